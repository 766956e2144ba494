"""Reconciliation of several datasets of one entity.

Overlaps of any number of datasets take one pass: each key's set of platforms
is a bit mask, and only the few masks that occur are combined into pairs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.joins import missing_from, pairwise_full
from ledgerloom.operators.windows import average_rank
from ledgerloom.schemas import ALIASES


def canonicalize(df: DataFrame, entity: str) -> DataFrame:
    """The entity's canonical columns, each from the aliases that ``df`` has; absent ones null."""
    have = set(df.columns)
    out = []
    for name, aliases in ALIASES[entity].items():
        found = [F.col(f"`{a}`") for a in dict.fromkeys(aliases) if a in have]
        out.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def platform_masks(tagged: DataFrame, key: str, platforms: list[str]) -> DataFrame:
    """``key, mask``: bit n is set if the n-th platform has the key. Null keys are left out."""
    bit = F.coalesce(*[F.when(F.col("platform") == p, F.lit(1 << n)) for n, p in enumerate(platforms)]).cast("long")
    return tagged.where(F.col(key).isNotNull()).groupBy(key).agg(F.bit_or(bit).alias("mask"))


def pairwise_overlap(tagged: DataFrame, key: str, platforms: list[str]) -> DataFrame:
    """``platform_a, platform_b, common, only_a, only_b, jaccard`` of every unordered pair.

    An empty union gives Jaccard 0. One shuffle for any number of platforms.
    """
    spark = tagged.sparkSession
    masks = platform_masks(tagged, key, platforms).groupBy("mask").agg(F.count("*").alias("n"))
    pairs = spark.createDataFrame([(a, b, 1 << i, 1 << j) for (i, a), (j, b) in combinations(enumerate(platforms), 2)], "platform_a string, platform_b string, bit_a long, bit_b long")
    has = lambda bit: F.col("mask").bitwiseAND(F.col(bit)) != 0
    n = F.coalesce("n", F.lit(0))
    either = has("bit_a") | has("bit_b")
    sums = pairs.join(masks, either, "left").groupBy("platform_a", "platform_b").agg(
        F.sum(F.when(has("bit_a") & has("bit_b"), n).otherwise(0)).alias("common"),
        F.sum(F.when(has("bit_a") & ~has("bit_b"), n).otherwise(0)).alias("only_a"),
        F.sum(F.when(~has("bit_a") & has("bit_b"), n).otherwise(0)).alias("only_b"),
    )
    union = F.col("common") + F.col("only_a") + F.col("only_b")
    return sums.withColumn("jaccard", F.when(union > 0, F.round(F.col("common") / F.greatest(union, F.lit(1)), 6)).otherwise(0.0))


def field_match(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``field, matches, mismatches, percent`` on common keys; null on a side is a mismatch."""
    both = pairwise_full(a, b, key).where("a is not null and b is not null")
    flags = [F.count_if(F.coalesce(F.col(f"a.{f}") == F.col(f"b.{f}"), F.lit(False))).alias(f) for f in fields]
    one = both.agg(F.count("*").alias("_n"), *flags)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("matches")) for f in fields]))
    out = one.select("_n", rows.alias("r")).select("r.field", "r.matches", (F.col("_n") - F.col("r.matches")).alias("mismatches"), "_n")
    percent = F.when(F.col("_n") > 0, F.format_string("%.2f%%", F.col("matches") * 100.0 / F.col("_n"))).otherwise("0.00%")
    return out.withColumn("percent", percent).drop("_n")


def tolerant_equal(x: Column, y: Column, numeric: bool) -> Column:
    """Both absent, equal text, equal numbers; ``numeric`` also within 1e-4 relative."""
    dx, dy = x.cast("string").try_cast("double"), y.cast("string").try_cast("double")
    near = F.abs((dx - dy) / F.when(F.abs(dx) + F.abs(dy) / 2 != 0, F.abs(dx) + F.abs(dy) / 2)) < 1e-4
    same = (x.isNull() & y.isNull()) | (x.cast("string") == y.cast("string")) | (dx == dy)
    return F.coalesce(same | near if numeric else same, same, F.lit(False))


def tolerant_diff(a: DataFrame, b: DataFrame, key: str, fields: dict[str, bool]) -> DataFrame:
    """Common keys with ``differs``: the fields that differ; ``fields`` says which are numeric."""
    both = pairwise_full(a, b, key).where("a is not null and b is not null")
    differs = [F.when(~tolerant_equal(F.col(f"a.{f}"), F.col(f"b.{f}"), numeric), F.lit(f)) for f, numeric in fields.items()]
    return both.select(key, F.array_compact(F.array(*differs)).alias("differs"))


def content_similarity(a: DataFrame, b: DataFrame, key: str, fields: dict[str, bool]) -> DataFrame:
    """Common keys, identical ones and their share, and Jaccard of the keys."""
    diff = tolerant_diff(a, b, key, fields).agg(F.count("*").alias("common"), F.count_if(F.size("differs") == 0).alias("identical"))
    sizes = pairwise_full(a, b, key).agg(F.count("*").alias("_all"))
    out = diff.crossJoin(sizes)
    share = lambda x, y: F.when(F.col(y) > 0, F.round(F.col(x) / F.greatest(F.col(y), F.lit(1)), 6)).otherwise(0.0)
    return out.select("common", "identical", share("identical", "common").alias("similarity"), share("common", "_all").alias("jaccard"))


def value_diff(a: DataFrame, b: DataFrame, key: str, col: str, fallback: str | None = None) -> DataFrame:
    """Common keys whose value differs, the value or else the fallback column's."""
    both = pairwise_full(a, b, key).where("a is not null and b is not null")
    of = lambda s: F.coalesce(F.col(f"{s}.{col}"), *([F.col(f"{s}.{fallback}")] if fallback else []))
    return both.select(key, of("a").alias("value_a"), of("b").alias("value_b")).where("not value_a <=> value_b")


def key_level_compare(tagged: DataFrame, levels: dict[str, str], platforms: list[str]) -> DataFrame:
    """Pairwise overlap at several levels of keys."""
    out = None
    for level, key in levels.items():
        part = pairwise_overlap(tagged, key, platforms).select(F.lit(level).alias("level"), "*")
        out = part if out is None else out.union(part)
    return out


def _wide(points: DataFrame, key: str, platforms: list[str]) -> DataFrame:
    """One row per account, a column per platform; a missing account has 0."""
    return points.groupBy(key).pivot("platform", platforms).agg(F.sum("points")).na.fill(0.0, platforms)


def pearson_matrix(points: DataFrame, key: str, platforms: list[str]) -> DataFrame:
    """``platform_a, platform_b, r`` on ln(points + 1); accounts that are 0 on both are skipped.

    Without variance r is 0.
    """
    wide, cols, pairs = _wide(points, key, platforms), [], list(combinations(platforms, 2))
    for a, b in pairs:
        used = (F.col(a) != 0) | (F.col(b) != 0)
        cols.append(F.corr(F.when(used, F.log1p(a)), F.when(used, F.log1p(b))).alias(f"{a}|{b}"))
    return _pairs_of(wide.agg(*cols), pairs)


def _pairs_of(one: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(a).alias("platform_a"), F.lit(b).alias("platform_b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])
    r = F.when(F.col("x.r").isNull() | F.isnan("x.r"), 0.0).otherwise(F.round("x.r", 6))
    return one.select(F.explode(rows).alias("x")).select("x.platform_a", "x.platform_b", r.alias("r"))


def spearman_matrix(points: DataFrame, key: str, platforms: list[str]) -> DataFrame:
    """The same on average ranks, ranked for each pair on the accounts it uses, by ranges of values."""
    wide, pairs, out = _wide(points, key, platforms), list(combinations(platforms, 2)), None
    for a, b in pairs:
        used = wide.where((F.col(a) != 0) | (F.col(b) != 0)).select(F.col(a).alias("x"), F.col(b).alias("y"))
        ranked = average_rank(average_rank(used, "x", "rank_x"), "y", "rank_y")
        part = _pairs_of(ranked.agg(F.corr("rank_x", "rank_y").alias(f"{a}|{b}")), [(a, b)])
        out = part if out is None else out.union(part)
    return out


def missing_pairs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of one side only, with the side."""
    left, right = missing_from(a, b, key), missing_from(b, a, key)
    return left.withColumn("only_in", F.lit("a")).unionByName(right.withColumn("only_in", F.lit("b")))


def sender_overlap(tagged: DataFrame, sender: str, platforms: list[str]) -> DataFrame:
    """Overlap of senders with each side's rows."""
    counts = tagged.groupBy("platform").agg(F.count("*").alias("rows"))
    overlap = pairwise_overlap(tagged, sender, platforms)
    for side in ("a", "b"):
        overlap = overlap.join(counts.select(F.col("platform").alias(f"platform_{side}"), F.col("rows").alias(f"rows_{side}")), f"platform_{side}", "left")
    return overlap


def completeness(counts: DataFrame, expected: DataFrame, key: str, near: float = 98) -> DataFrame:
    """Actual against expected rows: complete, near (``near`` per cent) or incomplete."""
    joined = expected.join(counts, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    percent = F.when(F.col("expected") > 0, F.round(F.col("actual") * 100.0 / F.col("expected"), 4)).otherwise(100.0)
    status = F.when(F.col("actual") >= F.col("expected"), "complete").when(F.col("percent") >= near, "near").otherwise("incomplete")
    return joined.withColumn("percent", percent).withColumn("status", status)


def coverage_matrix(counts: DataFrame, platforms: list[str]) -> DataFrame:
    """Metrics by platform: ``metric`` and a column per platform, missing 0."""
    return counts.groupBy("metric").pivot("platform", platforms).agg(F.sum("n")).na.fill(0, platforms)
