"""Aggregates: counts, ranges, histograms, coverage, sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.windows import number_bitmaps
from ledgerloom.functions.columns import path_tokens
from ledgerloom.operators.windows import share_of_total


def row_counts(tagged: DataFrame, platforms: DataFrame) -> DataFrame:
    """Rows per platform and whether any came; platforms without rows count 0."""
    counts = tagged.groupBy("platform").agg(F.count("*").alias("n"))
    return platforms.join(counts, "platform", "left").select("platform", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("loaded"))


def unique_counts(df: DataFrame, by: str, cols: list[str], approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(by).agg(*[count(c).alias(f"unique_{c}") for c in cols])


def unique_addresses(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Distinct addresses of several columns together: ``n`` of each group, null and empty ones left out."""
    found = df.select(*by, F.explode(F.array(*cols)).alias("_address")).where("_address <> ''").distinct()
    return found.groupBy(*by).agg(F.count("*").alias("n"))


def block_range(df: DataFrame, col: str = "block_number", by: list[str] | None = None) -> DataFrame:
    """Least, greatest, known count, and span of a column."""
    return df.groupBy(*(by or [])).agg(
        F.min(col).alias("min_block"), F.max(col).alias("max_block"), F.count(col).alias("n"), (F.max(col) - F.min(col) + 1).alias("span")
    )


def time_range(df: DataFrame, seconds: Column, by: list[str] | None = None) -> DataFrame:
    """Least and greatest time, zeros ignored."""
    known = F.when(seconds != 0, seconds)
    return df.groupBy(*(by or [])).agg(F.min(known).alias("min_time"), F.max(known).alias("max_time"))


def volume_sums(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"sum_{c}") for c in cols])


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` most frequent values with count and share of all rows; ties by value."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return share_of_total(counts).orderBy(F.desc("n"), key).limit(k)


def token_stats(df: DataFrame, path: str = "path") -> DataFrame:
    """Token frequency over exploded comma paths."""
    tokens = df.select(F.explode(path_tokens(F.col(path))).alias("token")).where("token <> ''")
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def path_summary(df: DataFrame, path: str = "path") -> DataFrame:
    """Distinct tokens and mean path length."""
    tokens = path_tokens(F.col(path))
    exploded = df.select(F.explode(tokens).alias("token")).where("token <> ''").agg(F.count_distinct("token").alias("distinct_tokens"))
    return exploded.crossJoin(df.agg(F.round(F.avg(F.size(tokens)), 6).alias("mean_path_length")))


def null_key_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows with and without a key; null, empty and ``0x`` are none."""
    missing = F.col(col).isNull() | F.col(col).isin("", "0x")
    return df.agg(F.count_if(~missing).alias("valid"), F.count_if(missing).alias("missing"))


def traces_per_tx(df: DataFrame, tx: str, key: str) -> DataFrame:
    """Records, transactions, those with several traces, most and mean traces, distinct keys."""
    per = df.groupBy(tx).agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"))
    return per.agg(
        F.sum("n").alias("records"), F.count("*").alias("transactions"), F.count_if(F.col("keys") > 1).alias("multi"),
        F.max("keys").alias("most"), F.round(F.sum("keys") / F.count("*"), 6).alias("mean"), F.sum("keys").alias("distinct_keys"),
    )


def bucket_histogram(df: DataFrame, col: str, size: int, lo: int, hi: int, by: str | None = None) -> DataFrame:
    """Rows per bucket of ``size`` numbers from ``lo``; empty ones are 0, the last ends at ``hi``."""
    spark = df.sparkSession
    buckets = spark.range(0, (hi - lo) // size + 1).select((F.col("id") * size + lo).alias("start"))
    buckets = buckets.withColumn("stop", F.least(F.col("start") + size - 1, F.lit(hi)))
    if by:
        buckets = df.select(by).distinct().withColumn("start", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long"), F.lit(size).cast("long"))))
        buckets = buckets.withColumn("stop", F.least(F.col("start") + size - 1, F.lit(hi)))
    inside = df.where(F.col(col).between(lo, hi))
    keys = ([by] if by else []) + ["start"]
    counts = inside.withColumn("start", (F.floor((F.col(col) - lo) / size) * size + lo).cast("long")).groupBy(*keys).agg(F.count("*").alias("n"))
    return buckets.join(counts, keys, "left").select(*keys, "stop", F.coalesce("n", F.lit(0)).alias("n"))


def coverage(df: DataFrame, col: str, lo: int, hi: int, by: str) -> DataFrame:
    """Distinct numbers against those expected, in per cent, with a label.

    Numbers are counted by bitmaps. ``partial with gaps`` has holes between its own least and greatest number.
    """
    inside = df.where(F.col(col).between(lo, hi))
    spans = inside.groupBy(by).agg((F.max(col) - F.min(col) + 1).alias("span"))
    counts = number_bitmaps(inside, col, by).groupBy(F.col(by).alias("_by")).agg(F.sum(F.bitmap_count("bits")).alias("found"))
    inside = spans.join(counts, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    expected = hi - lo + 1
    label = F.when(F.col("found") == expected, "complete").when(F.col("found") < F.col("span"), "partial with gaps").otherwise("partial without gaps")
    return inside.select(by, "found", F.lit(expected).cast("long").alias("expected"), F.round(F.col("found") * 100.0 / expected, 4).alias("percent"), label.alias("pattern"))


def count_where(df: DataFrame, **predicates: Column) -> DataFrame:
    return df.agg(*[F.count_if(p).alias(name) for name, p in predicates.items()])


def span(df: DataFrame, ts: str, by: list[str] | None = None) -> DataFrame:
    """Seconds between the first and the last time; 0 for none."""
    seconds = F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))
    return df.groupBy(*(by or [])).agg(F.coalesce(seconds / 1e6, F.lit(0.0)).alias("seconds"))


def run_summary(runs: DataFrame, case: str, seconds: str, usable: Column) -> DataFrame:
    """Runs, mean, greatest and least per case, without the rows that aren't usable."""
    return runs.where(usable).groupBy(case).agg(
        F.count("*").alias("n"), F.round(F.avg(seconds), 6).alias("mean"), F.max(seconds).alias("most"), F.min(seconds).alias("least")
    )


def event_counter(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def interval_gauge(df: DataFrame, ts: str, value: str, width: str = "60 minutes") -> DataFrame:
    """Last-known style aggregate per interval; empty intervals are left out."""
    return df.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.max(value).alias("most")).select(F.unix_timestamp("w.start").alias("start"), "n", "most")
