"""Mixing sources to target weights by Sainte-Laguë apportionment of blocks.

Documents are dealt over shards by a hash of their id. Within a shard each
source's documents stand in seeded order and are cut into blocks of equally
many words; the shard's blocks are apportioned to sources by highest quotients
and each source takes a seeded run of its blocks. No step needs a source, or
anything else that can hold a large part of the rows, in one task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.places import fresh, group_key
from ledgerloom.operators.joins import spread_join
from ledgerloom.session import written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most this many times its size, a document too.
MAX_REPEATS = 3


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, target`` from one row ``source, source_size`` per source.

    Targets share 100% of all sizes by weight, but none is above ``repeats``
    times its source's size; the excess is shared again by weight until none
    is. That is: one level of words per weight, at which sources that reach
    their limit stop. Sorted by limit per weight, the level follows from sums
    over the sources before and after. Works on one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    places = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("n", F.row_number().over(order) - 1).withColumn("weight", F.element_at(places, (F.col("n") % len(weights) + 1).cast("int")))
    limited = weighed.withColumn("most", F.col("source_size") * F.lit(repeats))
    every = Window.partitionBy()
    full = Window.orderBy(F.col("most") / F.col("weight"), "n")
    levels = (
        limited.withColumn("total", F.sum("source_size").over(every))
        .withColumn("before", F.coalesce(F.sum("most").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("after", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("after"))
    )
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(every)
    return levels.withColumn("share", level * F.col("weight")).select(
        "source", "source_size", F.when(F.col("share") <= F.col("most"), F.col("share")).otherwise(F.col("most").cast("double")).alias("target")
    )


def sainte_lague(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients vote / (2 * seats + 1), ``most`` at most.

    Ties go to the earlier one. Starts from seats that everyone surely gets and
    moves on by highest quotient, so the work is about the number of votes.
    """
    total = sum(votes)
    given = [0] * len(votes)
    if total > 0:
        given = [min(m, max(0, math.floor(v * seats / total) - len(votes))) for v, m in zip(votes, most, strict=True)]
    heap = [(-v / (2 * g + 1), i) for i, (v, g, m) in enumerate(zip(votes, given, most, strict=True)) if g < m and v > 0]
    heapq.heapify(heap)
    left = seats - sum(given)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        given[i] += 1
        left -= 1
        if given[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * given[i] + 1), i))
    return given


def mix(docs: DataFrame, seed: int = 42, weights: tuple = WEIGHTS, repeats: int = MAX_REPEATS, blocks: int = 1 << 20, shard_words: int = 1 << 22) -> DataFrame:
    """How many words of each document a mix with target weights takes.

    Returns ``doc_id, source, size, source_size, target, taken``; ``taken``
    counts repeats. A block has 1/``blocks`` of all words (1 word at least, 64
    at most), a shard about ``shard_words`` words or documents.

    Null texts have size 0, are never taken and count as documents. Null sources
    are one source, the last. Rows with the same doc_id and text count each.
    Null doc_ids are dealt by their size. An empty table gives an empty result.
    The same rows give the same result in any order and partitioning.
    """
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes, weights, repeats), "targets")
    total, rows = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    block = min(64, max(1, total // blocks))
    shards = max(1, -(-total // shard_words), -(-rows // shard_words))

    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("size"), F.col("size").cast("string")))))
    dealt = sized.withColumn("mark", mark).withColumn("shard", (F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") % shards).cast("int"))
    cells = dealt.groupBy("shard", "source").agg(F.sum("size").alias("cell_size"))
    aimed = cells.join(targets, cells.source.eqNullSafe(targets.source)).select(
        "shard",
        cells.source,
        "cell_size",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") * F.col("cell_size") / F.col("source_size")).otherwise(0.0).alias("aim"),
    )

    def apportion(shard: pd.DataFrame) -> pd.DataFrame:
        """One row per source of a shard: integer quotas of blocks."""
        shard = shard.sort_values("source", na_position="last", key=lambda s: s.map(lambda x: x.encode(), na_action="ignore"))
        blocks_of = [-(-int(s) // block) for s in shard["cell_size"]]
        quota = sainte_lague(shard["aim"].tolist(), math.floor(shard["aim"].sum() / block + 0.5), [repeats * b for b in blocks_of])
        return shard.assign(quota=quota, n_blocks=blocks_of)

    kind = dict(docs.dtypes)["source"]
    quotas = aimed.groupBy("shard").applyInPandas(
        apportion, f"shard int, source {kind}, cell_size long, source_size long, target double, aim double, quota long, n_blocks long"
    )
    order = Window.partitionBy("shard", "source").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("end", F.sum("size").over(order)).withColumnRenamed("shard", "in_shard").withColumnRenamed("source", "in_source")
    joined = placed.join(quotas, (F.col("in_shard") == F.col("shard")) & F.col("in_source").eqNullSafe(F.col("source")))

    # Every block is taken quota // n_blocks times; a run of quota % n_blocks
    # blocks from a seeded one, going round, once more.
    passes = F.when(F.col("n_blocks") > 0, F.floor(F.col("quota") / F.greatest("n_blocks", F.lit(1)))).otherwise(0)
    rest = F.col("quota") - passes * F.col("n_blocks")
    start_mark = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}run"), F.col("shard").cast("string"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("long")
    first = F.when(F.col("n_blocks") > 0, start_mark % F.greatest("n_blocks", F.lit(1))).otherwise(0)
    lo, hi = F.col("end") - F.col("size"), F.col("end")

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.least(hi, b * block) - F.greatest(lo, a * block), F.lit(0))

    until = first + rest
    once = overlap(first, F.least(until, F.col("n_blocks"))) + F.when(until > F.col("n_blocks"), overlap(F.lit(0), until - F.col("n_blocks"))).otherwise(0)
    return joined.select(
        "doc_id",
        F.col("in_source").alias("source"),
        "size",
        "source_size",
        "target",
        (passes * F.col("size") + once).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs``, each document as often as the mix takes it, to the nearest whole one.

    A document at the edge of a run of blocks is in if at least half of its
    words are taken; documents without words aren't in any mix. Rows that
    repeat a doc_id, or have none, share what these rows take together. Other
    columns may have any name; an empty table gives an empty result.
    """
    key, times, n = (fresh(name, docs) for name in ("key", "times", "n"))
    taken = mix(docs, **how).groupBy(group_key(F.col("doc_id")).alias(key)).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    told = taken.where("size > 0").select(key, F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias(times)).where(F.col(times) > 0)
    # Many rows may have no id, or the same one.
    joined = spread_join(docs.withColumn(key, group_key(F.col("doc_id"))), told, [key])
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), times))).select(docs.columns)
