"""Windows, ranks, gaps, paging, sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ordered import DEPTH, ordered_scan
from ledgerloom.session import written


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Exactly one row per key, the greatest by ``order`` (give a total order).

    An aggregate, so a key with very many rows is reduced before the shuffle.
    Null orders come last.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    if list(order) == rest:
        # The order is the row itself, so it is shuffled once.
        return df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.max(F.struct(*rest)).alias("_row")).select(*[(F.col(f"_key_{c}") if c in keys else F.col("_row").getField(c)).alias(c) for c in df.columns])
    greatest = F.max_by(F.struct(*df.columns), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(greatest.alias("_row")).select("_row.*")


def seq_in_tx(df: DataFrame, tx: str, order: list[str]) -> DataFrame:
    """``seq``: 1, 2, ... within a transaction."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(tx).orderBy(*order)))


def average_rank(df: DataFrame, col: str, name: str = "rank") -> DataFrame:
    """Ranks from 1 with ties averaged, over the whole table.

    Only distinct values with their counts are put in order, range-partitioned:
    each partition's own sums are added to the totals of the partitions before.
    """
    counts = df.groupBy(col).agg(F.count("*").alias("_n")).repartitionByRange(col).withColumn("_part", F.spark_partition_id())
    counts = written(counts, "ranks")
    totals = counts.groupBy("_part").agg(F.sum("_n").alias("_sum"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    upto = F.sum("_n").over(Window.partitionBy("_part").orderBy(col))
    ranks = counts.join(before.select("_part", "_before"), "_part").withColumn(name, F.col("_before") + upto - (F.col("_n") - 1) / 2)
    return df.join(ranks.select(F.col(col).alias("_value"), name), F.col(col).eqNullSafe(F.col("_value"))).drop("_value")


def out_of_order(df: DataFrame, key: str, arrival: list[str], block: str, depth: int = DEPTH) -> DataFrame:
    """``is_late``: a row's block is below the highest of the key's rows that came before.

    Keys with more than ``depth`` rows are cut into ranges of arrival.
    """
    seen = next(c for c in ("_seen" + "_" * k for k in range(len(df.columns) + 1)) if c not in df.columns)
    scanned = ordered_scan(df, key, arrival, highest={seen: block}, depth=depth)
    return scanned.withColumn("is_late", F.coalesce(F.col(seen) > F.col(block), F.lit(False))).drop(seen)


def number_bitmaps(df: DataFrame, col: str, *by: str) -> DataFrame:
    """``by, bucket, bits``: the distinct numbers as a bitmap for each 32,768 of them.

    Bitmaps are made before the shuffle, so a bucket is one row of 4 KB from each
    task, however many rows it has. For numbers that are dense, such as blocks.
    """
    n = F.col(col).cast("long")
    bucket = F.bitmap_bucket_number(n).alias("bucket")
    return df.where(n.isNotNull()).groupBy(*by, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bits"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bitmap the least and greatest number, and what is missing between them."""
    for batch in batches:
        rows = []
        for bucket, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
            numbers = (bucket - 1) * 32768 + at + 1 if bucket > 0 else (bucket * 32768 - at)[::-1]
            holes = np.flatnonzero(np.diff(numbers) > 1)
            rows.append((int(numbers[0]), int(numbers[-1]), (numbers[holes] + 1).tolist(), (numbers[holes + 1] - 1).tolist()))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["lo", "hi", "starts", "stops"])


def gaps(df: DataFrame, col: str) -> DataFrame:
    """Missing ranges between the least and the greatest number: ``start, stop, length``.

    From a bitmap for each 32,768 numbers. Only their edges, one row each, are
    put in order together.
    """
    runs = number_bitmaps(df, col).select("bucket", "bits").mapInArrow(_runs, "lo long, hi long, starts array<long>, stops array<long>")
    runs = runs.withColumn("next", F.lead("lo").over(Window.orderBy("lo")))
    found = F.arrays_zip(F.col("starts").alias("start"), F.col("stops").alias("stop"))
    across = F.when(F.col("next") - F.col("hi") > 1, F.array(F.struct((F.col("hi") + 1).alias("start"), (F.col("next") - 1).alias("stop"))))
    every = runs.select(F.explode(F.when(across.isNull(), found).otherwise(F.concat(found, across))).alias("gap"))
    return every.select("gap.start", "gap.stop", (F.col("gap.stop") - F.col("gap.start") + 1).alias("length"))


def share_of_total(df: DataFrame, count: str = "n", name: str = "share") -> DataFrame:
    """Each row's count as a percentage of all rows' counts; the total is one row."""
    total = df.agg(F.sum(count).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.round(F.col(count) * 100.0 / F.col("_total"), 4)).drop("_total")


def order_by(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """Rows in a total order, by ranges of it."""
    return df.orderBy(*order)


def page(df: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def keyset_page(df: DataFrame, key: str, last: object, n: int) -> DataFrame:
    """The first ``n`` rows after a key."""
    rows = df if last is None else df.where(F.col(key) > F.lit(last))
    return rows.orderBy(key).limit(n)


def first_n_examples(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def latest_rows(df: DataFrame, col: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(col), F.desc(tie)).limit(n)


def both_sides(transfers: DataFrame) -> DataFrame:
    """A row for the sender and one for the recipient, from one scan."""
    sides = F.array(F.struct(F.col("from_addr").alias("account")), F.struct(F.col("to_addr").alias("account")))
    return transfers.withColumn("_side", F.explode(sides)).select("_side.account", "block_number", "ts")


def signed_sides(transfers: DataFrame) -> DataFrame:
    """``id, account, sign, delta, mint, block_number, ts``: ids end in ``_f`` or ``_t``.

    Amounts keep their type; text, as decoded logs have it, becomes
    DECIMAL(38,0), and one that has more digits is an error. The time is ``ts``
    or else ``block_timestamp``.
    """
    kind = transfers.schema["value"].dataType.simpleString()
    value = F.col("value").cast("decimal(38,0)") if kind == "string" else F.col("value")
    kind = "decimal(38,0)" if kind == "string" or kind.startswith("decimal") else kind
    ts = "ts" if "ts" in transfers.columns else "block_timestamp"
    zero = F.lit(0).cast(kind)
    minted = F.when(F.col("from_addr") == F.lit("0x" + "0" * 40), value).otherwise(zero)
    sides = F.array(
        F.struct(F.lit("_f").alias("suffix"), F.col("from_addr").alias("account"), F.lit(-1).alias("sign"), (-value).cast(kind).alias("delta"), zero.alias("mint")),
        F.struct(F.lit("_t").alias("suffix"), F.col("to_addr").alias("account"), F.lit(1).alias("sign"), value.cast(kind).alias("delta"), minted.cast(kind).alias("mint")),
    )
    out = transfers.withColumn("_s", F.explode(sides))
    return out.select(F.concat("id", "_s.suffix").alias("id"), "_s.account", "_s.sign", "_s.delta", "_s.mint", "block_number", F.col(ts).alias("ts"))


def distinct_accounts(sides: DataFrame) -> DataFrame:
    return sides.select("account").distinct()


def key_intersect(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def key_except(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).subtract(b.select(key))


def key_union(frames: list[DataFrame], key: str) -> DataFrame:
    out = frames[0].select(key)
    for f in frames[1:]:
        out = out.union(f.select(key))
    return out.distinct()


def dedup(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key with ``duplicates``, how many others there were: an aggregate."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(F.col(key).alias("_key")).agg(first, (F.count("*") - 1).alias("duplicates")).select("_row.*", "duplicates")
