"""Places of rows in groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import written


def group_key(column: Column) -> Column:
    """The value as text that is never null and sorts as UTF-8 bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no frame has such a column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_places(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``place`` (from 0, within the rows of one ``key``) and ``of`` (their number).

    ``key`` is a column without nulls. Rows are dealt by ranges of key and order,
    so a key with very many rows is spread over tasks; within each range Spark
    numbers the sorted rows, and what earlier ranges of the key hold is added:
    one row for each key of a range. Give a total order. ``rows`` is read twice,
    so pass a table that is cheap to read.
    """
    ranged = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    part = F.spark_partition_id()
    stored = written(ranged.withColumn("_range", part).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)), name)
    spans = stored.groupBy("_range", key).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        "_range",
        key,
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(Window.partitionBy(key)).alias("of"),
    )
    return stored.join(spans, ["_range", key]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")
