"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, where: Column, most: dict[int, int]) -> DataFrame:
    """``doc_id, text, label`` of about ``most[value]`` documents per value of ``label``.

    Chosen by a hash of ``doc_id``, so by nothing that is learned; rows whose
    label or id is null are left out, of several labels of a document the
    greatest counts. The ids are at most ``sum(most.values())`` or so rows and
    are broadcast. Each comes back once: of an id's several texts that of the
    least hash, nulls left out. Ids may be of any type.
    """
    known = labels.where(where & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.lit(0)
    for value, n in most.items():
        share = F.when(F.col("label") == value, int(min(1.0, n / counts.get(value, 1)) * (1 << 30))).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("label").alias("label"))
