"""From raw documents to token ids: filters, near-dedup, source mix, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, mixing, nearcopies, quality, toxicity
from ledgerloom.llm.queries import rank_file, train_quality, train_toxicity
from ledgerloom.session import written

#: Near copies: the sets of five-word shingles have a similarity of 0.8 or more.
NEAR = {"shingle": 5, "similarity": 0.8}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.7.

    Null and empty texts stay, as do all documents if there are no labels of
    both kinds to learn from. Repeated rows and null ids are judged each; further
    columns stay; no documents give none.
    """
    scored = toxicity.score_documents(docs, train_toxicity(spark, sf_dir, docs), tuple(docs.columns), "_toxic")
    return scored.where("_toxic < 0.7").drop("_toxic")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is 0.3 or more.

    Null and empty texts score the share of good labels in the sample. Without
    labels of both kinds all documents stay. Repeated rows and null ids are
    judged each; further columns stay; no documents give none.
    """
    scored = quality.score_documents(docs, train_quality(spark, sf_dir, docs), tuple(docs.columns), "_quality")
    return scored.where("_quality >= 0.3").drop("_quality")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near copies.

    Texts without words are one group. Rows of null ids stay; rows that repeat
    the kept id and text are one. Further columns stay; no documents give none.
    """
    return nearcopies.keep_one_near(docs, **NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, to the nearest whole time.

    Documents without words are in no mix. A null source is a source, the last.
    Rows that repeat an id, or have none, share what they take together. Further
    columns stay; no documents give none.
    """
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256`` of every document that is left.

    Null and empty texts have no ids; repeated rows and null ids come back as
    often as they came; further columns go; no documents give no rows.
    """
    encoded = bpe.encode_documents(docs, rank_file(), public_tokenizers.PATTERN, by_units=True)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: SQL can express neither the trained models nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each but the last is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
