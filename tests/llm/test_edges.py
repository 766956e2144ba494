"""Odd rows through all stages, clashing columns, repeated labelled ids, patterns of any kind."""

from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, mixing, nearcopies, quality
from ledgerloom.llm.labels import labelled_sample
from ledgerloom.llm.queries import rank_file
from ledgerloom.session import written

SF = "/root/testdata/sf0.001"
ODD = ["_mark", "mark", "_n", "n", "_times", "times", "key", "_id", "_part", "_parts", "_spreadpart", "node", "size", "taken"]


def odd(df):
    """``df`` with columns that operators might use for themselves."""
    return df.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in ODD})


def kept_whole(rows):
    for r in rows:
        assert all(r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}" for c in ODD)


def test_odd_rows_through_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = " ".join(f"word{k % 977} and the other thing" for k in range(60000)) + "."
    own = [(None, "A short text without an id, and nothing else."), (None, None), (10**9, None), (10**9 + 1, ""), (10**9 + 2, whole), (10**9 + 3, whole), (10**9 + 3, whole), (10**9 + 4, "One row that comes twice."), (10**9 + 4, "One row that comes twice.")]
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in own], docs.schema)
    for table in (odd(docs.unionByName(more)), odd(docs).limit(0)):
        now = written(table, "odd")
        n = now.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = written(stage(spark, now, SF), name)
            assert now.columns == table.columns
            rows = now.collect()
            kept_whole(rows)
            if name == "simhash" and n:
                ids = Counter(r.doc_id for r in rows)
                assert ids[None] == 2 and ids[10**9 + 3] == 0 and ids[10**9 + 4] == 1
        tokens = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
        assert bool(tokens) == bool(n) and len(tokens) == len(rows)


def test_columns_of_any_name(spark):
    docs = odd(spark.createDataFrame([(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, "a b c d e f", None), (None, "x y", "s")], "doc_id long, text string, source string"))
    near = nearcopies.keep_one_near(docs).collect()
    assert sorted(str(r.doc_id) for r in near) == ["1", "None"]
    kept_whole(near)
    mixed = mixing.mixed_documents(docs).collect()
    assert mixed
    kept_whole(mixed)


def test_labelled_ids_that_repeat(spark):
    docs = spark.createDataFrame([("a", f"text {k}") for k in range(500)] + [("b", "other words"), ("b", None), ("c", None)], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0), ("c", 1), (None, 1)], "doc_id string, quality int")
    sample = labelled_sample(docs, labels, "quality", F.lit(True), {0: 10, 1: 10})
    assert sorted((r.doc_id, r.label) for r in sample.collect()) == [("a", 1), ("b", 0)]
    assert quality.train(sample) is not None


def plain_terms(text):
    """Distinct words and repeats of a text, by the docstring."""
    words, n = text.split(), quality.RUN_WORDS
    runs = [words[a : a + n] for a in range(0, len(words) - n + 1, n)] + [words[-n:]]
    return min(len(set(r)) / len(r) for r in runs), sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)


def test_pieces_of_long_texts_leave_no_trace(monkeypatch):
    rng = np.random.default_rng(6)
    text = b" ".join(rng.choice([b"aa", b"bb", b"ccc", b"x1", b"Y."], 700)) + b" " + b"zz " * 90 + b" ".join(rng.choice([b"q", b"r", b"s"], 300))
    monkeypatch.setattr(quality, "RUN_WORDS", 64)
    whole = quality.Terms()(text)
    for piece in (57, 200, 1000):
        monkeypatch.setattr(quality, "PIECE", piece)
        assert (quality.Terms()(text) == whole).all()
    fewest, same = plain_terms(text)
    repeats = whole[-2 * quality._BINS :]
    assert repeats[quality._bin(same)] == 20 and repeats[quality._BINS + quality._bin(fewest)] == 20
    assert whole[: quality._TRIGRAMS].sum() == len(text) - 2 and whole[quality._TRIGRAMS : quality._TRIGRAMS + quality._WORDS].sum() == len(text.split())


def test_patterns_that_units_do_not_fit(spark):
    pattern = r"\p{L}+\.|\S|\s+"
    texts = ["The end. Of it.\n\n All.", "a.b.c", "", None, "x" * 50 + ". y" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    public = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(rank_file()), special_tokens={})
    for chunk in (1 << 15, 32):
        got = {r.doc_id: bytes(r.ids) for r in bpe.encode_documents(docs, rank_file(), pattern, chunk=chunk).collect()}
        assert got == {k: np.array(public.encode_ordinary(t or ""), "<u4").tobytes() for k, t in enumerate(texts)}
    same = bpe.encode_documents(docs, rank_file(), public_tokenizers.PATTERN, by_units=True).select("ids").collect()
    assert same == bpe.encode_documents(docs, rank_file(), public_tokenizers.PATTERN).select("ids").collect()
