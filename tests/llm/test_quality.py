from __future__ import annotations

import tracemalloc
import zlib

import numpy as np

from ledgerloom.llm import quality
from ledgerloom.llm.queries import op2_quality

SCHEMA = "doc_id long, text string, lang string, score string, label int"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    found = op2_quality(spark, "/root/testdata/sf0.1").collect()
    assert len(found) == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    good, poor = [r for r in held if truth[r.doc_id]], [r for r in held if not truth[r.doc_id]]
    assert sum(r.predicted for r in good) / len(good) >= 0.99
    assert sum(r.predicted for r in poor) / len(poor) <= 0.05


def test_terms_of_words():
    """Hashes are those of the words alone, wherever they stand, in pieces or whole."""
    terms = quality.Terms()
    hashes = lambda t: quality.word_hashes(np.frombuffer(t, np.uint8), terms.powers, terms.inverse).tolist()
    a, b, c = (hashes(w)[0] for w in (b"one", b"two", b"oneb"))
    assert hashes(b" one\ttwo  one\n") == [a, b, a] and len({a, b, c}) == 3 and hashes(b"  ") == hashes(b"") == []
    counts = terms(b"Ab 1!")
    assert counts[: quality._TRIGRAMS].sum() == 3 and counts[quality._TRIGRAMS : quality._TRIGRAMS + quality._WORDS].sum() == 2


def test_vote_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    counts = rng.poisson(0.3, (60, quality.TERMS)).astype(np.float32)
    labels = rng.integers(0, 2, 60)
    model = quality.Model(counts, labels)
    new = rng.poisson(0.3, (9, quality.TERMS)).astype(np.float32)
    got = model.vote(new)
    for row, score in zip(model.latent(new), got, strict=True):
        cosine = [float(row @ v) for v in model.vectors]
        near = sorted(range(60), key=lambda i: -cosine[i])[: quality.NEIGHBOURS]
        weight = [max(cosine[i], 0) for i in near]
        assert np.isclose(score, sum(w * labels[i] for w, i in zip(weight, near, strict=True)) / sum(weight), atol=1e-4)


def test_edge_rows(spark):
    good = [f"Plain words of number {i}, with a few more words that follow them here." for i in range(40)]
    poor = [f"BUY!! NOW!! {'CHEAP!! ' * (i % 7 + 3)}" for i in range(40)]
    sample = spark.createDataFrame([(n, t, int(n < 40)) for n, t in enumerate(good + poor)], "doc_id long, text string, label int")
    model = quality.train(sample)
    rows = [(1, good[0]), (1, good[0]), (2, poor[0]), (3, None), (4, ""), (None, poor[1]), (5, good[3] * 30_000), (6, "x" * 1_200_000)]
    docs = spark.createDataFrame([(*r, "en", "mine", 0) for r in rows], SCHEMA)
    found = sorted(((r.doc_id or 0, round(r.score, 3)) for r in quality.score_documents(docs, model).collect()))
    assert [i for i, _ in found] == [0, 1, 1, 2, 3, 4, 5, 6]
    score = dict(found)
    assert score[1] > 0.9 > 0.1 > score[2] >= 0 and score[0] < 0.1 and score[3] == score[4] == 0.5 and score[5] > 0.5
    assert quality.score_documents(docs.limit(0), model).count() == 0
    assert quality.train(sample.where("label = 1")) is None
    assert {r.score for r in quality.score_documents(docs, None).collect()} == {1.0}
    whole = quality.score_documents(docs, model, tuple(docs.columns), "_q")
    assert whole.columns == [*docs.columns, "_q"] and whole.drop("_q").exceptAll(docs).count() == 0


def test_training_holds_one_matrix():
    """Beyond the counts it was given, training takes less than half their size."""
    rng = np.random.default_rng(4)
    counts = np.where(rng.random((1500, quality.TERMS), np.float32) < 0.1, np.float32(2), np.float32(0))
    labels, whole = rng.integers(0, 2, len(counts)), quality.Model(counts, np.arange(len(counts)) % 2)
    assert counts.max() == 2  # kept, unless told otherwise
    size = counts.nbytes
    tracemalloc.start()
    model = quality.Model(counts, labels, keep=False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < size / 2 and (model.vectors == whole.vectors).all()
