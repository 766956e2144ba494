from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import langid
from ledgerloom.llm.queries import op9_language_id

SCHEMA = "doc_id long, text string, lang string, score string"


def brute_em(counts, likelihood, allowed, rounds=25):
    share = np.array([a / sum(allowed) for a in allowed])
    for _ in range(rounds):
        new = np.zeros_like(share)
        for c, n in enumerate(counts):
            parts = share * likelihood[:, c]
            new += n * parts / parts.sum()
        share = new / sum(counts)
    return share, sum(n * np.log((share * likelihood[:, c]).sum()) for c, n in enumerate(counts))


def test_em_matches_one_text_at_a_time():
    rng = np.random.default_rng(0)
    likelihood, counts = rng.dirichlet(np.ones(20), 3), rng.integers(1, 9, (5, 20)).astype(float)
    allowed = np.array([[1, 1, 1], [1, 0, 1], [0, 0, 1], [1, 1, 0], [1, 1, 1]], float)
    share, value = langid.proportions(counts, likelihood, allowed)
    for n in range(5):
        want, best = brute_em(counts[n], likelihood, allowed[n])
        assert np.allclose(share[n], want) and np.isclose(value[n], best)


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = op9_language_id(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(docs[r.doc_id] == r.lang_pred for r in held) / len(held) >= 0.99


def test_mixtures_and_edge_rows(spark):
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang in ('en', 'fr')")
    rows = {r.lang: [] for r in train.select("lang").distinct().collect()}
    for r in train.orderBy("doc_id").collect():
        rows[r.lang].append(r.text[:400])
    en, fr = " ".join(rows["en"][:8]), " ".join(rows["fr"][:8])
    model = langid.train(train, F.col("lang"))
    odd = [(1, None), (2, ""), (3, "12 !! 34"), (4, en), (4, en), (5, en[:1500] + " " + fr[:1500]), (None, fr), (6, fr * 700)]
    docs = spark.createDataFrame([(i, t, "fr", "mine") for i, t in odd], SCHEMA)
    found = {(r.doc_id, r.lang_pred): r for r in langid.predict(docs, model).collect()}
    assert {k for k in found} >= {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "fr"), (6, "fr")}
    both = next(r for k, r in found.items() if k[0] == 5).languages
    assert set(both) == {"en", "fr"} and all(0.3 < p < 0.7 for p in both.values())
    assert set(found[4, "en"].languages) == {"en"} and found[1, "und"].score == 0
    assert langid.predict(docs, model).count() == len(odd) and langid.predict(docs.limit(0), model).count() == 0
    none = langid.train(docs.where("lang is null"), F.col("lang"))
    assert none is None and {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}


def test_pieces_of_a_long_text_give_the_same_grams():
    text = b"Some words AND others " * 40
    assert np.concatenate(list(langid.grams(text, 7))).tolist() == np.concatenate(list(langid.grams(text))).tolist()
    assert sum(len(g) for g in langid.grams(b"")) == 0


def test_rare_languages_are_learned(spark):
    """Of 4,000 rows two have the rare language; a sample of 60 has it all the same."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["red", "blue", "green", "over"], 9)), "en", "x") for i in range(3998)]
    rows += [(5000 + i, "zuvor schwarz jenseits zwischen", "de", "x") for i in range(2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs, F.col("lang"), sample=60)
    assert model.languages == ["de", "en"]
    found = {r.doc_id: r.lang_pred for r in langid.predict(docs.where("doc_id >= 3990"), model).collect()}
    assert found == {i: "en" if i < 5000 else "de" for i in [*range(3990, 3998), 5000, 5001]}
    many = [(i, f"text {i}", f"l{i % 50}", "x") for i in range(500)]
    assert len(langid.train(spark.createDataFrame(many, SCHEMA), F.col("lang"), sample=20).languages) == 50
