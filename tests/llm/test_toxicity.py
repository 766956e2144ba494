from __future__ import annotations

import math
import re
import zlib
from functools import cache

import numpy as np
import pytest

from ledgerloom.llm import toxicity
from ledgerloom.llm.labels import labelled_sample
from ledgerloom.llm.queries import fold, op5_toxicity

SCHEMA = "doc_id long, text string, lang string, score string, label int"


def corpus(n=400, seed=3):
    """Made-up prose; every fourth document has two insults somewhere."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("aeioulnrst"), int(rng.integers(3, 9)))) for _ in range(3000)]
    texts, labels = [], []
    for i in range(n):
        doc = list(rng.choice(words, int(rng.integers(5, 300))))
        if i % 4 == 0:
            for insult in rng.choice(["wretchbag", "scumface", "dunghead"], 2):
                doc[int(rng.integers(len(doc)))] = insult
        texts.append(" ".join(doc).encode())
        labels.append(int(i % 4 == 0))
    return texts, labels


@pytest.fixture(scope="module")
def model(spark):
    texts, labels = corpus(800)
    return toxicity.train(spark.createDataFrame([(n, t.decode(), y) for n, (t, y) in enumerate(zip(texts, labels, strict=True))], "doc_id long, text string, label int"))


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    found = op5_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert len(found) == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    toxic, clean = [r for r in held if truth[r.doc_id]], [r for r in held if not truth[r.doc_id]]
    # About a fifth of this table's toxic labels are on texts without any insult.
    assert sum(r.predicted for r in toxic) / len(toxic) >= 0.75
    assert sum(r.predicted for r in clean) / len(clean) <= 0.03


def test_misspellings_and_edge_rows(spark, model):
    clean = corpus(seed=4)[0][1].decode()
    bad = ["SCUMFACED", "wretchbags!", "dungheads,"]
    rows = [(n, f"{clean} {w} {clean}") for n, w in enumerate(bad)] + [(10, clean), (11, None), (12, ""), (13, " \n"), (14, "scumface"), (14, "scumface"), (None, clean), (15, f"{clean} " * 2000 + "scumface " + f"{clean} " * 2000), (16, "x" * 200_000), (17, f"{clean} " * 3000)]
    docs = spark.createDataFrame([(*r, "en", "mine", 0) for r in rows], SCHEMA)
    found = {(r.doc_id, r.score >= 0.7) for r in toxicity.score_documents(docs, model).collect()}
    assert found >= {(0, True), (1, True), (2, True), (10, False), (11, False), (12, False), (13, False), (14, True), (None, False), (15, True), (17, False)}
    assert toxicity.score_documents(docs, model).count() == len(rows)
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
    assert {r.score for r in toxicity.score_documents(docs, None).collect()} == {0.0}


def test_inference_is_the_trained_softmax():
    """A window's mean of word scores, in pieces or whole."""
    scores = np.random.default_rng(1).normal(size=50)
    assert np.allclose(toxicity.window_means(scores), [scores[i : i + 3].mean() for i in range(48)])
    assert np.allclose(toxicity.window_means(scores[:2]), scores[:2].mean())


def sample(spark, *rows):
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "doc_id long, text string, label int")


def test_one_class_gives_no_model(spark):
    assert toxicity.train(sample(spark, ("a b", 1))) is None and toxicity.train(sample(spark)) is None
    assert toxicity.train(sample(spark, ("", 0), (None, 0), (" ", 0), ("a", 1))) is None


def plain_slots(text):
    """The runs that each slot of a text is read by, from the text as a whole."""
    parts = re.split(rb"""[\s"&'()+,\-./:;<=>\[\\\]^_`{|}~]+""", text.encode().lower())
    for part in parts:
        marked = b"<" + part.strip(b"!?*#$%") + b">"
        if len(marked) == 2:
            continue
        if len(marked) <= toxicity.RUN:
            yield [marked]
        for at in range(0, len(marked) - toxicity.RUN + 1, toxicity.RUN) if len(marked) > toxicity.RUN else ():
            stretch = marked[at : at + 2 * toxicity.RUN - 1]
            yield [stretch[i : i + k] for k in toxicity.RUNS for i in range(len(stretch) - k + 1)]


def plain_score(text, model):
    """The score of a text, slot by slot and window by window, without caches or pieces."""

    @cache
    def unit(u):
        grams = [zlib.crc32(u[i : i + k]) % toxicity.BUCKETS for k in (3, 4, 5) for i in range(len(u) - k + 1)]
        grams += [zlib.crc32(u, 7) % toxicity.BUCKETS] * (u[:1] == b"<" and u[-1:] == b">")
        return sum(float(model.buckets[g]) for g in grams) / len(grams)

    of = [max(map(unit, runs)) for runs in plain_slots(text or "")]
    if not of:
        return 0.0
    means = [sum(of[i : i + toxicity.WINDOW]) / len(of[i : i + toxicity.WINDOW]) for i in range(max(1, len(of) - toxicity.WINDOW + 1))]
    return 1 / (1 + math.exp(-min(40, max(-40, model.scale * max(means) + model.offset))))


def test_scores_are_those_of_a_plain_scorer(spark, model):
    """The query's operator on whole documents, very long ones among them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("text is null or not text rlike '[\u0080-\u00bf\u2000-\u206f\u3000-\u303f\uff00-\uff20]'")
    extra = spark.createDataFrame([(-1, "wretchbag " + "x, y " * 600_000), (-2, "é" * 500), (-6, "!" * 3_000_000 + "scumface"), (-8, "!" * 1_200_000 + "scumface a b c d"), (-9, "a b scumface c" + " " * 1_200_000), (-7, "ab" * 1_500_000 + "wretchbag"), (-3, "_".join(["abc"] * 300)), (-4, None), (-5, "\n"), (-5, "\n")], "doc_id long, text string")
    rows = docs.union(extra)
    want = sorted((r.doc_id, round(plain_score(r.text, model), 9)) for r in rows.collect())
    assert sorted((r.doc_id, round(r.score, 9)) for r in toxicity.score_documents(rows, model).collect()) == want


def test_training_steps_follow_the_gradient():
    """The gradients of the joint training against differences of the loss."""
    rng = np.random.default_rng(1)
    trainer = toxicity.Trainer()
    windows = [[bytes(rng.choice(list(b"abcd"), int(rng.integers(1, 7)))) for _ in range(int(rng.integers(1, 4)))] for _ in range(6)]
    target = np.array([0, 1, 1, 0, 0, 1])
    bags = toxicity._bags(windows)

    def loss():
        total = 0.0
        for window, label in zip(windows, target, strict=True):
            vector = np.mean([trainer.embedding[toxicity.word_grams(w)].mean(axis=0) for w in window], axis=0)
            logits = vector @ trainer.softmax + trainer.bias
            total += 0.5 / (target == label).sum() * (np.log(np.exp(logits).sum()) - logits[label])
        return total

    for values, (where, g) in zip((trainer.embedding, trainer.softmax, trainer.bias), trainer.gradients(*bags, target), strict=True):
        rows = where if isinstance(where, np.ndarray) else np.arange(len(values))
        for n in range(min(5, len(rows))):
            at = (rows[n], 0) if values.ndim == 2 else (rows[n],)
            held = values[at]
            values[at] = held + 1e-6
            up = loss()
            values[at] = held - 1e-6
            down = loss()
            values[at] = held
            assert (up - down) / 2e-6 == pytest.approx(g[n, 0] if values.ndim == 2 else g[n], abs=1e-6)
    before = loss()
    trainer.fit(windows, target, steps=20)
    assert loss() < before


def test_long_labelled_texts_train_whole(spark):
    """Insults only in the middle of labelled texts of 300 kB: all of them are read."""
    texts, labels = corpus(60)
    clean = " ".join(t.decode() for t, y in zip(texts, labels, strict=True) if not y)
    clean = clean * (150_000 // len(clean) + 1)
    rows = [(f"{clean} scumface {clean}" if n % 3 == 0 else f"{clean} {clean}", int(n % 3 == 0)) for n in range(12)]
    trained = toxicity.train(sample(spark, *rows))
    found = {r.doc_id: r.score >= 0.7 for r in toxicity.score_documents(sample(spark, (f"{clean} scumface", 0), (clean, 0)), trained).collect()}
    assert found == {0: True, 1: False}


def test_worst_windows():
    scores = toxicity._Scores(np.random.default_rng(3).normal(size=toxicity.BUCKETS))
    text = b" ".join(bytes([97 + n % 26, 97 + n % 7, 97 + n % 5]) for n in range(200))
    slots = [b"<" + w + b">" for w in text.split()]
    means = [np.mean([scores[w] for w in slots[i : i + 3]]) for i in range(198)]
    worst, found = toxicity.worst_windows(text, scores, 2)
    order = np.argsort(-np.array(means), kind="stable")[:2]
    assert worst == pytest.approx(max(means)) and found == [slots[i : i + 3] for i in order]
    assert toxicity.any_window(text, 5) in [slots[i : i + 3] for i in range(198)] and toxicity.any_window(b"", 5) == []
    assert toxicity.worst_windows(b" ", scores, 2) == (None, []) and toxicity.worst_windows(b"|| !!! ***", scores, 2) == (None, [])


def test_sample_keeps_to_bounds_and_folds(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "mine", 7) for i in range(400)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0) if i % 5 else None) for i in range(400)] + [(1, 1), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.label for r in labelled_sample(docs, labels, "toxic", fold(3) != 1, {0: 10**6, 1: 10**6}).collect()}
    assert got == {i: int(i % 4 == 0 or i == 1) for i in range(400) if i % 5 and zlib.crc32(str(i).encode()) % 3 != 1}
    few = [r.label for r in labelled_sample(docs, labels, "toxic", fold(3) != 1, {0: 40, 1: 10}).collect()]
    assert 20 <= few.count(0) <= 60 and 2 <= few.count(1) <= 20


def test_long_words_are_scored_whole(spark, model):
    """An insult in the middle of text that is joined by anything but ASCII white space, or by nothing."""
    words = corpus(seed=4)[0][1].decode().split()
    words = (words * 40)[:400]
    bad = [*words[:200], "scumface", *words[200:]]
    joints = ["_", "-", ",", "\u00a0", "\u3000", "\u2009", "", "."]
    rows = [(n, j.join(bad)) for n, j in enumerate(joints)] + [(100 + n, j.join(words)) for n, j in enumerate(joints)]
    rows += [(200, " ".join([*words[:9], "_".join(bad), *words[9:]])), (201, " ".join([*words[:9], "_".join(words), *words[9:]]))]
    docs = spark.createDataFrame([(*r, "en", "mine", 0) for r in rows], SCHEMA)
    found = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    assert {i for i, s in found.items() if s >= 0.7} == {*range(len(joints)), 200}, found


@pytest.mark.parametrize("joint", ["_", "-", ".", "\u00a0", "\u3000"])
def test_one_rule_for_words_of_all_lengths(spark, model, joint):
    """An insult joined to neighbours counts alike in words of 10 to 400 bytes."""
    bad = ["scumface", "wretchbag", "dunghead", "scumfaces", "Dungheads", "wretchbagg"]
    rows = [(100 * i + n, joint.join(["x"] * n + [w] + ["x"] * n)) for i, w in enumerate(bad) for n in (1, 2, 5, 12, 14, 15, 20, 40, 90)]
    docs = spark.createDataFrame([(*r, "en", "mine", 0) for r in rows], SCHEMA)
    scores = [(r.doc_id, r.score) for r in toxicity.score_documents(docs, model).collect()]
    for i in range(len(bad)):
        some = [s for d, s in scores if d // 100 == i]
        assert max(some) - min(some) < 1e-9 and min(some) >= 0.7, (bad[i], some)


def test_no_byte_of_a_long_part_is_left_out():
    rng = np.random.default_rng(2)
    for n in (1, 11, 12, 13, 14, 25, 26, 27, 28, 39, 40, 65, 500):
        part = bytes(rng.integers(97, 123, n).astype(np.uint8))
        marked, slots = b"<" + part + b">", toxicity.slots_of([part])
        for size in toxicity.RUNS if len(marked) > toxicity.RUN else (len(marked),):
            runs = {s[i : i + size] for s in slots for i in range(len(s) - size + 1)}
            assert runs == {marked[i : i + size] for i in range(len(marked) - size + 1)}
        assert max(map(len, slots)) < 2 * toxicity.RUN
    assert toxicity.slots_of([b"left"] * 20) == [b"<left>"] * 20 and toxicity.slots_of([b"!!", b"*left!"]) == [b"<left>"]


def test_pieces_of_a_huge_part_are_those_of_the_whole(monkeypatch):
    part = bytes(np.random.default_rng(5).integers(97, 123, 3000).astype(np.uint8))
    whole = [s for some in toxicity._word_lists(part) for s in some]
    monkeypatch.setattr(toxicity, "MOST", 140)
    lists = list(toxicity._word_lists(part))
    assert len(lists) > 10 and [s for n, some in enumerate(lists) for s in some[2 * (n > 0) :]] == whole
