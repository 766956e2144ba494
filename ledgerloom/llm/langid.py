"""Language identification by multilingual mixture inference.

A text is taken as drawn from a mixture of languages. Expectation-maximisation
estimates its proportions from the likelihoods of its byte n-grams; a language
stays in the text's set only if it raises the likelihood by more than a
penalty. The n-grams' likelihoods are learned by Spark from labelled documents.

For the inference, n-grams with about the same likelihood ratios between the
languages are put in one class, so a text is a short histogram and whole
batches of texts go through the iterations as matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.arrow import text_bytes
from ledgerloom.session import written

#: Training documents of all languages together, in equal shares; each counts whole.
SAMPLE = 20_000
#: Least share of a language; a hash that leaves rows out can't miss so many.
LEAST = 100
#: Buckets of hashed n-grams, and classes of buckets with like ratios.
BUCKETS, CLASSES = 1 << 18, 512
#: Bytes of an n-gram, and tasks that count those of the sample.
GRAM, TASKS = 4, 8


def grams(text: bytes, piece: int = 1 << 20) -> Iterator[np.ndarray]:
    """Hash buckets of a text's byte n-grams, A-Z lower-cased, with a space at both ends.

    A long text comes in pieces, each of which starts where the last n-gram
    that is still due does.
    """
    padded = b" " + text.lower() + b"  "
    for at in range(0, len(padded) - GRAM + 1, piece):
        codes = np.frombuffer(padded[at : at + piece + GRAM - 1], np.uint8).astype(np.uint32)
        n = len(codes) - GRAM + 1
        code = codes[:n].copy()
        for k in range(1, GRAM):
            code = code * np.uint32(257) + codes[k : n + k]
        yield (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


class Model:
    """Languages, the class of each bucket, and each class's likelihood per language."""

    def __init__(self, counts: dict[str, np.ndarray], seed: int = 42):
        self.languages = sorted(counts)
        table = np.stack([counts[x] for x in self.languages]).astype(np.float64)
        total = table.sum(axis=0)
        share = table.sum(axis=1, keepdims=True)
        likelihood = (table + 0.5 * total / max(total.sum(), 1) + 1e-4) / (share + 0.5 + 1e-4 * BUCKETS)
        ratios = np.log(likelihood) - np.log(likelihood).mean(axis=0)
        self.classes = self._classes(ratios, total, seed)
        n = int(self.classes.max()) + 1
        weight = np.maximum(total, 1e-3)
        within = np.bincount(self.classes, weight, n)
        mean = np.stack([np.bincount(self.classes, weight * r, n) / np.maximum(within, 1e-12) for r in ratios])
        self.likelihood = np.exp(mean - mean.max(axis=0, keepdims=True, initial=-np.inf))

    @staticmethod
    def _classes(ratios: np.ndarray, total: np.ndarray, seed: int) -> np.ndarray:
        """k-means of the buckets' log ratios; buckets never seen share a class with the even ones."""
        seen = np.flatnonzero(total > 0)
        if not len(seen):
            return np.zeros(ratios.shape[1], np.uint16)
        points = ratios[:, seen].T
        rng = np.random.default_rng(seed)
        drawn = points[rng.choice(len(points), min(len(points), 16384), replace=False)]
        centres = np.unique(drawn, axis=0)
        centres = np.concatenate([np.zeros((1, points.shape[1])), centres[rng.permutation(len(centres))[: CLASSES - 1]]])
        near = lambda x: np.concatenate([np.argmin((centres**2).sum(axis=1) - 2 * x[a : a + 8192] @ centres.T, axis=1) for a in range(0, len(x), 8192)])
        for _ in range(8):
            of = near(drawn)
            for d in range(points.shape[1]):
                n = np.bincount(of, minlength=len(centres))
                centres[:, d] = np.where(n > 0, np.bincount(of, drawn[:, d], len(centres)) / np.maximum(n, 1), centres[:, d])
            centres[0] = 0
        classes = np.zeros(ratios.shape[1], np.uint16)
        classes[seen] = near(points)
        return classes

    def histograms(self, texts: list[bytes]) -> np.ndarray:
        width = self.likelihood.shape[1]
        return np.stack([sum(np.bincount(self.classes[g], minlength=width) for g in grams(t)) for t in texts]).astype(np.float64)


def proportions(counts: np.ndarray, likelihood: np.ndarray, allowed: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """EM for a batch: ``counts`` texts x classes, ``allowed`` texts x languages.

    Returns the proportions and the log-likelihoods of the texts.
    """
    share = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    for _ in range(rounds):
        share = share * ((counts / np.maximum(share @ likelihood, 1e-300)) @ likelihood.T) / total
    return share, (counts * np.log(np.maximum(share @ likelihood, 1e-300))).sum(axis=1)


def infer(counts: np.ndarray, likelihood: np.ndarray, penalty: float = 2.0) -> np.ndarray:
    """Proportions over a language set chosen by penalised likelihood, greedily.

    Starts from all languages and drops the one with the least proportion while
    the likelihood falls by less than ``penalty * log(grams)`` for it. That is
    the set of the highest penalised likelihood wherever the languages that
    don't belong have the least proportions, not for every conceivable text.
    """
    n, languages = len(counts), len(likelihood)
    allowed = np.ones((n, languages))
    share, best = proportions(counts, likelihood, allowed)
    cost = penalty * np.log(np.maximum(counts.sum(axis=1), 2))
    open_ = np.arange(n)
    for _ in range(languages - 1):
        fewer = allowed[open_].copy()
        least = np.where(fewer > 0, share[open_], np.inf).argmin(axis=1)
        fewer[np.arange(len(open_)), least] = 0
        tried, value = proportions(counts[open_], likelihood, fewer)
        better = value + cost[open_] >= best[open_]
        open_, fewer, tried, value = open_[better], fewer[better], tried[better], value[better]
        allowed[open_], share[open_], best[open_] = fewer, tried, value
        if not len(open_):
            break
    return share


def train(docs: DataFrame, label: Column, sample: int = SAMPLE) -> Model | None:
    """Learns n-gram likelihoods from rows whose ``label`` isn't null; None without any.

    Each label has an equal share of ``sample``, LEAST at least, so none is lost however rare it
    is. Of a label with up to twice its share all rows are in; of others a hash
    of ``doc_id`` leaves out the rows beyond about the share, and rows without
    an id go by a hash of their text. The sample is written in parallel; its
    texts are counted whole, in TASKS tasks at most, which send a histogram of
    BUCKETS counts at most for each language.
    """
    labelled = docs.select("doc_id", "text", label.alias("label")).where("label is not null and text is not null")
    rows = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    if not rows:
        return None
    share = max(LEAST, sample / len(rows))
    # A map rather than a join, which would deal whole texts by language.
    below = F.create_map(*[F.lit(x) for name, n in sorted(rows.items()) for x in (name, 1 << 30 if n <= 2 * share else int(share / n * (1 << 30)))])
    mark = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(1 << 30))
    chosen = labelled.where(mark < below[F.col("label")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                if name not in held:
                    held[name] = np.zeros(BUCKETS, np.uint32)
                for found in grams(text):
                    held[name] += np.bincount(found, minlength=BUCKETS).astype(np.uint32)
        for name, table in held.items():
            some = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([some.astype("<u4").tobytes()]), pa.array([table[some].astype("<u4").tobytes()])], names=["label", "bucket", "n"])

    counts: dict[str, np.ndarray] = {}
    # Few tasks on the written sample, so that the histograms are few.
    held = written(chosen.select("label", "text"), "language_sample").coalesce(TASKS)
    for r in held.mapInArrow(count, "label string, bucket binary, n binary").collect():
        table = counts.setdefault(r.label, np.zeros(BUCKETS, np.int64))
        table[np.frombuffer(r.bucket, "<u4")] += np.frombuffer(r.n, "<u4")
    return Model(counts) if counts else None


def predict(docs: DataFrame, model: Model | None, batch_rows: int = 256) -> DataFrame:
    """``doc_id, lang_pred, score, languages`` of every document, whole texts.

    ``lang_pred`` has the largest proportion (ties: the smaller name), ``score``
    is that proportion, ``languages`` all proportions of the chosen set. Texts
    that are null or have no letter are ``und`` with score 0, and so is every
    text without a model. Repeated rows and null ids come back as often as they
    came, an empty table gives an empty result. Further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]
    letter = regex.compile(r"\p{L}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                texts = part.column(1).to_pylist()
                known = [bool(model) and t is not None and letter.search(t) is not None for t in texts]
                names, scores, sets = ["und"] * len(texts), [0.0] * len(texts), [{}] * len(texts)
                some = [n for n, k in enumerate(known) if k]
                if some:
                    share = infer(model.histograms([texts[n].encode() for n in some]), model.likelihood)
                    for n, row in zip(some, share, strict=True):
                        first = int(row.argmax())
                        names[n], scores[n] = model.languages[first], min(1.0, float(row[first]))
                        sets[n] = {model.languages[k]: float(row[k]) for k in np.flatnonzero(row > 0)}
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array([list(s.items()) for s in sets], pa.map_(pa.string(), pa.float64()))],
                    names=["doc_id", "lang_pred", "score", "languages"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, languages map<string,double>")
