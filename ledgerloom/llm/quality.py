"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are classes of three neighbouring bytes (lower case, upper case,
digits, kinds of punctuation and so on), hashed words, and how much its words
repeat. Term weights go through a truncated singular value decomposition to
latent-semantic vectors. The labelled vectors, a bounded number, are on every
executor; every document's exact cosines with all of them come from blocked
matrix products, and its nearest neighbours vote, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.arrow import text_bytes, with_score
from ledgerloom.session import written

#: Bound of the labelled sample, per label.
LABELLED = 2000
LATENT, NEIGHBOURS = 48, 15
#: Bytes of a text that are looked at together; words of a window for repeats.
PIECE, RUN_WORDS = 1 << 20, 1 << 16

_GROUPS = [b"\t\n\r\x0b\x0c", b" ", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!?", b"#$%&*@", b"|", b"\"'()[]{}", b"-_/\\", b":;"]
_CLASS = np.full(256, 13, np.uint16)
for _n, _group in enumerate(_GROUPS):
    _CLASS[list(_group)] = _n
_CLASS[0x80:0xC0] = 15
_CLASS[0xC0:] = 14
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True

_TRIGRAMS, _WORDS, _BINS = 16**3, 1024, 16
TERMS = _TRIGRAMS + _WORDS + 2 * _BINS
_FACTOR = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


def word_hashes(data: np.ndarray, powers: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of a byte array, words parted by ASCII white space."""
    space = _SPACE[data]
    edges = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)])])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _bin(share: float) -> int:
    return min(_BINS - 1, int(share * _BINS))


class Terms:
    """Term counts of whole texts; the tables of powers are made once.

    How much words repeat is the share of words that equal the one before, over
    the text, and the least share of distinct words in any of its windows: runs
    of RUN_WORDS words one after another, and the last as many; a shorter text
    is one window. Texts are read in pieces of PIECE bytes for memory's sake;
    what a piece ends with is carried on, so pieces leave no trace.
    """

    def __init__(self):
        self.powers, self.inverse = _powers(_FACTOR, PIECE), _powers(_INVERSE, PIECE)

    def __call__(self, text: bytes) -> np.ndarray:
        counts = np.zeros(TERMS, np.float32)
        grams, words, same, fewest, at = np.zeros(_TRIGRAMS, np.int64), 0, 0, 1.0, 0
        held, window = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        while at < len(text):
            end = min(len(text), at + PIECE)
            cut = end
            if end < len(text):  # not within a word, if it isn't a very long one
                while cut > at and text[cut - 1] not in b" \t\n\r\x0b\x0c":
                    cut -= 1
                cut = cut if cut > at else end
            classes = _CLASS[np.frombuffer(text[max(0, at - 2) : cut], np.uint8)]
            if len(classes) >= 3:
                grams += np.bincount(classes[:-2] << 8 | classes[1:-1] << 4 | classes[2:], minlength=_TRIGRAMS)
            h = word_hashes(np.frombuffer(text[at:cut], np.uint8), self.powers, self.inverse)
            counts[_TRIGRAMS : _TRIGRAMS + _WORDS] += np.bincount((h >> np.uint64(54)).astype(np.int64), minlength=_WORDS)
            words += len(h)
            last, held = (held if len(held) else window)[-1:], np.concatenate([held, h])
            known = np.concatenate([last, h])
            same += int((known[1:] == known[:-1]).sum())
            while len(held) > RUN_WORDS:
                window, held = held[:RUN_WORDS], held[RUN_WORDS:]
                fewest = min(fewest, len(np.unique(window)) / RUN_WORDS)
            at = cut
        counts[:_TRIGRAMS] = grams
        if words:
            tail = np.concatenate([window, held])[-RUN_WORDS:]
            fewest = min(fewest, len(np.unique(tail)) / len(tail))
            counts[_TRIGRAMS + _WORDS + _bin(same / words)] = 20
            counts[_TRIGRAMS + _WORDS + _BINS + _bin(fewest)] = 20
        return counts


class Model:
    """Term weights, the latent space, and the labelled vectors with their labels.

    Training holds one matrix of the sample by TERMS: its counts, which are
    overwritten by their weights unless ``counts`` is to be kept.
    """

    def __init__(self, counts: np.ndarray, labels: np.ndarray, seed: int = 42, keep: bool = True):
        rows = counts.copy() if keep else counts
        known = np.count_nonzero(rows, axis=0)
        self.idf = np.log((1 + len(counts)) / (1 + known)).astype(np.float32) + np.float32(0.05)
        for at in range(0, len(rows), 256):
            rows[at : at + 256] = self.weigh(rows[at : at + 256])
        rng = np.random.default_rng(seed)
        latent = min(LATENT, *rows.shape)
        # Randomised subspace iteration: a few passes over the sample.
        basis = rng.normal(size=(rows.shape[1], min(latent + 16, *rows.shape))).astype(np.float32)
        for _ in range(4):
            basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
        turn = np.linalg.svd(rows @ basis, full_matrices=False)[2]
        self.space = (basis @ turn.T)[:, :latent].astype(np.float32)
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean())
        self.vectors = self.project(rows)

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        rows = np.log1p(counts) * self.idf
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return self.project(self.weigh(counts))

    def project(self, weighed: np.ndarray) -> np.ndarray:
        rows = weighed @ self.space
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    def vote(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by cosine.

        Of equally near ones the earlier in the sample's order counts. Products are
        summed in double precision and rounded, so that equal texts score alike
        whatever batch they are in.
        """
        similar = np.round(self.latent(counts).astype(np.float64) @ self.vectors.T.astype(np.float64), 6)
        k = min(NEIGHBOURS, similar.shape[1])
        least = np.partition(similar, -k, axis=1)[:, -k, None]
        above, equal = similar > least, similar == least
        near = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        weight = np.where(near, np.maximum(similar, 0), 0)
        total = weight.sum(axis=1)
        share = (weight * self.labels).sum(axis=1) / np.maximum(total, 1e-12)
        return np.clip(np.where(total > 0, share, self.prior), 0, 1)


def train(sample: DataFrame) -> Model | None:
    """Model from a bounded sample ``doc_id, text, label``; None unless both labels occur.

    Terms of whole texts are counted in Spark tasks and written; the driver gets
    a sparse row of at most TERMS counts for each of the sample's documents.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            rows = [terms(t) for t in text_bytes(batch.column(1))]
            some = [np.flatnonzero(r).astype("<u4") for r in rows]
            packed = [pa.array([r.tobytes() for r in some], pa.binary()), pa.array([r[s].astype("<f4").tobytes() for r, s in zip(rows, some, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *packed, batch.column(2)], names=["doc_id", "terms", "counts", "label"])

    usable = sample.where("text is not null").select("doc_id", "text", "label")
    rows = written(usable.mapInArrow(count, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, terms binary, counts binary, label int"), "terms").collect()
    found = sorted((r.doc_id, bytes(r.terms), bytes(r.counts), r.label) for r in rows)
    labels = np.array([n for *_, n in found])
    if len(set(labels.tolist())) < 2:
        return None
    del rows
    counts = np.zeros((len(found), TERMS), np.float32)
    for row, (_, terms, values, _) in zip(counts, found, strict=True):
        row[np.frombuffer(terms, "<u4")] = np.frombuffer(values, "<f4")
    del found
    return Model(counts, labels, keep=False)


def score_documents(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns ``keep`` and the score of every document, whole texts.

    The score is the vote for label 1. Null and empty texts have no terms and
    score the share of label 1 in the sample; without a model every text scores
    1. Texts are counted some MB at a time, however long. Repeated rows and null
    ids come back as often as they came, an empty table gives an empty result.
    Columns that aren't kept are ignored; ``name`` must not be one of ``keep``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        terms, model = Terms(), shared.value
        return lambda texts: np.ones(len(texts)) if model is None else model.vote(np.stack([terms(t) for t in texts]))

    return with_score(docs, make, list(keep), name)
