"""Toxicity by subword bags: averaged embeddings under a linear softmax.

A word's vector is the mean of the embeddings of its character n-grams and of
itself, a window's vector the mean of its words', and a linear softmax on that
gives its class; embeddings and softmax are trained jointly. Misspellings that
training never saw share most of their n-grams with words that it saw. A
document is as toxic as its worst window, however long it is.

Labels are of documents, not windows, so training alternates: in Spark tasks
each toxic document gives its worst window so far, each other one its worst
windows and one drawn by its id; on these, a bounded number of short windows,
the driver goes on with the joint training.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.arrow import text_bytes, with_score, word_chunks, worker_state
from ledgerloom.session import written

#: Bounds of the training sample: toxic and other documents, whole texts.
TOXIC, OTHER = 1500, 2500
#: Tasks that read the sample: as many counts of buckets go to the driver.
TASKS = 12
BUCKETS, DIM, WINDOW = 1 << 16, 4, 3
#: Slots whose score a worker keeps, and bytes of text whose slots are held at once.
CACHE, MOST = 300_000, 1 << 21
#: What sets off the parts of a word: ASCII punctuation that does not stand in
#: for letters, and punctuation and spaces beyond ASCII.
_JOINTS = b"\"&'()+,-./:;<=>[\\]^_`{|}~"
_SPACED = bytes(32 if c in _JOINTS else c for c in range(256))
_WIDE = re.compile(rb"\xc2[\x80-\xbf]|\xe1\x9a\x80|\xe2\x80[\x80-\xbf]|\xe2\x81\x9f|\xe3\x80[\x80-\x9f]|\xef\xbb\xbf|\xef\xbc[\x81-\x8f\x9a-\xa0]")
#: What may stand in for letters counts within a part, not at its ends.
_ENDS = b"!?*#$%"
#: Bytes of a part, with its ends marked, that are read at once, and the lengths
#: of the runs within longer ones.
RUN = 14
RUNS = (8, 11, 14)


def slots_of(parts: list[bytes]) -> list[bytes]:
    """What a window counts as words: parts with their ends marked, long ones as stretches.

    A stretch has the bytes of all runs that start within RUN bytes. So a slot
    is at most 2 * RUN - 1 bytes long, and every run of a part is in one. Parts
    of nothing but _ENDS give none.
    """
    slots = []
    for part in parts:
        part = part.strip(_ENDS)
        marked = b"<" + part + b">"
        if not part:
            continue
        if len(marked) <= RUN:
            slots.append(marked)
        else:
            slots += [marked[at : at + 2 * RUN - 1] for at in range(0, len(marked) - RUN + 1, RUN)]
    return slots


def word_grams(unit: bytes) -> list[int]:
    """Buckets of a unit's byte n-grams of 3 to 5, and of itself if it is a whole part."""
    crc, n = zlib.crc32, len(unit)
    grams = [crc(unit[i : i + k]) for k in (3, 4, 5) for i in range(n - k + 1)]
    if unit[:1] == b"<" and unit[-1:] == b">":
        grams.append(crc(unit, 7))
    return [g & (BUCKETS - 1) for g in grams]


def best_run(slot: bytes, table: list[float]) -> tuple[float, bytes]:
    """The highest mean score of a slot's units, and that unit: itself, or its runs if it is a stretch."""
    if len(slot) <= RUN:
        grams = word_grams(slot)
        return sum(map(table.__getitem__, grams)) / len(grams), slot
    crc, n = zlib.crc32, len(slot)
    upto = {k: list(accumulate((table[crc(slot[i : i + k]) & (BUCKETS - 1)] for i in range(n - k + 1)), initial=0.0)) for k in (3, 4, 5)}
    found = (
        (sum(upto[k][at + size - k + 1] - upto[k][at] for k in (3, 4, 5)) / (3 * size - 9), -at, size)
        for size in RUNS for at in range(n - size + 1)
    )
    score, at, size = max(found)
    return score, slot[-at : size - at]


class _Vocabulary:
    """Ids of words, and the buckets of all words in one array."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.grams, self.lengths = array("H"), array("L")

    def of(self, words: list[bytes]) -> np.ndarray:
        for w in words:
            if w not in self.ids:
                self.ids[w] = len(self.ids)
                grams = word_grams(w)
                self.grams.extend(grams)
                self.lengths.append(len(grams))
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array(self.lengths, np.int64)
        return np.array(self.grams, np.uint16), np.concatenate([[0], np.cumsum(lengths)])


def _bags(windows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, their window and their weight: 1 / (words of the window * grams of the word)."""
    vocabulary = _Vocabulary()
    words = vocabulary.of([w for window in windows for w in window])
    per = np.fromiter(map(len, windows), np.int64, len(windows))
    of = np.repeat(np.arange(len(windows)), per)
    flat, ends = vocabulary.flat()
    lengths = ends[words + 1] - ends[words]
    at = np.repeat(ends[words] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    return flat[at], np.repeat(of, lengths), np.repeat(1.0 / (per[of] * lengths), lengths)


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """A text's slots in lists of bounded length; each goes on with the last slots of the one before."""
    text = text.lower()
    text = (text if text.isascii() else _WIDE.sub(b" ", text)).translate(_SPACED)
    carry: list[bytes] = []
    whole = True
    for parts in word_chunks(text):
        # A part may be as long as the text: its stretches come some at a time.
        for some in (parts,) if sum(map(len, parts)) <= MOST else ([p] for p in parts):
            for slots in _bounded(some):
                held = carry + slots
                if slots and len(held) >= WINDOW:
                    yield held
                    held, whole = held[-(WINDOW - 1) :], False
                carry = held
    if whole and carry:
        yield carry


def _bounded(parts: list[bytes]) -> Iterator[list[bytes]]:
    """Slots of parts; of one beyond MOST bytes, given by itself, in several lists."""
    core = parts[0].strip(_ENDS) if len(parts) == 1 else b""
    if len(core) <= MOST:
        yield slots_of(parts)
        return
    marked = b"<" + core + b">"
    starts = range(0, len(marked) - RUN + 1, RUN)
    for n in range(0, len(starts), MOST // RUN):
        yield [marked[at : at + 2 * RUN - 1] for at in starts[n : n + MOST // RUN]]


def window_means(scores: np.ndarray) -> np.ndarray:
    """Mean score of each run of WINDOW words; of all words, if they are fewer."""
    if len(scores) <= WINDOW:
        return scores.mean(keepdims=True)
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    return (sums[WINDOW:] - sums[:-WINDOW]) / WINDOW


class Model:
    """What inference needs: a score per bucket, and how a window's mean becomes a probability."""

    def __init__(self, buckets: np.ndarray, scale: float, offset: float):
        self.buckets, self.scale, self.offset = buckets.astype(np.float32), scale, offset
        self.key = hash(self.buckets.tobytes())

    def probability(self, worst: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * worst + self.offset, -40, 40))))


class _Scores(dict):
    """Scores of slots under a table of buckets."""

    def __init__(self, buckets: np.ndarray):
        super().__init__()
        self.table = buckets.tolist()

    def __missing__(self, slot: bytes) -> float:
        score = best_run(slot, self.table)[0]
        if len(self) >= CACHE:
            self.clear()
        self[slot] = score
        return score

    def of(self, slots: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, slots), np.float64, len(slots))

    def units(self, slots: list[bytes]) -> list[bytes]:
        """What gives each slot its score."""
        return [best_run(slot, self.table)[1] for slot in slots]


def seen_buckets(texts: list[bytes]) -> np.ndarray:
    """How many of some texts have each bucket."""
    seen = np.zeros(BUCKETS, np.int64)
    for text in texts:
        found = np.zeros(BUCKETS, bool)
        for words in _word_lists(text):
            for slot in set(words):
                found[word_grams(slot)] = True
        seen += found
    return seen


def worst_windows(text: bytes, scores: _Scores, most: int) -> tuple[float | None, list[list[bytes]]]:
    """The highest mean of a text's windows, and the ``most`` windows with the highest, in falling order."""
    best: list[tuple[float, int, list[bytes]]] = []
    base = 0
    for words in _word_lists(text):
        means = window_means(scores.of(words))
        for n in np.argsort(-means, kind="stable")[:most].tolist():
            best.append((-float(means[n]), base + n, words[n : n + WINDOW]))
        best = sorted(best)[:most]
        base += max(1, len(words) - WINDOW + 1)
    return (-best[0][0] if best else None), [w for *_, w in best]


def any_window(text: bytes, seed: int) -> list[bytes]:
    """A window of a text, by a hash of its place and the seed."""
    chosen, least, base = [], None, 0
    for words in _word_lists(text):
        n = max(1, len(words) - WINDOW + 1)
        marks = ((np.arange(base, base + n, dtype=np.uint64) + np.uint64(seed % (1 << 32))) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(seed % (1 << 63))
        k = int(marks.argmin())
        if least is None or marks[k] < least:
            least, chosen = marks[k], words[k : k + WINDOW]
        base += n
    return chosen


class Trainer:
    """The joint training of embeddings and softmax on the driver, in numpy."""

    def __init__(self, rate: float = 0.1, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.rate, self.step = rate, 0
        self.embedding = rng.normal(0, 0.1, (BUCKETS, DIM))
        self.softmax = rng.normal(0, 0.1, (DIM, 2))
        self.bias = np.zeros(2)
        self.moments = [[np.zeros_like(p), 0.0] for p in (self.embedding, self.softmax, self.bias)]

    def scores(self) -> np.ndarray:
        """A score per bucket: its embedding along the direction of toxic."""
        return self.embedding @ (self.softmax[:, 1] - self.softmax[:, 0])

    def gradients(self, grams: np.ndarray, of: np.ndarray, weight: np.ndarray, target: np.ndarray) -> tuple:
        """Gradients of the cross-entropy, both classes weighing the same: of the used embeddings, the softmax, the bias."""
        used, at = np.unique(grams, return_inverse=True)
        part = self.embedding[used]
        vectors = np.stack([np.bincount(of, weight * part[at, k], len(target)) for k in range(DIM)], axis=1)
        logits = vectors @ self.softmax + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(target)), target] -= 1
        p *= np.where(target == 1, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum()))[:, None]
        back = p @ self.softmax.T
        gradient = np.stack([np.bincount(at, weight * back[of, k], len(used)) for k in range(DIM)], axis=1)
        return (used, gradient), (slice(None), vectors.T @ p), (slice(None), p.sum(axis=0))

    def fit(self, windows: list[list[bytes]], target: np.ndarray, steps: int = 50) -> None:
        """Some steps on windows of words with labels 0 and 1.

        One step size for a whole matrix: what many windows share moves far,
        what a single window has moves little.
        """
        bags = _bags(windows)
        for _ in range(steps):
            self.step += 1
            for values, (where, g), moment in zip((self.embedding, self.softmax, self.bias), self.gradients(*bags, target), self.moments, strict=True):
                moment[0][where] = 0.9 * moment[0][where] + 0.1 * g
                moment[1] = 0.99 * moment[1] + 0.01 * float((g * g).max())
                values[where] -= self.rate * moment[0][where] / (1 - 0.9**self.step) / (np.sqrt(moment[1] / (1 - 0.99**self.step)) + 1e-12)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> tuple[float, float]:
    """Scale and offset of a logistic fit on a standardised score, classes weighing the same."""
    mean, spread = x.mean(), x.std() + 1e-9
    z, a, b = (x - mean) / spread, 1.0, 0.0
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(a * z + b, -40, 40))) - y) * weight
        a -= 2 * ((error * z).sum() + 1e-3 * a)
        b -= 2 * error.sum()
    return float(a / spread), float(b - a * mean / spread)


def train(sample: DataFrame, rounds: int = 4) -> Model | None:
    """Model from a bounded sample ``doc_id, text, label``; None unless both labels have a word.

    Texts count whole, however long, and stay in Spark: a task sends how many of
    its documents have each bucket, or of each document at most three windows
    of WINDOW words (units of RUN bytes at most) and its highest mean.
    """
    held = written(sample.where("text is not null").select("doc_id", "text", "label"), "toxic_sample").coalesce(TASKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            labels = np.array(batch.column(2).to_pylist())
            texts = [(t, n) for t, n in zip(text_bytes(batch.column(1)), labels, strict=True) if t.split(None, 1)]
            for label in (0, 1):
                some = [t for t, n in texts if n == label]
                seen[label] += seen_buckets(some)
                docs[label] += len(some)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(docs), pa.array([x.astype("<u4").tobytes() for x in seen], pa.binary())], names=["label", "docs", "seen"])

    seen, docs = np.zeros((2, BUCKETS)), np.zeros(2, np.int64)
    for r in held.mapInArrow(count, "label int, docs long, seen binary").collect():
        seen[r.label] += np.frombuffer(r.seen, "<u4")
        docs[r.label] += r.docs
    if not docs.all():
        return None

    def windows(scores: np.ndarray, seed: int) -> list:
        """Each document's label, highest mean and windows, in an order of its own."""
        shared = held.sparkSession.sparkContext.broadcast(scores)
        kind = held.schema["doc_id"].dataType.simpleString()

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _Scores(shared.value)
            for batch in batches:
                rows = []
                for doc_id, text, label in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                    worst, found = worst_windows(text, known, 1 if label else 2)
                    if found:
                        some = found if label else [*found, any_window(text, zlib.crc32(f"{doc_id} {seed}".encode()))]
                        rows.append((doc_id, label, worst, [known.units(w) for w in some]))
                ids, labels, means, found = zip(*rows, strict=True) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.column(0).type), pa.array(labels, pa.int32()), pa.array(means, pa.float64()), pa.array(found, pa.list_(pa.list_(pa.binary())))], names=["doc_id", "label", "worst", "windows"]
                )

        found = held.mapInArrow(find, f"doc_id {kind}, label int, worst double, windows array<array<binary>>").collect()
        return sorted((r.doc_id, r.label, r.worst, [[bytes(w) for w in x] for x in r.windows]) for r in found)

    # The first windows come from how much more often than by chance toxic
    # documents have a bucket, in standard deviations.
    pooled = (seen.sum(axis=0) + 1) / (docs.sum() + 2)
    scores = (seen[1] - docs[1] * pooled) / np.sqrt(docs[1] * pooled * (1 - pooled))
    trainer = Trainer()
    for n in range(rounds):
        found = windows(scores, n)
        target = np.array([label for _, label, _, some in found for _ in some])
        trainer.fit([w for *_, some in found for w in some], target)
        scores = trainer.scores().astype(np.float32)
    found = windows(scores, rounds)
    scale, offset = _logistic(np.array([worst for _, _, worst, _ in found]), np.array([label for _, label, *_ in found]))
    return Model(scores, scale, offset)


def score_documents(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns ``keep`` and the score of every document, whole texts.

    The score is the probability of toxic for the worst window of WINDOW words
    (all words of a shorter text), however long the text is. Words are what white
    space and joints set off; of one of more than RUN bytes each stretch of RUN
    bytes counts as a word, by the run in it that scores highest. Null and empty texts, texts of white space,
    and all texts without a model, score 0. Repeated rows and null ids come back
    as often as they came, an empty table gives an empty result. Columns that
    aren't kept are ignored; ``name`` must not be one of ``keep``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        known = worker_state("toxicity", model.key, lambda: _Scores(model.buckets)) if model else None

        def probability(text: bytes) -> float:
            worst = max((float(window_means(known.of(words)).max()) for words in _word_lists(text)), default=None)
            return 0.0 if worst is None else model.probability(worst)

        return lambda texts: [probability(t) if model else 0.0 for t in texts]

    return with_score(docs, make, list(keep), name)
