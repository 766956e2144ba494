"""Byte-level BPE encoding and decoding, long texts in overlapping chunks.

A long text is cut into chunks that overlap. All chunks are pre-tokenised in
parallel, each from its own start, so at first a chunk's boundaries may differ
from the text's. Where a boundary of a chunk is also one of the chunk before,
the two have resynchronised, as the rest of the split depends on nothing
earlier: there the chunks are stitched. The pieces between stitches are encoded
and their ids concatenated. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.arrow import worker_state
from ledgerloom.llm.units import UnitEncoder, id_column, text_slices
from ledgerloom.session import written

#: Characters of a chunk, and how far it reads on into the next one.
CHUNK, OVERLAP = 32768, 1024
#: Rows that a worker decodes, and characters that it cuts, at a time.
ROWS, CUT = 512, 4 << 20


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file's lines: a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class _WholeEncoder:
    """Ids of texts that are encoded whole, for patterns of any kind."""

    def __init__(self, encode):
        self.one = encode

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [self.one(t or "") for t in texts.to_pylist()]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts


def _encoder(data: bytes, pattern: str, by_units: bool) -> UnitEncoder | _WholeEncoder:
    def make():
        core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(data), special_tokens={})
        return UnitEncoder(lambda units: list(map(core.encode_ordinary, units))) if by_units else _WholeEncoder(core.encode_ordinary)

    return worker_state("bpe", (data, pattern, by_units), make)


def boundaries(text: str, pattern: regex.Pattern, final: bool) -> np.ndarray:
    """Where pre-tokens of a chunk begin or end; the last end only if it is final."""
    ends = [m.end() for m in pattern.finditer(text)]
    return np.array([0, *(ends if final else ends[:-1])], np.int64)


def _chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``row, doc_id, n, last, text``: the chunks of every document, dealt evenly.

    A text is cut in one pass, some chunks at a time, so the work is in
    proportion to its length.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CUT // (chunk + overlap))
        for batch in batches:
            for at, text in enumerate(batch.column(2)):
                text, (row, doc_id) = text.as_py(), (batch.column(k).slice(at, 1) for k in (0, 1))
                last = (len(text) - 1) // chunk
                for first in range(0, last + 1, step):
                    numbers = range(first, min(first + step, last + 1))
                    same = pa.array([0] * len(numbers))
                    yield pa.RecordBatch.from_arrays(
                        [row.take(same), doc_id.take(same), pa.array(numbers, pa.int32()), pa.array([last] * len(numbers), pa.int32()), pa.array([text[n * chunk : n * chunk + chunk + overlap] for n in numbers], pa.string())],
                        names=["row", "doc_id", "n", "last", "text"],
                    )

    kind = dict(docs.dtypes)["doc_id"]
    named = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return written(named.mapInArrow(cut, f"row long, doc_id {kind}, n int, last int, text string").repartition("row", "n"), "chunks")


def _pieces(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``row, doc_id, n, text, stitched``: chunks cut down to what lies between stitches.

    If any two chunks of a document have no common boundary where they overlap
    (a pre-token that is longer than the overlap), the document's chunks come
    back without their overlap and not stitched, to be encoded as one.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for n, last, text in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                found = boundaries(text, compiled, n == last)
                heads.append(found[found < overlap].tolist())
                tails.append((found[(found >= chunk) & (found < chunk + overlap)] - chunk).tolist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], names=["row", "n", "last", "head", "tail"]
            )

    scanned = chunks.select("row", "n", "last", "text").mapInArrow(scan, "row long, n int, last int, head array<int>, tail array<int>")
    order, whole = Window.partitionBy("row").orderBy("n"), Window.partitionBy("row")
    start = F.when(F.col("n") == 0, 0).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    cuts = (
        scanned.withColumn("start", start)
        .withColumn("stop", F.lead("start").over(order))
        .withColumn("stitched", F.min(F.col("start").isNotNull()).over(whole))
        .select("row", "n", "start", "stop", "stitched")
    )
    begin = F.when(F.col("stitched"), F.col("start")).otherwise(0)
    end = F.when(F.col("n") == F.col("last"), F.length("text")).otherwise(F.lit(chunk) + F.when(F.col("stitched"), F.col("stop")).otherwise(0))
    return chunks.join(cuts, ["row", "n"]).select("row", "doc_id", "n", F.col("text").substr(begin + 1, end - begin).alias("text"), "stitched")


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, by_units: bool = False) -> DataFrame:
    """``doc_id, ids, n_tokens`` of every document, whole texts, no special tokens.

    ``ids`` holds the token ids as little-endian unsigned 32-bit integers.
    ``ranks`` is the content of a rank file, ``pattern`` splits a text into
    pre-tokens, each of which is encoded by itself. ``by_units`` states that no
    match of the pattern goes on from another character to white space, and that
    there is a boundary between any letter and punctuation, as in the public
    byte-level patterns: then ids of words are cached, which is several times
    faster. Other patterns need it to be false: a match may then depend on text
    at any distance after it, so texts are encoded whole, in one go each.

    A text of up to ``chunk`` characters is one chunk and needs no stitching.
    Null and empty texts have no ids. Repeated rows and null ids come back as
    often as they came. Further columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    data = spark.sparkContext.broadcast(ranks)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(data.value, pattern, by_units)
        for batch in batches:
            for part in text_slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), id_column(*encoder.encode(part.column(1)))], names=["doc_id", "ids"])

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(data.value, pattern, by_units)
        for batch in batches:
            for part in text_slices(batch, 3):
                texts, stitched = part.column(3).to_pylist(), part.column(4).to_pylist()
                ids = id_column(*encoder.encode(pa.array([t if s else "" for t, s in zip(texts, stitched, strict=True)], pa.string())))
                rest = pa.array([None if s else t for t, s in zip(texts, stitched, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], ids, rest], names=["row", "doc_id", "n", "ids", "text"])

    def gather(document: pa.Table) -> pa.Table:
        """The ids of one document from its pieces."""
        document = document.sort_by("n")
        joined = b"".join(x or b"" for x in document["ids"].to_pylist())
        if document["text"].null_count == 0:
            whole = pa.array(["".join(document["text"].to_pylist())])
            joined = _encoder(data.value, pattern, by_units).encode(whole)[0].astype("<u4").tobytes()
        return pa.table([document["doc_id"].slice(0, 1).combine_chunks(), pa.array([joined], pa.binary())], names=["doc_id", "ids"])

    picked = docs.select("doc_id", "text")
    if not by_units:
        return picked.mapInArrow(encode, schema).withColumn("n_tokens", (F.length("ids") / 4).cast("long"))
    short = picked.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk).mapInArrow(encode, schema)
    pieces = _pieces(_chunks(picked.where(F.length("text") > chunk), chunk, overlap), pattern, chunk, overlap)
    long = pieces.mapInArrow(encode_pieces, f"row long, doc_id {kind}, n int, ids binary, text string").groupBy("row").applyInArrow(gather, schema)
    return short.union(long).withColumn("n_tokens", (F.length("ids") / 4).cast("long"))


def decode_documents(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """``encoded`` with a column ``decoded``: the bytes of its ``ids``, null for null.

    An id that no rank has is an error. Further columns stay, but one named
    ``decoded`` must not be there; an empty table gives an empty result.
    """
    data = encoded.sparkSession.sparkContext.broadcast(ranks)
    names = encoded.columns

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = worker_state("bpe bytes", data.value, lambda: {i: t for t, i in read_ranks(data.value).items()})
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = part.column(names.index("ids")).to_pylist()
                texts = [None if x is None else b"".join(map(token.__getitem__, array("I", x))) for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*names, "decoded"])

    fields = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(decode, f"{fields}, decoded binary")
