"""Token files: zstandard frames per document with a shared dictionary.

A folder holds ``dictionary.zdict`` and files ``part-<n>-<m>.tok``, which in
order of their names hold the documents in ascending order of ``doc_id``:

- 8 bytes ``LLTOK001``, 32 bytes SHA-256 of the dictionary,
- one zstandard frame per document: its ids as little-endian 32-bit integers,
- the index, little-endian: per document ``doc_id`` (int64), ``known`` (uint8,
  0 for a null id), ``end`` (uint64, of its frame, from the file's start),
  ``n_tokens`` (uint64); each as one array,
- the number of documents (uint64) and 8 bytes ``LLTOKEND``.

So one document is read from the index and its own frame, not the whole file.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.arrow import worker_state
from ledgerloom.llm.units import UnitEncoder, id_column, text_slices
from ledgerloom.session import written

HEAD, TAIL = b"LLTOK001", b"LLTOKEND"

#: The dictionary is trained on about SAMPLE documents, those with the smallest
#: hash of their id. One of more than WINDOW ids gives a run of WINDOW of them.
SAMPLE, WINDOW, DICTIONARY = 1000, 4096, 32768
#: Documents of a file, unless that gives more than FILES files; bytes after
#: which a file is closed and its documents go on in a further one.
DOCS_PER_FILE, FILES, FILE_BYTES = 4096, 1 << 16, 256 << 20


class _Encoder:
    """Ids of texts by the tokenizers library.

    Texts that hold the string of an added token are given to it as a whole, as
    it looks for these before it splits a text; all others go by their units.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_str(tokenizer)
        self.many = lambda units: [e.ids for e in loaded.encode_batch_fast(units, add_special_tokens=False)]
        self.added = [t.content for t in loaded.get_added_tokens_decoder().values()]
        self.units = UnitEncoder(self.many)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and how many each has; null is empty."""
        special = np.zeros(len(texts), bool)
        for token in self.added:
            special |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        if not special.any():
            return self.units.encode(texts)
        flat, counts = self.units.encode(texts.filter(pa.array(~special)))
        ends = np.cumsum(counts)
        plain = (flat[a:b] for a, b in zip(ends - counts, ends, strict=True))
        whole = (np.array(ids, np.uint32) for ids in self.many(texts.filter(pa.array(special)).to_pylist()))
        parts = [next(whole if x else plain) for x in special]
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def token_encoder(tokenizer: str) -> _Encoder:
    """The worker's encoder of the content of a tokenizer file."""
    return worker_state("tokenizer", tokenizer, lambda: _Encoder(tokenizer))


def train_dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A zstandard dictionary from serialized id arrays; their end, if too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _codec(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


class TokenFile:
    """One file in the making: frames go out at once, the index at the end."""

    def __init__(self, root: str, name: str, dictionary: bytes):
        self.fs, folder = pyarrow.fs.FileSystem.from_uri(root)
        self.final, self.temporary = f"{folder}/{name}", f"{folder}/_{name}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(HEAD + hashlib.sha256(dictionary).digest())
        self.at, self.ids, self.ends, self.lengths = 40, [], [], []

    def add(self, doc_id: int | None, frame: bytes, n_tokens: int) -> None:
        self.out.write(frame)
        self.at += len(frame)
        self.ids.append(doc_id)
        self.ends.append(self.at)
        self.lengths.append(n_tokens)

    def close(self) -> tuple[int, int]:
        """Moves the file to its name; a later attempt of the task replaces it by the same."""
        known = [x is not None for x in self.ids]
        for values, kind in (([x or 0 for x in self.ids], "<i8"), (known, "u1"), (self.ends, "<u8"), (self.lengths, "<u8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(len(self.ids).to_bytes(8, "little") + TAIL)
        self.out.close()
        self.fs.move(self.temporary, self.final)
        return len(self.ids), sum(self.lengths)


def read_index(content: bytes, dictionary: bytes) -> tuple[list[int | None], list[int], list[int]]:
    """Ids, frame ends (one more than documents) and token counts of a file."""
    n = int.from_bytes(content[-16:-8], "little")
    if content[:8] != HEAD or content[-8:] != TAIL:
        raise ValueError("not a whole token file")
    if content[8:40] != hashlib.sha256(dictionary).digest():
        raise ValueError("written with another dictionary")
    at, arrays = len(content) - 16 - 25 * n, []
    for kind in ("<i8", "u1", "<u8", "<u8"):
        arrays.append(np.frombuffer(content, kind, n, at))
        at += arrays[-1].nbytes
    ids = [i if k else None for i, k in zip(arrays[0].tolist(), arrays[1].tolist(), strict=True)]
    return ids, [40, *arrays[2].tolist()], arrays[3].tolist()


def read_document(content: bytes, dictionary: bytes, doc_id: int) -> np.ndarray | None:
    """The ids of one document, by the index; None if the file doesn't have it."""
    ids, ends, _ = read_index(content, dictionary)
    start = sum(x is None for x in ids[: bisect.bisect_left(ids, True, key=lambda x: x is not None)])
    place = bisect.bisect_left(ids, doc_id, lo=start)
    if place == len(ids) or ids[place] != doc_id:
        return None
    frame = content[ends[place] : ends[place + 1]]
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=_codec(dictionary)).decompress(frame), "<u4")


def _windows(docs: DataFrame, shared, rows: int) -> list[bytes]:
    """Serialized ids to train a dictionary on: about SAMPLE runs of at most WINDOW ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_encoder(shared.value)
        for batch in batches:
            for part in text_slices(batch, 1):
                flat, counts = encoder.encode(part.column(1))
                most = np.maximum(counts - WINDOW, 0)
                starts = np.cumsum(counts) - counts + np.abs(part.column(0).to_numpy()) % (most + 1)
                ids = [flat[a : a + min(n, WINDOW)].astype("<u4").tobytes() for a, n in zip(starts, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])

    mark = F.xxhash64("doc_id")
    part = F.pmod(mark, F.lit(1 << 30)) < int(min(1, SAMPLE / max(rows, 1)) * (1 << 30))
    sample = docs.where(part).select(F.shiftrightunsigned(mark, 32).alias("mark"), "text").mapInArrow(run, "ids binary")
    return sorted(bytes(r.ids) for r in written(sample, "sample").collect())


def write_token_files(docs: DataFrame, tokenizer: str, root: str, end_id: int | None = None, docs_per_file: int = DOCS_PER_FILE) -> list[tuple[str, int, int]]:
    """Writes the token ids of all ``docs`` below ``root``; ``(file, documents, ids)`` each.

    ``tokenizer`` is the content of a byte-level BPE file of the tokenizers
    library; texts are encoded whole, with ``add_special_tokens=False``, then
    ``end_id`` is appended to each document. Files take ranges of ``doc_id`` of
    about ``docs_per_file`` documents, more of them if there would be more than
    FILES files; one of more than FILE_BYTES bytes goes on in a further file. A
    task writes under a name of its own and renames at the end, so lost
    executors and second attempts leave no half files.

    Null texts are empty. Null ids come first, in files of their own; an id that
    is repeated so often that it fills files is dealt over these. Repeated ids
    are in order of their frames within a file. Further columns are ignored; an
    empty table writes no file.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer)
    kind = dict(docs.dtypes)["doc_id"]
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    rows, unnamed = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    windows = _windows(docs, shared, rows)
    dictionary = train_dictionary([w + end for w in windows])
    fs, folder = pyarrow.fs.FileSystem.from_uri(root)
    fs.create_dir(folder)
    with fs.open_output_stream(f"{folder}/dictionary.zdict") as out:
        out.write(dictionary)

    per_file = max(docs_per_file, -(-rows // FILES))
    null_files, n_files = -(-unnamed // per_file), -(-(rows - unnamed) // per_file)
    at = [k / n_files for k in range(1, n_files)]
    bounds = np.array((docs.agg(F.percentile_approx("doc_id", at, 20 * n_files)).first()[0] if at else None) or [], np.int64)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, compressor = token_encoder(shared.value), zstandard.ZstdCompressor(level=3, dict_data=_codec(dictionary))
        for batch in batches:
            for piece in text_slices(batch, 1):
                flat, counts = encoder.encode(piece.column(1))
                made, crcs = [], []
                for ids in id_column(flat, counts):
                    ids = ids.as_buffer().to_pybytes() + end
                    made.append(compressor.compress(ids))
                    crcs.append(zlib.crc32(ids))
                # An id that several bounds equal may be in any file between them.
                known, crc = piece.column(0).is_valid().to_numpy(zero_copy_only=False), np.array(crcs, np.int64)
                doc_ids = pc.fill_null(piece.column(0), 0).to_numpy().astype(np.int64)
                lo, hi = np.searchsorted(bounds, doc_ids), np.searchsorted(bounds, doc_ids, side="right")
                file_no = np.where(known, null_files + lo + crc % (hi - lo + 1), crc % max(null_files, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file_no, pa.int32()), piece.column(0), pa.array(counts + len(end) // 4, pa.int64()), pa.array(made, pa.binary())], names=["file_no", "doc_id", "n_tokens", "frame"]
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One file after another from rows sorted by file and id."""
        current, file_of, further, done = None, None, 0, []
        for batch in batches:
            for number, doc_id, n_tokens, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or number != file_of or current.at >= FILE_BYTES:
                    further = further + 1 if current is not None and number == file_of else 0
                    if current is not None:
                        done.append((name, *current.close()))
                    file_of, name = number, f"part-{number:08d}-{further:04d}.tok"
                    current = TokenFile(root, name, dictionary)
                current.add(doc_id, frame, n_tokens)
        if current is not None:
            done.append((name, *current.close()))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "documents", "ids"])

    framed = docs.select("doc_id", "text").mapInArrow(frames, f"file_no int, doc_id {kind}, n_tokens long, frame binary")
    dealt = framed.repartition(max(1, null_files + n_files), "file_no").sortWithinPartitions("file_no", F.col("doc_id").asc_nulls_first(), "frame")
    return sorted(tuple(r) for r in dealt.mapInArrow(write, "file string, documents long, ids long").collect())


def read_token_files(spark: SparkSession, root: str, files: list[tuple[str, int, int]]) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents in the files of a folder.

    ``start`` is the number of ids of all documents before it. ``files`` is what
    write_token_files returned: a row per file, not per document.
    """
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not files:
        return spark.createDataFrame([], schema)
    before, base = 0, {}
    for name, _, ids in files:
        base[name], before = before, before + ids
    base = spark.sparkContext.broadcast(base)
    dictionary = bytes(spark.read.format("binaryFile").load(f"{root}/dictionary.zdict").first().content)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor(dict_data=_codec(dictionary))
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = content.as_buffer()
                ids, ends, lengths = read_index(content.to_pybytes(), dictionary)
                starts = np.cumsum([base.value[PurePosixPath(path).name], *lengths])[:-1]
                view = memoryview(content)
                for at in range(0, len(ids), 512):
                    got = [decompressor.decompress(view[a:b]) for a, b in zip(ends[at : at + 512], ends[at + 1 : at + 513], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[at : at + 512], pa.int64()), pa.array(starts[at : at + 512], pa.int64()), pa.array(lengths[at : at + 512], pa.int64()), pa.array(got, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    contents = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tok").load(root).select("path", "content")
    return contents.mapInArrow(decode, schema)
