"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def binary_column(matrix: np.ndarray) -> pa.Array:
    """One binary value per row of a 2-D uint8 array."""
    rows, width = matrix.shape
    data = pa.py_buffer(np.ascontiguousarray(matrix).tobytes())
    offsets = pa.py_buffer((np.arange(rows + 1, dtype=np.int32) * width).tobytes())
    return pa.Array.from_buffers(pa.binary(), rows, [None, offsets, data])


def byte_matrix(column: pa.Array, width: int) -> np.ndarray:
    """The inverse of binary_column for values of one width."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(-1, width)


def float_matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long float lists as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def word_chunks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of a text split at ASCII white space, some MB at a time.

    A piece ends only before white space, so no word is cut.
    """
    start = 0
    while len(text) - start > size:
        end = start + size
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[start:end].split()
        start = end
    yield text[start:].split()


def worker_state(kind: str, key, make):
    """What ``make()`` gives, made once for each Python worker process.

    A worker keeps one value of each kind; another key replaces it.
    """
    import sys
    import types

    held = sys.modules.setdefault("_worker_state", types.ModuleType("_worker_state")).__dict__
    if kind not in held or held[kind][0] != key:
        held[kind] = (key, make())
    return held[kind][1]


def with_score(docs: DataFrame, make: Callable[[], Callable], keep: list[str], name: str, rows: int = 256) -> DataFrame:
    """The columns ``keep`` of ``docs`` and a double ``name``.

    ``make()``, called once a task, gives a function from the UTF-8 bytes of
    some texts to their scores.
    """
    picked = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    at = picked.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                values = pa.array(score(text_bytes(part.column(at))), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], values], names=[*keep, name])

    return picked.mapInArrow(run, T.StructType([*docs.select(*keep).schema.fields, T.StructField(name, T.DoubleType())]))
