from __future__ import annotations

import glob
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import tokenfiles
from ledgerloom.llm.queries import op8_token_files
from ledgerloom.session import new_path

FILE = public_tokenizers.path("byte_bpe_50k.json")


def library():
    """The library as it is, on whole texts."""
    loaded = Tokenizer.from_file(FILE)
    return lambda text: np.array([*loaded.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes()


def test_query_matches_the_library(spark):
    encode = library()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = sorted(op8_token_files(spark, "/root/testdata/sf0.001").collect())
    assert [r.doc_id for r in found] == sorted(texts)
    start = 0
    for r in found:
        ids = encode(texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += r.n_tokens


@pytest.mark.parametrize("per_file", [16384, 7, 1])
def test_round_trip(spark, per_file):
    encode = library()
    rows = [(n, f"text number {n} " * (n % 9)) for n in range(60)] + [(7, "again"), (7, "again"), (None, "no id"), (None, None), (1000, None), (1001, ""), (-5, "<|endoftext|> a  b \n\n"), (2000, "word " * 60_000)]
    rows += [(3000, f"same id {n}") for n in range(20)] + [(None, f"no id {n}") for n in range(9)]
    rows += [(3001, "hi <|endoftext|> x"), (3002, "<|endoftext|><|endoftext|>"), (3003, "a  b \n <|endoftext|>  \n c")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, ids string").repartition(3)
    root = new_path(spark, "test")
    files = tokenfiles.write_token_files(docs, Path(FILE).read_text(), root, end_id=2, docs_per_file=per_file)
    found = sorted(tokenfiles.read_token_files(spark, root, files).collect(), key=lambda r: r.start)
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    assert [(r.doc_id is not None, r.doc_id or 0) for r in found] == sorted((i is not None, i or 0) for i, _ in rows)
    assert sorted((r.doc_id or 0, bytes(r.ids)) for r in found) == sorted((i or 0, encode(t or "")) for i, t in rows)
    local = root.removeprefix("file://")
    assert sorted(Path(f).name for f in glob.glob(f"{local}/*")) == ["dictionary.zdict", *(f for f, *_ in files)]
    dictionary = Path(f"{local}/dictionary.zdict").read_bytes()
    contents = [Path(f"{local}/{f}").read_bytes() for f, *_ in files]
    for doc_id, text in ((-5, "<|endoftext|> a  b \n\n"), (1001, ""), (2000, "word " * 60_000), (3001, "hi <|endoftext|> x")):
        got = [x for c in contents if (x := tokenfiles.read_document(c, dictionary, doc_id)) is not None]
        assert [x.tobytes() for x in got] == [encode(text)]
    assert all(tokenfiles.read_document(c, dictionary, 12345) is None for c in contents)
    with pytest.raises(ValueError, match="another dictionary"):
        tokenfiles.read_index(contents[0], b"other")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    root = new_path(spark, "test")
    files = tokenfiles.write_token_files(docs, Path(FILE).read_text(), root, end_id=2)
    assert files == [] and tokenfiles.read_token_files(spark, root, files).count() == 0


def test_special_token_is_found_before_the_text_is_split():
    encoder = tokenfiles._Encoder(Path(FILE).read_text())
    ids, counts = encoder.encode(pa.array(["hi <|endoftext|> x", None, "hi", "<|endoftext|>"]))
    assert ids.tolist() == [5303, 220, 50256, 2124, 5303, 50256] and counts.tolist() == [4, 0, 1, 1]


def test_files_are_closed_by_size(spark, monkeypatch):
    """A range of ids that is too long for a file goes on in further ones, in order."""
    docs = spark.createDataFrame([(n, f"text {n * 7919}") for n in range(500)], "doc_id long, text string")
    monkeypatch.setattr(tokenfiles, "FILE_BYTES", 400)
    root = new_path(spark, "test")
    files = tokenfiles.write_token_files(docs, Path(FILE).read_text(), root, docs_per_file=300)
    assert len(files) > 2 and sum(n for _, n, _ in files) == 500
    found = sorted(tokenfiles.read_token_files(spark, root, files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == list(range(500))
