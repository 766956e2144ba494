from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import bpe
from ledgerloom.llm.queries import op10_bpe, rank_file
from ledgerloom.llm.units import UnitEncoder

SCHEMA = "doc_id long, text string, ids string, n long"


@pytest.fixture(scope="module")
def public():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(rank_file()), special_tokens={})


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_query_matches_the_library(spark, public):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = op10_bpe(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        ids = public.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(packed(ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab Z9 é½Ⅷ中.'s\n\t\r\x0b\x1c\x1f\x85  　​_!|<>"), max_size=40))
def test_units_match_the_library(text):
    core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes([b]): b for b in range(256)} | {b" a": 256, b"ab": 257, b" ab": 258, b"  ": 259}, special_tokens={})
    encoder = UnitEncoder(lambda units: list(map(core.encode_ordinary, units)), kept=4)
    for _ in range(2):
        assert encoder.encode(pa.array([text]))[0].tolist() == core.encode_ordinary(text)


@pytest.mark.parametrize("overlap", [40, 8])
def test_chunks_are_stitched(spark, public, overlap):
    rng = np.random.default_rng(5)
    parts = ["word", " ", "  ", "\n", "don't", "9", "é", "...", "x" * 30, "中文", "\t", " \n "]
    rows = [(n, "".join(rng.choice(parts, int(rng.integers(0, 300))))) for n in range(60)]
    rows += [(100, "y" * 1000), (101, " " * 999), (102, "a" * 63 + " b" * 64), (102, "a" * 63 + " b" * 64), (None, "z " * 200), (103, None), (104, ""), (105, "a" * 64), (106, "a" * 65)]
    docs = spark.createDataFrame([(*r, "mine", 1) for r in rows], SCHEMA)
    encoded = bpe.decode_documents(bpe.encode_documents(docs, rank_file(), public_tokenizers.PATTERN, by_units=True, chunk=64, overlap=overlap), rank_file())
    found = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids), r.n_tokens, bytes(r.decoded)) for r in encoded.collect())
    want = []
    for i, t in rows:
        ids = public.encode_ordinary(t or "")
        want.append((i is None, i or 0, packed(ids), len(ids), (t or "").encode()))
    assert found == sorted(want)
    assert bpe.encode_documents(docs.limit(0), rank_file(), public_tokenizers.PATTERN).count() == 0


def test_chunks_do_resynchronise(spark):
    """Ordinary text is stitched, not encoded as one."""
    docs = spark.createDataFrame([(1, "some words, and more of them. " * 100)], "doc_id long, text string")
    pieces = bpe._pieces(bpe._chunks(docs, 100, 40), public_tokenizers.PATTERN, 100, 40).collect()
    assert len(pieces) == 30 and all(p.stitched for p in pieces)
    assert "".join(p.text for p in sorted(pieces, key=lambda p: p.n)) == "some words, and more of them. " * 100
