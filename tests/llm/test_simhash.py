from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import simhash
from ledgerloom.llm.queries import op1_simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_print(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, max_bits=2):
    prints = [(i, brute_print(t)) for i, t in rows]
    values = sorted({p for _, p in prints})
    root = {p: p for p in values}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    array = np.array(values, np.uint64)
    for k, p in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(array[k + 1 :] ^ array[k]) <= max_bits):
            root[find(values[k + 1 + j])] = find(p)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return sorted((i, f"{p:016x}", least.get(find(p))) for i, p in prints if i is not None)


def test_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = sorted(map(tuple, op1_simhash(spark, "/root/testdata/sf0.001").collect()))
    assert found == brute_groups(rows)


@pytest.mark.parametrize("block", [16384, 3])
def test_chains_and_long_posting_lists(spark, monkeypatch, block):
    """Near fingerprints in one posting list, whole and cut into blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(7)
    base = int(rng.integers(1 << 62))
    values = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 40)}
    values |= {base ^ 0b11 ^ (1 << k) ^ (1 << k + 1) for k in range(8, 60)}
    prints = spark.createDataFrame([(bytearray(v.to_bytes(8, "big")),) for v in values], "fingerprint binary")
    found = simhash.links(prints, 64, 2, 6, 6).collect()
    root = {v: v for v in values}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for r in found:
        root[find(int.from_bytes(r.u, "big"))] = find(int.from_bytes(r.v, "big"))
    got = {frozenset(v for v in values if find(v) == f) for f in {find(v) for v in values}}
    root = {v: v for v in values}
    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    assert got == {frozenset(v for v in values if find(v) == f) for f in {find(v) for v in values}}


def test_any_cover_meets_in_the_index():
    from itertools import combinations

    keys = [set(k) for k in simhash.index_keys(8, 6)]
    assert all(any(k <= set(some) for k in keys) for some in combinations(range(8), 6))
    keys = [set(k) for k in simhash.index_keys(16, 5, groups=2)]
    assert all(any(k <= set(some) for k in keys) for some in combinations(range(16), 5))


def test_edge_rows(spark):
    long = "word%d " * 3 % (1, 2, 3) + "x" * 10 + " tail" * 400_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (4, "one"), (5, "a b"), (6, long), (7, long.upper()), (None, "a b"), (None, "only here")]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], SCHEMA).withColumnRenamed("n_chars", "fingerprint")
    found = simhash.simhash_groups(docs).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found if r.doc_id is not None) == brute_groups(rows)
    assert sorted((r.component_id is None) for r in found if r.doc_id is None) == [False, True]
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_wide_prints_catch_edited_copies(spark):
    rng = np.random.default_rng(3)
    word = [f"w{int(x)}" for x in rng.integers(0, 5000, 400)]
    edited = word[:100] + ["new"] + word[101:300] + ["other"] + word[301:]
    docs = spark.createDataFrame([(1, " ".join(word)), (2, " ".join(edited)), (3, " ".join(word[::-1]))], "doc_id long, text string")
    how = dict(shingle=5, bits=128, max_bits=20, cover=5, min_match=3, groups=2)
    found = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs, **how).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
