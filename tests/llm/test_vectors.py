from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from ledgerloom.llm import vectors
from ledgerloom.llm.queries import op3_multi_index, op4_exact_top_k

SCHEMA = "vec_id long, embedding array<float>, vec string, rank int"


def brute(rows, every, k, change=lambda x: x, nonzero=True):
    """Each usable row by itself, against all usable rows of its length with another id."""
    usable = [(i, [change(x) for x in v]) for i, v in rows if i is not None and v and not any(x is None or not math.isfinite(x) for x in v) and (any(v) or not nonzero)]
    found = Counter()
    for q, v in usable:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v))[:k]
            found.update((q, r + 1, i, -s) for r, (s, i) in enumerate(scored))
    return found


def listed(df):
    return Counter((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def pairs(found):
    return Counter((q, r, v) for q, r, v, _ in found.elements())


def recall(found, want):
    hits = Counter((q, v) for q, _, v, _ in found.elements()) & Counter((q, v) for q, _, v, _ in want.elements())
    return hits.total() / want.total()


def table(spark, rows):
    return spark.createDataFrame([(i, v, "mine", 1) for i, v in rows], SCHEMA)


def example(n, seed=1):
    """Clusters, copies, unequal lengths and every kind of row that takes no part."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 12)) * rng.choice([0.1, 1, 3], size=(n, 1)) + 2 * rng.integers(0, 2, (n, 1))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(n + i, rows[3][1]) for i in range(40)]
    odd = [None, [], [0.0] * 12, [None] + [1.0] * 11, [math.nan] + [1.0] * 11, [math.inf] + [1.0] * 11, [1.0] * 5]
    rows += [(1000 + 20 * i, v) for i, v in enumerate(odd)] + [(None, [1.0] * 12), rows[7], (8, [9.0] * 12), (20, rows[20][1])]
    return rows


def test_multi_index_recall(spark):
    """The shipped parameters on 2,000 vectors: they leave vectors out, and the recall holds."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    found = listed(op3_multi_index(spark, "/root/testdata/sf0.1"))
    vec = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    want = Counter()
    for q in np.flatnonzero(ids % 20 == 0):
        order = [n for n in np.lexsort((ids, -(vec @ vec[q]))) if n != q][:20]
        want.update((int(ids[q]), r + 1, int(ids[n]), 0.0) for r, n in enumerate(order))
    assert len(found) == len(want) and {(q, r) for q, r, *_ in found} == {(q, r) for q, r, *_ in want}
    assert 0.93 <= recall(found, want) < 1
    at = {i: v for i, v in zip(ids.tolist(), vec, strict=True)}
    assert all(s == pytest.approx(at[q] @ at[v], abs=1e-12) for q, _, v, s in found)


def test_multi_index_probes_less_than_all(spark):
    rows = [(i, v) for i, v in example(300) if v and len(v) == 12]
    few = listed(vectors.multi_index_search(table(spark, rows), F.col("vec_id") % 20 == 0, centroids=8, probe=0.2, least=1))
    assert 0.3 < recall(few, brute(rows, 20, 20)) < 1


@pytest.mark.parametrize("block", [4096, 16])
def test_multi_index_edge_rows(spark, monkeypatch, block):
    """All cells probed: as brute force, whole cells or split ones, one slice of queries or several."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "SLICE", block // 2)
    rows = example(200)
    found = listed(vectors.multi_index_search(table(spark, rows), F.col("vec_id") % 20 == 0, centroids=4))
    want = brute(rows, 20, 20)
    assert pairs(found) == pairs(want)
    assert sorted(s for *_, s in found.elements()) == pytest.approx(sorted(s for *_, s in want.elements()))


def test_heap_goes_by_the_sum():
    rng = np.random.default_rng(2)
    first, second, counts = rng.normal(size=7), rng.normal(size=5), rng.integers(0, 4, (7, 5))
    cells = vectors.traverse(first, second, counts, 10**9)
    sums = [first[i] + second[j] for i, j in cells]
    assert sums == sorted(sums, reverse=True) and len(cells) == (counts > 0).sum()
    part = vectors.traverse(first, second, counts, 10)
    assert part == cells[: len(part)] and sum(counts[c] for c in part) >= 10 > sum(counts[c] for c in part[:-1])


def floor1024(x):
    return math.floor(1024 * x)


def test_exact_matches_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    assert listed(op4_exact_top_k(spark, "/root/testdata/sf0.01")) == brute(rows, 100, 10, floor1024, nonzero=False)


@pytest.mark.parametrize("block", [4096, 40])
def test_exact_edge_rows(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "SLICE", block // 5)
    rows = example(300)
    found = listed(vectors.exact_top_k(table(spark, rows), F.col("vec_id") % 20 == 0, k=10, head=3, step=8))
    assert found == brute(rows, 20, 10, floor1024, nonzero=False)


def test_exact_scores_of_63_bits(spark):
    """Scores up to the end of long are exact, whatever the components; those beyond are an error."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-3000, 3000, 64) * 90.0).tolist()) for i in range(60)] + [(100, [3e5] * 64), (101, [3e5] * 64), (102, [-3e5] * 64)]
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    found = listed(vectors.exact_top_k(table(spark, rows), F.col("vec_id") % 20 == 0, k=5))
    assert found == brute(rows, 20, 5, floor1024, nonzero=False) and max(s for *_, s in found) > 6e18
    with pytest.raises(PythonException, match="does not fit in a long"):
        vectors.exact_top_k(table(spark, [(20, [4e6] * 64), (21, [4e6] * 64)]), F.col("vec_id") % 20 == 0).collect()


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(7, [0.5]), (7, [0.9]), (20, [1.0]), (20, [2.0]), (3, [0.25])]
    want = [(20, 1, 7, 921), (20, 2, 7, 512), (20, 3, 3, 256)]
    doubled = [(q, r, v, (2 * (921, 512, 256)[r - 1])) for q, r, v, _ in want]
    found = listed(vectors.exact_top_k(table(spark, rows), F.col("vec_id") == 20))
    assert found == Counter([(q, r, v, s * 1024) for q, r, v, s in want + doubled])
    assert pairs(listed(vectors.multi_index_search(table(spark, rows), F.col("vec_id") == 20))) == Counter({(q, r, v): 2 for q, r, v, _ in want})


def test_no_vectors(spark):
    none = table(spark, [(1, None), (2, [])])
    assert vectors.multi_index_search(none, F.lit(True)).count() == vectors.exact_top_k(none, F.lit(True)).count() == 0
    one = table(spark, [(20, [1.0, 2.0]), (21, [0.5])])
    assert not listed(vectors.multi_index_search(one, F.lit(True))) and not listed(vectors.exact_top_k(one, F.lit(True)))
