from __future__ import annotations

import re
from collections import defaultdict

import pytest

from ledgerloom.llm import mixing
from ledgerloom.llm.mixing import mix, mixed_documents, sainte_lague

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, taken string"


def brute_targets(sizes):
    """Shares the excess again and again, until none is above its limit."""
    order = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def brute_seats(votes, seats, most):
    given = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if given[i] < most[i] and votes[i] > 0]
        if not open_:
            break
        given[max(open_, key=lambda i: (votes[i] / (2 * given[i] + 1), -i))] += 1
    return given


@pytest.mark.parametrize("votes", [[5.0, 5.0, 1.0], [1000.0, 3.0, 3.0, 2.0, 0.0], [7.5] * 9, [400.0, *[0.4] * 60]])
def test_highest_quotients(votes):
    for seats in (0, 1, 7, 100, 401):
        for most in ([10**6] * len(votes), [3] * len(votes), [10**6, *[1] * (len(votes) - 1)]):
            assert sainte_lague(votes, seats, most) == brute_seats(votes, seats, most)


@pytest.mark.parametrize("how", [{}, {"shard_words": 20_000}, {"shard_words": 60_000, "blocks": 20_000}])
def test_targets_and_limits(spark, how):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mix(docs, **how).collect()
    text = {r.doc_id: r for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id].text or ""))
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = brute_targets(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.03)
    again = mix(docs.repartition(7), **how).collect()
    assert sorted(again) == sorted(rows)


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", "b"), (4, "x y z", None), (4, "x y z", None), (None, "q q", "b"), (None, None, None), (5, "w " * 300_000, "ä"), (6, "one", "a")]
    docs = spark.createDataFrame([(i, t, "en", s, 0, "mine") for i, t, s in rows], SCHEMA)
    found = mix(docs).collect()
    assert len(found) == len(rows)
    assert {(r.source, r.source_size) for r in found} == {("a", 1), ("b", 2), ("ä", 300_000), (None, 6)}
    want = brute_targets({"a": 1, "b": 2, "ä": 300_000, None: 6})
    assert all(r.target == pytest.approx(want[r.source]) for r in found)
    assert all(r.taken <= 3 * r.size for r in found)
    assert mix(docs.limit(0)).count() == 0
    assert mix(docs.where("text is null")).select("taken").distinct().first().taken == 0
    out = mixed_documents(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} <= {4, 5, 6, None}


def test_documents_come_as_often_as_taken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    times = {r.doc_id: int(r.taken / r.size + 0.5) for r in mix(docs).collect() if r.size}
    got = {r.doc_id: r["count"] for r in mixed_documents(docs).groupBy("doc_id").count().collect()}
    assert got == {k: n for k, n in times.items() if n}
    assert mixing.MAX_REPEATS == 3 >= max(got.values())
