from __future__ import annotations

import corpus_pipeline
import numpy as np

from ledgerloom.llm import nearcopies, simhash


def edited(rng, n, changed):
    """Two texts of ``n`` shingles each, of which about ``changed`` differ, and their exact similarity."""
    words = [f"w{x}" for x in rng.integers(0, 10**9, n + 4)]
    other = list(words)
    for at in range(0, changed, 5):
        other[2 + at * n // max(changed, 1)] = f"x{rng.integers(10**9)}"
    sets = [{tuple(w[k : k + 5]) for k in range(n)} for w in (words, other)]
    return " ".join(words), " ".join(other), len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_finds_pairs_at_the_limit_and_none_below(spark):
    """Pairs of 0.80 to 0.83 in similarity, and of 0.72 to 0.80."""
    rng = np.random.default_rng(11)
    rows, similar = [], []
    while len(rows) < 1200:
        n = int(rng.choice([60, 200, 400]))
        one, two, found = edited(rng, n, int(n * rng.uniform(0.06, 0.14)))
        if not 0.72 <= found <= 0.83:
            continue
        similar.append(found)
        rows += [(len(rows), one, "s"), (len(rows) + 1, two, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    above = [2 * n + 1 not in kept for n, s in enumerate(similar) if s >= 0.8]
    below = [2 * n + 1 not in kept for n, s in enumerate(similar) if s < 0.8]
    assert len(above) > 100 and len(below) > 100
    assert sum(above) >= 0.99 * len(above) and not any(below)
    assert kept >= set(range(0, len(rows), 2))


def test_chains_join_and_rows_are_kept_whole(spark):
    """Each text is like the next only; ids that repeat with other texts, nulls, blanks."""
    rng = np.random.default_rng(5)
    words, chain = [f"w{x}" for x in range(200)], []
    for n in range(12):
        chain.append((100 + n, " ".join(words), "s"))
        for at in range(3):
            words[(n * 15 + at * 5) % 200] = f"y{rng.integers(10**9)}"
    sets = [nearcopies.shingle_set(t.encode()) for _, t, _ in chain]
    jaccard = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert all(jaccard(x, y) >= 0.8 for x, y in zip(sets, sets[1:], strict=False)) and jaccard(sets[0], sets[-1]) < 0.5
    odd = [(1, None, "s"), (2, "", "s"), (3, " \n", "s"), (4, "One two", "s"), (5, "one TWO", "s"), (7, "first text of seven", "s"), (7, "quite another one", "s"), (None, "one two", "s"), (8, "word " * 9, "s"), (9, "word " * 400_000, "s")]
    docs = spark.createDataFrame(chain + odd, "doc_id long, text string, source string").repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    found = sorted((r.doc_id or 0, (r.text or "")[:20]) for r in kept.collect())
    assert found == [(0, "one two"), (1, ""), (4, "One two"), (7, "first text of seven"), (7, "quite another one"), (8, ("word " * 9)[:20]), (100, chain[0][1][:20])]
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def row(node, size, sig=0):
    return bytes([node] * nearcopies.NODE) + np.int64(size).tobytes() + bytes(16) + bytes([0x11 * sig]) * (nearcopies.HASHES // 2)


def members(*rows):
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, nearcopies.WIDTH)


def test_candidates_of_a_list_and_of_two_blocks():
    forest = nearcopies.candidates(0.8, 0)
    ends = lambda left, right=None: {(int(u[0]), int(v[0])) for u, v in zip(*forest(left, right), strict=True)}
    rows = [row(1, 10), row(2, 8), row(3, 7), row(4, 5), row(5, 10, sig=1)]
    assert ends(members(*rows)) == {(2, 1), (3, 1)}
    assert ends(members(rows[0], rows[2]), members(rows[1], rows[3], rows[4])) == {(2, 1), (3, 1)}
    assert ends(members(rows[0], rows[1]), members(rows[3])) == set()


def test_similar_sets_join_as_all_pairs_do():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 40)
    sets = []
    for _ in range(60):
        changed = np.where(rng.random(40) < rng.uniform(0, 0.25), rng.integers(0, 1 << 62, 40), base)
        sets.append(np.unique(changed[: rng.integers(30, 41)]))

    def expected(pairs):
        label = list(range(60))
        for x, y in pairs:
            common = len(np.intersect1d(sets[x], sets[y]))
            if common >= 0.8 * (len(sets[x]) + len(sets[y]) - common):
                low, high = sorted((label[x], label[y]))
                label = [low if k == high else k for k in label]
        return label

    found = expected([(x, y) for x in range(60) for y in range(x)])
    assert nearcopies.similar_sets(sets, None, 0.8).tolist() == found and 1 < len(set(found)) < 60
    assert nearcopies.similar_sets(sets, 25, 0.8).tolist() == expected([(x, y) for x in range(25) for y in range(25, 60)])


def test_clusters_of_many_blocks_give_the_same_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words, rows = [f"w{x}" for x in range(120)], []
    for n in range(150):
        own = list(words)
        for at in rng.integers(0, 120, rng.integers(0, 5)):
            own[at] = f"z{rng.integers(10**9)}"
        rows.append((n, " ".join(own), "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    once = sorted(r.doc_id for r in nearcopies.keep_one_near(docs).collect())
    monkeypatch.setattr(nearcopies, "SHINGLES", 2000)
    assert sorted(r.doc_id for r in nearcopies.keep_one_near(docs).collect()) == once
    sets = [nearcopies.shingle_set(t.encode()) for _, t, _ in rows]
    assert once == sorted(set(nearcopies.similar_sets(sets, None, 0.8).tolist())) and 1 < len(once) < 150


def test_candidates_come_from_bytes_of_fingerprints():
    """Any 41 shared bytes meet in a list; few sets of like shingles don't, and sets apart hardly ever do."""
    rng = np.random.default_rng(21)
    width = nearcopies.BITS // 8
    one = rng.integers(0, 256, (300, width), np.uint8)
    other = one ^ rng.integers(1, 256, (300, width), np.uint8)
    for a, b in zip(one, other, strict=True):
        shared = rng.choice(width, nearcopies.GROUPS + 1, replace=False)
        b[shared] = a[shared]
    met = (nearcopies.list_keys(one) == nearcopies.list_keys(other)).any(axis=1)
    assert met.all()
    assert not (nearcopies.list_keys(one) == nearcopies.list_keys(np.invert(one))).any()

    def prints(changed, n):
        base = rng.integers(0, 1 << 62, n, np.uint64)
        new = base.copy()
        new[:changed] = rng.integers(0, 1 << 62, changed, np.uint64)
        return [np.frombuffer(nearcopies.sketch(np.unique(x)), np.uint8) for x in (base, new)]

    def found(changed, n, pairs):
        left, right = (np.array(x) for x in zip(*[prints(changed, n) for _ in range(pairs)], strict=True))
        return (nearcopies.list_keys(left) == nearcopies.list_keys(right)).any(axis=1).mean()

    assert found(10, 90, 1500) >= 0.995  # 80 of 100 shingles in common
    assert found(1, 9, 1500) >= 0.995  # 8 of 10
    assert found(90, 90, 500) <= 0.02


def test_lists_of_one_group_give_about_one_edge_a_node(spark, monkeypatch):
    """Fifty lists, each with most of the same 120 members in another order: short lists, and lists met as blocks."""
    rng, n = np.random.default_rng(3), 120
    rows = [(key, row(int(m), 10)) for key in range(50) for m in rng.permutation(n) if m < 60 or rng.random() < 0.9]
    rows += [(50, row(200, 10)), (50, row(201, 10)), (51, row(202, 90)), (51, row(203, 10))]
    posted = spark.createDataFrame([(k, bytearray(m)) for k, m in rows], "key long, member binary").coalesce(1)
    for block in (16384, 16):
        monkeypatch.setattr(simhash, "BLOCK", block)
        found = simhash.met_in_lists(posted, nearcopies.WIDTH, nearcopies.candidates(0.8, 0))
        edges = {(r.u[0], r.v[0]) for r in found.collect()}
        label = list(range(256))
        for _ in range(n):
            for u, v in edges:
                label[u] = label[v] = min(label[u], label[v])
        assert not any(label[:n]) and label[201] == 200 and label[203] == 203
        assert len(edges) <= (n if block > n else 8 * n)
