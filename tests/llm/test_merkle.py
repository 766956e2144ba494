"""Merkle manifests against a plain tree."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(digests, arity=8):
    """The root and each leaf's list of (before, after)."""
    paths, level, of = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for i, path in enumerate(paths):
            run = of[i] // arity * arity
            path.append(("".join(level[run : of[i]]), "".join(level[of[i] + 1 : run + arity])))
        level = [h(*level[a : a + arity]) for a in range(0, len(level), arity)]
        of = [x // arity for x in of]
    return level[0], paths


def brute(rows):
    groups = {}
    for group, doc_id, leaf in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(group, []).append((doc_id, leaf))
    tops = {g: tree([leaf for _, leaf in leaves]) for g, leaves in groups.items()}
    root, above = tree([top for top, _ in tops.values()])
    found = []
    for (g, leaves), up in zip(groups.items(), above, strict=True):
        top, paths = tops[g]
        found += [(g, doc_id, leaf, top, root, tuple(path + up)) for (doc_id, leaf), path in zip(leaves, paths, strict=True)]
    return sorted(found, key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1, "": 9, "é": 8}, {"a": 1100, "b": 513, None: 512, "z": 65}, {f"g{k}": 1 for k in range(20)}])
def test_manifest_equals_plain_tree(spark, sizes):
    random.seed(3)
    rows = [(g, random.choice([None, random.randrange(n)]), h(str(random.randrange(n)))) for g, n in sizes.items() for _ in range(n)]
    leaves = spark.createDataFrame(rows, "lang string, doc_id long, leaf string")
    got = merkle.manifest(leaves, "lang", ["doc_id"])
    got = got.withColumn("ok", merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).collect()
    assert all(r.ok for r in got)
    assert sorted(((r.lang, r.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.path))) for r in got), key=str) == brute(rows)


def test_columns_with_clashing_names_and_no_rows(spark):
    leaves = spark.createDataFrame([("x", 1, "aa", "k", 5, 7), ("x", 1, "aa", "k", 5, 7)], "lang string, doc_id long, leaf string, key string, place int, salt int")
    got = merkle.manifest(leaves, "lang", ["doc_id"]).collect()
    assert [(r.key, r.place, r.salt) for r in got] == [("k", 5, 7)] * 2
    assert {r.root for r in got} == {h("aa", "aa")}
    assert merkle.manifest(leaves.where("false"), "lang", ["doc_id"]).count() == 0


def test_fields_and_tampering(spark):
    rows = [(None, "é"), (12, None), (-3, "")]
    got = spark.createDataFrame(rows, "n long, t string").select(merkle.field(F.col("n")).alias("n"), merkle.field(F.col("t")).alias("t")).collect()
    assert [tuple(r) for r in got] == [("-", "2:é"), ("2:12", "-"), ("2:-3", "0:")]
    path = F.array(F.struct(F.lit("a").alias("before"), F.lit("b").alias("after")))
    got = spark.range(1).select(merkle.folded(F.lit("x"), path).alias("f"), merkle.proof_digest(path).alias("p")).first()
    assert (got.f, got.p) == (h("axb"), h("ab"))
