"""Merkle trees over groups of rows, with a proof for every row.

The rows of a group, in order, are leaves. While a level has several nodes,
every ``arity`` consecutive ones become their hash. The tops of the groups,
ordered by group, are the leaves of one tree more, whose top is the root.

Levels are computed a few at a time within chunks of consecutive nodes, a fixed
number however large a group is: a node's siblings are ``lag`` and ``lead`` by
fixed offsets, masked by its slot in the run and by the run's length, and the
first child of a run hashes its parent. Chunk tops, fewer by the chunk's size,
are the nodes of the next step; paths to the root then come down the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.places import fresh, group_key, with_places
from ledgerloom.session import written

#: Levels that are computed over one arrangement of nodes in chunks.
LEVELS = 3
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the texts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(column: Column) -> Column:
    """``-`` for null, else the UTF-8 length in bytes, ``:`` and the value as text."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _climb(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes with ``chunk``, ``local`` (their siblings, level by level) and ``top`` (the chunk's digest).

    ``nodes`` has ``key, place, of, digest``. An entry of ``local`` is a struct of
    the run's digests before and after; levels of a single node have no entry.
    ``top`` is on the chunk's first row only.
    """
    place, size = F.col("place"), arity**LEVELS
    chunks = Window.partitionBy("key", "chunk").orderBy("place")
    upto = chunks.rowsBetween(Window.unboundedPreceding, 0)
    found = nodes.withColumn("chunk", F.floor(place / size)).withColumn("_node0", F.col("digest"))
    for level in range(LEVELS):
        step, node = arity**level, f"_node{level}"
        at, nodes_here = F.floor(place / step), F.ceil(F.col("of") / step)
        slot = at % arity
        run = F.least(F.lit(arity), nodes_here - at + slot)
        before = F.concat(*[F.when(slot >= k, F.lag(node, k * step).over(chunks)).otherwise("") for k in range(arity - 1, 0, -1)])
        after = F.concat(*[F.when(slot + k < run, F.lead(node, k * step).over(chunks)).otherwise("") for k in range(1, arity)])
        own = F.when((place % step == 0) & (nodes_here > 1), F.struct(before.alias("before"), after.alias("after")))
        found = found.withColumn(f"_own{level}", own)
        parent = F.when(nodes_here > 1, digest(F.col(node), F.col(f"_own{level}.after"))).otherwise(F.col(node))
        found = found.withColumn(f"_node{level + 1}", F.when(place % (step * arity) == 0, parent))
    # A node further down has the entries of the last first child at or before it.
    entries = F.array(*[F.last(f"_own{level}", ignorenulls=True).over(upto) for level in range(LEVELS)])
    found = found.withColumn("local", F.filter(entries, lambda e: e.isNotNull()))
    top = F.col(f"_node{LEVELS}").alias("top")
    return found.select(*nodes.columns, "chunk", "local", top)


def _tops(nodes: DataFrame, arity: int) -> DataFrame:
    """The chunk tops as nodes of the next step."""
    size = arity**LEVELS
    tops = _climb(nodes.select("key", "place", "of", "digest"), arity).where(F.col("place") % size == 0)
    return tops.select("key", F.col("chunk").alias("place"), F.ceil(F.col("of") / size).alias("of"), F.col("top").alias("digest"))


def _proofs(leaves: DataFrame, arity: int, name: str, above=None) -> DataFrame:
    """``leaves`` (``key, place, of, digest`` and others) with ``path, subroot, root``.

    ``above(tops)`` gives ``key, path, subroot, root`` of each tree's top; without
    it the trees' tops are roots.
    """
    steps, most = [leaves], leaves.agg(F.max("of")).first()[0] or 1
    while True:
        tops, most = written(_tops(steps[-1], arity), name), -(-most // arity**LEVELS)
        if most == 1:
            break
        steps.append(tops)
    if above:
        known = above(tops.select("key", "digest"))
    else:
        known = tops.select("key", F.lit(None).cast(PATH).alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    known = known.select("key", F.lit(0).cast("long").alias("chunk"), "path", "subroot", "root")
    for nodes in reversed(steps):
        here = _climb(nodes, arity).drop("top").join(known, ["key", "chunk"])
        path = F.concat("local", F.coalesce("path", F.array().cast(PATH)))
        here = here.withColumn("path", path).drop("local", "chunk")
        known = here.select("key", F.col("place").alias("chunk"), "path", "subroot", "root")
    return here


def manifest(leaves: DataFrame, group: str, order: list[str], leaf: str = "leaf", arity: int = 8) -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` and ``path``, the proof of each.

    ``leaf`` is a column of digests. Leaves of one ``group`` ascend by ``order``,
    nulls first, then by digest; rows equal in all of these are leaves each, in any order. A null
    group is a group, the first. ``path`` is an array of structs ``before, after``:
    at each level with several nodes the digests of the run's other nodes, from
    the leaf to the root. A single leaf of a single group is the root, its path
    is empty. Further columns stay; names ``path``, ``subroot`` and ``root`` of
    the input are replaced. An empty table gives an empty result.
    """
    kept = [c for c in leaves.columns if c not in ("path", "subroot", "root")]
    salt = fresh("salt", leaves)
    row = F.struct(*[F.col(c) for c in kept])
    # What differs between rows that are equal in all columns is only where they stand.
    told = leaves.select(group_key(F.col(group)).alias("key"), F.struct(*order).alias("by"), F.col(leaf).alias("digest"), row.alias("row"), F.monotonically_increasing_id().alias(salt))
    by = [F.col(f"by.{c}").asc_nulls_first() for c in order]
    placed = with_places(written(told, "leaves"), "key", [*by, F.col("digest").asc_nulls_first(), F.col(salt)], "places").drop("by", salt)

    def root(tops: DataFrame) -> DataFrame:
        one = tops.select(F.lit("").alias("key"), F.col("key").alias("group"), "digest")
        ordered = with_places(one, "key", [F.col("group")], "groups")
        proofs = _proofs(ordered, arity, "groups")
        return proofs.select(F.col("group").alias("key"), "path", F.col("digest").alias("subroot"), "root")

    found = _proofs(placed, arity, "nodes", root)
    return found.select("row.*", "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """Hash of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda e: F.concat(e.before, e.after)), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda at, e: digest(e.before, at, e.after))
