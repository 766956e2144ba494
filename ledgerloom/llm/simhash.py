"""SimHash near-duplicates by a byte-position inverted index.

Fingerprints of ``bits`` bits are read as ``bits / 8`` positional bytes. Two
fingerprints that differ in few bits share many positional bytes, so they meet
in at least one posting list of the index. Postings are keyed by several
positional bytes at once (the intersection of their single lists), because a
list of one byte value would hold 1/256 of the corpus at any scale. In a
posting list the shared positional bytes of each pair are tallied, pairs below
the minimum are left out, and the others are verified by their differing bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.arrow import binary_column, byte_matrix, text_bytes, word_chunks
from ledgerloom.llm.graph import components
from ledgerloom.operators.joins import spread_join
from ledgerloom.session import written

#: Members of a posting list that one task compares at a time.
BLOCK = 16384


def _ones(hashes: list[int], lanes: int) -> np.ndarray:
    """How many of the hashes have each bit set; further lanes remix the hash."""
    h = np.array(hashes, dtype=np.uint64)
    all_lanes = [h]
    for lane in range(1, lanes):
        x = h ^ np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        all_lanes.append(x ^ (x >> np.uint64(31)))
    rows = np.stack(all_lanes, axis=1).astype(">u8").view(np.uint8)
    return np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, shingle: int = 3, bits: int = 64) -> bytes:
    """SimHash of a text's word shingles; all zero for a text without words."""
    digest, lanes = xxhash.xxh64_intdigest, bits // 64
    ones, total, carry = np.zeros(bits, np.int64), 0, []
    for words in word_chunks(text.lower()):
        carry += words
        if len(carry) < shingle:
            continue
        joined = b" ".join(carry)
        ends = np.cumsum(np.fromiter(map(len, carry), np.int64, len(carry)) + 1) - 1
        starts = [0, *(ends[: len(carry) - shingle] + 1).tolist()]
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
        for at in range(0, len(hashes), 1 << 15):
            ones += _ones(hashes[at : at + (1 << 15)], lanes)
        total += len(hashes)
        carry = carry[len(carry) - shingle + 1 :]
    if not total and carry:
        ones, total = _ones([digest(b" ".join(carry), 42)], lanes), 1
    return np.packbits(ones * 2 > total).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 3, bits: int = 64) -> DataFrame:
    """``doc_id, fingerprint`` (binary) of every row of ``docs``, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, shingle, bits) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], names=["doc_id", "fingerprint"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint binary")


def index_keys(n_bytes: int, cover: int, groups: int = 4) -> list[tuple[int, ...]]:
    """Position tuples of which any ``cover`` of ``n_bytes`` positions hold one whole.

    The positions lie in equal groups. With fewer misses than groups some groups
    are whole, and their unions serve; else some group has its share of the
    matches, and all tuples of that size within a group serve.
    """
    size = n_bytes // groups
    parts = [range(g * size, (g + 1) * size) for g in range(groups)]
    whole = groups - (n_bytes - cover)
    if whole > 0:
        return [tuple(p for part in some for p in part) for some in combinations(parts, whole)]
    share = -(-cover // groups)
    return [some for part in parts for some in combinations(part, share)]


def _hook(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joins the sets of i[k] and j[k]; parent holds each member's least one."""
    while True:
        a, b = parent[i], parent[j]
        open_ = a != b
        if not open_.any():
            return parent
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _linked(left: np.ndarray, right: np.ndarray, min_match: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that share enough positional bytes and differ in few bits."""
    shared = np.zeros((len(left), len(right)), np.uint8)
    for p in range(left.shape[1]):
        shared += left[:, p, None] == right[None, :, p]
    i, j = np.nonzero(shared >= min_match)
    differing = np.bitwise_count(left[i] ^ right[j]).sum(axis=1, dtype=np.int64)
    near = differing <= max_bits
    return i[near], j[near]


def _forest(left: np.ndarray, right: np.ndarray | None, min_match: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked within left, or between left and right."""
    rows = left if right is None else np.concatenate([left, right])
    parent, step = np.arange(len(rows)), max(1, (1 << 22) // len(rows))
    for at in range(0, len(left), step):
        if right is None:
            i, j = _linked(left[at : at + step], rows[at:], min_match, max_bits)
            parent = _hook(parent, i + at, j + at)
        else:
            i, j = _linked(left[at : at + step], right, min_match, max_bits)
            parent = _hook(parent, i + at, j + len(left))
    child = np.flatnonzero(parent != np.arange(len(rows)))
    return rows[child], rows[parent[child]]


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """``key, members, last`` of batches sorted by key, BLOCK members at most; most keys of one member are left out."""
    key, parts, held = None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        rows = byte_matrix(batch.column(1), width)
        starts = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
        ends = np.append(starts[1:], len(keys))
        wanted = ends - starts > 1
        wanted[[0, -1]] = True
        for a, b in zip(starts[wanted].tolist(), ends[wanted].tolist(), strict=True):
            if keys[a] != key:
                if held:
                    yield key, np.concatenate(parts), True
                key, parts, held = keys[a], [], 0
            while held + b - a > BLOCK:
                parts.append(rows[a : a + BLOCK - held])
                a += BLOCK - held
                yield key, np.concatenate(parts), False
                parts, held = [], 0
            parts.append(rows[a:b])
            held += b - a
    if held:
        yield key, np.concatenate(parts), True


_LINKS = "u binary, v binary, key long, block int"

#: Edges that a task gathers before it hands them on.
EDGES = 1 << 16


def least_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What edges between rows of bytes join, as one edge from each row to the least that they reach."""
    width = u.shape[1]
    rows = np.ascontiguousarray(np.concatenate([u, v])).view(np.dtype((np.void, width)))[:, 0]
    nodes, ids = np.unique(rows, return_inverse=True)
    parent = _hook(np.arange(len(nodes)), ids[: len(u)], ids[len(u) :])
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    whole = nodes.view(np.uint8).reshape(-1, width)
    return whole[child], whole[parent[child]]


def _table(u, v, keys, blocks) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [binary_column(u), binary_column(v), pa.array(keys, pa.int64()), pa.array(blocks, pa.int32())], names=["u", "v", "key", "block"]
    )


def _gathered(found: Iterator[tuple | pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task as ``least_forest`` gives them, EDGES or so at a time; tables go through."""

    def joined(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        return least_forest(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def told(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return _table(u, v, np.full(len(u), -1), np.full(len(u), -1))

    held, edges = [], 0
    for item in found:
        if isinstance(item, pa.RecordBatch):
            yield item
        elif len(item[0]):
            held.append(item)
            edges += len(item[0])
            if edges > EDGES:
                held = [joined(held)]
                edges = len(held[0][0])
                if edges > EDGES // 2:
                    yield told(*held[0])
                    held, edges = [], 0
    if held:
        yield told(*joined(held))


def met_in_lists(posted: DataFrame, width: int, forest: Callable) -> DataFrame:
    """Edges ``u, v`` that ``forest`` finds among the members of each posting list.

    ``posted`` has ``key`` (long) and ``member`` (binary of ``width`` bytes).
    ``forest(left, right)`` takes members as rows of bytes and gives the ends of
    edges within left, if right is None, or else between left and right. Many
    lists hold much the same members of a large group. So what the lists of a
    task join is given as edges to the least member, mostly the same for all of
    them, and not as other edges from each list.

    A posting list longer than BLOCK isn't gathered: its members go on as
    blocks, and a second pass compares every two of these blocks in a task of
    their own. So memory is bounded and no member is left out.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple | pa.RecordBatch]:
        """Links of whole lists; blocks of long lists, with their number."""
        block = 0
        for key, rows, last in _groups(batches, width):
            if last and not block:
                if len(rows) > 1:
                    yield forest(rows, None)
                continue
            yield _table(rows, rows, np.full(len(rows), key), np.full(len(rows), block))
            block = 0 if last else block + 1

    def meet_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Links between two blocks; rows are sorted by pair of blocks, then block."""
        for _, group in _pairs(batches, width):
            yield forest(group[0], group[1])

    met = written(posted.repartition("key").sortWithinPartitions("key").mapInArrow(lambda x: _gathered(meet(x)), _LINKS), "postings")
    found = met.where("block < 0").select("u", "v")
    long_lists = met.where("block >= 0").select("key", "block", F.col("u").alias("member"))
    if long_lists.isEmpty():
        return found.distinct()
    last = long_lists.groupBy("key").agg(F.max("block").alias("last"))
    met_again = (
        long_lists.join(last, "key")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .select("key", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "member")
    )
    again = met_again.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "side").mapInArrow(lambda x: _gathered(meet_blocks(x)), _LINKS)
    return found.union(again.select("u", "v")).distinct()


def links(prints: DataFrame, bits: int, max_bits: int, cover: int, min_match: int, groups: int = 4) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints of at most ``max_bits`` differing bits.

    ``prints`` has one row per distinct ``fingerprint``. The edges join exactly
    what the links join; of links that others imply, some are left out. A pair
    that shares ``cover`` positional bytes meets in the index for certain, so
    with ``cover = bits / 8 - max_bits`` no link is lost.
    """
    width, keys = bits // 8, index_keys(bits // 8, cover, groups)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                rows = byte_matrix(batch.column(0).slice(at, 2048), width)
                for n, positions in enumerate(keys):
                    key = np.full(len(rows), n, np.int64)
                    for p in positions:
                        key = key << 8 | rows[:, p]
                    yield pa.RecordBatch.from_arrays([pa.array(key), binary_column(rows)], names=["key", "member"])

    posted = prints.select("fingerprint").mapInArrow(post, "key long, member binary")
    return met_in_lists(posted, width, lambda left, right: _forest(left, right, min_match, max_bits))


def _pairs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list]]:
    """The two blocks of each pair of blocks; one block met with itself has no second."""
    at, sides = None, [[], []]
    for batch in batches:
        key, a, b, side = (batch.column(n).to_numpy() for n in range(4))
        rows = byte_matrix(batch.column(4), width)
        change = (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (side[1:] != side[:-1])
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(key)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if x == y:
                continue
            if (key[x], a[x], b[x]) != at:
                if at:
                    yield at, [np.concatenate(s) if s else None for s in sides]
                at, sides = (key[x], a[x], b[x]), [[], []]
            sides[side[x]].append(rows[x:y])
    if at:
        yield at, [np.concatenate(s) if s else None for s in sides]


def simhash_groups(docs: DataFrame, shingle: int = 3, bits: int = 64, max_bits: int = 2, cover: int | None = None, min_match: int | None = None, groups: int = 4) -> DataFrame:
    """Fingerprint and near-duplicate component of every document.

    Returns ``doc_id, fingerprint, component_id``: the fingerprint in lowercase
    hex, the component the smallest ``doc_id`` that links reach. Texts are
    lower-cased (A-Z), split at ASCII white space and cut into shingles of
    ``shingle`` words. Fingerprints link at ``max_bits`` or fewer differing bits.

    ``cover`` is the number of shared positional bytes at which a pair surely
    meets in the index, ``min_match`` the tally it has to reach; both default to
    what ``max_bits`` guarantees. Past ``max_bits >= bits / 8`` nothing is
    guaranteed and they have to be given. ``groups`` is the number of equal
    groups of positions from which index_keys takes its keys.

    Null and empty texts, and texts of white space, have the zero fingerprint
    and link like any other. A text with fewer words than a shingle is one
    shingle. Rows with the same text share one index entry. A repeated doc_id
    counts as so many rows; a null doc_id never names a component, and a
    component of null ids only is null. Further columns of ``docs`` are ignored;
    an empty table gives an empty result.
    """
    guaranteed = bits // 8 - max_bits
    if cover is None and guaranteed < 1:
        raise ValueError("this many differing bits guarantee no shared byte: give cover and min_match")
    cover = cover or guaranteed
    min_match = min_match or cover
    marked = written(fingerprints(docs, shingle, bits), "fingerprints")
    distinct = written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct")
    nodes = components(links(distinct, bits, max_bits, cover, min_match, groups))
    members = written(distinct.join(nodes, distinct.fingerprint == nodes.node).select("fingerprint", "root", "least"), "members")
    named = members.groupBy("root").agg(F.min("least").alias("component_id"))
    # A component may have a large part of all fingerprints.
    joined = spread_join(members, named, ["root"]).select("fingerprint", "component_id")
    component = distinct.join(joined, "fingerprint", "left").select(
        "fingerprint", F.coalesce("component_id", "least").alias("component_id")
    )
    # Many texts may share a fingerprint: copies, and all texts without words.
    return spread_join(marked, component, ["fingerprint"]).select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")
