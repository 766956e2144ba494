"""Near copies: SimHash candidates, verified by the exact similarity of their shingles.

The similarity of two texts is the Jaccard coefficient of their sets of word
shingles. Texts with the same set are one node. A node's SimHash fingerprint of
BITS bits is read as positional bytes, and nodes meet in the posting lists of an
index keyed by two of these: all pairs of positions within GROUPS groups of three.
Two sets of any size that are similar by 0.8 differ in about 15 % of the bits and
share about 32 of 120 bytes; any 41 would meet for certain, and by chance all but 4
in 10,000 pairs do (2 in 100 of four shingles against five, 2 in 10,000 at 0.815). Of
a list's pairs those are left out that can't be similar by the sizes of their sets,
or hardly can: they differ in more than MAX_BITS of the first 128 bits (at 0.8 the
mean is about 20, the standard deviation 4, or 5 for texts of a few shingles), or
share fewer than EQUAL of the next HASHES half bytes (at 0.8 the mean is 33, the
standard deviation 4).

What these candidates join is a cluster. No link leaves it, and each of its
nodes goes there once, with its shingles as 64-bit hashes: nodes that are not
yet joined are compared exactly. A cluster of more than SHINGLES shingles is
dealt into blocks by a hash of its nodes, and every two blocks are one unit of
work; so no cluster is gathered, and no pair that may be similar is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.arrow import byte_matrix, text_bytes, word_chunks
from ledgerloom.llm.graph import components
from ledgerloom.llm.simhash import index_keys, met_in_lists
from ledgerloom.operators.joins import spread_join
from ledgerloom.llm.places import fresh
from ledgerloom.session import written

#: Bits of a fingerprint, and groups of three positional bytes in it.
BITS, GROUPS = 960, 40
#: Differing bits, of the first 128, beyond which a pair isn't verified.
MAX_BITS = 44
#: Half bytes that are tallied after them, and how many have to be the same.
HASHES, EQUAL = 64, 14
#: Shingles of a cluster that make one block.
SHINGLES = 1 << 19

#: The positions of each of the index's keys.
_KEYS = np.array(index_keys(BITS // 8, GROUPS + 1, GROUPS))
_LANES = np.arange(BITS // 64, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
#: Of each byte how many of its two halves are zero.
_ZEROS = np.array([(n < 16) + (n % 16 == 0) for n in range(256)], np.uint8)


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle."""
    digest, found, carry, any_ = xxhash.xxh64_intdigest, [], [], False
    for words in word_chunks(text.lower()):
        carry += words
        if len(carry) < shingle:
            continue
        joined = b" ".join(carry)
        ends = np.cumsum(np.fromiter(map(len, carry), np.int64, len(carry)) + 1) - 1
        starts = [0, *(ends[: len(carry) - shingle] + 1).tolist()]
        hashes = {digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)}
        found.append(np.fromiter(hashes, np.uint64, len(hashes)))
        carry, any_ = carry[len(carry) - shingle + 1 :], True
    if not any_ and carry:
        found.append(np.array([digest(b" ".join(carry), 42)], np.uint64))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def node_of(hashes: np.ndarray) -> bytes:
    """16 bytes for a set of shingles."""
    return xxhash.xxh3_128_digest(hashes.tobytes(), 7)


def sketch(hashes: np.ndarray) -> bytes:
    """The SimHash of a set of shingles: BITS bits, 64 of each remix of their hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte counts
        x = hashes[at : at + 255, None] ^ _LANES
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        ones += np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def list_keys(prints: np.ndarray) -> np.ndarray:
    """The keys of each fingerprint, given as a row of bytes: number and values of two positions."""
    two = prints[:, _KEYS].astype(np.int64)
    return np.arange(len(_KEYS)) << 16 | two[:, :, 0] << 8 | two[:, :, 1]


#: Bytes of a node, of what else is compared before shingles are, and of both.
NODE, WIDTH = 16, 16 + 8 + 16 + HASHES // 2


def _marked(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, mark, node, n, member, print`` of every row; no fingerprint without words.

    ``member`` is node, size, and what is compared of the fingerprint, WIDTH bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, members, prints = [], [], [], []
            for text in text_bytes(batch.column(2)):
                hashes = shingle_set(text, shingle)
                bits = sketch(hashes)
                nodes.append(node_of(hashes))
                sizes.append(len(hashes))
                members.append(nodes[-1] + np.int64(len(hashes)).tobytes() + bits[: WIDTH - NODE - 8])
                prints.append(bits if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(members, pa.binary()), pa.array(prints, pa.binary())],
                names=["doc_id", "mark", "node", "n", "member", "print"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, f"doc_id {kind}, mark long, node binary, n long, member binary, print binary")


def _post(nodes: DataFrame) -> DataFrame:
    """``key, member``: each node once for every key of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                keys = list_keys(byte_matrix(part.column(1), BITS // 8))
                again = pa.array(np.repeat(np.arange(part.num_rows), len(_KEYS)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column(0).take(again)], names=["key", "member"])

    return nodes.where("print is not null").select("member", "print").mapInArrow(run, "key long, member binary")


def joined(rows: int, split: int | None, similar: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Of each row the least row that links reach.

    ``similar(x, others)`` gives those of the rows ``others`` that x links to.
    Linked are any two rows, or those before ``split`` with the others. Rows
    that are joined already are not compared.
    """
    label = np.arange(rows)
    for x in range(rows if split is None else split):
        low = x + 1 if split is None else split
        others = low + np.flatnonzero(label[low:] != label[x])
        if len(others):
            found = similar(x, others)
            if len(found):
                same = np.union1d(label[found], label[x : x + 1])
                label[np.isin(label, same)] = same[0]
    return label


def candidates(similarity: float, max_bits: int) -> Callable:
    """A forest of the pairs of members that may be similar."""

    def forest(left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        rows = left if right is None else np.concatenate([left, right])
        size = np.ascontiguousarray(rows[:, NODE : NODE + 8]).view(np.int64)[:, 0]
        bits, sig = np.ascontiguousarray(rows[:, NODE + 8 : NODE + 24]).view(np.uint64), rows[:, NODE + 24 :]
        if right is None and len(rows) <= 256:  # most lists have no pair at all
            differing = np.bitwise_count(bits[:, None] ^ bits).sum(axis=2, dtype=np.uint8)
            if np.count_nonzero(differing <= max_bits) == len(rows):
                return rows[:0], rows[:0]

        def similar(x: int, others: np.ndarray) -> np.ndarray:
            others = others[np.minimum(size[others], size[x]) >= similarity * np.maximum(size[others], size[x])]
            others = others[np.bitwise_count(bits[others] ^ bits[x]).sum(axis=1, dtype=np.int64) <= max_bits]
            return others[_ZEROS[sig[others] ^ sig[x]].sum(axis=1, dtype=np.int64) >= EQUAL]

        label = joined(len(rows), None if right is None else len(left), similar)
        child = np.flatnonzero(label != np.arange(len(rows)))
        return rows[child], rows[label[child]]

    return forest


def similar_sets(sets: list[np.ndarray], split: int | None, similarity: float) -> np.ndarray:
    """``joined`` by the exact Jaccard coefficient of sets, none of which is empty."""
    numbers, ids = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    starts, marked = ends - size, np.zeros(len(numbers), np.int32)

    def similar(x: int, others: np.ndarray) -> np.ndarray:
        others = others[np.minimum(size[others], size[x]) >= similarity * np.maximum(size[others], size[x])]
        mine = ids[starts[x] : ends[x]]
        marked[mine] = 1
        if len(others) * 8 < len(sets):
            common = np.array([marked[ids[starts[y] : ends[y]]].sum() for y in others], np.int64)
        else:
            common = np.add.reduceat(marked[ids], starts)[others]
        marked[mine] = 0
        return others[common >= similarity * (size[x] + size[others] - common)]

    return joined(len(sets), split, similar)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list[bytes], list[np.ndarray], int | None]]:
    """``whole, nodes, sets, split`` of each pair of blocks; split is None for a block with itself."""
    at, whole, nodes, sets, split = None, True, [], [], None
    for batch in batches:
        root, a, b, side, blocks, node = (batch.column(n).to_pylist() for n in range(6))
        for k, key in enumerate(zip(root, a, b, strict=True)):
            if key != at:
                if nodes:
                    yield whole, nodes, sets, split
                at, whole, nodes, sets, split = key, blocks[k] == 1, [], [], None
            if side[k] and split is None:
                split = len(nodes)
            nodes.append(node[k])
            sets.append(batch.column(6)[k].values.to_numpy().copy())
    if nodes:
        yield whole, nodes, sets, split


def _verified(similarity: float):
    """Edges ``u, v`` from a node to the least one that links reach; whole if all its cluster was there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, nodes, sets, split in _units(batches):
            label = similar_sets(sets, split, similarity)
            child = np.flatnonzero(label != np.arange(len(nodes)))
            u, v = [nodes[k] for k in child], [nodes[k] for k in label[child]]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array([whole] * len(u), pa.bool_())], names=["u", "v", "whole"])

    return run


def _sets(docs: DataFrame, marks: DataFrame, shingle: int) -> DataFrame:
    """``node, shingles`` of the texts with these marks, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, nodes, sets = batch.slice(at, 256), [], []
                for mark, text in zip(part.column(0).to_pylist(), text_bytes(part.column(1)), strict=True):
                    if (mark, len(text)) not in seen:
                        seen.add((mark, len(text)))
                        sets.append(shingle_set(text, shingle))
                        nodes.append(node_of(sets[-1]))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    texts = docs.select(F.xxhash64("text").alias("mark"), "text").join(marks, "mark", "left_semi").select("mark", "text")
    return texts.mapInArrow(run, "node binary, shingles array<long>").dropDuplicates(["node"])


def groups_of(nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float, max_bits: int) -> DataFrame:
    """``node, root`` of the nodes with links: root is the same for all that links join."""
    pairs = met_in_lists(_post(nodes), WIDTH, candidates(similarity, max_bits))
    clusters = components(pairs.select(F.substring("u", 1, NODE).alias("u"), F.substring("v", 1, NODE).alias("v")))
    members = written(clusters.join(nodes.select("node", "mark", "n"), "node"), "clusters")
    sizes = members.groupBy("root").agg(F.ceil(F.sum("n") / SHINGLES).cast("int").alias("blocks"))
    dealt = spread_join(members, sizes, ["root"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(_sets(docs, members.select("mark"), shingle), "node")
    side = F.when(F.col("block") <= F.col("other"), 0).otherwise(1)
    units = units.select("root", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), side.alias("side"), "blocks", "node", "shingles")
    units = units.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b", "side")
    edges = written(units.mapInArrow(_verified(similarity), "u binary, v binary, whole boolean"), "joined")
    whole = edges.where("whole")
    roots = whole.select(F.col("u").alias("node"), F.col("v").alias("root")).union(whole.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    return roots.union(components(edges.where("not whole").select("u", "v")))


def keep_one_near(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the least doc_id, then text's hash.

    Texts are lower-cased (A-Z), split at ASCII white space and cut into
    shingles of ``shingle`` words; a shorter text is one shingle. Texts whose
    sets of shingles are similar by ``similarity`` or more are linked, and a
    group is what links reach. Null, empty and white texts are one group. Rows
    that repeat a kept row's doc_id and text are one. Rows of null ids stay.
    Other columns may have any name; an empty table gives an empty result.
    """
    marked = written(_marked(docs, shingle), "marked")
    nodes = written(marked.groupBy("node").agg(F.min("mark").alias("mark"), F.min("n").alias("n"), F.min("member").alias("member"), F.min("print").alias("print")), "nodes")
    roots = groups_of(nodes, docs, shingle, similarity, max_bits)
    rows = spread_join(marked.where("doc_id is not null").select("doc_id", "mark", "node"), roots, ["node"], "left")
    groups = rows.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("doc_id", "mark")).alias("least"))
    mark = fresh("mark", docs)
    kept = groups.select("least.doc_id", F.col("least.mark").alias(mark))
    named = docs.withColumn(mark, F.xxhash64("text")).join(kept, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    return named.select(docs.columns).union(docs.where("doc_id is null"))
