"""Vector search: an inverted multi-index, and exact top-k by norm and residual bounds.

Both searches deal the vectors in blocks and the queries in slices of bounded
size, and work through one block and one slice in a task. What comes back is a
short list per query and block. Each row of the table is a vector, and a query
if it is one, by itself, also where ids are repeated. Vectors of different
lengths have no inner product, so each length is searched by itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.arrow import binary_column, float_matrix
from ledgerloom.session import written

#: Vectors on which centroids and rotations are fitted, those with the smallest hash of their id.
SAMPLE = 8192
#: Vectors of a block, queries of a slice, and queries that a task takes at a time.
BLOCK, SLICE, BATCH = 4096, 4096, 512
#: Pairs that a task scores one by one at a time.
PAIRS = 1 << 16


def usable(vector: Column) -> Column:
    """Not null or empty, and every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def usable_vectors(vectors: DataFrame, component: Callable[[Column], Column], queries: Column, nonzero: bool) -> DataFrame:
    """``uid, id, vec, asked`` of the rows that take part, written to the shared folder.

    Rows without an id take no part. ``component`` turns each component, as a
    double, into what is searched; with ``nonzero`` a vector needs a component
    other than zero. ``asked`` says whether ``queries`` holds.
    """
    kept = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    made = kept.select(
        F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: component(x.cast("double"))).alias("vec"), F.coalesce(queries, F.lit(False)).alias("asked")
    )
    return written(made.where(F.exists("vec", lambda x: x != 0)) if nonzero else made, "vectors")


def _each_length(base: DataFrame, search: Callable[[DataFrame, int, int], DataFrame], schema: str) -> DataFrame:
    """The union of ``search(vectors, rows, queries)`` over the lengths of vectors, few of them."""
    sizes = base.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("rows"), F.count_if("asked").alias("queries")).where("queries > 0").orderBy("n").collect()
    out = base.sparkSession.createDataFrame([], schema)
    for r in sizes:
        out = out.union(search(base.where(F.size("vec") == r.n), r.rows, r.queries))
    return out


def bounded_sample(vectors: DataFrame, rows: int, n: int = SAMPLE) -> np.ndarray:
    """About ``n`` vectors as a matrix, chosen by a hash of their ids, in order of ids; read in parallel."""
    chosen = F.pmod(F.xxhash64("id", "uid"), F.lit(1 << 30)) < int(min(1.0, n / max(rows, 1)) * (1 << 30))
    found = sorted(vectors.where(chosen).select("id", "vec").collect())
    if not found:
        found = vectors.orderBy(F.xxhash64("id", "uid"), "id").limit(1).select("id", "vec").collect()
    return np.array([r.vec for r in found], np.float64)


def search_blocks(entries: DataFrame, asked: DataFrame, build: Callable, search: Callable, score: str) -> DataFrame:
    """``uid, query_id, vec_ids, scores`` for each query and block.

    ``entries`` has ``block, slice, place, uid, id, vec, extra``: the vectors of a
    block, once for every slice of queries that needs it, to be held by
    ``place``. ``asked`` has the queries of these, with a ``bound`` each. A task holds
    one block, built once by ``build(ids, vectors, extras)``, and calls
    ``search(built, ids, vectors, extras, bounds)`` for BATCH queries at a time.
    """
    kinds = {"long": pa.int64(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, built = None, [], None
        for batch in batches:
            block, part, kind = (batch.column(n).to_numpy() for n in range(3))
            cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if (block[a], part[a]) != at:
                    at, parts, built = (block[a], part[a]), [], None
                for start in range(a, b, BATCH):
                    rows = batch.slice(start, min(BATCH, b - start))
                    ids, vec, extra = rows.column(5).to_numpy(), float_matrix(rows.column(6)), rows.column(7).to_pylist()
                    if kind[a] == 0:
                        parts.append((ids, vec, extra))
                        continue
                    if built is None and parts:
                        built = build(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [x for p in parts for x in p[2]])
                        parts = []
                    if built is not None:
                        q, found, scores = search(built, ids, vec, extra, rows.column(8).to_numpy())
                        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(q, minlength=len(ids)))]), pa.int32())
                        lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((found, pa.int64()), (scores, kinds[score]))]
                        yield pa.RecordBatch.from_arrays([rows.column(4), rows.column(5), *lists], names=["uid", "query_id", "vec_ids", "scores"])

    columns = ["block", "slice", "kind", "place", "uid", "id", "vec", "extra", "bound"]
    held = entries.withColumns({"kind": F.lit(0), "bound": F.lit(0.0)}).select(columns)
    both = held.union(asked.withColumns({"kind": F.lit(1), "place": F.lit(0.0)}).select(columns))
    dealt = both.repartition("block", "slice").sortWithinPartitions("block", "slice", "kind", "place", "uid")
    return dealt.mapInArrow(run, f"uid long, query_id long, vec_ids array<long>, scores array<{score}>")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of each query's short lists, ties to smaller ids."""
    rows = found.select("uid", "query_id", F.explode(F.arrays_zip("vec_ids", "scores")).alias("hit"))
    rows = rows.select("uid", "query_id", F.col("hit.vec_ids").alias("vec_id"), F.col("hit.scores").alias("score"))
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sliced(asked: DataFrame, queries: int) -> tuple[DataFrame, int]:
    """Queries with a ``slice``, about SLICE queries each, and how many slices there are."""
    n = -(-queries // SLICE)
    return asked.withColumn("slice", F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")), n


def _for_slices(entries: DataFrame, n: int) -> DataFrame:
    return entries.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _first_of_each(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to smaller ids, ordered by query."""
    order = np.lexsort((ids, -scores, q))
    q = q[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = order[place < k]
    return q[place < k], ids[keep], scores[keep]


def _scored(q: np.ndarray, e: np.ndarray, queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Inner products of pairs, each summed in the same order wherever it stands."""
    parts = [(queries[q[a : a + PAIRS]] * entries[e[a : a + PAIRS]]).sum(axis=1) for a in range(0, len(q), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, np.result_type(queries, entries))


# -- inverted multi-index -----------------------------------------------------


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 15, seed: int = 42) -> np.ndarray:
    """k-means in numpy; no more centroids than distinct rows."""
    distinct = np.unique(sample, axis=0)
    centroids = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(rounds):
        nearest = _nearest(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        counts = np.bincount(nearest, minlength=len(centroids))[:, None]
        centroids = np.where(counts > 0, sums / np.maximum(counts, 1), centroids)
    return centroids


def _nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1) - 2 * rows @ centroids.T, axis=1)


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Cells by falling first[i] + second[j] from a heap, until they hold enough entries."""
    one, two = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    a, b = first[one].tolist(), second[two].tolist()
    heap, seen, cells, held = [(-a[0] - b[0], 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        if counts[one[i], two[j]]:
            cells.append((one[i], two[j]))
            held += counts[one[i], two[j]]
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-a[x] - b[y], x, y))
    return cells


def multi_index_search(vectors: DataFrame, queries: Column, k: int = 20, centroids: int = 64, probe: float = 0.55, least: int | None = None) -> DataFrame:
    """Approximate nearest neighbours by largest inner product.

    Returns ``query_id, rank, vec_id, score``: for each row of ``vectors``
    (``vec_id, embedding``) for which ``queries`` holds, the ``k`` nearest found
    of all rows but those with its own id, nearest first, ties to smaller ids.

    The halves of the vectors are quantised separately, to ``centroids`` each,
    fitted on a bounded sample (SAMPLE vectors); every vector is in the index
    under its pair of centroids. A query goes through the pairs by the sum of
    its inner products with the two centroids, from a heap, until they hold the
    share ``probe`` of all vectors, ``least`` (k and its own) of them at least; these
    are scored exactly, in double precision, and no others are multiplied. Cells
    are packed into blocks, and a cell of more than BLOCK vectors is split over
    several, so no task holds more.

    Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do rows without an id. Rows that repeat an id are vectors, and
    queries with ranks of their own, each. Vectors meet those of their own
    length. Further columns are ignored. No vectors: no rows.
    """
    base = usable_vectors(vectors, lambda x: x, queries, nonzero=True)
    how = lambda some, rows, asked: _multi_index(some, rows, asked, k, centroids, probe, k + 1 if least is None else least)
    return _each_length(base, how, "query_id long, rank int, vec_id long, score double")


def _multi_index(base: DataFrame, rows: int, queries: int, k: int, centroids: int, probe: float, least: int) -> DataFrame:
    sample = bounded_sample(base, rows)
    half = max(1, sample.shape[1] // 2)
    tables = fit_centroids(sample[:, :half], centroids), fit_centroids(sample[:, half:], centroids)
    width = len(tables[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = float_matrix(batch.column(2))
            cell = _nearest(vec[:, :half], tables[0]) * width + _nearest(vec[:, half:], tables[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["uid", "id", "vec", "cell"])

    indexed = written(base.select("uid", "id", "vec").mapInArrow(place, "uid long, id long, vec array<double>, cell int"), "index")
    counts = np.zeros((len(tables[0]), width), np.int64)
    for r in indexed.groupBy("cell").count().collect():
        counts[divmod(r.cell, width)] = r["count"]
    flat = counts.ravel()
    parts = np.maximum(1, -(-flat // BLOCK))
    start, block, room = np.zeros(len(flat), np.int64), 0, BLOCK
    for cell in np.flatnonzero(flat):
        if parts[cell] > 1 or flat[cell] > room:
            block, room = block + (room < BLOCK), BLOCK
        start[cell] = block
        room -= flat[cell]
        if parts[cell] > 1:
            block, room = block + parts[cell], BLOCK
    enough = max(least, int(probe * rows))
    blocks_of = [np.arange(s, s + p) for s, p in zip(start, parts, strict=True)]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for each block that it visits, with its cells as bits."""
        for batch in batches:
            vec = float_matrix(batch.column(2))
            one, two = vec[:, :half] @ tables[0].T, vec[:, half:] @ tables[1].T
            for n in range(len(vec)):
                cells = [i * width + j for i, j in traverse(one[n], two[n], counts, enough)]
                mask = np.zeros(len(flat), np.uint8)
                mask[cells] = 1
                visited = np.unique(np.concatenate([blocks_of[c] for c in cells]))
                row = [c.take(pa.array([n] * len(visited))) for c in (*batch.columns[:3], batch.column(3))]
                masks = binary_column(np.broadcast_to(np.packbits(mask), (len(visited), -(-len(flat) // 8))))
                yield pa.RecordBatch.from_arrays([pa.array(visited, pa.int32()), *row, masks], names=["block", "uid", "id", "vec", "slice", "extra"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each entry with its block; the entries of a split cell go by a hash of their place."""
        for batch in batches:
            uid, cell = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            mixed = (uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            to = start[cell] + (mixed % parts[cell].astype(np.uint64)).astype(np.int64)
            extra = binary_column(cell.astype(">i4").view(np.uint8).reshape(-1, 4))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(cell, pa.float64()), *batch.columns[:3], extra], names=["block", "place", "uid", "id", "vec", "extra"])

    asked, n_slices = sliced(base.where("asked").select("uid", "id", "vec"), queries)
    # Few bytes a query, but much work: dealt evenly over all cores.
    asked = asked.repartition("uid").mapInArrow(ask, "block int, uid long, id long, vec array<double>, slice int, extra binary").withColumn("bound", F.lit(0.0))
    entries = _for_slices(indexed.mapInArrow(deal, "block int, place double, uid long, id long, vec array<double>, extra binary"), n_slices)

    def build(ids: np.ndarray, vec: np.ndarray, extra: list) -> tuple:
        """Entries come by cell: where each cell of the block begins and ends."""
        cells = np.array([int.from_bytes(x, "big") for x in extra])
        firsts = np.flatnonzero(np.diff(cells, prepend=-1))
        return ids, vec, cells[firsts], np.append(firsts, len(cells)), np.sqrt((vec**2).sum(axis=1).max())

    def search(built: tuple, ids: np.ndarray, vec: np.ndarray, extra: list, _: np.ndarray) -> tuple:
        entry_ids, entries, cells, ends, longest = built
        visited = np.unpackbits(np.frombuffer(b"".join(extra), np.uint8).reshape(len(ids), -1), axis=1)[:, cells].astype(bool)
        scores = np.full((len(ids), len(entry_ids)), -np.inf)
        for n, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            some = np.flatnonzero(visited[:, n])
            scores[some, a:b] = vec[some] @ entries[a:b].T
        scores[entry_ids[None, :] == ids[:, None]] = -np.inf
        worst = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(ids), -np.inf)
        # Products of a matrix may be off by a rounding error that depends on the place.
        slack = 1e-12 * np.sqrt((vec**2).sum(axis=1)) * longest
        q, e = np.nonzero((scores >= (worst - slack)[:, None]) & (scores > -np.inf))
        return _first_of_each(q, entry_ids[e], _scored(q, e, vec, entries), k)

    return ranked(search_blocks(entries, asked, build, search, "double"), k)


# -- exact search ---------------------------------------------------------------


def fit_rotation(sample: np.ndarray) -> np.ndarray:
    """Right singular vectors, strongest first: an orthogonal matrix."""
    return np.linalg.svd(sample.T @ sample)[0]


def exact_top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, head: int = 16, step: int = 1024) -> DataFrame:
    """Exact largest inner products of integer vectors ``floor(scale * x)``.

    Returns ``query_id, rank, vec_id, score``: for each row of ``vectors``
    (``vec_id, embedding``) for which ``queries`` holds, the ``k`` highest scores
    of all rows but those with its own id, ties to smaller ids.

    Vectors are dealt in blocks by falling length. The longest block gives each
    query a first k-th best score. Queries are then dealt in slices by the
    length that a vector needs to beat it, and a slice goes only to blocks whose
    longest vector has it. In a block, vectors come by falling length, ``step``
    at a time: those that cannot reach the query's k-th best by their length are
    skipped, and of the others those whose first ``head`` components, rotated by
    the singular vectors of a bounded sample, and the lengths of the remainders
    can't (Cauchy-Schwarz). What is left is multiplied out in 64-bit integers.
    Bounds are floating-point and loosened by more than their rounding error,
    so the result is exact.

    Vectors that are null or hold null or non-finite components take no part,
    nor do rows without an id. Rows that repeat an id are vectors, and queries
    with ranks of their own, each. Vectors meet those of their own length.
    Further columns are ignored. No vectors: no rows. Components have to fit in
    a long, and so do scores; a score that doesn't is an error.
    """
    base = usable_vectors(vectors, lambda x: F.floor(x * scale).cast("double"), queries, nonzero=False)
    how = lambda some, rows, asked: _exact(some, rows, asked, k, head, step)
    return _each_length(base, how, "query_id long, rank int, vec_id long, score long")


def _exact(base: DataFrame, rows: int, queries: int, k: int, head: int, step: int) -> DataFrame:
    rotation = fit_rotation(bounded_sample(base, rows))
    measured = base.withColumn("length", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)))
    ordered = measured.repartitionByRange(-(-rows // BLOCK), F.desc("length"), "uid")
    blocked = written(ordered.withColumn("block", F.spark_partition_id()), "blocks")

    def build(ids: np.ndarray, vec: np.ndarray, _: list) -> tuple:
        turned = vec @ rotation
        rest = np.sqrt((turned[:, head:] ** 2).sum(axis=1))
        return ids, vec.astype(np.int64), vec, np.sqrt((vec**2).sum(axis=1)), turned[:, :head], rest

    def search(built: tuple, ids: np.ndarray, vec: np.ndarray, _: list, bound: np.ndarray) -> tuple:
        entry_ids, entries, doubles, lengths, heads, rests = built
        whole, turned, length = vec.astype(np.int64), vec @ rotation, np.sqrt((vec**2).sum(axis=1))
        rest = np.sqrt((turned[:, head:] ** 2).sum(axis=1))
        best, q, found, scores = bound.astype(np.float64).copy(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a in range(0, len(entry_ids), step):
            slack = 1 + 1e-9 * length * lengths[a]
            open_ = np.flatnonzero(length * lengths[a] + slack >= best)
            if not len(open_):
                break  # all that follow are shorter
            b = slice(a, a + step)
            most = turned[open_, :head] @ heads[b].T + rest[open_, None] * rests[None, b]
            i, e = np.nonzero((most + slack[open_, None] >= best[open_, None]) & (entry_ids[None, b] != ids[open_, None]))
            i, e = open_[i], e + a
            if length.max() * lengths[a] >= 2.0**62 and (np.abs(_scored(i, e, vec, doubles)) >= 2.0**63).any():
                raise ValueError("a score does not fit in a long")
            q, found = np.concatenate([q, i]), np.concatenate([found, entry_ids[e]])
            # Sums of products are right modulo 2^64, whatever the parts are.
            scores = np.concatenate([scores, _scored(i, e, whole, entries)])
            q, found, scores = _first_of_each(q, found, scores, k)
            full = np.flatnonzero(np.bincount(q, minlength=len(ids)) >= k)
            best[full] = np.maximum(best[full], scores[np.searchsorted(q, full, side="right") - 1])
        return q, found, scores

    blocks = blocked.groupBy("block").agg(F.max("length").alias("most"))
    none = F.lit(None).cast("binary").alias("extra")
    entries = blocked.select("block", (-F.col("length")).alias("place"), "uid", "id", "vec", none)
    asked, n_slices = sliced(blocked.where("asked").select("uid", "id", "vec", "length", none), queries)
    longest = blocks.agg(F.max_by("block", F.struct("most", -F.col("block")))).first()[0]
    first = search_blocks(
        _for_slices(entries.where(F.col("block") == longest), n_slices), asked.select(F.lit(longest).alias("block"), "slice", "uid", "id", "vec", "extra", F.lit(float("-inf")).alias("bound")), build, search, "long"
    )
    first = written(first, "head")
    kth = first.select("uid", F.when(F.size("scores") >= k, F.array_min("scores").cast("double")).otherwise(float("-inf")).alias("bound"))
    # The least length of a vector that may still reach the k-th best.
    known = F.coalesce("bound", F.lit(float("-inf")))
    need = F.when(F.col("length") > 0, (known - F.abs(known) * 1e-9 - 1) / F.col("length")).when(known > 1, float("inf")).otherwise(float("-inf"))
    bounded = asked.drop("slice").join(kth, "uid", "left").withColumn("bound", known).withColumn("need", need)
    ordered = bounded.repartitionByRange(n_slices, "need", "uid").withColumn("slice", F.spark_partition_id()) if n_slices > 1 else bounded.withColumn("slice", F.lit(0))
    by_need = written(ordered, "asked")
    # One row per slice and one per block: the pairs of them that have to meet.
    slices = by_need.groupBy("slice").agg(F.min("need").alias("need"))
    pairs = blocks.where(F.col("block") != longest).join(slices, F.col("most") * (1 + 1e-9) >= F.col("need")).select("block", "slice")
    second = search_blocks(
        entries.join(pairs, "block").select("block", "slice", "place", "uid", "id", "vec", "extra"), by_need.join(pairs, "slice").select("block", "slice", "uid", "id", "vec", "extra", "bound"), build, search, "long"
    )
    return ranked(first.union(second), k)
