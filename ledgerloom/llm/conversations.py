"""Repair of conversation structure by the cheapest edits.

A conversation's rows and a position in the grammar ``(s?(ua)+)?`` of role
initials span a lattice: node ``(i, state)`` has consumed ``i`` rows. Edges are
Keep, Rerole, Delete and Insert. A search from the start and one from the end
meet; all crossings of least cost are compared by their audits.

Rows are cut into blocks, so that a conversation of any size is never in one
task: a block's searches give cost and audit for each pair of entry and exit
states, and a pass over the blocks picks the pairs.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.places import group_key, with_places
from ledgerloom.session import written

#: White space of the contract: a space and U+0009 to U+000D.
WHITE = " \t\n\x0b\f\r"
#: What edits cost; TRUNCATED is added for a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a block.
BLOCK = 4096

# States: nothing yet, after s, after u, after a. A conversation may end in ENDS.
START, ENDS = 0, (0, 3)
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that an insert or a change of role gives in each state, and the state after it.
_GIVES = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
_GIVEN = {target: [q for q, (_, to) in _GIVES.items() if to == target] for target in (2, 3)}


def _leaving(symbols: str, trailing: bool, i: int, q: int) -> Iterator[tuple[int, str, tuple[int, int]]]:
    """``cost, initial, node`` of the edges from a node."""
    if i < len(symbols) or trailing:
        yield INSERT, "I", (i, _GIVES[q][1])
    if i < len(symbols):
        yield DELETE, "D", (i + 1, q)
        symbol = symbols[i]
        if symbol != "-":
            more = TRUNCATED * symbol.isupper()
            yield REROLE + more, "R", (i + 1, _GIVES[q][1])
            if (q, symbol.lower()) in _NEXT:
                yield more, "K", (i + 1, _NEXT[q, symbol.lower()])


def _entering(symbols: str, trailing: bool, i: int, q: int) -> Iterator[tuple[int, str, tuple[int, int]]]:
    """``cost, initial, node`` of the edges to a node."""
    if i < len(symbols) or trailing:
        for before in _GIVEN.get(q, ()):
            yield INSERT, "I", (i, before)
    if i > 0:
        yield DELETE, "D", (i - 1, q)
        symbol = symbols[i - 1]
        if symbol != "-":
            more = TRUNCATED * symbol.isupper()
            for before in _GIVEN.get(q, ()):
                yield REROLE + more, "R", (i - 1, before)
            for before in range(4):
                if _NEXT.get((before, symbol.lower())) == q:
                    yield more, "K", (i - 1, before)


@lru_cache(1 << 16)
def cheapest(symbols: str, start: int = START, ends: tuple[int, ...] = ENDS, trailing: bool = True) -> tuple[int, str] | None:
    """Least cost and, of the edits that cost it, the ASCII-least audit; None if there are none.

    ``symbols`` has a character per row: ``s u a`` by role initial, ``x`` for
    others, in upper case for truncated rows, and ``-`` for rows that must go.
    ``trailing`` allows inserts after the last row.

    Heaps are in order of cost; among equal cost, edges without cost lead from a
    row to the next one, so forwards the earlier row is first, backwards the
    later one. So a node's label, cost and least audit, is final when the node
    leaves its heap. (Of two audits to one node none is the start of the other,
    as that would be a cycle of inserts, so the least one stays least with
    whatever follows.) The search ends when no path can cross any more at the
    least cost found.
    """
    n = len(symbols)
    labels = ({(0, start): (0, "")}, {(n, q): (0, "") for q in ends})
    heaps = ([(0, 0, start)], [(0, -n, q) for q in ends])
    settled: tuple[set, set] = (set(), set())
    heapq.heapify(heaps[1])
    best = 0 if (0, start) in labels[1] else None
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = 0 if heaps[0][0] <= heaps[1][0] else 1
        cost, i, q = heapq.heappop(heaps[side])
        node = (-i if side else i, q)
        if node in settled[side]:
            continue
        settled[side].add(node)
        mine, others, audit = labels[side], labels[1 - side], labels[side][node][1]
        for more, edit, to in (_entering if side else _leaving)(symbols, trailing, *node):
            label = (cost + more, edit + audit if side else audit + edit)
            if to not in settled[side] and (to not in mine or label < mine[to]):
                if to not in mine or label[0] < mine[to][0]:
                    heapq.heappush(heaps[side], (label[0], -to[0] if side else to[0], to[1]))
                mine[to] = label
                if to in others and (best is None or label[0] + others[to][0] < best):
                    best = label[0] + others[to][0]
    if best is None:
        return None
    crossings = (labels[0][v][1] + labels[1][v][1] for v in labels[0].keys() & labels[1].keys() if labels[0][v][0] + labels[1][v][0] == best)
    return best, min(crossings)


def _facts(rows: DataFrame) -> DataFrame:
    """Rows in their places, with what of a fault can be told from the row alone."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rest = F.rtrim(text, F.lit(WHITE))
    facts = rows.select(
        group_key(F.col("conv_id")).alias("key"),
        "conv_id",
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.sha2(text, 256).alias("mark"),
        (rest == "").alias("blank"),
        (~F.right(rest, F.lit(1)).isin(".", "!", "?")).alias("open"),
        F.monotonically_increasing_id().alias("salt"),
    )
    order = [F.col("turn").asc_nulls_first(), F.substring("role", 1, 64), F.substring("text", 1, 64), F.col("mark"), F.col("role"), F.col("salt")]
    return with_places(written(facts, "facts"), "key", order, "turns").drop("salt")


def _pairs_of_block(block: int, last: bool) -> list[tuple[int, tuple[int, ...]]]:
    """Entry states and exit states of a block; the ends of a conversation are one exit."""
    starts = [START] if block == 0 else range(4)
    return [(q, ends) for q in starts for ends in ([ENDS] if last else [(x,) for x in range(4)])]


_WAYS = "key string, block long, start int, stop int, cost long, rank int, audit string"


def _searches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost and audit of every way through each block, and the rank of the audit among them."""
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            key, block, last = row["key"], row["block"], row["last"]
            ways = [(q, ends, cheapest(row["symbols"], q, ends, last)) for q, ends in _pairs_of_block(block, last)]
            ways = [(q, ends[-1], way) for q, ends, way in ways if way is not None]
            rank = {audit: k for k, audit in enumerate(sorted({way[1] for _, _, way in ways}))}
            found += [(key, block, q, stop, cost, rank[audit], audit) for q, stop, (cost, audit) in ways]
        columns = list(zip(*found, strict=True)) if found else [()] * 7
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "block", "start", "stop", "cost", "rank", "audit"])


def _through(ways: pd.DataFrame) -> pd.DataFrame:
    """Of one conversation's blocks, the ways of the cheapest path, ties by audits.

    From the last block backwards. Of two ways from one state through a block no
    audit is the start of the other: they end with a row, not with an insert.
    """
    last = int(ways["block"].max())
    by_block: dict[int, list] = {}
    for way in ways.itertuples(index=False):
        by_block.setdefault(way.block, []).append(way)
    ahead, picks = {None: 0}, []
    for block in range(last, -1, -1):
        best: dict[int, tuple] = {}
        for way in by_block[block]:
            stop = None if block == last else way.stop
            if stop in ahead:
                best[way.start] = min(best.get(way.start, (float("inf"),)), (way.cost + ahead[stop], way.rank, stop))
        ahead = {q: b[0] for q, b in best.items()}
        picks.append(best)
    state, chosen = START, []
    for block, best in enumerate(reversed(picks)):
        chosen.append((ways["key"].iloc[0], block, state, best[state][1]))
        state = best[state][2]
    return pd.DataFrame(chosen, columns=["key", "block", "start", "rank"])


class Repair(NamedTuple):
    """``audits``: a row per conversation; ``rows``: the repaired conversations."""

    audits: DataFrame
    rows: DataFrame


def repair(rows: DataFrame, block: int = BLOCK) -> Repair:
    """Faults and the cheapest repair of conversations (``conv_id, turn, role, text``).

    ``audits``: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit`` of each conversation. ``rows``: ``conv_id, place, step, turn, edit,
    role, text`` of what stays (K, R) or is inserted (I), in order of ``place``,
    then ``step``; an inserted row has the place of the row that it stands
    before, and no turn.

    Null roles and texts are one space. Rows stand by turn, nulls first; those of
    one turn by role, then text (64 characters of each, then the text's SHA-256).
    A null ``conv_id`` is a conversation. A row with an empty role has no initial
    and can't be kept as it is. Rows that are repeated are duplicates. Further
    columns are ignored, and an empty table gives empty results. A conversation
    of many rows is searched in blocks of ``block`` rows, with the same result;
    only its audit, a character for each edit, is put together in one row.
    """
    placed = _facts(rows)
    at = F.floor(F.col("place") / block)
    seen = placed.groupBy("key", "role", "mark").agg(F.min("place").alias("place")).select("key", "place", F.lit(True).alias("first"))
    narrow = placed.select("key", "conv_id", "place", "of", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "open").join(seen, ["key", "place"], "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated").otherwise("")
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    symbol = F.when(fault.isin("blank", "duplicate"), "-").when(fault == "truncated", F.upper(known)).otherwise(known)
    told = written(narrow.select("key", "conv_id", "place", "of", "turn", "initial", fault.alias("fault"), symbol.alias("symbol")), "faults")

    ordered = F.array_sort(F.collect_list(F.struct("place", "symbol", "initial")))
    blocks = told.groupBy("key", at.alias("block")).agg(ordered.alias("rows"), F.max("of").alias("of"))
    legal = F.array(F.lit("su"), F.lit("ua"), F.lit("au"))
    initials = F.transform("rows", lambda r: r.initial)
    pairs = F.zip_with(initials, F.slice(initials, 2, block), lambda a, b: F.when(b.isNotNull() & ~F.array_contains(legal, F.concat(a, b)), 1).otherwise(0))
    blocks = blocks.select(
        "key",
        "block",
        (F.col("of") <= (F.col("block") + 1) * block).alias("last"),
        F.array_join(F.transform("rows", lambda r: r.symbol), "").alias("symbols"),
        F.aggregate(pairs, F.lit(0), lambda a, x: a + x).alias("illegal"),
        F.element_at(initials, 1).alias("head"),
        F.element_at(initials, -1).alias("tail"),
    )
    blocks = written(blocks, "blocks")

    ways = written(blocks.select("key", "block", "last", "symbols").mapInArrow(_searches, _WAYS), "ways")
    long = blocks.where("block > 0").select("key").distinct()
    of_long = ways.join(long, "key", "left_semi")
    picked = of_long.select("key", "block", "start", "stop", "cost", "rank").groupBy("key").applyInPandas(_through, "key string, block long, start int, rank int")
    # Ways of one start and one audit are one way: the audit tells the exit.
    chosen = ways.join(long, "key", "left_anti").unionByName(of_long.join(picked, ["key", "block", "start", "rank"], "left_semi"))
    chosen = written(chosen.select("key", "block", "start", "cost", "audit"), "chosen")

    facts = told.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    before = F.lag("tail").over(Window.partitionBy("key").orderBy("block"))
    bordered = blocks.withColumn("border", F.when(before.isNotNull() & ~F.array_contains(legal, F.concat(before, "head")), 1).otherwise(0))
    illegal = bordered.groupBy("key").agg(F.sum(F.col("illegal") + F.col("border")).cast("long").alias("illegal"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda b: b.audit), "")
    edits = chosen.groupBy("key").agg(F.sum("cost").cast("long").alias("cost"), whole.alias("audit"))
    audits = facts.join(illegal, "key").join(edits, "key").drop("key")

    # One shuffle of the texts: a block's audit goes before its rows.
    lines = placed.select("key", at.alias("block"), F.lit(1).alias("kind"), "place", "conv_id", "turn", "role", "text")
    heads = chosen.select("key", "block", F.lit(0).alias("kind"), (F.col("block") * block).alias("place"), "start", "audit")
    stream = lines.unionByName(heads, allowMissingColumns=True).repartition("key", "block").sortWithinPartitions("key", "block", "kind", "place")
    conv, turn = placed.schema["conv_id"].dataType.simpleString(), placed.schema["turn"].dataType.simpleString()
    repaired = stream.drop("key", "block", "kind").mapInArrow(_apply, f"conv_id {conv}, place long, step int, turn {turn}, edit string, role string, text string")
    return Repair(audits, repaired)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block by the audit that stands before them."""
    audit, at, state, conv_id, after = "", 0, START, None, 0
    names = ["conv_id", "place", "step", "turn", "edit", "role", "text"]
    for batch in chain(batches, [None]):
        out: list[tuple] = []
        rows = batch.to_pylist() if batch is not None else [None]
        for row in rows:
            place = row["place"] if row and row["audit"] is None else after
            step = 0
            while at < len(audit) and audit[at] == "I":
                role, state = _GIVES[state]
                out.append((conv_id if place == after and (not row or row["audit"] is not None) else row["conv_id"], place, step, None, "I", role, ""))
                at, step = at + 1, step + 1
            if row is None:
                break
            if row["audit"] is not None:
                audit, at, state = row["audit"], 0, row["start"]
                continue
            conv_id, after, edit, role = row["conv_id"], place + 1, audit[at], row["role"]
            at += 1
            if edit == "R":
                role, state = _GIVES[state]
            elif edit == "K":
                state = _NEXT[state, role[:1]]
            if edit != "D":
                out.append((conv_id, place, step, row["turn"], edit, role, row["text"]))
        if batch is not None:
            kinds = (batch.schema.field("conv_id").type, pa.int64(), pa.int32(), batch.schema.field("turn").type, pa.string(), pa.string(), pa.string())
        elif not out:
            return
        columns = list(zip(*out, strict=True)) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def conversation_digests(rows: DataFrame) -> DataFrame:
    """``conv_id, sha256`` of each conversation's ``role:text`` lines, in order of place and step.

    A digest takes its bytes one after another, so a conversation is hashed in
    one task; its rows are sorted by Spark and stream by, none is kept.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = digest = conv_id = None
        for batch in chain(batches, [None]):
            done = []
            for row in batch.to_pylist() if batch is not None else [None]:
                if digest is not None and (row is None or row["key"] != key):
                    done.append((conv_id, digest.hexdigest()))
                    digest = None
                if row is None:
                    break
                line = f"{row['role']}:{row['text']}".encode()
                if digest is None:
                    key, conv_id, digest = row["key"], row["conv_id"], hashlib.sha256(line)
                else:
                    digest.update(b"\n" + line)
            if batch is not None:
                kind = batch.schema.field("conv_id").type
            elif not done:
                return
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "sha256"])

    keyed = rows.select(group_key(F.col("conv_id")).alias("key"), "conv_id", "place", "step", "role", "text")
    return keyed.repartition("key").sortWithinPartitions("key", "place", "step").mapInArrow(hashed, f"conv_id {conv}, sha256 string")
