"""Joins. No side is forced into a broadcast: Spark decides by its size threshold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ordered import DEPTH, ordered_scan

#: A key with more than this part of a side's rows counts as hot.
HOT_SHARE = 1024


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", total: int | None = None) -> DataFrame:
    """``left.join(right, keys, how)`` where a key may hold a large part of ``left``.

    ``right`` has one row or few per key; ``how`` is inner, left, left_semi or
    left_anti. Rows are counted by key first. Keys with more than 1/HOT_SHARE of
    all rows, so fewer than HOT_SHARE of them, are broadcast; their rows on the
    left are dealt over parts by a hash of the other columns, and their rows on
    the right go to each part. All other keys have one part. ``total`` is the
    number of rows on the left, if it is known. Rows that are equal in all
    columns stay in one part.
    """
    total = left.count() if total is None else total
    limit = max(1, total // HOT_SHARE)
    taken = {c.lower() for c in (*left.columns, *right.columns)}
    mark = next(m for m in ("_spread" + "_" * k for k in range(len(taken) + 1)) if not any(c.startswith(m) for c in taken))
    parts, part, hot_key = f"{mark}parts", f"{mark}part", {k: f"{mark}key{i}" for i, k in enumerate(keys)}
    counts = left.groupBy(*keys).agg(F.count("*").alias(parts)).where(F.col(parts) > limit)
    hot = F.broadcast(counts.select(*[F.col(k).alias(h) for k, h in hot_key.items()], F.ceil(F.col(parts) / limit).cast("int").alias(parts)))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(h)) for k, h in hot_key.items()])
    rest = [F.col(f"`{c}`") for c in left.columns if c not in keys] or [F.lit(0)]
    drop = [*hot_key.values(), parts]
    dealt = left.join(hot, same, "left").withColumn(part, F.coalesce(F.pmod(F.xxhash64(*rest), F.col(parts)), F.lit(0)).cast("int")).drop(*drop)
    copied = right.join(hot, same, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(*drop)
    return dealt.join(copied, [*keys, part], how).drop(part)


def factory_semi_join(events: DataFrame, registry: DataFrame, key: str = "address") -> DataFrame:
    """Events whose emitter is in the registry of created contracts."""
    return events.join(registry.select(F.col("pair").alias(key)).distinct(), key, "left_semi")


def factory_temporal_join(events: DataFrame, registry: DataFrame) -> DataFrame:
    """The same, but only from the creation's position (block, log index) on.

    A contract created more than once counts from its first creation.
    """
    created = registry.groupBy("pair").agg(F.min(F.struct("created_at", "created_log_index")).alias("created"))
    after = F.struct(F.col("block_number").alias("created_at"), F.col("log_index").alias("created_log_index")) >= F.col("created")
    return events.join(created, (F.col("address") == F.col("pair")) & after, "left_semi")


def attach_parent(events: DataFrame, parents: DataFrame, key: str = "pair") -> DataFrame:
    """Each event with its parent's columns; events without one are dropped."""
    return events.join(parents, key)


def tx_receipt_join(transactions: DataFrame, receipts: DataFrame) -> DataFrame:
    """Transactions with receipts; those without are dropped."""
    return transactions.join(receipts, "hash")


def trace_tx_join(traces: DataFrame, transactions: DataFrame) -> DataFrame:
    """Traces with the sender of their transaction, else their own caller, else empty."""
    sender = transactions.select(F.col("hash").alias("transaction_hash"), F.col("from_address").alias("tx_from"))
    joined = traces.join(sender, "transaction_hash", "left")
    return joined.withColumn("sender", F.coalesce("tx_from", "from_address", F.lit(""))).drop("tx_from")


def log_tx_block_join(logs: DataFrame, transactions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Logs with their block: by the transaction's block hash, else the log's; others are dropped."""
    by_tx = transactions.select(F.col("hash").alias("transaction_hash"), F.col("block_hash").alias("tx_block_hash"))
    resolved = logs.join(by_tx, "transaction_hash", "left").withColumn("of_block", F.coalesce("tx_block_hash", "block_hash"))
    known = blocks.select(F.col("hash").alias("of_block"), F.col("number").alias("block_number"), F.col("timestamp").alias("block_timestamp"))
    return resolved.join(known, "of_block").drop("tx_block_hash", "of_block")


def balance_asof(wanted: DataFrame, history: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``account, block_number, balance``: the last balance at or before each wanted block.

    ``history`` has ``account, block_number, balance`` and at most one row per
    account and block. Both are laid in one sequence per account, so there is
    one shuffle and no range join; accounts with more than ``depth`` rows are
    cut into ranges. Accounts without history have balance 0.
    """
    both = wanted.select("account", "block_number", F.lit(None).cast(history.schema["balance"].dataType).alias("balance"), F.lit(1).alias("asked"))
    both = both.unionByName(history.select("account", "block_number", "balance", F.lit(0).alias("asked")))
    found = ordered_scan(both, "account", ["block_number", "asked"], known={"found": "balance"}, depth=depth).where("asked = 1")
    return found.select("account", "block_number", call_failure_default(found.found).alias("balance"))


def balance_at_window_start(history: DataFrame, block: int) -> DataFrame:
    """Per account the balance at a block; accounts that start later are absent."""
    return history.where(F.col("block_number") <= block).groupBy("account").agg(F.max_by("balance", "block_number").alias("balance"))


def call_failure_default(balance):
    """A look-up that fails yields 0, not an error."""
    return F.coalesce(balance, F.lit(0).cast("decimal(38,0)"))


def latest_by_max_join(df: DataFrame, key: str, order: str) -> DataFrame:
    """All rows that have the greatest ``order`` of their key; ties stay."""
    most = df.groupBy(F.col(key).alias("_of")).agg(F.max(order).alias("_most"))
    return df.join(most, (F.col(key) == F.col("_of")) & (F.col(order) == F.col("_most")), "left_semi")


def left_join_latest(accounts: DataFrame, updates: DataFrame, key: str, order: list[str], value: str, default: object = 0) -> DataFrame:
    """Accounts with the value of their latest update, ``default`` where there is none."""
    latest = updates.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))
    return accounts.join(latest, key, "left").withColumn(value, F.coalesce(value, F.lit(default).cast(latest.schema[value].dataType)))


def accounts_with_latest(accounts: DataFrame, snapshots: DataFrame, key: str = "account", order: str = "ts") -> DataFrame:
    """Accounts with their latest snapshot's columns, null where there is none."""
    latest = snapshots.groupBy(key).agg(F.max_by(F.struct(*[c for c in snapshots.columns if c != key]), order).alias("_latest"))
    return accounts.join(latest, key, "left").select(*accounts.columns, "_latest.*")


def nested_children(parents: DataFrame, children: DataFrame, key: str, order: list, n: int = 1) -> DataFrame:
    """For each parent its first ``n`` children in an order; parents without any stay."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = children.withColumn("child_no", place).where(F.col("child_no") <= n)
    return parents.join(first, key, "left")


def pairwise_full(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of both sides as ``key, a, b``: a struct of each side's row, null where absent."""
    left, right = (d.select(F.col(key), F.struct(*d.columns).alias(n)) for d, n in ((a, "a"), (b, "b")))
    return left.join(right, key, "full_outer")


def missing_from(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a`` whose key isn't in ``b``."""
    return a.join(b.select(key).distinct(), key, "left_anti")


def account_ticks(first_seen: DataFrame, every: int, until: int) -> DataFrame:
    """``account, ts``: each account at each multiple of ``every`` after it was first seen.

    Ticks are generated per account, so nothing is broadcast or range-joined.
    """
    start = (F.floor(F.col("first_ts") / every) + 1) * every
    ticks = F.when(start <= until, F.sequence(start.cast("long"), F.lit(until).cast("long"), F.lit(every).cast("long"))).otherwise(F.array().cast("array<long>"))
    return first_seen.select("account", F.explode(ticks).alias("ts"))
