"""Ledger jobs: balances, snapshots, points, gas, swaps, factory pairs.

Amounts and their products with seconds are DECIMAL(38,0): exact up to 38 digits,
an error beyond, never rounded. Transfers are rows ``id, from_addr, to_addr,
value, block_number`` and ``ts`` or ``block_timestamp``; values may be text, so what
transfers_job gives can be used as it is. The null address, which takes part in
very many transfers, is left out before any window. Accounts with very many
rows are cut into ranges of like depth (operators/ordered.py).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.abi import decode_event, decode_swap_call
from ledgerloom.functions.columns import gas_value, path_join, points_of, snapshot_id, trace_id, unit_seconds
from ledgerloom.operators.filters import block_between, by_selector, coalesce_default, exclude_zero_address, min_path, project_blocks, project_transfers, valid_gas
from ledgerloom.operators.joins import account_ticks, factory_temporal_join, trace_tx_join
from ledgerloom.operators.ordered import DEPTH, ordered_scan
from ledgerloom.operators.windows import gaps, number_bitmaps, signed_sides
from ledgerloom.schemas import SWAP_SELECTOR, WINDOW_END, WINDOW_SECONDS, ZERO_ADDRESS
from ledgerloom.session import written


def transfers_job(logs: DataFrame, lo: int, hi: int) -> DataFrame:
    """Transfers of a block range from raw logs."""
    return project_transfers(decode_event(block_between(logs, lo, hi), "Transfer"))


def sides_of_accounts(transfers: DataFrame) -> DataFrame:
    return exclude_zero_address(signed_sides(transfers)).withColumns({c: F.col(c).cast("decimal(38,0)") for c in ("delta", "mint")})


def balance_history(transfers: DataFrame) -> DataFrame:
    """``id, account, delta, balance, block_number, ts``: the balance after every change."""
    running = ordered_scan(sides_of_accounts(transfers), "account", ["ts", "block_number", "id"], sums={"balance": "delta"})
    running = running.withColumn("balance", F.col("balance").cast("decimal(38,0)"))
    return running.select("id", "account", "delta", "balance", "block_number", "ts")


def current_balances(transfers: DataFrame) -> DataFrame:
    """Balance, last block and last time of every account: a sum, no window."""
    return sides_of_accounts(transfers).groupBy("account").agg(
        F.sum("delta").cast("decimal(38,0)").alias("balance"), F.max("block_number").alias("last_block"), F.max("ts").alias("last_ts")
    )


def collapse_same_ts(transfers: DataFrame) -> DataFrame:
    """One row per account and time: net change and amount minted."""
    return sides_of_accounts(transfers).groupBy("account", "ts").agg(
        F.sum("delta").cast("decimal(38,0)").alias("delta"), F.sum("mint").cast("decimal(38,0)").alias("mint"), F.max("block_number").alias("block_number")
    )


def _snapshots(changes: DataFrame, order: str = "ts", sized: DataFrame | None = None) -> DataFrame:
    """Running balance, mint and unit-seconds from rows ``account, ts, delta, mint, trigger``.

    Unit-seconds up to a time are the sum of delta * (that time - the delta's
    own), so they follow from two running sums; the last row's are taken off.
    """
    zero = F.lit(0).cast("decimal(38,0)")
    timed = changes.withColumn("_moved", unit_seconds(F.col("delta"), F.col("ts")))
    running = ordered_scan(timed, "account", [order], {"balance": "delta", "mint_amount": "mint", "_moved_sum": "_moved"}, {"old_ts": "ts"}, sized=sized)
    running = running.withColumns({c: F.col(c).cast("decimal(38,0)") for c in ("balance", "mint_amount", "_moved_sum")})
    old = running.withColumn("old_balance", F.when(F.col("old_ts").isNotNull(), (F.col("balance") - F.col("delta")).cast("decimal(38,0)")))
    # The balance before, from the first change to this time, less what was moved until then.
    held = (unit_seconds(F.col("balance"), F.col("ts")) - F.col("_moved_sum")).cast("decimal(38,0)")
    return old.withColumn("unit_seconds", F.coalesce(held, zero)).withColumn("points", points_of(F.col("unit_seconds"))).drop("_moved", "_moved_sum")


def account_snapshots(transfers: DataFrame) -> DataFrame:
    """Per account and time: balance, cumulative mint, points so far; the first has none."""
    changes = collapse_same_ts(transfers).withColumn("trigger", F.lit("transfer"))
    return _snapshots(changes, sized=sides_of_accounts(transfers)).select(snapshot_id(F.col("account"), F.col("ts").cast("string")).alias("id"), "account", "ts", "balance", "mint_amount", "unit_seconds", "points")


def point_updates(transfers: DataFrame) -> DataFrame:
    """Change log: old and new time and balance, and the unit-seconds that were added."""
    changes = _snapshots(collapse_same_ts(transfers).withColumn("trigger", F.lit("transfer")), sized=sides_of_accounts(transfers))
    added = F.coalesce(unit_seconds(F.col("old_balance"), F.col("ts") - F.col("old_ts")), F.lit(0).cast("decimal(38,0)"))
    return changes.select(
        "account", F.coalesce("old_ts", F.lit(0).cast("long")).alias("old_ts"), F.coalesce("old_balance", F.lit(0).cast("decimal(38,0)")).alias("old_balance"),
        F.col("ts").alias("new_ts"), F.col("balance").alias("new_balance"), added.cast("decimal(38,0)").alias("added"), "trigger",
    )


def snapshots_with_ticks(transfers: DataFrame, every: int, until: int) -> DataFrame:
    """Snapshots at transfers and at every multiple of ``every`` seconds until ``until``.

    A tick carries the balance on; one at the time of a transfer is that snapshot.
    """
    changes = collapse_same_ts(transfers).select("account", "ts", "delta", "mint", F.lit(0).alias("tick"))
    seen = changes.groupBy("account").agg(F.min("ts").alias("first_ts"))
    zero = F.lit(0).cast("decimal(38,0)")
    ticks = account_ticks(seen, every, until).select("account", "ts", zero.alias("delta"), zero.alias("mint"), F.lit(1).alias("tick"))
    merged = changes.union(ticks).groupBy("account", "ts").agg(
        F.sum("delta").cast("decimal(38,0)").alias("delta"), F.sum("mint").cast("decimal(38,0)").alias("mint"), F.min("tick").alias("tick")
    )
    named = merged.withColumn("trigger", F.when(F.col("tick") == 1, "tick").otherwise("transfer"))
    return _snapshots(named).select("account", "ts", "balance", "mint_amount", "unit_seconds", "trigger")


def snapshots_at_blocks(transfers: DataFrame, blocks: DataFrame, every: int, until: int, backfill: int | None = None, live_from: int | None = None) -> DataFrame:
    """Snapshots at transfers and, after an account's first one, at every ``every``-th block until ``until``.

    Before the block ``live_from`` it is every ``backfill``-th one. ``blocks``
    (``number, timestamp``) is the calendar: a block that it lacks has no tick. A
    block with a transfer of the account is that snapshot. Rows of one account and
    block are one, at the later of their times.

    Only changes are shuffled. A tick has the balance and the sums of the change
    before it, so ticks are generated after the scan, each change's own up to the next one.
    The calendar's ticks are written, so that Spark knows their size.
    """
    sides = sides_of_accounts(transfers)
    steps = [(every, None, until)] if live_from is None else [(backfill or every, None, min(live_from - 1, until)), (every, live_from, until)]
    number = F.col("number")
    on_step = reduce(lambda x, y: x | y, [(number % step == 0) & (number <= hi) & (F.lit(True) if lo is None else number >= lo) for step, lo, hi in steps])
    calendar = written(blocks.where(on_step).groupBy(number.cast("long").alias("_number")).agg(F.max("timestamp").alias("_at"), F.lit(True).alias("_there")), "calendar")
    total = lambda c: F.sum(c).cast("decimal(38,0)").alias(c)
    changes = sides.groupBy("account", "block_number").agg(F.max("ts").alias("ts"), total("delta"), total("mint"))
    # A change in a tick's block is at the later of the two times, but an account's first one, which has no tick, at its own.
    zero = F.lit(0).cast("decimal(38,0)")
    moved = lambda at: F.coalesce(unit_seconds(F.col("delta"), at), zero)
    # An account has a row for each block at most.
    span = transfers.agg(F.max("block_number") - F.min("block_number") + 2).first()[0] or 0
    if span <= DEPTH:
        # No account is cut, so changes are shuffled for the scan here, before they widen.
        changes = changes.repartition("account")
    timed = changes.join(calendar, F.col("block_number") == F.col("_number"), "left").withColumn("_later", F.greatest("ts", "_at")).drop("_number", "_at", "_there")
    timed = timed.withColumns({"_moved": moved(F.col("_later")), "_more": F.when(F.col("block_number").isNotNull(), (moved(F.col("_later")) - moved(F.col("ts"))).cast("decimal(38,0)"))})
    running = ordered_scan(
        timed, "account", ["block_number"], {"balance": "delta", "mint_amount": "mint", "_sum": "_moved"}, {"_old": "block_number"},
        sized=sides, after={"_next": "block_number"}, first={"_too_much": "_more"}, most=span,
    )
    block, following = F.col("block_number"), F.coalesce(F.col("_next") - 1, F.lit(until))
    numbers = [F.array(block)]
    for step, lo, hi in steps:
        past = block if lo is None else F.greatest(block, F.lit(lo - 1))
        start, stop = (past - F.pmod(past, F.lit(step)) + step).cast("long"), F.least(following, F.lit(hi)).cast("long")
        numbers.append(F.when(start <= stop, F.sequence(start, stop, F.lit(step).cast("long"))).otherwise(F.array().cast("array<long>")))
    opened = running.select(
        "account", F.when(F.col("_old").isNull(), F.col("ts")).otherwise(F.col("_later")).alias("_ts"), F.col("balance").cast("decimal(38,0)").alias("balance"), F.col("mint_amount").cast("decimal(38,0)").alias("mint_amount"),
        (F.col("_sum") - F.coalesce("_too_much", zero)).cast("decimal(38,0)").alias("_sum"), F.posexplode(F.concat(*numbers)).alias("_place", "block_number"),
    )
    own = F.col("_place") == 0
    found = opened.join(calendar, F.col("block_number") == F.col("_number"), "left").where(own | F.col("_there")).withColumn("ts", F.when(own, F.col("_ts")).otherwise(F.col("_at")))
    held = (unit_seconds(F.col("balance"), F.col("ts")) - F.col("_sum")).cast("decimal(38,0)")
    return found.select("account", "block_number", "ts", "balance", "mint_amount", F.coalesce(held, zero).alias("unit_seconds"), F.when(own, "transfer").otherwise("tick").alias("trigger"))


def points_closed_form(transfers: DataFrame, starts: DataFrame | None = None, t_end: int = WINDOW_END, window: int = WINDOW_SECONDS) -> DataFrame:
    """``account, moved, held``: summation by parts, without a window.

    ``moved`` is the sum of signed amounts times seconds to the end, ``held`` the
    balance at the start (``account, balance``) times the window's length.
    """
    sides = sides_of_accounts(transfers)
    moved = sides.select("account", unit_seconds(F.col("delta"), F.lit(t_end) - F.col("ts")).alias("moved"), F.lit(0).cast("decimal(38,0)").alias("held"))
    if starts is not None:
        held = starts.select("account", F.lit(0).cast("decimal(38,0)").alias("moved"), unit_seconds(F.col("balance"), F.lit(window)).alias("held"))
        moved = moved.union(held)
    return points_window_sum(moved)


def points_window_sum(contributions: DataFrame) -> DataFrame:
    """Per account the sum of contributions and the greatest start contribution."""
    return contributions.groupBy("account").agg(F.sum("moved").cast("decimal(38,0)").alias("moved"), F.max("held").alias("held"))


def blocks_job(blocks: DataFrame, lo: int, hi: int) -> DataFrame:
    return project_blocks(block_between(blocks, lo, hi, "number"))


def gas_job(transactions: DataFrame) -> DataFrame:
    """Gas spent per transaction, an exact product; without a recipient the null address."""
    return valid_gas(transactions).select(
        F.col("hash").alias("id"),
        F.col("from_address").alias("sender"),
        coalesce_default(F.col("to_address"), ZERO_ADDRESS).alias("recipient"),
        gas_value(F.col("gas_used"), F.col("effective_gas_price"), F.col("gas_price")).alias("gas_value"),
        F.col("gas_used").cast("string").alias("gas_used"),
        "block_number",
    )


def router_swaps_job(traces: DataFrame, transactions: DataFrame) -> DataFrame:
    """Decoded router calls with the transaction's sender; paths of two tokens or more."""
    calls = traces.where("trace_type = 'call'")
    decoded = min_path(decode_swap_call(by_selector(calls, SWAP_SELECTOR)))
    return trace_tx_join(decoded, transactions).select(
        trace_id(F.col("transaction_hash"), F.col("trace_address")).alias("id"), "block_number", "transaction_hash",
        F.col("sender").alias("from_addr"), F.col("from_address").alias("caller"), F.col("to").alias("to_addr"),
        "amount_in", "amount_out_min", "deadline", path_join(F.col("path")).alias("path"), F.size("path").alias("path_length"),
    )


def pairs_job(logs: DataFrame, factory: str | None = None) -> DataFrame:
    """Created pairs from factory logs."""
    made = decode_event(logs if factory is None else logs.where(F.col("address") == factory), "PairCreated")
    p = F.col("decoded.event_params")
    return made.select(
        F.element_at(p, 3).alias("pair"), F.element_at(p, 1).alias("token0"), F.element_at(p, 2).alias("token1"), F.col("address").alias("factory"),
        F.col("block_number").alias("created_at"), F.col("log_index").alias("created_log_index"),
    )


def pair_swaps_job(logs: DataFrame, factory: str | None = None) -> DataFrame:
    """Swap logs of created pairs, from their creation on, with four amounts."""
    pairs = pairs_job(logs, factory)
    swaps = decode_event(logs, "Swap")
    p = F.col("decoded.event_params")
    names = ["sender", "amount0_in", "amount1_in", "amount0_out", "amount1_out", "to_addr"]
    return factory_temporal_join(swaps, pairs).select("id", F.col("address").alias("pair"), *[F.element_at(p, k + 1).alias(n) for k, n in enumerate(names)], "block_number", "log_index")


def fill_missing_blocks(blocks: DataFrame, lo: int, hi: int, min_percent: float = 50, first_ts: int = 1438269988, spacing: int = 15) -> DataFrame:
    """Blocks with ``is_generated``; placeholders for missing ones if too few came.

    Placeholders have a hash made from their number and times ``spacing`` seconds
    apart. They are always marked.
    """
    spark = blocks.sparkSession
    inside = block_between(blocks, lo, hi, "number").select("number", "hash", "parent_hash", "timestamp").withColumn("is_generated", F.lit(False))
    if number_bitmaps(inside, "number").agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))).first()[0] * 100 >= min_percent * (hi - lo + 1):
        return inside
    h = lambda n: F.concat(F.lit("0x"), F.sha2(n.cast("string"), 256))
    # The gaps between a number before the range and one after it; long ones in pieces.
    ends = spark.createDataFrame([(lo - 1,), (hi + 1,)], "number long")
    holes = gaps(inside.select("number").union(ends), "number")
    pieces = holes.withColumn("piece", F.explode(F.sequence("start", "stop", F.lit(65536).cast("long"))))
    wanted = pieces.select(F.explode(F.sequence("piece", F.least(F.col("piece") + 65535, F.col("stop")))).alias("number"))
    made = wanted.select("number", h(F.col("number")).alias("hash"), h(F.col("number") - 1).alias("parent_hash"), (F.col("number") * spacing + first_ts).cast("long").alias("timestamp"), F.lit(True).alias("is_generated"))
    return inside.union(made)
