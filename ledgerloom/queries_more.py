"""Further registered queries: scans, sinks, columns, exact amounts, streams, handlers; each with its SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions import columns as C
from ledgerloom.functions import u256
from ledgerloom.functions.abi import decode_log, decode_swap_call, route_events
from ledgerloom.operators import aggregates as A
from ledgerloom.operators import filters as P
from ledgerloom.operators import joins as J
from ledgerloom.operators import windows as W
from ledgerloom.plans import ledger as L
from ledgerloom.plans import pipeline as X
from ledgerloom.plans import reconcile as N
from ledgerloom.plans import renditions as R
from ledgerloom.queries import ORACLE_SQL, QUERIES, _B, _C, _E, _F, _S, _T, _X, _Z, _platforms, _raw, _raw_path, query
from ledgerloom.session import new_path, written
from ledgerloom.sources import readers, sinks
from ledgerloom.streaming import jobs

__all__ = ["ORACLE_SQL", "QUERIES"]

_TOPIC = schemas.EVENTS["Transfer"][0]
_CALLS = "select id, transaction_hash, caller as from_address, block_number"
_LOGS = "id, from_addr, to_addr, cast(value as varchar) as value, block_number"
#: Amounts as tokens of 18 decimals have them: a cent is 10^16 units, and a mint like one of 10 tokens is 10^19.
_W = _T.replace("transfers as (", "small as (", 1) + ", transfers as (select id, from_addr, to_addr, cast(value as hugeint) * 10000000000000000 as value, block_number, ts from small)"
_WS = (
    _W
    + f""", sides as (
  select id || '_f' as id, from_addr as account, -value as delta, cast(0 as hugeint) as mint, block_number, ts from transfers
  union all
  select id || '_t', to_addr, value, case when from_addr = {_Z} then value else 0 end, block_number, ts from transfers),
accounts as (select * from sides where account <> {_Z})"""
)
_WG = (
    _WS
    + """, grouped as (select account, ts, sum(delta) as delta, sum(mint) as mint, max(block_number) as block_number from accounts group by 1, 2),
running as (select *, sum(delta) over w as balance, sum(mint) over w as mint_amount, lag(ts) over (partition by account order by ts) as old_ts from grouped
            window w as (partition by account order by ts rows unbounded preceding)),
previous as (select *, lag(balance) over (partition by account order by ts) as old_balance from running),
snaps as (select *, sum(coalesce(cast(old_balance as hugeint) * (ts - old_ts), 0)) over (partition by account order by ts rows unbounded preceding) as unit_seconds from previous)"""
)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


# -- case 2: raw logs to balances and points, amounts of 18 decimals -------------------


def _token_logs(spark, d) -> DataFrame:
    """The transfers as raw logs whose amounts have 18 decimals."""
    return _raw("token_logs", R.token_logs, spark, d)


def _token_transfers(spark, d) -> DataFrame:
    """Decoded once a session and stored, as the jobs go through them several times."""
    return _raw("token_transfers", lambda spark, d: L.transfers_job(_token_logs(spark, d), 0, 1 << 40), spark, d)


@query(f"with {_WG} select account || '-' || ts as id, account, ts, cast(balance as varchar) as balance, cast(mint_amount as varchar) as mint_amount, cast(unit_seconds as varchar) as unit_seconds from snaps")
def l4_snapshots_from_logs(spark, d):
    found = L.account_snapshots(_token_transfers(spark, d))
    return found.select("id", "account", "ts", *[F.col(c).cast("string").alias(c) for c in ("balance", "mint_amount", "unit_seconds")])


@query(f"with {_WG} select account, ts, cast((unit_seconds // 86400) * 1000 + (unit_seconds % 86400) * 1000 // 86400 as varchar) as whole_points from snaps where unit_seconds >= 0 and unit_seconds % 86400 = 0")
def w4_points_from_logs(spark, d):
    """Points at whole days' unit-seconds, where no place is rounded."""
    found = L.account_snapshots(_token_transfers(spark, d)).where("unit_seconds >= 0 and unit_seconds % 86400 = 0")
    return found.select("account", "ts", F.split_part("points", F.lit("."), F.lit(1)).alias("whole_points"))


@query(f"with {_WS} select account, cast(sum(delta) as varchar) as balance, max(block_number) as last_block, max(ts) as last_ts from accounts group by 1")
def l3_balances_from_logs(spark, d):
    return L.current_balances(_token_transfers(spark, d)).withColumn("balance", F.col("balance").cast("string"))


@query(f"with {_WS} select account, cast(sum(delta * (1747451507 - ts)) as varchar) as moved from accounts group by 1")
def l7_points_from_logs(spark, d):
    return L.points_closed_form(_token_transfers(spark, d)).select("account", F.col("moved").cast("string").alias("moved"))


@query(f"with {_WS}, h as (select account, block_number, cast(max_by(balance, seq) as varchar) as balance from (select *, row_number() over w as seq, sum(delta) over (partition by account order by ts, block_number, id rows unbounded preceding) as balance from accounts window w as (partition by account order by ts, block_number, id)) group by 1, 2), wanted as (select distinct account, 900 as block_number from sides) select w.account, cast(w.block_number as bigint) as block_number, coalesce(h.balance, '0') as balance from wanted w asof left join h on w.account = h.account and w.block_number >= h.block_number")
def j9_asof_from_logs(spark, d):
    t = _token_transfers(spark, d)
    history = L.balance_history(t).groupBy("account", "block_number").agg(F.max_by("balance", F.struct("ts", "id")).alias("balance"))
    wanted = W.signed_sides(t).select("account", F.lit(900).cast("long").alias("block_number")).distinct()
    return J.balance_asof(wanted, history).withColumn("balance", F.col("balance").cast("string"))


# In whole millionths, half of one rounded away from zero.
@query(
    f"with {_WG}, p as (select account, ts, unit_seconds as u, abs(unit_seconds) as a from snaps), q as (select account, ts, u, (a // 86400) * 1000000000 + ((a % 86400) * 1000000000 + 43200) // 86400 as m from p)"
    " select account, ts, cast(case when u < 0 then -m else m end as varchar) as millionths from q"
)
def w4_points_everywhere(spark, d):
    """Points of all snapshots, in millionths."""
    found = L.account_snapshots(_token_transfers(spark, d))
    digits = F.translate("points", ".", "")
    return found.select("account", "ts", F.regexp_replace(digits, r"^(-?)0+(?=\d)", "$1").alias("millionths"))


@query(f"with {_WG} select account, ts, cast(old_balance as varchar) as old_balance, old_ts, cast(coalesce(cast(old_balance as hugeint) * (ts - old_ts), 0) as varchar) as added from previous where old_ts is not null")
def w2_prev_state(spark, d):
    updates = L.point_updates(_token_transfers(spark, d)).where("old_ts <> 0")
    return updates.select("account", F.col("new_ts").alias("ts"), F.col("old_balance").cast("string").alias("old_balance"), "old_ts", F.col("added").cast("string").alias("added"))


@query(f"with {_WG} select account, ts, cast(balance as varchar) as balance from running")
def w3_running_balance(spark, d):
    return L.account_snapshots(_token_transfers(spark, d)).select("account", "ts", F.col("balance").cast("string").alias("balance"))


@query(f"with {_WG} select account, max(mint_amount)::varchar as minted from running group by 1")
def w5_running_mint(spark, d):
    return L.account_snapshots(_token_transfers(spark, d)).groupBy("account").agg(F.max("mint_amount").cast("string").alias("minted"))


@query(f"with {_WG} select account, ts, cast(delta as varchar) as delta, cast(mint as varchar) as mint, block_number from grouped")
def u8_collapse_same_ts(spark, d):
    found = L.collapse_same_ts(_token_transfers(spark, d))
    return found.select("account", "ts", F.col("delta").cast("string").alias("delta"), F.col("mint").cast("string").alias("mint"), "block_number")


@query(f"with {_WG} select account, arg_max(ts, ts) as ts, cast(arg_max(balance, ts) as varchar) as balance from running group by 1")
def j12_accounts_with_latest(spark, d):
    t = _token_transfers(spark, d)
    accounts = L.sides_of_accounts(t).select("account").distinct()
    return J.accounts_with_latest(accounts, L.account_snapshots(t).select("account", "ts", "balance")).select("account", "ts", F.col("balance").cast("string").alias("balance"))


@query(f"with {_WS} select account, cast(sum(case when block_number < 1200 then delta else 0 end) as varchar) as moved, cast(max(mint) as varchar) as held from accounts group by 1")
def a15_points_window_sum(spark, d):
    zero = F.lit(0).cast("decimal(38,0)")
    moved = F.when(F.col("block_number") < 1200, F.col("delta")).otherwise(zero)
    found = L.points_window_sum(L.sides_of_accounts(_token_transfers(spark, d)).select("account", moved.alias("moved"), F.col("mint").alias("held")))
    return found.select("account", F.col("moved").cast("string").alias("moved"), F.col("held").cast("string").alias("held"))


@query(f"with {_WS}, c as (select account, sum(delta) as total, count(*) as n, sum(case when delta < 0 then -delta else delta end) as moved from accounts group by 1) select account, cast(moved // n as varchar) as floor from c")
def a6_u256_avg(spark, d):
    sides = L.sides_of_accounts(_token_transfers(spark, d))
    return sides.groupBy("account").agg(u256.u256_avg(F.abs("delta").cast("string")).alias("m")).select("account", F.col("m.floor").alias("floor"))


# -- scans --------------------------------------------------------------------------------


@query(f"with {_T} select {_LOGS.replace('from_addr, to_addr, cast(value as varchar) as value, ', '')} from transfers where block_number >= (select max(block_number) // 4 from transfers)")
def s1_scan_logs(spark, d):
    path = _raw_path("logs", R.logs, spark, d)
    lo = spark.read.parquet(path).agg(F.max("block_number")).first()[0] // 4
    return readers.scan_logs(spark, path, "0x" + "ab" * 20, lo, topic0_prefix=_TOPIC).select("id", "block_number")


@query(f"with {_F} select 'Swap' as name, count(*) as n from swaps union all select 'PairCreated', count(*) from made")
def s2_scan_logs_any_address(spark, d):
    path = _raw_path("factory_logs", R.factory_logs, spark, d)
    name = F.when(F.col("topics").startswith(schemas.EVENTS["Swap"][0]), "Swap").otherwise("PairCreated")
    return readers.scan_logs_any_address(spark, path, [schemas.EVENTS[n][0] for n in ("Swap", "PairCreated")]).groupBy(name.alias("name")).agg(F.count("*").alias("n"))


@query(f"with {_B} select id, number, hash from (select cast(number as varchar) as id, number, hash, max(number) over () as most from blocks) where number between most // 3 and most")
def s3_scan_blocks(spark, d):
    path = _raw_path("blocks", R.blocks, spark, d)
    most = spark.read.parquet(path).agg(F.max("number")).first()[0]
    return readers.scan_blocks(spark, path, most // 3, most).select("id", "number", "hash")


@query(f"with {_X} select hash, from_address, block_number from tx where block_number >= (select max(block_number) // 2 from tx)")
def s4_scan_transactions(spark, d):
    path = _raw_path("transactions", R.transactions, spark, d)
    most = spark.read.parquet(path).agg(F.max("block_number")).first()[0]
    return readers.scan_transactions(spark, path, most // 2, most).select("hash", "from_address", "block_number")


@query(f"with {_C} {_CALLS} from calls where block_number >= (select max(block_number) // 2 from calls)")
def s5_scan_traces_to(spark, d):
    path = _raw_path("calls", R.calls, spark, d)
    most = spark.read.parquet(path).agg(F.max("block_number")).first()[0]
    found = readers.scan_traces(spark, path, "0x" + "cd" * 20, most // 2, most, selector=schemas.SWAP_SELECTOR)
    return found.select("id", "transaction_hash", "from_address", "block_number")


@query(f"with {_B} select number // 1000 as part, count(*) as n from blocks group by 1")
def s6_scan_range_parallel(spark, d):
    path = _raw_path("blocks", R.blocks, spark, d)
    most = spark.read.parquet(path).agg(F.max("number")).first()[0]
    found = readers.scan_range_parallel(spark, lambda a, b: readers.scan_blocks(spark, path, a, b), 0, most, 1000, 8, "number")
    return found.groupBy(F.floor(F.col("number") / 1000).alias("part")).agg(F.count("*").alias("n"))


@query("select event_id, user_id from events")
def s7_read_dataset(spark, d):
    return readers.read_dataset(spark, f"{d}/events.parquet", "event_id long, user_id long")[0]


@query("select 'a' as platform, count(*) as n from events union all select 'b', count(*) from events")
def s8_read_datasets(spark, d):
    found, _ = readers.read_datasets(spark, {"a": f"{d}/events.parquet", "b": f"{d}/events.parquet", "c": f"{d}/no-such.parquet"}, "event_id long, user_id long")
    return found.groupBy("platform").agg(F.count("*").alias("n"))


@query("select o_orderkey, o_custkey, o_orderstatus from orders")
def s9_read_json_array(spark, d):
    path = new_path(spark, "json")
    rows = R.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    per = rows.groupBy(F.pmod(F.xxhash64("o_orderkey"), F.lit(64)).alias("n")).agg(F.collect_list(F.to_json(F.struct("*"))).alias("rows"))
    per.select(F.concat(F.lit("["), F.array_join("rows", ","), F.lit("]"))).repartition(64).write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_json_array(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string")


@query("select count(*) as n, cast(sum(event_id) as double) as ids from events")
def s13_infer_schema_first_row(spark, d):
    path = new_path(spark, "jsonl")
    R.table(spark, d, "events").select("event_id", "event_type").write.json(path)
    found = spark.read.schema(readers.infer_schema_first_row(spark, path)).json(path)
    return found.agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


# -- sinks --------------------------------------------------------------------------------


@query("select event_id, cast(user_id as varchar) as value from events")
def k1_write_parquet(spark, d):
    path = new_path(spark, "k1")
    sinks.write_parquet(R.table(spark, d, "events").select("event_id", F.col("user_id").alias("value"), "props"), path, {"event_id": "long", "value": "string"})
    return spark.read.parquet(path)


def _keyed(spark, d, write) -> DataFrame:
    """Two halves of the events, keyed by user and type, through a keyed sink."""
    path, e = new_path(spark, "keyed"), R.table(spark, d, "events").select("user_id", "event_type", "event_id")
    for half in (e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")):
        write(half, path, ["user_id", "event_type"])
    return sinks.read_table(spark, path)


@query("select user_id, event_type, coalesce(max(event_id) filter (where event_id % 2 = 1), max(event_id)) as event_id from events group by 1, 2")
def k2_upsert(spark, d):
    return _keyed(spark, d, sinks.upsert)


@query("select user_id, event_type, coalesce(max(event_id) filter (where event_id % 2 = 0), max(event_id)) as event_id from events group by 1, 2")
def k3_insert_ignore(spark, d):
    return _keyed(spark, d, sinks.insert_ignore)


@query("select event_id, 2::bigint as n from events")
def k4_append(spark, d):
    path = new_path(spark, "k4")
    for _ in range(2):
        sinks.append(R.table(spark, d, "events").select("event_id"), path)
    return spark.read.parquet(path).groupBy("event_id").agg(F.count("*").alias("n"))


@query("select event_type, count(*) as n, max(user_id) as most from events group by 1")
def k5_aggregate_sink(spark, d):
    """Every batch comes twice."""
    landing, table = new_path(spark, "landing"), new_path(spark, "aggregate")
    e = R.table(spark, d, "events").select("event_id", "event_type", "user_id", F.lit(1).alias("one"))
    for batch in (e, e.where("event_id % 3 = 0")):
        sinks.aggregate_sink(batch, landing, table, ["event_type"], {"n": ("one", "sum", "long"), "most": ("user_id", "max", "long")}, ["event_id"])
    return sinks.read_table(spark, table)


@query("select 'all' as branch, count(*) as n from events union all select 'clicks', count(*) from events where event_type = 'click'")
def k6_fan_out(spark, d):
    every, clicks = new_path(spark, "k6"), new_path(spark, "k6")
    sinks.fan_out(R.table(spark, d, "events"), [lambda x: sinks.append(x, every), lambda x: sinks.append(x.where("event_type = 'click'"), clicks)])
    return _union([spark.read.parquet(p).agg(F.count("*").alias("n")).select(F.lit(b).alias("branch"), "n") for b, p in (("all", every), ("clicks", clicks))])


@query("select event_id, true as stamped from events")
def k7_stamp_ingest(spark, d):
    return sinks.stamp_ingest(R.table(spark, d, "events")).select("event_id", F.col("inserted_at").isNotNull().alias("stamped"))


@query("select event_type, count(*) as n from events group by 1")
def k8_write_report_json(spark, d):
    path = new_path(spark, "k8")
    counts = R.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    sinks.write_report_json({"types": counts}, path)
    return spark.read.schema("event_type string, n long").json(f"{path}/types")


# -- projections, ids, predicates ------------------------------------------------------------


@query(f"with {_B} select cast(number as varchar) as id, number, hash, parent_hash, timestamp from blocks")
def p1_project_blocks(spark, d):
    return P.project_blocks(R.blocks(spark, d))


@query(f"with {_T} select {_LOGS} from transfers")
def p2_project_transfers(spark, d):
    decoded = decode_log(_raw("logs", R.logs, spark, d), ["Transfer"])
    return P.project_transfers(decoded).select("id", "from_addr", "to_addr", "value", "block_number")


@query("select '1_' || l_orderkey || '_' || l_linenumber as log_id, '0x' || md5(cast(l_orderkey as varchar)) || '-' || l_linenumber as tx_log_id, l_suppkey || '-' || l_partkey as snapshot_id from lineitem")
def p3_ids(spark, d):
    line = R.table(spark, d, "lineitem")
    tx = F.concat(F.lit("0x"), F.md5(F.col("l_orderkey").cast("string")))
    return line.select(C.log_id(F.lit("1"), F.col("l_orderkey"), F.col("l_linenumber")).alias("log_id"), C.tx_log_id(tx, F.col("l_linenumber")).alias("tx_log_id"), C.snapshot_id(F.col("l_suppkey"), F.col("l_partkey")).alias("snapshot_id"))


@query(f"with {_C} select '0x' || md5(cast(l_orderkey as varchar)) || '-' || concat_ws('-', l_linenumber, l_partkey, l_suppkey) as trace_id from calls union all select distinct '0x' || md5(cast(l_orderkey as varchar)) || '-0' from calls")
def p5_trace_id(spark, d):
    calls = _raw("calls", R.calls, spark, d)
    roots = calls.select(C.trace_id(F.col("transaction_hash"), F.array().cast("array<int>")).alias("trace_id")).distinct()
    return calls.select(C.trace_id(F.col("transaction_hash"), F.col("trace_address")).alias("trace_id")).union(roots)


@query("select cast(l_orderkey as varchar) as a, cast(l_partkey as varchar) as b, '' as c, count(*) as n from lineitem group by 1, 2")
def p7_split_id(spark, d):
    made = R.table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_partkey").alias("id"))
    return made.groupBy(*[C.split_id(F.col("id"), n + 1).alias(x) for n, x in enumerate("abc")]).agg(F.count("*").alias("n"))


@query(f"with {_T} select 'inclusive' as \"end\", count(*) as n from transfers where block_number between 300 and 1200 union all select 'exclusive', count(*) from transfers where block_number >= 300 and block_number < 1200")
def p8_block_between(spark, d):
    t = R.transfers(spark, d)
    return _union([P.block_between(t, 300, 1200, end=e).agg(F.count("*").alias("n")).select(F.lit(e).alias("end"), "n") for e in ("inclusive", "exclusive")])


@query(f"with {_T} select id, from_addr from transfers where from_addr <> {_Z}")
def p9_exclude_zero_address(spark, d):
    return P.exclude_zero_address(R.transfers(spark, d), "from_addr").select("id", "from_addr")


@query(f"with {_T} select id, from_addr = {_Z} as minted from transfers")
def p10_is_mint(spark, d):
    return R.transfers(spark, d).select("id", C.is_mint(F.col("from_addr")).alias("minted"))


@query(f"with {_F} select id, pair from swaps")
def p11_by_signature(spark, d):
    return P.by_signature(decode_log(_raw("factory_logs", R.factory_logs, spark, d), ["Swap", "PairCreated"]), "Swap").select("id", F.col("address").alias("pair"))


@query(f"with {_C} select id from calls")
def p12_by_selector(spark, d):
    return P.by_selector(_raw("calls", R.calls, spark, d), schemas.SWAP_SELECTOR).select("id")


@query(f"with {_X} select hash, to_address from tx where to_address is not null")
def p13_require_fields(spark, d):
    return P.require_fields(R.transactions(spark, d), ["hash", "to_address"]).select("hash", "to_address")


@query(f"with {_X} select t.hash from tx t join receipts r on t.hash = r.hash where r.effective_gas_price is not null")
def p14_valid_gas(spark, d):
    joined = J.tx_receipt_join(R.transactions(spark, d), R.receipts(spark, d)).withColumn("gas_price", F.lit(None).cast("decimal(38,0)"))
    return P.valid_gas(joined).select("hash")


@query(f"with {_C} select id from whole where len(path) >= 3")
def p15_min_path(spark, d):
    return P.min_path(decode_swap_call(_raw("calls", R.calls, spark, d)), 3).select("id")


@query(f"with {_X} select hash, coalesce(to_address, {_Z}) as recipient from tx")
def p16_coalesce_default(spark, d):
    return R.transactions(spark, d).select("hash", P.coalesce_default(F.col("to_address"), schemas.ZERO_ADDRESS).alias("recipient"))


@query("select o_orderkey, o_orderkey % 3 = 0 as valid, o_orderkey % 3 <> 2 as repaired from orders")
def p17_valid_and_repaired_address(spark, d):
    """By order key an address, one without its 0x, and one that is too short."""
    bare = F.lpad(F.lower(F.hex(F.col("o_orderkey"))), 40, "0")
    kind = F.col("o_orderkey") % 3
    text = F.when(kind == 0, F.concat(F.lit("0x"), bare)).when(kind == 1, bare).otherwise(F.substring(bare, 1, 39))
    return R.table(spark, d, "orders").select("o_orderkey", C.valid_address(text).alias("valid"), C.valid_address(C.repair_address(text)).alias("repaired"))


# -- decoding ----------------------------------------------------------------------------------


@query(f"with {_C} select id, cast(amount_in as varchar) as amount_in, cast(amount_out_min as varchar) as amount_out_min, array_to_string(path, ',') as path, caller as to_addr, cast(deadline as varchar) as deadline from whole")
def d3_decode_swap_call(spark, d):
    found = decode_swap_call(_raw("calls", R.calls, spark, d)).where(F.col("path").isNotNull() & (F.size("path") > 0))
    return found.select("id", "amount_in", "amount_out_min", C.path_join(F.col("path")).alias("path"), F.col("to").alias("to_addr"), "deadline")


@query(f"with {_C} select id, case when l_orderkey % 17 = 0 then {_Z} || ',' || {_Z} else array_to_string(path[1:2], ',') end as path from calls")
def d4_path_guard(spark, d):
    found = decode_swap_call(_raw("calls", R.calls, spark, d), most=2, fallback=True)
    return found.select("id", C.path_join(F.col("path")).alias("path"))


@query(f"with {_T} select id, from_addr, to_addr from transfers")
def d5_topic_to_address(spark, d):
    topic = lambda n: C.topic_to_address(F.split_part("topics", F.lit(","), F.lit(n)))
    return _raw("logs", R.logs, spark, d).select("id", topic(2).alias("from_addr"), topic(3).alias("to_addr"))


@query("select 'c' || o_orderkey as id, '0x' || printf('%040x', o_orderkey + 9000000) as pair from orders where o_orderstatus <> 'F'")
def d6_data_word_address(spark, d):
    created = _raw("factory_logs", R.factory_logs, spark, d).where(F.col("topics").startswith(schemas.EVENTS["PairCreated"][0]))
    return created.select("id", C.data_word_address(F.col("data"), 0).alias("pair"))


@query(f"with {_T} select id, cast(value as varchar) as value from transfers")
def d7_hex_to_u256(spark, d):
    return _raw("logs", R.logs, spark, d).select("id", u256.hex_to_u256(F.col("data")).alias("value"))


@query(f"with {_F} select 'Swap' as event, count(*) as n, count(distinct sender) as first_params from swaps union all select 'PairCreated', count(*), count(distinct token0) from made")
def d8_route_events(spark, d):
    routed = route_events(_raw("factory_logs", R.factory_logs, spark, d).withColumns({"block_timestamp": F.lit(0).cast("long"), "transaction_hash": F.lit("")}), ["Swap", "PairCreated"])
    first = {"Swap": "sender", "PairCreated": "token0"}
    return _union([routed[n].agg(F.count("*").alias("n"), F.count_distinct(c).alias("first_params")).select(F.lit(n).alias("event"), "n", "first_params") for n, c in first.items()])


_KINDS = ["Approval", "ClaimerUpdated", "FeeChanged", "Initialized", "NameAndSymbolChanged", "Paused", "BatchMintSkipped", "UnstakeRequest", "WithdrawalsEnabled", "EIP712DomainChanged"]


@query(
    "with o as (select o_orderkey as k, o_custkey as c, o_orderkey % 10 as kind, '0x' || printf('%040x', o_orderkey) as a, '0x' || printf('%040x', o_custkey) as b, '0x' || printf('%064x', o_orderkey) as h, o_custkey % 2 = 1 as odd,"
    " 'name ' || o_custkey as name, 'sym' || o_orderkey as sym, '0x' || lower(hex('payload ' || o_custkey)) as payload from orders)"
    " select k, ['Approval', 'ClaimerUpdated', 'FeeChanged', 'Initialized', 'NameAndSymbolChanged', 'Paused', 'BatchMintSkipped', 'UnstakeRequest', 'WithdrawalsEnabled', 'EIP712DomainChanged'][kind + 1] as signature,"
    " case kind when 0 then a || '|' || b || '|' || c when 1 then a || '|' || case when odd then 'true' else 'false' end when 2 then k || '|' || c when 3 then cast(c as varchar)"
    " when 4 then name || '|' || sym when 5 then a when 6 then h || '|' || payload when 7 then a || '|' || payload || '|' || c when 8 then case when odd then 'true' else 'false' end else '' end as params from o"
)
def d9_value_kinds(spark, d):
    """Addresses, numbers, flags, fixed and dynamic bytes and strings: ten events over the orders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    word = lambda v: F.lpad(F.lower(F.hex(v.cast("long"))), 64, "0")
    topic = lambda v: F.concat(F.lit("0x"), word(v))

    def body(text):
        size = F.length(text)
        filled = F.ceil(size / 32).cast("int") * 64
        return F.concat(word(size), F.rpad(F.lower(F.hex(text)), 640, "0").substr(F.lit(1), filled)), F.lit(1) + F.ceil(size / 32)

    name, symbol, payload = F.concat(F.lit("name "), c.cast("string")), F.concat(F.lit("sym"), k.cast("string")), F.concat(F.lit("payload "), c.cast("string"))
    (name_body, name_words), (symbol_body, _), (payload_body, _) = body(name), body(symbol), body(payload)
    flag, none = word(c % 2), F.lit("")
    made = {
        "Approval": ([topic(k), topic(c)], word(c)),
        "ClaimerUpdated": ([topic(k)], flag),
        "FeeChanged": ([topic(k), topic(c)], none),
        "Initialized": ([], word(c)),
        "NameAndSymbolChanged": ([], F.concat(word(F.lit(64)), word(64 + name_words * 32), name_body, symbol_body)),
        "Paused": ([], word(k)),
        "BatchMintSkipped": ([topic(k)], F.concat(word(F.lit(32)), payload_body)),
        "UnstakeRequest": ([topic(k)], F.concat(word(F.lit(64)), word(c), payload_body)),
        "WithdrawalsEnabled": ([], flag),
        "EIP712DomainChanged": ([], none),
    }
    topics, data = F.lit(""), none
    for n, event in enumerate(_KINDS):
        is_it = k % 10 == n
        topics = F.when(is_it, F.concat_ws(",", F.lit(schemas.EVENTS[event][0]), *made[event][0])).otherwise(topics)
        data = F.when(is_it, made[event][1]).otherwise(data)
    logs = written(R.table(spark, d, "orders").select(k.alias("k"), topics.alias("topics"), F.concat(F.lit("0x"), data).alias("data")), "kinds")
    return decode_log(logs, _KINDS).select("k", F.col("decoded.event_signature").alias("signature"), F.array_join("decoded.event_params", "|").alias("params"))


@query(f"with {_F} select '{schemas.EVENTS['Swap'][0]}' as topic0, 'Swap' as signature, count(*) as n from swaps union all select '{schemas.EVENTS['PairCreated'][0]}', 'PairCreated', count(*) from made")
def d10_topic_catalogue(spark, d):
    decoded = decode_log(_raw("factory_logs", R.factory_logs, spark, d))
    return decoded.groupBy(F.substring_index("topics", ",", 1).alias("topic0"), F.col("decoded.event_signature").alias("signature")).agg(F.count("*").alias("n"))


@query(f"with {_C} select id, array_to_string(path, ',') as path, len(path) as n from whole")
def d12_parse_list(spark, d):
    found = decode_swap_call(_raw("calls", R.calls, spark, d)).where(F.size("path") > 0)
    text = F.concat(F.lit('["'), F.array_join("path", '", "'), F.lit('"]'))
    return found.select("id", C.parse_list(text).alias("path"), C.list_length(C.parse_list(text)).alias("n"))


# -- exact amounts and columns -------------------------------------------------------------------


_AMOUNT = "cast(o_orderkey as hugeint) * 1000000000000000000 + o_custkey"


@query(f"select o_orderkey, cast({_AMOUNT} as varchar) as amount, case when o_orderkey % 2 = 0 then '1230000000000000000000' else '0' end as lenient from orders")
def f1_to_u256(spark, d):
    text = F.concat(F.col("o_orderkey").cast("string"), F.lpad(F.col("o_custkey").cast("string"), 18, "0"))
    bad = F.when(F.col("o_orderkey") % 2 == 0, "1.23e+21").otherwise("n/a")
    return R.table(spark, d, "orders").select("o_orderkey", u256.to_u256(text).cast("string").alias("amount"), u256.safe_to_u256(bad).cast("string").alias("lenient"))


@query("select o_orderkey, cast(cast(o_orderkey as hugeint) * 1000000007 * (o_custkey + 1000000000000) as varchar) as product, case when o_orderkey = 0 then '0' else o_orderkey || repeat('0', 60) end as wide from orders")
def f2_u256_mul(spark, d):
    a, b = F.col("o_orderkey").cast("decimal(20,0)") * F.lit(1000000007), F.col("o_custkey") + F.lit(1000000000000)
    power = F.lit("1" + "0" * 30)
    wide = u256.u256_mul(F.concat(F.col("o_orderkey").cast("string"), F.lit("0" * 30)), power)
    return R.table(spark, d, "orders").select("o_orderkey", u256.u256_mul(a.cast("decimal(38,0)"), b).alias("product"), wide.alias("wide"))


@query("select o_orderkey, cast((cast(o_custkey as hugeint) + 21000) * case when o_orderkey % 2 = 0 then 1000000001 else 1000000007 end as varchar) as gas from orders")
def f3_gas_value(spark, d):
    effective = F.when(F.col("o_orderkey") % 2 == 0, F.lit(1000000001))
    return R.table(spark, d, "orders").select("o_orderkey", C.gas_value(F.col("o_custkey") + 21000, effective, F.lit(1000000007)).alias("gas"))


@query("select o_orderkey, case when o_orderkey = 0 then '50000000000000000' else o_orderkey || '050000000000000000' end as up, o_orderkey // 100 || '.' || lpad(cast(o_orderkey % 100 as varchar), 2, '0') || repeat('0', 16) as down from orders")
def f5_scale_down_and_up(spark, d):
    k = F.col("o_orderkey")
    return R.table(spark, d, "orders").select("o_orderkey", u256.scale_up(F.concat(k.cast("string"), F.lit(".05")), 18).alias("up"), u256.scale_down(k, 2).cast("string").alias("down"))


@query("select o_orderkey, cast(o_custkey * o_orderkey * 1000 // 86400 as bigint) as whole, cast((o_custkey * o_orderkey // 86400) * 1000 as bigint) as at_least from orders")
def f7_points_rates(spark, d):
    o = R.table(spark, d, "orders")
    rate = C.points_rate(F.col("o_custkey"), F.col("o_orderkey"))
    days = F.call_function("div", F.col("o_custkey") * F.col("o_orderkey"), F.lit(86400).cast("long"))
    return o.select("o_orderkey", C.points_rate_floor(F.col("o_custkey"), F.col("o_orderkey")).alias("whole"), F.when(rate.cast("decimal(38,6)") >= days * 1000, days * 1000).alias("at_least"))


@query("select event_id, round(ln(value + 1), 6) as v from events where value >= 0")
def f9_log1p(spark, d):
    return R.table(spark, d, "events").where("value >= 0").select("event_id", F.round(C.log1p_clip(F.col("value")), 6).alias("v"))


@query("select o_orderkey, '0x' || printf('%040x', o_custkey) as address, md5(cast(o_orderkey as varchar)) as hash, '0x' || md5(cast(o_orderkey as varchar)) as hex from orders")
def f10_text_forms(spark, d):
    address = F.concat(F.lit(" 0X"), F.upper(F.lpad(F.lower(F.hex("o_custkey")), 40, "0")), F.lit(" "))
    h = F.concat(F.lit("0x"), F.md5(F.col("o_orderkey").cast("string")))
    return R.table(spark, d, "orders").select("o_orderkey", C.lower_address(address).alias("address"), C.normalize_hash(h).alias("hash"), C.bytes_to_hex(C.hex_to_bytes(h)).alias("hex"))


@query(f"with {_C} select id, len(path) as n, path[1] as first from whole")
def f14_path_tokens(spark, d):
    """Tokens with commas between them, or run together."""
    found = decode_swap_call(_raw("calls", R.calls, spark, d)).where(F.size("path") > 0)
    text = F.when(F.col("block_number") % 2 == 0, F.array_join("path", ",")).otherwise(F.array_join("path", ""))
    return found.select("id", F.size(C.path_tokens(text)).alias("n"), C.path_tokens(text)[0].alias("first"))


@query("select event_id, cast(epoch(date_trunc('second', ts)) as bigint) as s, cast(epoch(date_trunc('second', ts)) as bigint) * 1000 as ms, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.000Z') as iso from events")
def f15_times(spark, d):
    s = F.unix_timestamp("ts")
    either = F.when(F.col("event_id") % 2 == 0, s).otherwise(s * 1000)
    return R.table(spark, d, "events").select("event_id", C.epoch_seconds(either).alias("s"), C.epoch_millis(either).alias("ms"), C.iso_time(s * 1000).alias("iso"))


@query(f"with {_X} select hash, cast(gas_price as varchar) as gas_price, '0x' || lower(hex(hash)) as hash_hex from tx")
def f17_text_columns(spark, d):
    made = R.transactions(spark, d).select("hash", "gas_price", F.col("hash").cast("binary").alias("hash_hex"))
    return readers.text_columns(made)


# -- joins, sets, order -----------------------------------------------------------------------------


@query(f"with {_F} select s.id from swaps s where pair in (select pair from made)")
def j1_factory_semi_join(spark, d):
    logs = _raw("factory_logs", R.factory_logs, spark, d)
    return J.factory_semi_join(logs.where(F.col("topics").startswith(schemas.EVENTS["Swap"][0])), L.pairs_job(logs)).select("id")


@query(f"with {_F} select s.id from swaps s join made m on s.pair = m.pair and s.block_number >= m.created_at")
def j2_factory_temporal_join(spark, d):
    logs = _raw("factory_logs", R.factory_logs, spark, d)
    return J.factory_temporal_join(logs.where(F.col("topics").startswith(schemas.EVENTS["Swap"][0])), L.pairs_job(logs)).select("id")


@query(f"with {_X} select t.hash, t.block_number, cast(r.gas_used as varchar) as gas_used from tx t join receipts r on t.hash = r.hash")
def j4_tx_receipt_join(spark, d):
    joined = J.tx_receipt_join(R.transactions(spark, d), R.receipts(spark, d))
    return joined.select("hash", "block_number", F.col("gas_used").cast("string").alias("gas_used"))


@query(f"with {_C}, {_X} select c.id, coalesce(t.from_address, c.caller, '') as sender from calls c left join tx t on c.transaction_hash = t.hash")
def j5_trace_tx_join(spark, d):
    return J.trace_tx_join(_raw("calls", R.calls, spark, d), R.transactions(spark, d)).select("id", "sender")


@query(f"with {_B}, l as (select concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) as id, l_orderkey as k, l_orderkey % 3 <> 0 as known from lineitem) select l.id, b.number as block_number, b.timestamp as block_timestamp from l join blocks b on b.number = l.k")
def j6_log_tx_block_join(spark, d):
    """By order key the transaction knows its block's hash, or only the log does."""
    h = lambda c: F.concat(F.lit("0x"), F.md5(c.cast("string")))
    line = R.table(spark, d, "lineitem")
    key = F.col("l_orderkey")
    logs = line.select(F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.concat(F.lit("tx"), key.cast("string")).alias("transaction_hash"), F.when(key % 3 == 0, h(key)).alias("block_hash"))
    txs = line.select(F.concat(F.lit("tx"), key.cast("string")).alias("hash"), F.when(key % 3 != 0, h(key)).alias("block_hash")).distinct()
    return J.log_tx_block_join(logs, txs, R.blocks(spark, d)).select("id", "block_number", "block_timestamp")


@query(f"with {_E} select id from plat_a where id not in (select id from plat_b)")
def j15_missing_from(spark, d):
    e = R.table(spark, d, "events").select(F.col("event_id").alias("id"))
    return J.missing_from(e.where("id % 10 <> 0"), e.where("id % 7 <> 0"), "id").select("id")


@query("select o_custkey as account, unnest(range((min(o_orderkey) // 500 + 1) * 500, 60001, 500)) as ts from orders group by 1")
def j16_account_ticks(spark, d):
    seen = R.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("account")).agg(F.min("o_orderkey").alias("first_ts"))
    return J.account_ticks(seen, 500, 60000)


@query(f"with {_F}, listed as (select 'pairs' as what, unnest([pair, token0, token1]) as a from made) select what, count(distinct a) as n from listed group by 1")
def a8_unique_addresses(spark, d):
    pairs = L.pairs_job(_raw("factory_logs", R.factory_logs, spark, d)).withColumn("what", F.lit("pairs"))
    return A.unique_addresses(pairs, ["what"], ["pair", "token0", "token1"])


@query(f"with {_T} select count(*) as transfers from transfers")
def a19_event_counter(spark, d):
    return A.event_counter(_raw("logs", R.logs, spark, d), "transfers")


@query("with n as (select event_type, count(*) as n from events group by 1) select event_type, n, round(n * 100.0 / (select sum(n) from n), 4)::double as share from n")
def w10_share_of_total(spark, d):
    return W.share_of_total(R.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")))


@query("select event_id, row_number() over (order by value desc, event_id) as place from events order by value desc, event_id limit 100")
def o1_order_by(spark, d):
    top = W.order_by(R.table(spark, d, "events"), [F.desc("value"), "event_id"]).limit(100).select("event_id")
    return top.withColumn("place", (F.monotonically_increasing_id() + 1).cast("long"))


@query("select event_id, event_type from events order by event_type, event_id limit 5")
def o4_first_n_examples(spark, d):
    return W.first_n_examples(R.table(spark, d, "events"), ["event_type", "event_id"]).select("event_id", "event_type")


@query(f"with {_T} select from_addr as account, block_number, ts from transfers union all select to_addr, block_number, ts from transfers")
def u1_both_sides(spark, d):
    return W.both_sides(R.transfers(spark, d))


@query(f"with {_E} select id from plat_a where id not in (select id from plat_b)")
def u5_key_except(spark, d):
    e = R.table(spark, d, "events").select(F.col("event_id").alias("id"))
    return W.key_except(e.where("id % 10 <> 0"), e.where("id % 7 <> 0"), "id")


@query("select event_id as id from events where event_id % 10 <> 0 or event_id % 7 <> 0")
def u6_key_union(spark, d):
    e = R.table(spark, d, "events").select(F.col("event_id").alias("id"))
    return W.key_union([e.where("id % 10 <> 0"), e.where("id % 7 <> 0")], "id")


@query("select o_orderkey, case when o_orderkey % 5 = 0 then null else o_orderkey end as block from orders")
def n2_block_from_meta(spark, d):
    k = F.col("o_orderkey")
    meta = F.when(k % 5 == 0, "ethereum").otherwise(F.concat(F.lit("1:"), k.cast("string"), F.lit(":x")))
    return R.table(spark, d, "orders").select("o_orderkey", C.block_from_meta(meta).alias("block"))


@query(
    f"with {_E}, k as (select platform, 'id' as level, cast(id as varchar) as key from tagged union all select platform, 'user', cast(usr as varchar) from tagged), m as (select level, key, bool_or(platform = 'a') as a, bool_or(platform = 'b') as b from k group by 1, 2)"
    " select level, 'a' as platform_a, 'b' as platform_b, count(*) filter (where a and b) as common, count(*) filter (where a and not b) as only_a, count(*) filter (where b and not a) as only_b from m group by 1"
)
def n9_key_level_compare(spark, d):
    found = N.key_level_compare(_platforms(spark, d), {"id": "id", "user": "usr"}, R.PLATFORMS)
    return found.where("platform_a = 'a' and platform_b = 'b'").drop("jaccard")


@query(f"with {_T}, r as (select *, greatest(length(id), 0) as n from transfers) select count(*) as n, sum(n)::bigint as chars from r")
def x1_on_event(spark, d):
    indexer = X.Indexer()

    @indexer.on_event("0x" + "ab" * 20, "Transfer", 0, 1 << 40)
    def totals(df):
        return df.agg(F.count("*").alias("n"), F.sum(F.length("id")).alias("chars"))

    return indexer.run({"logs": _raw("logs", R.logs, spark, d)})["totals"]


@query(f"with {_B} select number from blocks where number % 10 = 0")
def x2_on_block(spark, d):
    indexer = X.Indexer()

    @indexer.on_block(every=10)
    def tens(df):
        return df.select("number")

    return indexer.run({"blocks": R.blocks(spark, d)})["tens"]


@query(f"with {_X} select from_address, count(*) as n from tx group by 1")
def x3_on_transaction(spark, d):
    indexer = X.Indexer()

    @indexer.on_transaction()
    def senders(df):
        return df.groupBy("from_address").agg(F.count("*").alias("n"))

    return indexer.run({"transactions": R.transactions(spark, d)})["senders"]


@query(f"with {_C} select id, cast(amount_in as varchar) as amount_in from whole")
def x4_on_call(spark, d):
    indexer = X.Indexer()

    @indexer.on_call("0x" + "cd" * 20, schemas.SWAP_SELECTOR)
    def amounts(df):
        return df.where(F.size("path") > 0).select("id", "amount_in")

    return indexer.run({"traces": _raw("calls", R.calls, spark, d)})["amounts"]


@query(f"with {_F} select s.pair, count(*) as n from swaps s join made m on s.pair = m.pair and s.block_number >= m.created_at group by 1")
def x5_template(spark, d):
    indexer = X.Indexer()

    @indexer.template("0x" + "ef" * 20)
    def swaps(df):
        return df.groupBy("pair").agg(F.count("*").alias("n"))

    return indexer.run({"logs": _raw("factory_logs", R.factory_logs, spark, d)})["swaps"]


@query(f"with {_T} select 'Transfer' as signature, from_addr, cast(sum(cast(value as hugeint) * 1000000007) as varchar) as total from transfers group by 2")
def x6_sql_functions(spark, d):
    X.register_sql_functions(spark)
    return spark.sql(
        "select log_signature(topics) as signature, event_param(topics, data, 1) as from_addr, cast(sum(cast(u256_mul(event_param(topics, data, 3), '1000000007') as decimal(38,0))) as string) as total from {logs} group by 1, 2",
        logs=_raw("logs", R.logs, spark, d),
    )


@query(f"with {_T} select from_addr as sender, count(*) as n from transfers group by 1")
def x7_pipeline(spark, d):
    path = new_path(spark, "x7")
    spec = {
        "sources": {"raw": "logs"},
        "transforms": {"counts": "select sender, count(*) n from {named} group by 1", "named": "select topic_address(split_part(topics, ',', 2)) sender from {raw}"},
        "sinks": {"s": {"from": "counts", "path": path, "keys": ["sender"]}},
    }
    X.register_sql_functions(spark)
    X.pipeline(spark, spec, {"logs": _raw("logs", R.logs, spark, d)})
    return sinks.read_table(spark, path)


@query("select event_type || '.log' as path, cast(max(event_id) % 100 as double) as progress, cast(max(event_id) as double) + 0.5 as rpc from events group by event_type")
def m1_parse_metric_logs(spark, d):
    e = R.table(spark, d, "events")
    text = F.concat(F.lit("rpc: "), F.col("event_id").cast("string"), F.lit(".5s done "), (F.col("event_id") % 100).cast("string"), F.lit("%"))
    lines = e.select(F.concat("event_type", F.lit(".log")).alias("path"), F.col("event_id").alias("line_no"), text.alias("value"))
    return X.parse_metric_logs(lines).select("path", "progress", "rpc")


@query('select event_type as "case", round(count(*) / 60.0, 6)::double as blocks_per_s, round(max(event_id) / 60.0, 6)::double as records_per_s, 1.0::double as minutes, least(round(count(*) * 100.0 / 1000, 6), 100.0)::double as progress from events group by 1')
def m2_throughput(spark, d):
    e = R.table(spark, d, "events")
    runs = e.groupBy(F.col("event_type").alias("case")).agg(F.lit(60.0).alias("seconds"), F.count("*").alias("blocks"), F.max("event_id").alias("records"), F.lit(1000).alias("total"))
    return X.throughput(runs)


@query("select o_orderkey as id, cast(o_custkey as varchar) as wide, '0x' || lower(hex(encode('b' || o_orderkey))) as raw, count(*) over () as n from orders where o_orderkey between 100 and 10000")
def s10_read_jdbc_range(spark, d):
    """Orders from the database that comes with Spark, one in the memory of a local master's process."""
    url = f"jdbc:derby:memory:orders{uuid.uuid4().hex}"
    rows = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("ID"), F.col("o_custkey").cast("decimal(31,0)").alias("WIDE"), F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).cast("binary").alias("RAW"))
    rows.coalesce(2).write.jdbc(f"{url};create=true", "ORDERS", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    found = readers.read_jdbc_range(spark, url, "ORDERS", "ID", 100, 10000, 4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    return found.select(F.col("ID").alias("id"), F.col("WIDE").alias("wide"), F.col("RAW").alias("raw"), F.count("*").over(Window.partitionBy()).alias("n"))


@query(
    f"with {_E} select cast(id // 1000 * 1000 as varchar) as bucket, cast(count(*) filter (platform = 'a') as varchar) as a, cast(count(*) filter (platform = 'b') as varchar) as b, cast(count(*) filter (platform = 'c') as varchar) as c from tagged group by id // 1000"
)
def k9_distribution_csv(spark, d):
    """The same figures from the CSV that was written."""
    rows = None
    for name, c in (("a", "event_id"), ("b", "eventId"), ("c", "id")):
        one = R.platform(spark, d, name).select(F.lit(name).alias("platform"), F.col(c).alias("n"))
        rows = one if rows is None else rows.union(one)
    path = new_path(spark, "k9")
    sinks.write_distribution_csv(rows, F.floor(F.col("n") / 1000) * 1000, ["a", "b", "c"], path)
    return spark.read.csv(path, header=True)


# -- streams, run to the end of what is there -----------------------------------------------------------

#: Changes in a file of a stream in order of time, and files of a micro-batch.
FILE_ROWS, FILES = 1 << 20, 32


def _stream(spark, df: DataFrame, files: int = 3) -> DataFrame:
    """``df`` written as some files, read as a stream of one file a micro-batch."""
    path = new_path(spark, "stream")
    df.repartition(files).write.parquet(path)
    return readers.read_stream_blocks(spark, path, df.schema, files_per_batch=1)


def _drained(spark, stream: DataFrame) -> DataFrame:
    out = new_path(spark, "drained")
    jobs.run_bounded(stream, jobs.micro_batch(lambda b: b, out), new_path(spark, "stream-state"))
    return jobs.read_batches(spark, out, stream.schema)


@query("select event_id, user_id, event_type from events")
def s14_read_stream_blocks(spark, d):
    return _drained(spark, _stream(spark, R.table(spark, d, "events").select("event_id", "user_id", "event_type")))


@query("select user_id, count(*) as n from events group by 1")
def t1_run_bounded(spark, d):
    out = new_path(spark, "t1")
    stream = _stream(spark, R.table(spark, d, "events").select("event_id", "user_id"))
    jobs.run_bounded(stream, jobs.micro_batch(lambda b: b, out, ["event_id"]), new_path(spark, "t1-state"))
    return sinks.read_table(spark, out).groupBy("user_id").agg(F.count("*").alias("n"))


@query("select user_id, max(event_id) as event_id from events group by 1")
def t2_micro_batch(spark, d):
    out = new_path(spark, "t2")
    stream = _stream(spark, R.table(spark, d, "events").select("user_id", "event_id"))

    def latest(batch: DataFrame) -> DataFrame:
        old, new = sinks.read_table(batch.sparkSession, out), batch.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
        return new if old is None else new.union(old).groupBy("user_id").agg(F.max("event_id").alias("event_id"))

    jobs.run_bounded(stream, jobs.micro_batch(latest, out, ["user_id"]), new_path(spark, "t2-state"))
    return sinks.read_table(spark, out)


@query(f"with {_T} select id, block_number from transfers where block_number <= (select max(block_number) from transfers) - 75")
def t3_finality_cut(spark, d):
    return jobs.finality_cut(R.transfers(spark, d)).select("id", "block_number")


@query("select o_custkey as block_number, o_orderkey as log_index, 'b' as block_hash, 2::bigint as ingest from orders where o_custkey % 2 = 0 and o_orderkey % 3 = 0 union all select o_custkey, o_orderkey, 'a', 1 from orders where o_custkey % 2 = 1 or o_custkey not in (select o_custkey from orders where o_custkey % 2 = 0 and o_orderkey % 3 = 0)")
def t4_hot_block_replace(spark, d):
    path = new_path(spark, "hot")
    rows = R.table(spark, d, "orders").select(F.col("o_custkey").alias("block_number"), F.col("o_orderkey").alias("log_index"), F.lit("a").alias("block_hash"), F.lit(1).cast("long").alias("ingest"))
    jobs.hot_block_replace(rows, path)
    jobs.hot_block_replace(rows.where("block_number % 2 = 0 and log_index % 3 = 0").withColumns({"block_hash": F.lit("b"), "ingest": F.lit(2).cast("long")}), path)
    return sinks.read_table(spark, path)


@query(f"with {_WG} select account, ts, cast(balance as varchar) as balance, cast(unit_seconds as varchar) as unit_seconds from snaps")
def t5_points_stream(spark, d):
    """The stream's rows are those of the batch job, on amounts of 18 decimals.

    Changes come in order of time, so that those which wait in the state are those of one micro-batch.
    """
    sides = L.sides_of_accounts(_token_transfers(spark, d)).select("account", "ts", "delta")
    told = sides.agg(F.count("*").alias("n"), F.max("ts").alias("ts"), F.max("delta").alias("delta")).first()
    path = new_path(spark, "t5")
    sinks.write_in_order(sides, path, max(1, -(-told.n // FILE_ROWS)), ["ts"], ["account", "ts"])
    # Far later rows of another account move the watermark past all others.
    ends = spark.createDataFrame([("end", (told.ts or 0) + 10**6 + late, told.delta) for late in (0, 86400)], sides.schema)
    ends.coalesce(1).write.mode("append").parquet(path)
    stream = readers.read_stream_blocks(spark, path, sides.schema, files_per_batch=FILES).withColumn("at", F.timestamp_seconds("ts"))
    found = _drained(spark, jobs.points_stream(stream, "at"))
    return found.where("account <> 'end'").select("account", "ts", F.col("balance").cast("string").alias("balance"), F.col("unit_seconds").cast("string").alias("unit_seconds"))


@query(
    "with e as (select user_id as account, cast(epoch(date_trunc('second', ts)) as bigint) as ts, event_id as delta from events), f as (select account, (min(ts) // 86400 + 1) * 86400 as first from e group by 1),"
    " t as (select account, unnest(range(first, (select max(ts) from e) + 1, 86400)) as ts from f), x as (select t.account, t.ts, sum(e.delta) as balance from t join e on e.account = t.account and e.ts <= t.ts group by 1, 2) select account, ts, cast(balance as varchar) as balance from x"
)
def t6_interval_trigger_time(spark, d):
    """Daily ticks of every user up to the last event."""
    s = F.unix_timestamp("ts")
    e = R.table(spark, d, "events").select(F.col("user_id").alias("account"), s.alias("ts"), F.col("event_id").alias("delta"), F.timestamp_seconds(s).alias("at"))
    last = e.agg(F.max("ts")).first()[0]
    end = spark.range(1).select(F.lit(-1).cast("long").alias("account"), F.lit(last + 10).cast("long").alias("ts"), F.lit(0).cast("long").alias("delta"), F.timestamp_seconds(F.lit(last + 4000)).alias("at"))
    path = new_path(spark, "t6")
    e.repartition(3).write.parquet(path)
    end.write.mode("append").parquet(path)
    runs = _drained(spark, jobs.interval_runs_time(readers.read_stream_blocks(spark, path, e.schema), "at", 86400, "10 seconds"))
    return jobs.run_ticks(runs, "ts").where(F.col("account") >= 0).where(F.col("ts") <= last).select("account", "ts", F.col("balance").cast("string").alias("balance"))


_BLOCK_TICKS = "(b < h and b % 100 = 0) or (b >= h and b % 20 = 0)"


@query(
    "with e as (select user_id as account, event_id // 10 as block, event_id as delta from events), n as (select cast(unnest(range(0, (select max(block) from e) + 1)) as bigint) as b), m as (select max(block) // 2 as h from e),"
    f" ticks as (select b from n, m where {_BLOCK_TICKS}), f as (select account, min(block) as first from e group by 1),"
    " x as (select e.account, t.b as block_number, sum(e.delta) as balance from f join ticks t on t.b > f.first join e on e.account = f.account and e.block <= t.b group by 1, 2) select account, block_number, cast(balance as varchar) as balance from x"
)
def t7_block_stream(spark, d):
    """Every user's balance at every 100th block of the first half and every 20th after it, from a stream.

    The ticks are users times blocks, so what is stored are their runs.
    """
    e = R.table(spark, d, "events").select(F.col("user_id").alias("account"), F.floor(F.col("event_id") / 10).alias("block_number"), F.col("event_id").alias("delta"))
    last = e.agg(F.max("block_number")).first()[0]
    end = spark.range(1).select(F.lit(-1).cast("long").alias("account"), F.lit(last + 200).cast("long").alias("block_number"), F.lit(0).cast("long").alias("delta"))
    path = new_path(spark, "t7")
    e.repartition(3).write.parquet(path)
    end.write.mode("append").parquet(path)
    runs = _drained(spark, jobs.interval_runs_block(readers.read_stream_blocks(spark, path, e.schema), 20, backfill=100, live_from=last // 2))
    return jobs.run_ticks(runs, "block_number").where(F.col("account") >= 0).where(F.col("block_number") <= last).select("account", "block_number", F.col("balance").cast("string").alias("balance"))


@query(f"with {_B}, m as (select max(number) // 2 as half from blocks) select number from blocks, m where case when number < half then number % 100 = 0 else number % 10 = 0 end")
def t7_interval_trigger_block(spark, d):
    blocks = R.blocks(spark, d)
    half = blocks.agg(F.max("number")).first()[0] // 2
    return jobs.interval_blocks(blocks, 10, backfill=100, live_from=half).select("number")


@query(f"with {_F} select distinct s.id from swaps s where pair in (select pair from made)")
def t8_factory_stream(spark, d):
    registry, out = new_path(spark, "registry"), new_path(spark, "swaps")
    logs = _raw("factory_logs", R.factory_logs, spark, d)
    path = new_path(spark, "t8")
    # Creations come first, as the stream takes files in order of their time.
    is_swap = F.col("topics").startswith(schemas.EVENTS["Swap"][0])
    for rows in (logs.where(~is_swap), logs.where(is_swap)):
        rows.write.mode("append").option("compression", "zstd").parquet(path)
    stream = readers.read_stream_blocks(spark, path, logs.schema)
    jobs.run_bounded(stream, jobs.factory_batch(registry, out), new_path(spark, "t8-state"))
    return sinks.read_table(spark, out).select("id")


@query("select distinct l_orderkey as id from lineitem join orders on l_orderkey = o_orderkey where cast(l_shipdate as timestamp) between cast(o_orderdate as timestamp) and cast(o_orderdate as timestamp) + interval 60 day")
def t8_two_streams(spark, d):
    """Orders as creations and their lines as events, each a stream of its own; lines within 60 days of their order."""
    created = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("pair"), F.col("o_orderdate").cast("timestamp").alias("at"))
    lines = R.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("address"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").cast("timestamp").alias("at"))
    found = jobs.factory_stream(_stream(spark, created), _stream(spark, lines), "60 days", "4000 days")
    return _drained(spark, found).select(F.col("address").alias("id")).distinct()


def _arrivals(spark, d) -> DataFrame:
    e = R.table(spark, d, "events")
    return e.select(F.col("event_type").alias("account"), F.col("event_id").cast("string").alias("id"), F.pmod(F.col("event_id") * 7919, F.lit(1000)).alias("block_number"), F.col("event_id").alias("arrival"))


@query("select event_type as account, cast(event_id as varchar) as id, event_id * 7919 % 1000 as block_number, coalesce(max(event_id * 7919 % 1000) over (partition by event_type order by event_id rows between unbounded preceding and 1 preceding) > event_id * 7919 % 1000, false) as is_late from events")
def t9_late_flag(spark, d):
    path = new_path(spark, "t9")
    arrivals = _arrivals(spark, d)
    # Many files in falling order of arrival, all in one micro-batch.
    arrivals.repartitionByRange(16, F.desc("arrival")).sortWithinPartitions(F.desc("arrival")).write.parquet(path)
    return _drained(spark, jobs.late_flag(readers.read_stream_blocks(spark, path, arrivals.schema, files_per_batch=10**6)))


@query("select event_id from events")
def t10_stream_dedup(spark, d):
    """Every event twice, in different micro-batches."""
    e = R.table(spark, d, "events").select("event_id", F.timestamp_seconds(F.unix_timestamp("ts")).alias("at"))
    return _drained(spark, jobs.stream_dedup(_stream(spark, e.union(e)), ["event_id"], "at", "4000 days")).select("event_id")


@query("select user_id, count(*) as n from events group by 1")
def t11_read_your_writes(spark, d):
    """Each micro-batch adds to the counts that those before it wrote."""
    path = new_path(spark, "t11")

    def add(batch: DataFrame, table: DataFrame | None) -> DataFrame:
        new = batch.groupBy("user_id").agg(F.count("*").alias("n"))
        return new if table is None else new.join(table.withColumnRenamed("n", "old"), "user_id", "left").select("user_id", (F.col("n") + F.coalesce("old", F.lit(0))).alias("n"))

    stream = _stream(spark, R.table(spark, d, "events").select("event_id", "user_id"))
    handle = jobs.read_your_writes(path, ["user_id"], add)

    def twice(batch: DataFrame, batch_id: int) -> None:
        """Every micro-batch comes again, as after a failure."""
        handle(batch, batch_id)
        handle(batch, batch_id)

    jobs.run_bounded(stream, twice, new_path(spark, "t11-state"))
    return sinks.read_table(spark, path)
