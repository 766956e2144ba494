"""Registered queries of the analytics operators, each with its SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.functions import u256
from ledgerloom.functions.abi import decode_call, decode_log
from ledgerloom.operators import aggregates as A
from ledgerloom.operators import joins as J
from ledgerloom.operators import windows as W
from ledgerloom.plans import ledger as L
from ledgerloom.plans import reconcile as N
from ledgerloom.plans import renditions as R
from ledgerloom.session import new_path, shared_dir
from ledgerloom.sources.readers import scan_traces
from ledgerloom.sources.sinks import distribution

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_Z = "'0x0000000000000000000000000000000000000000'"
_T = f"""transfers as (
  select concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) as id,
         case when l_returnflag = 'R' then {_Z} else '0x' || printf('%040x', l_suppkey) end as from_addr,
         '0x' || printf('%040x', case when l_linenumber % 2 = 0 then l_partkey + 1000000 else (l_suppkey * 7 + 1) % 100 end) as to_addr,
         cast(round(l_extendedprice * 100) as bigint) as value,
         date_diff('day', date '1995-01-01', cast(l_shipdate as date)) as block_number,
         cast(epoch(l_shipdate) as bigint) as ts
  from lineitem)"""
_S = (
    _T
    + f""", sides as (
  select id || '_f' as id, from_addr as account, -1 as sign, -value as delta, 0 as mint, block_number, ts from transfers
  union all
  select id || '_t', to_addr, 1, value, case when from_addr = {_Z} then value else 0 end, block_number, ts from transfers),
accounts as (select * from sides where account <> {_Z})"""
)
_G = (
    _S
    + """, grouped as (select account, ts, sum(delta) as delta, sum(mint) as mint, max(block_number) as block_number from accounts group by 1, 2),
running as (select *, sum(delta) over w as balance, sum(mint) over w as mint_amount, lag(ts) over (partition by account order by ts) as old_ts from grouped
            window w as (partition by account order by ts rows unbounded preceding)),
previous as (select *, lag(balance) over (partition by account order by ts) as old_balance from running),
snaps as (select *, sum(coalesce(cast(old_balance as decimal(24,0)) * cast(ts - old_ts as decimal(12,0)), 0)) over (partition by account order by ts rows unbounded preceding) as unit_seconds from previous)"""
)
_B = """blocks as (select distinct l_orderkey as number, '0x' || md5(cast(l_orderkey as varchar)) as hash,
  '0x' || md5(cast(l_orderkey - 1 as varchar)) as parent_hash, l_orderkey * 12 + 1700000000 as timestamp from lineitem)"""
_X = """tx as (select '0x' || md5(cast(o_orderkey as varchar)) as hash, '0x' || printf('%040x', o_custkey) as from_address,
  case when o_orderpriority <> '1-URGENT' then '0x' || printf('%040x', o_custkey + 5000000) end as to_address, o_orderkey as block_number,
  cast(round(o_totalprice * 100) as hugeint) * 1000000000 as gas_price from orders),
receipts as (select '0x' || md5(cast(o_orderkey as varchar)) as hash, cast(21000 + o_custkey as hugeint) as gas_used,
  case when o_orderstatus <> 'P' then cast(round(o_totalprice * 100) as hugeint) * 1000000001 end as effective_gas_price from orders where o_orderkey % 50 <> 0)"""
_C = """calls as (select concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) as id, '0x' || md5(cast(l_orderkey as varchar)) as transaction_hash,
  '0x' || printf('%040x', l_suppkey) as caller, l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint) as amount_in,
  cast(round(l_extendedprice * 100) as bigint) as amount_out_min, cast(epoch(l_shipdate) as bigint) as deadline,
  date_diff('day', date '1995-01-01', cast(l_shipdate as date)) as block_number,
  list_transform(range(1, l_linenumber % 3 + 3), lambda i: '0x' || printf('%040x', l_partkey + i)) as path
  from lineitem), whole as (select * from calls where l_orderkey % 17 <> 0)"""
_E = """plat_a as (select event_id as id, user_id as usr, event_type as kind, value, cast(epoch(date_trunc('second', ts)) as bigint) as ts from events where event_id % 10 <> 0),
plat_b as (select event_id as id, user_id as usr, event_type as kind, case when event_id % 11 = 0 then value + 1 else value end as value, cast(epoch(date_trunc('second', ts)) as bigint) as ts from events where event_id % 7 <> 0),
plat_c as (select event_id as id, user_id as usr, upper(event_type) as kind, value, cast(epoch(date_trunc('second', ts)) as bigint) as ts from events),
tagged as (select 'a' as platform, * from plat_a union all select 'b', * from plat_b union all select 'c', * from plat_c)"""
_F = """made as (select '0x' || printf('%040x', o_orderkey + 9000000) as pair, '0x' || printf('%040x', o_custkey) as token0, '0x' || printf('%040x', o_custkey + 1) as token1,
  date_diff('day', date '1995-01-01', cast(o_orderdate as date)) as created_at from orders where o_orderstatus <> 'F'),
swaps as (select concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) as id, '0x' || printf('%040x', l_orderkey + 9000000) as pair,
  '0x' || printf('%040x', l_suppkey) as sender, cast(cast(l_quantity as bigint) as varchar) as amount0_in, '0' as amount1_in, '0' as amount0_out,
  cast(cast(round(l_extendedprice * 100) as bigint) as varchar) as amount1_out, '0x' || printf('%040x', l_partkey) as to_addr,
  date_diff('day', date '1995-01-01', cast(l_shipdate as date)) as block_number, l_linenumber as log_index from lineitem)"""


_STORED: dict[tuple, str] = {}


def _raw_path(name: str, make: Callable[[SparkSession, str], DataFrame], spark: SparkSession, d: str) -> str:
    """A derived raw table as stored Parquet, so that jobs scan it as they would chain data.

    Built once per session and folder, from rows that are dealt evenly before
    they widen (see renditions), so nothing as wide as the table is shuffled.
    """
    key = (spark.sparkContext.applicationId, shared_dir(spark), d, name)
    if key not in _STORED:
        path = new_path(spark, f"raw-{name}")
        make(spark, d).write.option("compression", "zstd").parquet(path)
        _STORED[key] = path
    return _STORED[key]


def _raw(name: str, make: Callable[[SparkSession, str], DataFrame], spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(_raw_path(name, make, spark, d))


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# -- decoding ------------------------------------------------------------------


@query(f"with {_T} select id, from_addr, to_addr, cast(value as varchar) as value, block_number, ts as block_timestamp, '0x' || md5(id) as transaction_hash from transfers where block_number between 100 and 2000")
def l1_transfers_job(spark, d):
    return L.transfers_job(_raw("logs", R.logs, spark, d), 100, 2000)


@query(f"with {_T} select 'Transfer' as event_signature, from_addr as p1, to_addr as p2, cast(value as varchar) as p3, count(*) as n from transfers group by all")
def d1_decode_log(spark, d):
    p = F.col("decoded.event_params")
    decoded = decode_log(_raw("logs", R.logs, spark, d))
    return decoded.groupBy(F.col("decoded.event_signature").alias("event_signature"), *[F.element_at(p, k).alias(f"p{k}") for k in (1, 2, 3)]).agg(F.count("*").alias("n"))


@query(f"with {_C} select id, cast(amount_in as varchar) as i1, cast(amount_out_min as varchar) as i2, '[\"' || array_to_string(path, '\",\"') || '\"]' as i3, caller as i4, cast(deadline as varchar) as i5 from whole")
def d2_decode_call(spark, d):
    decoded = decode_call(_raw("calls", R.calls, spark, d), R.SWAP_SELECTOR, ["uint256", "uint256", "address[]", "address", "uint256"]).where("decoded is not null")
    return decoded.select("id", *[F.col("decoded.inputs")[k].alias(f"i{k + 1}") for k in range(5)])


@query(f"with {_C} select count(*) as n, count(distinct caller) as senders, min(block_number) as lo, max(block_number) as hi from calls where block_number between 500 and 1500")
def s5_scan_traces(spark, d):
    kept = scan_traces(spark, _raw_path("calls", R.calls, spark, d), None, 500, 1500, selector=R.SWAP_SELECTOR)
    return kept.agg(F.count("*").alias("n"), F.count_distinct("from_address").alias("senders"), F.min("block_number").alias("lo"), F.max("block_number").alias("hi"))


@query(f"with {_C} select '0x38ed1739' as selector, count(*) as n from calls")
def d11_selectors(spark, d):
    return _raw("calls", R.calls, spark, d).groupBy(C.method_selector(F.col("input")).alias("selector")).agg(F.count("*").alias("n"))


@query(
    f"with {_C}, {_X} select w.transaction_hash || '-' || concat_ws('-', l_linenumber, l_partkey, l_suppkey) as id, w.block_number, w.transaction_hash,"
    " coalesce(t.from_address, caller, '') as from_addr, caller, caller as to_addr, cast(amount_in as varchar) as amount_in, cast(amount_out_min as varchar) as amount_out_min,"
    " cast(deadline as varchar) as deadline, array_to_string(path, ',') as path, len(path) as path_length from whole w left join tx t on w.transaction_hash = t.hash where len(path) >= 2"
)
def l11_router_swaps(spark, d):
    return L.router_swaps_job(_raw("calls", R.calls, spark, d), R.transactions(spark, d))


# -- ledger -----------------------------------------------------------------------


@query(f"with {_S} select id, account, sign, delta, mint, block_number, ts from sides")
def u2_signed_sides(spark, d):
    return W.signed_sides(R.transfers(spark, d))


@query(f"with {_S} select distinct account from sides")
def u3_distinct_accounts(spark, d):
    return W.distinct_accounts(W.both_sides(R.transfers(spark, d)))


@query(f"with {_S} select id, account, cast(delta as decimal(38,0)) as delta, cast(sum(delta) over (partition by account order by ts, block_number, id rows unbounded preceding) as decimal(38,0)) as balance, block_number, ts from accounts")
def l2_balance_history(spark, d):
    return L.balance_history(R.transfers(spark, d))


@query(f"with {_S} select account, cast(sum(delta) as decimal(38,0)) as balance, max(block_number) as last_block, max(ts) as last_ts from accounts group by 1")
def l3_current_balances(spark, d):
    return L.current_balances(R.transfers(spark, d))


@query(f"with {_G} select account, ts, cast(balance as decimal(38,0)) as balance, cast(mint_amount as decimal(38,0)) as mint_amount, cast(unit_seconds as decimal(38,0)) as unit_seconds from snaps")
def l4_account_snapshots(spark, d):
    return L.account_snapshots(R.transfers(spark, d)).drop("id", "points")


@query(
    f"with {_G} select account, coalesce(old_ts, 0) as old_ts, cast(coalesce(old_balance, 0) as decimal(38,0)) as old_balance, ts as new_ts, cast(balance as decimal(38,0)) as new_balance,"
    " cast(coalesce(cast(old_balance as decimal(24,0)) * cast(ts - old_ts as decimal(12,0)), 0) as decimal(38,0)) as added, 'transfer' as trigger from previous"
)
def l5_point_updates(spark, d):
    return L.point_updates(R.transfers(spark, d))


_TICKS = 90 * 86400
_UNTIL = 1072915200


@query(
    f"with {_G}, seen as (select account, min(ts) as first_ts from grouped group by 1),"
    f" every_tick as (select account, unnest(range((first_ts // {_TICKS} + 1) * {_TICKS}, {_UNTIL} + 1, {_TICKS})) as ts from seen where (first_ts // {_TICKS} + 1) * {_TICKS} <= {_UNTIL}),"
    " merged as (select account, ts, sum(delta) as delta, sum(mint) as mint, min(tick) as tick from (select account, ts, delta, mint, 0 as tick from grouped union all select account, ts, 0, 0, 1 from every_tick) group by 1, 2),"
    " run2 as (select *, sum(delta) over (partition by account order by ts rows unbounded preceding) as balance, sum(mint) over (partition by account order by ts rows unbounded preceding) as mint_amount, lag(ts) over (partition by account order by ts) as old_ts from merged),"
    " prev2 as (select *, lag(balance) over (partition by account order by ts) as old_balance from run2)"
    " select account, ts, cast(balance as decimal(38,0)) as balance, cast(mint_amount as decimal(38,0)) as mint_amount,"
    " cast(sum(coalesce(cast(old_balance as decimal(24,0)) * cast(ts - old_ts as decimal(12,0)), 0)) over (partition by account order by ts rows unbounded preceding) as decimal(38,0)) as unit_seconds,"
    " case when tick = 1 then 'tick' else 'transfer' end as trigger from prev2"
)
def l6_snapshots_with_ticks(spark, d):
    return L.snapshots_with_ticks(R.transfers(spark, d), _TICKS, _UNTIL)


@query(
    f"with {_S}, calendar as (select distinct block_number, ts from transfers), at_block as (select account, block_number, max(ts) as ts, sum(delta) as delta, sum(mint) as mint, 0 as tick from accounts group by 1, 2),"
    " seen as (select account, min(block_number) as first from accounts group by 1),"
    " ticks as (select account, c.block_number, c.ts, 0 as delta, 0 as mint, 1 as tick from seen join calendar c on c.block_number > first where case when c.block_number < 365 then c.block_number % 90 = 0 else c.block_number % 30 = 0 end),"
    " merged as (select account, block_number, max(ts) as ts, sum(delta) as delta, sum(mint) as mint, min(tick) as tick from (select * from at_block union all select * from ticks) group by 1, 2),"
    " run3 as (select *, sum(delta) over w as balance, sum(mint) over w as mint_amount, lag(ts) over (partition by account order by block_number) as old_ts from merged window w as (partition by account order by block_number rows unbounded preceding)),"
    " prev3 as (select *, lag(balance) over (partition by account order by block_number) as old_balance from run3)"
    " select account, block_number, ts, cast(balance as decimal(38,0)) as balance, cast(mint_amount as decimal(38,0)) as mint_amount,"
    " cast(sum(coalesce(cast(old_balance as decimal(24,0)) * cast(ts - old_ts as decimal(12,0)), 0)) over (partition by account order by block_number rows unbounded preceding) as decimal(38,0)) as unit_seconds,"
    " case when tick = 1 then 'tick' else 'transfer' end as trigger from prev3"
)
def l6_snapshots_at_blocks(spark, d):
    """Every 90th block before block 365, every 30th from it on; the calendar is that of the transfers."""
    transfers = R.transfers(spark, d)
    calendar = transfers.select(F.col("block_number").alias("number"), F.col("ts").alias("timestamp")).distinct()
    last = calendar.agg(F.max("number")).first()[0]
    return L.snapshots_at_blocks(transfers, calendar, 30, last, backfill=90, live_from=365)


@query(
    f"with {_S}, starts as (select account, sum(delta) as balance from accounts where block_number <= 365 group by 1),"
    " parts as (select account, cast(delta as decimal(24,0)) * cast(1747451507 - ts as decimal(13,0)) as moved, cast(0 as decimal(38,0)) as held from accounts"
    " union all select account, 0, cast(balance as decimal(24,0)) * 1215588 from starts)"
    " select account, cast(sum(moved) as decimal(38,0)) as moved, cast(max(held) as decimal(38,0)) as held from parts group by 1"
)
def l7_points_closed_form(spark, d):
    t = R.transfers(spark, d)
    starts = L.sides_of_accounts(t).where("block_number <= 365").groupBy("account").agg(F.sum("delta").alias("balance"))
    return L.points_closed_form(t, starts)


@query(
    f"with {_S}, history as (select account, block_number, cast(max_by(balance, seq) as decimal(38,0)) as balance from (select *, row_number() over w as seq, sum(delta) over (partition by account order by ts, block_number, id rows unbounded preceding) as balance from accounts window w as (partition by account order by ts, block_number, id)) group by 1, 2),"
    " wanted as (select distinct account, unnest([300, 900, 1500]) as block_number from sides)"
    " select w.account, cast(w.block_number as bigint) as block_number, coalesce(h.balance, 0) as balance from wanted w asof left join history h on w.account = h.account and w.block_number >= h.block_number"
)
def j7_balance_asof(spark, d):
    t = R.transfers(spark, d)
    history = L.balance_history(t).groupBy("account", "block_number").agg(F.max_by("balance", F.struct("ts", "id")).alias("balance"))
    wanted = W.distinct_accounts(W.both_sides(t)).select("account", F.explode(F.array(*[F.lit(b).cast("long") for b in (300, 900, 1500)])).alias("block_number"))
    return J.balance_asof(wanted, history)


@query(f"with {_S} select account, round(case when sum(delta) <= 0 then 0 else sqrt(sum(delta) / 1e8) end, 6) as points from accounts group by 1")
def l8_sqrt_points(spark, d):
    balances = L.current_balances(R.transfers(spark, d))
    return balances.select("account", F.round(C.sqrt_points(F.col("balance").cast("double")), 6).alias("points"))


@query(f"with {_S} select id, account, block_number, coalesce(max(block_number) over (partition by account order by id, block_number rows between unbounded preceding and 1 preceding) > block_number, false) as is_late from accounts")
def w8_out_of_order(spark, d):
    return W.out_of_order(L.sides_of_accounts(R.transfers(spark, d)), "account", ["id", "block_number"], "block_number").select("id", "account", "block_number", "is_late")


# -- blocks, transactions, factory ---------------------------------------------------


@query(f"with {_B} select cast(number as varchar) as id, number, hash, parent_hash, timestamp from blocks where number between (select max(number) // 10 from blocks) and (select max(number) from blocks)")
def l9_blocks_job(spark, d):
    """From a tenth of the highest number on."""
    blocks = R.blocks(spark, d)
    most = blocks.agg(F.max("number")).first()[0]
    return L.blocks_job(blocks, most // 10, most)


@query(
    f"with {_X} select t.hash as id, from_address as sender, coalesce(to_address, {_Z}) as recipient, cast(gas_used * coalesce(effective_gas_price, gas_price) as varchar) as gas_value,"
    " cast(gas_used as varchar) as gas_used, block_number from tx t join receipts r on t.hash = r.hash"
)
def l10_gas_job(spark, d):
    return L.gas_job(J.tx_receipt_join(R.transactions(spark, d), R.receipts(spark, d)))


@query(f"with {_X} select cast(sum(gas_used * coalesce(effective_gas_price, gas_price)) as varchar) as total, count(*) as n, count(distinct from_address) as senders from tx t join receipts r on t.hash = r.hash")
def a5_gas_totals(spark, d):
    gas = L.gas_job(J.tx_receipt_join(R.transactions(spark, d), R.receipts(spark, d)))
    return gas.agg(u256.decimal_sum(F.col("gas_value")).alias("total"), F.count("*").alias("n"), F.count_distinct("sender").alias("senders"))


@query(f"with {_T} select from_addr, cast(sum(value) as varchar) as total from transfers group by 1")
def a5_u256_sum(spark, d):
    logs = _raw("logs", R.logs, spark, d)
    return logs.groupBy(C.topic_to_address(F.split_part("topics", F.lit(","), F.lit(2))).alias("from_addr")).agg(u256.u256_sum(F.col("data")).alias("total"))


@query(f"with {_F} select pair, token0, token1, '0x{'ef' * 20}' as factory, created_at, 0::bigint as created_log_index from made")
def l12_pairs_job(spark, d):
    return L.pairs_job(_raw("factory_logs", R.factory_logs, spark, d))


@query(f"with {_F} select s.id, s.pair, sender, amount0_in, amount1_in, amount0_out, amount1_out, to_addr, block_number, cast(log_index as bigint) as log_index from swaps s join made m on s.pair = m.pair and (s.block_number > m.created_at or (s.block_number = m.created_at and s.log_index >= 0))")
def l13_pair_swaps(spark, d):
    return L.pair_swaps_job(_raw("factory_logs", R.factory_logs, spark, d))


@query(f"with {_F} select s.pair, token0, token1, count(*) as n from swaps s join made m on s.pair = m.pair group by all")
def j3_attach_parent(spark, d):
    logs = _raw("factory_logs", R.factory_logs, spark, d)
    swaps = J.factory_semi_join(logs.where(F.col("topics").startswith(R.EVENTS["Swap"][0])), L.pairs_job(logs)).withColumnRenamed("address", "pair")
    return J.attach_parent(swaps, L.pairs_job(logs)).groupBy("pair", "token0", "token1").agg(F.count("*").alias("n"))


@query(f"with {_B}, n as (select number, lead(number) over (order by number) as next from blocks) select number + 1 as start, next - 1 as stop, next - number - 1 as length from n where next - number > 1")
def w9_gaps(spark, d):
    return W.gaps(R.blocks(spark, d), "number")


@query(f"with {_B}, m as (select max(number) as most from blocks), buckets as (select start, least(start + 499, (select most from m)) as stop from (select unnest(range(0, (select most + 1 from m), 500)) as start)), k as (select number // 500 * 500 as start, count(*) as n from blocks group by 1) select b.start, b.stop, coalesce(k.n, 0) as n from buckets b left join k on k.start = b.start")
def a13_bucket_histogram(spark, d):
    blocks = R.blocks(spark, d)
    return A.bucket_histogram(blocks, "number", 500, 0, blocks.agg(F.max("number")).first()[0])


@query(f"with {_B} select min(number) as min_block, max(number) as max_block, count(number) as n, max(number) - min(number) + 1 as span from blocks")
def a3_block_range(spark, d):
    return A.block_range(R.blocks(spark, d), "number")


@query(
    f"with {_B}, tagged as (select 'x' as platform, number from blocks union all select 'y', number from blocks where number < (select max(number) // 3 from blocks)), k as (select platform, count(distinct number) as found, max(number) - min(number) + 1 as span, (select max(number) + 1 from blocks) as expected from tagged group by 1)"
    " select platform, found, expected, round(found * 100.0 / expected, 4)::double as percent, case when found = expected then 'complete' when found < span then 'partial with gaps' else 'partial without gaps' end as pattern from k"
)
def a14_coverage(spark, d):
    b = R.blocks(spark, d)
    most = b.agg(F.max("number")).first()[0]
    tagged = b.select(F.lit("x").alias("platform"), "number").union(b.where(F.col("number") < most // 3).select(F.lit("y"), "number"))
    return A.coverage(tagged, "number", 0, most, "platform")


@query(f"with {_C}, tokens as (select unnest(path) as token from whole), n as (select token, count(*) as n from tokens group by 1) select token, n, round(n * 100.0 / (select sum(n) from n), 4)::double as share from n order by n desc, token limit 5")
def a10_top_tokens(spark, d):
    swaps = L.router_swaps_job(_raw("calls", R.calls, spark, d), R.transactions(spark, d))
    return W.share_of_total(A.token_stats(swaps)).orderBy(F.desc("n"), "token").limit(5)


@query(f"with {_C}, per as (select transaction_hash, count(*) as n, count(distinct id) as keys from whole group by 1) select cast(sum(n) as bigint) as records, count(*) as transactions, count(*) filter (where keys > 1) as multi, max(keys) as most, round(sum(keys) / count(*), 6) as mean, cast(sum(keys) as bigint) as distinct_keys from per")
def a12_traces_per_tx(spark, d):
    return A.traces_per_tx(L.router_swaps_job(_raw("calls", R.calls, spark, d), R.transactions(spark, d)), "transaction_hash", "id")


@query(f"with {_C} select transaction_hash, id, row_number() over (partition by transaction_hash order by id) as seq from calls")
def w6_seq_in_tx(spark, d):
    return W.seq_in_tx(_raw("calls", R.calls, spark, d), "transaction_hash", ["id"]).select("transaction_hash", "id", "seq")


@query(
    f"with {_B}, m as (select max(number) * 3 as hi from blocks) select number, hash, parent_hash, timestamp, false as is_generated from blocks"
    " union all select n, '0x' || sha256(cast(n as varchar)), '0x' || sha256(cast(n - 1 as varchar)), n * 15 + 1438269988, true from (select unnest(range(0, (select hi + 1 from m))) as n)"
    " where (select count(*) from blocks) * 100 < 50 * (select hi + 1 from m) and n not in (select number from blocks)"
)
def l14_fill_missing_blocks(spark, d):
    """Up to three times the highest number, so that fewer than half of the blocks came."""
    blocks = R.blocks(spark, d)
    return L.fill_missing_blocks(blocks, 0, blocks.agg(F.max("number")).first()[0] * 3)


# -- reconciliation -------------------------------------------------------------------


def _platforms(spark, d) -> DataFrame:
    out = None
    for name in R.PLATFORMS:
        df = N.canonicalize(R.platform(spark, d, name), "event")
        df = df.select(F.lit(name).alias("platform"), "id", F.col("user").alias("usr"), "kind", "value", C.epoch_seconds(F.col("timestamp")).alias("ts"))
        out = df if out is None else out.union(df)
    return out


def _one(spark, d, name) -> DataFrame:
    return _platforms(spark, d).where(F.col("platform") == name).drop("platform")


@query(f"with {_E} select platform, id, usr, kind, value, ts from tagged")
def n1_canonicalize(spark, d):
    return _platforms(spark, d)


def _overlap_sql(key: str) -> str:
    return (
        f"with {_E}, keys as (select distinct platform, {key} as key from tagged where {key} is not null), masks as (select key, bool_or(platform = 'a') as a, bool_or(platform = 'b') as b, bool_or(platform = 'c') as c from keys group by 1),"
        " pairs as (select 'a' as platform_a, 'b' as platform_b, a as x, b as y from masks union all select 'a', 'c', a, c from masks union all select 'b', 'c', b, c from masks)"
        " select platform_a, platform_b, count(*) filter (where x and y) as common, count(*) filter (where x and not y) as only_a, count(*) filter (where y and not x) as only_b,"
        " round(count(*) filter (where x and y) / count(*) filter (where x or y), 6)::double as jaccard from pairs group by 1, 2"
    )


@query(_overlap_sql("id"))
def n4_pairwise_overlap(spark, d):
    return N.pairwise_overlap(_platforms(spark, d), "id", R.PLATFORMS)


@query(_overlap_sql("lower(cast(id as varchar)) || ':' || lower(kind) || ':' || lower(cast(cast(round(value * 100) as bigint) as varchar))"))
def n3_fingerprint_overlap(spark, d):
    keyed = _platforms(spark, d).withColumn("key", C.fingerprint(F.col("id"), F.col("kind"), F.round(F.col("value") * 100).cast("long")))
    return N.pairwise_overlap(keyed, "key", R.PLATFORMS)


@query(
    f"with {_E}, j as (select a.usr = b.usr as u, a.kind = b.kind as k, a.value = b.value as v from plat_a a join plat_b b using (id)), m as (select 'usr' as field, count(*) filter (where u) as matches, count(*) as n from j union all select 'kind', count(*) filter (where k), count(*) from j union all select 'value', count(*) filter (where v), count(*) from j)"
    " select field, matches, n - matches as mismatches, printf('%.2f', matches * 100.0 / n) || '%' as percent from m"
)
def n5_field_match(spark, d):
    return N.field_match(_one(spark, d, "a"), _one(spark, d, "b"), "id", ["usr", "kind", "value"])


@query(
    f"with {_E}, j as (select a.id, a.kind <> c.kind as k, not (a.value = c.value or coalesce(abs((a.value - c.value) / nullif(abs(a.value) + abs(c.value) / 2, 0)) < 1e-4, false)) as v from plat_b a join plat_c c using (id))"
    " select count(*) as common, count(*) filter (where not k and not v) as identical, count(*) filter (where k) as kinds, count(*) filter (where v) as vals from j"
)
def n6_tolerant_diff(spark, d):
    diff = N.tolerant_diff(_one(spark, d, "b"), _one(spark, d, "c"), "id", {"kind": False, "value": True})
    has = lambda f: F.count_if(F.array_contains("differs", f))
    return diff.agg(F.count("*").alias("common"), F.count_if(F.size("differs") == 0).alias("identical"), has("kind").alias("kinds"), has("value").alias("vals"))


@query(f"with {_E} select a.id, a.value as value_a, b.value as value_b from plat_a a join plat_b b using (id) where a.value is distinct from b.value")
def n8_value_diff(spark, d):
    return N.value_diff(_one(spark, d, "a"), _one(spark, d, "b"), "id", "value")


@query(f"with {_E} select id, 'a' as only_in from plat_a where id not in (select id from plat_b) union all select id, 'b' from plat_b where id not in (select id from plat_a)")
def n12_missing(spark, d):
    return N.missing_pairs(_one(spark, d, "a"), _one(spark, d, "b"), "id").select("id", "only_in")


def _points(spark, d) -> DataFrame:
    return _platforms(spark, d).groupBy("platform", "usr").agg(F.sum(F.round(F.col("value") * 100).cast("long")).cast("double").alias("points"))


_WIDE = (
    f"with {_E}, w as (select usr, coalesce(sum(case when platform = 'a' then cast(round(value * 100) as bigint) end), 0)::double as a,"
    " coalesce(sum(case when platform = 'b' then cast(round(value * 100) as bigint) end), 0)::double as b,"
    " coalesce(sum(case when platform = 'c' then cast(round(value * 100) as bigint) end), 0)::double as c from tagged group by 1),"
    " p as (select 'a' as platform_a, 'b' as platform_b, a as x, b as y from w where a <> 0 or b <> 0 union all select 'a', 'c', a, c from w where a <> 0 or c <> 0 union all select 'b', 'c', b, c from w where b <> 0 or c <> 0)"
)


@query(_WIDE + " select platform_a, platform_b, round(corr(ln(x + 1), ln(y + 1)), 6) as r from p group by 1, 2")
def n10_pearson(spark, d):
    return N.pearson_matrix(_points(spark, d), "usr", R.PLATFORMS)


@query(
    _WIDE + ", r as (select *, rank() over (partition by platform_a, platform_b order by x) + (count(*) over (partition by platform_a, platform_b, x) - 1) / 2 as rx,"
    " rank() over (partition by platform_a, platform_b order by y) + (count(*) over (partition by platform_a, platform_b, y) - 1) / 2 as ry from p)"
    " select platform_a, platform_b, round(corr(rx, ry), 6) as r from r group by 1, 2"
)
def n11_spearman(spark, d):
    return N.spearman_matrix(_points(spark, d), "usr", R.PLATFORMS)


@query(f"with {_E}, v as (select platform, usr, sum(cast(round(value * 100) as bigint))::double as points from tagged group by 1, 2) select platform, usr, rank() over (order by points) + (count(*) over (partition by points) - 1) / 2 as rank from v")
def w7_average_rank(spark, d):
    return W.average_rank(_points(spark, d), "points").select("platform", "usr", F.col("rank").cast("double").alias("rank"))


@query(f"with {_E} select platform, count(*) as n, true as loaded from tagged group by 1 union all select 'd', 0, false")
def a1_row_counts(spark, d):
    names = spark.createDataFrame([(p,) for p in [*R.PLATFORMS, "d"]], "platform string")
    return A.row_counts(_platforms(spark, d), names)


@query(f"with {_E} select platform, count(distinct usr) as unique_usr, count(distinct kind) as unique_kind from tagged group by 1")
def a2_unique_counts(spark, d):
    return A.unique_counts(_platforms(spark, d), "platform", ["usr", "kind"])


@query(f"with {_E} select platform, min(ts) as min_time, max(ts) as max_time from tagged where ts <> 0 group by 1")
def a4_time_range(spark, d):
    return A.time_range(_platforms(spark, d), F.col("ts"), ["platform"])


@query("with n as (select event_type, count(*) as n from events group by 1) select event_type, n, round(n * 100.0 / (select sum(n) from n), 4)::double as share from n order by n desc, event_type limit 3")
def a9_top_k(spark, d):
    return A.top_k(R.table(spark, d, "events"), "event_type", 3)


@query(f"with {_E}, c as (select platform, count(*) as actual from tagged group by 1), e(platform, expected) as (select p, (select count(*) from events) from (select unnest(['a', 'b', 'c', 'd']) as p)) select e.platform, expected, coalesce(actual, 0) as actual, round(coalesce(actual, 0) * 100.0 / expected, 4)::double as percent, case when coalesce(actual, 0) >= expected then 'complete' when round(coalesce(actual, 0) * 100.0 / expected, 4) >= 98 then 'near' else 'incomplete' end as status from e left join c using (platform)")
def n14_completeness(spark, d):
    names = spark.createDataFrame([(p,) for p in [*R.PLATFORMS, "d"]], "platform string")
    expected = names.join(R.table(spark, d, "events").agg(F.count("*").alias("expected")))
    counts = _platforms(spark, d).groupBy("platform").agg(F.count("*").alias("actual"))
    return N.completeness(counts, expected, "platform")


@query(f"with {_E} select lower(kind) as metric, count(*) filter (where platform = 'a') as a, count(*) filter (where platform = 'b') as b, count(*) filter (where platform = 'c') as c from tagged group by 1")
def n15_coverage_matrix(spark, d):
    counts = _platforms(spark, d).groupBy("platform", F.lower("kind").alias("metric")).agg(F.count("*").alias("n"))
    return N.coverage_matrix(counts, R.PLATFORMS)


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def w1_latest_per_key(spark, d):
    return W.latest_per_key(R.table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("select user_id, event_type, event_id, n - 1 as duplicates from (select *, row_number() over (partition by user_id, event_type order by event_id) as rn, count(*) over (partition by user_id, event_type) as n from events) where rn = 1")
def u7_dedup(spark, d):
    keyed = R.table(spark, d, "events").withColumn("key", F.concat_ws("|", "user_id", "event_type"))
    return W.dedup(keyed, "key", ["event_id"]).select("user_id", "event_type", "event_id", "duplicates")


@query("select user_id, child_no, event_id from (select *, row_number() over (partition by user_id order by value desc, event_id) as child_no from events) where child_no <= 3 union all select user_id, null, null from (select distinct user_id from events) where false")
def j13_nested_children(spark, d):
    e = R.table(spark, d, "events")
    return J.nested_children(e.select("user_id").distinct(), e, "user_id", [F.desc("value"), "event_id"], 3).select("user_id", "child_no", "event_id")


@query("select event_id, user_id from events where event_id > 500 order by event_id limit 25")
def o3_keyset_page(spark, d):
    return W.keyset_page(R.table(spark, d, "events"), "event_id", 500, 25).select("event_id", "user_id")


@query("select event_id, user_id, value from events order by value desc, event_id limit 20 offset 40")
def o2_page(spark, d):
    return W.page(R.table(spark, d, "events"), [F.desc("value"), "event_id"], 20, 40).select("event_id", "user_id", "value")


@query("select cast(epoch(date_trunc('hour', ts)) as bigint) as start, count(*) as n, max(value) as most from events group by 1")
def a20_interval_gauge(spark, d):
    return A.interval_gauge(R.table(spark, d, "events"), "ts", "value")


# -- further aggregates, joins and sets over the same tables ---------------------------


@query("select sum(value) is not null as any_value, round(sum(coalesce(value, 0)), 2) as sum_value from events")
def a7_volume_sums(spark, d):
    sums = A.volume_sums(R.table(spark, d, "events"), ["value"])
    return sums.select(F.col("sum_value").isNotNull().alias("any_value"), F.round("sum_value", 2).alias("sum_value"))


@query(f"with {_X} select count(*) filter (where to_address is not null) as valid, count(*) filter (where to_address is null) as missing from tx")
def a11_null_key_counts(spark, d):
    return A.null_key_counts(R.transactions(spark, d), "to_address")


@query("select count(*) filter (where value > 50) as high, count(*) filter (where event_type = 'click') as clicks from events")
def a16_count_where(spark, d):
    return A.count_where(R.table(spark, d, "events"), high=F.col("value") > 50, clicks=F.col("event_type") == "click")


@query("select user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as seconds from events group by 1")
def a17_span(spark, d):
    return A.span(R.table(spark, d, "events"), "ts", ["user_id"])


@query("select event_type, count(*) as n, max(value) as most, min(value) as least from events where value < 90 group by 1")
def a18_run_summary(spark, d):
    return A.run_summary(R.table(spark, d, "events"), "event_type", "value", F.col("value") < 90).drop("mean")


@query(f"with {_S}, h as (select account, block_number, ts, id, cast(sum(delta) over (partition by account order by ts, block_number, id rows unbounded preceding) as decimal(38,0)) as balance from accounts) select account, max_by(balance, lpad(cast(block_number as varchar), 9, '0') || '|' || id) as balance from h where block_number <= 700 group by 1")
def j8_balance_at_start(spark, d):
    history = L.balance_history(R.transfers(spark, d))
    last = history.groupBy("account", "block_number").agg(F.max_by("balance", "id").alias("balance"))
    return J.balance_at_window_start(last, 700)


@query("select user_id, event_id, value from (select *, max(value) over (partition by user_id) as most from events) where value = most")
def j10_latest_by_max(spark, d):
    return J.latest_by_max_join(R.table(spark, d, "events"), "user_id", "value").select("user_id", "event_id", "value")


@query("select c_custkey, coalesce(arg_max(o_totalprice, (o_orderdate, o_orderkey)), 0) as o_totalprice from customer left join orders on c_custkey = o_custkey group by 1")
def j11_left_join_latest(spark, d):
    accounts = R.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    latest = J.left_join_latest(accounts, R.table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")
    return latest.select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")


@query(f"with {_E} select coalesce(a.id, b.id) as id, a.value as value_a, b.value as value_b from plat_a a full join plat_b b on a.id = b.id")
def j14_pairwise_full(spark, d):
    both = J.pairwise_full(_one(spark, d, "a"), _one(spark, d, "b"), "id")
    return both.select("id", F.col("a.value").alias("value_a"), F.col("b.value").alias("value_b"))


@query(f"with {_E} select 'both' as side, count(*) as n from (select id from plat_a intersect select id from plat_b) union all select 'a', count(*) from (select id from plat_a except select id from plat_b) union all select 'any', count(*) from (select id from plat_a union select id from plat_b)")
def u4_key_sets(spark, d):
    a, b = _one(spark, d, "a"), _one(spark, d, "b")
    sets = {"both": W.key_intersect(a, b, "id"), "a": W.key_except(a, b, "id"), "any": W.key_union([a, b], "id")}
    out = None
    for side, keys in sets.items():
        n = keys.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
        out = n if out is None else out.union(n)
    return out


@query(_overlap_sql("usr").replace(" select platform_a, platform_b,", " select platform_a, platform_b, (select count(*) from tagged where platform = platform_a) as rows_a, (select count(*) from tagged where platform = platform_b) as rows_b,"))
def n13_sender_overlap(spark, d):
    return N.sender_overlap(_platforms(spark, d), "usr", R.PLATFORMS)


@query(f"with {_E}, j as (select b.kind = c.kind and b.value = c.value as same from plat_b b join plat_c c using (id)) select count(*) as common, count(*) filter (where same) as identical, round(count(*) filter (where same) / count(*), 6) as similarity, round(count(*) / (select count(*) from (select id from plat_b union select id from plat_c)), 6) as jaccard from j")
def n7_content_similarity(spark, d):
    return N.content_similarity(_one(spark, d, "b"), _one(spark, d, "c"), "id", {"kind": False, "value": False})


@query(f"with {_E} select (ts // 86400) * 86400 as bucket, count(*) filter (where platform = 'a') as a, count(*) filter (where platform = 'b') as b, count(*) filter (where platform = 'c') as c from tagged group by 1")
def k9_distribution(spark, d):
    return distribution(_platforms(spark, d), (F.floor(F.col("ts") / 86400) * 86400).cast("long"), R.PLATFORMS)


@query(f"with {_B} select number, hash from blocks order by number desc limit 12")
def o5_latest_rows(spark, d):
    return W.latest_rows(R.blocks(spark, d), "number", 12, "hash").select("number", "hash")
