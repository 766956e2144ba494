"""Registered queries on ABI text: events, calls, nested types, templates."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.abi import decode_log, route_events
from ledgerloom.functions.contract_abi import call_table, decode_calls, event_table, parse_abi
from ledgerloom.plans import pipeline as X
from ledgerloom.plans import renditions as R
from ledgerloom.plans.templates import found_contracts, template_events
from ledgerloom.queries import _C, _F, _raw, query
from ledgerloom.session import written


def _entry(kind: str, name: str, inputs: list[tuple], outputs: list[tuple] = ()) -> dict:
    """An entry of ABI JSON from (name, type[, indexed or components])."""

    def told(part: tuple) -> dict:
        found = {"name": part[0], "type": part[1]}
        if len(part) > 2:
            found |= {"indexed": part[2]} if isinstance(part[2], bool) else {"components": [told(p) for p in part[2]]}
        return found

    return {"type": kind, "name": name, "anonymous": False, "inputs": [told(p) for p in inputs], "outputs": [told(p) for p in outputs]}


# The public interfaces of pairs, their factory and the router.
PAIRS = json.dumps(
    [
        _entry("event", "PairCreated", [("token0", "address", True), ("token1", "address", True), ("pair", "address", False), ("", "uint256", False)]),
        _entry("event", "Swap", [("sender", "address", True), ("amount0In", "uint256", False), ("amount1In", "uint256", False), ("amount0Out", "uint256", False), ("amount1Out", "uint256", False), ("to", "address", True)]),
    ]
)
ROUTER = json.dumps([_entry("function", "swapExactTokensForTokens", [("amountIn", "uint256"), ("amountOutMin", "uint256"), ("path", "address[]"), ("to", "address"), ("deadline", "uint256")], [("amounts", "uint256[]")])])

#: An interface with tuples and arrays in tuples.
ORDERS = json.dumps(
    [
        _entry("function", "submit", [("order", "tuple", [("buyer", "address"), ("lines", "tuple[]", [("part", "uint256"), ("delta", "int64")]), ("note", "string")]), ("tag", "bytes32")], [("ok", "bool")]),
        _entry("event", "Created", [("owner", "address", True), ("child", "address", False)]),
        _entry("event", "Filled", [("lines", "uint256[2][]", False)]),
    ]
)

_WORD = lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 64, "0")
_ADDRESS = lambda c: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(c.cast("long"))), 40, "0"))


def _submissions(spark, d) -> DataFrame:
    """Orders with their lines as calldata of ``submit``."""
    line = F.struct(F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("part"))
    lines = R.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    order = R.table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    n, note = F.size("lines"), F.concat(F.lit("note é "), F.col("o_custkey").cast("string"))
    negative = lambda c: F.lpad(F.lower(F.hex((-c).cast("long"))), 64, "f")
    body = F.array_join(F.transform("lines", lambda x: F.concat(_WORD(x.part), negative(x.n))), "")
    text = F.lower(F.hex(F.encode(note, "UTF-8")))
    data = F.concat(
        F.lit(parse_abi(ORDERS).one("function", "submit").selector), _WORD(F.lit(64)), _WORD(F.col("o_orderkey")), _WORD(F.col("o_custkey")), _WORD(F.lit(96)), _WORD(128 + 64 * n),
        _WORD(n), body, _WORD(F.length(text) / 2), F.rpad(text, 64, "0"),
    )
    return order.select(F.col("o_orderkey").alias("id"), F.lit("call").alias("trace_type"), F.lit("0x" + "aa" * 20).alias("to_address"), data.alias("input"), F.concat(F.lit("0x"), _WORD(F.col("o_orderkey") % 2)).alias("output"))


_LINES = "lines as (select l_orderkey, count(*) as n, string_agg(l_partkey || ':' || (-l_linenumber), ',' order by l_linenumber, l_partkey) as told from lineitem group by 1)"


@query(f"with {_F} select id, sender, amount0_in, amount1_out, to_addr from swaps")
def d1_abi_events(spark, d):
    """Swaps by the text of their ABI, to named columns."""
    found = event_table(_raw("factory_logs", R.factory_logs, spark, d), PAIRS, "Swap", ["id"])
    return found.select("id", "sender", F.col("amount0In").alias("amount0_in"), F.col("amount1Out").alias("amount1_out"), F.col("to").alias("to_addr"))


@query(f"with {_F} select 'Swap' as signature, sender as first, to_addr as last, count(*) as n from swaps group by all union all select 'PairCreated', token0, '1', count(*) from made group by all")
def d1_abi_params(spark, d):
    """Both events by the same text, as lists of texts."""
    p = F.col("decoded.event_params")
    found = decode_log(_raw("factory_logs", R.factory_logs, spark, d), abi=PAIRS)
    return found.groupBy(F.col("decoded.event_signature").alias("signature"), F.element_at(p, 1).alias("first"), F.element_at(p, -1).alias("last")).agg(F.count("*").alias("n"))


@query(f"with {_C} select id, cast(amount_in as varchar) as amount_in, array_to_string(path, ',') as path, caller as recipient from whole")
def d2_abi_calls(spark, d):
    found = call_table(_raw("calls", R.calls, spark, d), ROUTER, "swapExactTokensForTokens", ["id"]).where("path is not null")
    return found.select("id", F.col("amountIn").alias("amount_in"), F.array_join("path", ",").alias("path"), F.col("to").alias("recipient"))


@query(f"with {_LINES} select o_orderkey as id, '0x' || printf('%040x', o_custkey) as buyer, n, told as lines, 'note é ' || o_custkey as note, '0x' || printf('%064x', o_orderkey) as tag from orders join lines on l_orderkey = o_orderkey")
def d2_nested_calls(spark, d):
    """A tuple that holds an array of tuples with signed numbers, and a string."""
    found = call_table(_raw("submissions", _submissions, spark, d), ORDERS, "submit", ["id"])
    lines = F.array_join(F.transform("order.lines", lambda x: F.concat_ws(":", x.part, x.delta)), ",")
    return found.select("id", "order.buyer", F.size("order.lines").cast("long").alias("n"), lines.alias("lines"), "order.note", "tag")


@query(f"with {_LINES} select o_orderkey as id, 'submit' as function, case when o_orderkey % 2 = 1 then 'true' else 'false' end as ok, '0x' || printf('%064x', o_orderkey) as tag from orders join lines on l_orderkey = o_orderkey")
def d2_abi_outputs(spark, d):
    found = decode_calls(_raw("submissions", _submissions, spark, d), ORDERS, output="output")
    return found.select("id", "decoded.function", F.element_at("decoded.outputs", 1).alias("ok"), F.element_at("decoded.inputs", 2).alias("tag"))


@query("select o_orderkey as id, count(*) as n, string_agg(l_partkey || '/' || l_suppkey, ',' order by l_linenumber, l_partkey, l_suppkey) as lines from orders join lineitem on l_orderkey = o_orderkey group by 1")
def d8_nested_events(spark, d):
    """An event with an array of fixed arrays, routed by its ABI."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    lines = R.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: F.concat(_WORD(x.l_partkey), _WORD(x.l_suppkey))), "")
    logs = lines.select(
        "id", F.lit(parse_abi(ORDERS).one("event", "Filled").topic).alias("topics"), F.concat(F.lit("0x"), _WORD(F.lit(32)), _WORD(F.size("lines")), body).alias("data"),
        F.lit(0).cast("long").alias("block_number"), F.lit(0).cast("long").alias("block_timestamp"), F.lit("").alias("transaction_hash"),
    )
    found = route_events(written(logs, "filled"), abi=ORDERS)["Filled"]
    return found.select("id", F.size("lines").cast("long").alias("n"), F.array_join(F.transform("lines", lambda x: F.array_join(x, "/")), ",").alias("lines"))


@query("select '0x' || printf('%040x', o_custkey) as buyer, count(*) as n from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey) group by 1")
def x4_on_call_by_abi(spark, d):
    """A handler of another function than the router's."""
    indexer = X.Indexer()

    @indexer.on_call("0x" + "aa" * 20, "submit", ORDERS)
    def buyers(df):
        return df.groupBy("order.buyer").agg(F.count("*").alias("n"))

    return indexer.run({"traces": _raw("submissions", _submissions, spark, d)})["buyers"]


@query("select '0x' || printf('%040x', o_custkey) as from_address, count(*) as n, cast(sum(21000 + o_custkey) as varchar) as gas from orders where o_orderkey % 50 <> 0 group by 1")
def x3_on_transaction_receipts(spark, d):
    indexer = X.Indexer()

    @indexer.on_transaction(receipts=True)
    def gas(df):
        return df.groupBy("from_address").agg(F.count("*").alias("n"), F.sum("gas_used").cast("string").alias("gas"))

    return indexer.run({"transactions": R.transactions(spark, d), "receipts": R.receipts(spark, d)})["gas"]


@query(f"with {_F} select s.pair, count(*) as n, cast(sum(cast(s.amount0_in as bigint)) as bigint) as total from swaps s join made m on s.pair = m.pair and s.block_number >= m.created_at group by 1")
def x5_template_by_abi(spark, d):
    indexer = X.Indexer()

    @indexer.template("0x" + "ef" * 20, event="PairCreated", param="pair", child="Swap", abi=PAIRS)
    def swaps(df):
        return df.groupBy(F.col("address").alias("pair")).agg(F.count("*").alias("n"), F.sum(F.col("amount0In").cast("long")).alias("total"))

    return indexer.run({"logs": _raw("factory_logs", R.factory_logs, spark, d)})["swaps"]


def _family(spark, d) -> DataFrame:
    """A root announces nations (but every seventh), these customers, these orders; orders swap."""
    topic = parse_abi(ORDERS).one("event", "Created").topic
    zero = F.lit(0).cast("long")

    def announced(rows: DataFrame, parent, child, block) -> DataFrame:
        topics = F.concat_ws(",", F.lit(topic), F.concat(F.lit("0x"), _WORD(F.lit(1))))
        return rows.select(parent.alias("address"), topics.alias("topics"), F.concat(F.lit("0x"), F.lpad(F.substring(child, 3, 40), 64, "0")).alias("data"), block.cast("long").alias("block_number"), zero.alias("log_index"))

    nation, customer, order = (lambda c, base=base: _ADDRESS(c + base) for base in (1 << 40, 2 << 40, 3 << 40))
    root = F.lit("0x" + "ee" * 20)
    swaps = R.factory_logs(spark, d).where(F.col("id").contains("_"))
    return reduce_union(
        [
            announced(R.table(spark, d, "nation").where("n_nationkey % 7 <> 0"), root, nation(F.col("n_nationkey")), F.lit(1)),
            announced(R.table(spark, d, "customer"), nation(F.col("c_nationkey")), customer(F.col("c_custkey")), F.lit(2)),
            # Every third order is announced before its customer, which does not count.
            announced(R.table(spark, d, "orders"), customer(F.col("o_custkey")), _ADDRESS(F.col("o_orderkey") + 9000000), F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(3)),
            swaps.select("address", "topics", "data", (F.col("block_number") + 10000).alias("block_number"), "log_index"),
        ]
    )


def reduce_union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query(
    "with n as (select n_nationkey from nation where n_nationkey % 7 <> 0), c as (select c_custkey from customer where c_nationkey in (select * from n)), o as (select o_orderkey from orders where o_orderkey % 3 <> 0 and o_custkey in (select * from c))"
    " select 1 as level, count(*) as contracts, 0::bigint as swaps from n union all select 2, count(*), 0 from c union all select 3, (select count(*) from o), (select count(*) from lineitem where l_orderkey in (select * from o))"
)
def x5_factories_of_factories(spark, d):
    """Contracts at any depth below one root, and the swaps of the last ones."""
    logs = _raw("family", _family, spark, d)
    contracts = written(found_contracts(logs, ["0x" + "ee" * 20], [("Created", "child")], ORDERS, repeat=True), "family")
    swaps = template_events(logs, contracts, "Swap", PAIRS, ["address"]).join(contracts, "address").groupBy("level").agg(F.count("*").alias("swaps"))
    counts = contracts.groupBy("level").agg(F.count("*").alias("contracts"))
    return counts.join(swaps, "level", "left").na.fill(0, ["swaps"])
