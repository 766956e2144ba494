"""Chain tables derived from the supplied business tables, row by row.

No chain data is at hand, so logs, blocks, transactions, calls, contracts and
platforms' datasets are computed from ``lineitem``, ``orders`` and ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.schemas import EVENTS, SWAP_SELECTOR, ZERO_ADDRESS

#: Block numbers of swaps and transfers are days since this date.
EPOCH = "1995-01-01"
#: Creations come first in a block; swaps follow at these log indexes.
PLATFORMS = ["a", "b", "c"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _even(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a business table dealt evenly by a key, whatever files they come from.

    What is computed from them is many times wider, so this is done before: only
    the few columns that are used are shuffled, to as many tasks as their size needs.
    """
    return rows.hint("rebalance", key)


def _hex(value: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(value.cast("long"))), width, "0")


def address(value: Column) -> Column:
    return F.concat(F.lit("0x"), _hex(value, 40))


def _word(value: Column) -> Column:
    return _hex(value, 64)


def _topic(addr: Column) -> Column:
    return F.concat(F.lit("0x" + "0" * 24), F.substring(addr, 3, 40))


def _day(ts: Column) -> Column:
    return F.date_diff(ts.cast("date"), F.lit(EPOCH).cast("date")).cast("long")


def _line_id() -> Column:
    return F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, from_addr, to_addr, value, block_number, ts``."""
    return _transfers(table(spark, sf_dir, "lineitem"))


def _transfers(line: DataFrame) -> DataFrame:
    even = F.col("l_linenumber") % 2 == 0
    to = F.when(even, F.col("l_partkey") + 1000000).otherwise((F.col("l_suppkey") * 7 + 1) % 100)
    return line.select(
        _line_id().alias("id"),
        F.when(F.col("l_returnflag") == "R", ZERO_ADDRESS).otherwise(address(F.col("l_suppkey"))).alias("from_addr"),
        address(to).alias("to_addr"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("value"),
        _day(F.col("l_shipdate")).alias("block_number"),
        F.unix_timestamp("l_shipdate").alias("ts"),
    )


def _transfer_logs(t: DataFrame, data: Column) -> DataFrame:
    return t.select(
        "id",
        F.lit("0x" + "ab" * 20).alias("address"),
        F.concat_ws(",", F.lit(EVENTS["Transfer"][0]), _topic(F.col("from_addr")), _topic(F.col("to_addr"))).alias("topics"),
        data.alias("data"),
        "block_number",
        F.col("ts").alias("block_timestamp"),
        F.concat(F.lit("0x"), F.md5("id")).alias("transaction_hash"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transfers as raw logs."""
    return _transfer_logs(_transfers(_even(table(spark, sf_dir, "lineitem"), "l_orderkey")), F.concat(F.lit("0x"), _word(F.col("value"))))


def token_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same logs with amounts of 18 decimals: a cent is 10^16 units."""
    t = _transfers(_even(table(spark, sf_dir, "lineitem"), "l_orderkey"))
    # value * 10^16 in two halves of 60 and 64 bits, as hex() takes a long at most.
    wide = F.col("value").cast("decimal(20,0)") * F.lit(str(10**16)).cast("decimal(17,0)")
    half = F.lit(str(1 << 60)).cast("decimal(19,0)")
    high, low = F.call_function("div", wide, half).cast("long"), (wide % half).cast("long")
    data = F.concat(F.lit("0x"), _hex(high, 49), _hex(low, 15))
    return _transfer_logs(t, data)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Router calls as traces; every 17th (by order key) is cut short after its second word.

    Calls of a transaction lie together, as on a chain: its hash, random text
    that doesn't compress, is then a repeat to codecs of files and shuffles.
    """
    line = _even(table(spark, sf_dir, "lineitem"), "l_orderkey").sortWithinPartitions("l_orderkey")
    n = (F.col("l_linenumber") % 3 + 2).cast("int")
    tokens = F.transform(F.sequence(F.lit(1), n), lambda i: _word(F.col("l_partkey") + i))
    body = F.concat(
        F.lit(SWAP_SELECTOR), _word(F.col("l_quantity")), _word(F.round(F.col("l_extendedprice") * 100)), _word(F.lit(160)), _word(F.col("l_suppkey")),
        _word(F.unix_timestamp("l_shipdate")), _word(n), F.array_join(tokens, ""),
    )
    return line.select(
        _line_id().alias("id"),
        F.concat(F.lit("0x"), F.md5(F.col("l_orderkey").cast("string"))).alias("transaction_hash"),
        address(F.col("l_suppkey")).alias("from_address"),
        F.lit("0x" + "cd" * 20).alias("to_address"),
        F.lit("call").alias("trace_type"),
        F.when(F.col("l_orderkey") % 17 == 0, F.substring(body, 1, 138)).otherwise(body).alias("input"),
        F.lit("0x").alias("output"),
        _day(F.col("l_shipdate")).alias("block_number"),
        F.array(F.col("l_linenumber"), F.col("l_partkey").cast("int"), F.col("l_suppkey").cast("int")).alias("trace_address"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, number, hash, parent_hash, timestamp``: the order keys that occur, so with gaps."""
    numbers = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("number")).distinct()
    h = lambda c: F.concat(F.lit("0x"), F.md5(c.cast("string")))
    return numbers.select(F.col("number").cast("string").alias("id"), "number", h(F.col("number")).alias("hash"), h(F.col("number") - 1).alias("parent_hash"), (F.col("number") * 12 + 1700000000).alias("timestamp"))


def _tx_hash() -> Column:
    return F.concat(F.lit("0x"), F.md5(F.col("o_orderkey").cast("string")))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = F.when(F.col("o_orderpriority") != "1-URGENT", address(F.col("o_custkey") + 5000000))
    price = F.round(F.col("o_totalprice") * 100).cast("decimal(20,0)") * F.lit(1000000000)
    return table(spark, sf_dir, "orders").select(
        _tx_hash().alias("hash"), address(F.col("o_custkey")).alias("from_address"), to.alias("to_address"), F.col("o_orderkey").alias("block_number"), price.cast("decimal(38,0)").alias("gas_price")
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of most transactions; pending ones have no effective price."""
    price = F.round(F.col("o_totalprice") * 100).cast("decimal(20,0)") * F.lit(1000000001)
    kept = table(spark, sf_dir, "orders").where("o_orderkey % 50 <> 0")
    return kept.select(_tx_hash().alias("hash"), (F.lit(21000) + F.col("o_custkey")).cast("decimal(38,0)").alias("gas_used"), F.when(F.col("o_orderstatus") != "P", price.cast("decimal(38,0)")).alias("effective_gas_price"))


def factory_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creations (orders that aren't final) and swaps (lines of any order) as logs."""
    pair = lambda c: address(c + 9000000)
    order = _even(table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'"), "o_orderkey")
    created = order.select(
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("id"),
        F.lit("0x" + "ef" * 20).alias("address"),
        F.concat_ws(",", F.lit(EVENTS["PairCreated"][0]), _topic(address(F.col("o_custkey"))), _topic(address(F.col("o_custkey") + 1))).alias("topics"),
        F.concat(F.lit("0x"), _word(F.col("o_orderkey") + 9000000), _word(F.lit(1))).alias("data"),
        _day(F.col("o_orderdate")).alias("block_number"),
        F.lit(0).cast("long").alias("log_index"),
    )
    swaps = _even(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        _line_id().alias("id"),
        pair(F.col("l_orderkey")).alias("address"),
        F.concat_ws(",", F.lit(EVENTS["Swap"][0]), _topic(address(F.col("l_suppkey"))), _topic(address(F.col("l_partkey")))).alias("topics"),
        F.concat(F.lit("0x"), _word(F.col("l_quantity")), _word(F.lit(0)), _word(F.lit(0)), _word(F.round(F.col("l_extendedprice") * 100))).alias("data"),
        _day(F.col("l_shipdate")).alias("block_number"),
        F.col("l_linenumber").cast("long").alias("log_index"),
    )
    return created.union(swaps)


def platform(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The events as platform ``a``, ``b`` or ``c`` has them: rows missing, values changed, names drifting."""
    e = table(spark, sf_dir, "events")
    if name == "a":
        return e.where("event_id % 10 <> 0").select("event_id", "user_id", "event_type", "value", F.unix_timestamp("ts").alias("ts"))
    if name == "b":
        value = F.when(F.col("event_id") % 11 == 0, F.col("value") + 1).otherwise(F.col("value"))
        return e.where("event_id % 7 <> 0").select(F.col("event_id").alias("eventId"), F.col("user_id").alias("userId"), F.col("event_type").alias("eventType"), value.alias("amount"), F.unix_timestamp("ts").alias("timestamp"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("USER_ID"), F.upper("event_type").alias("EVENT_TYPE"), F.col("value").alias("VALUE"), (F.unix_timestamp("ts") * 1000).alias("ts_ms"))
