from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.functions import abi, contract_abi, u256
from ledgerloom.functions.abi import decode_call, decode_log, decode_swap_call, route_events
from ledgerloom.schemas import EVENTS, SWAP_SELECTOR, ZERO_ADDRESS

NUMBERS = [0, 1, 9, 2**31, 2**60 - 1, 2**60, 2**64 - 1, 2**64, 2**124 - 1, 2**124, 10**38, 2**126, 2**255 + 12345, 2**256 - 1]


def word(n):
    return f"{n:064x}"


def one(spark, values, schema, column):
    return [r[0] for r in spark.createDataFrame(values, schema).select(column).collect()]


def test_exact_numbers(spark):
    rng = random.Random(1)
    numbers = NUMBERS + [rng.getrandbits(rng.randrange(1, 257)) for _ in range(60)]
    assert one(spark, [(word(n),) for n in numbers], "h string", u256.word_to_u256(F.col("h"))) == [str(n) for n in numbers]
    assert one(spark, [(hex(n),) for n in numbers], "h string", u256.hex_to_u256(F.col("h"))) == [str(n) for n in numbers]
    assert one(spark, [(x,) for x in (None, "", "0x", "zz", "0xzz", "f" * 65)], "h string", u256.hex_to_u256(F.col("h"))) == ["0"] * 6
    pairs = [(str(rng.getrandbits(256)), str(rng.getrandbits(rng.randrange(1, 257)))) for _ in range(30)] + [("0", "5"), ("10", "0"), (None, "1"), ("99999999999999999999", "999999999999999999")]
    want = [None if a is None else str(int(a) * int(b)) for a, b in pairs]
    assert one(spark, pairs, "a string, b string", u256.u256_mul(F.col("a"), F.col("b"))) == want
    sums = spark.createDataFrame([(n % 3, hex(v)) for n, v in enumerate(numbers)], "g int, h string").groupBy("g").agg(u256.u256_sum(F.col("h")).alias("s"))
    assert {r.g: int(r.s) for r in sums.collect()} == {g: sum(v for n, v in enumerate(numbers) if n % 3 == g) for g in range(3)}
    lenient = [(None,), ("",), ("12",), ("1.23e+21",), ("x1",), ("-5",)]
    assert [int(x) for x in one(spark, lenient, "v string", u256.safe_to_u256(F.col("v")))] == [0, 0, 12, 1230000000000000000000, 0, -5]


def dynamic(*values):
    """ABI encoding of bytes values after a head of so many words."""
    head, tail = "", ""
    for v in values:
        head += word(32 * len(values) + len(tail) // 2)
        tail += word(len(v)) + v.hex() + "0" * (-len(v) % 32 * 2)
    return head + tail


def test_event_kinds(spark):
    a, b = "0x" + "11" * 20, "0x" + "ab" * 20
    topic = lambda addr: "0x" + "0" * 24 + addr[2:]
    cases = {
        "Transfer": ([topic(a), topic(b)], word(10**19), [a, b, str(10**19)]),
        "Approval": ([topic("0x" + "0" * 39 + "1")] * 2, word(234), ["0x" + "0" * 39 + "1"] * 2 + ["234"]),
        "ClaimerUpdated": ([topic(a)], word(1), [a, "true"]),
        "BurnCommissionChanged": (["0x" + word(7), "0x" + word(9)], "", ["7", "9"]),
        "BatchMintSkipped": (["0x" + "cd" * 32], dynamic(b"\x01\x02\x03"), ["0x" + "cd" * 32, "0x010203"]),
        "NameAndSymbolChanged": ([], dynamic("Näme".encode(), b"N" * 40), ["Näme", "N" * 40]),
        "UnstakeRequest": ([topic(a)], word(64) + word(5) + word(2) + "beef" + "0" * 60, [a, "0xbeef", "5"]),
        "EIP712DomainChanged": ([], "", []),
        "Paused": ([], word(int(b, 16)), [b]),
    }
    rows = [(n, ",".join([EVENTS[n][0], *topics]), "0x" + data, 1, 2, "0xt") for n, (topics, data, _) in cases.items()] + [("?", "0x1234", "0x", 1, 2, "0xt")]
    df = spark.createDataFrame(rows, "id string, topics string, data string, block_number long, block_timestamp long, transaction_hash string")
    found = {r.id: r.decoded for r in decode_log(df).collect()}
    assert found.pop("?") is None
    assert {n: (d.event_signature, d.event_params) for n, d in found.items()} == {n: (n, params) for n, (*_, params) in cases.items()}
    tables = route_events(df, ["Transfer", "Paused"])
    assert tables["Transfer"].first()["value"] == str(10**19) and tables["Paused"].first().account == b


def test_calls_and_short_paths(spark):
    addresses = ["0x" + f"{n:040x}" for n in (5, 6, 7)]
    body = word(100) + word(2**200) + word(160) + word(int(addresses[0], 16)) + word(99) + word(3) + "".join(word(int(a, 16)) for a in addresses)
    rows = [("whole", SWAP_SELECTOR + body), ("cut", SWAP_SELECTOR + body[:-64]), ("head", SWAP_SELECTOR + body[:320]), ("short", SWAP_SELECTOR + body[:60]), ("bad", SWAP_SELECTOR + body[:128] + "f" * 64 + body[192:]), ("other", "0x12345678" + body)]
    df = spark.createDataFrame(rows, "id string, input string")
    found = {r.id: r for r in decode_swap_call(df).collect()}
    assert set(found) == {"whole", "cut", "head", "bad", "other"}
    assert (found["whole"].amount_in, found["whole"].amount_out_min, found["whole"].deadline, found["whole"].to) == ("100", str(2**200), "99", addresses[0])
    assert found["whole"].path == addresses and found["cut"].path == addresses[:2] and not found["head"].path and found["bad"].path is None
    assert {r.id: r.path for r in decode_swap_call(df, most=1, fallback=True).collect()} == {"whole": addresses[:1], "cut": addresses[:1], "other": addresses[:1], "head": [ZERO_ADDRESS] * 2, "bad": [ZERO_ADDRESS] * 2}
    decoded = {r.id: r.decoded for r in decode_call(df, SWAP_SELECTOR, ["uint256", "uint256", "address[]", "address", "uint256"]).collect()}
    assert decoded["other"] is None and decoded["short"] is None and decoded["whole"].inputs[2] == '["' + '","'.join(addresses) + '"]'


@pytest.mark.parametrize(
    ("column", "value", "want"),
    [
        (lambda: C.trace_id(F.lit("0xt"), F.col("v")), [], "0xt-0"),
        (lambda: C.trace_id(F.lit("0xt"), F.col("v")), [0, 2], "0xt-0-2"),
        (lambda: C.path_tokens(F.col("v")), "0x" + "1" * 40 + "0x" + "2" * 40, ["0x" + "1" * 40, "0x" + "2" * 40]),
        (lambda: C.path_tokens(F.col("v")), "a,b", ["a", "b"]),
        (lambda: C.path_tokens(F.col("v")), None, []),
        (lambda: C.list_length(C.parse_list(F.col("v"))), '["a", "b"]', 2),
        (lambda: C.epoch_seconds(F.col("v")), 1700000000123, 1700000000),
        (lambda: C.iso_time(F.col("v")), 0, "1970-01-01T00:00:00.000Z"),
        (lambda: C.normalize_hash(F.col("v")), "0xAB", "ab"),
        (lambda: C.repair_address(F.col("v")), "a" * 40, "0x" + "a" * 40),
        (lambda: C.valid_address(F.col("v")), "0xzz", False),
        (lambda: C.block_from_meta(F.col("v")), "1:200:x", 200),
        (lambda: C.points_rate_floor(F.col("v"), F.lit(86400)), 3, 3000),
        (lambda: C.method_selector(F.col("v")), "0x12", None),
    ],
)
def test_columns(spark, column, value, want):
    kind = {int: "long", list: "array<int>"}.get(type(value), "string")
    assert spark.createDataFrame([(value,)], f"v {kind}").select(column()).first()[0] == want


def test_odd_data_decode_by_characters_and_calldata_are_cut_once(spark):
    """Letters beyond ASCII and other than hex digits count as one place each; calldata stand once in the plan."""
    word = lambda n: f"{n:064x}"
    body = word(5) + word(1 << 70) + word(160) + "0" * 24 + "é" * 40 + "g" * 64 + word(2) + word(10) + word(11)
    calls = spark.createDataFrame([(1, "0x38ed1739" + body), (2, "0x38ed1739" + body.replace("é", "A")), (3, "0x38ed1739" + body[:300])], "id int, input string")
    decoded = abi.decode_call(calls, "0x38ed1739", ["uint256", "uint256", "address[]", "address", "uint256"])
    got = {r.id: r.decoded and list(r.decoded.inputs) for r in decoded.collect()}
    path = '["0x' + f"{10:040x}" + '","0x' + f"{11:040x}" + '"]'
    assert got == {1: ["5", str(1 << 70), path, "0x" + "é" * 40, "0"], 2: ["5", str(1 << 70), path, "0x" + "a" * 40, "0"], 3: None}
    plan = decoded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring(input") <= 2
    flat = [contract_abi.Parameter(n, contract_abi.parse_type(t)) for n, t in (("a", "uint256"), ("b", "int64"), ("c", "address"), ("d", "bool"), ("e", "bytes4"), ("f", "uint32"))]
    data = word(1 << 70) + "f" * 64 + "0" * 24 + "AB" * 20 + word(1) + "12345678" + "0" * 56 + word(7)
    rows = spark.createDataFrame([(1, data), (2, data[:64] + "é" * 64 + data[128:]), (3, data[:128])], "id int, data string")
    read = {r.id: list(r.v) for r in rows.select("id", contract_abi.decode_data(tuple(flat), F.col("data")).alias("v")).collect()}
    good = [str(1 << 70), "-1", "0x" + "ab" * 20, True, "0x12345678", "7"]
    assert read == {1: good, 2: [good[0], None, *good[2:]], 3: [*good[:2], None, None, None, None]}
