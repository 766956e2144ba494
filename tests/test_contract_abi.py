"""ABI JSON against a plain encoder."""

import json
import random

import pytest

from ledgerloom.functions.contract_abi import call_table, decode_calls, decode_logs, event_table, event_tables, keccak256, parse_abi
from ledgerloom.schemas import EVENTS, SWAP_SELECTOR

SWAP = '[{"name":"swapExactTokensForTokens","type":"function","inputs":[{"name":"amountIn","type":"uint256"},{"name":"amountOutMin","type":"uint256"},{"name":"path","type":"address[]"},{"name":"to","type":"address"},{"name":"deadline","type":"uint256"}],"outputs":[{"name":"amounts","type":"uint256[]"}]}]'
NESTED = json.dumps(
    [
        {
            "type": "function",
            "name": "place",
            "inputs": [
                {"name": "order", "type": "tuple", "components": [{"name": "who", "type": "address"}, {"name": "legs", "type": "tuple[]", "components": [{"name": "amount", "type": "int128"}, {"name": "note", "type": "string"}]}]},
                {"name": "grid", "type": "uint8[2][]"},
                {"name": "", "type": "bytes4"},
                {"name": "names", "type": "string[2]"},
                {"name": "flag", "type": "bool"},
                {"name": "raw", "type": "bytes"},
            ],
            "outputs": [{"name": "ok", "type": "bool"}, {"name": "left", "type": "int256"}],
        },
        {"type": "constructor", "inputs": []},
        {"type": "event", "name": "Done", "anonymous": False, "inputs": [{"name": "key", "type": "string", "indexed": True}, {"name": "by", "type": "int64", "indexed": True}, {"name": "ids", "type": "uint256[]", "indexed": False}]},
        {"type": "event", "name": "Ping", "inputs": []},
    ]
)


def word(n):
    return f"{n % (1 << 256):064x}"


def encode(kind, value):
    """Head and tail by the rules of the format, without types of the library under test."""
    if isinstance(kind, list):  # [item] dynamic, [item, n] fixed
        body = encode_all([kind[0]] * len(value), value)
        return (word(len(value)) if len(kind) == 1 else "") + body
    if isinstance(kind, tuple):
        return encode_all(kind, value)
    if kind in ("bytes", "string"):
        raw = value.encode() if kind == "string" else value
        return word(len(raw)) + raw.hex() + "0" * (-len(raw.hex()) % 64)
    if kind.startswith("bytes"):
        return value.hex().ljust(64, "0")
    return word(int(value))


def dynamic(kind):
    if isinstance(kind, list):
        return len(kind) == 1 or dynamic(kind[0])
    return any(map(dynamic, kind)) if isinstance(kind, tuple) else kind in ("bytes", "string")


def encode_all(kinds, values):
    bodies = [encode(k, v) for k, v in zip(kinds, values, strict=True)]
    heads = sum(32 if dynamic(k) else len(b) // 2 for k, b in zip(kinds, bodies, strict=True))
    head, tail = "", ""
    for kind, body in zip(kinds, bodies, strict=True):
        if dynamic(kind):
            head, tail = head + word(heads + len(tail) // 2), tail + body
        else:
            head += body
    return head + tail


def test_hash_gives_known_topics_and_selectors():
    assert keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak256(b"x" * 136) != keccak256(b"x" * 135)
    for name, (topic, params) in EVENTS.items():
        if name != "Initialized":
            assert "0x" + keccak256(f"{name}({','.join(k for _, k, _ in params)})".encode()).hex() == topic, name
    assert parse_abi(SWAP).one("function", "swapExactTokensForTokens").selector == SWAP_SELECTOR


KINDS = (("address", [("int128", "string")]), [["uint8", 2]], "bytes4", ["string", 2], "bool", "bytes")


def values(rng):
    legs = [(rng.randrange(-(1 << 127), 1 << 127), "é" * rng.randrange(40)) for _ in range(rng.randrange(4))]
    return (
        (rng.getrandbits(160), legs),
        [[rng.randrange(256), rng.randrange(256)] for _ in range(rng.randrange(3))],
        rng.randbytes(4),
        ["", "long " * rng.randrange(20)],
        rng.random() < 0.5,
        rng.randbytes(rng.randrange(70)),
    )


def test_nested_calls(spark):
    rng = random.Random(1)
    made = [values(rng) for _ in range(30)]
    place = parse_abi(NESTED).one("function", "place")
    assert place.signature == "place((address,(int128,string)[]),uint8[2][],bytes4,string[2],bool,bytes)"
    rows = [(k, place.selector + encode_all(KINDS, v), "0x" + word(1) + word(-k)) for k, v in enumerate(made)]
    calls = spark.createDataFrame([*rows, (98, "0x12345678", "0x"), (99, None, None)], "id int, input string, output string")
    got = {r.id: r for r in call_table(calls, NESTED, "place", ["id"]).collect()}
    assert sorted(got) == list(range(30))
    for k, ((who, legs), grid, tag, names, flag, raw) in enumerate(made):
        r = got[k]
        assert r.order.who == f"0x{who:040x}" and [(x.amount, x.note) for x in r.order.legs] == [(str(a), n) for a, n in legs]
        assert (r.grid, r.arg2, r.names, r.flag, r.raw) == ([[str(x) for x in g] for g in grid], "0x" + tag.hex(), names, flag, "0x" + raw.hex())
    texts = {r.id: r.decoded for r in decode_calls(calls, NESTED, output="output").collect()}
    assert texts[98] is None and texts[99] is None
    assert texts[3].outputs == ["true", "-3"] and texts[3].function == "place" and json.loads(texts[3].inputs[1]) == [[str(x) for x in g] for g in made[3][1]]


def test_events_by_name(spark):
    abi = parse_abi(NESTED)
    done, ping = abi.one("event", "Done"), abi.one("event", "Ping")
    big = [0, 1, (1 << 256) - 1, 1 << 200]
    logs = [
        (1, ",".join([done.topic, "0x" + "ab" * 32, "0x" + word(-7)]), "0x" + encode_all([["uint256"]], [big])),
        (2, ",".join([done.topic.upper().replace("X", "x", 1), "0x" + "ab" * 32, "0x" + word(7)]), "0x" + encode_all([["uint256"]], [[]])),
        (3, ",".join([done.topic, "0x" + "ab" * 32]), "0x"),  # one topic less: another event
        (4, ping.topic, "0x"),
        (5, ",".join([done.topic, "0x" + "ab" * 32, "0x" + word(1)]), "0x" + word(32) + word(1 << 40)),  # a length beyond the data
        (6, None, None),
    ]
    df = spark.createDataFrame(logs, "key int, topics string, data string")
    got = {r.key: r for r in decode_logs(df, abi).collect()}
    assert got[1].decoded.event_params == ["0x" + "ab" * 32, "-7", json.dumps([str(x) for x in big], separators=(",", ":"))]
    assert got[2].decoded.event_params[1:] == ["7", "[]"]
    assert got[3].decoded is None and got[6].decoded is None and tuple(got[4].decoded) == ("Ping", [])
    assert got[5].decoded.event_params[1:] == ["1", None]
    tables = event_tables(df, abi, ["key"])
    assert set(tables) == {"Done", "Ping"} and tables["Ping"].columns == ["key"]
    row = next(r for r in event_table(df, abi, "Done", ["key"]).collect() if r[0] == 1)
    assert row["_key"] == "0x" + "ab" * 32 and row.by == "-7" and row.ids == [str(x) for x in big]


def test_errors():
    with pytest.raises(ValueError, match="no function 'other'"):
        parse_abi(SWAP).one("function", "other")
    with pytest.raises(ValueError, match="uint7"):
        parse_abi('[{"type":"event","name":"E","inputs":[{"name":"a","type":"uint7"}]}]')
    two = parse_abi('[{"type":"event","name":"E","inputs":[{"name":"a","type":"uint8"}]},{"type":"event","name":"E","inputs":[]}]')
    assert set(two.all("event")) == {"E(uint8)", "E()"}


def test_handlers_and_templates_ask_for_an_abi(spark):
    from ledgerloom.plans.pipeline import Indexer
    from ledgerloom.plans.templates import found_contracts

    with pytest.raises(ValueError, match="needs an ABI"):
        Indexer().on_call(None, "0x12345678")
    with pytest.raises(ValueError, match="need an ABI"):
        Indexer().template("0x1", event="Created", param="child")
    logs = spark.createDataFrame([], "address string, topics string, data string, block_number long, log_index long")
    with pytest.raises(ValueError, match="no parameter"):
        found_contracts(logs, ["0x1"], [("Done", "nothing")], NESTED)
