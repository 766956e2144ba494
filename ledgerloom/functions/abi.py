"""ABI decoding compiled on the driver into column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import cut_from, data_word, topic_to_address
from ledgerloom.functions.columns import let as _let
from ledgerloom.functions.contract_abi import Abi, decode_logs, event_tables, parse_abi
from ledgerloom.functions.u256 import word_to_u256
from ledgerloom.schemas import EVENTS, ZERO_ADDRESS

_DYNAMIC = {"bytes", "string", "address[]"}


def _number(word: Column) -> Column:
    """A word as long; null where it is beyond 15 hex digits or not hex."""
    ok = word.rlike("^0{49}[0-9a-fA-F]{15}$")
    return F.when(ok, F.conv(F.substring(word, 50, 15), 16, 10).cast("long"))


def _from_word(word: Column, kind: str) -> Column:
    """The text of a word; a number's word as it is, to be printed with the others."""
    if kind == "address":
        return F.concat(F.lit("0x"), F.lower(F.substring(word, 25, 40)))
    if kind.startswith("uint"):
        return word
    if kind == "bool":
        return F.when(F.substring(word, 64, 1) == "1", "true").otherwise("false")
    return F.concat(F.lit("0x"), F.lower(word))


def _tail(data: Column, offset: Column, kind: str) -> Column:
    """A dynamic value; ``offset`` is in bytes from the start of ``0x`` data."""
    at = (offset * 2 + 3).cast("int")
    length = _number(data.substr(at, F.lit(64)).cast("string")).cast("int")
    if kind == "address[]":
        path = address_array(data, offset)
        return F.concat(F.lit('["'), F.array_join(path, '","'), F.lit('"]'))
    body = data.substr(at + 64, length * 2).cast("string")
    if kind == "string":
        return F.decode(F.unhex(body), "UTF-8")
    return F.concat(F.lit("0x"), F.lower(body))


def _computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row.

    A generator of one row: projections and filters that follow read its
    result, where they would else be merged with the expression and repeat it.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def address_array(data: Column, offset: Column, most: int | None = None) -> Column:
    """``address[]`` at a byte offset of ``0x`` data, cut short where the data end."""

    def counted(s: Column) -> Column:
        there = F.call_function("div", F.length(s["d"]) - s["at"] - 63, F.lit(64))
        told = _number(s["d"].substr(s["at"], F.lit(64)).cast("string"))
        n = F.when(told.isNotNull(), F.least(told, there, *([F.lit(most)] if most else [])))
        return F.struct(s["d"].alias("d"), s["at"].alias("at"), n.alias("n"))

    def cut(s: Column) -> Column:
        item = lambda i: F.concat(F.lit("0x"), F.lower(s["d"].substr((s["at"] + 88 + i * 64).cast("int"), F.lit(40)).cast("string")))
        items = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(s["n"], F.lit(1).cast("long")) - 1), item)
        return F.when(s["n"] <= 0, F.array().cast("array<string>")).when(s["n"].isNotNull(), items)

    start = F.struct(data.alias("d"), (offset * 2 + 3).cast("int").alias("at"))
    return _let(start, lambda s: _let(counted(s), cut))


def _value(data: Column, k: int, kind: str) -> Column:
    if kind in _DYNAMIC:
        return _tail(data, _number(data_word(data, k)), kind)
    return _from_word(data_word(data, k), kind)


def _printed(values: Column, kinds: list[str]) -> Column:
    """Parameters as text: the words of numbers go through one expression together."""
    numbers = F.array(*[F.lit(k.startswith("uint")) for k in kinds])
    return F.zip_with(values, numbers, lambda v, is_number: F.when(is_number, word_to_u256(v)).otherwise(v))


def event_params(name: str, topics: Column, data: Column) -> list[Column]:
    """The parameters of an event in order of declaration, as text."""
    found, topic, word = [], 1, 0
    for _, kind, indexed in EVENTS[name][1]:
        if indexed:
            t = F.try_element_at(topics, F.lit(topic + 1))
            found.append(topic_to_address(t) if kind == "address" else t if kind in _DYNAMIC else _from_word(F.substring(t, 3, 64), kind))
            topic += 1
        else:
            found.append(_value(data, word, kind))
            word += 1
    return found


def decode_log(df: DataFrame, names: list[str] | None = None, topics: str = "topics", data: str = "data", abi: str | None = None) -> DataFrame:
    """``df`` with ``decoded``: struct(event_signature, event_params), null for other events.

    Events are those of ``abi``, ABI JSON (see ``contract_abi``), else of the
    catalogue, which has a faster path for flat parameters.

    ``topics`` is a comma list whose first item selects the event. Parameters
    are text, in order of declaration, ``element_at(event_params, 1)`` the first.
    """
    if abi is not None:
        found = parse_abi(abi)
        return decode_logs(df, Abi(tuple(found.one("event", n) for n in names)) if names else found, topics, data)
    listed = F.split(F.col(topics), ",")
    topic0 = F.lower(F.substring_index(F.col(topics), ",", 1))
    raw = numbers = signature = F.lit(None)
    for name in names or list(EVENTS):
        is_it, kinds = topic0 == EVENTS[name][0], [kind for _, kind, _ in EVENTS[name][1]]
        params = event_params(name, listed, F.col(data))
        signature = F.when(is_it, F.lit(name)).otherwise(signature)
        raw = F.when(is_it, F.array(*params).cast("array<string>")).otherwise(raw)
        numbers = F.when(is_it, F.array(*[F.lit(k.startswith("uint")) for k in kinds]).cast("array<boolean>")).otherwise(numbers)
    printed = F.zip_with(raw, numbers, lambda v, is_number: F.when(is_number, word_to_u256(v)).otherwise(v))
    return _computed(df, "decoded", F.when(signature.isNotNull(), F.struct(signature.alias("event_signature"), printed.alias("event_params"))))


def decode_event(df: DataFrame, name: str, topics: str = "topics", data: str = "data") -> DataFrame:
    """The logs of one event, decoded; the filter on topics reaches the scan."""
    return decode_log(df.where(F.col(topics).startswith(EVENTS[name][0])), [name], topics, data)


def route_events(df: DataFrame, names: list[str] | None = None, abi: str | None = None) -> dict[str, DataFrame]:
    """One table per event: its parameters as columns, block, time and transaction.

    Parameters of the catalogue's events are text; those of ``abi`` are typed.
    """
    kept = ["id", "block_number", "block_timestamp", "transaction_hash"]
    if abi is not None:
        return {n: t for n, t in event_tables(df, abi, kept).items() if names is None or n in names}
    out = {}
    for name in names or list(EVENTS):
        rows = decode_event(df, name)
        params = [F.col("decoded.event_params")[k].alias(p) for k, (p, *_) in enumerate(EVENTS[name][1])]
        out[name] = rows.select(*kept, *params)
    return out


def decode_call(df: DataFrame, selector: str, kinds: list[str], call: str = "input") -> DataFrame:
    """``df`` with ``decoded``: struct(inputs array<string>), null if not decodable.

    Decodable is an input with the selector and all words of its head.
    """

    def decoded(data: Column) -> Column:
        inputs = F.array(*[_value(data, k, kind).cast("string") for k, kind in enumerate(kinds)])
        return F.struct(_printed(inputs, kinds).alias("inputs"))

    data = F.concat(F.lit("0x"), F.substring(F.col(call), 11, 1 << 30))
    whole = F.col(call).startswith(selector) & (F.length(F.col(call)) >= 10 + 64 * len(kinds))
    return _computed(df, "decoded", F.when(whole, cut_from(data, decoded)))


def decode_swap_call(df: DataFrame, call: str = "input", most: int | None = None, fallback: bool = False) -> DataFrame:
    """``amount_in, amount_out_min, path, to, deadline`` by fixed positions; too short calls are dropped.

    The path ends where the data do, or at ``most`` tokens; with ``fallback`` an
    unreadable path is two null addresses.
    """

    def decoded(data: Column) -> Column:
        path = address_array(data, _number(data_word(data, 2)), most)
        if fallback:
            path = F.when(path.isNull() | (F.size(path) == 0), F.array(F.lit(ZERO_ADDRESS), F.lit(ZERO_ADDRESS))).otherwise(path)
        numbers = F.transform(F.array(*[data_word(data, k) for k in (0, 1, 4)]), word_to_u256)
        return F.struct(numbers.alias("numbers"), path.alias("path"), _from_word(data_word(data, 3), "address").alias("to"))

    data = F.concat(F.lit("0x"), F.substring(F.col(call), 11, 1 << 30))
    whole = _computed(df.where(F.length(F.col(call)) >= 10 + 64), "_call", cut_from(data, decoded))
    named = {n: F.col("_call.numbers")[k] for k, n in enumerate(("amount_in", "amount_out_min", "deadline"))}
    return whole.withColumns(named | {"path": F.col("_call.path"), "to": F.col("_call.to")}).drop("_call")
