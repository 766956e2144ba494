"""Contract ABIs given as JSON, compiled on the driver into column expressions.

The JSON is parsed into a tree of types; a tree becomes one expression over the
hex data, with offsets followed through tuples and arrays at any depth. Topics
and selectors are Keccak-256 of the signatures, so no catalogue is needed.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import cut_from
from ledgerloom.functions.u256 import BASE, _carried, digits_to_string, string_to_digits, word_to_u256

_MASK = (1 << 64) - 1


def keccak256(message: bytes) -> bytes:
    """Keccak-256 as contracts use it: rate 136, padding 0x01. For signatures, so on the driver."""
    rotation, constants, x, y, step = {(0, 0): 0}, [], 1, 0, 1
    for t in range(24):
        rotation[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    for _ in range(24):  # round constants come from a shift register
        word = 0
        for j in range(7):
            word |= (step & 1) << (2**j - 1)
            step = step << 1 ^ (0x171 if step & 0x80 else 0)
        constants.append(word)
    turn = lambda v, n: (v << n | v >> (64 - n)) & _MASK if n else v

    padded = bytearray(message) + b"\x01" + b"\x00" * (135 - len(message) % 136)
    padded[-1] |= 0x80
    lanes = {(x, y): 0 for x in range(5) for y in range(5)}
    for at in range(0, len(padded), 136):
        for k in range(17):
            lanes[k % 5, k // 5] ^= int.from_bytes(padded[at + 8 * k : at + 8 * k + 8], "little")
        for constant in constants:
            columns = [reduce(lambda a, y: a ^ lanes[x, y], range(5), 0) for x in range(5)]
            mixed = {(x, y): v ^ columns[x - 1] ^ turn(columns[(x + 1) % 5], 1) for (x, y), v in lanes.items()}
            moved = {(y, (2 * x + 3 * y) % 5): turn(v, rotation[x, y]) for (x, y), v in mixed.items()}
            lanes = {(x, y): v ^ (~moved[(x + 1) % 5, y] & moved[(x + 2) % 5, y]) for (x, y), v in moved.items()}
            lanes[0, 0] ^= constant
    return b"".join(lanes[k, 0].to_bytes(8, "little") for k in range(4))


@dataclass(frozen=True)
class Type:
    """A type: ``kind`` is uint, int, address, bool, fixed (bytesN), bytes, string, tuple or array."""

    kind: str
    bits: int = 0  # of numbers; bytes of fixed
    parts: tuple[Parameter, ...] = ()  # of tuples
    item: Type | None = None  # of arrays
    length: int | None = None  # of arrays of fixed length

    @property
    def name(self) -> str:
        """The name in signatures."""
        if self.kind == "array":
            return f"{self.item.name}[{'' if self.length is None else self.length}]"
        if self.kind == "tuple":
            return f"({','.join(p.type.name for p in self.parts)})"
        return {"uint": f"uint{self.bits}", "int": f"int{self.bits}", "fixed": f"bytes{self.bits}"}.get(self.kind, self.kind)

    @property
    def dynamic(self) -> bool:
        """Whether the value stands in the tail, its offset in the head."""
        if self.kind == "array":
            return self.length is None or self.item.dynamic
        return self.kind in ("bytes", "string") or any(p.type.dynamic for p in self.parts)

    @property
    def words(self) -> int:
        """Words in the head."""
        if self.dynamic:
            return 1
        if self.kind == "array":
            return self.length * self.item.words
        return sum(p.type.words for p in self.parts) if self.kind == "tuple" else 1


@dataclass(frozen=True)
class Parameter:
    name: str
    type: Type
    indexed: bool = False


_ATOM = re.compile(r"(uint|int|bytes)(\d*)$")


def parse_type(text: str, components: list[dict] | None = None) -> Type:
    """A type by its name in ABI JSON; an unknown one is an error."""
    if m := re.match(r"(.*)\[(\d*)\]$", text):
        return Type("array", item=parse_type(m[1], components), length=int(m[2]) if m[2] else None)
    if text == "tuple":
        return Type("tuple", parts=tuple(_parameters(components or [])))
    if text in ("address", "bool", "bytes", "string"):
        return Type(text)
    if text == "function":
        return Type("fixed", 24)
    if m := _ATOM.match(text):
        bits = int(m[2] or 256)
        if m[1] == "bytes" and 0 < bits <= 32:
            return Type("fixed", bits)
        if m[1] != "bytes" and bits % 8 == 0 and 0 < bits <= 256:
            return Type(m[1], bits)
    raise ValueError(f"not an ABI type: {text!r}")


def _parameters(inputs: list[dict]) -> list[Parameter]:
    """Parameters with names: those without one, or with one that is there already, get ``arg<n>``."""
    found, names = [], set()
    for k, p in enumerate(inputs):
        name = p.get("name") or f"arg{k}"
        name = f"arg{k}" if name.lower() in names else name
        names.add(name.lower())
        found.append(Parameter(name, parse_type(p["type"], p.get("components")), bool(p.get("indexed"))))
    return found


@dataclass(frozen=True)
class Entry:
    """An event or a function."""

    kind: str
    name: str
    inputs: tuple[Parameter, ...]
    outputs: tuple[Parameter, ...] = ()

    @property
    def signature(self) -> str:
        return f"{self.name}({','.join(p.type.name for p in self.inputs)})"

    @property
    def topic(self) -> str:
        return "0x" + keccak256(self.signature.encode()).hex()

    @property
    def selector(self) -> str:
        return self.topic[:10]

    @property
    def indexed(self) -> int:
        return sum(p.indexed for p in self.inputs)


@dataclass(frozen=True)
class Abi:
    entries: tuple[Entry, ...] = field(default=())

    def all(self, kind: str) -> dict[str, Entry]:
        """Entries by name, overloaded ones by signature."""
        own = [e for e in self.entries if e.kind == kind]
        names = [e.name for e in own]
        return {e.name if names.count(e.name) == 1 else e.signature: e for e in own}

    def one(self, kind: str, name: str) -> Entry:
        """An entry by name, signature, topic or selector; an error where there is none."""
        for e in self.entries:
            known = (e.signature, e.topic if kind == "event" else e.selector)
            if e.kind == kind and (name.lower() == known[1] or name == known[0] or self.all(kind).get(name) == e):
                return e
        raise ValueError(f"no {kind} {name!r} in the ABI; it has {sorted(self.all(kind))}")


def parse_abi(text: str | list | Abi) -> Abi:
    """ABI JSON, its text or what it was read into. Constructors, errors, fallbacks and anonymous events are left out."""
    if isinstance(text, Abi):
        return text
    items = json.loads(text) if isinstance(text, str) else text
    entries = {}
    for item in items if isinstance(items, list) else items.get("abi", [items]):
        kind = item.get("type", "function")
        if kind in ("event", "function") and not item.get("anonymous"):
            e = Entry(kind, item["name"], tuple(_parameters(item.get("inputs", []))), tuple(_parameters(item.get("outputs", []))))
            entries[kind, e.signature, e.indexed] = e
    return Abi(tuple(entries.values()))


# -- expressions -----------------------------------------------------------------
# Positions are characters from 1; ``d`` is hex data without 0x, text or its bytes.


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _word(d: Column, at: Column) -> Column:
    """64 hex digits; null where the data end before."""
    word = d.substr(at, F.lit(64)).cast("string")
    return F.when((at > 0) & (F.length(word) == 64), word)


def _size(word: Column) -> Column:
    """An offset or length as int; null from 2^28 on, as no data are as long."""
    return F.when(word.rlike("^0{57}[0-9a-fA-F]{7}$"), F.conv(F.substring(word, 58, 7), 16, 10).cast("int"))


def _signed(word: Column) -> Column:
    """Two's complement: of a negative number the inverted digits, and one more."""
    inverted = F.translate(F.lower(word), "0123456789abcdef", "fedcba9876543210")
    short = lambda t: (t.cast("decimal(37,0)") + 1).cast("string")
    long = lambda t: digits_to_string(_carried(string_to_digits(t), F.lit(1).cast("long"), 1, BASE)["out"])
    magnitude = _let(word_to_u256(inverted), lambda t: F.when(F.length(t) < 37, short(t)).otherwise(long(t)))
    return F.when(word.rlike("^[89a-fA-F]"), F.concat(F.lit("-"), magnitude)).otherwise(word_to_u256(word))


def _atom(kind: Type, word: Column) -> Column:
    """A word's value: numbers as decimal text, addresses and bytes as lower-case 0x text; null if it has other than hex digits."""
    if kind.kind == "address":
        value = F.concat(F.lit("0x"), F.lower(F.substring(word, 25, 40)))
    elif kind.kind == "bool":
        value = F.substring(word, 64, 1) != "0"
    elif kind.kind == "fixed":
        value = F.concat(F.lit("0x"), F.lower(F.substring(word, 1, 2 * kind.bits)))
    elif kind.kind == "uint" and kind.bits <= 56:
        value = F.conv(F.substring(word, 51, 14), 16, 10)
    else:
        return _let(word, lambda w: F.when(w.rlike("^[0-9a-fA-F]{64}$"), _signed(w) if kind.kind == "int" else word_to_u256(w)))
    return F.when(word.rlike("^[0-9a-fA-F]{64}$"), value)


def _of_kind(kind: Type):
    return lambda word: _atom(kind, word)


def _flat_atom(kind: Type, d: Column, at: int) -> Column:
    """``_atom`` of the word at a fixed place of data's bytes, all hex digits; most numbers have 49 zeros first."""
    cut = lambda start, n: F.substring(d, start, n).cast("string")
    if kind.kind == "address":
        return F.concat(F.lit("0x"), F.lower(cut(at + 24, 40)))
    if kind.kind == "bool":
        return cut(at + 63, 1) != "0"
    if kind.kind == "fixed":
        return F.concat(F.lit("0x"), F.lower(cut(at, 2 * kind.bits)))
    if kind.kind == "uint" and kind.bits <= 56:
        return F.conv(cut(at + 50, 14), 16, 10)
    word = cut(at, 64)
    rest = _signed(word) if kind.kind == "int" else word_to_u256(word)
    return F.when(cut(at, 49) == "0" * 49, F.conv(cut(at + 49, 15), 16, 10)).otherwise(rest)


def _struct(parts: tuple[Parameter, ...], d: Column, base: Column) -> Column:
    """The values of a tuple that starts at ``base``."""
    fields, at = [], 0
    for p in parts:
        fields.append(_value(p.type, d, base, base + 64 * at).alias(p.name))
        at += p.type.words
    return F.struct(*fields) if fields else F.struct(F.lit(None).cast("string").alias("none"))


def _items(kind: Type, d: Column, base: Column, n: Column) -> Column:
    """``n`` items from ``base`` on; null where the data can't hold as many."""
    width = 64 * kind.item.words
    item = lambda i: _value(kind.item, d, base, base + i * width)
    some = F.transform(F.sequence(F.lit(0), n - 1), item)
    none = F.slice(F.transform(F.array(F.lit(0)), item), 1, 0)  # an empty array of the type
    return F.when(n == 0, none).when(base.cast("long") - 1 + n.cast("long") * width <= F.length(d), some)


def _value(kind: Type, d: Column, base: Column, at: Column) -> Column:
    """A value whose head is at ``at`` in the tuple that starts at ``base``."""
    if kind.dynamic:
        return _let(base + _size(_word(d, at)) * 2, lambda start: _body(kind, d, start))
    if kind.kind == "array":
        return _items(kind, d, at, F.lit(kind.length))
    return _struct(kind.parts, d, at) if kind.kind == "tuple" else _atom(kind, _word(d, at))


def _body(kind: Type, d: Column, start: Column) -> Column:
    """A dynamic value at its place in the tail."""
    if kind.kind == "tuple":
        return F.when(start.isNotNull(), _struct(kind.parts, d, start))
    if kind.kind == "array" and kind.length is not None:
        return _items(kind, d, start, F.lit(kind.length))
    if kind.kind == "array":
        return _let(_size(_word(d, start)), lambda n: _items(kind, d, start + 64, n))
    size = _size(_word(d, start)) * 2
    body = d.substr(start + 64, size).cast("string")
    whole = F.when(F.length(body) == size, body)
    return F.make_valid_utf8(F.unhex(whole).cast("string")) if kind.kind == "string" else F.concat(F.lit("0x"), F.lower(whole))


def decode_data(parts: tuple[Parameter, ...], data: Column) -> Column:
    """Hex data, without 0x, as a struct of named values; a part that the data don't hold is null.

    Where all values are single words, and the data have them whole, the digits
    are checked once and the words taken by their places.
    """
    whole = lambda d: _struct(parts, d, F.lit(1))
    if not parts or any(p.type.dynamic or p.type.kind in ("array", "tuple") for p in parts):
        return cut_from(data, whole)
    flat = lambda d: F.struct(*[_flat_atom(p.type, d, 1 + 64 * k).alias(p.name) for k, p in enumerate(parts)])
    return _let(data, lambda d: F.when(d.rlike(f"^[0-9a-fA-F]{{{64 * len(parts)}}}"), _let(d.cast("binary"), flat)).otherwise(whole(d)))


def _event_values(event: Entry, topics: Column, data: Column) -> Column:
    """A struct of an event's values; an indexed value of more than a word is its hash."""
    held = tuple(p for p in event.inputs if not p.indexed)

    def found(read: Column) -> Column:
        topics, body = read["topics"], read["body"]
        fields, topic = [], 1
        for p in event.inputs:
            if p.indexed:
                topic += 1
                atom = Type("fixed", 32) if p.type.dynamic or p.type.kind in ("tuple", "array") else p.type
                fields.append(_let(F.substring(F.get(topics, F.lit(topic - 1)), 3, 64), _of_kind(atom)).alias(p.name))
            else:
                fields.append(body[p.name].alias(p.name))
        return F.struct(*fields) if fields else F.struct(F.lit(None).cast("string").alias("none"))

    body = decode_data(held, F.substring(data, 3, 1 << 30)) if held else F.lit(None)
    return _let(F.struct(topics.alias("topics"), body.alias("body")), found)


def _texts(struct: Column, parts: tuple[Parameter, ...]) -> Column:
    """The values of a struct as text, arrays and tuples as JSON."""

    def told(values: Column) -> Column:
        texts = [F.to_json(values[p.name]) if p.type.kind in ("array", "tuple") else values[p.name].cast("string") for p in parts]
        return F.array(*texts).cast("array<string>")

    return _let(struct, told) if parts else F.array().cast("array<string>")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that later projections and filters read, not repeat: a generator of one row."""
    return df.withColumn(name, F.explode(F.array(value)))


def _is_event(event: Entry, topics: str) -> Column:
    """By topic 0 and the number of topics: events may differ only in what is indexed."""
    commas = F.length(F.col(topics)) - F.length(F.replace(F.col(topics), F.lit(","), F.lit("")))
    return (F.lower(F.substring(F.col(topics), 1, 66)) == event.topic) & (commas == event.indexed)


def event_table(logs: DataFrame, abi: str | Abi, name: str, keep: list[str] | None = None, topics: str = "topics", data: str = "data") -> DataFrame:
    """The logs of one event: the columns ``keep`` (all, if None) and a column for each parameter, after its name.

    Numbers are decimal text of any size, addresses and bytes lower-case ``0x``
    text, flags booleans, tuples structs and arrays arrays of these. A parameter
    named like a kept column gets ``_`` before its name.
    """
    event = parse_abi(abi).one("event", name)
    own = logs.where(F.col(topics).startswith(event.topic) & _is_event(event, topics))
    kept = logs.columns if keep is None else keep
    found = _once(own, "_event", _event_values(event, F.split(F.col(topics), ","), F.col(data)))
    taken = {c.lower() for c in kept}
    return found.select(*kept, *[F.col(f"_event.`{p.name}`").alias(f"_{p.name}" if p.name.lower() in taken else p.name) for p in event.inputs])


def event_tables(logs: DataFrame, abi: str | Abi, keep: list[str] | None = None) -> dict[str, DataFrame]:
    """One table for each event of the ABI, by name, overloaded ones by signature."""
    abi = parse_abi(abi)
    return {name: event_table(logs, abi, e.signature if name == e.signature else name, keep) for name, e in abi.all("event").items()}


def decode_logs(logs: DataFrame, abi: str | Abi, topics: str = "topics", data: str = "data") -> DataFrame:
    """``logs`` with ``decoded``: struct(event_signature, event_params), null for events that the ABI doesn't have.

    ``event_signature`` is the event's name, ``event_params`` its values as text
    in order of declaration, arrays and tuples as JSON.
    """
    decoded = F.lit(None).cast("struct<event_signature:string,event_params:array<string>>")
    for event in parse_abi(abi).all("event").values():
        texts = _texts(_event_values(event, F.split(F.col(topics), ","), F.col(data)), event.inputs)
        decoded = F.when(_is_event(event, topics), F.struct(F.lit(event.name).alias("event_signature"), texts.alias("event_params"))).otherwise(decoded)
    return _once(logs, "decoded", decoded)


def _call_values(function: Entry, call: str) -> Column:
    return decode_data(function.inputs, F.substring(F.col(call), 11, 1 << 30))


def _is_call(function: Entry, call: str) -> Column:
    """By selector, with a whole head."""
    head = 10 + 64 * sum(p.type.words for p in function.inputs)
    return (F.lower(F.substring(F.col(call), 1, 10)) == function.selector) & (F.length(F.col(call)) >= head)


def call_table(calls: DataFrame, abi: str | Abi, name: str, keep: list[str] | None = None, call: str = "input") -> DataFrame:
    """The calls of one function (its name, signature or selector): ``keep`` and a column for each parameter."""
    function = parse_abi(abi).one("function", name)
    kept = calls.columns if keep is None else keep
    found = _once(calls.where(_is_call(function, call)), "_call", _call_values(function, call))
    taken = {c.lower() for c in kept}
    return found.select(*kept, *[F.col(f"_call.`{p.name}`").alias(f"_{p.name}" if p.name.lower() in taken else p.name) for p in function.inputs])


def decode_calls(calls: DataFrame, abi: str | Abi, call: str = "input", output: str | None = None) -> DataFrame:
    """``calls`` with ``decoded``: struct(function, inputs, outputs), null for functions that the ABI doesn't have.

    ``inputs`` and ``outputs`` are texts in order of declaration; ``outputs`` is
    null without a column ``output``, or where it is empty.
    """
    decoded = F.lit(None).cast("struct<function:string,inputs:array<string>,outputs:array<string>>")
    none = F.lit(None).cast("array<string>")
    for function in parse_abi(abi).all("function").values():
        inputs = _texts(_call_values(function, call), function.inputs)
        outputs = none
        if output and function.outputs:
            told = decode_data(function.outputs, F.substring(F.col(output), 3, 1 << 30))
            outputs = F.when(F.length(F.col(output)) > 2, _texts(told, function.outputs))
        made = F.struct(F.lit(function.name).alias("function"), inputs.alias("inputs"), outputs.alias("outputs"))
        decoded = F.when(_is_call(function, call), made).otherwise(decoded)
    return _once(calls, "decoded", decoded)
