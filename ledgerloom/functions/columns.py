"""Column functions: ids, addresses, hashes, times, points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.u256 import u256_mul
from ledgerloom.schemas import POINTS_PER_DAY, ZERO_ADDRESS


def log_id(chain: Column, block: Column, index: Column) -> Column:
    return F.concat_ws("_", chain, block, index)


def tx_log_id(tx: Column, index: Column) -> Column:
    return F.concat_ws("-", tx, index)


def trace_id(tx: Column, address: Column) -> Column:
    """Transaction and trace address; an empty address is ``0``."""
    path = F.when(F.size(address) == 0, "0").otherwise(F.array_join(address.cast("array<string>"), "-"))
    return F.concat_ws("-", tx, path)


def snapshot_id(account: Column, ts: Column) -> Column:
    return F.concat_ws("-", account, ts)


def split_id(id_: Column, part: int, by: str = "-") -> Column:
    """A part, from 1, of a composite id; empty if it has fewer."""
    return F.split_part(id_, F.lit(by), F.lit(part))


def topic_to_address(topic: Column) -> Column:
    """The last 20 of a topic's 32 bytes."""
    return F.concat(F.lit("0x"), F.lower(F.substring(topic, 27, 40)))


def data_word(data: Column, k: int | Column) -> Column:
    """The k-th 32-byte word of ``0x`` data, text or its bytes: 64 hex digits."""
    k = F.lit(k) if isinstance(k, int) else k
    return data.substr(k * 64 + 3, F.lit(64)).cast("string")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def cut_from(text: Column, body) -> Column:
    """``body(text)`` for a body that cuts many pieces by their places.

    It gets the bytes where each character is one: a piece of bytes is found at
    once, where one of text is found by counting all characters before it.
    """
    return let(text, lambda t: F.when(F.octet_length(t) == F.length(t), let(t.cast("binary"), body)).otherwise(body(t)))


def data_word_address(data: Column, k: int) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.substring(data, 27 + 64 * k, 40)))


def method_selector(call: Column) -> Column:
    """The first ten characters of an input that has as many."""
    return F.when(F.length(call) >= 10, F.substring(call, 1, 10))


def parse_list(text: Column) -> Column:
    """``["a","b"]`` to ``a,b``."""
    return F.regexp_replace(text, r'[\[\]" ]', "")


def list_length(text: Column) -> Column:
    """Items of comma text; none in empty text."""
    return F.when(text.isNull(), None).when(text == "", 0).otherwise(F.size(F.split(text, ",")))


def gas_value(used: Column, effective: Column, price: Column) -> Column:
    """Gas times the effective price, or the gas price where that is null; exact text."""
    return u256_mul(used, F.coalesce(effective, price))


def points_rate(balance: Column, seconds: Column) -> Column:
    """Points of holding a balance for some seconds, as text with six places; exact up to 38 digits of unit-seconds, beyond that an error."""
    return points_of(unit_seconds(balance, seconds))


def unit_seconds(balance: Column, seconds: Column) -> Column:
    """Balance times seconds, DECIMAL(38,0); more digits are an error, never a rounded value."""
    return (balance.cast("decimal(38,0)") * seconds.cast("decimal(12,0)")).cast("decimal(38,0)")


def points_of(held: Column) -> Column:
    """Points of some unit-seconds as text with six places, rounded half up; exact for 38 digits of them.

    A decimal of six places would leave 32 digits before them. The division by a
    day is done on pieces of 18, 10 and 10 digits, in long.
    """
    div, day, step = (lambda a, b: F.call_function("div", a, b)), F.lit(86400).cast("long"), F.lit(10**10)
    # abs() of a decimal keeps 34 digits; a difference keeps all.
    held = held.cast("decimal(38,0)")
    size = F.when(held < 0, (F.lit(0).cast("decimal(38,0)") - held).cast("decimal(38,0)")).otherwise(held)
    tail = (size % F.lit(str(10**20)).cast("decimal(21,0)")).cast("decimal(20,0)")
    high, mid, low = div(size, F.lit(str(10**20)).cast("decimal(21,0)")), div(tail, step), (tail % step).cast("long")
    mid = high % day * step + mid
    low = mid % day * step + low
    # Millionths of what is left of a day, a day's at most.
    part = div(low % day * F.lit(POINTS_PER_DAY * 10**6) + F.lit(43200), day)
    number = lambda v, zeros: v.cast("decimal(18,0)") * F.lit(str(10**zeros)).cast(f"decimal({zeros + 1},0)")
    days = (number(div(high, day), 20).cast("decimal(34,0)") + number(div(mid, day), 10)).cast("decimal(34,0)") + div(low, day)
    whole = (days.cast("decimal(34,0)") * F.lit(POINTS_PER_DAY).cast("decimal(4,0)")).cast("decimal(38,0)") + div(part, F.lit(10**6)).cast("decimal(10,0)")
    return F.concat(F.when(held < 0, "-").otherwise(""), whole.cast("decimal(38,0)").cast("string"), F.lit("."), F.lpad((part % 10**6).cast("string"), 6, "0"))


def points_rate_floor(balance: Column, seconds: Column) -> Column:
    """The same in whole units, rounded down, for balances of zero and more."""
    return F.call_function("div", balance * seconds * F.lit(POINTS_PER_DAY), F.lit(86400))


def sqrt_points(balance: Column) -> Column:
    """Square root of the balance over 10^8; nothing for none."""
    return F.when(balance <= 0, 0.0).otherwise(F.sqrt(balance / F.lit(1e8)))


def log1p_clip(value: Column) -> Column:
    return F.log1p(value)


def lower_address(address: Column) -> Column:
    return F.lower(F.trim(address))


def normalize_hash(h: Column) -> Column:
    """Lower-case without ``0x``; null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(h, F.lit(""))), "^0x", "")


def bytes_to_hex(b: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(b)))


def hex_to_bytes(h: Column) -> Column:
    return F.unhex(F.regexp_replace(h, "^0x", ""))


def path_join(path: Column) -> Column:
    return F.array_join(path, ",")


def path_tokens(text: Column) -> Column:
    """Tokens of comma text; text without commas is cut every 42 characters."""
    count = F.greatest(F.ceil(F.length(text) / 42), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: text.substr(i * 42 + 1, F.lit(42)))
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).when(F.locate(",", text) > 0, F.split(text, ",")).otherwise(cut)


def epoch_seconds(ts: Column) -> Column:
    """Seconds from seconds or milliseconds, told apart at 10^10."""
    return F.when(ts > 10_000_000_000, F.floor(ts / 1000)).otherwise(ts).cast("long")


def epoch_millis(ts: Column) -> Column:
    return F.when(ts > 10_000_000_000, ts).otherwise(ts * 1000).cast("long")


def iso_time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def valid_address(address: Column) -> Column:
    return F.coalesce(address.rlike("^0x[0-9a-f]{40}$"), F.lit(False))


def repair_address(address: Column) -> Column:
    """Adds ``0x`` to 40 bare hex digits."""
    return F.when(address.rlike("^[0-9a-f]{40}$"), F.concat(F.lit("0x"), address)).otherwise(address)


def is_mint(sender: Column) -> Column:
    return sender == F.lit(ZERO_ADDRESS)


def block_from_meta(meta: Column) -> Column:
    """The block number in ``chain:block:...``; null if there is none."""
    return F.split_part(meta, F.lit(":"), F.lit(2)).try_cast("long")


def fingerprint(*parts: Column, by: str = ":") -> Column:
    """Key text of normalised parts; a null part gives no key."""
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known = known & p.isNotNull()
    return F.when(known, F.concat_ws(by, *[F.lower(p.cast("string")) for p in parts]))
