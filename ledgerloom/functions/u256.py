"""Exact integers of 256 bits and more, as column expressions.

Amounts that fit are DECIMAL(38,0). Beyond that a number is an array of nine or
more base-10^9 digits, lowest first, made and printed by built-in functions, so
nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE, LIMB = 10**9, 1 << 32
DIGITS = 9


def hex_word(text: Column) -> Column:
    """A hex quantity, with or without 0x, as 64 digits; null, empty and malformed give zero."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "^0x", "")
    return F.lpad(F.when(bare.rlike("^[0-9a-f]{1,64}$"), bare).otherwise(F.lit("0")), 64, "0")


def limbs(word: Column) -> Column:
    """Eight 32-bit words of 64 hex digits, highest first."""
    return F.array(*[F.conv(F.substring(word, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(8)])


def _carried(values: Column, start: Column, factor: int, base: int) -> Column:
    """Digits of ``sum(values[i] * factor) + start`` in ``base``, lowest first, as struct(carry, out)."""
    first = F.struct(start.alias("carry"), F.array().cast("array<long>").alias("out"))

    def step(held: Column, v: Column) -> Column:
        total = v * F.lit(factor) + held["carry"]
        return F.struct(F.call_function("div", total, F.lit(base)).alias("carry"), F.concat(held["out"], F.array(total % F.lit(base))).alias("out"))

    return F.aggregate(values, first, step)


def digits_of_limbs(parts: Column) -> Column:
    """Base-10^9 digits of 32-bit words, highest first."""
    zero = F.array_repeat(F.lit(0).cast("long"), DIGITS)
    return F.aggregate(parts, zero, lambda digits, limb: _carried(digits, limb, LIMB, BASE)["out"])


def digits_to_string(digits: Column) -> Column:
    joined = F.array_join(F.transform(F.reverse(digits), lambda d: F.lpad(d.cast("string"), 9, "0")), "")
    short = F.regexp_replace(joined, "^0+", "")
    return F.when(short == "", "0").otherwise(short)


def string_to_digits(text: Column) -> Column:
    """Digits of a decimal string; anything but digits counts as zero."""
    width = 9 * DIGITS
    good = F.when(text.rlike(f"^[0-9]{{1,{width}}}$"), text).otherwise(F.lit("0"))
    padded = F.lpad(good, width, "0")
    return F.array(*[F.substring(padded, 1 + 9 * i, 9).cast("long") for i in reversed(range(DIGITS))])


def hex_to_decimal(text: Column) -> Column:
    """A hex quantity as DECIMAL(38,0); null from 2^126 on."""
    l = limbs(hex_word(text))  # noqa: E741
    power = lambda n: F.lit(str(1 << n)).cast("decimal(38,0)")
    low = l[4].cast("decimal(10,0)") * power(96).cast("decimal(29,0)") + l[5].cast("decimal(10,0)") * power(64).cast("decimal(20,0)")
    low = low + l[6].cast("decimal(10,0)") * power(32).cast("decimal(10,0)") + l[7]
    return F.when((l[0] == 0) & (l[1] == 0) & (l[2] == 0) & (l[3] == 0) & (l[4] < 1 << 30), low.cast("decimal(38,0)"))


def word_to_u256(word: Column) -> Column:
    """64 hex digits as exact decimal text; anything else gives ``0``.

    Most amounts fit in 60 bits and take one conversion, most of the rest in 124.
    """
    high, low = (F.conv(F.substring(word, at, n), 16, 10).cast("decimal(20,0)") for at, n in ((34, 15), (49, 16)))
    return (
        F.when(~F.coalesce(word.rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), "0")
        .when(F.substring(word, 1, 49) == "0" * 49, F.conv(F.substring(word, 50, 15), 16, 10))
        .when(F.substring(word, 1, 33) == "0" * 33, (high.cast("decimal(19,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)") + low).cast("decimal(38,0)").cast("string"))
        .otherwise(digits_to_string(digits_of_limbs(limbs(word))))
    )


def hex_to_u256(text: Column) -> Column:
    """A hex quantity as exact decimal text; null, empty and malformed give ``0``."""
    return F.transform(F.array(hex_word(text)), word_to_u256)[0]


def to_u256(text: Column) -> Column:
    """Decimal text as DECIMAL(38,0); null where it doesn't fit."""
    return text.cast("string").try_cast("decimal(38,0)")


def safe_to_u256(value: Column) -> Column:
    """Lenient parse: null and bad text give 0, ``1.23e+21`` is written out."""
    text = value.cast("string")
    return F.coalesce(
        F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), text.try_cast("decimal(38,0)")),
        F.when(text.rlike(r"^\s*[+-]?[0-9.]+[eE][+-]?[0-9]+\s*$"), text.try_cast("decimal(38,0)")),
        F.lit(0).cast("decimal(38,0)"),
    )


def u256_mul(a: Column, b: Column) -> Column:
    """Exact product of two non-negative decimals or decimal texts, as text."""
    a, b = a.cast("string"), b.cast("string")
    fast = F.try_multiply(a.try_cast("decimal(20,0)"), b.try_cast("decimal(18,0)")).cast("string")

    def slow(pair: Column) -> Column:
        """Schoolbook product of nine digits each; a column sum stays below 2^63."""
        last = DIGITS - 1
        sums = F.transform(
            F.sequence(F.lit(0), F.lit(2 * last)),
            lambda k: F.aggregate(
                F.sequence(F.greatest(k - last, F.lit(0)), F.least(k, F.lit(last))), F.lit(0).cast("long"), lambda s, i: s + pair["x"][i] * pair["y"][k - i]
            ),
        )
        return F.transform(F.array(_carried(sums, F.lit(0).cast("long"), 1, BASE)), lambda h: digits_to_string(F.concat(h["out"], F.array(h["carry"]))))[0]

    parts = F.array(F.struct(string_to_digits(a).alias("x"), string_to_digits(b).alias("y")))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(fast, F.transform(parts, slow)[0]))


def u256_sum(text: Column) -> Column:
    """Exact sum of hex quantities as decimal text: an aggregate, up to 2^31 rows.

    Each 32-bit word is summed by itself, so partial sums are added before the
    shuffle; carries are settled once at the end.
    """
    word = hex_word(text)
    sums = [F.sum(F.conv(F.substring(word, 1 + 8 * i, 8), 16, 10).cast("long")) for i in range(8)]
    held = _carried(F.array(*[F.coalesce(s, F.lit(0)) for s in reversed(sums)]), F.lit(0).cast("long"), 1, LIMB)
    return digits_to_string(digits_of_limbs(F.reverse(F.concat(held["out"], F.array(held["carry"])))))


def _sum_parts(value: Column) -> list[Column]:
    """Sums of a non-negative amount's digits in groups of nine, lowest first."""
    padded = F.lpad(F.coalesce(F.when(value.rlike(f"^[0-9]{{1,{9 * DIGITS}}}$"), value), F.lit("0")), 9 * DIGITS, "0")
    return [F.coalesce(F.sum(F.substring(padded, 1 + 9 * i, 9).cast("long")), F.lit(0)) for i in reversed(range(DIGITS))]


def decimal_sum(value: Column) -> Column:
    """Exact sum of non-negative amounts, decimals or decimal text of up to 81 digits, as text.

    Groups of nine digits are summed by themselves, up to 2^33 rows, so partial
    sums are added before the shuffle; carries are settled once at the end.
    """
    held = _carried(F.array(*_sum_parts(value.cast("string"))), F.lit(0).cast("long"), 1, BASE)
    return digits_to_string(F.concat(held["out"], F.array(held["carry"])))


def u256_avg(value: Column) -> Column:
    """Mean of amounts as struct(mean, floor): a double, and the exact whole part as text; null without any.

    The sum and the count are exact; the quotient is divided digit by digit.
    """
    n = F.count(value)
    held = _carried(F.array(*_sum_parts(value.cast("string"))), F.lit(0).cast("long"), 1, BASE)
    digits = F.reverse(F.concat(held["out"], F.array(held["carry"])))

    def divided(rows: Column) -> Column:
        first = F.struct(F.lit(0).cast("decimal(20,0)").alias("rest"), F.array().cast("array<long>").alias("out"))

        def step(h: Column, d: Column) -> Column:
            total = (h["rest"] * F.lit(BASE) + d).cast("decimal(30,0)")
            return F.struct((total % rows).cast("decimal(20,0)").alias("rest"), F.concat(h["out"], F.array(F.call_function("div", total, rows).cast("long"))).alias("out"))

        return F.aggregate(digits, first, step)

    whole = divided(F.greatest(n, F.lit(1)).cast("decimal(20,0)"))
    floor = digits_to_string(F.reverse(whole["out"]))
    return F.when(n > 0, F.struct((floor.cast("double") + whole["rest"].cast("double") / n).alias("mean"), floor.alias("floor")))


def scale_down(value: Column, decimals: int) -> Column:
    """Integer amount to an amount with ``decimals`` decimal places."""
    return (value.cast("decimal(38,0)") / F.lit(str(10**decimals)).cast(f"decimal({decimals + 1},0)")).cast("decimal(38,18)")


def scale_up(value: Column, decimals: int) -> Column:
    """Decimal text with a fraction to a whole number of its smallest unit, as text; further places are cut off.

    ``1.5`` with 18 decimals is ``1500000000000000000``. Anything but digits
    with at most one point is null.
    """
    text = F.trim(value.cast("string"))
    whole, part = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    joined = F.concat(whole, F.rpad(part, decimals, "0")) if decimals else whole
    short = F.regexp_replace(joined, "^0+", "")
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]*)?$"), F.when(short == "", "0").otherwise(short))
