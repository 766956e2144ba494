"""Running values over the rows of a key in order, where one key may hold any part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key with more than this part of all rows is cut into ranges, so fewer keys than this are.
SHARE = 1024
#: Rows of one key that a task puts in order at least; only keys with more are cut.
DEPTH = 1 << 18
#: Places that are looked at, on average, for each range.
LOOKS = 64


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def ordered_scan(
    df: DataFrame,
    key: str,
    order: list[str],
    sums: dict[str, str] | None = None,
    before: dict[str, str] | None = None,
    known: dict[str, str] | None = None,
    highest: dict[str, str] | None = None,
    depth: int = DEPTH,
    sized: DataFrame | None = None,
    after: dict[str, str] | None = None,
    first: dict[str, str] | None = None,
    most: int | None = None,
) -> DataFrame:
    """``df`` with running values per ``key`` in ``order``, ascending, nulls first.

    Each argument names new columns by columns of ``df``: ``sums`` up to and with
    the row, ``before`` the row before's value, ``known`` the last value up to
    and with the row that is not null, ``highest`` the greatest of the rows before,
    ``after`` the next row's value, ``first`` the first value up to and with the row that is not null.

    Rows are counted by key first (``sized`` is another table with the key whose
    counts bound those of ``df``), unless no key can have more than ``most`` and that is within ``depth``. A key with more rows than ``depth`` and than
    1/SHARE of all is cut into ranges of ``order`` of like depth, by a sample of
    its places that a hash picks; of a range only its totals, one row, go on to
    the ranges after it. Those are fewer than 2 * SHARE rows and broadcast; all
    else is one shuffle. Rows that are equal in all of ``order`` stay in one range, and
    which of them is first is open. An empty table gives an empty one.
    """
    sums, before, known, highest, after, first = sums or {}, before or {}, known or {}, highest or {}, after or {}, first or {}
    taken = {c.lower() for c in (*df.columns, *sums, *before, *known, *highest, *after, *first)}
    mark = next(m for m in ("_scan" + "_" * k for k in range(len(taken) + 1)) if not any(c.startswith(m) for c in taken))
    of, n, part, cut, place, end = (f"{mark}{c}" for c in ("key", "n", "part", "cut", "place", "end"))
    counts = (df if sized is None else sized).groupBy(_col(key).alias(of)).agg(F.count("*").alias(n))
    total = 0
    if most is None or most > depth:
        total, most = counts.agg(F.sum(n), F.max(n)).first()
    limit = max(depth, (total or 0) // SHARE)
    rows, by = df, [_col(key)]
    if (most or 0) > limit:
        rows = _ranged(df, key, order, counts.where(F.col(n) > limit), limit, (of, n, part, cut))
        by.append(F.col(part))
    within = Window.partitionBy(*by).orderBy(*map(_col, order))
    upto, past = within.rowsBetween(Window.unboundedPreceding, 0), within.rowsBetween(Window.unboundedPreceding, -1)
    made = {c: F.sum(_col(x)).over(upto) for c, x in sums.items()} | {c: F.lag(_col(x)).over(within) for c, x in before.items()}
    made |= {c: F.last(_col(x), ignorenulls=True).over(upto) for c, x in known.items()} | {c: F.max(_col(x)).over(past) for c, x in highest.items()}
    made |= {c: F.lead(_col(x)).over(within) for c, x in after.items()} | {c: F.first(_col(x), ignorenulls=True).over(upto) for c, x in first.items()}
    if rows is df:
        return df.withColumns(made)
    at = F.struct(*map(_col, order))
    totals = rows.where(F.col(cut).isNotNull()).groupBy(_col(key).alias(of), F.col(part).alias(n)).agg(
        *[F.sum(_col(x)).alias(f"{mark}_{c}") for c, x in sums.items()], *[F.max_by(_col(x), at).alias(f"{mark}_{c}") for c, x in before.items()],
        *[F.max_by(_col(x), F.when(_col(x).isNotNull(), at)).alias(f"{mark}_{c}") for c, x in known.items()], *[F.max(_col(x)).alias(f"{mark}_{c}") for c, x in highest.items()],
        *[F.min_by(_col(x), at).alias(f"{mark}_{c}") for c, x in after.items()], *[F.min_by(_col(x), F.when(_col(x).isNotNull(), at)).alias(f"{mark}_{c}") for c, x in first.items()],
    )
    ranges = Window.partitionBy(of).orderBy(n)
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    kinds = [(sums, lambda c: F.sum(c).over(earlier)), (before, lambda c: F.lag(c).over(ranges)), (known, lambda c: F.last(c, ignorenulls=True).over(earlier)), (highest, lambda c: F.max(c).over(earlier))]
    kinds += [(after, lambda c: F.lead(c).over(ranges)), (first, lambda c: F.first(c, ignorenulls=True).over(earlier))]
    carried = totals.select(of, n, *[f(_col(f"{mark}_{c}")).alias(f"{mark}_{c}") for names, f in kinds for c in names])
    held = rows.withColumns({f"{mark}.{c}": e for c, e in made.items()} | {place: F.row_number().over(within), end: F.lead(F.lit(False), 1, True).over(within)})
    joined = held.join(F.broadcast(carried), _col(key).eqNullSafe(F.col(of)) & (F.col(part) == F.col(n)), "left")
    own, past_ = lambda c: _col(f"{mark}.{c}"), lambda c: _col(f"{mark}_{c}")
    kind = {c: held.schema[f"{mark}.{c}"].dataType for c in made}
    out = {c: F.coalesce((own(c) + past_(c)).cast(kind[c]), own(c), past_(c)) for c in sums} | {c: F.when(F.col(place) == 1, past_(c)).otherwise(own(c)) for c in before}
    out |= {c: F.coalesce(own(c), past_(c)) for c in known} | {c: F.greatest(own(c), past_(c)) for c in highest}
    out |= {c: F.when(F.col(end), past_(c)).otherwise(own(c)) for c in after} | {c: F.coalesce(past_(c), own(c)) for c in first}
    return joined.select(*map(_col, df.columns), *[e.alias(c) for c, e in out.items()])


def _ranged(df: DataFrame, key: str, order: list[str], hot: DataFrame, limit: int, names: tuple[str, ...]) -> DataFrame:
    """``df`` with each row's range, and the cuts of its key (null for a key that isn't cut)."""
    of, n, part, cut = names
    at, parts = F.struct(*map(_col, order)), F.ceil(F.max(n) / limit).cast("int")
    looked = df.join(F.broadcast(hot), _col(key).eqNullSafe(F.col(of))).where(F.pmod(F.xxhash64(at), F.lit(max(1, limit // LOOKS))) == 0)
    found = looked.groupBy(of).agg(F.sort_array(F.collect_set(at)).alias(cut), parts.alias(n))
    step = lambda i: F.get(cut, F.floor(i * F.size(cut) / F.col(n)).cast("int"))
    cuts = found.select(of, F.transform(F.sequence(F.lit(1), F.col(n) - 1), step).alias(cut))
    # The number of cuts at or before the row, by halving.
    halves = F.array(*[F.lit(1 << b) for b in reversed(range((2 * SHARE).bit_length()))])
    where = F.aggregate(halves, F.lit(0), lambda pos, size: F.when(F.get(cut, pos + size - 1) <= at, pos + size).otherwise(pos))
    return df.join(F.broadcast(cuts), _col(key).eqNullSafe(F.col(of)), "left").withColumn(part, where).drop(of)
