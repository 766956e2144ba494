"""Projections, filters and predicates on raw tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import valid_address
from ledgerloom.schemas import ZERO_ADDRESS


def block_between(df: DataFrame, lo: int, hi: int, col: str = "block_number", end: str = "inclusive") -> DataFrame:
    """Rows in a block range; ``end`` says whether ``hi`` itself is in."""
    if end not in ("inclusive", "exclusive"):
        raise ValueError("end is inclusive or exclusive")
    below = F.col(col) <= hi if end == "inclusive" else F.col(col) < hi
    return df.where((F.col(col) >= lo) & below)


def exclude_zero_address(df: DataFrame, col: str = "account") -> DataFrame:
    return df.where(F.col(col) != F.lit(ZERO_ADDRESS))


def by_signature(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("decoded.event_signature") == name)


def by_selector(df: DataFrame, selector: str, col: str = "input") -> DataFrame:
    return df.where(F.col(col).startswith(selector))


def require_fields(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows in which none of the columns is null or empty text."""
    kinds = dict(df.dtypes)
    return reduce(lambda d, c: d.where(F.col(c) != "") if kinds[c] == "string" else d, cols, df.dropna(subset=cols))


def valid_gas(df: DataFrame) -> DataFrame:
    """Transactions with gas used and at least one price."""
    return df.where(F.col("gas_used").isNotNull() & (F.col("effective_gas_price").isNotNull() | F.col("gas_price").isNotNull()))


def min_path(df: DataFrame, n: int = 2, col: str = "path") -> DataFrame:
    return df.where(F.size(F.col(col)) >= n)


def coalesce_default(col: Column, default: object) -> Column:
    return F.coalesce(col, default if isinstance(default, Column) else F.lit(default))


def flag_addresses(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with ``bad_addresses``: the names of columns that hold no valid address."""
    bad = F.array(*[F.when(~valid_address(F.col(c)), F.lit(c)) for c in cols])
    return df.withColumn("bad_addresses", F.array_compact(bad))


def project_blocks(df: DataFrame) -> DataFrame:
    return df.select(F.col("number").cast("string").alias("id"), "number", "hash", F.col("parent_hash"), "timestamp")


def project_transfers(decoded: DataFrame) -> DataFrame:
    """Transfers from decoded Transfer logs: id, sender, recipient, exact value text, position."""
    params = F.col("decoded.event_params")
    return decoded.select(
        "id",
        F.element_at(params, 1).alias("from_addr"),
        F.element_at(params, 2).alias("to_addr"),
        F.element_at(params, 3).alias("value"),
        "block_number",
        "block_timestamp",
        "transaction_hash",
    )
