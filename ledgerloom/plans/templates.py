"""Contracts that other contracts announce in events, and the events of these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.contract_abi import Abi, event_table, parse_abi
from ledgerloom.session import written


def _creations(logs: DataFrame, abi: Abi, event: str, param: str) -> DataFrame:
    """``parent, address, block_number, log_index`` of each announcement."""
    if param not in [p.name for p in abi.one("event", event).inputs]:
        raise ValueError(f"{event} has no parameter {param!r}")
    kept = logs.select(F.lower("address").alias("_parent"), "block_number", "log_index", "topics", "data")
    told = event_table(kept, abi, event, ["_parent", "block_number", "log_index"])
    name = f"_{param}" if param in ("_parent", "block_number", "log_index") else param
    return told.select(F.col("_parent").alias("parent"), F.lower(name).alias("address"), "block_number", "log_index").where("address is not null")


def _after(rows: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is registered, from the registration's position on; each once."""
    known = registry.select(F.col("address").alias("_known"), F.struct("block_number", "log_index").alias("_since"))
    return rows.join(known, (F.col(key) == F.col("_known")) & (F.struct("block_number", "log_index") >= F.col("_since")), "left_semi")


def _first(creations: DataFrame) -> DataFrame:
    """Each contract at its first creation."""
    at = F.min(F.struct("block_number", "log_index")).alias("_at")
    return creations.groupBy("address").agg(at).select("address", "_at.block_number", "_at.log_index")


def found_contracts(logs: DataFrame, factories: list[str], levels: list[tuple[str, str]], abi: str | Abi, repeat: bool = False) -> DataFrame:
    """``address, block_number, log_index, level`` of the contracts that come from some factories.

    ``levels`` names an event and its parameter for each generation: the first
    is emitted by ``factories``, the next by the contracts that it announces. With
    ``repeat`` the last level goes on for as long as there are new contracts
    (factories of factories at any depth). A contract counts from its first
    creation, and what it announces earlier does not count. Each level is one
    join against the contracts of the level before, written as a table.
    """
    abi, level = parse_abi(abi), 0
    creations = _creations(logs, abi, *levels[0])
    new = written(_first(creations.where(F.col("parent").isin([f.lower() for f in factories]))), "contracts")
    found = new.withColumn("level", F.lit(1))
    while level + 1 < len(levels) or repeat:
        level += 1
        if level < len(levels):
            creations = _creations(logs, abi, *levels[level])
        elif level == len(levels):
            creations = written(creations, "creations")
        own = _first(_after(creations, new, "parent"))
        new = written(own.join(found.select("address"), "address", "left_anti"), "contracts")
        if level >= len(levels) and new.isEmpty():
            break
        found = found.unionByName(new.withColumn("level", F.lit(level + 1)))
    return found


def template_events(logs: DataFrame, contracts: DataFrame, event: str, abi: str | Abi, keep: list[str] | None = None) -> DataFrame:
    """An event's table, of found contracts only and from their creation on."""
    return event_table(_after(logs.withColumn("address", F.lower("address")), contracts, "address"), abi, event, keep)
