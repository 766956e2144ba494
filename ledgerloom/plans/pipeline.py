"""Handlers, declarative specs, SQL names, and metrics of runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.abi import decode_swap_call, route_events
from ledgerloom.functions.contract_abi import Abi, call_table, event_table, parse_abi
from ledgerloom.operators.filters import block_between, by_selector
from ledgerloom.operators.joins import tx_receipt_join
from ledgerloom.plans.ledger import pair_swaps_job
from ledgerloom.plans.templates import found_contracts, template_events
from ledgerloom.schemas import EVENTS, SWAP_SELECTOR
from ledgerloom.sources.sinks import append, upsert

Handler = Callable[[DataFrame], DataFrame]


@dataclass
class Indexer:
    """Handlers bound to events, blocks, transactions, calls and found contracts.

    A handler maps a DataFrame to the rows of its entity. ``run`` resolves each
    to its source among the given tables, applies it and returns the results.
    """

    handlers: dict[str, tuple[Callable[[dict], DataFrame], Handler]] = field(default_factory=dict)

    def _bind(self, source: Callable[[dict], DataFrame]) -> Callable[[Handler], Handler]:
        def bind(handler: Handler) -> Handler:
            self.handlers[handler.__name__] = (source, handler)
            return handler

        return bind

    def on_event(self, contract: str | None, name: str, lo: int, hi: int, abi: str | Abi | None = None):
        """Logs of an event as a table of its parameters; without ``abi`` the event is one of the catalogue."""

        def source(tables: dict) -> DataFrame:
            logs = block_between(tables["logs"], lo, hi)
            logs = logs if contract is None else logs.where(F.col("address") == contract)
            return route_events(logs, [name])[name] if abi is None else event_table(logs, abi, name)

        return self._bind(source)

    def on_block(self, every: int = 1, lo: int = 0, hi: int = 1 << 62):
        return self._bind(lambda tables: block_between(tables["blocks"], lo, hi, "number").where(F.col("number") % every == 0))

    def on_transaction(self, receipts: bool = False):
        """Transactions, with ``receipts`` joined with theirs; those without one are dropped then."""
        return self._bind(lambda tables: tx_receipt_join(tables["transactions"], tables["receipts"]) if receipts else tables["transactions"])

    def on_call(self, contract: str | None, function: str, abi: str | Abi | None = None):
        """Calls of a function (name, signature or selector in ``abi``) as a table of its parameters.

        Without ``abi`` only the router's swap is known; another selector is an error.
        """
        if abi is None and function != SWAP_SELECTOR:
            raise ValueError(f"the function {function!r} needs an ABI")
        known = parse_abi(abi).one("function", function) if abi else None

        def source(tables: dict) -> DataFrame:
            calls = by_selector(tables["traces"].where("trace_type = 'call'"), known.selector if known else function)
            calls = calls if contract is None else calls.where(F.col("to_address") == contract)
            return call_table(calls, abi, known.signature) if known else decode_swap_call(calls)

        return self._bind(source)

    def template(self, factory: str | None = None, event: str = "PairCreated", param: str = "pair", child: str = "Swap", abi: str | Abi | None = None, repeat: bool = False):
        """Events ``child`` of the contracts that ``factory`` announces in ``event`` by ``param``.

        With ``repeat`` these contracts are factories too, at any depth. Without
        ``abi`` it is the swaps of the catalogue's pairs.
        """
        if abi is None:
            if (event, param, child, repeat) != ("PairCreated", "pair", "Swap", False):
                raise ValueError("other events than the catalogue's pairs need an ABI")
            return self._bind(lambda tables: pair_swaps_job(tables["logs"], factory))
        if factory is None:
            raise ValueError("a template needs its factory")
        known = parse_abi(abi)

        def source(tables: dict) -> DataFrame:
            contracts = found_contracts(tables["logs"], [factory], [(event, param)], known, repeat)
            return template_events(tables["logs"], contracts, child, known)

        return self._bind(source)

    def run(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return {name: handler(source(tables)) for name, (source, handler) in self.handlers.items()}


def register_sql_functions(spark: SparkSession) -> None:
    """SQL names for user SQL, as SQL functions over built-ins.

    ``to_u256(text)``, ``u256_mul(a, b)`` (exact text, null beyond 38 digits),
    ``topic_address(topic)``, ``data_word(data, k)``, ``log_signature(topics)``,
    ``event_param(topics, data, n)`` (the n-th parameter, from 1, of an event of
    addresses and numbers, as text; null for others).
    """
    words = "split(topics, ',')"
    event = {}
    for name, (topic, params) in EVENTS.items():
        if not params or any(not (kind == "address" or kind.startswith("uint")) for _, kind, _ in params):
            continue
        found, indexed, word = [], 1, 0
        for _, kind, is_topic in params:
            text = f"substring(try_element_at({words}, {indexed + 1}), 3, 64)" if is_topic else f"substring(data, {word * 64 + 3}, 64)"
            indexed, word = indexed + is_topic, word + (not is_topic)
            found.append(f"concat('0x', lower(substring({text}, 25, 40)))" if kind == "address" else f"word_number({text})")
        event[topic] = "element_at(array(" + ", ".join(found) + f"), case when n between 1 and {len(found)} then n end)"
    digit = "cast(conv(substring(w, {}, 8), 16, 10) as decimal(10,0))"
    low = " + ".join(f"{digit.format(33 + 8 * k)} * cast({1 << (32 * (3 - k))} as decimal({len(str(1 << (32 * (3 - k))))},0))" for k in range(4))
    made = {
        "to_u256(t string) returns decimal(38,0)": "try_cast(t as decimal(38,0))",
        # Null where the product has more than 38 digits; the column function has no such end.
        "u256_mul(a string, b string) returns string": "cast(try_multiply(try_cast(a as decimal(38,0)), try_cast(b as decimal(38,0))) as string)",
        # Null from 2^126 on, as DECIMAL(38,0) ends there.
        "word_number(w string) returns string": f"case when w rlike '^0{{32}}[0-3][0-9a-fA-F]{{31}}$' then cast(cast({low} as decimal(38,0)) as string) end",
        "event_param(topics string, data string, n int) returns string": "case " + " ".join(f"when lower(substring_index(topics, ',', 1)) = '{t}' then {e}" for t, e in event.items()) + " end",
        "topic_address(t string) returns string": "concat('0x', lower(substring(t, 27, 40)))",
        "data_word(d string, k int) returns string": "substring(d, k * 64 + 3, 64)",
        "log_signature(t string) returns string": "case "
        + " ".join(f"when lower(substring_index(t, ',', 1)) = '{topic}' then '{name}'" for name, (topic, _) in EVENTS.items())
        + " end",
    }
    for head, body in made.items():
        spark.sql(f"create or replace temporary function {head} return {body}")


def pipeline(spark: SparkSession, spec: dict, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Named sources, SQL transforms in any order, and sinks.

    ``spec`` has ``sources`` (name -> table), ``transforms`` (name -> SQL text,
    ``{name}`` standing for another relation) and ``sinks`` (name -> dict with
    ``from``, ``path`` and, for keyed tables, ``keys``). Spark parses the SQL;
    relations are handed over as named arguments, not as global views.
    """
    done = {name: tables[table] for name, table in spec.get("sources", {}).items()}
    open_ = dict(spec.get("transforms", {}))
    while open_:
        ready = [n for n, text in open_.items() if all("{" + other + "}" not in text for other in open_ if other != n)]
        if not ready:
            raise ValueError(f"transforms depend on each other: {sorted(open_)}")
        for n in ready:
            text = open_.pop(n)
            done[n] = spark.sql(text, **{k: v for k, v in done.items() if "{" + k + "}" in text})
    for sink in spec.get("sinks", {}).values():
        if sink.get("keys"):
            upsert(done[sink["from"]], sink["path"], sink["keys"])
        else:
            append(done[sink["from"]], sink["path"])
    return done


def parse_metric_logs(lines: DataFrame) -> DataFrame:
    """Last progress and the seconds by kind in text logs: ``path, progress, rpc, compute, storage``.

    ``lines`` has ``path, line_no, value``; figures look like ``rpc: 1.25s`` or ``42.5%``.
    """
    figure = lambda name: F.regexp_extract("value", rf"(?i)\b{name}\s*[:=]\s*([0-9]+(?:\.[0-9]+)?)\s*s", 1).try_cast("double")
    progress = F.regexp_extract("value", r"([0-9]+(?:\.[0-9]+)?)\s*%", 1).try_cast("double")
    found = lines.select("path", "line_no", progress.alias("progress"), *[figure(n).alias(n) for n in ("rpc", "compute", "storage")])
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c) for c in ("progress", "rpc", "compute", "storage")]
    return found.groupBy("path").agg(*latest)


def throughput(runs: DataFrame) -> DataFrame:
    """Blocks and records a second, minutes, and progress clipped at 100 %."""
    per = lambda c: F.when(F.col("seconds") > 0, F.round(F.col(c) / F.col("seconds"), 6)).otherwise(0.0)
    done = F.when(F.col("total") > 0, F.least(F.round(F.col("blocks") * 100.0 / F.col("total"), 6), F.lit(100.0))).otherwise(0.0)
    return runs.select("case", per("blocks").alias("blocks_per_s"), per("records").alias("records_per_s"), F.round(F.col("seconds") / 60, 6).alias("minutes"), done.alias("progress"))
