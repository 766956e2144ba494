"""URL filters: host-suffix and path-prefix expressions met by hash prefix.

Everything is DataFrame functions; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.joins import spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #``, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and what follows each of its dots."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def path_prefixes(path: Column, lengths: list[int]) -> Column:
    """The prefixes of a path that have one of the given lengths."""
    fitting = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length(path))
    return F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def url_verdicts(pages: DataFrame, rules: DataFrame, prefix: int = 8, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    ``rules`` has ``host, path, action``. A rule fits its host and all
    subdomains, if the page's path starts with the rule's. Of the rules that
    fit, the longest wins (ties: the longer host, then ``block``, then the
    smaller action). Pages that no rule fits get ``default`` and a null rule.

    Each distinct URL is expanded into host suffix + path prefix expressions;
    only path lengths that some rule has are made (their number is bounded by
    the longest rule path, not by the rules). Expressions and rules meet on the
    first ``prefix`` hex digits of their SHA-256, then full digests are
    compared. Spark broadcasts the rules only below its own size threshold,
    otherwise the join is a shuffle on the hash prefix. Verdicts go back to the
    pages by URL; the pages of a very frequent one are dealt over tasks.

    Null URLs and those without ``://`` have empty host and path, which no rule
    fits. Repeated pages and null ids come back as often as they came. Further
    columns are ignored. No rules at all: every page gets the default.
    """
    made = rules.select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("action")
    ).where("rule_host is not null and action is not null")
    keyed = made.select(
        _digest(F.concat("rule_host", "rule_path")).alias("rule_digest"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.length("rule_host").alias("host_length"),
        "action",
    ).withColumn("rule_prefix", F.substring("rule_digest", 1, prefix))
    lengths = sorted(r[0] for r in made.select(F.length("rule_path")).distinct().collect())

    parsed = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    told, untold = parsed.where("host <> ''"), parsed.where("host = ''")
    distinct = told.select("host", "path").distinct()
    suffixes = distinct.withColumn("suffix", F.explode(host_suffixes(F.col("host"))))
    expressions = suffixes.withColumn("start", F.explode(path_prefixes(F.col("path"), lengths)))
    digests = expressions.select(
        "host", "path", F.length("suffix").alias("suffix_length"), _digest(F.concat("suffix", "start")).alias("digest")
    ).withColumn("digest_prefix", F.substring("digest", 1, prefix))
    met = digests.join(
        keyed,
        (F.col("digest_prefix") == F.col("rule_prefix")) & (F.col("digest") == F.col("rule_digest")) & (F.col("suffix_length") == F.col("host_length")),
    )
    best = met.groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), "host_length", F.col("action") == "block", F.col("rule"))).alias("best")
    )
    # One URL may be that of very many pages; pages without a host meet no rule.
    judged = spread_join(told, best, ["host", "path"], "left")
    both = judged.select("page_id", "host", "path", "best").union(untold.select("page_id", "host", "path", F.lit(None).cast(best.schema["best"].dataType)))
    return both.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
