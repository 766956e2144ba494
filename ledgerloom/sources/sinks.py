"""Sinks: Parquet, keyed tables, aggregates, reports.

A keyed table is a folder of data folders and manifests. Rows are dealt over
hash buckets of their key. A write makes a data folder with the buckets that it
touches, and then a manifest: the next version, which names for each bucket the
folder that holds it. So a write costs what it touches, readers never see half
of one, and a writer that is lost changes nothing. A manifest is put in place by
a rename that fails where the version exists, so of two writers one starts anew
on what the other has written. Manifests hold the last batch of each stream:
a batch that is repeated is skipped. Folders that the last versions do not name
are deleted.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ledgerloom.operators.windows import latest_per_key
from ledgerloom.session import new_path, written

#: Buckets of a new keyed table, versions that stay readable, and tries to commit against other writers.
BUCKETS, KEEP, TRIES = 32, 4, 20
_BUCKET, _DATA, _GONE = "_bucket", "_data", "_gone"


def write_parquet(df: DataFrame, path: str, schema: dict[str, str]) -> None:
    """Overwrites with the declared columns and types, SNAPPY; no rows give an empty file with schema."""
    df.select(*[F.col(n).cast(t).alias(n) for n, t in schema.items()]).write.mode("overwrite").option("compression", "snappy").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_in_order(df: DataFrame, path: str, files: int, order: list[str], within: list[str]) -> None:
    """Writes ``files`` ranges of ``order`` as files that a stream reads from the least on.

    A stream takes files by their times of modification, those of one job come
    in any order; so they are set, a second apart. A folder that doesn't keep them is an error.
    """
    df.repartitionByRange(files, *order).sortWithinPartitions(*within).write.option("compression", "zstd").parquet(path)
    held = _Files(df.sparkSession, path)
    names = sorted(n for n in held.names("") if not n.startswith(("_", ".")))
    begin = int(time.time() - len(names)) * 1000
    for k, name in enumerate(names):
        held.fs.setTimes(held.at(name), begin + 1000 * k, -1)
    times = [held.fs.getFileStatus(held.at(name)).getModificationTime() for name in names]
    if times != sorted(set(times)):
        raise ValueError(f"{path}: times of files can't be set")


class _Files:
    """The few calls on a table's folder that are not reads or writes of rows, by Hadoop's file API."""

    def __init__(self, spark: SparkSession, path: str):
        self.fs_api, self.path = spark._jvm.org.apache.hadoop.fs, path
        self.gateway = spark.sparkContext._gateway
        root = self.fs_api.Path(path)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = root.getFileSystem(conf)
        self.context = self.fs_api.FileContext.getFileContext(self.fs.getUri(), conf)

    def at(self, name: str):
        return self.fs_api.Path(f"{self.path}/{name}")

    def names(self, folder: str) -> list[str]:
        """What a folder holds; nothing if it isn't there. Other failures are errors."""
        if not self.fs.exists(self.at(folder)):
            return []
        return [status.getPath().getName() for status in self.fs.listStatus(self.at(folder))]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Puts a whole file in place; False if there is one of the name."""
        temporary = self.at(f"_{uuid.uuid4().hex}")
        stream = self.fs.create(temporary, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(self.at(name).getParent())
        try:
            self.context.rename(temporary, self.at(name), self.gateway.new_array(self.fs_api.Options.Rename, 0))
            return True
        except Py4JJavaError as e:
            self.fs.delete(temporary, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _manifest(files: _Files) -> dict | None:
    """The last version's manifest; None before the first write, an error if it can't be read."""
    versions = [int(n.removesuffix(".json")) for n in files.names("manifests") if n.endswith(".json")]
    return json.loads(files.read(f"manifests/{max(versions)}.json")) if versions else None


def _read(spark: SparkSession, path: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
    """Some or all buckets, with their number: one scan of their folders."""
    held = [(b, f) for b, f in manifest["folders"].items() if buckets is None or int(b) in buckets]
    schema = spark.createDataFrame([], manifest["schema"]).schema
    numbered = StructType([*schema.fields, StructField(_BUCKET, IntegerType())])
    if not held:
        return spark.createDataFrame([], numbered)
    whole = StructType([*numbered.fields, StructField(_DATA, StringType())])
    return spark.read.schema(whole).option("basePath", path).parquet(*[f"{path}/{f}/{_BUCKET}={b}" for b, f in held]).drop(_DATA)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version of a keyed table; None before the first write."""
    manifest = _manifest(_Files(spark, path))
    return None if manifest is None else _read(spark, path, manifest).drop(_BUCKET)


def table_batch(spark: SparkSession, path: str, stream: str = "stream") -> int | None:
    """The last batch of a stream that a table holds."""
    return ((_manifest(_Files(spark, path)) or {}).get("batches") or {}).get(stream)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _bucket(keys: list[str], buckets: int) -> Column:
    return (F.pmod(F.xxhash64(*keys), F.lit(buckets)) if keys else F.lit(0)).cast("int")


def _commit(files: _Files, before: dict | None, rows: DataFrame, touched: list[int], **told) -> bool:
    """Writes rows (with their buckets) and the manifest that puts them in the place of the touched buckets."""
    folder, version = f"{_DATA}={uuid.uuid4().hex}", (before["version"] if before else 0) + 1
    rows.repartition(_BUCKET).write.option("compression", "zstd").partitionBy(_BUCKET).parquet(f"{files.path}/{folder}")
    there = {n.removeprefix(f"{_BUCKET}=") for n in files.names(folder)}
    folders = {b: f for b, f in (before or {}).get("folders", {}).items() if int(b) not in touched}
    folders |= {str(b): folder for b in touched if str(b) in there}
    manifest = (before or {}) | {"version": version, "folders": folders} | told
    if not files.create(f"manifests/{version}.json", json.dumps(manifest)):
        files.delete(folder)
        return False
    _clean(files, version)
    return True


def _clean(files: _Files, version: int, keep: int = KEEP) -> None:
    """Deletes the manifests before the last ``keep`` and the data folders that only they named."""
    old = [n for n in files.names("manifests") if n.endswith(".json") and int(n.removesuffix(".json")) <= version - keep]
    if not old:
        return
    named = lambda names: {f for n in names for f in json.loads(files.read(f"manifests/{n}"))["folders"].values()}
    kept = [n for n in files.names("manifests") if n.endswith(".json") and n not in old]
    for folder in named(old) - named(kept):
        files.delete(folder)
    for name in old:
        files.delete(f"manifests/{name}")


def _batches(before: dict | None, batch: int | None, stream: str) -> dict:
    batches = dict((before or {}).get("batches") or {})
    return batches if batch is None else batches | {stream: batch}


def _done(before: dict | None, batch: int | None, stream: str) -> bool:
    return batch is not None and ((before or {}).get("batches") or {}).get(stream, -1) >= batch


def replace_table(df: DataFrame, path: str, keys: list[str] | None = None, batch: int | None = None, stream: str = "stream", note: int | None = None, buckets: int = BUCKETS) -> None:
    """Makes ``df`` the next version of a keyed table, whole. The last of several writers counts."""
    files, keys = _Files(df.sparkSession, path), keys or []
    n = buckets if keys else 1
    held = df.withColumn(_BUCKET, _bucket(keys, n))
    for _ in range(TRIES):
        before = _manifest(files)
        if _done(before, batch, stream):
            return
        told = {"schema": _schema(df), "keys": keys, "buckets": n, "batches": _batches(before, batch, stream), "note": note}
        if _commit(files, (before or {"version": 0}) | {"folders": {}}, held, list(range(n)), **told):
            return
    raise RuntimeError(f"{path}: other writers came first {TRIES} times")


def _merge(spark: SparkSession, path: str, keys: list[str], new: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None, stream: str, note: int | None, buckets: int) -> None:
    """The next version, of which only the buckets that ``new`` touches are read and written.

    ``change(old, new)`` gives these buckets' rows. ``new`` has one row for each
    key, and may have a flag ``_gone``.
    """
    files, at = _Files(spark, path), new_path(spark, "staged")
    staged = None
    try:
        for _ in range(TRIES):
            before = _manifest(files)
            if _done(before, batch, stream):
                return
            if before and before["keys"] != keys:
                # A table that was written whole, or with other keys, is dealt anew once.
                replace_table(read_table(spark, path), path, keys, note=before.get("note"), buckets=buckets)
                continue
            n = before["buckets"] if before else buckets
            gone = F.col(_GONE) if _GONE in new.columns else F.lit(False)
            held = new.withColumns({_BUCKET: _bucket(keys, n), _GONE: gone})
            if before:
                # Read several times: for the buckets that it touches, and as both sides of joins.
                staged = written(held, "staged", at) if staged is None else staged
                touched = [r[0] for r in staged.select(_BUCKET).distinct().collect()]  # as many as buckets
                kind = spark.createDataFrame([], before["schema"]).schema
                typed = staged.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kind.fields], _BUCKET, _GONE)
                rows = change(_read(spark, path, before, touched), typed)
            else:
                touched, rows = list(range(n)), change(held.where("false").drop(_GONE), held)
            told = {"schema": before["schema"] if before else _schema(new.drop(_GONE)), "keys": keys, "buckets": n, "batches": _batches(before, batch, stream), "note": note}
            if _commit(files, before, rows, touched, **told):
                return
    finally:
        if staged is not None:
            _Files(spark, at).delete("")
    raise RuntimeError(f"{path}: other writers came first {TRIES} times")


def upsert(df: DataFrame, path: str, keys: list[str], order: list[str] | None = None, batch: int | None = None, stream: str = "stream", buckets: int = BUCKETS) -> None:
    """Inserts or replaces by key; of rows that share a key the last by ``order`` counts.

    Without ``order`` the greatest row counts, so the result doesn't depend on
    how rows are dealt. With ``batch`` the write is skipped if the table holds
    this batch of ``stream`` or a later one. ``buckets`` is for a new table:
    choose it so that a bucket fits in a task. Null keys are keys.
    """
    new = latest_per_key(df, keys, order or [c for c in df.columns if c not in keys] or keys)

    _merge(df.sparkSession, path, keys, new, lambda old, new: _replaced(old, new, keys), batch, stream, None, buckets)


def _replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows but those with a new one, and the new ones that are not gone."""
    return _without(old, new, keys).unionByName(new.where(~F.col(_GONE)).drop(_GONE))


def _without(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left_anti") -> DataFrame:
    """Rows of ``a`` without (or, left_semi, with) a row of ``b`` of the same key; nulls are equal."""
    names = [f"_of_{k}" for k in keys]
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    return a.join(b.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]), same, how)


def insert_ignore(df: DataFrame, path: str, keys: list[str], batch: int | None = None, stream: str = "stream", buckets: int = BUCKETS) -> None:
    """Inserts only keys that aren't there yet."""
    new = latest_per_key(df, keys, [c for c in df.columns if c not in keys] or keys)
    _merge(df.sparkSession, path, keys, new, lambda old, new: old.unionByName(_without(new.drop(_GONE), old, keys)), batch, stream, None, buckets)


def aggregate_sink(df: DataFrame, landing: str, table: str, group_by: list[str], aggregates: dict[str, tuple[str, str, str]], keys: list[str], buckets: int = BUCKETS) -> None:
    """Lands contributions and brings a grouped table up to date: name -> (column, sum or max, type).

    The landing table is keyed by ``keys``, which name a contribution (a log, a
    batch), so one that comes again replaces itself and doesn't count twice. New
    contributions are added to their groups' rows. Groups of contributions that
    have changed are aggregated anew from the landing table. The grouped table
    notes the landing version that it stands for; where that is another one (a
    writer was lost in between), it is made anew.
    """
    spark = df.sparkSession
    made = {"sum": F.sum, "max": F.max}
    grouped = lambda rows: rows.groupBy(*group_by).agg(*[made[f](c).cast(t).alias(n) for n, (c, f, t) in aggregates.items()])
    again = lambda rows: rows.groupBy(*group_by, _BUCKET).agg(*[made[f](n).cast(t).alias(n) for n, (c, f, t) in aggregates.items()])
    landed, told = _manifest(_Files(spark, landing)), _manifest(_Files(spark, table))
    if landed and (not told or told.get("note") != landed["version"]):
        replace_table(grouped(read_table(spark, landing)), table, group_by, note=landed["version"], buckets=buckets)
    new = written(latest_per_key(df, keys, [c for c in df.columns if c not in keys] or keys), "contributions")
    old = _without(read_table(spark, landing), new, keys, "left_semi") if landed else new.where("false")
    old = written(old.select(*new.columns), "replaced")
    upsert(new, landing, keys, buckets=buckets)
    version = _manifest(_Files(spark, landing))["version"]
    change = new.exceptAll(old)
    gone = _without(old, change, keys, "left_semi")
    if gone.isEmpty():
        _merge(spark, table, group_by, grouped(change), lambda old, new: again(old.unionByName(new.drop(_GONE))), None, "stream", version, buckets)
        return
    groups = written(change.select(*group_by).unionByName(gone.select(*group_by)).distinct(), "groups")
    now = grouped(_without(read_table(spark, landing), groups, group_by, "left_semi")).withColumn(_GONE, F.lit(False))
    empty = _without(groups, now, group_by).withColumn(_GONE, F.lit(True))
    _merge(spark, table, group_by, now.unionByName(empty, allowMissingColumns=True), lambda old, new: _replaced(old, new, group_by), None, "stream", version, buckets)


def fan_out(df: DataFrame, branches: list[Callable[[DataFrame], None]]) -> None:
    """One read of ``df`` for several writes."""
    held = df.persist()
    try:
        for write in branches:
            write(held)
    finally:
        held.unpersist()


def stamp_ingest(df: DataFrame, name: str = "inserted_at") -> DataFrame:
    return df.withColumn(name, F.current_timestamp())


def write_report_json(reports: dict[str, DataFrame], path: str) -> None:
    """Each report's rows as JSON lines, below a folder of its name."""
    for name, df in reports.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def distribution(df: DataFrame, bucket: Column | str, platforms: list[str]) -> DataFrame:
    """Buckets by platforms, sorted by bucket, missing 0."""
    column = F.col(bucket) if isinstance(bucket, str) else bucket
    return df.groupBy(column.alias("bucket")).pivot("platform", platforms).count().na.fill(0, platforms).orderBy("bucket")


def write_distribution_csv(df: DataFrame, bucket: Column | str, platforms: list[str], path: str) -> None:
    distribution(df, bucket, platforms).write.mode("overwrite").option("header", True).csv(path)
