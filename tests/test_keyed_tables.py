"""Keyed tables and streams: what a write touches, replays, two writers, broken manifests."""

import glob
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import readers, sinks
from ledgerloom.streaming import jobs


def rows(spark, *r):
    return spark.createDataFrame(list(r), "id string, v int")


def table(spark, path):
    return {r.id: r.v for r in sinks.read_table(spark, path).collect()}


def manifests(path):
    return sorted(json.load(open(f))["version"] for f in glob.glob(f"{path}/manifests/*.json"))


def test_a_write_touches_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert(spark.range(2000).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("v")), path, ["id"], buckets=16)
    first = {f for f in glob.glob(f"{path}/_data=*/_bucket=*/*.parquet")}
    sinks.upsert(rows(spark, ("7", 1)), path, ["id"])
    new = {f for f in glob.glob(f"{path}/_data=*/_bucket=*/*.parquet")} - first
    assert len({os.path.dirname(f) for f in new}) == 1 and spark.read.parquet(*new).count() < 300
    got = table(spark, path)
    assert len(got) == 2000 and got["7"] == 1 and sum(got.values()) == 1
    for k in range(6):
        sinks.upsert(rows(spark, (f"n{k}", k)), path, ["id"])
    assert manifests(path) == list(range(8 - sinks.KEEP + 1, 9))
    named = {f for m in glob.glob(f"{path}/manifests/*.json") for f in json.load(open(m))["folders"].values()}
    assert {os.path.basename(f) for f in glob.glob(f"{path}/_data=*")} == named
    assert len(table(spark, path)) == 2006


def test_null_keys_and_later_types(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert(rows(spark, (None, 1), ("a", 1)), path, ["id"])
    sinks.upsert(spark.createDataFrame([(5, None), (6, "b")], "v long, id string"), path, ["id"])
    sinks.insert_ignore(rows(spark, (None, 9), ("c", 9)), path, ["id"])
    assert table(spark, path) == {None: 5, "a": 1, "b": 6, "c": 9}
    assert sinks.read_table(spark, path).dtypes == [("id", "string"), ("v", "int")]


def test_repeated_batches_and_broken_manifests(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert(rows(spark, ("a", 1)), path, ["id"], batch=0, stream="s")
    sinks.upsert(rows(spark, ("a", 2)), path, ["id"], batch=0, stream="s")
    sinks.upsert(rows(spark, ("b", 2)), path, ["id"], batch=0, stream="other")
    assert table(spark, path) == {"a": 1, "b": 2} and sinks.table_batch(spark, path, "s") == 0
    (tmp_path / "t/manifests/2.json").write_text("{")
    (tmp_path / "t/manifests/.2.json.crc").unlink()
    with pytest.raises(json.JSONDecodeError):
        sinks.upsert(rows(spark, ("c", 3)), path, ["id"])
    assert not os.path.exists(f"{path}/manifests/3.json")


def test_two_writers_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert(rows(spark, ("a", 0)), path, ["id"])
    writers = [threading.Thread(target=sinks.upsert, args=(rows(spark, *[(f"{w}{k}", w) for k in range(5)]), path, ["id"])) for w in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert len(table(spark, path)) == 16 and manifests(path)[-1] == 4


def test_aggregates_of_changed_contributions(spark, tmp_path):
    landing, grouped = str(tmp_path / "landing"), str(tmp_path / "grouped")
    how = (landing, grouped, ["id"], {"total": ("v", "sum", "long"), "most": ("v", "max", "int")}, ["log"])
    logs = lambda *r: spark.createDataFrame(list(r), "log string, id string, v int")
    found = lambda: {r.id: (r.total, r.most) for r in sinks.read_table(spark, grouped).collect()}
    sinks.aggregate_sink(logs(("x", "a", 1), ("y", "a", 9), ("z", "b", 4)), *how)
    sinks.aggregate_sink(logs(("x", "a", 1), ("w", "a", 2)), *how)
    assert found() == {"a": (12, 9), "b": (4, 4)}
    sinks.aggregate_sink(logs(("y", "a", 3), ("z", "c", 4), ("v", None, 1)), *how)  # one smaller, one in another group
    assert found() == {"a": (6, 3), "c": (4, 4), None: (1, 1)}
    sinks.upsert(logs(("u", "a", 50)), landing, ["log"])  # a writer that was lost before the groups
    sinks.aggregate_sink(logs(("t", "a", 1)), *how)
    assert found()["a"] == (57, 50)


def test_late_rows_in_falling_order_of_one_key(spark, tmp_path):
    arrivals = spark.range(60000).select(F.lit("a").alias("account"), F.col("id").cast("string").alias("id"), F.col("id").alias("block_number"), F.col("id").alias("arrival"))
    arrivals = arrivals.unionByName(spark.createDataFrame([("a", "late", 5, 30000), ("b", "alone", 1, 0)], arrivals.schema))
    arrivals.repartitionByRange(8, F.desc("arrival")).sortWithinPartitions(F.desc("arrival")).write.parquet(str(tmp_path / "in"))
    stream = readers.read_stream_blocks(spark, str(tmp_path / "in"), arrivals.schema, files_per_batch=1000)
    flagged = jobs.late_flag(stream)
    jobs.run_bounded(flagged, jobs.micro_batch(lambda b: b, str(tmp_path / "out")), str(tmp_path / "c"))
    got = jobs.read_batches(spark, str(tmp_path / "out"), flagged.schema)
    assert got.count() == 60002
    # The late row stands before the row of its arrival, as its block is lower.
    assert [r.id for r in got.where("is_late").collect()] == ["late"]


def test_repeated_micro_batches_count_once(spark, tmp_path):
    batch = spark.createDataFrame([("u", 1), ("u", 2)], "id string, e int")

    def add(batch, table):
        new = batch.groupBy("id").agg(F.count("*").alias("v"))
        return new if table is None else new.join(table.withColumnRenamed("v", "old"), "id", "left").select("id", (F.col("v") + F.coalesce("old", F.lit(0))).alias("v"))

    handle = jobs.read_your_writes(str(tmp_path / "counts"), ["id"], add)
    for batch_id in (0, 0, 1, 1):
        handle(batch, batch_id)
    assert table(spark, str(tmp_path / "counts")) == {"u": 4}
    handle = jobs.micro_batch(lambda b: b, str(tmp_path / "rows"))
    for batch_id in (0, 0, 1):
        handle(batch, batch_id)
    assert jobs.read_batches(spark, str(tmp_path / "rows"), batch.schema).count() == 4


def test_factory_batch_keeps_no_copies(spark, tmp_path, monkeypatch):
    """No decoded logs are held, and no staged rows are left behind; topics in upper case are read too."""
    from ledgerloom.plans import ledger
    from ledgerloom.plans import renditions as R
    from ledgerloom.session import shared_dir

    staged = lambda: set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/staged-*"))
    held, before = [], staged()
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda df, *a: held.append(df) or df)
    logs = R.factory_logs(spark, "/root/testdata/sf0.001")
    loud = logs.withColumn("topics", F.when(F.col("log_index") % 2 == 1, F.concat(F.lit("0x"), F.upper(F.substring("topics", 3, 64)), F.substring("topics", 67, 1000))).otherwise(F.col("topics")))
    handle = jobs.factory_batch(str(tmp_path / "registry"), str(tmp_path / "swaps"))
    handle(loud.where("block_number < 900"), 0)
    handle(loud, 1)
    want = {r.id for r in logs.join(ledger.pairs_job(logs).select(F.col("pair").alias("address")), "address", "left_semi").collect()}
    got = [r.id for r in sinks.read_table(spark, str(tmp_path / "swaps")).collect()]
    assert set(got) == want and len(got) == len(want) and want and held == []
    assert staged() == before


def test_latest_row_of_its_own_columns(spark):
    """An order of all other columns needs no second copy of them in the shuffle; nulls come last."""
    from ledgerloom.operators.windows import latest_per_key

    df = spark.createDataFrame([("a", None, 9), ("a", 1, 2), ("a", 1, None), (None, None, None), ("b", 2, 3), ("b", 2, 3)], "id string, v int, w int").select("v", "id", "w")
    found = latest_per_key(df, ["id"], ["v", "w"])
    assert found.columns == ["v", "id", "w"] and sorted(map(tuple, found.collect()), key=str) == sorted([(1, "a", 2), (None, None, None), (2, "b", 3)], key=str)
    assert "max_by" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r[0] or "" for r in latest_per_key(df.select("id"), ["id"], ["id"]).collect()) == ["", "a", "b"]


def test_points_stream_waits_for_one_micro_batch(spark, monkeypatch):
    """Changes come in order of time, a few files at a time; what waits in the state are those of one micro-batch, and none is late."""
    from ledgerloom import queries_more as Q

    runs, run = [], jobs.run_bounded
    monkeypatch.setattr(jobs, "run_bounded", lambda *a, **k: runs.append(run(*a, **k)) or runs[-1])
    monkeypatch.setattr(jobs.points_stream, "__defaults__", ("1 hour", 16))
    monkeypatch.setattr(Q, "FILE_ROWS", 1000, raising=False)
    monkeypatch.setattr(Q, "FILES", 2, raising=False)
    found = Q.t5_points_stream(spark, "/root/testdata/sf0.001")
    want = Q.L.account_snapshots(Q._token_transfers(spark, "/root/testdata/sf0.001")).select("account", "ts", F.col("balance").cast("string"), F.col("unit_seconds").cast("string"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    told = [p for p in runs[0].recentProgress if p["numInputRows"]]
    assert len(told) >= 4 and max(p["numInputRows"] for p in told) < 3000
    assert all(p["stateOperators"][0]["numRowsDroppedByWatermark"] == 0 for p in told)


def test_files_in_order(spark, tmp_path):
    """A stream takes the ranges from the least on, whatever order their tasks end in."""
    path = str(tmp_path / "in")
    sinks.write_in_order(spark.range(1000).select((999 - F.col("id")).alias("id")), path, 8, ["id"], ["id"])
    seen = []
    stream = readers.read_stream_blocks(spark, path, spark.range(0).schema, files_per_batch=1)
    jobs.run_bounded(stream, lambda batch, n: seen.append([r.id for r in batch.collect()]), str(tmp_path / "c"))
    assert len(seen) > 4 and [i for batch in seen for i in batch] == list(range(1000))


def test_waiting_changes_of_one_time_are_one():
    """A thousand changes of an account at one time wait as one sum; state is compact."""
    import pandas as pd

    class State:
        exists, get, wakes = False, None, None
        now = 0

        def getCurrentWatermarkMs(self):
            return self.now

        def update(self, held):
            self.exists, self.get = True, held

        def setTimeoutTimestamp(self, at):
            self.wakes = at

    state = State()
    frame = pd.DataFrame({"account": ["0x" + "ab" * 20] * 1000 + [None] * 2, "ts": [86400] * 1000 + [5, 7], "delta": [10**20] * 1002})
    assert list(jobs._apply_in_order((1,), iter([frame]), state)) == []
    assert sum(map(len, state.get)) < 300 and state.wakes == 5001
    state.now = 90000 * 1000
    (out,) = jobs._apply_in_order((1,), iter([frame.iloc[:1].assign(ts=86401)]), state)
    assert list(map(tuple, out.values.tolist())) == [("0x" + "ab" * 20, 86400, 10**23, 0), ("0x" + "ab" * 20, 86401, 10**23 + 10**20, 10**23), (None, 5, 10**20, 0), (None, 7, 2 * 10**20, 2 * 10**20)]
