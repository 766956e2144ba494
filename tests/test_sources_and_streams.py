from __future__ import annotations

import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import ledger, pipeline
from ledgerloom.plans import renditions as R
from ledgerloom.sources import readers, sinks
from ledgerloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_scans_push_filters(spark, tmp_path):
    R.logs(spark, SF).write.parquet(str(tmp_path / "logs"))
    df = readers.scan_logs(spark, str(tmp_path / "logs"), "0x" + "ab" * 20, 100, 900, "0xddf252ad")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(topics,0xddf252ad)" in plan and "GreaterThanOrEqual(block_number,100)" in plan
    assert df.count() == R.logs(spark, SF).where("block_number between 100 and 900").count()
    parts = readers.scan_range_parallel(spark, lambda a, b: readers.scan_logs(spark, str(tmp_path / "logs"), None, a, b), 100, 900, 300)
    assert parts.count() == df.count()


def test_datasets(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "a"))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "part-0.parquet").write_bytes(b"not parquet")
    df, loaded = readers.read_datasets(spark, {n: str(tmp_path / n) for n in "abc"}, "id long")
    assert loaded == {"a": True, "b": False, "c": False} and df.groupBy("platform").count().collect() == [("a", 5)]
    (tmp_path / "x.json").write_text(json.dumps([{"n": 1}, {"n": 2}]))
    (tmp_path / "y.json").write_text(json.dumps({"n": 1}))
    assert readers.read_json_array(spark, str(tmp_path / "x.json"), "n int").count() == 2
    with pytest.raises(ValueError, match="not an array"):
        readers.read_json_array(spark, str(tmp_path / "y.json"), "n int")
    (tmp_path / "z.json").write_text('{"a": 1, "b": true, "c": "x", "d": [1]}\n{"a": 2}\n')
    assert [f.dataType.simpleString() for f in readers.infer_schema_first_row(spark, str(tmp_path / "z.json"))] == ["double", "boolean", "string", "string"]


def test_keyed_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "id string, v int")
    table = lambda p=path: {r[0]: r[1] for r in sinks.read_table(spark, p).collect()}
    assert sinks.read_table(spark, path) is None
    sinks.upsert(rows(("a", 1), ("b", 1), ("b", 2)), path, ["id"])
    sinks.upsert(rows(("b", 0), ("c", 5)), path, ["id"])
    assert table() == {"a": 1, "b": 0, "c": 5}
    sinks.insert_ignore(rows(("b", 9), ("d", 9)), path, ["id"])
    assert table() == {"a": 1, "b": 0, "c": 5, "d": 9}
    logs = spark.createDataFrame([("x", "a", 1), ("y", "a", 2), ("z", "b", 4)], "log string, id string, v int")
    for batch in (logs, logs, logs.where("log = 'y'").withColumn("log", F.lit("w"))):  # the second is a replay
        sinks.aggregate_sink(batch, str(tmp_path / "landing"), str(tmp_path / "agg"), ["id"], {"total": ("v", "sum", "long"), "most": ("v", "max", "int")}, ["log"])
    assert {r.id: (r.total, r.most) for r in sinks.read_table(spark, str(tmp_path / "agg")).collect()} == {"a": (5, 2), "b": (4, 4)}
    sinks.write_parquet(rows().limit(0), str(tmp_path / "e"), {"id": "string", "v": "long"})
    assert spark.read.parquet(str(tmp_path / "e")).dtypes == [("id", "string"), ("v", "bigint")]
    tagged = spark.createDataFrame([("a", 1), ("b", 1), ("a", 12)], "platform string, n int")
    sinks.write_distribution_csv(tagged, F.floor(F.col("n") / 10) * 10, ["a", "b"], str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).collect() == [("0", "1", "1"), ("10", "1", "0")]


def test_points_stream_is_the_batch_job(spark, tmp_path):
    sides = ledger.sides_of_accounts(R.transfers(spark, SF)).select("account", "ts", F.col("delta").cast("double").alias("delta"), F.timestamp_seconds("ts").alias("at"))
    late = spark.createDataFrame([("zz", 4102444800, 1.0), ("zz", 4102444900, 1.0)], "account string, ts long, delta double").withColumn("at", F.timestamp_seconds("ts"))
    kept = sides.where("account < '0x0000000000000000000000000000000000000003'")
    kept.repartition(3).write.parquet(str(tmp_path / "in"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = readers.read_stream_blocks(spark, str(tmp_path / "in"), kept.schema)
    out = str(tmp_path / "out")
    # The far later rows of another account move the watermark past all others.
    jobs.run_bounded(jobs.points_stream(source, "at"), jobs.micro_batch(lambda b: b, out), str(tmp_path / "c"))
    got = defaultdict(list)
    for r in spark.read.parquet(out).collect():
        got[r.account].append((r.ts, r.balance, r.unit_seconds))
    want = defaultdict(list)
    for r in ledger.account_snapshots(R.transfers(spark, SF)).where("account < '0x0000000000000000000000000000000000000003'").collect():
        want[r.account].append((r.ts, float(r.balance), float(r.unit_seconds)))
    for account, rows in want.items():
        assert [x for r in sorted(got[account]) for x in r] == pytest.approx([x for r in sorted(rows) for x in r])


def test_factory_dedup_and_late_streams(spark, tmp_path):
    logs = R.factory_logs(spark, SF)
    logs.repartition(2).write.parquet(str(tmp_path / "in"))
    handler = jobs.factory_batch(str(tmp_path / "registry"), str(tmp_path / "swaps"))
    jobs.run_bounded(readers.read_stream_blocks(spark, str(tmp_path / "in"), logs.schema), handler, str(tmp_path / "c"))
    want = {r.id for r in logs.join(ledger.pairs_job(logs).select(F.col("pair").alias("address")), "address", "left_semi").collect()}
    assert {r.id for r in sinks.read_table(spark, str(tmp_path / "swaps")).collect()} == want
    events = spark.createDataFrame([("x", "1", 5, 1), ("x", "2", 3, 2), ("x", "2", 3, 2), ("y", "3", 1, 3)], "account string, id string, block_number long, arrival long").withColumn("at", F.timestamp_seconds("block_number"))
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    source = lambda: readers.read_stream_blocks(spark, str(tmp_path / "ev"), events.schema)
    jobs.run_bounded(jobs.stream_dedup(source(), ["id"], "at"), jobs.micro_batch(lambda b: b, str(tmp_path / "dd")), str(tmp_path / "c3"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "dd")).collect()) == ["1", "2", "3"]
    jobs.run_bounded(jobs.late_flag(source()), jobs.micro_batch(lambda b: b, str(tmp_path / "lf")), str(tmp_path / "c4"))
    assert sorted((r.id, r.is_late) for r in spark.read.parquet(str(tmp_path / "lf")).collect()) == [("1", False), ("2", True), ("2", True), ("3", False)]


def test_hot_blocks(spark, tmp_path):
    path = str(tmp_path / "hot")
    rows = lambda *r: spark.createDataFrame(list(r), "block_number long, log_index long, block_hash string, ingest long")
    jobs.hot_block_replace(rows((1, 0, "a", 1), (2, 0, "b", 1), (2, 1, "b", 1)), path)
    jobs.hot_block_replace(rows((2, 0, "B", 2), (3, 0, "c", 2)), path)
    assert sorted(map(tuple, sinks.read_table(spark, path).collect())) == [(1, 0, "a", 1), (2, 0, "B", 2), (3, 0, "c", 2)]
    assert jobs.finality_cut(rows((1, 0, "a", 1), (80, 0, "b", 1))).count() == 1


def test_handlers_specs_and_metrics(spark, tmp_path):
    indexer = pipeline.Indexer()

    @indexer.on_event(None, "Transfer", 0, 10**9)
    def totals(df):
        return df.groupBy("to").agg(F.count("*").alias("n"))

    @indexer.on_block(every=10)
    def tens(df):
        return df.select("number")

    @indexer.template()
    def swaps(df):
        return df

    tables = {"logs": R.logs(spark, SF).withColumn("log_index", F.lit(0).cast("long")), "blocks": R.blocks(spark, SF)}
    out = indexer.run(tables)
    assert out["totals"].agg(F.sum("n")).first()[0] == tables["logs"].count()
    assert all(r.number % 10 == 0 for r in out["tens"].collect()) and out["swaps"].count() == 0
    pipeline.register_sql_functions(spark)
    spec = {
        "sources": {"raw": "logs"},
        "transforms": {"counts": "select sender, count(*) n from {named} group by 1", "named": "select log_signature(topics) sig, topic_address(split_part(topics, ',', 2)) sender from {raw}"},
        "sinks": {"s": {"from": "counts", "path": str(tmp_path / "k"), "keys": ["sender"]}, "a": {"from": "named", "path": str(tmp_path / "n")}},
    }
    done = pipeline.pipeline(spark, spec, tables)
    assert done["named"].select("sig").distinct().collect() == [("Transfer",)]
    assert sinks.read_table(spark, str(tmp_path / "k")).agg(F.sum("n")).first()[0] == tables["logs"].count()
    with pytest.raises(ValueError, match="depend on each other"):
        pipeline.pipeline(spark, {"transforms": {"a": "select * from {b}", "b": "select * from {a}"}}, {})
    lines = spark.createDataFrame([("f", 1, "rpc: 1.5s, 10%"), ("f", 2, "compute = 2s 55.5%"), ("g", 1, "nothing")], "path string, line_no int, value string")
    assert sorted(map(tuple, pipeline.parse_metric_logs(lines).collect()))[0] == ("f", 55.5, 1.5, 2.0, None)
    runs = spark.createDataFrame([("c", 60.0, 120, 30, 100)], "case string, seconds double, blocks long, records long, total long")
    assert tuple(pipeline.throughput(runs).first()) == ("c", 2.0, 0.5, 1.0, 100.0)
