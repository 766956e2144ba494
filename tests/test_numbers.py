"""Bitmaps of numbers against plain sets; filters that reach a database."""

import random
import uuid
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import functions as F

from ledgerloom.functions.columns import points_of
from ledgerloom.operators import aggregates, windows
from ledgerloom.plans import renditions as R
from ledgerloom.sources import readers


def test_gaps_and_coverage_of_any_numbers(spark):
    random.seed(8)
    numbers = [random.randrange(-70000, 70000) for _ in range(300)] + list(range(32760, 32775)) + [0, -1, 1, -32768, -32767, 32768, 10**9]
    df = spark.createDataFrame([(n,) for n in numbers * 2] + [(None,)], "n long").repartition(5)
    known = sorted(set(numbers))
    want = [(a + 1, b - 1, b - a - 1) for a, b in zip(known, known[1:], strict=False) if b - a > 1]
    assert sorted(map(tuple, windows.gaps(df, "n").collect())) == want
    assert windows.gaps(df.where("n = 0"), "n").count() == windows.gaps(df.limit(0), "n").count() == 0
    inside = {n for n in known if -1000 <= n <= 50000}
    row = aggregates.coverage(df.withColumn("p", F.lit(None).cast("string")), "n", -1000, 50000, "p").first()
    assert (row.p, row.found, row.expected, row.pattern) == (None, len(inside), 51001, "partial with gaps")


def test_range_is_pushed_to_the_database(spark):
    url, driver = f"jdbc:derby:memory:t{uuid.uuid4().hex}", "org.apache.derby.jdbc.EmbeddedDriver"
    spark.range(100).select(F.col("id").alias("ID")).coalesce(1).write.jdbc(f"{url};create=true", "T", properties={"driver": driver})
    found = readers.read_jdbc_range(spark, url, "T", "ID", 10, 19, 3, driver=driver)
    assert sorted(r.ID for r in found.collect()) == list(range(10, 20))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(ID), *GreaterThanOrEqual(ID,10), *LessThanOrEqual(ID,19)]" in plan and "numPartitions=3" in plan


def test_points_of_amounts_of_any_size(spark):
    """Exact to 38 digits of unit-seconds; a decimal of six places ended at 32 digits of points."""
    random.seed(9)
    held = [0, 1, -1, 43, 86399, 86400, -86400, 10**9 + 7, 10**20 - 1, 10**33 + 5, 10**38 - 1, 1 - 10**38] + [random.randrange(10**n) for n in range(1, 39) for _ in range(3)]

    def wanted(v: int) -> str:
        m = int(Fraction(abs(v) * 10**9, 86400) + Fraction(1, 2))
        return f"{'-' if v < 0 else ''}{m // 10**6}.{m % 10**6:06d}"

    df = spark.createDataFrame([(Decimal(v),) for v in held], "v decimal(38,0)")
    assert [r[0] for r in df.select(points_of(F.col("v"))).collect()] == list(map(wanted, held))
    assert spark.sql("select cast(null as decimal(38,0)) v").select(points_of(F.col("v"))).first()[0] is None


def test_raw_tables_shuffle_narrow_rows(spark):
    """Tables that are derived from lines are dealt before their rows widen."""
    for make in (R.logs, R.token_logs, R.calls, R.factory_logs):
        plan = make(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        below = plan.split("RebalancePartitions", 1)[1]
        assert "Project [l_orderkey" in below or "Project [o_orderkey" in below, plan
        assert "concat" not in below.split("RebalancePartitions")[0].split("Union")[0] or make is R.factory_logs


def test_factory_stream_has_no_task_with_all_swaps(spark, monkeypatch):
    """The files of the stream: all creations before the swaps, which are not in one task."""
    from ledgerloom import queries_more as Q

    seen = {}
    read = Q.readers.read_stream_blocks

    def noted(session, path, schema, *more, **options):
        rows = session.read.parquet(path).select(F.input_file_name().alias("f"), F.col("_metadata.file_modification_time").alias("at"), F.col("topics").startswith(Q.schemas.EVENTS["Swap"][0]).alias("swap"))
        seen.update({r.f: (r.at, r.swaps, r.n) for r in rows.groupBy("f", "at").agg(F.min("swap").alias("swaps"), F.count_distinct("swap").alias("n")).collect()})
        return read(session, path, schema, *more, **options)

    monkeypatch.setattr(Q.readers, "read_stream_blocks", noted)
    monkeypatch.setattr(Q, "_raw", lambda name, make, session, d: make(session, d).repartition(3))
    Q.t8_factory_stream(spark, "/root/testdata/sf0.001")
    assert all(n == 1 for _, _, n in seen.values()) and sum(swaps for _, swaps, _ in seen.values()) == 3
    assert max(at for at, swaps, _ in seen.values() if not swaps) <= min(at for at, swaps, _ in seen.values() if swaps)


def test_raw_tables_are_dealt_before_they_widen(spark):
    """The shuffle lies below the hashes and hex texts, so it has the source columns only."""
    for make in (R.logs, R.token_logs, R.calls, R.factory_logs):
        plan = make(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        dealt = plan.index("RebalancePartitions")
        assert plan.index("hex(") < dealt and "hex(" not in plan[dealt:].split("Project")[0] and "Repartition " not in plan


def test_calls_of_a_transaction_lie_together(spark):
    rows = R.calls(spark, "/root/testdata/sf0.001").select("transaction_hash", F.spark_partition_id().alias("part")).collect()
    runs = sum(a != b for a, b in zip(rows, rows[1:], strict=False)) + 1
    assert len(rows) > 1000 and runs == len(set(rows))
