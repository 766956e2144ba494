"""Running values of hot keys, cut into ranges, against the plain window; ticks by blocks; two streams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators.joins import balance_asof
from ledgerloom.operators.ordered import ordered_scan
from ledgerloom.operators.windows import out_of_order
from ledgerloom.plans import ledger
from ledgerloom.sources import readers
from ledgerloom.streaming import jobs


def _rows(spark, seed=1, n=4000):
    """Half of all rows are one account's, and some are those of null."""
    r = random.Random(seed)
    rows = [("hot" if i % 2 else r.choice(["a", "b", None]), None if r.random() < 0.01 else r.randrange(300), i, None if r.random() < 0.3 else r.randrange(-50, 50)) for i in range(n)]
    return spark.createDataFrame(rows, "`a.key` string, at long, id long, value long")


@pytest.mark.parametrize("depth", [10, 100, 1 << 18])
def test_scan_is_the_plain_window(spark, depth):
    df = _rows(spark)
    got = ordered_scan(df, "a.key", ["at", "id"], {"total": "value"}, {"old": "value"}, {"last": "value"}, {"most": "value"}, depth=depth)
    w = Window.partitionBy("`a.key`").orderBy("at", "id")
    upto, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.sum("value").over(upto).alias("total"), F.lag("value").over(w).alias("old"), F.last("value", True).over(upto).alias("last"), F.max("value").over(past).alias("most"))
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_no_task_has_the_hot_key(spark):
    """A key with half of 100,000 rows: no range has over twice the median's rows."""
    df = spark.range(100000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("at"), F.lit(1).alias("one"))
    from ledgerloom.operators import ordered

    counts = df.groupBy(F.col("k").alias("of")).agg(F.count("*").alias("n")).where("n > 2000")
    parts = ordered._ranged(df, "k", ["at"], counts, 2000, ("of", "n", "part", "cut")).where("cut is not null").groupBy("part").count().collect()
    sizes = sorted(r["count"] for r in parts)
    assert len(sizes) == 25 and sum(sizes) == 50000 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_ties_and_empty_tables(spark):
    tied = spark.createDataFrame([("k", 1, 1)] * 50, "k string, at long, v long")
    assert sorted(r.total for r in ordered_scan(tied, "k", ["at"], {"total": "v"}, depth=10).collect()) == list(range(1, 51))
    assert ordered_scan(tied.where("at = 0"), "k", ["at"], {"total": "v"}).collect() == []


def test_asof_and_late_rows_of_a_hot_account(spark):
    r = random.Random(2)
    history = {("x" if i % 2 else f"y{i % 7}", b): r.randrange(1000) for i in range(2000) for b in [r.randrange(1500)]}
    asked = [(a, b) for a in ("x", "y1", "none") for b in range(0, 1600, 50)]
    h = spark.createDataFrame([(a, b, v) for (a, b), v in history.items()], "account string, block_number long, balance long").withColumn("balance", F.col("balance").cast("decimal(38,0)"))
    got = {(x.account, x.block_number): int(x.balance) for x in balance_asof(spark.createDataFrame(asked, "account string, block_number long"), h, depth=20).collect()}
    for a, b in asked:
        upto = [(n, v) for (k, n), v in history.items() if k == a and n <= b]
        assert got[a, b] == (max(upto)[1] if upto else 0)
    df = _rows(spark, 3).where("at is not null").withColumnRenamed("a.key", "key")
    late = lambda depth: sorted((x.id, x.is_late) for x in out_of_order(df, "key", ["id"], "at", depth).collect())
    assert late(50) == late(1 << 18)


def test_ticks_by_blocks_in_batch_and_stream(spark, tmp_path):
    """Every 10th block before 100, every 3rd from it on."""
    r = random.Random(4)
    moves = [(f"t{i}", r.choice("abc"), r.choice("abc"), r.randrange(1, 9), b) for i, b in enumerate(sorted(r.choice([0, r.randrange(160)]) for _ in range(120)))]
    transfers = spark.createDataFrame(moves, "id string, from_addr string, to_addr string, value long, block_number long").withColumn("ts", F.col("block_number") * 12)
    blocks = spark.range(200).select(F.col("id").alias("number"), (F.col("id") * 12).alias("timestamp"))
    batch = ledger.snapshots_at_blocks(transfers, blocks, 3, 170, backfill=10, live_from=100)
    ticks = {n for n in range(171) if (n % 10 == 0 if n < 100 else n % 3 == 0)}
    balance = lambda a, n: sum(v * ((t == a) - (f == a)) for _, f, t, v, b in moves if b <= n)
    first = {a: min(b for _, f, t, _, b in moves if a in (f, t)) for a in "abc"}
    rows = {(x.account, x.block_number): x for x in batch.collect()}
    want = {(a, n) for a in "abc" for n in ticks if n > first[a]} | {(a, b) for _, f, t, _, b in moves for a in (f, t)}
    assert set(rows) == want and all(int(x.balance) == balance(*k) for k, x in rows.items())
    for a in "abc":
        held, at, prior = 0, None, 0
        for n in sorted(n for k, n in want if k == a):
            held, at, prior = held + (prior * (n - at) * 12 if at is not None else 0), n, balance(a, n)
            assert int(rows[a, n].unit_seconds) == held
    sides = ledger.sides_of_accounts(transfers).select("account", "block_number", "delta")
    end = spark.createDataFrame([("end", 400, 0)], "account string, block_number long, delta long").withColumn("delta", F.col("delta").cast("decimal(38,0)"))
    sides.repartition(3).write.parquet(str(tmp_path / "in"))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = readers.read_stream_blocks(spark, str(tmp_path / "in"), sides.schema, files_per_batch=10)
    out = str(tmp_path / "out")
    jobs.run_bounded(jobs.interval_trigger_block(source, 3, 75, 10, 100), jobs.micro_batch(lambda b: b, out), str(tmp_path / "c"))
    got = {(x.account, x.block_number): int(x.balance) for x in spark.read.parquet(out).where("account <> 'end' and block_number <= 170").collect()}
    assert got == {(a, n): balance(a, n) for a in "abc" for n in ticks if n > first[a]}


def test_two_streams_and_a_restart(spark, tmp_path):
    """An event before, in and after the micro-batch of its creation, over three runs of one checkpoint."""
    made, events, out = (str(tmp_path / n) for n in ("made", "events", "out"))
    schemas = {made: "pair string, at timestamp", events: "address string, id long, at timestamp"}

    def put(path, *rows):
        spark.createDataFrame(list(rows), schemas[path].replace("timestamp", "long")).withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(path)

    def run():
        read = lambda p: readers.read_stream_blocks(spark, p, spark.createDataFrame([], schemas[p]).schema)
        jobs.run_bounded(jobs.factory_stream(read(made), read(events), "1 day"), jobs.micro_batch(lambda b: b, out), str(tmp_path / "c"))

    put(made, ("other", 900))
    put(events, ("x", 1, 1100), ("x", 2, 900), ("never", 3, 1000))
    run()
    put(made, ("x", 1000), ("x", 1000))
    put(events, ("x", 4, 1200), ("x", 5, 1000))
    run()
    put(events, ("x", 6, 3000), ("x", 7, 1000 + 86401))
    put(made, ("x", 1000))
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 4, 5, 6]


def test_ticks_of_a_stream_come_as_runs(spark):
    """One row from the state for each change, not for each tick; backfill and live steps, ticks from the first change on."""
    from ledgerloom.streaming import jobs

    steps = jobs._steps(20, 100, 430)
    ticks = lambda a, b: [t for first, last, step in jobs._runs(steps, a, b) for t in range(first, last + 1, step)]
    want = [t for t in range(1, 2000) if (t % 100 == 0 if t < 430 else t % 20 == 0)]
    assert ticks(0, 1999) == want and ticks(400, 1999) == [t for t in want if t > 400] and ticks(1980, 1999) == []
    assert len(list(jobs._runs(steps, 0, 10**9))) == 2


@pytest.mark.parametrize("depth", [10, 100, 1 << 18])
def test_scan_looks_ahead_and_back_to_the_first(spark, depth):
    df = _rows(spark, 5)
    got = ordered_scan(df, "a.key", ["at", "id"], depth=depth, after={"next": "value"}, first={"start": "value"})
    w = Window.partitionBy("`a.key`").orderBy("at", "id")
    want = df.select("*", F.lead("value").over(w).alias("next"), F.first("value", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("start"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("depth", [5, 1 << 18])
def test_ticks_are_made_after_the_scan(spark, monkeypatch, depth):
    """Nothing but changes is shuffled; blocks with several times, gaps of the calendar, accounts cut into ranges."""
    from ledgerloom.operators import ordered

    monkeypatch.setattr(ordered.ordered_scan, "__defaults__", tuple(depth if x == ordered.DEPTH else x for x in ordered.ordered_scan.__defaults__))
    r = random.Random(6)
    moves = [(f"t{i}", r.choice("abcd"), r.choice("abcd"), r.randrange(1, 9), b, b * 100 + r.randrange(50)) for i in range(400) for b in [r.choice([10, 12, r.randrange(10, 200)])]]
    transfers = spark.createDataFrame(moves, "id string, from_addr string, to_addr string, value long, block_number long, ts long")
    calendar = [(n, n * 100 + x) for n in range(0, 240) if n % 7 for x in (0, 20, 49)]
    found = ledger.snapshots_at_blocks(transfers, spark.createDataFrame(calendar, "number long, timestamp long"), 4, 230, backfill=6, live_from=90)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "hashpartitioning" not in plan[: plan.index("Generate")]
    at = {n: max(t for m, t in calendar if m == n) for n, _ in calendar if n <= 230 and (n % 6 == 0 if n < 90 else n % 4 == 0)}
    want = []
    for a in "abcd":
        changes = {}
        for _, f, t, v, b, ts in moves:
            if a in (f, t):
                last, delta = changes.get(b, (0, 0))
                changes[b] = max(last, ts), delta + v * ((t == a) - (f == a))
        first = min(changes)
        balance = held = 0
        before = None
        for n in sorted({n for n in at if n > first} | set(changes)):
            ts = max(changes.get(n, (0, 0))[0], at.get(n, 0) if n > first else 0)
            held += balance * (ts - before) if before is not None else 0
            balance, before = balance + changes.get(n, (0, 0))[1], ts
            want.append((a, n, ts, balance, held, "transfer" if n in changes else "tick"))
    assert sorted((x.account, x.block_number, x.ts, int(x.balance), int(x.unit_seconds), x.trigger) for x in found.collect()) == sorted(want)


def test_a_stream_stores_runs_not_ticks(spark, tmp_path, monkeypatch):
    """A row for each change and micro-batch, however many ticks; ticks wait for the watermark only, not for a later change."""
    from ledgerloom import queries_more as Q

    rows = lambda *r: spark.createDataFrame(list(r), "account long, block_number long, delta long")
    for batch in (((1, 1, 5), (2, 2, 2**60)), ((9, 200, 0),), ((1, 230, 3),), ((2**62, 10**6, 1),), ((9, 10**6 + 40, 0),)):
        rows(*batch).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = readers.read_stream_blocks(spark, str(tmp_path / "in"), rows().schema, files_per_batch=1)
    seen = []

    def noted(batch, number):
        seen.append(max((r.last for r in batch.where("account = 1").collect()), default=0))
        batch.write.mode("append").parquet(str(tmp_path / "out"))

    jobs.run_bounded(jobs.interval_runs_block(source, 3, 75, buckets=1), noted, str(tmp_path / "c"))
    runs = spark.read.parquet(str(tmp_path / "out"))
    assert runs.count() < 30 and max(x for x in seen if x < 10**5) == 153
    upto = 10**6 + 40 - 75
    got = jobs.run_ticks(runs, "block_number").groupBy("account", "balance").agg(F.count("*").alias("n"), F.max("block_number").alias("last")).collect()
    first = lambda n: upto // 3 - n // 3
    want = {(1, 5): (229 // 3, 228), (1, 8): (upto // 3 - 229 // 3, upto // 3 * 3), (2, 2**60): (upto // 3, upto // 3 * 3), (9, 0): (first(200), upto // 3 * 3)}
    assert {(r.account, int(r.balance)): (r.n, r.last) for r in got} == want
    drained, held = Q._drained, []
    monkeypatch.setattr(Q, "_drained", lambda session, stream: held.append(stream.columns) or drained(session, stream))
    for query in (Q.t6_interval_trigger_time, Q.t7_block_stream):
        query(spark, "/root/testdata/sf0.001")
    assert held == [["account", "first", "last", "step", "balance"]] * 2
