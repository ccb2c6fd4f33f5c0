"""Chunked running values, frames and joins against whole-run windows; row numbers and quantiles against Spark's own."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fahrwerk.operators import joins, ranks, segmented
from fahrwerk.operators import sequence as sq
from fahrwerk.plans import long_runs

BY, ORDER, SIZE = ["run_id"], ["seq"], 7


@pytest.fixture(scope="module")
def runs(spark):
    """Runs of 100, 1, 33 and 50 rows, the last one's id null; values and labels with nulls; equal times."""
    rng = random.Random(1)
    rows = [(run, i, rng.choice([None, rng.random()]), rng.choice(["road", "road", "a", "b", None]), rng.randrange(400)) for run, n in ((1, 100), (2, 1), (3, 33), (None, 50)) for i in range(n)]
    return spark.createDataFrame(rows, "run_id long, seq long, v double, context string, t long").cache()


def same(got, want, columns):
    lists = [sorted(map(str, map(tuple, d.select(*columns).collect()))) for d in (got, want)]
    assert lists[0] == lists[1] and lists[0]


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_scans_of_all_kinds(spark, runs, monkeypatch, levels):
    monkeypatch.setattr(segmented, "CHUNK", 3)
    scans, w = {}, Window.partitionBy("run_id").orderBy("seq")
    up, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    before, past = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    want = {}
    for open_, back, front in ((False, up, ahead), (True, before, past)):
        n = "x" if open_ else "i"
        scans |= {f"{k}{n}": segmented.Scan(k, "t" if k in ("sum", "max") else "v", open_) for k in ("last", "next", "first", "sum", "max")}
        want |= {f"last{n}": F.last("v", True).over(back), f"next{n}": F.first("v", True).over(front), f"first{n}": F.first("v").over(back), f"sum{n}": F.sum("t").over(back), f"max{n}": F.max("t").over(back)}
    got = segmented.scanned(runs, scans, BY, ORDER, SIZE, levels)
    same(got, runs.withColumns(want), ["run_id", "seq", *scans])


def test_filling_and_times(runs):
    same(segmented.filled(runs, "v", BY, ORDER, SIZE), runs.withColumn("v", sq.filled("v")), ["run_id", "seq", "v"])
    same(segmented.gap_filled(runs, BY, ORDER, size=SIZE), runs.withColumn("context", sq.gap_fill()), ["run_id", "seq", "context"])
    same(segmented.retimestamped(runs, BY, "seq", "t", 100, SIZE), runs.withColumn("t", sq.retimestamped(F.col("t"), 100)), ["run_id", "seq", "t"])


def test_blocks(runs):
    same(segmented.with_blocks(runs, BY, ORDER, size=SIZE), sq.with_blocks(runs), ["run_id", "seq", "block"])
    same(segmented.blocks(runs, BY, size=SIZE), sq.blocks(runs), ["run_id", "block", "context", "start", "end", "n"])


@pytest.mark.parametrize("size", [3, 7, 1000])
def test_frames(runs, size):
    whole = Window.partitionBy("run_id").orderBy("seq").rowsBetween(-11, 10)
    got = segmented.framed(runs, {"m": lambda w: F.max("t").over(w), "n": lambda w: F.count(F.lit(1)).over(w)}, 11, 10, BY, size=size)
    same(got, runs.withColumns({"m": F.max("t").over(whole), "n": F.count(F.lit(1)).over(whole)}), ["run_id", "seq", "m", "n"])


def test_asof(runs):
    left, right = runs.where("context = 'a'").select("run_id", "seq"), runs.where("context = 'b'").select("run_id", "seq", F.col("t").alias("x"))
    same(segmented.asof_before(left, right, BY, ORDER, "x", SIZE), joins.asof_before(left, right, BY, ORDER, "x"), ["run_id", "seq", "x"])


def test_pointer_walk(runs):
    d = runs.where("run_id is not null").withColumn("t", F.col("seq") * 3 + F.pmod(F.col("t"), F.lit(3)))
    left = d.where("context in ('a', 'b')").select("run_id", F.col("seq").alias("rid"), "t")
    right = d.where("context = 'road'").select("run_id", "t", F.col("v").alias("x")).dropDuplicates(["run_id", "t"])
    same(segmented.asof_pointer(left, right, BY, ["x"], "rid", 10), joins.asof_pointer(left, right, BY, BY, ["x"]), ["run_id", "rid", "t", "at", "x"])


def test_a_run_spreads_over_tasks(spark):
    """One run with all rows: no task of the window holds more than its chunks."""
    rows = spark.range(40_000).select(F.lit(1).alias("run_id"), F.col("id").alias("seq"), (F.col("id") % 7).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = segmented.scanned(rows, {"s": segmented.Scan("sum", "v")}, BY, ORDER, 1000).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 25_000


@pytest.mark.parametrize("cells", [2, 5, 64])
def test_numbers(runs, cells):
    order = ["t", "context", "v"]
    want = runs.withColumn("place", (F.row_number().over(Window.partitionBy("run_id").orderBy(*order)) - 1).cast("long"))
    same(ranks.numbered(runs, BY, order, "place", cells), want, ["run_id", "t", "context", "v", "place"])
    gaps = runs.withColumn("t", F.when(F.col("seq") % 5 > 0, F.col("t")))
    want = gaps.withColumn("place", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    same(ranks.numbered(gaps, [], order, "place", cells), want, ["t", "context", "v", "place"])


@pytest.mark.parametrize("buffer,bins", [(0, 16), (40, 1024), (1000, 1024)])
def test_quantiles(spark, runs, monkeypatch, buffer, bins):
    monkeypatch.setattr(ranks, "BINS", bins)
    shares = [0.0, 0.1, 0.5, 0.95, 1.0]
    odd = runs.withColumn("v", F.when(F.col("seq") % 9 == 0, F.lit(float("nan"))).when(F.col("seq") % 4 == 0, 7.0).otherwise(F.col("v") * F.exp(F.col("v") * 30)))
    for by in (BY, []):
        got = {tuple(r)[:-1]: r.q for r in ranks.quantiles(odd, by, "v", shares, buffer).collect()}
        want = {tuple(r)[:-1]: r.q for r in odd.where("not isnan(v)").groupBy(*by).agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
        assert set(got) == set(want)
        for k in want:
            assert got[k] == pytest.approx(want[k])


def test_empty_tables(runs):
    none = runs.limit(0)
    assert segmented.with_blocks(none, BY, ORDER).count() == segmented.filled(none, "v", BY, ORDER).count() == ranks.numbered(none.drop("seq"), BY, ["t"]).count() == ranks.quantiles(none, BY, "v", [0.5]).count() == 0


def test_ties_that_sql_leaves_open_are_settled_by_the_row(spark, tmp_path):
    """Line items of one flag, date, order and line number: the same numbers and results in whatever order the files hold them."""
    rng, rows = random.Random(5), []
    for i in range(40):
        rows += [("A", i // 4, i, 1 + i % 7, float(q)) for q in rng.sample(range(1, 51), 1 + 2 * (i % 2))]
    found = []
    for turn, part in enumerate((sorted(rows), sorted(rows)[::-1])):
        t = spark.createDataFrame(part, "l_returnflag string, day int, l_orderkey long, l_linenumber int, l_quantity double")
        t.withColumn("l_shipdate", F.to_timestamp(F.date_add(F.lit("2000-01-01").cast("date"), F.col("day")))).drop("day").coalesce(1).write.parquet(f"{tmp_path}/{turn}/lineitem.parquet")
        queries = [long_runs.long_numbered, long_runs.long_fill, long_runs.long_gap_fill, long_runs.long_blocks, long_runs.long_crash_dilation, long_runs.long_sliding_windows, long_runs.long_asof]
        found.append([sorted(map(str, q(spark, f"{tmp_path}/{turn}").collect())) for q in queries])
    assert found[0] == found[1] and all(found[0])


def test_no_frame_is_read_again_for_each_row(runs):
    """Frames that end with the chunk cost the square of its rows; cells are found without a function for each edge."""
    asof = segmented.asof_before(runs.select("run_id", "seq"), runs.select("run_id", "seq", "v"), BY, ORDER, "v", SIZE)
    for d in (segmented.filled(runs, "v", BY, ORDER, SIZE), segmented.gap_filled(runs, BY, ORDER, size=SIZE), asof, ranks.numbered(runs.drop("seq"), BY, ["t", "context", "v"])):
        plan = d._jdf.queryExecution().toString().lower()
        assert "unboundedfollowing" not in plan and "lambdafunction" not in plan


@pytest.mark.parametrize("groups", [0, 1_000])
def test_numbers_with_and_without_broadcast(runs, monkeypatch, groups):
    monkeypatch.setattr(ranks, "BROADCAST_GROUPS", groups)
    order = ["t", "context", "v"]
    same(ranks.numbered(runs, BY, order, "place", 9), runs.withColumn("place", (F.row_number().over(Window.partitionBy("run_id").orderBy(*order)) - 1).cast("long")), ["run_id", "t", "context", "v", "place"])
