"""Ordered-run operators: windows, blocks, filling, dilation.

Every operator partitions by run_id only, so runs spread over the cluster and
one sort by (run_id, seq) serves all that follow on the same window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import WINDOW


def run_order() -> Window:
    return Window.partitionBy("run_id").orderBy("seq")




def tumbling_windows(df: DataFrame, values: list[str], size: int = WINDOW) -> DataFrame:
    """Windows of ``size`` rows as arrays, in order; an unfinished last one is dropped."""
    rows = F.sort_array(F.collect_list(F.struct("seq", *values)))
    w = df.groupBy("run_id", F.floor(F.col("seq") / size).alias("win")).agg(rows.alias("r")).where(F.size("r") == size)
    return w.select("run_id", "win", *[F.col(f"r.{v}").alias(v) for v in values])


def sliding_windows(df: DataFrame, value: str, size: int = WINDOW) -> DataFrame:
    """Windows of ``size`` rows that start at each row."""
    w = F.collect_list(value).over(run_order().rowsBetween(0, size - 1))
    return df.select("run_id", "seq", w.alias("values")).where(F.size("values") == size)


def centred(df: DataFrame, measure: Column, size: int = WINDOW) -> Column:
    """A measure over the window whose middle the row is; null where the window isn't whole."""
    w = run_order().rowsBetween(-(size // 2), size - size // 2 - 1)
    return F.when(F.count(F.lit(1)).over(w) == size, measure.over(w))


def with_blocks(df: DataFrame, label: str = "context") -> DataFrame:
    """Adds ``block``: the number of the unbroken stretch of equal labels."""
    new = F.coalesce((~F.lag(label).over(run_order()).eqNullSafe(F.col(label))).cast("int"), F.lit(0))
    first = F.row_number().over(run_order()) == 1
    return df.withColumn("_new", F.when(first, 0).otherwise(new)).withColumn("block", F.sum("_new").over(run_order())).drop("_new")


def blocks(df: DataFrame, label: str = "context") -> DataFrame:
    """Stretches of equal labels: first seq, end (exclusive), rows."""
    return with_blocks(df, label).groupBy("run_id", "block", label).agg(F.min("seq").alias("start"), (F.max("seq") + 1).alias("end"), F.count("*").alias("n"))


def label_runs(df: DataFrame, label: str, least: int) -> DataFrame:
    """Stretches of one label with at least so many rows."""
    return blocks(df).where((F.col("context") == label) & (F.col("n") >= least)).select("run_id", "start", "end", "n")


def crash_dilation(df: DataFrame, flag: Column, before: int = 10, after: int = 11) -> Column:
    """'crash' from ``before`` rows ahead of a flagged row to ``after`` rows past it, both inclusive; else the context."""
    near = F.max(flag.cast("int")).over(run_order().rowsBetween(-after, before))
    return F.when(near == 1, "crash").otherwise(F.col("context"))


def gap_fill(label: str = "context", gap: str = "road") -> Column:
    """A stretch of ``gap`` between two equal other labels takes that label."""
    other = F.when(F.col(label) != gap, F.col(label))
    before = F.last(other, True).over(run_order().rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(other, True).over(run_order().rowsBetween(0, Window.unboundedFollowing))
    return F.when((F.col(label) == gap) & (before == after), before).otherwise(F.col(label))


def filled(value: str) -> Column:
    """The last value so far, or else the next one."""
    before = F.last(value, True).over(run_order().rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, True).over(run_order().rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(before, after)


def retimestamped(t: Column, step: int) -> Column:
    """Equal steps from the run's first time."""
    return F.first(t).over(run_order()) + (F.row_number().over(run_order()) - 1) * F.lit(step)


def pivot_series(df: DataFrame, names: list[str], length: int) -> DataFrame:
    """Series (run_id, name, pos, value) side by side by position: cut or padded with nulls to ``length``."""
    spine = df.select("run_id").distinct().select("run_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))).alias("pos"))
    wide = df.where(F.col("pos") < length).groupBy("run_id", "pos").pivot("name", names).agg(F.first("value"))
    return spine.join(wide, ["run_id", "pos"], "left")


def representative_samples(df: DataFrame, value: str, size: int = WINDOW) -> DataFrame:
    """For each run and context one sample of ``size`` values.

    The longest block if it has that many rows (its first ones); else blocks
    joined, longest first; else these repeated.
    """
    rows = F.transform(F.sort_array(F.collect_list(F.struct("seq", value))), lambda r: r[value])
    b = with_blocks(df).groupBy("run_id", "context", "block").agg(rows.alias("v"), F.min("seq").alias("start"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.size("v")).alias("n"), "start", "v")))
    joined = b.groupBy("run_id", "context").agg(F.flatten(F.transform(ordered, lambda r: r["v"])).alias("v"))
    times = F.ceil(F.lit(size) / F.size("v")).cast("int")
    return joined.select("run_id", "context", F.slice(F.flatten(F.array_repeat("v", times)), 1, size).alias("sample"))


def context_blocks(df: DataFrame, value: str, label: str = "context") -> DataFrame:
    """Stretches of equal labels with their values in order: run_id, context, start, n, v."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("seq", value))), lambda r: r[value])
    return with_blocks(df, label).groupBy("run_id", "block", label).agg(F.min("seq").alias("start"), F.count("*").alias("n"), rows.alias("v")).drop("block")


def chosen_blocks(blocks: DataFrame) -> DataFrame:
    """Of each context the first block (by run, then place) of more than one row, which seeds its cluster."""
    first = F.min_by(F.struct("run_id", "start", "v"), F.struct("run_id", "start"))
    return blocks.where("n > 1").groupBy("context").agg(first.alias("c")).select("context", "c.*")


def context_segments(df: DataFrame, value: str, label: str = "context") -> DataFrame:
    """For each run and context its stretches joined in order, and where each begins and ends in the joined values."""
    s = F.sort_array(F.collect_list(F.struct("start", "n", "v")))
    j = context_blocks(df, value, label).groupBy("run_id", label).agg(s.alias("s"))
    ends = F.aggregate("s", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["n"])))
    return j.select("run_id", label, ends.alias("bounds"), F.flatten(F.transform("s", lambda x: x["v"])).alias("v"))


def whole_groups(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows of the groups in which none of the columns is null anywhere."""
    gap = F.lit(False)
    for c in columns:
        gap = gap | F.col(c).isNull()
    bad = df.groupBy(*by).agg(F.bool_or(gap).alias("gap")).where("gap")
    return df.join(bad.drop("gap"), by, "left_anti")


def random_split(df: DataFrame, key: list[str]) -> DataFrame:
    """70 % train, 15 % validation, 15 % test by a digest of the key: the same rows in any partitioning."""
    digest = F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in key])), 1, 2)
    return df.withColumn("part", F.when(digest < "b3", "train").when(digest < "d9", "validation").otherwise("test"))
