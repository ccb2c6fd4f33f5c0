"""Row numbers and exact quantiles of groups that no task holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Ranges into which a group is cut for row numbers.
CELLS = 64
#: Ranges of values that a round counts, and rows of a group that one buffer may hold.
BINS, BUFFER = 1024, 4096
#: Groups whose edges and counts every task may get.
BROADCAST_GROUPS = 1_000
_KEY = "_key"


def _keyed(df: DataFrame, by: list[str]) -> DataFrame:
    """Null groups are groups like others: the key is a struct."""
    return df.withColumn(_KEY, F.struct(*by) if by else F.struct(F.lit(0)))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "seq", cells: int = CELLS) -> DataFrame:
    """``df`` with the row's place (from 0) in its group.

    A group is cut at quantiles of its first order column (a number or a
    time); places inside a cell and the rows of the cells before it add up.
    Rows that are equal there stay in one cell.  Nulls come first.
    """
    first = F.col(order[0])
    kind = dict(df.dtypes)[order[0]]
    first = F.unix_micros(first.cast("timestamp")) if kind.startswith(("timestamp", "date")) else first
    keyed = _keyed(df, by).withColumn("_x", first.cast("double"))
    shares = [k / cells for k in range(1, cells)]
    edges = cut(keyed.groupBy(_KEY).agg(F.percentile_approx("_x", shares, 20 * cells).alias("_edges")))
    small = F.broadcast if edges.count() <= BROADCAST_GROUPS else lambda t: t
    # A row's cell: how many edges lie below it, found by halving.
    dealt, step = keyed.join(small(edges), _KEY).withColumn("_cell", F.lit(0)), 1 << (cells - 1).bit_length()
    while step := step // 2:
        dealt = dealt.withColumn("_cell", F.col("_cell") + F.when(F.get("_edges", F.col("_cell") + (step - 1)) < F.col("_x"), step).otherwise(0))
    dealt = dealt.withColumn("_cell", F.when(F.col("_x").isNull(), -1).otherwise(F.col("_cell"))).drop("_edges", "_x")
    counts = dealt.groupBy(_KEY, "_cell").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(_KEY).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(_KEY, "_cell", F.coalesce(before, F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy(_KEY, "_cell").orderBy(*order))
    out = dealt.withColumn("_place", inside).join(small(counts), [_KEY, "_cell"])
    return out.withColumn(name, (F.col("_ahead") + F.col("_place") - 1).cast("long")).drop(_KEY, "_cell", "_place", "_ahead")


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], buffer: int = BUFFER) -> DataFrame:
    """``by`` and ``q``: the exact quantiles of each group, between two values in proportion.

    Groups of at most ``buffer`` values are sorted in one buffer.  In larger
    ones the sought values are narrowed down: a range of values is counted in
    BINS bins, the bin that holds the rank is the next range, from its smallest
    to its largest value, until it holds one value alone.  A round reads only
    rows in ranges that are still open, and no group meets in a task.
    Nulls and NaN don't count.
    """
    rows = _keyed(df, by).select(_KEY, *by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    totals = rows.groupBy(_KEY).agg(F.count("*").alias("_n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    totals = cut(totals)
    small = rows.join(totals.where(F.col("_n") <= buffer).select(_KEY), _KEY, "left_semi").groupBy(_KEY).agg(F.percentile("_v", F.array(*map(F.lit, shares))).alias("q"))
    # The ranks on both sides of each quantile.
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(F.lit(s) * (F.col("_n") - 1)), F.ceil(F.lit(s) * (F.col("_n") - 1))) for s in shares])))
    state = totals.where(F.col("_n") > buffer).select(_KEY, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"))
    while state.where("lo < hi").limit(1).count():
        bin_ = F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        # Ranks that share a range are counted once.
        ranges = state.where("lo < hi").select(_KEY, "lo", "hi", "below").distinct()
        counted = rows.join(ranges, _KEY).where("_v between lo and hi").groupBy(_KEY, "lo", "hi", "below", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("_v").alias("new_lo"), F.max("_v").alias("new_hi"))
        upto = F.sum("n").over(Window.partitionBy(_KEY, "lo", "hi").orderBy("bin"))
        counted = counted.withColumn("new_below", F.col("below") + upto - F.col("n"))
        open_ = state.where("lo < hi").join(counted, [_KEY, "lo", "hi", "below"]).where("rank >= new_below and rank < new_below + n")
        new = open_.select(_KEY, "rank", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), F.col("new_below").alias("below"))
        state = cut(state.where("lo = hi").union(new))
    values = state.groupBy(_KEY).agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("_at")).join(totals.select(_KEY, "_n"), _KEY)
    spot = lambda s: F.lit(s) * (F.col("_n") - 1)
    low, high = (lambda s: F.element_at("_at", F.floor(spot(s)))), (lambda s: F.element_at("_at", F.ceil(spot(s))))
    large = values.select(_KEY, F.array(*[low(s) + (spot(s) - F.floor(spot(s))) * (high(s) - low(s)) for s in shares]).alias("q"))
    return small.union(large).select(*[F.col(f"{_KEY}.{c}").alias(c) for c in by], "q")
