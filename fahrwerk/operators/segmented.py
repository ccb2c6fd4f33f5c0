"""Running values, blocks, frames and as-of joins of runs that are longer than a task should hold.

A run is cut into chunks of ``size`` steps of its order column.  What a running
value needs from the rows before its chunk is a summary of these chunks (their
last value, sum, maximum and so on), so three steps give the value:

1.  in each chunk, a window over its rows;
2.  a summary of each chunk, and a scan over the summaries of a run, which is
    done in the same way over chunks of chunks;
3.  the summary of all earlier chunks joined back to the chunk's rows.

Steps 1 and 3 share one shuffle by (run, chunk).  Frames of some rows around a
row need no summary: rows near a chunk's edges are sent to the neighbours, too.

Order columns are numbers, the first of which cuts the chunks (``size`` is in
its unit); frames need it to be the row's place in its run.  Null is a run
like any other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of a chunk.
CHUNK = 8192
_RUN, _PART = "_run", "_part"


@dataclass(frozen=True)
class Scan:
    """A running value: its kind, of which column, and whether the row itself is left out.

    ``last`` is the last value that isn't null up to the row, ``next`` the first
    one from the row on, ``first`` the value of the run's first row, ``sum``
    and ``max`` run up to the row.
    """

    kind: str
    value: Column | str
    before: bool = False

    def column(self) -> Column:
        return F.col(self.value) if isinstance(self.value, str) else self.value


def _over(kind: str, value: Column, keys: list[str], order: list[str], open_: bool) -> Column:
    """The value over a chunk's rows up to the current one (or from there on); ``open_`` leaves that one out.

    What comes next is what came last in the order turned round: frames that
    end with the chunk would be read again for each of its rows.
    """
    turned = [F.desc(c) for c in order] if kind == "next" else order
    back = Window.partitionBy(*keys).orderBy(*turned).rowsBetween(Window.unboundedPreceding, -1 if open_ else 0)
    return {
        "last": lambda: F.last(value, True).over(back),
        "next": lambda: F.last(value, True).over(back),
        "first": lambda: F.first(value).over(back),
        "sum": lambda: F.sum(value).over(back),
        "max": lambda: F.max(value).over(back),
    }[kind]()


def _summary(kind: str, value: str, order: list[str]) -> Column:
    """What a chunk tells the others."""
    at = F.when(F.col(value).isNotNull(), F.struct(*order))
    return {"last": lambda: F.max_by(value, at), "next": lambda: F.min_by(value, at), "first": lambda: F.min_by(value, F.struct(*order)), "sum": lambda: F.sum(value), "max": lambda: F.max(value)}[kind]()


def _joined(kind: str, own: Column, carried: Column) -> Column:
    if kind == "sum":
        return F.when(own.isNull() & carried.isNull(), None).otherwise(F.coalesce(own, F.lit(0)) + F.coalesce(carried, F.lit(0)))
    return {"first": lambda: F.coalesce(carried, own), "max": lambda: F.greatest(own, carried)}.get(kind, lambda: F.coalesce(own, carried))()


def _chunked(df: DataFrame, by: list[str], order: list[str], size: float) -> DataFrame:
    return df.withColumns({_RUN: F.struct(*by) if by else F.struct(F.lit(0)), _PART: F.floor(F.col(order[0]) / size)})


def _scanned(df: DataFrame, scans: dict[str, Scan], order: list[str], levels: int) -> DataFrame:
    """``df`` (with the run and the chunk) and the running values."""
    # Values of a first row may be null: they travel inside a struct.
    inside = {n: F.struct(s.column().alias("v")) if s.kind == "first" else s.column() for n, s in scans.items()}
    temp = {n: f"_own_{n}" for n in scans}
    df = df.withColumns({temp[n]: v for n, v in inside.items()})
    summaries = df.groupBy(_RUN, _PART).agg(*[_summary(s.kind, temp[n], order).alias(f"_all_{n}") for n, s in scans.items()])
    above = {f"_in_{n}": Scan(s.kind, f"_all_{n}", True) for n, s in scans.items()}
    carried = _carried(summaries, above, levels)
    out = df.withColumns({f"_w_{n}": _over(s.kind, F.col(temp[n]), [_RUN, _PART], order, s.before) for n, s in scans.items()})
    out = out.join(carried.select(_RUN, _PART, *above), [_RUN, _PART], "left")
    done = {}
    for n, s in scans.items():
        value = _joined(s.kind, F.col(f"_w_{n}"), F.col(f"_in_{n}"))
        done[n] = value["v"] if s.kind == "first" else value
    return out.withColumns(done).drop(*temp.values(), *above, *[f"_w_{n}" for n in scans])


def _carried(summaries: DataFrame, above: dict[str, Scan], levels: int) -> DataFrame:
    """For each chunk what the chunks before it (for ``next``: after it) give together."""
    if levels <= 0:
        return summaries.withColumns({n: _over(s.kind, s.column(), [_RUN], [_PART], True) for n, s in above.items()})
    higher = summaries.withColumnRenamed(_PART, "_chunk").withColumn(_PART, F.floor(F.col("_chunk") / CHUNK))
    return _scanned(higher, above, ["_chunk"], levels - 1).drop(_PART).withColumnRenamed("_chunk", _PART)


def scanned(df: DataFrame, scans: dict[str, Scan], by: list[str], order: list[str], size: float = CHUNK, levels: int = 1) -> DataFrame:
    """``df`` with a column for each running value; ``order`` must order a run's rows fully."""
    return _scanned(_chunked(df, by, order, size), scans, order, levels).drop(_RUN, _PART)


def framed(df: DataFrame, measures: dict[str, Callable[[Window], Column]], before: int, after: int, by: list[str], order: str = "seq", size: int = CHUNK) -> DataFrame:
    """``df`` with measures over the frame from ``before`` rows ahead of a row to ``after`` rows past it."""
    first, last = F.floor((F.col(order) - after) / size), F.floor((F.col(order) + before) / size)
    spread = df.withColumns({_RUN: F.struct(*by) if by else F.struct(F.lit(0)), _PART: F.explode(F.sequence(F.greatest(first, F.lit(0)), last))})
    w = Window.partitionBy(_RUN, _PART).orderBy(order).rowsBetween(-before, after)
    out = spread.withColumns({n: f(w) for n, f in measures.items()})
    return out.where(F.col(_PART) == F.floor(F.col(order) / size)).drop(_RUN, _PART)


def filled(df: DataFrame, value: str, by: list[str], order: list[str], size: float = CHUNK) -> DataFrame:
    """``value`` where it is null: the last one so far, or else the next one."""
    out = scanned(df, {"_a": Scan("last", value), "_b": Scan("next", value)}, by, order, size)
    return out.withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def gap_filled(df: DataFrame, by: list[str], order: list[str], label: str = "context", gap: str = "road", size: float = CHUNK) -> DataFrame:
    """A stretch of ``gap`` between two equal other labels takes that label."""
    other = F.when(F.col(label) != gap, F.col(label))
    out = scanned(df, {"_a": Scan("last", other), "_b": Scan("next", other)}, by, order, size)
    return out.withColumn(label, F.when((F.col(label) == gap) & (F.col("_a") == F.col("_b")), F.col("_a")).otherwise(F.col(label))).drop("_a", "_b")


def retimestamped(df: DataFrame, by: list[str], order: str, t: str, step: int, size: float = CHUNK) -> DataFrame:
    """``t`` in equal steps from the run's first time; ``order`` is the row's place."""
    out = scanned(df, {"_first": Scan("first", t)}, by, [order], size)
    return out.withColumn(t, F.col("_first") + F.col(order) * F.lit(step)).drop("_first")


def with_blocks(df: DataFrame, by: list[str], order: list[str], label: str = "context", size: float = CHUNK, levels: int = 1) -> DataFrame:
    """Adds ``block``: the number of the unbroken stretch of equal labels."""
    parted = _chunked(df, by, order, size)
    seen = _scanned(parted, {"_before": Scan("last", F.struct(F.col(label).alias("v")), True)}, order, levels)
    new = (F.col("_before").isNotNull() & ~F.col("_before.v").eqNullSafe(F.col(label))).cast("int")
    out = _scanned(seen.withColumn("_new", new), {"block": Scan("sum", "_new")}, order, levels)
    return out.drop("_before", "_new", _RUN, _PART)


def blocks(df: DataFrame, by: list[str], order: str = "seq", label: str = "context", size: float = CHUNK) -> DataFrame:
    """Stretches of equal labels: first place, end (exclusive), rows.  A stretch over many chunks is added up from them."""
    b = with_blocks(df, by, [order], label, size)
    return b.groupBy(*by, "block", label).agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end"), F.count("*").alias("n"))


def asof_before(left: DataFrame, right: DataFrame, by: list[str], order: list[str], value: str, size: float = CHUNK) -> DataFrame:
    """For each left row the right row's value last strictly before it; before all of them, the first one's."""
    a = left.select(*left.columns, F.lit(0).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(*by, *order, F.col(value).alias("_v"), F.lit(1).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    # Before all of the right side, the next value is the first one.
    out = scanned(both, {"_seen": Scan("last", "_v"), "_next": Scan("next", "_v")}, by, [*order, "_side"], size)
    return out.where("_side = 0").withColumn(value, F.coalesce("_seen", "_next")).drop("_side", "_v", "_seen", "_next")


def asof_pointer(left: DataFrame, right: DataFrame, by: list[str], values: list[str], tie: str, size: float) -> DataFrame:
    """The pointer walk of ``joins.asof_pointer`` (same keys on both sides), for runs of any length.

    ``size`` is the time that a chunk spans; ``tie`` orders left rows of equal time.
    """
    order = ["t", "_side", tie]
    r = right.select(*by, "t", *values, F.lit(0).alias("_n"))
    r = scanned(r, {"_count": Scan("sum", F.lit(1)), "_after": Scan("next", "t", True)}, by, ["t"], size)
    r = r.withColumn("_i", F.col("_count") - 1)
    spot = r.select(*by, F.col("t").alias("_t"), F.col("_i").alias("_p"), *values)
    sides = r.select(*by, "t", "_i", F.coalesce("_after", F.lit(-1)).alias("_after"), F.lit(1).alias("_side"), F.lit(None).cast(left.schema[tie].dataType).alias(tie))
    both = left.select(*left.columns, F.lit(0).alias("_side")).unionByName(sides, allowMissingColumns=True)
    seen = scanned(both, {"_k": Scan("last", "_i"), "_until": Scan("last", "_after")}, by, order, size).where("_side = 0").drop("_i", "_after", "_side")
    order = ["t", tie]
    seen = seen.withColumn("_inside", F.col("_k").isNotNull() & (F.col("t") < F.col("_until")))
    seen = scanned(seen, {"_start": Scan("first", "_k"), "_top": Scan("max", F.when(F.col("_inside"), F.col("_k")), True)}, by, order, size)
    seen = seen.withColumn("_start", F.greatest(F.coalesce("_start", F.lit(0)), F.lit(0)))
    seen = seen.withColumn("_new", F.col("_inside") & (F.col("_top").isNull() | (F.col("_top") < F.col("_k"))))
    seen = scanned(seen, {"_nth": Scan("sum", F.col("_new").cast("int"))}, by, order, size)
    seen = seen.withColumn("_moves", F.col("_new") & (F.col("_k") == F.col("_start") + F.col("_nth") - 1))
    seen = scanned(seen, {"_moved": Scan("sum", F.col("_moves").cast("int"))}, by, order, size)
    seen = seen.withColumn("_p", F.col("_start") + F.col("_moved"))
    return seen.join(spot, [*by, "_p"], "left").select(*left.columns, F.col("_t").alias("at"), *values)
