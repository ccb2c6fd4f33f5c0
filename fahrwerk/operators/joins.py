"""Spatial and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import segment_squared_distances
from .lineage import cut

RADIUS = 5.0
#: Cells along a radius.
CELLS = 4
#: Cells that every task may get.
BROADCAST_CELLS = 100_000
_CELL = ["cx", "cy", "cz"]


def _celled(points: DataFrame, radius: float) -> DataFrame:
    side = radius / CELLS
    return points.withColumns({f"c{axis}": F.floor(F.col(axis) / side).cast("long") for axis in "xyz"})


def ranked_cells(features: DataFrame, points: DataFrame, radius: float = RADIUS) -> DataFrame:
    """The features that can be the first one within ``radius`` of some point, by the points' cells (cx, cy, cz).

    A feature that is within the radius of the whole box around a cell's points
    settles the cell: no feature of a higher rank can be the first one there.
    So a cell keeps the lowest such feature and those of lower ranks that reach
    into the box, which are few however dense the features lie: they grow with
    the part of the ball that lies at the box's border, not with the number of
    features.  Of features in the same place the lowest one is kept.
    """
    cell = lambda x: F.floor(x / (radius / CELLS)).cast("long")
    boxes = points.dropna(subset=list("xyz")).groupBy(*_CELL).agg(*[g(axis).alias(f"{n}{axis}") for axis in "xyz" for n, g in (("lo", F.min), ("hi", F.max))])
    boxes = cut(boxes)
    small = F.broadcast if boxes.count() <= BROADCAST_CELLS else lambda t: t
    place = [f"{e}{axis}" for axis in "xyz" for e in "ab"]
    # A feature becomes many rows: as many tasks as a shuffle has, however few features there are.
    tasks = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    f = features.where("list_idx is not null").repartition(tasks, *place).groupBy(*place).agg(F.min(F.struct("type_rank", "list_idx", "ftype")).alias("rank")).select(*place, "rank.*")
    # Only cells between the first and the last one of each axis.
    f = f.crossJoin(F.broadcast(boxes.agg(*[g(c).alias(f"{n}{c}") for c in _CELL for n, g in (("first_", F.min), ("last_", F.max))])))
    for axis in "xyz":
        lo = F.greatest(cell(F.least(f[f"a{axis}"], f[f"b{axis}"]) - radius), F.col(f"first_c{axis}"))
        hi = F.least(cell(F.greatest(f[f"a{axis}"], f[f"b{axis}"]) + radius), F.col(f"last_c{axis}"))
        f = f.where(lo <= hi).withColumn(f"c{axis}", F.explode(F.sequence(lo, hi)))
    middle = [((F.col(f"lo{c}") + F.col(f"hi{c}")) / 2).alias(f"m{c}") for c in "xyz"]
    half = F.sqrt(sum((F.col(f"hi{c}") - F.col(f"lo{c}")) * (F.col(f"hi{c}") - F.col(f"lo{c}")) for c in "xyz")) / 2
    f = f.join(small(boxes.select(*_CELL, *middle, half.alias("half"))), _CELL)
    f = f.withColumn("away", F.sqrt(segment_squared_distances(*[f"{e}{c}" for e in "mab" for c in "xyz"])))
    # A hair more and less, for what rounding does.
    f = f.where((F.col("away") - F.col("half")) <= radius * (1 + 1e-9)).withColumn("settles", (F.col("away") + F.col("half")) <= radius * (1 - 1e-9))
    # The lowest of each type, then the lowest type: sums of fixed size, which need no sort.
    first = f.where("settles").groupBy(*_CELL, "type_rank").agg(F.min("list_idx").alias("list_idx")).groupBy(*_CELL).agg(F.min(F.struct("type_rank", "list_idx")).alias("first"))
    out = f.join(small(first), _CELL, "left").where(F.col("first").isNull() | (F.struct("type_rank", "list_idx") <= F.col("first")))
    return out.select(*_CELL, *place, "type_rank", "list_idx", "ftype")


def spatial_context(points: DataFrame, features: DataFrame, key: list[str], radius: float = RADIUS) -> DataFrame:
    """Label of the first map feature (by type, then list order) within ``radius`` of each point, or 'road'.

    A point looks into its own cell of ``ranked_cells``, so the join is on
    equal cells, and each point meets a few features, however many there are.
    """
    p = _celled(points, radius).select(*key, *"xyz", *_CELL)
    near = p.join(ranked_cells(features, p, radius), _CELL)
    d2 = segment_squared_distances(*"xyz", *[f"{e}{c}" for e in "ab" for c in "xyz"])
    # The box as well: where rounding makes them differ at the very border, both must hold.
    for c in "xyz":
        near = near.where(F.col(c).between(F.least(f"a{c}", f"b{c}") - radius, F.greatest(f"a{c}", f"b{c}") + radius))
    best = near.where(d2 <= radius * radius).groupBy(*key, "type_rank", "ftype").agg(F.min("list_idx").alias("list_idx"))
    best = best.groupBy(*key).agg(F.min(F.struct("type_rank", "list_idx", "ftype")).alias("rank"))
    named = best.select(*key, F.concat_ws("_", "rank.ftype", "rank.list_idx").alias("feature"))
    return points.join(named, key, "left").withColumn("feature", F.coalesce("feature", F.lit("road")))


def asof_before(left: DataFrame, right: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """For each left row the right row's value last strictly before it; before all of them, the first one's.

    Both sides are sorted once by key and time; no pair of rows is formed.
    """
    name = f"_{value}"
    a = left.select(*left.columns, F.lit(0).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias(name))
    b = right.select(*by, *order, value).withColumnRenamed(value, name).withColumn("_side", F.lit(1))
    w = Window.partitionBy(*by).orderBy(*order, "_side")
    seen = F.last(name, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(name, True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(value, F.coalesce(seen, first)).where("_side = 0").drop("_side", name)


def asof_pointer(left: DataFrame, right: DataFrame, by: list[str], right_by: list[str], values: list[str]) -> DataFrame:
    """The pointer walk over the right side's times: adds ``at`` (the pointer's time) and ``values`` there.

    The pointer starts at the latest time strictly before a key's first row,
    or at the first, and moves on by one at a row that lies strictly between
    it and the next.  So it moves once in each stretch between two times that
    holds rows, and stays for good at the first stretch without any: windows
    over both sides express it, and no key's rows meet in memory.  ``right_by``
    is the part of ``by`` that the right side has; its times are distinct.
    """
    keys, more = [c for c in by if c in right_by], [c for c in by if c not in right_by]
    order = Window.partitionBy(*keys).orderBy("t")
    r = right.select(*keys, "t", *values).withColumns({"_i": F.row_number().over(order) - 1, "_next": F.lead("t").over(order)})
    spot = r.select(*keys, F.col("t").alias("_t"), F.col("_i").alias("_p"), *values)
    # The right side once for each of the left's keys.
    heads = left.select(*by).distinct()
    sides = heads.join(r.select(*keys, "t", "_i", "_next"), keys)
    both = left.select(*left.columns, F.lit(0).alias("_side")).unionByName(sides.select(*by, "t", "_i", "_next", F.lit(1).alias("_side")), allowMissingColumns=True)
    # At equal times the left row comes first, as only times strictly before it count.
    tie = [c for c in left.columns if c not in (*by, "t") and dict(left.dtypes)[c] in ("bigint", "int")]
    w = Window.partitionBy(*by).orderBy("t", "_side", *tie)
    upto = F.last(F.when(F.col("_side") == 1, F.coalesce("_next", F.lit(-1))), True).over(w)
    seen = both.withColumns({"_k": F.last("_i", True).over(w), "_until": upto}).where("_side = 0").drop("_i", "_next", "_side")
    w = Window.partitionBy(*by).orderBy("t", *tie)
    start = F.greatest(F.coalesce(F.first("_k").over(w), F.lit(0)), F.lit(0))
    seen = seen.withColumn("_start", start).withColumn("_inside", F.col("_k").isNotNull() & (F.col("t") < F.col("_until")))
    # The first row of each stretch.
    last = F.max(F.when(F.col("_inside"), F.col("_k"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    seen = seen.withColumn("_new", F.col("_inside") & (last.isNull() | (last < F.col("_k"))))
    nth = F.sum(F.col("_new").cast("int")).over(w)
    seen = seen.withColumn("_moves", F.col("_new") & (F.col("_k") == F.col("_start") + nth - 1))
    seen = seen.withColumn("_p", (F.col("_start") + F.sum(F.col("_moves").cast("int")).over(w)).cast("int"))
    return seen.join(spot, [*keys, "_p"], "left").select(*left.columns, F.col("_t").alias("at"), *values)


def asof_sequential(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """``asof_pointer`` of rows (``by``, rid, t) on times (``by``, t): adds ``ego``, the pointer's time."""
    return asof_pointer(left.select(by, "rid", "t"), right.select(by, "t"), [by], [by], []).withColumnRenamed("at", "ego")
