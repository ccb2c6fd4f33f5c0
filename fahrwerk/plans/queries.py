"""Registered queries over the test tables, each with the same question in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, geo, labels, text, units
from ..model import GROUPS, physics_groups
from ..operators import cluster, features, joins, lagged, lineage, pricing, ranks, reduction
from ..operators import sequence as sq
from ..streaming import buffer
from .base import ORACLES, QUERIES, query, r  # noqa: F401
from ..sources.telemetry import FEAT_SQL, SHIP_SQL, TELE_SQL, map_features, shipments, table, telemetry

_ROWS = ", ".join(f"('{n}', {lo}, {hi}, {m}, {f}::double)" for n, lo, hi, m, f in GROUPS)
GROUPS_SQL = f"grp as (select * from (values {_ROWS}) g(grp, lo, hi, mass, friction))"
PRICE_SQL = """case when context is null then 1.0::double when contains(lower(context), 'road') then 1.0::double
 when contains(lower(context), 'ramp') and try_cast(split_part(context, '_', 3) as double) is null then 3.0::double
 when contains(lower(context), 'ramp') and contains(split_part(context, '_', 2), 'asc') then 2.0::double + 1.5::double * try_cast(split_part(context, '_', 3) as double)
 when contains(lower(context), 'ramp') and contains(split_part(context, '_', 2), 'desc') then greatest(1.0::double, 2.0::double - try_cast(split_part(context, '_', 3) as double))
 {crash} when contains(context, 'pothole') then 15.0::double when contains(context, 'speedbump') then 8.0::double
 when contains(context, 'elevated_crosswalk') then 5.0::double else 3.0::double end"""
PRICE2 = PRICE_SQL.replace("{crash}", "when contains(context, 'crash') then 50.0::double")
PRICE1 = PRICE_SQL.replace("{crash}", "")
GENERIC_SQL = r"coalesce(regexp_replace(context, '_\d+$', ''), 'unknown')"


def with_groups(df: DataFrame) -> DataFrame:
    """Physics groups by a range of run numbers; the eleven ranges are broadcast."""
    g = F.broadcast(physics_groups(df.sparkSession).withColumnRenamed("group", "grp"))
    n = F.col("run_id") % 220 + 1
    return df.join(g, (n >= g["lo"]) & (n <= g["hi"])).drop("lo", "hi")


JOIN_GROUPS = "join grp on run_id % 220 + 1 between lo and hi"


# Scans, projections, filters, lookups


@query(f"with {TELE_SQL} select run_id, seq, value, k from tele")
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).select("run_id", "seq", "value", "k")


@query(f"with {TELE_SQL} select run_id, count(*) as n, round(avg(value), 4) as mean from tele where value > 100 and context <> 'road' and k is not null group by run_id having count(*) > 5")
def filter_predicates(spark, sf_dir):
    t = telemetry(spark, sf_dir).where("value > 100 and context <> 'road'").dropna(subset=["k"])
    return t.groupBy("run_id").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean")).where("n > 5")


@query(f"with {TELE_SQL} select run_id, seq, round(sqrt(value * value + k * k + 1), 4) as speed, round(value - 9.81::double, 4) as z, round(sqrt(value * value + k * k), 4) as horizontal, sqrt(value * value + k * k) > 400 as crash from tele")
def derive_speed_crash(spark, sf_dir):
    h = F.sqrt(F.col("value") * F.col("value") + F.col("k") * F.col("k"))
    return telemetry(spark, sf_dir).select(
        "run_id", "seq", r(F.sqrt(F.col("value") * F.col("value") + F.col("k") * F.col("k") + 1)).alias("speed"), r(F.col("value") - 9.81).alias("z"), r(h).alias("horizontal"), (h > 400).alias("crash")
    )


@query(f"with {TELE_SQL}, code as (select event_type, dense_rank() over (order by event_type) - 1 as code from (select distinct event_type from events)) select run_id, seq, code from tele join code using (event_type)")
def lookup_join(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    # Kinds of events are few by definition; the planner broadcasts them by their size.
    kinds = t.select("event_type").distinct().withColumn("code", (F.dense_rank().over(Window.orderBy("event_type")) - 1).cast("long"))
    return t.join(kinds, "event_type").select("run_id", "seq", "code")


@query(f"with {TELE_SQL}, {GROUPS_SQL} select grp, mass, friction, count(*) as n, count(distinct run_id) as runs from tele {JOIN_GROUPS} group by all")
def range_group_join(spark, sf_dir):
    return with_groups(telemetry(spark, sf_dir)).groupBy("grp", "mass", "friction").agg(F.count("*").alias("n"), F.countDistinct("run_id").alias("runs"))


@query(f"with {TELE_SQL} select run_id, count(*) as n from tele where run_id not in (54, 55) group by run_id")
def anti_skip_runs(spark, sf_dir):
    skip = spark.createDataFrame([(54,), (55,)], "run_id long")
    return telemetry(spark, sf_dir).join(F.broadcast(skip), "run_id", "left_anti").groupBy("run_id").agg(F.count("*").alias("n"))


@query(f"with {TELE_SQL} select run_id, count(*) as n from tele where run_id in (select l_suppkey from lineitem where l_quantity > 49) group by run_id")
def semi_runs(spark, sf_dir):
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("run_id"))
    return telemetry(spark, sf_dir).join(big, "run_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("n"))


KINDS = ["click", "error", "purchase", "signup", "view"]


@query(
    f"with {TELE_SQL}, s as (select run_id, event_type, value, row_number() over (partition by run_id, event_type order by seq) - 1 as pos from tele), runs as (select distinct run_id from tele) "
    + "select run_id, pos, " + ", ".join(f"max(case when event_type = '{k}' then value end) as {k}" for k in KINDS)
    + " from runs cross join (select unnest(range((select max(pos) + 1 from s))) as pos) left join s using (run_id, pos) group by run_id, pos"
)
def pivot_series(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    w = Window.partitionBy("run_id", "event_type").orderBy("seq")
    s = t.select("run_id", F.col("event_type").alias("name"), "value", (F.row_number().over(w) - 1).cast("long").alias("pos"))
    # As long as the longest series.
    length = s.agg(F.max("pos")).first()[0]
    return sq.pivot_series(s, KINDS, 1 + (-1 if length is None else length))


# Spatial and as-of joins


@query(f"""with {TELE_SQL}, {FEAT_SQL}, d as (select event_id, ftype || '_' || list_idx as feature, type_rank, list_idx,
  (case when (bx-ax)*(bx-ax) + ("by"-ay)*("by"-ay) = 0 then 0.0::double else greatest(0.0::double, least(1.0::double, ((value-ax)*(bx-ax) + (k-ay)*("by"-ay)) / nullif((bx-ax)*(bx-ax) + ("by"-ay)*("by"-ay), 0))) end) as t,
  value, k, ax, ay, bx, "by" from tele join feat on value between least(ax,bx) - 5 and greatest(ax,bx) + 5 and k between ay - 5 and ay + 5),
  m as (select event_id, arg_min(feature, (type_rank, list_idx)) as feature from d where (value-(ax+t*(bx-ax)))*(value-(ax+t*(bx-ax))) + (k-(ay+t*("by"-ay)))*(k-(ay+t*("by"-ay))) <= 25 group by event_id)
  select run_id, seq, coalesce(feature, 'road') as feature from tele left join m using (event_id)""")
def spatial_context(spark, sf_dir):
    t = telemetry(spark, sf_dir).select("event_id", "run_id", "seq", F.col("value").alias("x"), F.col("k").cast("double").alias("y"), F.lit(0.0).alias("z"))
    return joins.spatial_context(t, map_features(spark, sf_dir), ["event_id"]).select("run_id", "seq", "feature")


@query(f"""with {TELE_SQL}, e as (select run_id, t, seq, value from tele where event_type = 'view'), l as (select run_id, t, seq, event_id from tele where event_type = 'error'),
  f as (select run_id, arg_min(value, seq) as fv from e group by run_id)
  select l.run_id, l.seq, coalesce(e.value, f.fv) as ego from l asof left join e on l.run_id = e.run_id and l.seq > e.seq left join f on f.run_id = l.run_id""")
def asof_strict(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    left = t.where("event_type = 'error'").select("run_id", "seq")
    ego = t.where("event_type = 'view'").select("run_id", "seq", F.col("value").alias("ego"))
    return joins.asof_before(left, ego, ["run_id"], ["seq"], "ego")


@query(f"with {TELE_SQL}, {FEAT_SQL} select run_id, round(min(sqrt((value-ax)*(value-ax) + (k-ay)*(k-ay))), 4) as nearest from tele cross join (select * from feat order by list_idx limit 1) group by run_id")
def path_min_distance(spark, sf_dir):
    one = F.broadcast(map_features(spark, sf_dir).orderBy("list_idx").limit(1))
    d2 = geo.squared_distance([F.col("value"), F.col("k")], [F.col("ax"), F.col("ay")])
    return telemetry(spark, sf_dir).crossJoin(one).groupBy("run_id").agg(r(F.min(F.sqrt(d2))).alias("nearest"))


# Ordered runs


@query(f"with {SHIP_SQL} select run_id, cast(seq // 30 as bigint) as win, round(sum(quantity), 4) as total, first(quantity order by seq) as head from ship group by run_id, seq // 30 having count(*) = 30")
def tumbling_windows(spark, sf_dir):
    w = sq.tumbling_windows(shipments(spark, sf_dir), ["quantity"])
    return w.select("run_id", "win", r(F.aggregate("quantity", F.lit(0.0), lambda a, x: a + x)).alias("total"), F.col("quantity")[0].alias("head"))


@query(f"with {TELE_SQL} select run_id, seq, s as total from (select run_id, seq, round(sum(value) over w, 4) as s, count(*) over w as n from tele window w as (partition by run_id order by seq rows between current row and 29 following)) where n = 30")
def sliding_windows(spark, sf_dir):
    w = sq.sliding_windows(telemetry(spark, sf_dir), "value")
    return w.select("run_id", "seq", r(F.aggregate("values", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"with {TELE_SQL} select run_id, seq, case when n = 30 then m end as mid from (select run_id, seq, round(avg(value) over w, 4) as m, count(*) over w as n from tele window w as (partition by run_id order by seq rows between 15 preceding and 14 following))")
def centred_window(spark, sf_dir):
    return telemetry(spark, sf_dir).select("run_id", "seq", r(sq.centred(None, F.avg("value"))).alias("mid"))


@query(f"with {TELE_SQL}, b as (select *, seq - row_number() over (partition by run_id, event_type order by seq) as g from tele) select run_id, event_type, min(seq) as start, max(seq) + 1 as \"end\", count(*) as n from b group by run_id, event_type, g")
def context_blocks(spark, sf_dir):
    return sq.blocks(telemetry(spark, sf_dir), "event_type").select("run_id", "event_type", "start", "end", "n")


@query(f"with {TELE_SQL}, b as (select *, seq - row_number() over (partition by run_id, context order by seq) as g from tele) select run_id, min(seq) as start, max(seq) + 1 as \"end\", count(*) as n from b where context = 'road' group by run_id, g having count(*) >= 2")
def road_runs(spark, sf_dir):
    return sq.label_runs(telemetry(spark, sf_dir), "road", 2)


@query(f"""with {TELE_SQL}, f as (select *, last_value(case when event_type <> 'view' then event_type end ignore nulls) over (partition by run_id order by seq rows between unbounded preceding and current row) as a,
  first_value(case when event_type <> 'view' then event_type end ignore nulls) over (partition by run_id order by seq rows between current row and unbounded following) as b from tele)
  select run_id, seq, case when event_type = 'view' and a = b then a else event_type end as label from f""")
def gap_fill(spark, sf_dir):
    return telemetry(spark, sf_dir).select("run_id", "seq", sq.gap_fill("event_type", "view").alias("label"))


@query(f"with {TELE_SQL} select run_id, seq, case when max(case when value > 480 then 1 else 0 end) over (partition by run_id order by seq rows between 11 preceding and 10 following) = 1 then 'crash' else context end as context from tele")
def crash_dilation(spark, sf_dir):
    return telemetry(spark, sf_dir).select("run_id", "seq", sq.crash_dilation(None, F.col("value") > 480).alias("context"))


@query(f"""with {TELE_SQL}, n as (select run_id, seq, case when k % 3 <> 0 then value end as v from tele) select run_id, seq, coalesce(last_value(v ignore nulls) over (partition by run_id order by seq rows between unbounded preceding and current row),
  first_value(v ignore nulls) over (partition by run_id order by seq rows between current row and unbounded following)) as v from n""")
def ffill_bfill(spark, sf_dir):
    t = telemetry(spark, sf_dir).withColumn("v", F.when(F.col("k") % 3 != 0, F.col("value")))
    return t.select("run_id", "seq", sq.filled("v").alias("v"))


@query(f"with {TELE_SQL} select run_id, seq, first_value(epoch_us(t)) over (partition by run_id order by seq) + seq * 100000 as t from tele")
def retimestamp(spark, sf_dir):
    t = telemetry(spark, sf_dir).withColumn("us", F.unix_micros(F.col("t").cast("timestamp")))
    return t.select("run_id", "seq", sq.retimestamped(F.col("us"), 100000).alias("t"))


@query(f"""with {TELE_SQL}, b as (select *, seq - row_number() over (partition by run_id, event_type order by seq) as g from tele),
  k as (select run_id, event_type, g, list(value order by seq) as v, count(*) as n, min(seq) as start from b group by run_id, event_type, g),
  j as (select run_id, event_type, flatten(list(v order by n desc, start)) as v from k group by run_id, event_type)
  select run_id, event_type as context, round(list_sum(list_transform(range(30), lambda i: v[(i % len(v)) + 1])), 4) as total from j""")
def representative_samples(spark, sf_dir):
    t = telemetry(spark, sf_dir).select("run_id", "seq", "value", F.col("event_type").alias("context"))
    return sq.representative_samples(t, "value").select("run_id", "context", r(F.aggregate("sample", F.lit(0.0), lambda a, x: a + x)).alias("total"))


# Labels and codecs


@query(f"with {TELE_SQL} select run_id, seq, {PRICE1} as price from tele")
def context_price_v1(spark, sf_dir):
    return telemetry(spark, sf_dir).select("run_id", "seq", labels.context_price(F.col("context"), crash=False).alias("price"))


@query(f"with {TELE_SQL} select run_id, seq, {PRICE2} as price from tele")
def context_price_v2(spark, sf_dir):
    return telemetry(spark, sf_dir).select("run_id", "seq", labels.context_price(F.col("context")).alias("price"))


@query(f"with {TELE_SQL} select {GENERIC_SQL} as generic, count(*) as n from tele group by 1")
def generic_context(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy(labels.generic_context(F.col("context")).alias("generic")).agg(F.count("*").alias("n"))


@query(f"""with {TELE_SQL} select case when context = 'road' then 'road' when starts_with(context, 'ramp_') then 'ramp_' || split_part(context, '_', 2) when context = 'crash' then 'crash'
  when starts_with(context, 'pothole') then 'pothole' when starts_with(context, 'speedbump') then 'speedbump' when starts_with(context, 'elevated_crosswalk') then 'elevated_crosswalk'
  when starts_with(context, 'cut') then 'cut' else 'unknown' end as coarse, count(*) as n from tele group by 1""")
def coarse_context(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy(labels.coarse_context(F.col("context")).alias("coarse")).agg(F.count("*").alias("n"))


_U = "(l_orderkey * 2654435761 + l_partkey * 40503) % 4294967296"


@query(f"""with u as (select l_orderkey, l_linenumber, {_U} as u from lineitem) select l_orderkey, l_linenumber, u as unit, (u >> 31) & 1 as si,
  case when (u >> 31) & 1 = 1 then (u >> 24) & 7 else 0 end as sr, case when (u >> 31) & 1 = 1 then (u >> 18) & 7 else 0 end as m, case when (u >> 31) & 1 = 1 then (u >> 8) & 255 else 0 end as mod,
  case when (u >> 31) & 1 = 0 then u & 65535 else 0 end as length, case when (u >> 31) & 1 = 0 then (u >> 24) & 31 else 0 end as type, case when (u >> 31) & 1 = 0 then (u >> 29) & 3 else 0 end as multi from u""")
def unit_decode(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_U.replace("2654435761", "2654435761L").replace("40503", "40503L").replace("4294967296", "4294967296L")).alias("unit"))
    d = li.withColumn("d", units.decode_unit(F.col("unit")))
    return d.select("l_orderkey", "l_linenumber", "unit", *[F.col(f"d.{c}").cast("long").alias(c) for c in ("si", "sr", "m", "mod", "length", "type", "multi")])


@query("""select l_orderkey, l_linenumber, ((l_linenumber & 3)::bigint << 29) | ((l_suppkey & 31) << 24) | ((l_partkey & 255) << 16) | (l_orderkey & 65535) as digital,
  (1::bigint << 31) | ((l_suppkey & 7) << 24) | ((l_linenumber & 7)::bigint << 18) | ((l_partkey & 7) << 12) | ((l_orderkey & 255) << 8) as si from lineitem""")
def unit_encode(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        units.encode_digital(multi=c("l_linenumber"), type=c("l_suppkey"), subtype=c("l_partkey"), length=c("l_orderkey")).alias("digital"),
        units.encode_si(sr=c("l_suppkey"), m=c("l_linenumber"), s=c("l_partkey"), mod=c("l_orderkey")).alias("si"),
    )


@query(f"with {TELE_SQL} select event_id, round(value::float::double, 4) as speed, round((k * 0.5::double)::float::double, 4) as heading, event_id as id, 32 as size from tele")
def mv_codec(spark, sf_dir):
    t = telemetry(spark, sf_dir).select("event_id", F.col("value").alias("speed"), (F.col("k") * 0.5).alias("heading"), F.lit(0.0).alias("yaw_rate"), F.lit(1.5).alias("accel"), F.col("event_id").alias("id"))
    out = codec.round_trip(t)
    return out.select("event_id", r(F.col("back.speed")).alias("speed"), r(F.col("back.heading")).alias("heading"), F.col("back.id").cast("long").alias("id"), F.length("blob").alias("size"))


@query(f"with {TELE_SQL} select run_id, 4 + run_id % 9 as unit, seq as pos, k as dev, epoch_us(t) as t, run_id as signature, case when event_type = 'view' then null else value end as value, case when event_type = 'view' then value end as speed from tele")
def log_parse(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    value = F.col("value").cast("string")
    body = F.when(F.col("event_type") == "view", F.concat(F.lit("={[{id=1,speed="), value, F.lit("},\n\t]}"))).otherwise(F.concat(F.lit("={"), value, F.lit("}")))
    us = F.unix_micros(F.col("t").cast("timestamp")).cast("string")
    line = F.concat(F.lit("(u={x}=>"), (4 + F.col("run_id") % 9).cast("string"), F.lit(",d="), F.col("k").cast("string"), F.lit(",t="), us, F.lit(",sig="), F.col("run_id").cast("string"), F.lit(")"), body)
    # One log per run: its lines in order.
    logs = t.groupBy("run_id").agg(F.concat(F.lit("noise\nLog Start:\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n")).alias("text"))
    e = text.log_entries(logs)
    return e.select("run_id", "unit", F.col("pos").cast("long").alias("pos"), F.col("dev").cast("long").alias("dev"), "t", "signature", "value", F.col("value_mv")[0]["speed"].alias("speed"))


@query(f"with {TELE_SQL} select event_id, k as a, event_type as b from tele")
def json_repair(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    raw = F.concat(F.lit("{a="), F.col("k").cast("string"), F.lit(",b='"), F.col("event_type"), F.lit("'}"))
    j = F.from_json(text.repaired_json(raw), "a bigint, b string")
    return t.select("event_id", j["a"].alias("a"), j["b"].alias("b"))


_A = "6378137.0::double"
_E = "6.6943799901413165e-3::double"


@query(f"""with {TELE_SQL}, p as (select event_id, radians(trunc((value / 10)::double * 1e8) / 1e8) as lat, radians(trunc((k * 1.25::double) * 1e8) / 1e8) as lon, trunc(run_id * 0.5::double * 1e3) / 1e3 as alt from tele),
  n as (select *, {_A} / sqrt(1 - {_E} * sin(lat) * sin(lat)) as n from p)
  select event_id, round((n + alt) * cos(lat) * cos(lon), 3) as x, round((n + alt) * cos(lat) * sin(lon), 3) as y, round((n * (1 - {_E}) + alt) * sin(lat), 3) as z from n""")
def ecef(spark, sf_dir):
    p = geo.ecef(F.col("value") / 10, F.col("k") * 1.25, F.col("run_id") * 0.5)
    return telemetry(spark, sf_dir).withColumn("p", p).select("event_id", *[r(F.col(f"p.{c}"), 3).alias(c) for c in "xyz"])


# Aggregates


def _label_votes(spark, sf_dir):
    t = telemetry(spark, sf_dir).withColumn("win", F.floor(F.col("seq") / 30)).withColumn("p", labels.context_price(F.col("context")))
    return t.groupBy("run_id", "win", "context").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("p").alias("p"))


_VOTES = f"{TELE_SQL}, v as (select run_id, cast(seq // 30 as bigint) as win, context, count(*) as n, min(seq) as first, max({PRICE2}) as p from tele group by all)"


@query(f"with {_VOTES} select run_id, win, arg_max(context, (n, -first)) as label from v group by run_id, win")
def majority_label(spark, sf_dir):
    return _label_votes(spark, sf_dir).groupBy("run_id", "win").agg(F.max_by("context", F.struct("n", -F.col("first"))).alias("label"))


@query(f"with {_VOTES} select run_id, win, arg_max(context, (p, -first)) as label from v group by run_id, win")
def expensive_label(spark, sf_dir):
    return _label_votes(spark, sf_dir).groupBy("run_id", "win").agg(F.max_by("context", F.struct("p", -F.col("first"))).alias("label"))


@query(f"with {_VOTES} select run_id, win, arg_max(context, (n, p, -first)) as label from v group by run_id, win")
def majority_expensive(spark, sf_dir):
    return _label_votes(spark, sf_dir).groupBy("run_id", "win").agg(F.max_by("context", F.struct("n", "p", -F.col("first"))).alias("label"))


def truth(spark, sf_dir) -> DataFrame:
    """Mean price of each whole window."""
    t = telemetry(spark, sf_dir).select("run_id", "seq", "value", labels.context_price(F.col("context")).alias("price"))
    w = t.groupBy("run_id", F.floor(F.col("seq") / 30).alias("win")).agg(F.count("*").alias("n"), F.avg("price").alias("truth"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    return w.where("n = 30").drop("n")


_TRUTH = f"{TELE_SQL}, truth as (select run_id, cast(seq // 30 as bigint) as win, avg({PRICE2}) as truth, sqrt(avg(value * value)) as rms from tele group by run_id, seq // 30 having count(*) = 30)"
_BASE = f"{_TRUTH}, base as (select *, case when rhi = rlo then 25.0::double else 1 + 49 * (rms - rlo) / nullif(rhi - rlo, 0) end as base from (select *, min(rms) over (partition by run_id) as rlo, max(rms) over (partition by run_id) as rhi from truth))"


@query(f"with {_TRUTH}, {GROUPS_SQL} select grp, run_id, win, round(truth, 6) as truth from truth {JOIN_GROUPS}")
def ground_truth_price(spark, sf_dir):
    return with_groups(truth(spark, sf_dir)).select("grp", "run_id", "win", r(F.col("truth"), 6).alias("truth"))


def baseline(spark, sf_dir) -> DataFrame:
    return truth(spark, sf_dir).withColumn("base", pricing.scaled(F.col("rms"), Window.partitionBy("run_id")))


@query(f"with {_BASE} select run_id, win, round(base, 5) as price from base")
def price_baseline(spark, sf_dir):
    return baseline(spark, sf_dir).select("run_id", "win", r(F.col("base"), 5).alias("price"))


def metrics(df: DataFrame, by: list[str], price: str = "base", true: str = "truth") -> DataFrame:
    """Pearson correlation (null for constant input), mean absolute and root mean squared error."""
    e = F.col(price) - F.col(true)
    both = F.nullif(F.stddev_pop(price) * F.stddev_pop(true), F.lit(0.0))
    return df.groupBy(*by).agg((F.covar_pop(price, true) / both).alias("pearson_corr"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


_METRICS = f"{_BASE}, {GROUPS_SQL}, m as (select grp, mass, friction, case when isnan(corr(base, truth)) then null else corr(base, truth) end as c, avg(abs(base - truth)) as mae, sqrt(avg((base - truth) * (base - truth))) as rmse from base {JOIN_GROUPS} group by grp, mass, friction)"


@query(f"with {_METRICS} select grp, round(c, 5) as pearson_corr, round(mae, 5) as mae, round(rmse, 5) as rmse from m")
def eval_metrics(spark, sf_dir):
    m = metrics(with_groups(baseline(spark, sf_dir)), ["grp"])
    return m.select("grp", *[r(F.col(c), 5).alias(c) for c in ("pearson_corr", "mae", "rmse")])


@query(f"with {_METRICS} select mass, friction, round(avg(mae), 5) as mae_mean, round(stddev_samp(mae), 5) as mae_std, round(avg(rmse), 5) as rmse_mean from m group by mass, friction")
def summary_by_group(spark, sf_dir):
    m = metrics(with_groups(baseline(spark, sf_dir)), ["grp", "mass", "friction"])
    return m.groupBy("mass", "friction").agg(r(F.avg("mae"), 5).alias("mae_mean"), r(F.stddev_samp("mae"), 5).alias("mae_std"), r(F.avg("rmse"), 5).alias("rmse_mean"))


@query(f"with {TELE_SQL} select run_id, event_type, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (partition by run_id), 4) as share from tele group by run_id, event_type")
def context_share(spark, sf_dir):
    n = telemetry(spark, sf_dir).groupBy("run_id", "event_type").agg(F.count("*").alias("n"))
    return n.withColumn("share", r(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("run_id"))))


@query(f"""with {TELE_SQL} select coalesce(event_type, 'all') as label, round(avg(value), 4) as mean, round(stddev_samp(value), 4) as std, round(stddev_pop(value), 4) as pop, min(value) as lo, max(value) as hi,
  round(quantile_cont(value, 0.25), 4) as p25, round(median(value), 4) as p50, round(quantile_cont(value, 0.95), 4) as p95 from tele group by grouping sets ((), (event_type))""")
def error_stats(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    sums = [r(F.avg("value")).alias("mean"), r(F.stddev_samp("value")).alias("std"), r(F.stddev_pop("value")).alias("pop"), F.min("value").alias("lo"), F.max("value").alias("hi")]
    shares = [0.25, 0.5, 0.95]
    stats = t.rollup("event_type").agg(*sums).select(F.coalesce("event_type", F.lit("all")).alias("label"), "mean", "std", "pop", "lo", "hi")
    each = ranks.quantiles(t, ["event_type"], "value", shares).withColumnRenamed("event_type", "label")
    every = ranks.quantiles(t, [], "value", shares).select(F.lit("all").alias("label"), "q")
    names = zip(("p25", "p50", "p95"), range(3), strict=True)
    return stats.join(each.union(every), "label").select(*stats.columns, *[r(F.col("q")[k]).alias(n) for n, k in names])


# Scaling


@query(f"with {SHIP_SQL}, m as (select min(least(quantity, price)) as lo, max(greatest(quantity, price)) as hi from ship) select run_id, seq, round((quantity - lo) / (hi - lo), 6) as quantity, round((price - lo) / (hi - lo), 6) as price from ship, m")
def global_minmax(spark, sf_dir):
    s = shipments(spark, sf_dir)
    m = s.agg(F.min(F.least("quantity", "price")).alias("lo"), F.max(F.greatest("quantity", "price")).alias("hi"))
    span = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo"))
    return s.crossJoin(F.broadcast(m)).select("run_id", "seq", *[r((F.col(c) - F.col("lo")) / span, 6).alias(c) for c in ("quantity", "price")])


@query(f"with {SHIP_SQL}, m as (select min(quantity) as lo, max(quantity) as hi from ship) select run_id, seq, round((quantity - lo) / (hi - lo), 6) as quantity from ship, m")
def column_minmax(spark, sf_dir):
    s = shipments(spark, sf_dir)
    m = s.agg(F.min("quantity").alias("lo"), F.max("quantity").alias("hi"))
    return s.crossJoin(F.broadcast(m)).select("run_id", "seq", r((F.col("quantity") - F.col("lo")) / F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo")), 6).alias("quantity"))


@query(f"with {SHIP_SQL} select run_id, seq, round((quantity - (select avg(l_quantity) from lineitem)) / (select stddev_pop(l_quantity) from lineitem), 5) as quantity from ship")
def standard_scale(spark, sf_dir):
    s = shipments(spark, sf_dir)
    m = s.agg(F.avg("quantity").alias("m"), F.stddev_pop("quantity").alias("s"))
    return s.crossJoin(F.broadcast(m)).select("run_id", "seq", r((F.col("quantity") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")), 5).alias("quantity"))


# Features


def _windows(spark, sf_dir):
    return sq.tumbling_windows(telemetry(spark, sf_dir), ["value"]).select("run_id", "win", F.col("value").alias("v"))


_WIN = f"{TELE_SQL}, w as (select run_id, cast(seq // 30 as bigint) as win, seq % 30 as i, value as x from tele where seq // 30 < (select max(s2 // 30) from (select max(seq) + 1 as s2 from tele t2)) + 1), full_w as (select run_id, win from w group by run_id, win having count(*) = 30), x as (select w.* from w join full_w using (run_id, win))"


@query(f"""with {_WIN}, m as (select run_id, win, avg(x) as m, stddev_pop(x) as s from x group by run_id, win), z as (select *, case when sign(x) <> sign(lag(x) over (partition by run_id, win order by i)) then 1 else 0 end as zc from x)
  select run_id, win, min(x) as min, max(x) as max, round(avg(x), 4) as mean, round(max(s), 4) as std, round(max(s) * max(s), 2) as var, round(avg(power((x - m) / s, 3)), 4) as skew, round(avg(power((x - m) / s, 4)), 4) as kurt,
  round(sum(x * x), 1) as energy, round(sqrt(avg(x * x)), 4) as rms, round(sum(zc) / 30.0::double, 6) as zcr, round(max(x) - min(x), 4) as ptp from z join m using (run_id, win) group by run_id, win""")
def time_features(spark, sf_dir):
    f = _windows(spark, sf_dir).select("run_id", "win", features.time_features(F.col("v")).alias("f"))
    places = {"var": 2, "energy": 1, "zcr": 6}
    return f.select("run_id", "win", *[F.col(f"f.{c}") if c in ("min", "max") else r(F.col(f"f.{c}"), places.get(c, 4)).alias(c) for c in features.TIME])


@query(f"""with {_WIN}, m as (select run_id, win, avg(x) as m, sqrt(var_samp(x)) + 1e-8 as s, sum(x * x) as e from x group by run_id, win)
  select run_id, win, min(x) as min, max(x) as max, round(avg(x), 4) as mean, round(sum(x * x), 1) as energy, round(sqrt(avg(x * x)), 4) as rms, round(var_samp(x), 2) as var, round(avg(power((x - m), 3)) / power(max(s), 3), 4) as skew, round(avg(power((x - m), 4)) / power(max(s), 4), 4) as kurt,
  round(sqrt(sum(x)) / avg(abs(x)), 5) as shape, round(max(x) / sqrt(avg(x * x)), 5) as crest, round(-sum(x * x / e * log2(x * x / e + 1e-8)), 4) as entropy from x join m using (run_id, win) group by run_id, win""")
def features_11(spark, sf_dir):
    f = _windows(spark, sf_dir).select("run_id", "win", features.shape_features(F.col("v")).alias("f"))
    places = {"var": 2, "shape": 5, "crest": 5, "energy": 1, "min": 9, "max": 9}
    return f.select("run_id", "win", *[r(F.col(f"f.{c}"), places.get(c, 4)).alias(c) for c in ("min", "max", "mean", "energy", "rms", "var", "skew", "kurt", "shape", "crest", "entropy")])


_DFT = f"{_WIN}, c as (select run_id, win, b as bin, sum(x * cos(2 * pi() / 30 * b * i)) as re, sum(x * sin(2 * pi() / 30 * b * i)) as im from x cross join range(15) t(b) group by all), mag as (select run_id, win, bin, bin / 3.0::double as f, sqrt(re * re + im * im) as m from c)"


@query(f"""with {_DFT}, t as (select run_id, win, sum(m) as s, sum(f * m) / sum(m) as c from mag group by run_id, win), run as (select *, sum(m) over (partition by run_id, win order by bin) as cum, m - lag(m) over (partition by run_id, win order by bin) as step from mag)
  select run_id, win, round(min(case when cum >= 0.95::double * s - 1e-9 then f end), 4) as rolloff, round(sum(step * step), 0) as flux, round(sum(m * m), 0) as energy, round(max(c), 4) as centroid, round(sqrt(sum((f - c) * (f - c) * m) / max(s)), 4) as spread, round(arg_max(f, (m, -bin)), 4) as dominant, round(-sum(m / s * log2(m / s + 1e-12)), 4) as entropy from run join t using (run_id, win) group by run_id, win""")
def fft_features(spark, sf_dir):
    f = _windows(spark, sf_dir).select("run_id", "win", features.fft_features("v").alias("f"))
    return f.select("run_id", "win", *[r(F.col("f")[i], 0 if c in ("flux", "energy") else 4).alias(c) for i, c in enumerate(features.FFT)])


@query()
def morlet_features(spark, sf_dir):
    return _windows(spark, sf_dir).select("run_id", "win", features.morlet_features("v").alias("f"))


@query()
def dtw_distance(spark, sf_dir):
    w = _windows(spark, sf_dir)
    first = w.where("win = 0").select("run_id", F.col("v").alias("head"))
    return w.join(first, "run_id").select("run_id", "win", r(features.dtw_distance("v", "head")).alias("d"))


# Clusters and prices


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _centroids(spark, sf_dir):
    c = cluster.mean_vectors(_vectors(spark, sf_dir), "label")
    return c.select(F.col("label").alias("centroid"), "c", (5.0 * F.col("label") + 1).alias("price"))


def _distances(spark, sf_dir):
    return cluster.with_distances(_vectors(spark, sf_dir), _centroids(spark, sf_dir)).select("vec_id", "centroid", "price", "d")


_DIST = """v as (select vec_id, cast(label as bigint) as label, i, x::double as x from (select vec_id, label, unnest(range(len(embedding))) as i, unnest(embedding) as x from embeddings)),
  c as (select label as centroid, i, avg(x) as c from v group by label, i), dist as (select vec_id, centroid, 5.0::double * centroid + 1 as price, sqrt(sum((x - c) * (x - c))) as d from v join c using (i) group by vec_id, centroid)"""


@query(f"with {_DIST} select vec_id, centroid, round(d, 6) as d from dist")
def distance_matrix(spark, sf_dir):
    return _distances(spark, sf_dir).select("vec_id", "centroid", r(F.col("d"), 6).alias("d"))


@query(f"with {_DIST} select vec_id, arg_min(price, (d, centroid)) as price from dist group by vec_id")
def nearest_centroid(spark, sf_dir):
    return pricing.price_windows(_distances(spark, sf_dir), ["vec_id"], "hard")


def _priced(name: str):
    def run(spark, sf_dir):
        return pricing.price_windows(_distances(spark, sf_dir), ["vec_id"], name).withColumn("price", r(F.col("price"), 5))

    return run


_FILTERED = "coalesce(sum(case when 1 / d >= 0.01 then price / d end) / sum(case when 1 / d >= 0.01 then 1 / d end), arg_min(price, (d, centroid)))"


@query(f"with {_DIST} select vec_id, round(sum(price / d) / sum(1 / d), 5) as price from dist group by vec_id")
def price_inverse(spark, sf_dir):
    return _priced("inverse")(spark, sf_dir)


@query(f"with {_DIST} select vec_id, round({_FILTERED}, 5) as price from dist group by vec_id")
def price_filtered(spark, sf_dir):
    return _priced("weighted_average")(spark, sf_dir)


@query(f"with {_DIST} select vec_id, round(case when 1 - list_sort(list(d))[1] / list_sort(list(d))[2] >= 0.8 then arg_min(price, (d, centroid)) else {_FILTERED} end, 5) as price from dist group by vec_id")
def price_threshold(spark, sf_dir):
    return _priced("threshold")(spark, sf_dir)


@query(f"with {_DIST} select vec_id, round(coalesce(sum(case when exp(-3 * d) >= 0.01 then price * exp(-3 * d) end) / sum(case when exp(-3 * d) >= 0.01 then exp(-3 * d) end), arg_min(price, (d, centroid))), 5) as price from dist group by vec_id")
def price_exponential(spark, sf_dir):
    return _priced("exponential")(spark, sf_dir)


@query(f"""with {_BASE}, m as (select *, greatest(1.0::double, 1 - (base - median(base) over (partition by run_id))) as t from base), s as (select *, min(t) over (partition by run_id) as a, max(t) over (partition by run_id) as b from m)
  select run_id, win, round(case when a = b then 25.0::double else 1 + 49 * (t - a) / nullif(b - a, 0) end, 4) as price from s""")
def price_stretched(spark, sf_dir):
    b = pricing.stretched(baseline(spark, sf_dir).select("run_id", "win", "base"), "base", ["run_id"])
    return b.select("run_id", "win", r(F.col("stretched")).alias("price"))


@query(f"with {_DIST}, n as (select vec_id, arg_min(centroid, (d, centroid)) as centroid from dist group by vec_id) select centroid, i, round(avg(x), 6) as c from v join n using (vec_id) group by centroid, i")
def kmeans_one_step(spark, sf_dir):
    p, c = _vectors(spark, sf_dir), _centroids(spark, sf_dir)
    joined = p.join(cluster.assign(p, c, ["vec_id"]).select("vec_id", "centroid"), "vec_id")
    return cluster.mean_vectors(joined, "centroid").select("centroid", F.posexplode("c").alias("i", "c")).select("centroid", F.col("i").cast("long").alias("i"), r(F.col("c"), 6).alias("c"))


@query()
def kmeans_seeded(spark, sf_dir):
    p = _vectors(spark, sf_dir)
    c = cluster.seeded_kmeans(p, _centroids(spark, sf_dir).select("centroid", "c"), ["vec_id"])
    return cluster.assign(p, c, ["vec_id"]).select("vec_id", "centroid", r(F.col("d")).alias("d"))


@query()
def pca_variance(spark, sf_dir):
    p = _vectors(spark, sf_dir)
    mean, top, _ = cluster.pca(p, "v", 64)
    return cluster.project(p, "v", mean, top).select("vec_id", F.transform("z", lambda x: F.round(x, 6)).alias("z"))


@query("""with v as (select label, i, x::double as x from (select label, unnest(range(len(embedding))) as i, unnest(embedding) as x from embeddings)),
  g as (select i, label, count(*) as n, avg(x) as m, var_pop(x) * count(*) as w from v group by i, label),
  t as (select i, sum(n) as n, count(*) as k, sum(n * m) as s, sum(n * m * m) as ss, sum(w) as w from g group by i)
  select cast(i as int) as i, round(((ss - s * s / n) / (k - 1)) / (w / (n - k)), 4) as f from t order by ((ss - s * s / n) / (k - 1)) / (w / (n - k)) desc, i limit 20""")
def anova_topk(spark, sf_dir):
    s = cluster.anova_scores(_vectors(spark, sf_dir), "label")
    return s.orderBy(F.desc("f"), "i").limit(20).select("i", r(F.col("f")).alias("f"))


# Splits and unions


@query(f"""with {TELE_SQL}, {GROUPS_SQL}, runs as (select distinct run_id, grp from tele {JOIN_GROUPS}), o as (select *, row_number() over (partition by grp order by cast(run_id as varchar)) as rn, count(*) over (partition by grp) as n from runs)
  select grp, run_id, case when rn <= floor(n * 0.7::double) then 'train' else 'validation' end as part from o""")
def ordered_split(spark, sf_dir):
    runs = with_groups(telemetry(spark, sf_dir).select("run_id").distinct())
    w = Window.partitionBy("grp")
    rank = F.row_number().over(w.orderBy(F.col("run_id").cast("string")))
    return runs.select("grp", "run_id", F.when(rank <= F.floor(F.count("*").over(w) * 0.7), "train").otherwise("validation").alias("part"))


@query(f"with {TELE_SQL} select run_id, seq, value, k from tele where run_id % 2 = 0 union all select run_id, seq, value, null from tele where run_id % 2 = 1")
def union_runs(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return t.where("run_id % 2 = 0").select("run_id", "seq", "value", "k").unionByName(t.where("run_id % 2 = 1").select("run_id", "seq", "value"), allowMissingColumns=True)


@query(f"with {TELE_SQL} select run_id from tele union select l_suppkey from lineitem")
def distinct_merge(spark, sf_dir):
    return telemetry(spark, sf_dir).select("run_id").union(table(spark, sf_dir, "lineitem").select("l_suppkey")).distinct()


# Anomaly signal, streams


@query()
def recon_error(spark, sf_dir):
    """Reconstruction error of the middle rows, by a linear autoencoder over the windows of all runs."""
    s = shipments(spark, sf_dir).select("run_id", "seq", "quantity", (F.col("price") / 1000).alias("price"), "discount", "tax")
    signals = ["quantity", "price", "discount", "tax"]
    parts = lineage.cut(lagged.stretches(s, signals))
    mean, top = lagged.fit(parts, len(signals))
    e = lagged.point_errors(parts, mean, top, len(signals))
    return e.select("run_id", "seq", F.transform("error", lambda x: F.round(x, 5)).alias("error"))


@query(f"with {TELE_SQL}, c as (select run_id as dev, cast(seq // 10 as bigint) as chunk, value, seq from tele) select dev, chunk, count(*) as n, min(seq) as first, max(seq) as last, round(sum(value), 4) as total from c group by dev, chunk")
def buffer_chunks(spark, sf_dir):
    t = telemetry(spark, sf_dir).select(F.col("run_id").alias("dev"), F.col("seq").alias("t"), "value")
    return buffer.chunks(t, 10).withColumn("total", r(F.col("total")))


@query(f"with {TELE_SQL} select run_id, min(epoch_us(t)) as t0, max(epoch_us(t)) as t1, arg_min(value, seq) as first, arg_max(value, seq) as last from tele group by run_id")
def series_bounds(spark, sf_dir):
    us = F.unix_micros(F.col("t").cast("timestamp"))
    return telemetry(spark, sf_dir).groupBy("run_id").agg(F.min(us).alias("t0"), F.max(us).alias("t1"), F.min_by("value", "seq").alias("first"), F.max_by("value", "seq").alias("last"))


@query(f"with {TELE_SQL} select count(*) as n, count(distinct run_id) as runs, count(distinct context) as contexts, sum(case when value is null then 1 else 0 end)::bigint as nulls, min(value) as lo, max(value) as hi, round(avg(value), 4) as mean from tele")
def profile(spark, sf_dir):
    return telemetry(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("run_id").alias("runs"), F.countDistinct("context").alias("contexts"), F.count_if(F.col("value").isNull()).alias("nulls"), F.min("value").alias("lo"), F.max("value").alias("hi"), r(F.avg("value")).alias("mean"))


# Reduction, further clustering, small reports


@query()
def reduce_hybrid(spark, sf_dir):
    p = _vectors(spark, sf_dir)
    out = reduction.fit_reducer(p, "hybrid", 64, "label", k=8, select=32).apply(p)
    return out.select("vec_id", F.transform("z", lambda x: F.round(x, 6)).alias("z"))


@query(f"with {TELE_SQL}, f as (select event_type, min(event_id) as first from tele group by event_type) select event_type, dense_rank() over (order by first) - 1 as code from f")
def factorize(spark, sf_dir):
    f = telemetry(spark, sf_dir).groupBy("event_type").agg(F.min("event_id").alias("first"))
    # One row per label.
    return f.select("event_type", (F.dense_rank().over(Window.orderBy("first")) - 1).cast("long").alias("code"))


@query(f"""with {TELE_SQL}, n as (select coalesce(nullif(context, 'road'), 'road') as context, count(*) as n from tele group by 1), m as (select *, max(n) over () as top from n)
  select context, case when context in ('crash', 'road') then greatest(2.0::double, least(6.0::double, n * 4.0::double / top + 2)) else greatest(1.0::double, least(3.0::double, n * 2.0::double / top)) end as width,
  case when context = 'crash' then 1 when context = 'road' then 2 else 0 end as place from m""")
def layout_widths(spark, sf_dir):
    n = telemetry(spark, sf_dir).groupBy("context").agg(F.count("*").alias("n"))
    top = F.max("n").over(Window.partitionBy())
    wide = F.greatest(F.lit(2.0), F.least(F.lit(6.0), F.col("n") * 4.0 / top + 2))
    slim = F.greatest(F.lit(1.0), F.least(F.lit(3.0), F.col("n") * 2.0 / top))
    place = F.when(F.col("context") == "crash", 1).when(F.col("context") == "road", 2).otherwise(0)
    return n.select("context", F.when(F.col("context").isin("crash", "road"), wide).otherwise(slim).alias("width"), place.alias("place"))


@query(f"with {SHIP_SQL} select run_id, seq, round(quantity - (quantity + discount + tax) / 3, 6) as quantity, round(discount - (quantity + discount + tax) / 3, 6) as discount from ship")
def dc_removed(spark, sf_dir):
    """Each signal less the mean of all signals at that time."""
    s = shipments(spark, sf_dir)
    mean = (F.col("quantity") + F.col("discount") + F.col("tax")) / 3
    return s.select("run_id", "seq", r(F.col("quantity") - mean, 6).alias("quantity"), r(F.col("discount") - mean, 6).alias("discount"))
