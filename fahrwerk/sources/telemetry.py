"""The test tables seen as telemetry: ordered runs, signals, context labels, map features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_window(*order: str) -> Window:
    return Window.partitionBy("run_id").orderBy(*(order or ("seq",)))


def event_context() -> Column:
    """A context label from an event's type and number."""
    k = F.col("k")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (
        F.when(F.col("event_type") == "view", "road")
        .when(F.col("event_type") == "click", text("pothole_small_2.56_", (k % 3 + 1).cast("string")))
        .when(F.col("event_type") == "signup", text(F.when(k % 2 == 0, "ramp_asc_").otherwise("ramp_desc_"), (k % 10).cast("string"), ".0_1.0_1"))
        .when(F.col("event_type") == "purchase", "speedbump_raised_2.0_1")
        .when(k % 4 == 0, "crash")
        .when(k % 4 == 1, "ramp_two_way_5.0_1.0_1")
        .when(k % 4 == 2, "cut__0.1_1")
        .otherwise("elevated_crosswalk__2.0_1")
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: run_id, seq, t, value, k, event_type, context."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    e = e.withColumn("k", F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("long"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("seq", (F.row_number().over(w) - 1).cast("long")).withColumn("context", event_context())
    return e.select(F.col("user_id").alias("run_id"), "seq", "event_id", F.col("ts").alias("t"), "value", "k", "event_type", "context")


#: The same in DuckDB, as a CTE named tele.
TELE_SQL = """tele as (select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) - 1 as seq, event_id, ts as t, value, k, event_type,
  case when event_type = 'view' then 'road' when event_type = 'click' then 'pothole_small_2.56_' || (k % 3 + 1)
    when event_type = 'signup' then (case when k % 2 = 0 then 'ramp_asc_' else 'ramp_desc_' end) || (k % 10) || '.0_1.0_1'
    when event_type = 'purchase' then 'speedbump_raised_2.0_1' when k % 4 = 0 then 'crash' when k % 4 = 1 then 'ramp_two_way_5.0_1.0_1'
    when k % 4 = 2 then 'cut__0.1_1' else 'elevated_crosswalk__2.0_1' end as context
  from (select *, cast(regexp_extract(props, '"k":\\s*(\\d+)', 1) as bigint) as k from events))"""


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as runs of four signals: run_id (supplier), seq, quantity, price, discount, tax."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    return li.select(
        F.col("l_suppkey").alias("run_id"),
        (F.row_number().over(w) - 1).cast("long").alias("seq"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


SHIP_SQL = """ship as (select l_suppkey as run_id, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber) - 1 as seq,
  l_quantity as quantity, l_extendedprice as price, l_discount as discount, l_tax as tax from lineitem)"""


def map_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as map features: every fifth one a ramp (a segment), the others points of four kinds."""
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("ramp", "pothole", "speedbump", "elevated_crosswalk", "cut")]), (F.col("p_size") % 5 + 1).cast("int"))
    x = F.round(F.pmod(F.col("p_partkey") * 7.3, F.lit(490.0)), 3)
    y = (F.col("p_size") * 2).cast("double")
    long = F.when(F.col("p_size") % 5 == 0, 12.0).otherwise(0.0)
    return p.select(
        (F.col("p_size") % 5).cast("int").alias("type_rank"), F.col("p_partkey").alias("list_idx"), kind.alias("ftype"),
        x.alias("ax"), y.alias("ay"), F.lit(0.0).alias("az"), (x + long).alias("bx"), y.alias("by"), F.lit(0.0).alias("bz"),
    )


FEAT_SQL = """feat as (select cast(p_size % 5 as int) as type_rank, p_partkey as list_idx, ['ramp', 'pothole', 'speedbump', 'elevated_crosswalk', 'cut'][p_size % 5 + 1] as ftype,
  round((p_partkey * 7.3::double) % 490.0::double, 3) as ax, cast(p_size * 2 as double) as ay, 0.0::double as az,
  round((p_partkey * 7.3::double) % 490.0::double, 3) + (case when p_size % 5 = 0 then 12.0::double else 0.0::double end) as bx, cast(p_size * 2 as double) as "by", 0.0::double as bz from part)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log entries: views are the ego vehicle, errors an SI sensor, clicks and purchases lists of vectors, signups other road users."""
    e = telemetry(spark, sf_dir)
    kind = lambda *x: F.element_at(F.create_map(*[F.lit(v) for v in x]), F.col("event_type"))
    k = F.col("k")
    vector = lambda n: F.struct((F.col("event_id") + n).alias("id"), (k % 256).cast("int").alias("class"), F.floor(F.col("value") * 1e7).alias("lat"), (k * 125000000).alias("lon"), (F.col("run_id") * 500 + n).alias("alt"), F.col("value").alias("speed"), (k * 0.5).alias("heading"), F.lit(0.25).alias("yawr"), (k * 0.125 + n).alias("accel"))
    dev = kind("view", 16, "error", 0, "click", 19, "purchase", 20, "signup", 26).cast("long")
    unit = F.when(dev == 0, F.lit((1 << 31) | (1 << 18)).cast("long")).when(dev.isin(19, 20), F.lit(1 << 29).cast("long")).otherwise(F.lit(0).cast("long"))
    vectors = F.when(dev == 0, F.lit(None)).when(dev.isin(19, 20), F.array(vector(0), vector(1))).otherwise(F.array(vector(0)))
    return e.select("run_id", F.col("seq").alias("pos"), "event_id", dev.alias("dev"), unit.alias("unit"), (F.col("seq") * 100000).alias("t"), F.when(dev == 0, F.col("value")).alias("value"), vectors.alias("value_mv"))


#: The same in DuckDB, one row for each vector (SI entries have one, of nulls), as CTEs named ent and vec.
ENTRIES_SQL = TELE_SQL + """, ent as (select run_id, seq as pos, event_id, seq * 100000 as t, value, k, case event_type when 'view' then 16 when 'error' then 0 when 'click' then 19 when 'purchase' then 20 else 26 end as dev from tele),
  vec as (select ent.*, n as item, event_id + n as id, k % 256 as class, floor(value * 1e7::double) / 1e8::double as lat, k * 1.25::double as lon, (run_id * 500 + n) / 1e3::double as alt, value as speed, k * 0.5::double as heading, 0.25::double as yawr, k * 0.125::double + n as accel
    from ent join range(2) r(n) on n = 0 or dev in (19, 20) where dev <> 0)"""


def ecef_sql(lat: str, lon: str, alt: str, axis: str) -> str:
    """Earth-centred coordinate as SQL text; angles in radians."""
    n = f"(6378137.0::double / sqrt(1 - 6.6943799901413165e-3::double * sin({lat}) * sin({lat})))"
    return {"x": f"({n} + {alt}) * cos({lat}) * cos({lon})", "y": f"({n} + {alt}) * cos({lat}) * sin({lon})", "z": f"({n} * (1 - 6.6943799901413165e-3::double) + {alt}) * sin({lat})"}[axis]
