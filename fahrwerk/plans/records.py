"""Registered queries over log entries: records of the ego vehicle, of sensors, of other road users."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec, geo, units
from ..operators import joins, records
from ..sources.telemetry import ENTRIES_SQL, TELE_SQL, ecef_sql, entries, telemetry
from .base import query, r

_BY = ["run_id"]


def _egos(spark, sf_dir, **how):
    return records.ego_entries(entries(spark, sf_dir), _BY, **how)


def _decoded(df, *columns: str):
    """The motion in a record's blob, beside other columns."""
    d = df.withColumn("d", codec.decode_motion(F.unbase64("value")))
    return d.select(*columns, "unit", *[r(F.col(f"d.{c}")).alias(c) for c in ("speed", "heading", "yaw_rate", "accel")], F.col("d.id").cast("long").alias("id"))


def _xyz(lat: str, lon: str, alt: str = "alt", places: int = 3) -> str:
    return ", ".join(f"round({ecef_sql(lat, lon, alt, a)}, {places}) as {a}" for a in "xyz")


@query(f"with {ENTRIES_SQL} select run_id, pos, first_value(t) over (partition by run_id order by pos) + (row_number() over (partition by run_id order by pos) - 1) * 50000 as t, {_xyz('radians(lat)', 'radians(lon)')} from vec where dev = 16")
def ego_positions(spark, sf_dir):
    return _egos(spark, sf_dir, step=50000).select("run_id", "pos", "t", *[r(F.col(c), 3).alias(c) for c in "xyz"])


@query(f"with {ENTRIES_SQL} select run_id, pos, {_xyz('radians(lon)', 'radians(lat)')} from vec where dev = 16")
def ego_positions_swapped(spark, sf_dir):
    return _egos(spark, sf_dir, swapped=True).select("run_id", "pos", *[r(F.col(c), 3).alias(c) for c in "xyz"])


def _walk_sql(rows: str) -> str:
    """The pointer walk as a recursive CTE named walk (run_id, rid, p), over CTEs egos (run_id, t, i) and rows (run_id, rid, t)."""
    move = "case when a.t < x.t and b.t > x.t then 1 else 0 end"
    return f"""egos as (select run_id, t, row_number() over (partition by run_id order by t) - 1 as i, pos from ent where dev = 16),
      rws as (select *, row_number() over (partition by run_id order by t, rid) - 1 as n from ({rows})),
      first_p as (select x.run_id, x.rid, x.t, coalesce(max(e.i), 0) as p from rws x left join egos e on e.run_id = x.run_id and e.t < x.t where n = 0 group by all),
      walk as (select x.run_id, x.rid, 0 as n, x.p + {move} as p from first_p x left join egos a on a.run_id = x.run_id and a.i = x.p left join egos b on b.run_id = x.run_id and b.i = x.p + 1
        union all select x.run_id, x.rid, x.n, w.p + {move} from walk w join rws x on x.run_id = w.run_id and x.n = w.n + 1 left join egos a on a.run_id = x.run_id and a.i = w.p left join egos b on b.run_id = x.run_id and b.i = w.p + 1)"""


@query(f"with recursive {ENTRIES_SQL}, {_walk_sql('select run_id, event_id as rid, t from ent where dev = 0')} select x.run_id, x.rid, x.t, e.t as ego from walk w join rws x on x.run_id = w.run_id and x.n = w.n left join egos e on e.run_id = w.run_id and e.i = w.p")
def asof_sequential(spark, sf_dir):
    e = entries(spark, sf_dir)
    return joins.asof_sequential(e.where("dev = 0").select("run_id", F.col("event_id").alias("rid"), "t"), e.where("dev = 16").select("run_id", "t"), "run_id")


@query(f"""with recursive {ENTRIES_SQL}, {_walk_sql('select run_id, pos as rid, t from ent where dev = 0')}
  select w.run_id, w.rid as pos, s.value, {', '.join(f"round({ecef_sql('radians(v.lat)', 'radians(v.lon)', 'v.alt', a)}, 3) as {a}" for a in 'xyz')}
  from walk w join ent s on s.run_id = w.run_id and s.pos = w.rid left join egos e on e.run_id = w.run_id and e.i = w.p left join vec v on v.run_id = e.run_id and v.pos = e.pos and v.dev = 16""")
def si_records(spark, sf_dir):
    e = entries(spark, sf_dir)
    return records.si_records(e, _egos(spark, sf_dir), _BY).select("run_id", "pos", "value", *[r(F.col(c), 3).alias(c) for c in "xyz"])


_STEPPED = "first_value(t) over (partition by run_id order by t, pos) + (row_number() over (partition by run_id order by t, pos) - 1) * 50000 as t"


@query(f"""with recursive {ENTRIES_SQL}, {_walk_sql(f'select run_id, pos as rid, {_STEPPED} from ent where dev = 0')}
  select w.run_id, w.rid as pos, x.t, 1000 + w.run_id as signature, s.value, {', '.join(f"round({ecef_sql('radians(v.lat)', 'radians(v.lon)', 'v.alt', a)}, 3) as {a}" for a in 'xyz')}
  from walk w join rws x on x.run_id = w.run_id and x.n = w.n join ent s on s.run_id = w.run_id and s.pos = w.rid left join egos e on e.run_id = w.run_id and e.i = w.p left join vec v on v.run_id = e.run_id and v.pos = e.pos and v.dev = 16""")
def si_records_signed(spark, sf_dir):
    """Sensor records at fixed time steps, under a signature of their run."""
    e = records.si_records(entries(spark, sf_dir), _egos(spark, sf_dir), _BY, step=50000, signature=1000 + F.col("run_id"))
    return e.select("run_id", "pos", "t", "signature", "value", *[r(F.col(c), 3).alias(c) for c in "xyz"])


_UNIT = "(1::bigint << 29) | (class::bigint << 16) | 1 as unit"


def _motion_sql(dev: int) -> str:
    """Vectors of a list device with the pointer's ego vector."""
    add = lambda c: f"v.{c} + g.{c}" if dev == 20 else f"v.{c}"
    move = ", ".join(f"round(({add(c)})::float::double, 4) as {n}" for c, n in (("speed", "speed"), ("heading", "heading"), ("yawr", "yaw_rate"), ("accel", "accel")))
    ego = {a: ecef_sql("radians(g.lat)", "radians(g.lon)", "g.alt", a) if dev == 20 else "0" for a in "xyz"}
    place = ", ".join(f"cast(trunc(trunc({ecef_sql('v.lat', 'v.lon', 'v.alt', a)}) + {ego[a]}) as bigint) as {a}" for a in "xyz")
    return f"""with recursive {ENTRIES_SQL}, {_walk_sql(f'select run_id, pos as rid, t from ent where dev = {dev}')}
      select v.run_id, v.pos, v.item::int as item, v.t, {_UNIT.replace('class', 'v.class')}, {move}, v.id, {place}
      from walk w join vec v on v.run_id = w.run_id and v.pos = w.rid left join egos e on e.run_id = w.run_id and e.i = w.p left join vec g on g.run_id = e.run_id and g.pos = e.pos and g.dev = 16"""


@query(_motion_sql(19))
def motion_records(spark, sf_dir):
    e = entries(spark, sf_dir).where("dev in (16, 19)")
    return _decoded(records.motion_records(e, _egos(spark, sf_dir), _BY), "run_id", "pos", "item", "t", "x", "y", "z")


@query(f"""with recursive {ENTRIES_SQL}, {_walk_sql(f'select run_id, pos as rid, {_STEPPED} from ent where dev = 20')}
  select v.run_id, v.pos, v.item::int as item, x.t, 1000 + v.run_id as signature, v.id, round((v.speed + g.speed)::float::double, 4) as speed
  from walk w join rws x on x.run_id = w.run_id and x.n = w.n join vec v on v.run_id = w.run_id and v.pos = w.rid left join egos e on e.run_id = w.run_id and e.i = w.p left join vec g on g.run_id = e.run_id and g.pos = e.pos and g.dev = 16""")
def motion_records_signed(spark, sf_dir):
    """Vectors of a relative device at fixed time steps, under a signature of their run."""
    e = entries(spark, sf_dir).where("dev in (16, 20)")
    m = records.motion_records(e, _egos(spark, sf_dir), _BY, step=50000, signature=1000 + F.col("run_id"))
    return _decoded(m, "run_id", "pos", "item", "t", "signature").select("run_id", "pos", "item", "t", "signature", "id", "speed")


@query(_motion_sql(20))
def relative_records(spark, sf_dir):
    e = entries(spark, sf_dir).where("dev in (16, 20)")
    return _decoded(records.motion_records(e, _egos(spark, sf_dir), _BY), "run_id", "pos", "item", "t", "x", "y", "z")


_MOVES = ", ".join(f"round({c}::float::double, 4) as {n}" for c, n in (("speed", "speed"), ("heading", "heading"), ("yawr", "yaw_rate"), ("accel", "accel")))


@query(f"with {ENTRIES_SQL} select run_id, pos, {_UNIT}, {_MOVES}, id from vec where dev = 16")
def ego_records(spark, sf_dir):
    return _decoded(records.ego_records(_egos(spark, sf_dir), _BY), "run_id", "pos")


@query(f"with {ENTRIES_SQL} select run_id, pos, id as signature, {_UNIT}, {_MOVES}, id, {_xyz('radians(lat)', 'radians(lon)')} from vec where dev = 26")
def etsi_records(spark, sf_dir):
    return _decoded(records.etsi_records(entries(spark, sf_dir), _BY), "run_id", "pos", "signature", *[r(F.col(c), 3).alias(c) for c in "xyz"])


@query(f"with {ENTRIES_SQL} select case when dev = 0 then 'si' when dev in (19, 20) then 'multi' else 'other' end as kind, dev, count(*) as n from ent group by all")
def unit_kinds(spark, sf_dir):
    u = F.col("unit")
    kind = F.when(units.bits(u, 31, 1) == 1, "si").when(units.is_multi(u), "multi").otherwise("other")
    return entries(spark, sf_dir).groupBy(kind.alias("kind"), "dev").agg(F.count("*").alias("n"))


@query(f"with {ENTRIES_SQL} select event_id, 2 as version, t, dev, run_id as signature, value, 0.0::double as error from ent where dev = 0")
def record_json(spark, sf_dir):
    e = entries(spark, sf_dir).where("dev = 0").withColumn("version", F.lit(records.MOBILE)).withColumn("signature", F.col("run_id"))
    back = e.withColumn("value", F.col("value").cast("string")).withColumn("d", records.from_json(records.as_json(e)))
    return back.select("event_id", *[F.col(f"d.{c}").alias(c) for c in ("version", "t", "dev", "signature")], F.col("d.value").cast("double").alias("value"), "d.error")


@query(f"with {TELE_SQL} select event_id, round(value / 10, 6) as lat, round(k * 1.25::double, 6) as lon, round(run_id * 0.5::double, 3) as alt from tele where k * 1.25 <= 180")
def ecef_inverse(spark, sf_dir):
    t = telemetry(spark, sf_dir).where(F.col("k") * 1.25 <= 180)
    p = geo.ecef(F.col("value") / 10, F.col("k") * 1.25, F.col("run_id") * 0.5, cut=False)
    back = t.select("event_id", p.alias("p")).select("event_id", geo.geodetic(F.col("p.x"), F.col("p.y"), F.col("p.z")).alias("g"))
    return back.select("event_id", r(F.col("g.lat"), 6).alias("lat"), r(F.col("g.lon"), 6).alias("lon"), r(F.col("g.alt"), 3).alias("alt"))
