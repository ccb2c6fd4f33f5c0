"""From log entries to store records: positions, fixed time steps, one record for each motion vector.

Entries have dev, unit, pos, t, value_mv (array of vectors) and the columns
named in ``by``, which tell one log from another.  Each step is a plan over
whole tables; order inside a device is (t, pos).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec, geo, units
from ..model import EGO_DEVICE, ETSI_DEVICES, RELATIVE_DEVICES
from .joins import asof_pointer

#: A record's fields, in order.
RECORD = "version int, unit long, value string, error double, confidence double, x double, y double, z double, t long, signature long, dev long"
MOBILE = 2
_MOTION = ["speed", "heading", "yawr", "accel"]


def position(vector: Column, radians: bool = False, swapped: bool = False) -> Column:
    """Earth-centred position of a motion vector, whose angles are 1e-8 degree and whose height is mm.

    ``radians`` takes degrees for radians and ``swapped`` takes latitude for
    longitude, for stores that were filled that way.
    """
    lat, lon, alt = vector["lat"] / F.lit(1e8), vector["lon"] / F.lit(1e8), vector["alt"] / F.lit(1e3)
    return geo.ecef(lon if swapped else lat, lat if swapped else lon, alt, radians=radians, cut=False)


def stepped(entries: DataFrame, by: list[str], step: int | None) -> DataFrame:
    """Times of a device at equal steps from its first; None leaves them."""
    if step is None:
        return entries
    w = Window.partitionBy(*by, "dev").orderBy("t", "pos")
    return entries.withColumn("t", F.first("t").over(w) + (F.row_number().over(w) - 1) * F.lit(step))


def _signed(df: DataFrame, signature: Column | int | None) -> Column:
    """The signature that records bear: the given one, else their entry's, else 0."""
    if signature is not None:
        return (signature if isinstance(signature, Column) else F.lit(signature)).cast("long")
    return F.col("signature").cast("long") if "signature" in df.columns else F.lit(0).cast("long")


def ego_entries(entries: DataFrame, by: list[str], step: int | None = None, swapped: bool = False) -> DataFrame:
    """The ego vehicle's entries with position and motion."""
    e = stepped(entries.where(F.col("dev") == EGO_DEVICE), by, step)
    first = F.col("value_mv")[0]
    p = position(first, swapped=swapped)
    return e.select(*by, "pos", "t", *[p[c].alias(c) for c in "xyz"], *[first[c].alias(c) for c in _MOTION], first["id"].alias("id"), first["class"].alias("class"), _signed(e, None).alias("signature"))


def _with_ego(entries: DataFrame, egos: DataFrame, by: list[str]) -> DataFrame:
    """Each entry with the ego entry of the pointer walk."""
    return asof_pointer(entries, egos, [*by, "dev"], by, ["x", "y", "z", *_MOTION])


def si_records(entries: DataFrame, egos: DataFrame, by: list[str], step: int | None = None, signature: Column | int | None = None) -> DataFrame:
    """Entries of SI units at the ego vehicle's position, with the signature of their sender."""
    e = stepped(entries.where((units.bits(F.col("unit"), 31, 1) == 1) & (F.col("dev") != EGO_DEVICE)), by, step)
    e = e.select(*by, "dev", "pos", "t", "unit", "value", _signed(e, signature).alias("signature"))
    return _with_ego(e, egos, by).select(*by, "dev", "pos", "t", "unit", "value", "signature", "x", "y", "z")


def _blob(vector: dict[str, Column], ident: Column) -> Column:
    return F.base64(codec.encode_motion(*[vector[c].cast("double") for c in _MOTION], ident))


def motion_unit(vector: Column) -> Column:
    """The unit of a single motion vector of its class."""
    return units.encode_digital(length=F.lit(1), subtype=vector["class"], type=F.lit(0), multi=F.lit(1))


def motion_records(entries: DataFrame, egos: DataFrame, by: list[str], step: int | None = None, signature: Column | int | None = None) -> DataFrame:
    """One record for each vector of lists; relative devices add the ego vehicle's motion and position.  Positions are whole metres."""
    e = entries.where(units.is_multi(F.col("unit")) & ~F.col("dev").isin(EGO_DEVICE, *ETSI_DEVICES))
    e = stepped(e, by, step)
    e = _with_ego(e.select(*by, "dev", "pos", "t", "value_mv", _signed(e, signature).alias("signature")), egos, by)
    e = e.select("*", F.posexplode("value_mv").alias("item", "v"))
    relative = F.col("dev").isin(*RELATIVE_DEVICES)
    own, ego = ({c: F.col(f"v.{c}") for c in _MOTION}, {c: F.col(c) for c in _MOTION})
    moved = codec.relative_motion(own, ego)
    motion = {c: F.when(relative, moved[c]).otherwise(own[c]) for c in _MOTION}
    p = position(F.col("v"), radians=True)
    whole = [(p[c].cast("long") + F.when(relative, F.col(c)).otherwise(0.0)).cast("long").alias(c) for c in "xyz"]
    return e.select(*by, "dev", "pos", "item", "t", motion_unit(F.col("v")).alias("unit"), "signature", _blob(motion, F.col("v.id")).alias("value"), *whole)


def ego_records(egos: DataFrame, by: list[str]) -> DataFrame:
    """The ego vehicle's first vector as a blob, in the unit of its class."""
    v = F.struct(*[F.col(c) for c in (*_MOTION, "id", "class")])
    return egos.select(*by, "pos", "t", motion_unit(v).alias("unit"), "signature", _blob({c: F.col(c) for c in _MOTION}, F.col("id")).alias("value"), "x", "y", "z")


def etsi_records(entries: DataFrame, by: list[str], step: int | None = None) -> DataFrame:
    """Road users that report themselves: their id is the signature, their own position the place."""
    e = stepped(entries.where(F.col("dev").isin(*ETSI_DEVICES)), by, step)
    v = F.col("value_mv")[0]
    p = position(v)
    return e.select(*by, "dev", "pos", "t", motion_unit(v).alias("unit"), v["id"].alias("signature"), _blob({c: v[c] for c in _MOTION}, v["id"]).alias("value"), *[p[c].alias(c) for c in "xyz"])


def for_store(records: DataFrame, version: int = MOBILE, dev: int = EGO_DEVICE) -> DataFrame:
    """Records with all fields of the store, in order: what is missing is 0, a missing device ``dev``."""
    given = {"version": F.lit(version), "dev": F.lit(dev)}
    fields = [f.split() for f in RECORD.split(", ")]
    return records.select(*[(F.col(n) if n in records.columns else given.get(n, F.lit(0))).cast(t).alias(n) for n, t in fields])


def as_json(records: DataFrame) -> Column:
    """A record as JSON text, with 0 for the fields that are missing."""
    fields = [f.split() for f in RECORD.split(", ")]
    return F.to_json(F.struct(*[(F.col(n) if n in records.columns else F.lit(0)).cast(t).alias(n) for n, t in fields]))


def from_json(text: Column) -> Column:
    """A record from JSON text; fields that are missing are null."""
    return F.from_json(text, RECORD)
