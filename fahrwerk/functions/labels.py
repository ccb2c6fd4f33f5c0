"""Context labels: prices, generic and coarse names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prices by the kind of road feature that a label names.
FEATURE_PRICES = [("pothole", 15.0), ("speedbump", 8.0), ("elevated_crosswalk", 5.0), ("cut", 3.0)]
CRASH_PRICE = 50.0
OTHER_PRICE = 3.0


def context_price(label: Column, crash: bool = True) -> Column:
    """Price of a context label; ``crash`` adds the rule for crashes (second rule set)."""
    low = F.lower(label)
    parts = F.split(low, "_")
    way = F.get(parts, F.lit(1))
    slope = F.get(parts, F.lit(2)).try_cast("double")
    ramp = low.contains("ramp")
    out = F.when(label.isNull(), 1.0).when(low.contains("road"), 1.0)
    out = out.when(ramp & slope.isNull(), OTHER_PRICE)
    out = out.when(ramp & way.contains("asc"), 2.0 + 1.5 * slope)
    out = out.when(ramp & way.contains("desc"), F.greatest(F.lit(1.0), 2.0 - slope))
    if crash:
        out = out.when(low.contains("crash"), CRASH_PRICE)
    for kind, price in FEATURE_PRICES:
        out = out.when(low.contains(kind), price)
    return out.otherwise(OTHER_PRICE)


def generic_context(label: Column) -> Column:
    """The label without its trailing number."""
    return F.coalesce(F.regexp_replace(label, r"_\d+$", ""), F.lit("unknown"))


def coarse_context(label: Column) -> Column:
    """Ramps by direction, other features by kind."""
    ramp = F.concat(F.lit("ramp_"), F.get(F.split(label, "_"), F.lit(1)))
    out = F.when(label == "road", "road").when(label.startswith("ramp_"), ramp).when(label == "crash", "crash")
    for kind, _ in FEATURE_PRICES:
        out = out.when(label.startswith(kind), kind)
    return out.otherwise("unknown")


def run_name(run: Column, mass: Column, friction: Column) -> Column:
    """The name of a run's file, without its ending: mass as a whole number."""
    return F.concat(F.lit("simulation_"), run.cast("string"), F.lit("_mass_"), mass.cast("long").cast("string"), F.lit("_friction_"), friction.cast("double").cast("string"))


def split_id(name: Column) -> Column:
    """The run's number, second part of its file's name."""
    return F.get(F.split(name, "_"), F.lit(1)).try_cast("int")


def index_time(index: Column) -> Column:
    """A whole number as nanoseconds since 1970, as far as a time holds them: to the microsecond below."""
    return F.timestamp_micros(F.floor(index / 1000).cast("long"))


def index_nanos(index: Column) -> Column:
    """The nanoseconds of such a number that lie beyond the microsecond."""
    return F.pmod(index, F.lit(1000)).cast("int")
