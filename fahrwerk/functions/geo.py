"""Positions and distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The WGS84 ellipsoid.
AXIS = 6378137.0
ECC2 = 6.6943799901413165e-3


def truncated(x: Column, scale: float) -> Column:
    """Cut toward zero to a multiple of 1 / scale."""
    return (x * scale).cast("long") / F.lit(scale)


def ecef(lat: Column, lon: Column, alt: Column, radians: bool = False, cut: bool = True) -> Column:
    """Earth-centred x, y, z in metres.

    ``radians`` takes the angles as radians, for logs written that way.
    ``cut`` first drops what is below 1e-8 degree and 1 mm.
    """
    if cut:
        lat, lon, alt = truncated(lat, 1e8), truncated(lon, 1e8), truncated(alt, 1e3)
    if not radians:
        lat, lon = F.radians(lat), F.radians(lon)
    n = AXIS / F.sqrt(1 - ECC2 * F.sin(lat) * F.sin(lat))
    return F.struct(
        ((n + alt) * F.cos(lat) * F.cos(lon)).alias("x"),
        ((n + alt) * F.cos(lat) * F.sin(lon)).alias("y"),
        ((n * (1 - ECC2) + alt) * F.sin(lat)).alias("z"),
    )


def geodetic(x: Column, y: Column, z: Column) -> Column:
    """Latitude and longitude in degrees and height in metres of an Earth-centred position (Bowring's formula)."""
    b = AXIS * (1 - ECC2) ** 0.5
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * AXIS, p * b)
    lat = F.atan2(z + ECC2 / (1 - ECC2) * b * F.pow(F.sin(theta), F.lit(3)), p - ECC2 * AXIS * F.pow(F.cos(theta), F.lit(3)))
    n = AXIS / F.sqrt(1 - ECC2 * F.sin(lat) * F.sin(lat))
    # The form without a division by the cosine holds near the poles too.
    alt = p * F.cos(lat) + z * F.sin(lat) - AXIS * AXIS / n
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"), alt.alias("alt"))


def squared_distance(p, q) -> Column:
    """Of two triples of columns."""
    return sum(((a - b) * (a - b) for a, b in zip(p[1:], q[1:], strict=True)), (p[0] - q[0]) * (p[0] - q[0]))


def segment_squared_distance(p, a, b) -> Column:
    """From a point to a segment; a segment of no length is a point."""
    along = [y - x for x, y in zip(a, b, strict=True)]
    length2 = squared_distance(a, b)
    dot = sum(((x - s) * d for x, s, d in zip(p[1:], a[1:], along[1:], strict=True)), (p[0] - a[0]) * along[0])
    t = F.when(length2 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / F.nullif(length2, F.lit(0.0)))))
    return squared_distance(p, [s + t * d for s, d in zip(a, along, strict=True)])


@F.pandas_udf(T.DoubleType())
def segment_squared_distances(px: pd.Series, py: pd.Series, pz: pd.Series, ax: pd.Series, ay: pd.Series, az: pd.Series, bx: pd.Series, by: pd.Series, bz: pd.Series) -> pd.Series:
    """``segment_squared_distance`` of many rows at once: as one expression its code is too long to be compiled, and a row costs some 50 us."""
    p, a, b = ([c.to_numpy(float) for c in cs] for cs in ((px, py, pz), (ax, ay, az), (bx, by, bz)))
    along = [y - x for x, y in zip(a, b, strict=True)]
    length2 = along[0] * along[0] + along[1] * along[1] + along[2] * along[2]
    dot = (p[0] - a[0]) * along[0] + (p[1] - a[1]) * along[1] + (p[2] - a[2]) * along[2]
    t = np.where(length2 == 0, 0.0, np.clip(dot / np.where(length2 == 0, 1.0, length2), 0.0, 1.0))
    off = [x - (s + t * d) for x, s, d in zip(p, a, along, strict=True)]
    return pd.Series(off[0] * off[0] + off[1] * off[1] + off[2] * off[2])
