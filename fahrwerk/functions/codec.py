"""Motion vectors as 24-byte blobs, and base64, with SQL functions where SQL has them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: four 32-bit floats and an unsigned 64-bit id, little-endian.
LAYOUT = np.dtype([("speed", "<f4"), ("heading", "<f4"), ("yaw_rate", "<f4"), ("accel", "<f4"), ("id", "<u8")])


@F.pandas_udf(T.BinaryType())
def encode_motion(speed: pd.Series, heading: pd.Series, yaw_rate: pd.Series, accel: pd.Series, vid: pd.Series) -> pd.Series:
    rows = np.zeros(len(speed), LAYOUT)
    for name, values in zip(LAYOUT.names[:4], (speed, heading, yaw_rate, accel), strict=True):
        rows[name] = values.fillna(0)
    rows["id"] = vid.fillna(0).astype("int64").to_numpy().astype("u8")
    raw = rows.tobytes()
    return pd.Series([raw[i : i + 24] for i in range(0, len(raw), 24)])


@F.pandas_udf(T.StructType([*(T.StructField(n, T.DoubleType()) for n in LAYOUT.names[:4]), T.StructField("id", T.DecimalType(20, 0))]))
def decode_motion(blob: pd.Series) -> pd.DataFrame:
    import decimal

    ok = blob.map(lambda b: b is not None and len(b) == 24)
    rows = np.frombuffer(b"".join(b if k else b"\0" * 24 for b, k in zip(blob, ok, strict=True)), LAYOUT)
    out = pd.DataFrame({n: rows[n].astype(float) for n in LAYOUT.names[:4]})
    out["id"] = [decimal.Decimal(int(x)) for x in rows["id"]]
    out.loc[~ok.to_numpy(), :] = None
    return out


def relative_motion(row: dict[str, Column], ego: dict[str, Column]) -> dict[str, Column]:
    """Motion of a device seen from the ego vehicle, in absolute terms."""
    return {k: row[k] + ego[k] for k in row}


def round_trip(df: DataFrame) -> DataFrame:
    """Encodes to base64 text and decodes again."""
    text = F.base64(encode_motion("speed", "heading", "yaw_rate", "accel", "id"))
    return df.withColumn("blob", text).withColumn("back", decode_motion(F.unbase64("blob")))
