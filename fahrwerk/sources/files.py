"""Readers of run tables, run contexts, series and logs, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import run_name
from ..functions.text import log_entries
from ..model import RUN_CONTEXT, SENSORS, SERIES

READINGS = "array<struct<kind: string, measurement: string, unit: bigint, t0: bigint, tf: bigint, dev: bigint>>"
RUN_NAME = r"simulation_(\d+)_mass_(\d+)_friction_([0-9.]+)\.csv$"


def read_runs(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Run tables in CSV, with run_id, mass and friction from the file's name and seq from the line's place.

    Names are in upper case; NaN counts as null.  A file is read by one task,
    in order, so that seq is its line number.
    """
    reader = spark.read.option("header", True).option("nanValue", "NaN")
    # A file's lines in one partition: larger than any run.
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    df = df.toDF(*[c.upper() for c in df.columns])
    types = dict(df.dtypes)
    df = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if types[c] == "double" else F.col(c) for c in df.columns], F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    from pyspark.sql import Window

    w = Window.partitionBy("_file").orderBy("_block", "_line")
    part = lambda k: F.regexp_extract("_file", RUN_NAME, k)
    return df.withColumns({"run_id": part(1).cast("int"), "mass": part(2).cast("int"), "friction": part(3).cast("double"), "seq": F.row_number().over(w) - 1}).drop("_file", "_block", "_line")


def write_runs(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A folder for each run; where mass and friction are columns it bears the name of the run's file, else its id."""
    if {"mass", "friction"} <= set(df.columns):
        df = df.withColumn("run", run_name(F.col("run_id"), F.col("mass").cast("int"), F.col("friction").cast("double")))
        df.write.partitionBy("run").format(fmt).mode("overwrite").save(path)
    else:
        df.write.partitionBy("run_id").format(fmt).mode("overwrite").save(path)


def read_run_context(spark: SparkSession, path: str) -> DataFrame:
    """Run contexts: id, mass, friction, map features."""
    c = spark.read.schema(RUN_CONTEXT).option("multiLine", True).json(path)
    return c.select("id", "description", "sigs", F.col("vehicles")[0]["body"]["mass"].alias("mass"), F.col("environment.simulatorSettings.map_friction").alias("friction"), F.col("environment.location.map_features").alias("map_features"), "vehicles")


def readings(contexts: DataFrame, units: dict[str, int] | None = None) -> DataFrame:
    """One row per signature and reading to fetch: sensors, actuation, telemetry and motion vectors.

    ``units`` gives a kind's readings a unit of its own in place of theirs.
    """
    v = F.col("vehicles")[0]
    unit = lambda kind, r: F.lit((units or {})[kind]) if kind in (units or {}) else r["unit"]
    plain = lambda c, kind: F.transform(F.coalesce(c, F.array()), lambda r: F.struct(F.lit(kind).alias("kind"), r["measurement"].alias("measurement"), unit(kind, r).cast("long").alias("unit"), r["t0"].cast("long").alias("t0"), r["tf"].cast("long").alias("tf"), r["dev"].cast("long").alias("dev"))).cast(READINGS)
    every = F.concat(plain(F.flatten(v["sensors"]["readings"]), "sensor"), plain(v["actuation"], "actuation"), plain(v["telemetry"], "telemetry"), plain(v["motion_vectors"], "motion_vector"))
    return contexts.select("id", F.explode("sigs").alias("sig"), every.alias("all")).select("id", "sig", F.explode("all").alias("r")).select("id", "sig", "r.*")


def features_of(contexts: DataFrame) -> DataFrame:
    """Map features as rows; ids of the same base are numbered in order of their lists."""
    from pyspark.sql import Window

    f = contexts.select("id", F.posexplode("map_features").alias("type_rank", "ftype", "items")).select("id", "type_rank", "ftype", F.posexplode("items").alias("list_idx", "i"))
    size = F.when(F.col("ftype") == "ramp", F.concat_ws("_", F.col("i.ry").cast("string"), F.col("i.w").cast("string"))).otherwise(F.coalesce(F.col("i.r"), F.col("i.l")).cast("string"))
    base = F.concat_ws("_", "ftype", F.coalesce("i.class", F.lit("")), size)
    w = Window.partitionBy("id", "base").orderBy("type_rank", "list_idx")
    return f.withColumn("base", base).withColumn("label", F.concat_ws("_", "base", F.row_number().over(w)))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Series files: file, pos in the file, dev, sensor name, value, x, y, z, timestamp.  Malformed files give no rows.

    ``value`` is a number or null; ``raw`` holds it as it stands, be it text, a list or a record.
    """
    s = spark.read.schema(SERIES).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = s.select(F.col("_metadata.file_path").alias("file"), F.posexplode("series").alias("pos", "r")).select("file", "pos", "r.*")
    names = F.create_map(*[F.lit(x) for name, dev in SENSORS.items() for x in (dev, name)])
    rows = rows.withColumn("raw", F.col("value")).withColumn("value", F.col("value").try_cast("double"))
    return rows.withColumn("sensor", F.element_at(names, F.col("dev").cast("int")))


def expected_length(series: DataFrame) -> int:
    """The longest file's number of entries: what shorter ones are padded to, whatever their order."""
    top = series.agg(F.max("pos")).first()[0]
    return 0 if top is None else top + 1


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Entries of sniffer logs."""
    return log_entries(spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "text"))


def write_results(df: DataFrame, path: str) -> None:
    """Result tables as one CSV with a header; they hold a row per run and method."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_measurements(df: DataFrame, path: str) -> None:
    """JSON lines, a folder for each measurement; written again they replace themselves."""
    df.write.mode("overwrite").partitionBy("measurement").json(path)


def write_blobs(df: DataFrame, path: str, name: str = "name", blob: str = "blob") -> int:
    """One binary file for each record in a folder that all executors share; returns how many.

    A file takes its name when it is whole, and a task that runs again writes
    the same ones.
    """
    import os

    import pandas as pd

    def run(batches):
        os.makedirs(path, exist_ok=True)
        for b in batches:
            done = 0
            for n, data in zip(b[name], b[blob], strict=True):
                if n is None or data is None:
                    continue
                if os.path.basename(n) != n or n in ("", ".", ".."):
                    raise ValueError(f"not a file name: {n!r}")
                part = os.path.join(path, f".{n}.{os.getpid()}")
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, os.path.join(path, n))
                done += 1
            yield pd.DataFrame({"n": [done]})

    return df.select(name, blob).mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_report(spark: SparkSession, lines: list[str], path: str) -> None:
    """A short text: averages of clusters and their inertia, a line each."""
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def save_arrays(spark: SparkSession, arrays: dict, path: str) -> None:
    """A fitted model's or scaler's arrays, by name: nothing that runs code when it is loaded."""
    import numpy as np

    rows = [(k, list(np.shape(v)), np.asarray(v, float).ravel().tolist()) for k, v in sorted(arrays.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, data array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_arrays(spark: SparkSession, path: str) -> dict:
    """What ``save_arrays`` wrote: a model's weights, as large as the model."""
    import numpy as np

    return {r.name: np.array(r.data, float).reshape(r.shape) for r in spark.read.parquet(path).collect()}


def find_run(spark: SparkSession, path: str, run_id: int) -> str:
    """The first file (by name) of a run in a folder; raises if there is none."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", f"simulation_{run_id}_*.csv").load(path).agg(F.min("path")).first()[0]
    if names is None:
        raise FileNotFoundError(f"no file of run {run_id} in {path}")
    return names


def missing_inputs(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that don't exist, in any store that Spark reads."""
    from pyspark.errors import AnalysisException

    out = []
    for p in paths:
        try:
            spark.read.format("binaryFile").load(p)
        except AnalysisException:
            out.append(p)
    return out


def check_columns(df: DataFrame, wanted: list[str]) -> tuple[list[str], list[str]]:
    """(available, missing) of the wanted columns, in their order and whatever their letter case."""
    held = {c.upper() for c in df.columns}
    return [c for c in wanted if c.upper() in held], [c for c in wanted if c.upper() not in held]


def three_regimes(spark: SparkSession, series: int, length: int, sensors: int, seed: int = 42) -> DataFrame:
    """Series of uniform noise whose level rises by thirds, for trials: id, target, t, sensor, value."""
    if series % 3:
        raise ValueError("the number of series must be a multiple of 3")
    rows = spark.range(series).select("id", (F.floor(F.col("id") * 3 / series)).alias("target"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("t")).select("*", F.explode(F.sequence(F.lit(0), F.lit(sensors - 1))).alias("sensor"))
    noise = F.pmod(F.xxhash64(F.lit(seed), "id", "t", "sensor"), F.lit(1 << 53)) / (1 << 53)
    return rows.withColumn("value", 1 + F.col("target") + noise)
