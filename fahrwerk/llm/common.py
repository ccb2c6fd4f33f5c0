"""Shared pieces: tables in the cluster's shared folder and components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``; where that is unset (tests on one
    machine) a fresh temporary folder is set once for the session.  On a
    cluster an unset folder is an error, as a local one isn't shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        ctx = spark.sparkContext
        if ctx.getCheckpointDir() is None and not ctx.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if ctx.getCheckpointDir() is None:
            ctx.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = ctx.getCheckpointDir()
    return base.rstrip("/")


def free_names(table: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``table`` doesn't have, whatever its letter case."""
    held = {c.lower() for c in table.columns}
    out = []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        out.append(name)
    return out


#: Rows that a task hands to Python at once: few enough for batches of long texts to stay small in memory.
BATCH = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, batch: int = BATCH, by: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back (cuts lineage).

    ``batch`` is the number of rows in a batch for Python while it is
    written: less for rows that hold many others.  ``by`` names a column whose
    few values get a folder each, so that a filter on it reads no more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH_KEY)
    spark.conf.set(_BATCH_KEY, str(min(batch, int(before)) if int(before) > 0 else batch))
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_BATCH_KEY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables made by ``materialize`` once nothing reads them."""
    for table in tables:
        path = getattr(table, "_llm_path", None)
        if path:
            jvm = table.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating star contraction.

    ``edges`` has two long columns, ``a`` and ``b``; null ends and loops are
    ignored.  Returns ``node``, ``component`` (the smallest node reachable)
    for each node that has an edge.  Every round groups with partial
    aggregation and joins on the grouped key, so a node with a third of all
    edges is pre-aggregated and its join is split by the skew rule.
    """
    spark = edges.sparkSession
    cur = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v").distinct()
    )
    seen = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of u joins u's smallest neighbour.
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: every smaller neighbour of u, and u, join the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        mark = new.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        release(cur)
        cur = new
        if seen == mark:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
