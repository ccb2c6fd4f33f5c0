"""Cuts the lineage of tables that loops read again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` from the folder that the cluster shares (``spark.checkpoint.dir``); where that is unset, only local masters get one of their own."""
    ctx = df.sparkSession.sparkContext
    if ctx.getCheckpointDir() is None:
        if ctx.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        ctx.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
