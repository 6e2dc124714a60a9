"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder (spark.checkpoint.dir) and read back.

    Where it is unset a temporary folder serves a local session; a cluster's
    executors would not share one, so there it is an error.
    """
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="heliograph-")
        spark.sparkContext.setCheckpointDir(where)
    path = f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
