"""Reading the tables of a corpus folder, and intermediate tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its rows have been counted and are at most this many.
SMALL_ROWS = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def materialised(df: DataFrame) -> DataFrame:
    """Written as Parquet to the folder all executors share (spark.checkpoint.dir) and read back."""
    sc = df.sparkSession.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not top:
        top = tempfile.mkdtemp(prefix="enthyme-")
        sc.setCheckpointDir(top)
    path = f"{top.rstrip('/')}/enthyme-{sc.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has been counted to be small; else left to the planner."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df
