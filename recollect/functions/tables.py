"""Tables in the shared folder, top rows per key, and latest rows per key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Where it is unset, a local session gets a folder made here; on a cluster
    that is an error, as executors wouldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="recollect-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_out(df: DataFrame) -> DataFrame:
    """The rows of a table, over as many tasks as there are cores if its files give fewer; else as they are. For work that is heavy
    for its bytes, as a small file that can't be split is one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, per_row: Column | None = None) -> DataFrame:
    """The first k rows of each key, with `rank`. The literal bound lets Spark prune before the shuffle; per_row is a
    smaller bound of the row's own."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    ranked = ranked if per_row is None else ranked.where(F.col("rank") <= per_row)
    return ranked.withColumn("rank", F.col("rank").cast("long"))


def latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each key: a maximum of structs, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in by])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")
