"""Stored forms that answer late questions by reading little: a commit log with snapshots, and pages by counts of key ranges.

Both are ordinary Parquet folders, pruned by partition values and file statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions.tables import written
from recollect.operators.versions import as_of

LOG = "seq long, file_path string, sha string, deleted boolean"


def append_commit(path: str, delta: DataFrame, seq: int, every: int = 16) -> None:
    """Add the rows (file_path, sha, deleted) of a commit to the log in a folder: under deltas/part, and behind each `every`th commit
    the whole state under snapshots/snapshot. Commits come in order from 1. A commit that is written again replaces itself."""
    spark = delta.sparkSession
    rows = delta.select(F.lit(seq).cast("long").alias("seq"), "file_path", "sha", "deleted")
    rows.write.mode("overwrite").parquet(f"{path}/deltas/part={(seq - 1) // every}/seq_of_commit={seq}")
    if seq % every == 0:
        state_at(spark, path, seq, every, snapshot=seq // every - 1).write.mode("overwrite").parquet(f"{path}/snapshots/snapshot={seq // every}")


def store_log(log: DataFrame, path: str, every: int = 16) -> None:
    """Store a whole log (seq, file_path, sha, deleted), commit by commit groups: all deltas at once, then a snapshot for each part from
    the one before it and that part's deltas."""
    log = written(log.select(F.col("seq").cast("long").alias("seq"), "file_path", "sha", "deleted"), "log")
    last = log.agg(F.max("seq")).first()[0] or 0
    parts = log.withColumn("part", F.floor((F.col("seq") - 1) / every)).withColumn("seq_of_commit", F.col("seq"))
    parts.hint("rebalance", "part").write.mode("overwrite").partitionBy("part", "seq_of_commit").parquet(f"{path}/deltas")
    for snapshot in range(1, last // every + 1):
        state_at(log.sparkSession, path, snapshot * every, every, snapshot=snapshot - 1).write.mode("overwrite").parquet(f"{path}/snapshots/snapshot={snapshot}")


def state_at(spark: SparkSession, path: str, seq: int, every: int = 16, snapshot: int | None = None) -> DataFrame:
    """(file_path, sha) at a commit: the last snapshot before it (or the one given) with the deltas after that. It reads one snapshot
    and less than `every` commits (or as many), however long the log is."""
    base = seq // every if snapshot is None else snapshot
    read = lambda kind, schema: spark.read.schema(schema).parquet(f"{path}/{kind}")
    part, deltas = F.col("part"), read("deltas", LOG + ", part long, seq_of_commit long")
    deltas = deltas.where((part >= base) & (part <= max((seq - 1) // every, 0)) & (F.col("seq_of_commit") <= seq)).select("seq", "file_path", "sha", "deleted")
    if base:
        held = read("snapshots", "file_path string, sha string, snapshot long").where(F.col("snapshot") == base)
        deltas = deltas.unionByName(held.select(F.lit(base * every).cast("long").alias("seq"), "file_path", "sha", F.lit(False).alias("deleted")))
    return as_of(deltas, seq)


def files_read(rows: DataFrame) -> int:
    """Files that a scan of stored rows reads, as its metadata tell."""
    return rows.select(F.col("_metadata.file_path").alias("f")).distinct().count()


#: Rows of a range of a page index.
RANGE_ROWS = 100_000


class Pages:
    """Rows in order, cut into ranges of about so many, with the count of each: a page reads the ranges that hold it, and sorts those
    alone. The ranges' counts are read as a table of one row each."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[tuple[str, bool]], path: str, size: int = RANGE_ROWS):
        """order: columns with whether they descend; keys and order together tell every row apart, or equal rows are in any order."""
        self.spark, self.keys, self.path = rows.sparkSession, keys, path
        self.order = [F.col(c).desc() if down else F.col(c).asc() for c, down in order]
        rows = written(rows, "page-rows")
        parts = max(1, -(-rows.count() // size))
        placed = rows.repartitionByRange(parts, *[F.col(k).asc() for k in keys], *self.order).withColumn("range", F.spark_partition_id())
        placed.write.partitionBy("range").parquet(path)
        self.rows = self.spark.read.schema(placed.schema).parquet(path)
        self.counts = written(self.rows.groupBy(*keys, "range").agg(F.count("*").alias("n")), "page-counts")

    def starts(self) -> DataFrame:
        """(keys, range, n, before, total): how many rows of a key lie in a range, in the ranges before it, and in all."""
        key = W.partitionBy(*self.keys)
        before = F.sum("n").over(key.orderBy("range").rowsBetween(W.unboundedPreceding, -1))
        return self.counts.withColumns({"before": F.coalesce(before, F.lit(0)), "total": F.sum("n").over(key)})

    def page(self, offset: int, limit: int) -> DataFrame:
        """Of each key the rows from an offset on, `limit` at most, with `rank` and `total`."""
        inside = written(self.starts().where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)), "page-ranges")
        ranges = [r[0] for r in inside.select("range").distinct().collect()]  # those that hold the page of some key
        held = self.rows.where(F.col("range").isin(ranges)).join(inside.hint("merge"), [*self.keys, "range"])
        rank = F.row_number().over(W.partitionBy(*self.keys, "range").orderBy(*self.order)) + F.col("before")
        return held.withColumn("rank", rank.cast("long")).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit)).drop("range", "n", "before")
