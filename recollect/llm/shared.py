"""Shared-folder tables and small column helpers for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the quality, substring and near-duplicate operators: ASCII white space separates.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows, and bytes of texts, that a Python stage works on at once; a longer text stands alone.
PIECE_ROWS, PIECE_BYTES = 256, 1 << 22


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder made
    here; on a cluster that is an error, as executors wouldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="recollect-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths made in each open temporary() scope, innermost last.
_SCOPES: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/recollect/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession):
    """A scope whose written tables are deleted at its end, but for those that result() has made.

    What leaves the scope must be a result, or not read the tables of the scope.
    """
    mine: list[str] = []
    _SCOPES.append(mine)
    try:
        yield
    finally:
        _SCOPES.remove(mine)
        for path in mine:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str, path: str | None = None, rows: int = PIECE_ROWS, group: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors. While it is written, Arrow
    batches hold so many rows at most. group: bytes of a row group, told after each row, for rows of MBs: else a writer holds 100 rows
    before it looks at their size, and a reader all that stand in a group."""
    spark, setting = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, before = path or new_path(spark, name), spark.conf.get(setting)
    spark.conf.set(setting, rows)
    try:
        writer = df.write.mode("errorifexists")
        if group:
            writer = writer.options(**{"parquet.block.size": group, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1})
        writer.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def result(df: DataFrame, name: str) -> DataFrame:
    """written(), but the table outlives the innermost temporary() scope."""
    mine = _SCOPES.pop() if _SCOPES else None
    try:
        return written(df, name)
    finally:
        if mine is not None:
            _SCOPES.append(mine)


def pieces(batches: Iterator[pa.RecordBatch], column: int, rows: int = PIECE_ROWS, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most so many rows and about so many bytes of the (string or binary) column."""
    for batch in batches:
        if batch.num_rows <= 1:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin, held = 0, 0
        for k, n in enumerate(sizes):
            if k > begin and (k - begin >= rows or held + n > size):
                yield batch.slice(begin, k - begin)
                begin, held = k, 0
            held += n
        yield batch.slice(begin)


def release() -> None:
    """Give memory that a task has freed back to the system; workers live on, and would hold on to it beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fits(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; reads no more than it needs to tell."""
    return df.limit(rows + 1).count() <= rows


def bounded_join(left: DataFrame, right: DataFrame, on, how: str, rows: int) -> DataFrame:
    """Broadcast the right side if its counted rows fit the bound, else sort-merge (AQE splits hot keys)."""
    return left.join(F.broadcast(right) if fits(right, rows) else right.hint("merge"), on, how)
