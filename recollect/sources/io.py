"""Reading and writing memories, dialogues and source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MEMORY_SCHEMA = """agent_id string, id string, ord long, content string, memory_type string, keywords array<string>, persons array<string>, topic string, importance double, created_at timestamp"""

#: Stands for null in CSV, which has no other way to tell it from an empty text.
NULL = "\\N"


def read_memories(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Memories in a folder by agent: the schema is fixed, so nothing is inferred, and an agent's filter prunes folders. CSV is what
    export_memories() writes: with a header, lists as JSON text, and texts with line ends."""
    if kind != "csv":
        return spark.read.schema(MEMORY_SCHEMA).format(kind).load(path)
    fields = [c.split() for c in MEMORY_SCHEMA.split(", ")]
    lists = [name for name, kind in fields if kind.startswith("array")]
    # the order of a file's columns, with the folder's last
    schema = ", ".join(f"{name} {'string' if name in lists else kind}" for name, kind in [*fields[1:], fields[0]])
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", NULL).csv(path)
    return rows.withColumns({c: F.from_json(c, "array<string>") for c in lists}).select(*[name for name, _ in fields])


def export_memories(memories: DataFrame, path: str, kind: str = "json") -> None:
    """Memories by agent as JSON, CSV or Parquet; for CSV, lists and times go as JSON text."""
    rows = memories.select(*[F.col(c.split()[0]) for c in MEMORY_SCHEMA.split(", ")])
    if kind == "csv":
        rows = rows.withColumns({c: F.to_json(c) for c in ("keywords", "persons")})
        rows.write.partitionBy("agent_id").option("header", True).option("escape", '"').option("nullValue", NULL).csv(path)
    else:
        rows.write.partitionBy("agent_id").format(kind).save(path)


def import_memories(rows: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with new ids and an import time, rejected rows): those without content are rejected.

    A new id is a hash of the row, the import time, and the row's number among equal ones, so that a task that runs again gives
    the same ids."""
    good = F.length(F.trim(F.coalesce("content", F.lit("")))) > 0
    told = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    kept = rows.where(good).withColumn("__row", F.sha2(told, 256))
    again = F.row_number().over(W.partitionBy("__row").orderBy("__row"))
    ids = F.sha2(F.concat_ws(":", "__row", now.cast("string"), again.cast("string")), 256)
    return kept.withColumns({"source_id": F.col("id"), "id": ids, "imported_at": now}).drop("__row"), rows.where(~good)


def replace_memories(memories: DataFrame, rows: DataFrame) -> DataFrame:
    """The memories after an import that replaces: those of the agents that the rows name give way to the rows."""
    return memories.join(rows.select("agent_id").distinct().hint("merge"), "agent_id", "left_anti").select(*memories.columns).unionByName(rows.select(*memories.columns))


def export_bundle(memories: DataFrame, documents: DataFrame, checkpoints: DataFrame, path: str) -> None:
    """Memories, documents and checkpoints as JSON by agent, each kind in a folder of its own."""
    export_memories(memories, f"{path}/memories")
    documents.write.partitionBy("agent_id").json(f"{path}/documents")
    checkpoints.write.partitionBy("agent_id").json(f"{path}/checkpoints")


def import_bundle(spark: SparkSession, path: str, documents: str, checkpoints: str) -> dict[str, DataFrame]:
    """What export_bundle() has written: memories, and documents and checkpoints of the schemas given."""
    read = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}")
    return {"memories": read_memories(spark, f"{path}/memories"), "documents": read("documents", documents), "checkpoints": read("checkpoints", checkpoints)}


def load_dialogues(conversations: DataFrame, start: Column) -> DataFrame:
    """(conv_id, turn, speaker, content, ts): turns with content, a minute each from the start."""
    rows = conversations.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    return rows.select("conv_id", "turn", F.col("role").alias("speaker"), F.col("text").alias("content"), (start + F.make_dt_interval(mins=F.col("turn").cast("int"))).alias("ts"))


def read_corpus(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file_path, content, size_bytes, modified_at) of the files of a folder; bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.make_valid_utf8(F.col("content").cast("string")))
    return files.select(F.col("path").alias("file_path"), text.alias("content"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
