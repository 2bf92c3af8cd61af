"""Upserts, deletes, deltas, retention and vector upkeep: each gives the table as it is afterwards.

Plain Parquet has no merge: a change is a join of the present table with the change, and the result is written as
the next version.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.tables import latest, top_rows
from recollect.functions.text import normalise_hash
from recollect.functions.vectors import normalise


def upsert_file(stored: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Files (file_path, id, content_hash, access_count, created_at) with new ones (file_path, id, content_hash): a
    path that is there keeps id and created_at and counts an access."""
    s = stored.select("file_path", *[F.col(c).alias(f"s_{c}") for c in ("id", "content_hash", "access_count", "created_at")], F.lit(True).alias("s"))
    n = new.select("file_path", F.col("id").alias("n_id"), F.col("content_hash").alias("n_hash"), F.lit(True).alias("n"))
    both = s.join(n.hint("merge"), "file_path", "full")
    old = F.col("s").isNotNull()
    return both.select(
        "file_path",
        F.when(old, F.col("s_id")).otherwise(F.col("n_id")).alias("id"),
        F.when(F.col("n").isNotNull(), F.col("n_hash")).otherwise(F.col("s_content_hash")).alias("content_hash"),
        F.when(old, F.col("s_access_count") + F.when(F.col("n").isNotNull(), 1).otherwise(0)).otherwise(0).alias("access_count"),
        F.when(old, F.col("s_created_at")).otherwise(now).alias("created_at"),
    )


def delta_chunks(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_path, hash_id, change): the distinct hashes of each file as added, removed or unchanged."""
    a, b = before.select("file_path", "hash_id").distinct(), after.select("file_path", "hash_id").distinct()
    both = a.withColumn("a", F.lit(True)).join(b.withColumn("b", F.lit(True)).hint("merge"), ["file_path", "hash_id"], "full")
    return both.select("file_path", "hash_id", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("unchanged").alias("change"))


def touch(stored: DataFrame, accesses: DataFrame) -> DataFrame:
    """Files with the number of accesses (file_path, ts) added and the last one's time."""
    a = accesses.groupBy("file_path").agg(F.count("*").alias("n"), F.max("ts").alias("ts"))
    out = stored.join(a.hint("merge"), "file_path", "left")
    return out.withColumns({"access_count": F.col("access_count") + F.coalesce("n", F.lit(0)), "last_accessed_at": F.greatest("last_accessed_at", "ts")}).drop("n", "ts")


def invalidate(keys: DataFrame | None, **tables: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table without the rows of the keys' file paths (None: of all), and how many rows each loses (name, removed).

    The keys of one file, those that `freshness` calls stale or missing, or None are the scopes of a call. Vectors have no
    path: they lose those of the chunks (file_path, hash_id) that go, by their id."""
    if keys is None:
        out = {name: t.limit(0) for name, t in tables.items()}
    else:
        gone = keys.select("file_path").distinct()
        out = {name: t.join(gone.hint("merge"), "file_path", "left_anti") for name, t in tables.items() if name != "vectors"}
        if "vectors" in tables:
            hashes = tables["chunks"].join(gone.hint("merge"), "file_path", "left_semi").select(F.col("hash_id").alias("id")).distinct()
            still = out["chunks"].select(F.col("hash_id").alias("id")).distinct()
            out["vectors"] = tables["vectors"].join(hashes.join(still.hint("merge"), "id", "left_anti").hint("merge"), "id", "left_anti")
    counts = [tables[n].agg(F.count("*").alias("n")).crossJoin(F.broadcast(out[n].agg(F.count("*").alias("left")))).select(F.lit(n).alias("name"), (F.col("n") - F.col("left")).alias("removed")) for n in out]  # one row each
    return out, reduce(DataFrame.unionByName, counts)


def evict_idle(stored: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return stored.where(F.col("last_accessed_at") >= now - F.make_dt_interval(days=F.lit(days)))


def retain_last_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return top_rows(rows, keys, order, n).drop("rank")


def update_rows(rows: DataFrame, patch: DataFrame, columns: list[str], now: Column, key: str = "id") -> DataFrame:
    """Rows with the non-null values of a patch table in the columns named, and updated_at of those that it names."""
    p = patch.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    out = rows.join(p.hint("merge"), F.col(key) == F.col("__k"), "left")
    changed = {c: F.coalesce(f"__{c}", c) for c in columns} | {"updated_at": F.when(F.col("__k").isNotNull(), now).otherwise(F.col("updated_at"))}
    return out.withColumns(changed).drop("__k", *[f"__{c}" for c in columns])


def delete_rows(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(keys.select(key).distinct().hint("merge"), key, "left_anti")


def delete_agent(rows: DataFrame, agent: str) -> DataFrame:
    """On a table partitioned by agent_id the filter drops whole partitions."""
    return rows.where(F.col("agent_id") != agent)


def bulk_add(memories: DataFrame, new: DataFrame, skip_duplicates: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejected rows): those without content are rejected; skip_duplicates also leaves out rows whose
    (agent, content, type) is there, or stands before in the batch."""
    good = new.where(F.length(F.trim(F.coalesce("content", F.lit("")))) > 0)
    bad = new.where(F.length(F.trim(F.coalesce("content", F.lit("")))) == 0)
    if skip_duplicates:
        key = F.sha2(F.to_json(F.struct("agent_id", "content", "memory_type")), 256)
        first = good.withColumn("__key", key)
        first = latest(first.withColumn("__o", -F.col("ord")), ["__key"], ["__o"])
        good = first.join(memories.select(key.alias("__key")).distinct().hint("merge"), "__key", "left_anti").drop("__key", "__o").select(*new.columns)
    return good, bad


#: Words whose bucket a task remembers; rows that it works on at once.
KNOWN, PIECE = 500_000, 256


def hash_embed(items: DataFrame, dim: int) -> DataFrame:
    """(id, embedding) of items (id, content): counts of hashed words, divided by their L2 norm. Items without a word have no row.
    Tasks count the words of whole items, so that an item is one row between stages; rows of an id are added up."""

    def run(batches):
        known: dict[str, int] = {}
        for whole in batches:
            for k in range(0, whole.num_rows, PIECE):
                batch = whole.slice(k, PIECE)
                counts = np.zeros((batch.num_rows, dim), np.int64)
                for i, text in enumerate(batch.column(1).to_pylist()):
                    words = re.findall("[a-z]+", text or "")
                    if len(known) > KNOWN:
                        known.clear()
                    known.update((w, int(hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()[:8], 16) % dim) for w in set(words) if w not in known)
                    counts[i] = np.bincount(np.array([known[w] for w in words], np.int64), minlength=dim)
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(counts.ravel()))], ["id", "counts"])

    rows = items.select("id", F.lower("content").alias("content")).mapInArrow(run, f"id {items.schema['id'].dataType.simpleString()}, counts array<long>")
    added = rows.groupBy("id").agg(F.collect_list("counts").alias("rows"))
    zero = F.array_repeat(F.lit(0).cast("long"), dim)
    counts = F.when(F.size("rows") == 1, F.col("rows")[0]).otherwise(F.aggregate("rows", zero, lambda s, x: F.zip_with(s, x, lambda a, b: a + b)))
    return added.select("id", counts.alias("counts")).where(F.exists("counts", lambda x: x > 0)).select("id", normalise(F.transform("counts", lambda x: x.cast("double"))).alias("embedding"))


def embed_missing(items: DataFrame, vectors: DataFrame, embed) -> DataFrame:
    """Vectors of the items (id, content) that have none and have text; embed is DataFrame (id, content) -> (id, embedding)."""
    missing = items.select("id", "content").where(F.length(F.trim("content")) > 0).join(vectors.select("id").hint("merge"), "id", "left_anti")
    return vectors.select("id", "embedding").unionByName(embed(missing))


def upsert_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """The new vectors, and the present ones of other ids."""
    both = vectors.select("id", "embedding", F.lit(0).alias("v")).unionByName(new.select("id", "embedding", F.lit(1).alias("v")))
    return latest(both, ["id"], ["v"]).drop("v")


def orphan_vectors(vectors: DataFrame, items: DataFrame) -> DataFrame:
    return vectors.join(items.select("id").distinct().hint("merge"), "id", "left_anti")


def vector_stats(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("agent_id").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dimension"))


def hashed_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("hash_id", normalise_hash(F.col("content")))
