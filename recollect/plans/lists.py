"""Further listing, source and version queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions.tables import shared_path, top_rows
from recollect.operators import maintain as mt
from recollect.operators import stored
from recollect.operators import versions as vs
from recollect.plans.changes import _LOG, _SHAS, _log, _states
from recollect.sources import driverdata as dd
from recollect.sources import io
from recollect.sources.driverdata import with_views


def read_corpus(spark, sf_dir):
    """Documents written as text files by language and read again as whole files."""
    path = shared_path(spark, "corpus")
    dd.table(spark, sf_dir, "documents").select("lang", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("lang").text(path)
    files = io.read_corpus(spark, path, "*.txt")
    lang = F.regexp_extract("file_path", "/lang=([^/]+)/", 1)
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    return files.groupBy(lang.alias("lang")).agg(F.sum("size_bytes").alias("bytes"), F.sum(lines).alias("lines"))


def read_vectors(spark, sf_dir):
    """Vectors written by agent and read again."""
    path = shared_path(spark, "vectors")
    v = dd.vectors(spark, sf_dir).join(dd.memories(spark, sf_dir).select("id", "agent_id").hint("merge"), "id")
    v.write.partitionBy("agent_id").parquet(path)
    v = spark.read.schema("id string, embedding array<float>, agent_id string").parquet(path)
    return v.select("agent_id", "id", F.size("embedding").alias("dimension"))


def clear_vectors(spark, sf_dir):
    v = dd.vectors(spark, sf_dir).join(dd.memories(spark, sf_dir).select("id", "agent_id").hint("merge"), "id")
    return mt.delete_agent(v, "4").groupBy("agent_id").agg(F.count("*").alias("n"))


def list_documents(spark, sf_dir):
    d = dd.table(spark, sf_dir, "documents")
    return top_rows(d.select("source", "lang", "doc_id"), ["source", "lang"], [F.col("doc_id").desc()], 5)


def list_checkpoints(spark, sf_dir):
    e = dd.session_events(spark, sf_dir).where("action = 'store'")
    return top_rows(e.select("agent_id", "event_id", "ts"), ["agent_id"], [F.col("ts").desc(), F.col("event_id").desc()], 4)


def count_documents(spark, sf_dir):
    return dd.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("english"))


def count_checkpoints(spark, sf_dir):
    return dd.session_events(spark, sf_dir).where("action = 'store'").groupBy("agent_id").agg(F.count("*").alias("n"))


def show_commit(spark, sf_dir):
    """Commit 2: its entries and how many there are."""
    log = _log(spark, sf_dir).where("seq = 2")
    return log.join(F.broadcast(log.groupBy("seq").agg(F.count("*").alias("entries"))), "seq").select("file_path", "sha", "deleted", "entries")  # one row


def _refs(spark, sf_dir):
    e = dd.session_events(spark, sf_dir)
    kind = F.when(F.col("action") == "store", "tag").when(F.col("action") == "hit", "agent").otherwise("branch")
    return e.select(kind.alias("kind"), F.col("file_path").alias("name"), F.col("event_id").alias("seq"), F.sha2(F.col("event_id").cast("string"), 256).alias("sha"))


def branch(spark, sf_dir):
    return vs.list_refs(_refs(spark, sf_dir).where("kind = 'branch'"))


def tag(spark, sf_dir):
    return vs.list_refs(_refs(spark, sf_dir).where("kind = 'tag'"))


def checkout(spark, sf_dir):
    """Agents' places after each went back to the first commit that it knew."""
    refs = _refs(spark, sf_dir).where("kind = 'agent'")
    first = refs.groupBy("kind", "name").agg(F.min_by("sha", "seq").alias("sha"), (F.max("seq") + 1).alias("seq"))
    return vs.list_refs(refs.unionByName(first))


def export_state(spark, sf_dir):
    """All contents at commit 2."""
    b = dd.snapshots(spark, sf_dir)[1].select(F.sha2("content", 256).alias("sha"), "content")
    blobs = b.groupBy("sha").agg(F.min("content").alias("content"))
    return vs.as_of(_log(spark, sf_dir), 2).join(blobs.hint("merge"), "sha").select("file_path", F.length("content").alias("n_chars"))


def state_at_commit(spark, sf_dir):
    """The state at commit 39 of 40, stored with a snapshot behind each 8th: commit k sets the files whose number has remainder k by
    40, and deletes those that the commit ten before has set."""
    d = dd.table(spark, sf_dir, "documents").select((F.col("doc_id") % 40 + 1).cast("long").alias("seq"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    log = d.withColumn("deleted", F.lit(False)).unionByName(d.withColumns({"seq": F.col("seq") + 10, "deleted": F.lit(True)}).where("seq <= 40"))
    path = shared_path(spark, "commit-log")
    stored.store_log(log, path, 8)
    return stored.state_at(spark, path, 39, 8)


def list_memories_page(spark, sf_dir):
    """A late page of each agent's memories, newest first, from the ranges that hold it."""
    m = dd.memories(spark, sf_dir).select("agent_id", "id", "ord", "created_at")
    pages = stored.Pages(m, ["agent_id"], [("created_at", True), ("ord", True)], shared_path(spark, "pages"), 500)
    return pages.page(30, 10).select("agent_id", "id", "rank", "total")


def snapshot_contexts(spark, sf_dir):
    """A full-state snapshot of the file contexts: a blob by content, and not by time, for each."""
    a = dd.snapshots(spark, sf_dir)[0].withColumn("created_at", F.current_timestamp())
    return a.select("file_path", vs.blob_hash("file_path", "content").alias("sha"))


def compare_snapshots(spark, sf_dir):
    return vs.diff_snapshots(*_states(spark, sf_dir)).groupBy("change").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (read_corpus, read_vectors, clear_vectors, list_documents, list_checkpoints, count_documents, count_checkpoints, show_commit, branch, tag, checkout, export_state, state_at_commit, list_memories_page, snapshot_contexts, compare_snapshots)}

_REFS = "refs as (select case action when 'store' then 'tag' when 'hit' then 'agent' else 'branch' end as kind, file_path as name, event_id as seq, sha256(event_id::varchar) as sha from session_events)"
SQL = {
    "read_corpus": "select lang, sum(octet_length(encode(coalesce(text, ''))) + 1)::bigint as bytes, sum(len(string_split(coalesce(text, ''), chr(10))))::bigint as lines from documents group by 1",
    "read_vectors": with_views("vectors", body="select agent_id, id, len(embedding)::int as dimension from vectors join memories using (id)"),
    "clear_vectors": with_views("vectors", body="select agent_id, count(*) as n from vectors join memories using (id) where agent_id <> '4' group by 1"),
    "list_documents": "select source, lang, doc_id, rank from (select *, row_number() over (partition by source, lang order by doc_id desc) as rank from documents) where rank <= 5",
    "list_checkpoints": with_views("session_events", body="select agent_id, event_id, ts, rank from (select *, row_number() over (partition by agent_id order by ts desc, event_id desc) as rank from session_events where action = 'store') where rank <= 4"),
    "count_documents": "select source, count(*) as n, count(*) filter (lang = 'en') as english from documents group by 1",
    "count_checkpoints": with_views("session_events", body="select agent_id, count(*) as n from session_events where action = 'store' group by 1"),
    "show_commit": with_views("snapshots", body=_SHAS + ",\n" + _LOG + "\nselect file_path, sha, deleted, count(*) over () as entries from log where seq = 2"),
    "branch": with_views("session_events", body=_REFS + "\nselect kind, name, arg_max(sha, seq) as sha, max(seq) as seq from refs where kind = 'branch' group by 1, 2"),
    "tag": with_views("session_events", body=_REFS + "\nselect kind, name, arg_max(sha, seq) as sha, max(seq) as seq from refs where kind = 'tag' group by 1, 2"),
    "checkout": with_views("session_events", body=_REFS + "\nselect kind, name, arg_min(sha, seq) as sha, max(seq) + 1 as seq from refs where kind = 'agent' group by 1, 2"),
    "export_state": with_views("snapshots", body="select file_path, len(content)::int as n_chars from snap_b"),
    "state_at_commit": "select 'd' || doc_id as file_path, sha256(coalesce(text, '')) as sha from documents where doc_id % 40 + 1 between 30 and 39",
    "list_memories_page": with_views("memories", body="select agent_id, id, rank, total from (select agent_id, id, row_number() over (partition by agent_id order by created_at desc, ord desc) as rank, count(*) over (partition by agent_id) as total from memories) where rank between 31 and 40"),
    "snapshot_contexts": with_views("snapshots", body="""select file_path, sha256('{"content":"' || replace(replace(replace(replace(content, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t') || '","file_path":"' || file_path || '"}') as sha from snap_a""".replace("\\\\\\\\", "\\\\")),
    "compare_snapshots": with_views("snapshots", body=_SHAS + "\nselect change, count(*) as n from (select 'added' as change from (select * from sb except select * from sa) union all select 'removed' from (select * from sa except select * from sb)) group by 1"),
}
