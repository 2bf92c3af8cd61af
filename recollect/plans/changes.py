"""Graph, upkeep, version and vector queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.operators import graph as gr
from recollect.operators import maintain as mt
from recollect.operators import versions as vs
from recollect.sources import driverdata as dd
from recollect.sources.driverdata import with_views

NOW = "2024-02-15 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _edges(spark, sf_dir):
    i = gr.extract_imports(dd.code_chunks(spark, sf_dir))
    return i.select(gr.module_of().alias("u"), F.col("module").alias("v")).distinct()


def extract_imports(spark, sf_dir):
    return gr.extract_imports(dd.code_chunks(spark, sf_dir))


def find_importers(spark, sf_dir):
    c = dd.code_chunks(spark, sf_dir)
    return gr.find_importers(c, c.select(gr.module_of().alias("module")).distinct())


def call_edges(spark, sf_dir):
    return gr.call_edges(dd.code_chunks(spark, sf_dir))


def called_by(spark, sf_dir):
    return gr.called_by(dd.code_chunks(spark, sf_dir))


def dependency_graph(spark, sf_dir):
    return gr.dependency_graph(dd.code_chunks(spark, sf_dir))


def unused_functions(spark, sf_dir):
    return gr.unused_functions(dd.code_chunks(spark, sf_dir))


def functions_used(spark, sf_dir):
    return gr.defined_and_used(dd.code_chunks(spark, sf_dir))


def dependency_kind(spark, sf_dir):
    return gr.dependency_kind(dd.code_chunks(spark, sf_dir).select(gr.module_of().alias("module")), _edges(spark, sf_dir))


def usage_analysis(spark, sf_dir):
    c = dd.code_chunks(spark, sf_dir)
    return gr.usage_analysis(c.withColumn("parameters", F.array(F.lit("self"), F.lit("a"), F.lit("b"), F.lit("row"))))


def transitive_imports(spark, sf_dir):
    return gr.transitive_imports(_edges(spark, sf_dir))


def reachable(spark, sf_dir):
    return gr.reachable(_edges(spark, sf_dir))


def circular_dependencies(spark, sf_dir):
    return gr.circular_dependencies(_edges(spark, sf_dir))


def _stored(spark, sf_dir):
    """Files of version A as stored contexts, with accesses from the events."""
    a, b = dd.snapshots(spark, sf_dir)
    day = F.make_dt_interval(days=(F.length("content") % 60).cast("int"))
    s = a.select("file_path", F.concat(F.lit("id-"), F.col("file_path")).alias("id"), F.sha2("content", 256).alias("content_hash"), (F.length("content") % 5).alias("access_count"), (F.lit("2024-01-01").cast("timestamp") + day).alias("created_at"))
    return s.withColumn("last_accessed_at", F.col("created_at")), b.select("file_path", F.concat(F.lit("new-"), F.col("file_path")).alias("id"), F.sha2("content", 256).alias("content_hash"))


def upsert_file(spark, sf_dir):
    return mt.upsert_file(*_stored(spark, sf_dir), _now())


def _chunk_versions(spark, sf_dir):
    c = mt.hashed_chunks(dd.chunks(spark, sf_dir)).withColumn("doc", F.floor(F.col("ord") / 1000))
    b = c.where("doc % 5 <> 0").withColumn("hash_id", F.when(F.col("ord") % 11 == 0, F.sha2(F.concat("hash_id", F.lit("changed")), 256)).otherwise(F.col("hash_id")))
    return c.where("doc % 7 <> 0"), b


def delta_chunks(spark, sf_dir):
    return mt.delta_chunks(*_chunk_versions(spark, sf_dir))


def touch(spark, sf_dir):
    s = _stored(spark, sf_dir)[0]
    e = dd.table(spark, sf_dir, "events").select(F.concat(F.lit("d"), F.get_json_object("props", "$.k"), F.lit(".md")).alias("file_path"), "ts")
    return mt.touch(s, e).select("file_path", "access_count", "last_accessed_at")


def invalidate(spark, sf_dir):
    """Stale files of version A against B, taken out of the chunks."""
    from recollect.operators.reports import freshness

    stored, now = _stored(spark, sf_dir)
    stale = freshness(stored, now).where("freshness <> 'fresh'")
    return mt.invalidate(stale, files=stored)[0]["files"].select("file_path", "content_hash")


def invalidate_counts(spark, sf_dir):
    """What chunks, vectors of chunks and index lose in each scope: one file, the stale ones (every 4th document), all."""
    from recollect.operators.chunks import build_symbol_index

    c = mt.hashed_chunks(dd.chunks(spark, sf_dir)).withColumn("doc", F.floor(F.col("ord") / 1000))
    tables = {"chunks": c, "vectors": c.select(F.col("hash_id").alias("id")).distinct(), "index": build_symbol_index(c)}
    scopes = {"file": c.where("doc = 7"), "stale": c.where("doc % 4 = 0"), "all": None}
    counts = [mt.invalidate(keys, **tables)[1].select(F.lit(scope).alias("scope"), "name", "removed") for scope, keys in scopes.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def evict_idle(spark, sf_dir):
    return mt.evict_idle(_stored(spark, sf_dir)[0], _now()).select("file_path", "last_accessed_at")


def retain_last_n(spark, sf_dir):
    return mt.retain_last_n(dd.session_events(spark, sf_dir).select("agent_id", "event_id", "ts"), ["agent_id"], [F.col("ts").desc(), F.col("event_id").desc()], 100)


def update_rows(spark, sf_dir):
    m = dd.memories(spark, sf_dir).select("id", "ord", "topic", "importance", F.col("created_at").alias("updated_at"))
    patch = m.select("id", F.when(F.col("ord") % 4 == 0, F.lit("moved")).alias("topic"), F.when(F.col("ord") % 6 == 0, F.lit(0.9)).alias("importance"), "ord").where("ord % 2 = 0")
    return mt.update_rows(m, patch, ["topic", "importance"], _now()).select("id", "topic", "importance", "updated_at")


def delete_rows(spark, sf_dir):
    m = dd.memories(spark, sf_dir).select("id", "topic")
    return mt.delete_rows(m, m.where("topic = 'system'"))


def delete_agent(spark, sf_dir):
    return mt.delete_agent(dd.memories(spark, sf_dir), "3").select("agent_id", "id")


def bulk_add(spark, sf_dir):
    """All memories again and some blank ones, added to those of even place: duplicates are left out."""
    m = dd.memories(spark, sf_dir)
    new = m.withColumn("content", F.when(F.col("ord") % 9 == 0, F.lit("  ")).otherwise(F.col("content")))
    good, bad = mt.bulk_add(m.where("ord % 2 = 0"), new, skip_duplicates=True)
    return good.select("id", F.lit("added").alias("state")).unionByName(bad.select("id", F.lit("rejected").alias("state")))


def _some_vectors(spark, sf_dir):
    """The vectors of two thirds of the memories: the others are to be made, or to be added."""
    return dd.vectors(spark, sf_dir).where("cast(id as long) % 3 <> 0")


def _embed(df):
    return mt.hash_embed(df, 16).select("id", F.col("embedding").cast("array<float>").alias("embedding"))


def embed_missing(spark, sf_dir):
    v = mt.embed_missing(dd.memories(spark, sf_dir), _some_vectors(spark, sf_dir), _embed)
    return v.select("id", F.size("embedding").alias("dimension"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


def upsert_vector(spark, sf_dir):
    v = _some_vectors(spark, sf_dir)
    new = dd.vectors(spark, sf_dir).where("cast(id as long) % 2 = 0").withColumn("embedding", F.slice("embedding", 1, 8))
    return mt.upsert_vectors(v, new).select("id", F.size("embedding").alias("dimension"))


def delete_vectors(spark, sf_dir):
    return mt.delete_rows(dd.vectors(spark, sf_dir), dd.memories(spark, sf_dir).where("topic = 'user'")).select("id")


def get_vectors_batch(spark, sf_dir):
    wanted = dd.memories(spark, sf_dir).where("topic = 'assistant'").select("id")
    return dd.vectors(spark, sf_dir).join(wanted.hint("merge"), "id", "left_semi").select("id", F.element_at("embedding", 1).cast("double").alias("first"))


def vector_stats(spark, sf_dir):
    v = dd.vectors(spark, sf_dir).join(dd.memories(spark, sf_dir).select("id", "agent_id").hint("merge"), "id")
    return mt.vector_stats(v)


def orphan_vectors(spark, sf_dir):
    return mt.orphan_vectors(dd.vectors(spark, sf_dir), dd.memories(spark, sf_dir).where("memory_type <> 'working'")).select("id")


def _states(spark, sf_dir):
    a, b = dd.snapshots(spark, sf_dir)
    return tuple(x.select("file_path", F.sha2("content", 256).alias("sha")) for x in (a, b))


def blob_hash(spark, sf_dir):
    return dd.memories(spark, sf_dir).select("id", vs.blob_hash("topic", "memory_type", "agent_id").alias("sha"))


def tree_hash(spark, sf_dir):
    d = dd.table(spark, sf_dir, "documents")
    return vs.tree_hash(d.select("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")), ["source"])


def diff_snapshots(spark, sf_dir):
    return vs.diff_snapshots(*_states(spark, sf_dir))


def _log(spark, sf_dir):
    a, b = _states(spark, sf_dir)
    empty = a.limit(0)
    return vs.commit_delta(empty, a, 1).unionByName(vs.commit_delta(a, b, 2)).unionByName(vs.commit_delta(b, a, 3))


def commit(spark, sf_dir):
    return _log(spark, sf_dir)


def as_of(spark, sf_dir):
    return vs.as_of(_log(spark, sf_dir), 2)


def commit_staged(spark, sf_dir):
    """A fourth commit of staged files: what it adds and how many there are, and the branch's target after it."""
    a, b = _states(spark, sf_dir)
    refs = spark.createDataFrame([("branch", "main", "0", 3)], "kind string, name string, sha string, seq int")
    _, after, stats = vs.commit(_log(spark, sf_dir), refs, b.where("file_path like '%1.md'").withColumn("file_path", F.concat(F.lit("new-"), "file_path")), "main", 4)
    return stats.crossJoin(F.broadcast(vs.list_refs(after).select("name", "sha", "seq")))  # one row each


def history_walk(spark, sf_dir):
    """Each agent's stores as commits in order: the last three, from its head back."""
    e = dd.session_events(spark, sf_dir).where("action = 'store'").select("agent_id", "event_id")
    sha = F.sha2(F.col("event_id").cast("string"), 256)
    c = e.withColumn("before", F.lag("event_id").over(W.partitionBy("agent_id").orderBy("event_id"))).select("agent_id", "event_id", sha.alias("sha"), F.sha2(F.col("before").cast("string"), 256).alias("parent"))
    heads = c.groupBy(F.col("agent_id").alias("name")).agg(F.max_by("sha", "event_id").alias("sha"))
    return vs.walk(c.select("sha", "parent"), heads, 3)


def history(spark, sf_dir):
    return vs.history(_log(spark, sf_dir))


def rollback(spark, sf_dir):
    """The state at commit 3, which goes back to that of commit 1."""
    return vs.as_of(_log(spark, sf_dir), 3)


def list_refs(spark, sf_dir):
    e = dd.session_events(spark, sf_dir)
    return vs.list_refs(e.select(F.when(F.col("action") == "store", "tag").otherwise("branch").alias("kind"), F.col("file_path").alias("name"), F.sha2(F.col("event_id").cast("string"), 256).alias("sha"), F.col("event_id").alias("seq")))


def checkpoint(spark, sf_dir):
    c = vs.checkpoint_counts(dd.memories(spark, sf_dir))
    return c.select("agent_id", "memories", F.array_join(F.transform(F.map_entries("counts"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",").alias("counts"))


def snapshot_text_search(spark, sf_dir):
    a, _ = dd.snapshots(spark, sf_dir)
    blobs = a.select(F.sha2("content", 256).alias("sha"), "content").dropDuplicates(["sha"])
    return vs.snapshot_text_search(_states(spark, sf_dir)[0], blobs, "tion", 25)


def snapshot_text_search_typed(spark, sf_dir):
    """Memories as a state: entries have the memory's type as their mode."""
    m = dd.memories(spark, sf_dir).withColumn("sha", F.sha2("content", 256))
    state = m.select(F.concat_ws("/", "memory_type", "id").alias("file_path"), "sha", F.col("memory_type").alias("mode"))
    return vs.snapshot_text_search(state, m.groupBy("sha").agg(F.min("content").alias("content")), "tion", 25, "semantic")


QUERIES = {
    f.__name__: f
    for f in (
        extract_imports, find_importers, call_edges, called_by, dependency_graph, unused_functions, usage_analysis, functions_used, dependency_kind, invalidate_counts, commit_staged, history_walk, snapshot_text_search_typed, transitive_imports, reachable, circular_dependencies, upsert_file, delta_chunks, touch, invalidate, evict_idle,
        retain_last_n, update_rows, delete_rows, delete_agent, bulk_add, embed_missing, upsert_vector, delete_vectors, get_vectors_batch, vector_stats, orphan_vectors, blob_hash, tree_hash, diff_snapshots, commit, as_of, history,
        rollback, list_refs, checkpoint, snapshot_text_search,
    )
}

_EDGES = "edges as (select distinct 'm' || a as u, 'm' || b as v from code_parts where b is not null)"
_REACH = "reach(u, v) as (select u, v from edges union select r.u, e.v from reach r join edges e on r.v = e.u)"
_MODULES = "fn as (select *, regexp_extract(file_path, '^(.*)\\.py$', 1) as module, case when contains(target, '.') then split_part(target, '.', 1) else target end as head, case when contains(target, '.') then split_part(target, '.', 2) end as tail from code_chunks)".replace("\\\\", "\\")
_UNUSED = "unused as (select file_path, name from fn f where not exists (select 1 from fn g where g.file_path = f.file_path and g.target = f.name) and not exists (select 1 from fn g where g.tail is not null and g.head = f.module and g.tail = f.name))"
_STORED = """stored as (select file_path, 'id-' || file_path as id, sha256(content) as content_hash, len(content) % 5 as access_count, timestamp '2024-01-01' + (len(content) % 60) * interval 1 day as created_at from snap_a),
fresh as (select file_path, 'new-' || file_path as id, sha256(content) as content_hash from snap_b)"""
_SHAS = "sa as (select file_path, sha256(content) as sha from snap_a), sb as (select file_path, sha256(content) as sha from snap_b)"
_HASHED = "h as (select ord, ord // 1000 as doc, file_path, sha256(trim(regexp_replace(content, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) as hash_id from chunks)".replace("\\\\", "\\")
_HELD = "held as (select v.*, ord, agent_id, topic, memory_type from vectors v join memories using (id))"
_LOG = """log as (select 1 as seq, file_path, sha, false as deleted from sa
union all select 2, coalesce(sa.file_path, sb.file_path), coalesce(sb.sha, sa.sha), sb.sha is null from sa full join sb using (file_path) where sa.sha is distinct from sb.sha
union all select 3, coalesce(sa.file_path, sb.file_path), coalesce(sa.sha, sb.sha), sa.sha is null from sa full join sb using (file_path) where sa.sha is distinct from sb.sha)"""
SQL = {
    "extract_imports": with_views("code_chunks", body="select c.file_path, 'm' || b as module, 'direct' as kind, min(start_line) as line from code_chunks c join code_parts on ord = p_partkey where b is not null group by 1, 2"),
    "find_importers": with_views("code_chunks", body="mods as (select distinct regexp_extract(file_path, '^(.*)[.]py$', 1) as module from code_chunks)\nselect module, file_path, min(start_line) as line from mods join code_chunks on contains(lower(content), 'import ') and contains(lower(content), module) group by 1, 2"),
    "call_edges": with_views("code_chunks", body="select file_path, name as caller, target, call_line as line from code_chunks"),
    "called_by": with_views("code_chunks", body=_MODULES + "\nselect head as module, file_path, name as caller, target from fn where head in (select module from fn) and head <> module"),
    "dependency_graph": with_views("code_chunks", body=_EDGES + ",\n" + _MODULES + ",\n" + _UNUSED + """,
f as (select distinct file_path, module from fn)
select file_path, coalesce((select string_agg(v, ',' order by v) from edges where u = f.module), '') as imports, coalesce((select string_agg(v, ',' order by v) from edges where u = f.module and v not in (select module from fn)), '') as external,
coalesce((select string_agg(distinct target, ',' order by target) from fn g where g.file_path = f.file_path), '') as callees, coalesce((select string_agg(distinct g.file_path || ':' || g.name, ',' order by g.file_path || ':' || g.name) from fn g where g.head = f.module and g.module <> f.module), '') as callers,
coalesce((select string_agg(name, ',' order by name) from unused g where g.file_path = f.file_path), '') as unused_names, coalesce((select string_agg(u || '.py', ',' order by u || '.py') from edges where v = f.module), '') as imported_by,
(select count(*) from fn g where g.file_path = f.file_path) as calls_to, (select count(*) from fn g where g.head = f.module and g.module <> f.module) as called_by, (select count(*) from unused g where g.file_path = f.file_path) as unused from f"""),
    "unused_functions": with_views("code_chunks", body=_MODULES + ",\n" + _UNUSED + "\nselect * from unused"),
    "usage_analysis": with_views("code_chunks", body="select file_path, name, p as parameter from code_chunks, (values ('b'), ('row')) t(p)"),
    "functions_used": with_views("code_chunks", body=_MODULES + ",\n" + _UNUSED + """,
x as (select distinct f.file_path, coalesce(g.tail, g.head) as name from fn g join (select distinct file_path, module from fn) f on g.head = f.module where g.file_path <> f.file_path)
select file_path, 'defined' as kind, name from fn union all select file_path, 'external', name from x union all select file_path, 'unused', name from unused"""),
    "dependency_kind": with_views("code_chunks", body=_EDGES + ",\n" + _REACH + "\nselect (select count(distinct file_path) from code_chunks) as modules, count(distinct u) as on_cycles, case when count(*) > 0 then 'DCG' else 'DAG' end as kind from reach where u = v").replace("with ", "with recursive ", 1),
    "invalidate_counts": with_views("chunks", body=_HASHED + """,
idx as (select distinct symbol, file_path, doc from (select lower(name) as symbol, file_path, ord // 1000 as doc from chunks union all select unnest(keywords), file_path, ord // 1000 from chunks) where len(symbol) > 1),
scopes as (select 'file' as scope, doc from (select distinct doc from h) where doc = 7 union all select 'stale', doc from (select distinct doc from h) where doc % 4 = 0 union all select 'all', doc from (select distinct doc from h)),
s(scope) as (values ('file'), ('stale'), ('all'))
select scope, 'chunks' as name, (select count(*) from h where doc in (select doc from scopes t where t.scope = s.scope)) as removed from s
union all select scope, 'index', (select count(*) from idx where doc in (select doc from scopes t where t.scope = s.scope)) from s
union all select scope, 'vectors', (select count(distinct hash_id) from h) - (select count(distinct hash_id) from h where doc not in (select doc from scopes t where t.scope = s.scope)) from s"""),
    "transitive_imports": with_views("code_chunks", body=_EDGES + "\nselect u, v from edges union select a.u, b.v from edges a join edges b on a.v = b.u"),
    "reachable": with_views("code_chunks", body=_EDGES + ",\n" + _REACH + "\nselect u, v from reach").replace("with ", "with recursive ", 1),
    "circular_dependencies": with_views("code_chunks", body=_EDGES + ",\n" + _REACH + "\nselect a.u as node, min(a.v) as cycle, count(*) as size from reach a join reach b on a.u = b.v and a.v = b.u group by 1").replace("with ", "with recursive ", 1),
    "upsert_file": with_views("snapshots", body=_STORED + f"""
select coalesce(s.file_path, n.file_path) as file_path, coalesce(s.id, n.id) as id, coalesce(n.content_hash, s.content_hash) as content_hash, case when s.id is null then 0 else s.access_count + (n.id is not null)::int end::int as access_count,
coalesce(s.created_at, timestamp '{NOW}') as created_at from stored s full join fresh n using (file_path)"""),
    "delta_chunks": with_views("chunks", body=_HASHED + """,
a as (select distinct file_path, hash_id from h where doc % 7 <> 0), b as (select distinct file_path, case when ord % 11 = 0 then sha256(hash_id || 'changed') else hash_id end as hash_id from h where doc % 5 <> 0)
select file_path, hash_id, 'added' as change from (select * from b except select * from a) union all select file_path, hash_id, 'removed' from (select * from a except select * from b) union all select file_path, hash_id, 'unchanged' from (select * from a intersect select * from b)"""),
    "touch": with_views("snapshots", body=_STORED + """,
e as (select 'd' || json_extract_string(props, '$.k') || '.md' as file_path, count(*) as n, max(ts) as ts from events group by 1)
select file_path, access_count + coalesce(n, 0) as access_count, greatest(created_at, coalesce(ts, created_at)) as last_accessed_at from stored left join e using (file_path)"""),
    "invalidate": with_views("snapshots", body=_STORED + "\nselect file_path, s.content_hash from stored s join fresh f using (file_path) where s.content_hash = f.content_hash"),
    "evict_idle": with_views("snapshots", body=_STORED + f"\nselect file_path, created_at as last_accessed_at from stored where created_at >= timestamp '{NOW}' - interval 30 day"),
    "retain_last_n": with_views("session_events", body="select agent_id, event_id, ts from (select *, row_number() over (partition by agent_id order by ts desc, event_id desc) as rn from session_events) where rn <= 100"),
    "update_rows": with_views("memories", body=f"select id, case when ord % 4 = 0 then 'moved' else topic end as topic, case when ord % 6 = 0 then 0.9::double else importance end as importance, case when ord % 2 = 0 then timestamp '{NOW}' else created_at end as updated_at from memories"),
    "delete_rows": with_views("memories", body="select id, topic from memories where topic <> 'system'"),
    "delete_agent": with_views("memories", body="select agent_id, id from memories where agent_id <> '3'"),
    "bulk_add": with_views("memories", body="""n as (select *, case when ord % 9 = 0 then '  ' else content end as c from memories)
select id, 'rejected' as state from n where trim(c) = '' union all
select arg_min(id, ord), 'added' from n where trim(c) <> '' and not exists (select 1 from memories m where m.ord % 2 = 0 and m.agent_id = n.agent_id and m.content = n.c and m.memory_type = n.memory_type) group by agent_id, c, memory_type"""),
    "embed_missing": with_views("vectors", body=_HELD.replace("using (id)", "using (id) where ord % 3 <> 0") + """,
w as (select id, unnest(regexp_extract_all(lower(content), '[a-z]+')) as w from memories where ord % 3 = 0),
n as (select id, ('0x' || substr(md5(w), 1, 8))::bigint % 16 as b, count(*) as n from w group by 1, 2)
select id, len(embedding)::int as dimension, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) as total from held union all select id, 16, round(sum(n) / sqrt(sum(n * n)), 4) from n group by 1"""),
    "upsert_vector": with_views("vectors", body="select id, case when ord % 2 = 0 then 8 else len(embedding) end::int as dimension from vectors join memories using (id) where ord % 3 <> 0 or ord % 2 = 0"),
    "delete_vectors": with_views("vectors", body=_HELD + "\nselect id from held where topic <> 'user'"),
    "get_vectors_batch": with_views("vectors", body=_HELD + "\nselect id, embedding[1]::double as first from held where topic = 'assistant'"),
    "vector_stats": with_views("vectors", body=_HELD + "\nselect agent_id, count(*) as n, max(len(embedding))::int as dimension from held group by 1"),
    "orphan_vectors": with_views("vectors", body=_HELD + "\nselect id from held where memory_type = 'working'"),
    "blob_hash": with_views("memories", body="""select id, sha256('{"agent_id":"' || agent_id || '","memory_type":"' || memory_type || '","topic":"' || topic || '"}') as sha from memories"""),
    "tree_hash": "with s as (select source, sha256(coalesce(text, '')) as sha from documents), c as (select source, sha, sha || 'x' || count(*) as v from s group by 1, 2),\nn8 as (select source, substr(sha, 1, 8) as node, sha256(string_agg(v || ':' || v, ',' order by v)) as h from c group by 1, 2),\n"
    + ",\n".join(f"n{k} as (select source, up as node, sha256(string_agg(node || ':' || h, ',' order by node)) as h from (select *, substr(node, 1, {k}) as up from n{k + 2}) group by 1, 2)" for k in (6, 4, 2, 0))
    + "\nselect source, h as tree_sha from n0",
    "diff_snapshots": with_views("snapshots", body=_SHAS + "\nselect 'added' as change, file_path, sha from (select * from sb except select * from sa) union all select 'removed', file_path, sha from (select * from sa except select * from sb)"),
    "commit": with_views("snapshots", body=_SHAS + ",\n" + _LOG + "\nselect * from log"),
    "as_of": with_views("snapshots", body=_SHAS + "\nselect * from sb"),
    "commit_staged": with_views("snapshots", body=_SHAS + """
select (select count(*) from sb where file_path like '%1.md') as added, (select count(*) from sa) + (select count(*) from sb where file_path like '%1.md') as total, 'main' as name, sha256('main:4') as sha, 4 as seq"""),
    "history_walk": with_views("session_events", body="c as (select agent_id, sha256(event_id::varchar) as sha, row_number() over (partition by agent_id order by event_id desc) - 1 as depth from session_events where action = 'store')\nselect agent_id as name, sha, depth::int as depth from c where depth < 3"),
    "snapshot_text_search_typed": with_views("memories", body="s as (select memory_type || '/' || id as file_path, lower(content) as c from memories where memory_type = 'semantic' and contains(lower(content), 'tion'))\nselect file_path, round((len(c) - len(replace(c, 'tion', ''))) / 4.0::double / len(c), 6) as score from s order by 2 desc, 1 limit 25"),
    "history": with_views("snapshots", body=_SHAS + ",\n" + _LOG + "\nselect seq, count(*) filter (not deleted) as written, count(*) filter (deleted) as deleted from log group by 1"),
    "rollback": with_views("snapshots", body=_SHAS + "\nselect * from sa"),
    "list_refs": with_views("session_events", body="select case when action = 'store' then 'tag' else 'branch' end as kind, file_path as name, sha256(max(event_id)::varchar) as sha, max(event_id) as seq from session_events group by 1, 2"),
    "checkpoint": with_views("memories", body="c as (select agent_id, memory_type, count(*) as n from memories group by 1, 2)\nselect agent_id, sum(n)::bigint as memories, string_agg(memory_type || '=' || n, ',' order by memory_type) as counts from c group by 1"),
    "snapshot_text_search": with_views("snapshots", body="s as (select file_path, lower(content) as c from snap_a where contains(lower(content), 'tion'))\nselect file_path, round((len(c) - len(replace(c, 'tion', ''))) / 4.0::double / len(c), 6) as score from s order by 2 desc, 1 limit 25"),
}
