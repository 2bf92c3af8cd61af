"""Listing, report and rule queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.operators import reports as rp
from recollect.sources import driverdata as dd
from recollect.sources.driverdata import with_views

# Patterns that the generated messages hold, beside the fixed rules.
DRIVER_RULES = [("personal", ["tion"], "semantic"), ("preferences", ["ing"], "semantic"), ("work", ["ble of"], "semantic"), ("dates", ["and the"], "episodic")]
DRIVER_ADVICE = [("personal_info", ["tion"]), ("preference", ["ing", "love"]), ("explicit_memory", ["ble the"]), ("work_context", ["thand"])]
DRIVER_TRIGGERS = ["tion", "ing", "the a", "of th", "from", "and"]


def _m(spark, sf_dir):
    return dd.memories(spark, sf_dir)


def list_memories(spark, sf_dir):
    rows = _m(spark, sf_dir).where("memory_type <> 'working'")
    return rp.page_of(rows, ["agent_id"], [F.col("created_at").desc(), F.col("ord").desc()], 2, 5).select("agent_id", "id", "rank", "total")


def list_memories_filtered(spark, sf_dir):
    rows = _m(spark, sf_dir).where(F.contains(F.lower("topic"), F.lit("user")) & F.exists("persons", lambda p: F.contains(F.lower(p), F.lit("th"))))
    return rp.page_of(rows, ["agent_id"], [F.col("created_at").desc(), F.col("ord").desc()], 0, 10).select("agent_id", "id", "rank", "total")


def memories_by_bin(spark, sf_dir):
    return rp.top_rows(_m(spark, sf_dir), ["memory_type"], [F.col("ord")], 10).select("memory_type", "id", "rank")


def list_logs(spark, sf_dir):
    e = dd.session_events(spark, sf_dir).where("action = 'miss'")
    return rp.top_rows(e, ["agent_id"], [F.col("ts").desc(), F.col("event_id").desc()], 7).select("agent_id", "event_id", "rank")


def list_code_files(spark, sf_dir):
    files = dd.code_chunks(spark, sf_dir).groupBy("file_path").agg(F.count("*").alias("chunks")).withColumn("one", F.lit(1))
    return rp.page_of(files, ["one"], [F.col("file_path")], 10, 20).select("file_path", "chunks", "rank", "total")


def lookup_prefix(spark, sf_dir):
    prefixes = _m(spark, sf_dir).select(F.substring("id", 1, 3).alias("prefix")).distinct()
    return rp.lookup_prefix(_m(spark, sf_dir), prefixes)


def folder_stats(spark, sf_dir):
    c = dd.chunks(spark, sf_dir)
    return c.groupBy("language").agg(F.countDistinct("file_path").alias("files"), F.sum(F.octet_length("content")).alias("bytes"), F.sum(F.floor(F.length("content") * 0.25)).cast("long").alias("tokens"))


def list_agents(spark, sf_dir):
    c = dd.table(spark, sf_dir, "customer")
    return rp.top_rows(c, ["c_nationkey", "c_mktsegment"], [F.col("c_acctbal").desc(), F.col("c_custkey").desc()], 3).select("c_nationkey", "c_mktsegment", "c_custkey", "rank")


def memory_counts(spark, sf_dir):
    return rp.memory_counts(_m(spark, sf_dir))


def agent_stats(spark, sf_dir):
    """Locations are the words after ` in `; documents belong to agents by number."""
    m = _m(spark, sf_dir).withColumn("location", F.regexp_extract("content", " in ([a-z]+)", 1))
    return rp.agent_stats(m, dd.table(spark, sf_dir, "documents").select((F.col("doc_id") % 12).cast("string").alias("agent_id")))


def count_logs(spark, sf_dir):
    return dd.session_events(spark, sf_dir).groupBy("agent_id", "action").agg(F.count("*").alias("n"))


def memory_summary(spark, sf_dir):
    return rp.memory_summary(_m(spark, sf_dir))


def memory_summary_focus(spark, sf_dir):
    return rp.memory_summary(_m(spark, sf_dir), focus="TION")


def summary_metadata(spark, sf_dir):
    return rp.summary_metadata(_m(spark, sf_dir))


def summary_metadata_focus(spark, sf_dir):
    return rp.summary_metadata(_m(spark, sf_dir), focus="user")


def what_do_i_know(spark, sf_dir):
    return rp.what_do_i_know(_m(spark, sf_dir))


def categorize_memories(spark, sf_dir):
    m = _m(spark, sf_dir)
    return m.groupBy("agent_id", rp.categories(F.col("content"), F.col("topic")).alias("category")).agg(F.count("*").alias("n"))


def group_by_purpose(spark, sf_dir):
    c = dd.chunks(spark, sf_dir)
    return c.groupBy("language", rp.purpose(F.col("content"), F.col("summary")).alias("purpose")).agg(F.count("*").alias("n"))


def context_by_topic(spark, sf_dir):
    return rp.context_by_topic(_m(spark, sf_dir))


def session_rollup(spark, sf_dir):
    return rp.session_rollup(dd.session_events(spark, sf_dir))


def token_savings(spark, sf_dir):
    """A file is in the cache of an agent with the tokens of its last store."""
    e = dd.session_events(spark, sf_dir)
    held = e.where("action = 'store'").groupBy("agent_id", "file_path").agg(F.max_by("tokens", F.struct("ts", "event_id")).alias("tokens"))
    return rp.token_savings(e, held)


def usage_activity(spark, sf_dir):
    return rp.indexing_activity(dd.chunks(spark, sf_dir))


def usage_report(spark, sf_dir):
    return rp.usage_report(dd.session_events(spark, sf_dir))


def _versions(spark, sf_dir):
    a, b = dd.snapshots(spark, sf_dir)
    stored = a.select("file_path", F.when(F.length("content") % 13 != 0, F.sha2("content", 256)).alias("content_hash"), F.floor(F.length("content") * 0.25).cast("long").alias("tokens"))
    return stored, b.select("file_path", F.sha2("content", 256).alias("content_hash"))


def freshness(spark, sf_dir):
    return rp.freshness(*_versions(spark, sf_dir)).select("file_path", "freshness")


def cache_stats(spark, sf_dir):
    return rp.cache_stats(*_versions(spark, sf_dir))


def cache_files(spark, sf_dir):
    return rp.cache_files(*_versions(spark, sf_dir))


def cache_recommendations(spark, sf_dir):
    return rp.cache_recommendations(*_versions(spark, sf_dir), dd.session_events(spark, sf_dir).where("action = 'none'"))


def engagement_rollup(spark, sf_dir):
    return rp.engagement_rollup(dd.table(spark, sf_dir, "events"), "user_id")


def op_latency(spark, sf_dir):
    return rp.op_latency(dd.table(spark, sf_dir, "events"))


def auto_remember(spark, sf_dir):
    return rp.auto_remember(_m(spark, sf_dir), DRIVER_RULES)


def auto_remember_fixed(spark, sf_dir):
    return rp.auto_remember(_m(spark, sf_dir))


def should_remember(spark, sf_dir):
    types, confidence = rp.should_remember(F.col("content"), DRIVER_ADVICE)
    return _m(spark, sf_dir).select("id", F.array_join(types, ",").alias("types"), confidence.alias("confidence"))


def memorable_triggers(spark, sf_dir):
    found, confidence = rp.triggers(F.col("content"), DRIVER_TRIGGERS)
    return _m(spark, sf_dir).select("id", F.array_join(F.slice(found, 1, 5), ",").alias("triggers"), confidence.alias("confidence"))


QUERIES = {
    f.__name__: f
    for f in (
        list_memories, list_memories_filtered, memories_by_bin, list_logs, list_code_files, lookup_prefix, folder_stats, list_agents, memory_counts, agent_stats, count_logs, memory_summary, memory_summary_focus, summary_metadata, summary_metadata_focus, usage_activity, cache_files, cache_recommendations, what_do_i_know,
        categorize_memories, group_by_purpose, context_by_topic, session_rollup, token_savings, usage_report, freshness, cache_stats, engagement_rollup, op_latency, auto_remember, auto_remember_fixed, should_remember, memorable_triggers,
    )
}


def _any(text: str, words: list[str]) -> str:
    return "(" + " or ".join("contains({}, '{}')".format(text, w.replace("'", "''")) for w in words) + ")"


def _facts(rules) -> str:
    parts = ", ".join(f"case when {_any('lower(content)', words)} then {{'topic': '{topic}', 'memory_type': '{kind}'}} end" for topic, words, kind in rules)
    return with_views("memories", body=f"""f as (select id, content, list_filter([{parts}], lambda x: x is not null) as met from memories),
g as (select id, unnest(case when len(met) > 0 then met when len(content) > 50 then [{{'topic': 'conversation', 'memory_type': 'episodic'}}] else [] end) as x from f)
select id, x.topic as topic, x.memory_type as memory_type from g""")


_STATE = """state as (select a.file_path, floor(len(a.content) * 0.25)::bigint as tokens, case when b.file_path is null then 'missing' when len(a.content) % 13 = 0 then 'unknown' when sha256(a.content) = sha256(b.content) then 'fresh' else 'stale' end as freshness from snap_a a left join snap_b b using (file_path))"""
_PURPOSE = "case " + " ".join(f"when {_any('t', words)} then '{name}'" for name, words in rp.PURPOSES.items()) + " else 'other' end"
_METADATA = with_views("memories", body="""r as (select * from {0}),
p as (select agent_id, string_agg(distinct x, ',' order by x) as persons from (select agent_id, unnest(persons) as x from r) group by 1)
select agent_id, count(*) as memories, string_agg(distinct topic, ',' order by topic) as topics, coalesce(any_value(p.persons), '') as persons from r left join p using (agent_id) group by 1""").replace("{4,}", "{{4,}}")
SQL = {
    "list_memories": with_views("memories", body="select agent_id, id, rank, total from (select agent_id, id, row_number() over (partition by agent_id order by created_at desc, ord desc) as rank, count(*) over (partition by agent_id) as total from memories where memory_type <> 'working') where rank between 3 and 7"),
    "list_memories_filtered": with_views("memories", body="select agent_id, id, rank, total from (select agent_id, id, row_number() over (partition by agent_id order by created_at desc, ord desc) as rank, count(*) over (partition by agent_id) as total from memories where contains(lower(topic), 'user') and len(list_filter(persons, lambda p: contains(lower(p), 'th'))) > 0) where rank <= 10"),
    "memories_by_bin": with_views("memories", body="select memory_type, id, rank from (select *, row_number() over (partition by memory_type order by ord) as rank from memories) where rank <= 10"),
    "list_logs": with_views("session_events", body="select agent_id, event_id, rank from (select *, row_number() over (partition by agent_id order by ts desc, event_id desc) as rank from session_events where action = 'miss') where rank <= 7"),
    "list_code_files": with_views("code_chunks", body="f as (select file_path, count(*) as chunks from code_chunks group by 1)\nselect * from (select file_path, chunks, row_number() over (order by file_path) as rank, count(*) over () as total from f) where rank between 11 and 30"),
    "lookup_prefix": with_views("memories", body="p as (select distinct substr(id, 1, 3) as prefix from memories)\nselect prefix, arg_min(id, ord) as id from p join memories on starts_with(id, prefix) group by 1"),
    "folder_stats": with_views("chunks", body="select language, count(distinct file_path) as files, sum(octet_length(encode(content)))::bigint as bytes, sum(floor(len(content) * 0.25))::bigint as tokens from chunks group by 1"),
    "list_agents": "select c_nationkey, c_mktsegment, c_custkey, rank from (select *, row_number() over (partition by c_nationkey, c_mktsegment order by c_acctbal desc, c_custkey desc) as rank from customer) where rank <= 3",
    "memory_counts": with_views("memories", body="select agent_id, memory_type, count(*) as n from memories group by grouping sets ((agent_id), (agent_id, memory_type))"),
    "agent_stats": with_views("memories", body="""t as (select agent_id, topic, count(*) as n from memories group by 1, 2),
p as (select agent_id, count(distinct x) as persons from (select agent_id, unnest(persons) as x from memories) group by 1),
l as (select agent_id, count(distinct regexp_extract(content, ' in ([a-z]+)', 1)) as locations from memories where regexp_matches(content, ' in [a-z]+') group by 1),
f as (select (doc_id % 12)::varchar as agent_id, count(*) as documents from documents group by 1)
select t.agent_id, sum(n)::bigint as memories, string_agg(topic || '=' || n, ',' order by topic || '=' || n) as topics, coalesce(any_value(p.persons), 0) as persons, coalesce(any_value(l.locations), 0) as locations, coalesce(any_value(f.documents), 0) as documents
from t left join p using (agent_id) left join l using (agent_id) left join f using (agent_id) group by 1"""),
    "count_logs": with_views("session_events", body="select agent_id, action, count(*) as n from session_events group by 1, 2"),
    "memory_summary": with_views("memories", body="""r as (select *, row_number() over (partition by agent_id order by created_at desc, ord desc) as age from memories),
s as (select *, row_number() over (partition by agent_id, topic order by age) as rn from r where age <= 100)
select agent_id, topic, count(*) as n, string_agg(substr(content, 1, 100), ' | ' order by rn) filter (rn <= 3) as samples from s group by 1, 2"""),
    "memory_summary_focus": with_views("memories", body="""r as (select *, row_number() over (partition by agent_id order by created_at desc, ord desc) as age from memories),
f as (select * from r where age <= 100 and contains(lower(content || ' ' || topic || ' ' || array_to_string(keywords, ' ') || ' ' || array_to_string(persons, ' ')), 'tion')),
s as (select *, row_number() over (partition by agent_id, topic order by age) as rn from f)
select agent_id, topic, count(*) as n, string_agg(substr(content, 1, 100), ' | ' order by rn) filter (rn <= 3) as samples from s group by 1, 2"""),
    "summary_metadata": _METADATA.format("memories"),
    "summary_metadata_focus": _METADATA.format("memories where topic = 'user'"),
    "usage_activity": with_views("chunks", body="f as (select language, file_path, count(*) as n from chunks group by 1, 2)\nselect language, count(*) as files, sum(n)::bigint as chunks, round(avg(n), 1) as mean_chunks from f group by grouping sets ((), (language))"),
    "cache_files": with_views("snapshots", body=_STATE + "\nselect file_path, tokens, freshness from state"),
    "cache_recommendations": with_views("snapshots", body=_STATE + "\nselect case freshness when 'stale' then 'update the files' else 'remove the files from the index' end as advice, count(*) as n from state where freshness in ('stale', 'missing') group by 1 union all select 'read summaries before files', count(*) from state"),
    "what_do_i_know": with_views("memories", body="""r as (select * from (select *, row_number() over (partition by agent_id order by created_at desc, ord desc) as age from memories) where age <= 50),
p as (select agent_id, string_agg(distinct x, ',' order by x) as persons from (select agent_id, unnest(persons) as x from r) group by 1)
select r.agent_id, string_agg(distinct topic, ',' order by topic) as topics, coalesce(any_value(p.persons), '') as persons, string_agg(id, ',' order by age) filter (age <= 5) as recent from r left join p using (agent_id) group by 1"""),
    "categorize_memories": with_views("memories", body="""select agent_id, case when contains(lower(content), 'name') or contains(topic, 'personal') then 'personal_info' when contains(lower(content), 'prefer') or contains(lower(content), 'like') then 'preferences'
when contains(topic, 'date') or contains(lower(content), 'deadline') then 'dates_events' when contains(topic, 'project') or contains(topic, 'work') then 'projects_work' when contains(topic, 'decision') then 'decisions' else 'other' end as category, count(*) as n from memories group by 1, 2"""),
    "group_by_purpose": with_views("chunks", body=f"c as (select language, lower(content || ' ' || summary) as t from chunks)\nselect language, {_PURPOSE} as purpose, count(*) as n from c group by 1, 2"),
    "context_by_topic": with_views("memories", body="r as (select *, row_number() over (partition by agent_id, topic order by ord) as rn from memories)\nselect agent_id, topic, string_agg('- ' || content, chr(10) order by rn) as context from r where rn <= 20 group by 1, 2"),
    "session_rollup": with_views("session_events", body="select agent_id, session_id, count(distinct case when action = 'store' then file_path end) as stored, count(distinct case when action = 'retrieve' then file_path end) as retrieved, sum(tokens)::bigint as tokens, count(*) filter (action = 'hit') as hits, count(*) filter (action = 'miss') as misses from session_events group by 1, 2"),
    "token_savings": with_views("session_events", body="""t as (select agent_id, sum(tokens)::bigint as tokens, count(*) filter (action = 'hit') as hits, count(*) filter (action = 'miss') as misses, count(distinct file_path) as files, count(distinct session_id) as sessions from session_events group by 1)
select agent_id, tokens, hits, misses, case when hits + misses > 0 then round(100.0::double * hits / (hits + misses), 2) else 0 end as hit_rate, files, sessions, coalesce(cached_files, 0) as cached_files, coalesce(cached_tokens, 0) as cached_tokens
from t left join (select agent_id, count(*) as cached_files, sum(tokens)::bigint as cached_tokens from (select agent_id, file_path, arg_max(tokens, {'ts': ts, 'e': event_id}) as tokens from session_events where action = 'store' group by 1, 2) group by 1) using (agent_id)"""),
    "usage_report": with_views("session_events", body="""f as (select agent_id, file_path, count(*) as accesses, sum(tokens)::bigint as tokens, round(avg(tokens), 1) as mean_tokens from session_events group by 1, 2)
select * from (select *, row_number() over (partition by agent_id order by accesses desc, file_path) as rank from f) where rank <= 10"""),
    "freshness": with_views("snapshots", body=_STATE + "\nselect file_path, freshness from state"),
    "cache_stats": with_views("snapshots", body=_STATE + "\nselect freshness, count(*) as files, sum(tokens)::bigint as tokens from state group by 1"),
    "engagement_rollup": "select user_id, count(*) filter (event_type = 'click') as upvotes, count(*) filter (event_type = 'purchase') as runs, arg_max(value, {'ts': ts, 'e': event_id}) filter (event_type = 'signup') as rating from events group by 1",
    "op_latency": "select event_type, count(*) as n, round(avg(value), 4) as mean from events group by 1",
    "auto_remember": _facts(DRIVER_RULES),
    "auto_remember_fixed": _facts(rp.FACT_RULES),
    "should_remember": with_views("memories", body="t as (select id, list_filter([" + ", ".join(f"case when {_any('lower(content)', w)} then '{n}' end" for n, w in DRIVER_ADVICE) + "], lambda x: x is not null) as types from memories)\nselect id, array_to_string(types, ',') as types, round(least(len(types) * 0.3::double + 0.1::double, 1), 2) as confidence from t"),
    "memorable_triggers": with_views("memories", body="t as (select id, list_filter([" + ", ".join(f"'{w}'" for w in DRIVER_TRIGGERS) + "], lambda t: contains(lower(content), t)) as f from memories)\nselect id, array_to_string(f[1:5], ',') as triggers, case when len(f) >= 2 then 'high' when len(f) = 1 then 'medium' else 'low' end as confidence from t"),
}
