"""Chunk pipeline queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions.tables import dealt_out
from recollect.functions.text import decompose_identifier, detect_language, estimate_tokens, normalise_hash, number_lines
from recollect.operators import chunks as ch
from recollect.sources import driverdata as dd
from recollect.sources.driverdata import with_views


def _hashed(spark, sf_dir):
    return dd.chunks(spark, sf_dir).withColumn("hash_id", normalise_hash(F.col("content")))


def _files(spark, sf_dir):
    return dd.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.coalesce("text", F.lit("")).alias("content"))


def _enriched(spark, sf_dir):
    c = dealt_out(dd.code_chunks(spark, sf_dir))
    return c.withColumn("keywords", ch.enriched_keywords(F.col("name"), F.col("type"), F.col("content"), F.col("summary"), F.array().cast("array<string>")))


def detect_language_(spark, sf_dir):
    p = dd.table(spark, sf_dir, "pages").select("page_id", "url")
    ends = F.array(*[F.lit(x) for x in (".py", ".TS", ".rs", ".yml", ".xyz", "")])
    path = F.concat(F.regexp_extract("url", "^([^?#]*)", 1), F.element_at(ends, (F.col("page_id") % 6 + 1).cast("int")))
    return p.select("page_id", detect_language(path).alias("language"))


def chunk_whole(spark, sf_dir):
    return ch.chunk_whole(_files(spark, sf_dir)).select("file_path", "type", F.sha2("content", 256).alias("content_sha256"), "start_line", "end_line")


def chunk_lines(spark, sf_dir):
    c = ch.chunk_lines(_files(spark, sf_dir), 3)
    return c.select("file_path", F.sha2("content", 256).alias("content_sha256"), "start_line", "end_line")


def ingest_chunks(spark, sf_dir):
    c = dd.chunks(spark, sf_dir)
    sparse = F.col("ord") % 3 == 0
    c = c.withColumns({x: F.when(~sparse, F.col(x)) for x in ("type", "summary", "keywords", "start_line", "end_line")})
    return ch.ingest_chunks(c).select("ord", "type", "summary", F.size("keywords").cast("long").alias("n_keywords"), "start_line", "end_line", "hash_id", "token_count")


def number_lines_(spark, sf_dir):
    return dd.chunks(spark, sf_dir).select("ord", F.sha2(number_lines(F.col("content"), F.col("start_line")), 256).alias("numbered_sha256"))


def normalise_hash_(spark, sf_dir):
    return _hashed(spark, sf_dir).select("ord", "hash_id")


def estimate_tokens_(spark, sf_dir):
    return dd.chunks(spark, sf_dir).select("ord", estimate_tokens(F.col("content")).alias("tokens"))


def dedup_chunks(spark, sf_dir):
    return ch.dedup_chunks(_hashed(spark, sf_dir)).select("hash_id", "ord", "file_path", "name")


def dup_report(spark, sf_dir):
    return ch.dup_report(_hashed(spark, sf_dir))


def enrich_keywords(spark, sf_dir):
    return _enriched(spark, sf_dir).select("ord", F.array_join("keywords", " ").alias("keywords"))


def decompose(spark, sf_dir):
    return dd.table(spark, sf_dir, "customer").select("c_custkey", F.array_join(decompose_identifier(F.concat(F.lit("getCustomer_"), F.col("c_mktsegment"), F.lit(".loadRow"))), " ").alias("parts"))


def qa_hints(spark, sf_dir):
    return _enriched(spark, sf_dir).select("ord", F.array_join(ch.qa_hints(F.col("name"), F.col("type"), F.col("content"), F.col("summary")), "|").alias("hints"))


def embedding_text(spark, sf_dir):
    c = _enriched(spark, sf_dir).withColumn("end_line", F.col("start_line") + 3)
    return c.select("ord", ch.embedding_text(c).alias("text"))


def build_symbol_index(spark, sf_dir):
    return ch.build_symbol_index(dd.chunks(spark, sf_dir))


def refresh_symbol_index(spark, sf_dir):
    """The index of all chunks, with the files of every other document indexed anew from their first window alone."""
    c = dd.chunks(spark, sf_dir)
    return ch.refresh_symbol_index(ch.build_symbol_index(c), c.where("ord % 1000 = 0 and floor(ord / 1000) % 2 = 0"))


def build_skeleton(spark, sf_dir):
    return ch.build_skeleton(dd.chunks(spark, sf_dir))


def build_skeleton_json(spark, sf_dir):
    return ch.skeleton_json(dd.chunks(spark, sf_dir))


def summarize_file_normal(spark, sf_dir):
    """Outlines of version A's chunks with the freshness of their files by language: those of `en` are stale."""
    c = dd.chunks(spark, sf_dir)
    state = c.select("file_path", F.when(F.col("language") == "en", "stale").otherwise("fresh").alias("freshness")).where("file_path not like '%3.md'").distinct()
    return ch.summarize_file_normal(c, state).select("file_path", F.sha2("outline", 256).alias("outline_sha256"), "freshness")


def summarize_file_detailed(spark, sf_dir):
    return ch.summarize_file_detailed(dd.chunks(spark, sf_dir)).select("file_path", "total_chunks", F.sha2("chunks", 256).alias("chunks_sha256"))


def compression_ratio(spark, sf_dir):
    return ch.compression_ratio(dd.chunks(spark, sf_dir))


def summarize_file(spark, sf_dir):
    return ch.summarize_file(dd.code_chunks(spark, sf_dir))


QUERIES = {
    "detect_language": detect_language_, "chunk_whole": chunk_whole, "chunk_lines": chunk_lines, "ingest_chunks": ingest_chunks, "number_lines": number_lines_, "normalise_hash": normalise_hash_,
    "estimate_tokens": estimate_tokens_, "dedup_chunks": dedup_chunks, "dup_report": dup_report, "enrich_keywords": enrich_keywords, "decompose_identifier": decompose, "qa_hints": qa_hints,
    "embedding_text": embedding_text, "build_symbol_index": build_symbol_index, "refresh_symbol_index": refresh_symbol_index, "build_skeleton": build_skeleton, "build_skeleton_json": build_skeleton_json, "summarize_file_normal": summarize_file_normal, "summarize_file_detailed": summarize_file_detailed, "compression_ratio": compression_ratio,
    "summarize_file": summarize_file,
}

_HASH = "hashed as (select *, sha256(trim(regexp_replace(content, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) as hash_id from chunks)"
_NUMBERED = "array_to_string(list_transform(string_split(content, chr(10)), lambda x, i: 'line:' || (i - 1 + coalesce(start_line, 0)) || ' ' || x), ' ')"
_INDEX = "symbols as (select distinct symbol, file_path from (select lower(name) as symbol, file_path from {0} union all select unnest(keywords) as symbol, file_path from {0}) where len(symbol) > 1)"
_KW = """enriched as (select *, list_sort(list_distinct(list_filter(list_concat([name, 'part', regexp_extract(name, '_(\\d+)', 1), 'app.route', 'query', kind_, kind_ || '_table', '/' || kind_, kind_, 'route', 'app', 'db', 'function', 'reads'],
 case when target like 'm%' then ['m' || regexp_extract(target, '^m(\\d+)', 1), split_part(target, '.', 2)] else [] end, case when regexp_matches(summary, 'Brand') then ['brand'] else [] end), lambda k: len(k) > 1))) as keywords from
 (select *, regexp_extract(content, 'query\\(''([a-z]+)''', 1) as kind_ from code_chunks))"""
_OUTLINES = """outlines as (select file_path, any_value(language) as language, to_json({'type': 'start', 'content': 'File: ' || regexp_extract(file_path, '([^/]*)$', 1), 'line': 1,
 'children': list_append(list({'type': 'processing', 'content': case when len(summary) > 0 then summary else substr(content, 1, 60) end, 'line': start_line::bigint} order by ord), {'type': 'end', 'content': 'End of File', 'line': arg_max(end_line, ord)::bigint})})::varchar as outline from chunks group by 1)"""
SQL = {
    "detect_language": """select page_id, coalesce(map {'.py': 'python', '.ts': 'typescript', '.rs': 'rust', '.yml': 'yaml', '.html': 'html', '.xml': 'xml', '.md': 'markdown', '.json': 'json', '.php': 'php', '.js': 'javascript', '.css': 'css'}[regexp_extract(lower(regexp_extract(url, '^([^?#]*)', 1) || ['.py', '.TS', '.rs', '.yml', '.xyz', ''][page_id % 6 + 1]), '(\\.[^./]+)$', 1)], 'other') as language from pages""".replace("\\\\", "\\"),
    "chunk_whole": "select 'd' || doc_id || '.md' as file_path, 'file' as type, sha256(coalesce(text, '')) as content_sha256, 1 as start_line, len(string_split(coalesce(text, ''), chr(10)))::int as end_line from documents",
    "chunk_lines": """select 'd' || doc_id || '.md' as file_path, sha256(array_to_string(l[w * 3 + 1:w * 3 + 3], chr(10))) as content_sha256, (w * 3 + 1)::int as start_line, (w * 3 + len(l[w * 3 + 1:w * 3 + 3]))::int as end_line
from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents), unnest(range(0, (len(l) - 1) // 3 + 1)) as t(w)""",
    "ingest_chunks": with_views("chunks", body=f"""sparse as (select ord, content, case when ord % 3 <> 0 then type end as type, case when ord % 3 <> 0 then summary end as summary, case when ord % 3 <> 0 then keywords end as keywords, case when ord % 3 <> 0 then start_line end as start_line, case when ord % 3 <> 0 then end_line end as end_line from chunks)
select ord, coalesce(type, 'block') as type, coalesce(summary, '') as summary, coalesce(len(keywords), 0)::bigint as n_keywords, coalesce(start_line, 0)::int as start_line, coalesce(end_line, 0)::int as end_line,
sha256(trim(regexp_replace(content, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) as hash_id, floor(len({_NUMBERED}) * 0.25)::bigint as token_count from sparse"""),
    "number_lines": with_views("chunks", body=f"select ord, sha256({_NUMBERED}) as numbered_sha256 from chunks"),
    "normalise_hash": with_views("chunks", body=_HASH + "\nselect ord, hash_id from hashed"),
    "estimate_tokens": with_views("chunks", body="select ord, floor(len(content) * 0.25)::bigint as tokens from chunks"),
    "dedup_chunks": with_views("chunks", body=_HASH + "\nselect hash_id, min(ord) as ord, arg_min(file_path, ord) as file_path, arg_min(name, ord) as name from hashed group by 1"),
    "dup_report": with_views("chunks", body=_HASH + "\nselect hash_id, count(*) as n_chunks, count(distinct file_path) as n_files from hashed group by 1 having count(*) > 1"),
    "enrich_keywords": with_views("code_chunks", body=_KW + "\nselect ord, array_to_string(keywords, ' ') as keywords from enriched"),
    "decompose_identifier": "select c_custkey, array_to_string(list_sort(list_distinct(list_concat(['get', 'customer', 'load', 'row', 'getcustomer', 'loadrow', lower('getCustomer_' || c_mktsegment || '.loadRow'), lower(c_mktsegment)], []::varchar[]))), ' ') as parts from customer",
    "qa_hints": with_views("code_chunks", body="""select ord, 'What does ' || name || ' do?|How does ' || name || ' work?|Which functions interact with the ' || k || ' table?|How is the ' || k || ' table used?' as hints
from (select ord, name, regexp_extract(content, 'query\\(''([a-z]+)''', 1) as k from code_chunks)"""),
    "embedding_text": with_views("code_chunks", body=_KW + """
select ord, array_to_string(['function ' || name, summary, substr(content, 1, 600), 'Decorators: @app.route(''/' || kind_ || ''')', 'Database tables: ' || kind_,
'Related questions: What does ' || name || ' do? | How does ' || name || ' work? | Which functions interact with the ' || kind_ || ' table? | How is the ' || kind_ || ' table used?',
'Keywords: ' || array_to_string(keywords, ', '), 'Lines: ' || start_line || '-' || (start_line + 3)], chr(10)) as text from enriched"""),
    "build_symbol_index": with_views("chunks", body=_INDEX.format("chunks") + "\nselect symbol, file_path from symbols"),
    "refresh_symbol_index": with_views("chunks", body="fresh as (select * from chunks where ord % 1000 = 0 and (ord // 1000) % 2 = 0),\nmixed as (select * from fresh union all select * from chunks where file_path not in (select file_path from fresh)),\n" + _INDEX.format("mixed") + "\nselect symbol, file_path from symbols"),
    "build_skeleton": with_views("chunks", body="""n as (select file_path, count(*)::int as n from chunks group by 1)
select file_path, 0 as node, 'start' as kind, '' as label from n union all select file_path, (n + 1)::int, 'end', '' from n
union all select file_path, row_number() over (partition by file_path order by ord)::int, 'processing', case when len(summary) > 0 then summary else substr(content, 1, 60) end from chunks"""),
    "build_skeleton_json": with_views("chunks", body=_OUTLINES + "\nselect file_path, outline from outlines"),
    "summarize_file_normal": with_views("chunks", body=_OUTLINES + """
select file_path, sha256(outline) as outline_sha256, case when file_path like '%3.md' then 'unknown' when language = 'en' then 'stale' else 'fresh' end as freshness from outlines"""),
    "summarize_file_detailed": with_views("chunks", body="""j as (select file_path, count(*) as total_chunks, to_json(list({'name': name, 'type': type, 'content': content, 'summary': summary, 'keywords': keywords} order by ord))::varchar as chunks from chunks group by 1)
select file_path, total_chunks, sha256(chunks) as chunks_sha256 from j"""),
    "compression_ratio": with_views("chunks", body="""t as (select file_path, sum(floor(len(content) * 0.25))::bigint as original, sum(floor(len(case when len(summary) > 0 then summary else substr(content, 1, 60) end) * 0.25))::bigint as skeleton from chunks group by 1)
select *, case when original > 0 then round(1 - skeleton::double / original, 4) else 0 end as ratio from t"""),
    "summarize_file": with_views("code_chunks", body="""r as (select *, row_number() over (partition by file_path order by ord) as rn from code_chunks)
select file_path, 'function=' || count(*) as types, string_agg(name, ',' order by ord) filter (rn <= 8) as names from r group by 1"""),
}
SQL = {k: v.replace("\\\\", "\\") for k, v in SQL.items()}
