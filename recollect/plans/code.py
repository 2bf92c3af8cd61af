"""Code search queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions.tables import dealt_out, written
from recollect.functions.text import CODE_STOPWORDS
from recollect.operators import chunks as ch
from recollect.operators import code_search as cs
from recollect.sources import driverdata as dd
from recollect.sources.driverdata import with_views

#: A small table of concepts for the driver's words.
CONCEPTS = {"the": ["that"], "anan": ["thanan", "inan"], "tion": ["ention"]}


def _chunks(spark, sf_dir):
    return dd.chunks(spark, sf_dir)


def _vectors(spark, sf_dir):
    e = dd.table(spark, sf_dir, "embeddings")
    n = e.agg(F.count("*").alias("n"))
    c = _chunks(spark, sf_dir).select("ord").crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("ord") % F.col("n"))  # one row
    return c.join(e.select("vec_id", "embedding").hint("merge"), "vec_id").select("ord", "embedding")


def _queries(spark, sf_dir):
    """Whole benchmark texts with a line, a broad word, a file or a route by item."""
    q = dd.questions(spark, sf_dir)
    kind = F.pmod("query_id", F.lit(4))
    text = F.when(kind == 0, F.concat("query", F.lit(" line 3"))).when(kind == 1, F.concat(F.lit("list "), "query")).when(kind == 2, F.concat("query", F.lit(" d12.md"))).otherwise(F.concat(F.lit("tion/of "), "query"))
    return q.withColumn("query", text)


def parse_code_query(spark, sf_dir):
    q = cs.prepared_queries(_queries(spark, sf_dir), 5, CONCEPTS)
    join = lambda c: F.array_join(F.array_sort(c), " ").alias(c)
    return q.select("query_id", "text", "file_filter", join("routes"), join("terms"), join("wanted"), F.array_join(F.transform("lines", lambda n: n.cast("string")), " ").alias("lines"), "intent", "alpha", "depth")


def term_idf(spark, sf_dir):
    q = cs.prepared_queries(_queries(spark, sf_dir), 5, CONCEPTS)
    return cs.term_idf(cs.lowered(dealt_out(_chunks(spark, sf_dir))), q).select("query_id", "term", F.round("idf", 6).alias("idf"))


def code_hybrid_search(spark, sf_dir):
    return cs.code_hybrid_search(_chunks(spark, sf_dir), _vectors(spark, sf_dir), _queries(spark, sf_dir), 5, CONCEPTS)


def line_proximity(spark, sf_dir):
    c = dd.code_chunks(spark, sf_dir)
    return c.select("ord", F.round(cs.line_proximity(F.col("start_line"), F.col("start_line") + 3, F.array(F.lit(3), F.lit(40), F.lit(75))), 6).alias("boost"))


def trace_calls(spark, sf_dir):
    c = dd.code_chunks(spark, sf_dir)
    found = c.select((F.col("ord") % 40).alias("query_id"), "ord", F.floor(F.col("ord") / 40).alias("rank"))
    return cs.trace_calls(found, c)


def symbol_references(spark, sf_dir):
    c = written(dealt_out(_chunks(spark, sf_dir)), "chunks")  # read several times
    symbols = dd.questions(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("query"), F.lit("([a-z]{9,})"), F.lit(1))).alias("symbol"))
    r = cs.symbol_references(c, ch.build_symbol_index(c), symbols)
    return r.select("symbol", "ord", "reason", F.sha2("context", 256).alias("context_sha256"))


def evaluate_retrieval(spark, sf_dir):
    """The names expected of a query are those of memories by place; found are the hybrid search's rows."""
    from recollect.operators import memory_search as ms

    m, q = dd.memories(spark, sf_dir), dd.queries(spark, sf_dir)
    nine = ms.keyword_search(m, q, 9)  # which begin with the five
    found = nine.where("rank <= 5").select("query_id", F.col("id").alias("name"), "rank")
    e = nine.where("rank % 2 = 1").select("query_id", F.concat(F.lit("c"), (F.col("query_id") % 5).cast("string")).alias("category"), F.col("id").alias("name"))
    return cs.evaluate_retrieval(found, e)


QUERIES = {
    f.__name__: f for f in (parse_code_query, term_idf, code_hybrid_search, line_proximity, trace_calls, symbol_references, evaluate_retrieval)
}
_VIEWS = {"broad_intent": ["depth"], "detect_intent": ["intent", "alpha"], "extract_line_numbers": ["lines"], "expand_concepts": ["terms", "wanted"]}


def _view(columns):
    return lambda spark, sf_dir: parse_code_query(spark, sf_dir).select("query_id", *columns)


QUERIES |= {n: _view(columns) for n, columns in _VIEWS.items()}

_SW = "[" + ", ".join(f"'{w}'" for w in CODE_STOPWORDS) + "]"
_DEC = "list_distinct(list_concat(list_transform(list_filter(list_concat(regexp_extract_all({0}, '[a-z]+'), regexp_split_to_array({0}, '[_.]')), lambda p: len(p) > 1), lambda p: lower(p)), [lower({0})]))"
_PARSED = rf"""cq as (select query_id, embedding, case query_id % 4 when 0 then query || ' line 3' when 1 then 'list ' || query when 2 then query || ' d12.md' else 'tion/of ' || query end as query, query_id % 4 as kind from questions),
ct as (select *, case when kind = 2 then trim(replace(query, 'd12.md', '')) else query end as text, case when kind = 2 then 'd12.md' end as file_filter, case when kind = 3 then ['tion/of'] else []::varchar[] end as routes from cq),
cw as (select *, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws from ct),
cb as (select *, list_filter(list_transform(ws, lambda w: regexp_replace(w, '^[!-/:-@\[-`{{-~]+|[!-/:-@\[-`{{-~]+$', '', 'g')), lambda w: w <> '' and not list_contains({_SW}, w)) as plain, list_filter(ws, lambda w: not list_contains({_SW}, w)) as words from cw),
cs as (select *, list_sort(list_distinct(list_filter(flatten(list_transform(plain, lambda w: {_DEC.format("w")})), lambda w: w <> ''))) as terms from cb),
code_queries as (select *, list_distinct(list_concat(terms, case when list_contains(terms, 'the') then ['that'] else [] end, case when list_contains(terms, 'anan') then ['thanan', 'inan'] else [] end, case when list_contains(terms, 'tion') then ['ention'] else [] end,
 case when kind = 3 then ['tion'] else [] end)) as wanted, case when kind = 0 then [3] else [] end as lines,
 case when kind = 0 then 'line' when regexp_matches(lower(text), '\b(all|every|list|show me|overview)\b') then 'broad' when regexp_matches(lower(text), '\b(how is|where is|which.*use|interact|call)\b') then 'usage' when len(words) <= 2 then 'symbol' else 'concept' end as intent,
 case when list_has_any(ws, ['all', 'every', 'list', 'show', 'related', 'overview', 'relevant', 'associated', 'connected', 'involved']) then 8 else 5 end as depth from cs)"""
_ALPHA = "case intent when 'line' then 0.30::double when 'broad' then 0.45::double when 'usage' then 0.40::double when 'symbol' then 0.35::double else 0.55::double end"
_BAGS = f"""bags as (select *, lower(name) as l_name, lower(summary) as l_summary, lower(content) as l_content, lower(file_path) as l_path, {_DEC.format("lower(name)")} as name_parts,
 list_distinct(regexp_extract_all(lower(summary), '[a-z0-9_]+')) as summary_words, list_distinct(regexp_extract_all(lower(content), '[a-z0-9_]+')) as content_words from chunks),
bagged as (select *, list_distinct(list_concat(list_concat(keywords, summary_words), list_concat(content_words, list_concat(name_parts, [l_name])))) as bag from bags)"""
_IDF = """wt as (select query_id, file_filter, term, list_contains(terms, term) as original from (select query_id, file_filter, terms, unnest(list_distinct(list_concat(wanted, terms))) as term from code_queries)),
words_ as (select ord, l_path, w, list_contains(summary_words, w) as in_summary, list_contains(content_words, w) as in_content, list_contains(name_parts, w) as in_name
 from (select ord, l_path, summary_words, content_words, name_parts, unnest(bag) as w from bagged) where w in (select term from wt)),
met as (select query_id, ord, term, original, in_summary, in_content, in_name from words_ join wt on w = term and (file_filter is null or contains(l_path, file_filter))),
df as (select query_id, term, count(*) as df from met where original group by 1, 2),
tn as (select query_id, count(*) as n from bagged, code_queries where file_filter is null or contains(l_path, file_filter) group by 1),
idf as (select q.query_id, q.term, ln((greatest(coalesce(n, 0), 1) + 1)::double / (coalesce(df, 0) + 1)) + 1 as idf from (select query_id, unnest(terms) as term from code_queries) q left join df using (query_id, term) left join tn using (query_id)),
idfs as (select query_id, sum(idf) as total from idf group by 1),
hits as (select query_id, ord, coalesce(sum(idf) filter (original), 0) as hit_idf, count(*) as n_hits, count(*) filter (not original) as n_extra, count(*) filter (original and in_summary) as n_summary,
 count(*) filter (original and in_content) as n_content, count(*) filter (in_name) as n_name from met left join idf using (query_id, term) group by 1, 2)"""
_PARSE_SQL = with_views("questions", body=_PARSED + f"""
select query_id, text, file_filter, array_to_string(routes, ' ') as routes, array_to_string(terms, ' ') as terms, array_to_string(list_sort(wanted), ' ') as wanted, array_to_string(lines, ' ') as lines, intent, {_ALPHA} as alpha, depth from code_queries""")
_SEARCH_SQL = with_views("questions", "chunks", body=_PARSED + ",\n" + _BAGS + ",\n" + _IDF + f""",
n as (select count(*) as n from embeddings),
pairs as (select q.query_id, b.ord, file_path, name, depth, {_ALPHA} as alpha,
 round(greatest(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 0), 6) as close,
 case when coalesce(n_hits, 0) > 0 then least(1.0::double, hit_idf / i.total * 0.7 + n_extra * 0.3::double * 0.1) else 0 end
 + case when list_contains(wanted, l_name) then 0.8::double when coalesce(n_name, 0) > 0 then 0.5 when len(list_filter(wanted, lambda w: contains(l_name, w))) > 0 then 0.4 else 0 end
 + coalesce(n_summary, 0) / greatest(len(terms), 1)::double * 0.4 + least(0.35::double, coalesce(n_content, 0) / greatest(len(terms), 1)::double * 0.35)
 + case when len(list_filter(routes, lambda r: contains(l_content, r) or contains(l_summary, r))) > 0 then 0.6 else 0 end
 + case when list_has_any(wanted, ['block', 'blocks']) then 0.2 else 0 end
 + case when len(list_filter(range(1, len(words)), lambda k: contains(l_summary, words[k] || ' ' || words[k + 1]))) > 0 then 0.25 else 0 end as signals,
 coalesce(list_max(list_transform(lines, lambda l: case when l between start_line and end_line then 0.5::double + 0.4::double * least(1.0, 20.0::double / greatest(end_line - start_line, 1)) when abs(l - start_line) <= 10 or abs(l - end_line) <= 10 then 0.3::double else 0 end)), 0) as line
 from bagged b cross join code_queries q cross join n join embeddings e on e.vec_id = b.ord % n.n join idfs i on i.query_id = q.query_id left join hits h on h.query_id = q.query_id and h.ord = b.ord where file_filter is null or contains(l_path, file_filter)),
scored as (select *, round(close * alpha + least(1.0, signals) * (1 - alpha) + line + 1e-9::double, 3) as score from pairs)
select query_id, ord, file_path, name, score, rank from (select *, row_number() over (partition by query_id order by score desc, ord) as rank from scored where close * alpha + least(1.0, signals) * (1 - alpha) + line > 0.01::double + 1e-9::double) where rank <= depth""")
SQL = {"parse_code_query": _PARSE_SQL} | {n: f"select query_id, {', '.join(columns)} from ({_PARSE_SQL})" for n, columns in _VIEWS.items()}
SQL |= {
    "term_idf": with_views("questions", "chunks", body=_PARSED + ",\n" + _BAGS + ",\n" + _IDF + "\nselect query_id, term, round(idf, 6) as idf from idf"),
    "code_hybrid_search": _SEARCH_SQL,
    "line_proximity": with_views("code_chunks", body="""s as (select ord, start_line as a, start_line + 3 as b, unnest([3, 40, 75]) as n from code_chunks)
select ord, round(max(case when n between a and b then 0.5::double + 0.4::double * least(1.0, 20.0::double / greatest(b - a, 1)) when abs(n - a) <= 10 or abs(n - b) <= 10 then 0.3::double else 0 end), 6) as boost from s group by 1"""),
    "trace_calls": with_views("code_chunks", body="select ord % 40 as query_id, ord // 40 as rank, 0 as place, name as what from code_chunks union all select ord % 40, ord // 40, 1, target from code_chunks"),
    "symbol_references": with_views("questions", "chunks", body="""idx as (select distinct symbol as key, file_path from (select lower(name) as symbol, file_path from chunks union all select unnest(keywords), file_path from chunks) where len(symbol) > 1),
s as (select distinct unnest(regexp_extract_all(lower(query), '[a-z]{9,}')) as symbol from questions),
f as (select distinct symbol, file_path from idx join s on contains(key, symbol) or contains(symbol, key))
select s.symbol, ord, case when lower(name) = s.symbol then 'definition' when list_contains(keywords, s.symbol) then 'keyword' else 'usage' end as reason, sha256(case when len(content) > 200 then substr(content, 1, 200) || '...' else content end) as context_sha256
from chunks c join s on contains(lower(name), s.symbol) or list_contains(keywords, s.symbol) or (contains(lower(content), s.symbol) and (s.symbol, c.file_path) in (select symbol, file_path from f))"""),
}
from recollect.plans.memory import _KEYWORD, _top  # noqa: E402

SQL["evaluate_retrieval"] = with_views("memories", "queries", body=_KEYWORD + ",\nfound as (" + _top("keyword", 5) + "),\nmore as (" + _top("keyword", 9) + """),
expected as (select query_id, 'c' || query_id % 5 as category, id from more where rank % 2 = 1),
each as (select e.query_id, category, count(f.id) / count(*)::double * 100 as relevance, coalesce(sum(greatest(0, 6 - f.rank) / 5.0::double), 0) / count(*) * 100 as position from expected e left join found f using (query_id, id) group by 1, 2),
t as (select category, count(*) as queries, count(*) filter (relevance >= 40) as passed, round(avg(relevance), 2) as relevance, round(avg(position), 2) as position from each group by 1)
select *, case when relevance >= 70 then 'good' when relevance >= 50 then 'fair' else 'poor' end as verdict from t""")
