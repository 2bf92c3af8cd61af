"""Memory retrieval queries over the driver's tables, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from recollect.functions.text import MEMORY_STOPWORDS, QUERY_STOPWORDS, tokenize_query
from recollect.functions.vectors import normalise
from recollect.operators import maintain as mt
from recollect.operators import memory_search as ms
from recollect.sources import driverdata as dd
from recollect.sources.driverdata import with_views

NOW = "2024-06-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _all(spark, sf_dir):
    return dd.memories(spark, sf_dir), dd.vectors(spark, sf_dir), dd.queries(spark, sf_dir)


def _names(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + "]"


_WORDS = r"list_filter(regexp_split_to_array(lower(query), '[\x20\x09-\x0D]+'), lambda w: len(w) > 2)"
_PARSED = f"""parsed as (select query_id, embedding, case when len(list_filter(ws, lambda w: not list_contains(sw, w))) > 0 then list_filter(ws, lambda w: not list_contains(sw, w)) else ws end as words
 from (select *, {_WORDS} as ws, {_names(MEMORY_STOPWORDS)} as sw from queries))"""
_KEYWORD = (
    _PARSED
    + """,
kraw as (select query_id, id, ord, len(list_filter(words, lambda w: contains(lower(content), w))) as matched,
 ((case when len(words) >= 2 and contains(lower(content), array_to_string(words, ' ')) then 2.0::double else 0 end) + list_sum(list_transform(words, lambda w:
 (case when contains(lower(content), w) then 0.3::double + 0.05::double * len(w) else 0 end)
 + (case when len(list_filter(keywords, lambda k: contains(lower(k), w) or contains(w, lower(k)))) > 0 then 0.6::double else 0 end)
 + (case when contains(lower(topic), w) then 0.4::double else 0 end)
 + (case when len(list_filter(persons, lambda p: contains(lower(p), w))) > 0 then 0.5::double else 0 end))))
 * (0.5::double + len(list_filter(words, lambda w: contains(lower(content), w))) / len(words)::double) * (1.0::double + importance) as raw
 from memories, parsed where len(words) > 0),
keyword as (select query_id, id, ord, round(raw + 1e-9::double, 3) as score from kraw where matched > 0 and raw > 0.3::double + 1e-9::double)"""
)
_SEMANTIC = """semantic as (select * from (select q.query_id, m.id, m.ord, round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 6) as score
 from memories m join vectors v using (id), queries q) where score >= 0)"""


def _hybrid(depth: int, name: str = "hybrid") -> str:
    return f"""st as (select *, score / (case when max(score) over (partition by query_id) = 0 then 1 else max(score) over (partition by query_id) end) as s from
 (select *, row_number() over (partition by query_id order by score desc, ord) as rn from semantic) where rn <= {depth}),
kt as (select *, score / (case when max(score) over (partition by query_id) = 0 then 1 else max(score) over (partition by query_id) end) as s from
 (select *, row_number() over (partition by query_id order by score desc, ord) as rn from keyword) where rn <= {depth}),
{name} as (select coalesce(st.query_id, kt.query_id) as query_id, coalesce(st.id, kt.id) as id, coalesce(st.ord, kt.ord) as ord,
 round(0.6::double * coalesce(st.s, 0) + 0.4::double * coalesce(kt.s, 0) + 1e-9::double, 3) as score from st full join kt on st.query_id = kt.query_id and st.id = kt.id)"""


def _top(source: str, k: int, columns: str = "query_id, id, ord, score, rank") -> str:
    return f"select {columns} from (select *, row_number() over (partition by query_id order by score desc, ord) as rank from {source}) where rank <= {k}"


_BOTH = _KEYWORD + ",\n" + _SEMANTIC
_ANALYZED = rf"""analyzed as (select *, round(least(least(nw / 20.0::double, 0.3) + least(len(keywords) / 10.0::double, 0.2) + least(len(persons) / 5.0::double, 0.2)
 + (case when time_type is not null then 0.1::double else 0 end)
 + (case when len(list_filter(['what', 'when', 'where', 'why', 'how', 'who', 'which'], lambda w: contains(lower(query), w))) > 0 then 0.1::double else 0 end)
 + (case when contains(lower(query), ' and ') or contains(query, ',') then 0.1::double else 0 end), 1), 6) as complexity from (
 select query_id, query, embedding, len(list_filter(ws, lambda w: w <> '')) as nw, list_filter(list_transform(ws, lambda w: lower(w)), lambda w: len(w) > 2 and not list_contains(sw, w)) as keywords,
 list_filter(ws, lambda w: regexp_matches(w, '^[A-Z]') and len(w) > 1 and not list_contains(sw, lower(w))) as persons,
 case when regexp_matches(lower(query), '\btoday\b') then 'today' when regexp_matches(lower(query), '\byesterday\b') then 'yesterday' when regexp_matches(lower(query), '\blast\s+week\b') then 'last_week'
 when regexp_matches(lower(query), '\blast\s+month\b') then 'last_month' when regexp_matches(lower(query), '\bthis\s+week\b') then 'this_week' when regexp_matches(lower(query), '\bthis\s+month\b') then 'this_month'
 when regexp_matches(lower(query), '\brecent(ly)?\b') then 'recent' end as time_type
 from (select *, regexp_split_to_array(query, '[\x20\x09-\x0D]+') as ws, {_names(QUERY_STOPWORDS)} as sw from queries)))"""


def tokenize_query_(spark, sf_dir):
    q = dd.queries(spark, sf_dir)
    return q.select("query_id", F.array_join(tokenize_query(F.col("query")), " ").alias("words"))


def keyword_search(spark, sf_dir):
    m, _, q = _all(spark, sf_dir)
    return ms.keyword_search(m, q, 10)


def keyword_search_typed(spark, sf_dir):
    m, _, q = _all(spark, sf_dir)
    return ms.keyword_search(m, q, 5, "semantic")


def semantic_search(spark, sf_dir):
    return ms.semantic_search(*_all(spark, sf_dir), 10)


def hybrid_search(spark, sf_dir):
    return ms.hybrid_search(*_all(spark, sf_dir), 10)


def batch_search(spark, sf_dir):
    m, v, q = _all(spark, sf_dir)
    return ms.batch_search(m, v, q, 3)


def analyze_query(spark, sf_dir):
    a = ms.analyze_query(dd.queries(spark, sf_dir), _now())
    return a.select("query_id", F.array_join("keywords", " ").alias("keywords"), F.array_join("persons", " ").alias("persons"), "complexity", ms.dynamic_k(F.col("complexity"), 5).cast("long").alias("k"))


def query_complexity(spark, sf_dir):
    return analyze_query(spark, sf_dir).select("query_id", "complexity")


def dynamic_k(spark, sf_dir):
    """Depths for 3, 5 and 20 rows asked for."""
    a = ms.analyze_query(dd.queries(spark, sf_dir), _now())
    return a.select("query_id", *[ms.dynamic_k(F.col("complexity"), k).cast("long").alias(f"k_of_{k}") for k in (3, 5, 20)])


def extract_time_filter(spark, sf_dir):
    """The phrases stand before messages by place, so that each is met."""
    m = dd.memories(spark, sf_dir)
    said = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("today ", "since last  week ", "recently ", "this month ", "")]), (F.col("ord") % 5 + 1).cast("int")), F.col("content"))
    name, start = ms.extract_time_filter(said, _now())
    return m.select("id", name.alias("time_type"), F.datediff(_now(), start).cast("long").alias("days_back"))


def retrieve(spark, sf_dir):
    return ms.retrieve(*_all(spark, sf_dir), _now(), 5)


def symbolic_boost(spark, sf_dir):
    m, v, q = _all(spark, sf_dir)
    a = ms.analyze_query(q, _now())
    return ms.symbolic_boost(ms.hybrid_search(m, v, q, 5).drop("rank"), m, a)


def reflect(spark, sf_dir):
    m, v, q = _all(spark, sf_dir)
    a = ms.analyze_query(q, _now())
    return ms.reflect(m, v, ms.keyword_search(m, q, 3), a, 5)


def pull_context(spark, sf_dir):
    m, _, q = _all(spark, sf_dir)
    return ms.pull_context(ms.keyword_search(m, q, 5), m)


def context_answer(spark, sf_dir):
    m, _, q = _all(spark, sf_dir)
    return ms.context_answer(ms.keyword_search(m, q, 10), m)


def cosine(spark, sf_dir):
    """Cosine of every vector with those whose number is divisible by 20."""
    e = dd.table(spark, sf_dir, "embeddings")
    rows, asked = e.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), "embedding"), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = ms.vector_matches(rows, asked, threshold=-1.0)
    return found.select(F.col("id").alias("vec_id"), "query_id", F.col("score").alias("cosine"))


def normalise_vector(spark, sf_dir):
    e = dd.table(spark, sf_dir, "embeddings")
    n = normalise(F.col("embedding"))
    return e.select("vec_id", F.round(F.element_at(n, 1), 6).alias("first"), F.round(F.aggregate(n, F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"))


def hash_embed(spark, sf_dir):
    """The values of each memory's hashed vector that aren't 0."""
    v = mt.hash_embed(dd.memories(spark, sf_dir).select("id", "content"), 64)
    return v.select("id", F.posexplode("embedding").alias("bucket", "x")).where("x <> 0").select("id", "bucket", F.round("x", 6).alias("value"))


QUERIES = {
    "tokenize_query": tokenize_query_, "keyword_search": keyword_search, "keyword_search_typed": keyword_search_typed, "semantic_search": semantic_search, "hybrid_search": hybrid_search,
    "batch_search": batch_search, "analyze_query": analyze_query, "query_complexity": query_complexity, "dynamic_k": dynamic_k, "extract_time_filter": extract_time_filter, "retrieve": retrieve,
    "symbolic_boost": symbolic_boost, "reflect": reflect, "pull_context": pull_context, "context_answer": context_answer, "cosine": cosine, "normalise_vector": normalise_vector, "hash_embed": hash_embed,
}



def _reflect_sql(first: int, k: int, rounds: int) -> str:
    """Rounds of second looks, one after another: each searches the sub-queries of the queries that still have fewer than k rows."""
    steps = [f"seen_0 as (select query_id, id, ord, score, 0 as round from ({_top('keyword', first)}))", """subs as (select query_id as parent, embedding, unnest(list_concat(list_concat(list_filter(keywords, lambda w: len(w) > 4)[1:1],
 case when len(keywords) >= 2 then [keywords[1] || ' ' || keywords[2]] else []::varchar[] end), persons[1:1])[1:3]) as query from analyzed)"""]
    for r in range(1, rounds + 1):
        steps.append(f"""subs_{r} as (select parent || ':' || query as query_id, parent, query, embedding from subs where parent in
 (select a.query_id from analyzed a left join (select query_id, count(*) as n from seen_{r - 1} group by 1) using (query_id) where coalesce(n, 0) < {k}))""")
        body = _BOTH + ",\n" + _hybrid(3 * k * r)
        for name in ("parsed", "kraw", "keyword", "semantic", "st", "kt", "hybrid"):
            body = re.sub(rf"\b{name}\b", f"{name}_{r}", body)
        steps.append(re.sub(r"\bqueries\b", f"subs_{r}", body))
        again = _top(f"(select * from hybrid_{r} where score >= 0)", k * r)
        steps.append(f"""seen_{r} as (select * from seen_{r - 1} union all select parent, id, ord, round(max(score) * 0.9::double + 1e-9::double, 3), {r} from ({again}) join subs_{r} using (query_id)
 where not exists (select 1 from seen_{r - 1} s where s.query_id = parent and s.id = id_) group by parent, id, ord)""".replace("s.id = id_", "s.id = found.id").replace(f"from ({again}) join", f"from ({again}) found join"))
    return with_views("memories", "vectors", "queries", body=_ANALYZED + ",\n" + _KEYWORD + ",\n" + ",\n".join(steps) + f"\nselect query_id, id, ord, score, round from seen_{rounds}")


_BOOST = """select query_id, id, ord, round(score + 0.2::double * len(list_intersect(list_transform(a.persons, lambda p: lower(p)), list_transform(m.persons, lambda p: lower(p)))) + 1e-9::double, 3) as score"""
_ANALYSIS = with_views("memories", "vectors", "queries", body=_ANALYZED + "\nselect query_id, array_to_string(keywords, ' ') as keywords, array_to_string(persons, ' ') as persons, complexity, greatest(5, least(floor(5 * (1 + complexity)), 15))::bigint as k from analyzed")
SQL = {
    "tokenize_query": with_views("queries", body=_PARSED + "\nselect query_id, array_to_string(words, ' ') as words from parsed"),
    "keyword_search": with_views("memories", "queries", body=_KEYWORD + "\n" + _top("keyword", 10)),
    "keyword_search_typed": with_views("memories", "queries", body=_KEYWORD + "\n" + _top("(select k.* from keyword k join memories m using (id) where memory_type = 'semantic')", 5)),
    "semantic_search": with_views("memories", "vectors", "queries", body=_SEMANTIC + "\n" + _top("semantic", 10)),
    "hybrid_search": with_views("memories", "vectors", "queries", body=_BOTH + ",\n" + _hybrid(30) + "\n" + _top("hybrid", 10)),
    "batch_search": with_views("memories", "vectors", "queries", body=_BOTH + ",\n" + _hybrid(9) + "\n" + _top("hybrid", 3)),
    "reflect": _reflect_sql(3, 5, 2),
    "analyze_query": _ANALYSIS, "query_complexity": f"select query_id, complexity from ({_ANALYSIS})",
    "dynamic_k": "select query_id, " + ", ".join(f"greatest({k}, least(floor({k} * (1 + complexity)), {3 * k}))::bigint as k_of_{k}" for k in (3, 5, 20)) + f" from ({_ANALYSIS})",
    "extract_time_filter": with_views("memories", body=r"""said as (select id, lower(['today ', 'since last  week ', 'recently ', 'this month ', ''][ord % 5 + 1] || content) as t from memories),
named as (select id, case when regexp_matches(t, '\btoday\b') then 'today' when regexp_matches(t, '\byesterday\b') then 'yesterday' when regexp_matches(t, '\blast\s+week\b') then 'last_week' when regexp_matches(t, '\blast\s+month\b') then 'last_month'
 when regexp_matches(t, '\bthis\s+week\b') then 'this_week' when regexp_matches(t, '\bthis\s+month\b') then 'this_month' when regexp_matches(t, '\brecent(ly)?\b') then 'recent' end as time_type from said)
select id, time_type, case time_type when 'today' then 0 when 'yesterday' then 1 when 'last_week' then 7 when 'last_month' then 30 when 'this_week' then 7 when 'this_month' then 30 when 'recent' then 7 end::bigint as days_back from named"""),
    "retrieve": with_views("memories", "vectors", "queries", body=_BOTH + ",\n" + _ANALYZED + ",\n" + _hybrid(45) + """,
deep as (select h.* from (select *, row_number() over (partition by query_id order by score desc, ord) as rn from hybrid) h join analyzed a using (query_id) where rn <= greatest(5, least(floor(5 * (1 + complexity)), 15))),
boosted as (""" + _BOOST + " from deep d join analyzed a using (query_id) join memories m using (id, ord))\n" + _top("boosted", 5)),
    "symbolic_boost": with_views("memories", "vectors", "queries", body=_BOTH + ",\n" + _ANALYZED + ",\n" + _hybrid(15) + ",\ntop as (" + _top("hybrid", 5) + ")\n" + _BOOST + " from top d join analyzed a using (query_id) join memories m using (id, ord)"),
    "pull_context": with_views("memories", "queries", body=_KEYWORD + ",\ntop as (" + _top("keyword", 5) + """),
firsts as (select content, min({'query_id': query_id, 'rank': rank, 'id': id}) as f from top join memories using (id) group by content)
select * from (select row_number() over (order by f.query_id, f.rank, f.id) as place, f.id as id, content from firsts) where place <= 20"""),
    "context_answer": with_views("memories", "queries", body=_KEYWORD + ",\ntop as (" + _top("keyword", 10) + ")\nselect query_id, rank, id, content, substr(content, 1, 100) as source from top join memories using (id)"),
    "cosine": "select e.vec_id, q.vec_id as query_id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) as cosine from embeddings e, embeddings q where q.vec_id % 20 = 0",
    "normalise_vector": """select vec_id, round(embedding[1]::double / sqrt(s), 6) as first, round(list_sum(list_transform(embedding, lambda x: (x::double / sqrt(s)) * (x::double / sqrt(s)))), 6) as length
from (select *, list_sum(list_transform(embedding, lambda x: x::double * x::double)) as s from embeddings)""",
    "hash_embed": with_views("memories", body="w as (select id, unnest(regexp_extract_all(lower(content), '[a-z]+')) as w from memories)\nselect id, bucket, round(n / sqrt(sum(n * n) over (partition by id)), 6) as value from (select id, (('0x' || substr(md5(w), 1, 8))::bigint % 64)::int as bucket, count(*) as n from w group by 1, 2)"),
}
