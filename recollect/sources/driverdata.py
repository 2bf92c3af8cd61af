"""Views of the driver's tables as memories, chunks, vectors, sessions, modules and queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    first = F.regexp_extract(text, "^([A-Z][a-z]+)", 1)
    kinds = F.array(*[F.lit(x) for x in ("episodic", "semantic", "procedural", "working")])
    return t.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"),
        (F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("id"),
        (F.col("conv_id") % 10).cast("string").alias("agent_id"),
        text.alias("content"),
        F.element_at(kinds, (F.col("turn") % 4 + 1).cast("int")).alias("memory_type"),
        F.slice(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{4,})"), F.lit(1))), 1, 5).alias("keywords"),
        F.when(first != "", F.array(first)).otherwise(F.array().cast("array<string>")).alias("persons"),
        F.col("role").alias("topic"),
        ((F.col("conv_id") % 10) / F.lit(10.0)).alias("importance"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("conv_id") * 60 + F.col("turn")).cast("int"))).alias("created_at"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding) of the memories: the vector whose vec_id is the place number modulo the number of vectors."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.count("*").alias("n"))
    ids = memories(spark, sf_dir).select("id", "ord").crossJoin(F.broadcast(n))  # one row
    return ids.withColumn("vec_id", F.col("ord") % F.col("n")).join(e.select("vec_id", "embedding").hint("merge"), "vec_id").select("id", "embedding")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, embedding): the whole text and the vector of each memory of a conversation whose number is divisible by 20."""
    asked = memories(spark, sf_dir).where(F.floor(F.col("ord") / 1000) % 20 == 0).select(F.col("ord").alias("query_id"), "id", F.col("content").alias("query"))
    return asked.join(vectors(spark, sf_dir).hint("merge"), "id").select("query_id", "query", "embedding")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, embedding): the whole text of each benchmark item, and a vector by item_id."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.count("*").alias("n"))
    b = table(spark, sf_dir, "benchmark").crossJoin(F.broadcast(n))  # one row
    q = b.select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"), (F.col("item_id") % F.col("n")).alias("vec_id"))
    return q.join(e.select("vec_id", "embedding").hint("merge"), "vec_id").drop("vec_id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 5 lines of the documents."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    d = table(spark, sf_dir, "documents").withColumn("lines", lines)
    w = d.select("doc_id", "lang", "lines", F.explode(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 5).cast("int"))).alias("w"))
    part = F.slice("lines", F.col("w") * 5 + 1, F.lit(5))
    w = w.select("doc_id", "lang", "w", part.alias("part"))
    content = F.array_join("part", "\n")
    return w.select(
        (F.col("doc_id") * 1000 + F.col("w")).alias("ord"),
        F.concat_ws("/", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("file_path"),
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("w").cast("string")).alias("name"),
        F.lit("block").alias("type"),
        content.alias("content"),
        F.element_at("part", 1).alias("summary"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(content), F.lit("([a-z]{9,})"), F.lit(1)))).alias("keywords"),
        (F.col("w") * 5 + 1).alias("start_line"),
        (F.col("w") * 5 + F.size("part")).alias("end_line"),
        F.col("lang").alias("language"),
    )


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions in modules: each part is a function of one of 200 modules that may call another module."""
    p = table(spark, sf_dir, "part")
    a = F.col("p_partkey") % 200
    b = F.when(F.col("p_size") > 44, (a * 7 + 3) % 200).when(F.col("p_size").isin(1, 2), (a + F.col("p_size")) % 200)
    p = p.select("p_partkey", "p_brand", F.lower("p_type").alias("kind"), a.alias("a"), b.cast("string").alias("b"))
    has = F.col("b").isNotNull()
    key = F.col("p_partkey").cast("string")
    content = F.concat(
        F.when(has, F.concat(F.lit("import m"), F.col("b"), F.lit("\n"))).otherwise(F.lit("")),
        F.lit("@app.route('/"), F.col("kind"), F.lit("')\ndef part_"), key, F.lit("(a, b):\n    rows = self.db.query('"), F.col("kind"), F.lit("')\n    return "),
        F.when(has, F.concat(F.lit("m"), F.col("b"), F.lit(".part_"), F.col("b"))).otherwise(F.concat(F.lit("part_"), (F.col("p_partkey") + 200).cast("string"))),
        F.lit("(rows, a)"),
    )
    target = F.when(has, F.concat(F.lit("m"), F.col("b"), F.lit(".part_"), F.col("b"))).otherwise(F.concat(F.lit("part_"), (F.col("p_partkey") + 200).cast("string")))
    return p.select(
        F.col("p_partkey").alias("ord"),
        F.concat(F.lit("m"), F.col("a").cast("string"), F.lit(".py")).alias("file_path"),
        F.concat(F.lit("part_"), key).alias("name"),
        F.lit("function").alias("type"),
        content.alias("content"),
        F.concat(F.lit("Reads "), F.col("p_brand"), F.lit(" rows")).alias("summary"),
        (F.floor(F.col("p_partkey") / 200) * 10 + 1).cast("int").alias("start_line"),
        F.array(F.lit("a"), F.lit("b")).alias("parameters"),
        F.array(F.struct(target.alias("target"), (F.floor(F.col("p_partkey") / 200) * 10 + 4).cast("int").alias("line"))).alias("calls"),
    )


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as coding sessions: a session is a user's day."""
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "purchase", "store").when(F.col("event_type") == "view", "retrieve").when(F.col("event_type") == "click", "hit").when(F.col("event_type") == "error", "miss").otherwise("open")
    return e.select(
        F.col("event_id"),
        (F.col("user_id") % 10).cast("string").alias("agent_id"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        action.alias("action"),
        F.concat(F.lit("f"), F.get_json_object("props", "$.k"), F.lit(".py")).alias("file_path"),
        F.floor("value").cast("long").alias("tokens"),
        F.col("value"),
        F.col("ts"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the documents as files (file_path, content)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.coalesce("text", F.lit("")).alias("content"))
    a = d.where("doc_id % 7 <> 0")
    b = d.where("doc_id % 5 <> 0").withColumn("content", F.when(F.col("doc_id") % 11 == 0, F.concat("content", F.lit(" changed"))).otherwise(F.col("content")))
    return a.drop("doc_id"), b.drop("doc_id")


# The same views for DuckDB: a WITH list to stand before a query.
SQL_VIEWS = {
    "memories": """memories as (select conv_id * 1000 + turn as ord, (conv_id * 1000 + turn)::varchar as id, (conv_id % 10)::varchar as agent_id, coalesce(text, '') as content,
 ['episodic', 'semantic', 'procedural', 'working'][turn % 4 + 1] as memory_type,
 list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}'), lambda x, i: list_position(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}'), x) = i)[1:5] as keywords,
 case when regexp_matches(coalesce(text, ''), '^[A-Z][a-z]+') then [regexp_extract(text, '^([A-Z][a-z]+)', 1)] else []::varchar[] end as persons,
 role as topic, (conv_id % 10) / 10.0::double as importance, timestamp '2024-01-01' + (conv_id * 60 + turn) * interval 1 minute as created_at from conversations)""",
    "vectors": """vectors as (select m.id, e.embedding from memories m, (select count(*) as n from embeddings) c, embeddings e where e.vec_id = m.ord % c.n)""",
    "queries": "queries as (select ord as query_id, content as query, embedding from memories join vectors using (id) where ord // 1000 % 20 = 0)",
    "questions": "questions as (select item_id as query_id, coalesce(text, '') as query, e.embedding from benchmark b, (select count(*) as n from embeddings) c, embeddings e where e.vec_id = b.item_id % c.n)",
    "chunks": r"""chunk_parts as (select doc_id, lang, w, string_split(coalesce(text, ''), chr(10))[w * 5 + 1:w * 5 + 5] as part from documents, unnest(range(0, (len(string_split(coalesce(text, ''), chr(10))) - 1) // 5 + 1)) as t(w)),
chunks as (select doc_id * 1000 + w as ord, lang || '/d' || doc_id || '.md' as file_path, doc_id || ':' || w as name, 'block' as type, array_to_string(part, chr(10)) as content, part[1] as summary,
 list_sort(list_distinct(regexp_extract_all(lower(array_to_string(part, chr(10))), '[a-z]{9,}'))) as keywords, w * 5 + 1 as start_line, w * 5 + len(part) as end_line, lang as language from chunk_parts)""",
    "code_chunks": """code_parts as (select p_partkey, p_brand, lower(p_type) as kind, p_partkey % 200 as a, case when p_size > 44 then (p_partkey % 200 * 7 + 3) % 200 when p_size in (1, 2) then (p_partkey % 200 + p_size) % 200 end as b from part),
code_chunks as (select p_partkey as ord, 'm' || a || '.py' as file_path, 'part_' || p_partkey as name, 'function' as type,
 coalesce('import m' || b || chr(10), '') || '@app.route(''/' || kind || ''')' || chr(10) || 'def part_' || p_partkey || '(a, b):' || chr(10) || '    rows = self.db.query(''' || kind || ''')' || chr(10) || '    return '
 || coalesce('m' || b || '.part_' || b, 'part_' || (p_partkey + 200)) || '(rows, a)' as content, 'Reads ' || p_brand || ' rows' as summary, (p_partkey // 200 * 10 + 1)::int as start_line,
 ['a', 'b'] as parameters, coalesce('m' || b || '.part_' || b, 'part_' || (p_partkey + 200)) as target, (p_partkey // 200 * 10 + 4)::int as call_line from code_parts)""",
    "session_events": """session_events as (select event_id, (user_id % 10)::varchar as agent_id, user_id || '-' || strftime(ts, '%Y%m%d') as session_id,
 case event_type when 'purchase' then 'store' when 'view' then 'retrieve' when 'click' then 'hit' when 'error' then 'miss' else 'open' end as action,
 'f' || json_extract_string(props, '$.k') || '.py' as file_path, floor(value)::bigint as tokens, value, ts from events)""",
    "snapshots": """files as (select doc_id, 'd' || doc_id || '.md' as file_path, coalesce(text, '') as content from documents),
snap_a as (select file_path, content from files where doc_id % 7 <> 0),
snap_b as (select file_path, content || case when doc_id % 11 = 0 then ' changed' else '' end as content from files where doc_id % 5 <> 0)""",
}
_NEEDS = {"vectors": ["memories"], "queries": ["memories", "vectors"]}


def with_views(*names: str, body: str) -> str:
    """SQL text with the views named (and what they need) before the body, which may begin with more of the list."""
    order = list(dict.fromkeys(x for n in names for x in [*_NEEDS.get(n, []), n]))
    return "with " + ",\n".join(SQL_VIEWS[n] for n in order) + ("\n" if body.lstrip().lower().startswith("select") else ",\n") + body
