"""Counts, roll-ups, listings and rules over memories, files, sessions and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions.tables import top_rows
from recollect.functions.text import strings


def joined(values: Column) -> Column:
    return F.array_join(F.array_sort(values), ",")


def memory_counts(memories: DataFrame) -> DataFrame:
    """Memories of each agent, in all (null type) and by type."""
    return memories.groupingSets([["agent_id"], ["agent_id", "memory_type"]], "agent_id", "memory_type").agg(F.count("*").alias("n"))


def names_in(rows: DataFrame, column: str = "persons") -> Column:
    """Names as an array, also where the column is a string with commas."""
    if rows.schema[column].dataType.simpleString() == "string":
        return F.filter(F.transform(F.split(column, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.col(column)


def agent_stats(memories: DataFrame, documents: DataFrame) -> DataFrame:
    """Of each agent: memories, topics with counts, distinct persons and locations, documents (agent_id)."""
    topic = F.coalesce("topic", F.lit("uncategorized"))
    topics = memories.groupBy("agent_id", topic.alias("topic")).agg(F.count("*").alias("n"))
    topics = topics.groupBy("agent_id").agg(F.sum("n").alias("memories"), joined(F.collect_list(F.concat_ws("=", "topic", F.col("n").cast("string")))).alias("topics"))
    persons = memories.select("agent_id", F.explode(names_in(memories)).alias("p")).groupBy("agent_id").agg(F.countDistinct("p").alias("persons"))
    places = memories.where("location <> ''").groupBy("agent_id").agg(F.countDistinct("location").alias("locations"))
    files = documents.groupBy("agent_id").agg(F.count("*").alias("documents"))
    for more in (persons, places, files):
        topics = topics.join(more.hint("merge"), "agent_id", "left")
    return topics.select("agent_id", "memories", "topics", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("persons", "locations", "documents")])


def newest(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    return top_rows(rows, keys, [F.col("created_at").desc(), F.col("ord").desc()], n)


def memory_summary(memories: DataFrame, n: int = 100, each: int = 3, width: int = 100, focus: str | None = None) -> DataFrame:
    """Of each agent's newest memories, those of them that mention the focus anywhere if one is given: topics with their number
    and first contents."""
    recent = newest(memories, ["agent_id"], n)
    if focus is not None:
        said = F.concat_ws(" ", "content", "topic", F.array_join("keywords", " "), F.array_join(names_in(memories), " "))
        recent = recent.where(F.contains(F.lower(said), F.lit(focus.lower())))
    recent = recent.select("agent_id", "topic", "content", F.col("rank").alias("age"))
    counts = recent.groupBy("agent_id", "topic").agg(F.count("*").alias("n"))
    first = top_rows(recent, ["agent_id", "topic"], [F.col("age")], each).groupBy("agent_id", "topic").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.substring("content", 1, width).alias("c")))), lambda x: x["c"]), " | ").alias("samples")
    )
    return counts.join(first.hint("merge"), ["agent_id", "topic"])


def summary_metadata(memories: DataFrame, focus: str | None = None) -> DataFrame:
    """Of each agent, of all memories or of those whose topic is the focus: memories, topics covered, persons mentioned."""
    rows = memories if focus is None else memories.where(F.col("topic") == focus)
    own = rows.groupBy("agent_id").agg(F.count("*").alias("memories"), joined(F.collect_set(F.when(F.col("topic") != "", F.col("topic")))).alias("topics"))
    persons = rows.select("agent_id", F.explode(names_in(memories)).alias("p")).groupBy("agent_id").agg(joined(F.collect_set("p")).alias("persons"))
    return own.join(persons.hint("merge"), "agent_id", "left").withColumn("persons", F.coalesce("persons", F.lit("")))


def what_do_i_know(memories: DataFrame, n: int = 50, recent: int = 5) -> DataFrame:
    """Of each agent's newest memories: distinct topics and persons, and the ids of the most recent."""
    rows = newest(memories, ["agent_id"], n)
    persons = rows.select("agent_id", F.explode("persons").alias("p")).groupBy("agent_id").agg(joined(F.collect_set("p")).alias("persons"))
    own = rows.groupBy("agent_id").agg(joined(F.collect_set("topic")).alias("topics"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= recent, F.struct("rank", "id")))), lambda x: x["id"]), ",").alias("recent"))
    return own.join(persons.hint("merge"), "agent_id", "left").select("agent_id", "topics", F.coalesce("persons", F.lit("")).alias("persons"), "recent")


def categories(content: Column, topic: Column) -> Column:
    """The first class whose rule holds."""
    text, tag = F.lower(content), F.lower(F.coalesce(topic, F.lit("")))
    has = lambda c, word: F.contains(c, F.lit(word))
    return (
        F.when(has(text, "name") | has(tag, "personal"), "personal_info").when(has(text, "prefer") | has(text, "like"), "preferences").when(has(tag, "date") | has(text, "deadline"), "dates_events")
        .when(has(tag, "project") | has(tag, "work"), "projects_work").when(has(tag, "decision"), "decisions").otherwise("other")
    )


# Words of the four purposes, in their order.
PURPOSES = {
    "storage_operations": "storage store save db database insert update delete filesystem".split(),
    "search_operations": "search find query lookup retrieval retriever".split(),
    "encoding_operations": "encoding encode embed vector token hash".split(),
    "llm_interactions": "llm chat model prompt completion generate".split(),
}


def purpose(content: Column, summary: Column) -> Column:
    text, out = F.lower(F.concat_ws(" ", content, summary)), F.lit("other")
    for name, words in reversed(PURPOSES.items()):
        out = F.when(F.exists(strings(words), lambda w: F.contains(text, w)), F.lit(name)).otherwise(out)
    return out


def context_by_topic(memories: DataFrame, each: int = 20) -> DataFrame:
    """Text of each agent's topics: the first memories of each, in order, a line each."""
    topic = F.coalesce("topic", F.lit("general"))
    first = top_rows(memories.select("agent_id", topic.alias("topic"), "ord", "content"), ["agent_id", "topic"], [F.col("ord")], each)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: F.concat(F.lit("- "), x["content"]))
    return first.groupBy("agent_id", "topic").agg(F.array_join(lines, "\n").alias("context"))


def session_rollup(events: DataFrame) -> DataFrame:
    """Of each session: distinct files stored and retrieved, tokens, hits, misses."""
    of = lambda action: F.when(F.col("action") == action, F.col("file_path"))
    return events.groupBy("agent_id", "session_id").agg(
        F.countDistinct(of("store")).alias("stored"), F.countDistinct(of("retrieve")).alias("retrieved"), F.sum("tokens").alias("tokens"),
        F.count_if(F.col("action") == "hit").alias("hits"), F.count_if(F.col("action") == "miss").alias("misses"),
    )


def token_savings(events: DataFrame, contexts: DataFrame) -> DataFrame:
    """Of each agent: tokens, hits and misses, hit rate in % (0 if none), files, sessions; files in its cache and their tokens
    (contexts: agent_id, file_path, tokens)."""
    held = contexts.groupBy("agent_id").agg(F.count("*").alias("cached_files"), F.sum("tokens").alias("cached_tokens"))
    hits, misses = F.count_if(F.col("action") == "hit"), F.count_if(F.col("action") == "miss")
    rate = F.when(hits + misses > 0, F.round(100.0 * hits / (hits + misses), 2)).otherwise(0.0)
    out = events.groupBy("agent_id").agg(F.sum("tokens").alias("tokens"), hits.alias("hits"), misses.alias("misses"), rate.alias("hit_rate"), F.countDistinct("file_path").alias("files"), F.countDistinct("session_id").alias("sessions"))
    return out.join(held.hint("merge"), "agent_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("cached_files", "cached_tokens")})


def indexing_activity(chunks: DataFrame) -> DataFrame:
    """By language, and in all (null): files, chunks, chunks in a file to one place."""
    files = chunks.groupBy("language", "file_path").agg(F.count("*").alias("n"))
    return files.groupingSets([[], ["language"]], "language").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.coalesce(F.round(F.avg("n"), 1), F.lit(0.0)).alias("mean_chunks"))


def usage_report(events: DataFrame, n: int = 10) -> DataFrame:
    """The n files of each agent with most events, with tokens and the mean to one place."""
    files = events.groupBy("agent_id", "file_path").agg(F.count("*").alias("accesses"), F.sum("tokens").alias("tokens"), F.round(F.avg("tokens"), 1).alias("mean_tokens"))
    return top_rows(files, ["agent_id"], [F.col("accesses").desc(), F.col("file_path")], n)


def cache_stats(contexts: DataFrame, current: DataFrame) -> DataFrame:
    """Stored files (file_path, content_hash, tokens) by freshness against the current hashes: files and tokens."""
    return freshness(contexts, current).groupBy("freshness").agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"))


def cache_files(contexts: DataFrame, current: DataFrame) -> DataFrame:
    """Stored files with their freshness, largest first. Ranges of tokens are sorted apart, so no task takes all files."""
    return freshness(contexts, current).select("file_path", "tokens", "freshness").orderBy(F.desc("tokens"), "file_path")


def cache_recommendations(contexts: DataFrame, current: DataFrame, hits: DataFrame) -> DataFrame:
    """(advice, n): what to do about stale and missing files, and about a cache without hits (hits: a row for each)."""
    states = freshness(contexts, current).where(F.col("freshness").isin("stale", "missing")).groupBy("freshness").agg(F.count("*").alias("n"))
    about = states.select(F.when(F.col("freshness") == "stale", "update the files").otherwise("remove the files from the index").alias("advice"), "n")
    none = contexts.agg(F.count("*").alias("n")).crossJoin(F.broadcast(hits.agg(F.count("*").alias("hits")))).where("n > 0 and hits = 0")  # one row each
    return about.unionByName(none.select(F.lit("read summaries before files").alias("advice"), "n"))


def freshness(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored files with fresh, stale, missing (not there now) or unknown (stored without a hash)."""
    now = current.select("file_path", F.col("content_hash").alias("__now"), F.lit(True).alias("__there"))
    state = F.when(F.col("__there").isNull(), "missing").when(F.col("content_hash").isNull(), "unknown").when(F.col("content_hash") == F.col("__now"), "fresh").otherwise("stale")
    return stored.join(now.hint("merge"), "file_path", "left").withColumn("freshness", state).drop("__now", "__there")


def engagement_rollup(events: DataFrame, key: str) -> DataFrame:
    """Of each key: upvotes, runs, and the last rating."""
    rated = F.when(F.col("event_type") == "signup", F.struct("ts", "event_id"))
    return events.groupBy(key).agg(F.count_if(F.col("event_type") == "click").alias("upvotes"), F.count_if(F.col("event_type") == "purchase").alias("runs"), F.max_by("value", rated).alias("rating"))


def op_latency(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


def page_of(rows: DataFrame, keys: list[str], order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of each key, with rank and the total."""
    ranked = rows.withColumns({"rank": F.row_number().over(W.partitionBy(*keys).orderBy(*order))}).where(F.col("rank") <= offset + limit)
    totals = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    return ranked.where(F.col("rank") > offset).withColumn("rank", F.col("rank").cast("long")).join(totals.hint("merge"), keys)


def lookup_prefix(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """For each prefix the first row whose id equals it or begins with it: ids are cut to the lengths that occur."""
    lengths = [r[0] for r in prefixes.select(F.length("prefix")).distinct().orderBy(F.length("prefix")).collect()]  # a row for each length
    cuts = F.explode(F.array(*[F.substring("id", 1, n) for n in lengths]) if lengths else F.array().cast("array<string>"))
    hits = rows.select("id", "ord", cuts.alias("prefix")).join(prefixes.select("prefix").distinct().hint("merge"), "prefix")
    return hits.groupBy("prefix").agg(F.min_by("id", "ord").alias("id"))


# What makes a message worth keeping.
TRIGGERS = [
    "my name", "i am", "i'm", "i like", "i prefer", "i hate", "favorite", "birthday", "deadline", "meeting", "schedule", "remember", "don't forget", "important", "always", "never",
    "i work", "my job", "project", "team", "company", "email", "phone", "address", "live in", "from",
]
FACT_RULES = [
    ("personal", ["my name is", "i'm ", "i am "], "semantic"),
    ("preferences", ["i prefer", "i like", "i love", "i hate", "i don't like"], "semantic"),
    ("work", ["working on", "my project", "building", "developing"], "semantic"),
    ("dates", ["birthday", "deadline", "meeting", "appointment"], "episodic"),
]
ADVICE_RULES = [
    ("personal_info", ["my name", "i am", "i'm"]),
    ("preference", ["prefer", "like", "love", "hate", "favorite"]),
    ("explicit_memory", ["remember", "don't forget", "important"]),
    ("work_context", ["work", "project", "building", "developing"]),
]


def facts(content: Column, rules: list[tuple[str, list[str], str]] = FACT_RULES, least: int = 50) -> Column:
    """Topics and types of the rules that a message meets; if none and it is longer than `least`, a conversation."""
    text = F.lower(content)
    own = [F.when(F.exists(strings(words), lambda w: F.contains(text, w)), F.struct(F.lit(topic).alias("topic"), F.lit(kind).alias("memory_type"))) for topic, words, kind in rules]
    met = F.filter(F.array(*own), lambda x: x.isNotNull())
    rest = F.when(F.length(content) > least, F.array(F.struct(F.lit("conversation").alias("topic"), F.lit("episodic").alias("memory_type"))))
    return F.when(F.size(met) > 0, met).otherwise(F.coalesce(rest, F.array().cast("array<struct<topic:string,memory_type:string>>")))


def auto_remember(messages: DataFrame, rules: list[tuple[str, list[str], str]] = FACT_RULES) -> DataFrame:
    """(id, topic, memory_type) of the facts in messages (id, content): stateless, so it runs on a stream too."""
    return messages.select("id", F.explode(facts(F.col("content"), rules)).alias("fact")).select("id", "fact.topic", "fact.memory_type")


def should_remember(content: Column, rules: list[tuple[str, list[str]]] = ADVICE_RULES) -> tuple[Column, Column]:
    """(types, confidence)."""
    text = F.lower(content)
    met = F.filter(F.array(*[F.when(F.exists(strings(words), lambda w: F.contains(text, w)), F.lit(name)) for name, words in rules]), lambda x: x.isNotNull())
    return met, F.round(F.least(F.size(met) * F.lit(0.3) + F.lit(0.1), F.lit(1.0)), 2)


def triggers(content: Column, phrases: list[str] = TRIGGERS) -> tuple[Column, Column]:
    """(phrases found, confidence)."""
    hit = F.filter(strings(phrases), lambda t: F.contains(F.lower(content), t))
    return hit, F.when(F.size(hit) >= 2, "high").when(F.size(hit) == 1, "medium").otherwise("low")
