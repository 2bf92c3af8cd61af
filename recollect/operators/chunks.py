"""Chunks of text files: cutting, hashing, dedup, keywords, index, texts to embed, summaries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions.tables import top_rows
from recollect.functions.text import decompose_identifier, estimate_tokens, normalise_hash, number_lines, strings

# Patterns of code that become keywords, and words that never do.
DECORATOR = r"@(\w+[\.\w]*)"
TABLE_CALL = r"\.(?:query|insert|update|delete|select|from)\s*\(\s*['\"](\w+)['\"]"
ROUTE = r"@\w+\.route\s*\(\s*['\"]([^'\"]+)['\"]"
METHODS = r"methods\s*=\s*\[([^\]]+)\]"
IMPORT = r"(?:from|import)\s+([\w.]+)"
EXCEPTION = r"(?:raise|except)\s+(\w+)"
CALL = r"(\w+)\.(\w+)\s*\("
CAPITALISED = r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)*)\b"
TECHNICAL = r"(?i)\b(JWT|API|SQL|HTTP|REST|OAuth|TTL|Redis|CORS)\b"
NEVER = ["self", "cls", "none", "true", "false"]


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group)), lambda x: F.lower(x))


def chunk_whole(files: DataFrame) -> DataFrame:
    """Each file (file_path, content) as one chunk of lines 1 to n."""
    return files.select("file_path", F.lit("file").alias("type"), "content", F.lit(1).alias("start_line"), F.size(F.split("content", "\n", -1)).alias("end_line"))


def chunk_lines(files: DataFrame, width: int = 100) -> DataFrame:
    """Files in windows of so many lines: one row for each window, cut from the file's own array of lines."""
    lines = files.withColumn("lines", F.split(F.coalesce("content", F.lit("")), "\n", -1))
    each = lines.select("file_path", "lines", F.explode(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / width).cast("int"))).alias("part"))
    own = F.slice("lines", F.col("part") * width + 1, F.lit(width))
    return each.select("file_path", F.lit("block").alias("type"), F.array_join(own, "\n").alias("content"), (F.col("part") * width + 1).alias("start_line"), (F.col("part") * width + F.size(own)).alias("end_line"))


def ingest_chunks(rows: DataFrame) -> DataFrame:
    """Chunks given by a caller, some columns null: defaults, hash and token estimate of the numbered text."""
    content = F.coalesce("content", F.lit(""))
    return rows.withColumns({
        "content": content,
        "type": F.coalesce("type", F.lit("block")),
        "summary": F.coalesce("summary", F.lit("")),
        "keywords": F.coalesce("keywords", strings([])),
        "start_line": F.coalesce("start_line", F.lit(0)),
        "end_line": F.coalesce("end_line", F.lit(0)),
        "hash_id": normalise_hash(content),
        "token_count": estimate_tokens(number_lines(content, F.coalesce("start_line", F.lit(0)))),
    })


def dedup_chunks(chunks: DataFrame) -> DataFrame:
    """One row for each hash: the first by (ord). A minimum of structs, combined before the shuffle."""
    rest = [c for c in chunks.columns if c != "hash_id"]
    return chunks.groupBy("hash_id").agg(F.min_by(F.struct(*rest), "ord").alias("r")).select("hash_id", "r.*")


def dup_report(chunks: DataFrame) -> DataFrame:
    """Hashes in more than one chunk: how many chunks and files."""
    return chunks.groupBy("hash_id").agg(F.count("*").alias("n_chunks"), F.countDistinct("file_path").alias("n_files")).where("n_chunks > 1")


def enriched_keywords(name: Column, kind: Column, content: Column, summary: Column, keywords: Column) -> Column:
    """Sorted distinct keywords of a chunk: given ones, parts of the name, patterns of the content, terms of the summary, type."""
    text = F.coalesce(content, F.lit(""))
    whole = F.coalesce(name, F.lit(""))
    tables, routes = found(text, TABLE_CALL), found(text, ROUTE)
    calls = F.filter(found(text, CALL, 1), lambda x: (F.length(x) > 1) & ~F.array_contains(strings(["self", "cls"]), x))
    parts = F.array(
        F.coalesce(keywords, strings([])), F.array(whole), decompose_identifier(whole), found(text, DECORATOR), tables, F.transform(tables, lambda t: F.concat(t, F.lit("_table"))), routes,
        F.flatten(F.transform(routes, lambda r: F.split(r, "/"))), found(F.array_join(found(text, METHODS), ","), r"'(\w+)'"),
        F.transform(found(text, IMPORT), lambda i: F.element_at(F.split(i, r"\."), -1)), found(text, EXCEPTION), calls, found(text, CALL, 2), found(summary, CAPITALISED), found(summary, TECHNICAL),
        F.array(F.lower(F.coalesce(kind, F.lit("")))),
    )
    return F.array_sort(F.array_distinct(F.filter(F.flatten(parts), lambda k: (F.length(k) > 1) & ~F.array_contains(strings(NEVER), k))))


# Questions about a chunk, in the order of the rules: what is looked at (name: kinds of chunk; dotted: functions with a
# parent; table: names of tables in calls; text: a pattern in the content; said: words that the summary holds), and the questions.
QUESTIONS = [
    ("name", "class", ["What does the {name} class do?", "How does {name} work?"]),
    ("name", "function method", ["What does {base} do?", "How does {base} work?"]),
    ("dotted", "function method", ["How does {parent} handle {base}?"]),
    ("table", r"\.(?:query|insert|update|delete)\s*\(\s*['\"](\w+)['\"]", ["Which functions interact with the {table} table?", "How is the {table} table used?"]),
    ("text", r"(?i)\b(bcrypt|jwt|token|hash|encrypt|password)\b", ["How is security implemented?", "What security measures are in place?"]),
    ("text", r"(?i)\b(cache|ttl|memoize|lru)\b", ["How is caching used?", "How to improve performance?"]),
    ("text", r"(?i)\b(rate|throttle|limit)\b", ["How are API endpoints protected?", "What prevents too many requests?"]),
    ("text", r"(?i)\b(email|send_email|smtp)\b", ["How are emails sent?"]),
    ("said", "reset password", ["What happens when a user forgets their password?"]),
    ("said", "migration", ["How are database schema changes managed?"]),
    ("said", "refresh token", ["What happens when a token expires?"]),
]


def qa_hints(name: Column, kind: Column, content: Column, summary: Column) -> Column:
    """Questions that a reader may ask of a chunk, 5 at most, in the order of the rules."""
    split, text, said = F.split(name, r"\."), F.coalesce(content, F.lit("")), F.lower(F.coalesce(summary, F.lit("")))
    values = {"name": name, "base": F.element_at(split, -1), "parent": F.element_at(split, 1)}

    def asked(question: str, known: dict[str, Column]) -> Column:
        parts = re.split(r"\{(\w+)\}", question)
        return F.concat(*[known[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if x])

    rules = []
    for field, what, questions in QUESTIONS:
        if field == "table":
            tables = F.array_sort(F.array_distinct(found(text, what)))
            rules.append(F.flatten(F.transform(tables, lambda t: F.array(*[asked(q, {"table": t}) for q in questions]))))  # noqa: B023
            continue
        holds = {
            "name": lambda: kind.isin(*what.split()), "dotted": lambda: kind.isin(*what.split()) & F.contains(name, F.lit(".")),  # noqa: B023
            "text": lambda: text.rlike(what), "said": lambda: reduce(lambda a, b: a & b, [F.contains(said, F.lit(w)) for w in what.split()]),  # noqa: B023
        }[field]()
        rules.append(F.when(holds, F.array(*[asked(q, values) for q in questions])).otherwise(strings([])))
    return F.slice(F.flatten(F.array(*rules)), 1, 5)


def embedding_text(chunk: DataFrame) -> Column:
    """The text to embed of a chunk with keywords: header, parent, summary, 600 characters, patterns, questions, keywords, lines."""
    c = F.col
    some = lambda label, values, sep=", ": F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(values, sep)))
    full = lambda column: F.when(F.length(column) > 0, column)
    raw = lambda pattern, group=1: F.regexp_extract_all(c("content"), F.lit(pattern), F.lit(group))
    split = F.split(c("name"), r"\.")
    return F.concat_ws(
        "\n",
        F.trim(F.concat_ws(" ", c("type"), c("name"))),
        F.when(F.contains(c("name"), F.lit(".")), F.format_string("Method %s of class %s", F.element_at(split, -1), F.array_join(F.slice(split, 1, F.size(split) - 1), "."))),
        full(c("summary")),
        full(F.substring(c("content"), 1, 600)),
        some("Decorators: ", raw(r"(@\w+[\.\w]*(?:\([^)]*\))?)")),
        some("HTTP methods: ", raw(METHODS)),
        some("Database tables: ", F.array_sort(F.array_distinct(raw(TABLE_CALL)))),
        some("Exceptions: ", F.array_sort(F.array_distinct(raw(EXCEPTION)))),
        some("Related questions: ", qa_hints(c("name"), c("type"), c("content"), c("summary")), " | "),
        some("Keywords: ", c("keywords")),
        F.format_string("Lines: %d-%d", c("start_line"), c("end_line")),
    )


def build_symbol_index(chunks: DataFrame) -> DataFrame:
    """Distinct (symbol, file_path) of names and keywords in lower case."""
    symbols = F.concat(F.array(F.lower("name")), F.transform("keywords", lambda k: F.lower(k)))
    return chunks.select(F.explode(symbols).alias("symbol"), "file_path").where(F.length("symbol") > 1).distinct()


def refresh_symbol_index(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """The index with the entries of the files of these chunks replaced."""
    return index.join(chunks.select("file_path").distinct().hint("merge"), "file_path", "left_anti").select("symbol", "file_path").unionByName(build_symbol_index(chunks))


def label_of(width: int) -> Column:
    """What an outline says of a chunk: its summary, else its first characters."""
    return F.when(F.length("summary") > 0, F.col("summary")).otherwise(F.substring("content", 1, width))


def build_skeleton(chunks: DataFrame, width: int = 60) -> DataFrame:
    """Nodes of each file's outline: a start, one for each chunk in order (its summary, else its first characters), an end."""
    files = chunks.groupBy("file_path").agg(F.count("*").cast("int").alias("n"))
    start = files.select("file_path", F.lit(0).alias("node"), F.lit("start").alias("kind"), F.lit("").alias("label"))
    end = files.select("file_path", (F.col("n") + 1).alias("node"), F.lit("end").alias("kind"), F.lit("").alias("label"))
    order = F.row_number().over(W.partitionBy("file_path").orderBy("ord"))
    return start.unionByName(chunks.select("file_path", order.alias("node"), F.lit("processing").alias("kind"), label_of(width).alias("label"))).unionByName(end)


def skeleton_json(chunks: DataFrame, width: int = 60) -> DataFrame:
    """(file_path, outline): each file's outline as nested JSON: a start node with a child for each chunk, in order, and the end."""
    node = lambda kind, label, line: F.struct(F.lit(kind).alias("type"), label.alias("content"), line.cast("long").alias("line"))
    base = F.regexp_extract("file_path", r"([^/]*)$", 1)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(label_of(width).alias("content"), F.col("start_line").alias("line"), F.col("end_line").alias("end")).alias("x")))), lambda c: c["x"])
    files = chunks.groupBy("file_path").agg(parts.alias("parts"))
    children = F.concat(F.transform("parts", lambda c: node("processing", c["content"], c["line"])), F.array(node("end", F.lit("End of File"), F.element_at("parts", -1)["end"])))
    return files.select("file_path", F.to_json(F.struct(F.lit("start").alias("type"), F.concat(F.lit("File: "), base).alias("content"), F.lit(1).alias("line"), children.alias("children"))).alias("outline"))


def compression_ratio(chunks: DataFrame, width: int = 60) -> DataFrame:
    """Of each file: tokens of its chunks and of the labels of its outline, and 1 - outline / text, to 4 places (0 if no token)."""
    own = chunks.groupBy("file_path").agg(F.sum(estimate_tokens(F.col("content"))).alias("original"), F.sum(estimate_tokens(label_of(width))).alias("skeleton"))
    return own.withColumn("ratio", F.when(F.col("original") > 0, F.round(1 - F.col("skeleton") / F.col("original"), 4)).otherwise(0.0))


def summarize_file(chunks: DataFrame, names: int = 8) -> DataFrame:
    """Of each file: chunks by type, and its first names in order."""
    counts = chunks.groupBy("file_path", "type").agg(F.count("*").alias("n"))
    types = counts.groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "type", F.col("n").cast("string")))), ",").alias("types"))
    first = top_rows(chunks.select("file_path", "ord", "name"), ["file_path"], [F.col("ord")], names)
    first = first.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ",").alias("names"))
    return types.join(first.hint("merge"), "file_path", "left")


def summarize_file_normal(chunks: DataFrame, freshness: DataFrame) -> DataFrame:
    """(file_path, outline, freshness) of each file; unknown where freshness (file_path, freshness) says nothing."""
    return skeleton_json(chunks).join(freshness.select("file_path", "freshness").hint("merge"), "file_path", "left").withColumn("freshness", F.coalesce("freshness", F.lit("unknown")))


def summarize_file_detailed(chunks: DataFrame) -> DataFrame:
    """(file_path, total_chunks, chunks): each file's chunks in order, whole, as JSON."""
    one = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("name", "type", "content", "summary")], F.coalesce("keywords", strings([])).alias("keywords"))
    files = chunks.groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("x")))), lambda c: c["x"]).alias("x"))
    return files.select("file_path", F.size("x").cast("long").alias("total_chunks"), F.to_json("x").alias("chunks"))
