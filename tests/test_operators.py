"""Small fixtures with results worked out by hand, and invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from recollect.functions.text import decompose_identifier, detect_language, estimate_tokens, normalise_hash, number_lines, tokenize_query
from recollect.functions.vectors import cosine, normalise
from recollect.operators import code_search as cs
from recollect.operators import graph, maintain, memory_search, reports, versions
from recollect.operators.chunks import build_symbol_index, chunk_lines, dedup_chunks, dup_report, enriched_keywords, refresh_symbol_index
from recollect.operators.definitions import chunk_definitions
from recollect.sources import io
from recollect.streaming import streams

MEMORY = "id string, ord long, content string, keywords array<string>, persons array<string>, topic string, importance double, created_at timestamp"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def memories(spark):
    t = None
    rows = [
        ("1", 1, "Anna likes green tea and long walks", ["tea", "walks"], ["Anna"], "preferences", 0.5, t),
        ("2", 2, "The deadline of the project is Friday", ["deadline"], [], "work", 1.0, t),
        ("3", 3, "Nothing of note", None, None, None, None, t),
    ]
    return spark.createDataFrame(rows, MEMORY)


def test_text_functions(spark):
    assert one(spark, tokenize_query(F.lit("What is the green tea"))) == ["green", "tea"]
    assert one(spark, tokenize_query(F.lit("the who is"))) == ["the", "who"]
    assert one(spark, number_lines(F.lit("a\nb"), F.lit(5))) == "line:5 a line:6 b"
    assert one(spark, normalise_hash(F.lit(" a \n b "))) == one(spark, F.sha2(F.lit("a b"), 256))
    assert one(spark, estimate_tokens(F.lit("abcdefg"))) == 1
    assert [one(spark, detect_language(F.lit(p))) for p in ("a/b.PY", "x.unknown", "none")] == ["python", "other", "other"]
    assert one(spark, decompose_identifier(F.lit("getUser_name"))) == ["get", "getuser", "getuser_name", "name", "user"]


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, cosine(a, a)) == 1.0 and one(spark, cosine(a, z)) == 0.0
    assert one(spark, normalise(a)) == [0.6, 0.8] and one(spark, normalise(z)) == [0.0, 0.0]


def test_keyword_score_by_hand(spark):
    q = spark.createDataFrame([(1, "green tea", [1.0]), (2, "the", [1.0])], "query_id int, query string, embedding array<double>")
    rows = memory_search.keyword_search(memories(spark), q, 5).collect()
    # a query of stopwords alone keeps its words of 3 letters and more
    # phrase 2.0; green .3 + .25; tea .3 + .15 and keyword .6; all words matched: * 1.5; importance .5: * 1.5
    assert [(r["query_id"], r["id"], r["score"]) for r in rows] == [(1, "1", round((2.0 + 0.55 + 1.05) * 1.5 * 1.5, 3)), (2, "2", round(0.45 * 1.5 * 2.0, 3))]


def test_batch_equals_single(spark):
    q = spark.createDataFrame([(1, "green tea", [1.0, 0.0]), (2, "project deadline", [0.0, 1.0])], "query_id int, query string, embedding array<double>")
    v = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.0, 1.0])], "id string, embedding array<double>")
    both = memory_search.hybrid_search(memories(spark), v, q, 2).collect()
    single = [r for k in (1, 2) for r in memory_search.hybrid_search(memories(spark), v, q.where(F.col("query_id") == k), 2).collect()]
    assert sorted(both) == sorted(single)


def test_time_filter_and_boost(spark):
    q = spark.createDataFrame([(1, "What did Anna say last week", [1.0])], "query_id int, query string, embedding array<double>")
    a = memory_search.analyze_query(q, F.lit("2024-03-08").cast("timestamp")).first()
    assert a["time_type"] == "last_week" and a["persons"] == ["Anna"] and str(a["time_start"].date()) == "2024-03-01"
    found = spark.createDataFrame([(1, "1", 1, 0.5), (1, "2", 2, 0.6)], "query_id int, id string, ord long, score double")
    analyzed = memory_search.analyze_query(q, F.lit("2024-03-08").cast("timestamp"))
    m = memories(spark).withColumn("created_at", F.when(F.col("id") == "2", F.lit("2020-01-01").cast("timestamp")))
    assert {r["id"]: r["score"] for r in memory_search.symbolic_boost(found, m, analyzed).collect()} == {"1": 0.7, "2": 0.6}
    assert [r["id"] for r in memory_search.symbolic_boost(found, m, analyzed, strict_time=True).collect()] == ["1"]


def test_reflect_adds_only_new_rows(spark):
    q = spark.createDataFrame([(1, "green walks nothing deadline", [1.0])], "query_id int, query string, embedding array<double>")
    v = spark.createDataFrame([("1", [1.0])], "id string, embedding array<double>")
    a = memory_search.analyze_query(q, F.lit("2024-03-08").cast("timestamp"))
    found = memory_search.keyword_search(memories(spark), q, 1)
    rows = memory_search.reflect(memories(spark), v, found, a, 5).collect()
    assert len({r["id"] for r in rows}) == len(rows) and found.first()["id"] in {r["id"] for r in rows if r["round"] == 0}


def chunks(spark):
    rows = [(1, "a.py", "f", "function", "x = 1", "", ["xy"]), (2, "a.py", "g", "function", "y = 2", "", []), (3, "b.py", "f", "function", "x  =  1", "", [])]
    c = spark.createDataFrame(rows, "ord int, file_path string, name string, type string, content string, summary string, keywords array<string>")
    return maintain.hashed_chunks(c)


def test_dedup_and_index(spark):
    c = chunks(spark)
    assert dedup_chunks(c).count() == 2
    assert [(r["n_chunks"], r["n_files"]) for r in dup_report(c).collect()] == [(2, 2)]
    index = build_symbol_index(c)
    assert {(r["symbol"], r["file_path"]) for r in index.collect()} == {("xy", "a.py")}
    again = c.where("ord = 2").withColumn("keywords", F.array(F.lit("new")))
    assert {(r["symbol"], r["file_path"]) for r in refresh_symbol_index(index, again).collect()} == {("new", "a.py")}


def test_chunk_lines_cover_the_file(spark):
    f = spark.createDataFrame([("a", "1\n2\n3\n4\n5"), ("b", ""), ("c", None)], "file_path string, content string")
    rows = chunk_lines(f, 2).orderBy("file_path", "start_line").collect()
    assert [(r["file_path"], r["content"], r["start_line"], r["end_line"]) for r in rows] == [("a", "1\n2", 1, 2), ("a", "3\n4", 3, 4), ("a", "5", 5, 5), ("b", "", 1, 1), ("c", "", 1, 1)]


def test_enriched_keywords(spark):
    text = "@app.route('/users/list', methods=['GET'])\ndef f():\n    raise KeyError\n    return db.insert('users')"
    found = one(spark, enriched_keywords(F.lit("UserStore.addUser"), F.lit("method"), F.lit(text), F.lit("Adds a Row by SQL"), F.array().cast("array<string>")))
    assert {"users", "users_table", "/users/list", "list", "get", "keyerror", "insert", "db", "user", "store", "add", "row", "sql", "method", "app.route"} <= set(found)


def test_delta_is_idempotent_and_upkeep(spark):
    c = chunks(spark)
    assert {r["change"] for r in maintain.delta_chunks(c, c).collect()} == {"unchanged"}
    v = spark.createDataFrame([("1", [1.0]), ("9", [2.0])], "id string, embedding array<double>")
    new = spark.createDataFrame([("1", [5.0])], "id string, embedding array<double>")
    assert {r["id"]: r["embedding"] for r in maintain.upsert_vectors(v, new).collect()} == {"1": [5.0], "9": [2.0]}
    assert [r["id"] for r in maintain.orphan_vectors(v, memories(spark)).collect()] == ["9"]
    seen = []

    def embed(df):
        seen.append(df.count())
        return df.select("id", F.array(F.lit(1.0)).alias("embedding"))

    once = maintain.embed_missing(memories(spark), v, embed)
    maintain.embed_missing(memories(spark), once, embed).count()
    assert seen == [2, 0]


def test_bulk_add(spark):
    m = memories(spark).withColumns({"agent_id": F.lit("a"), "memory_type": F.lit("semantic")})
    new = m.unionByName(m.withColumns({"id": F.concat(F.lit("n"), "id"), "content": F.when(F.col("id") == "1", F.lit(" ")).otherwise(F.concat("content", F.lit("!")))}))
    good, bad = maintain.bulk_add(m, new, skip_duplicates=True)
    assert {r["id"] for r in good.collect()} == {"n2", "n3"} and [r["id"] for r in bad.collect()] == ["n1"]
    assert maintain.bulk_add(m, new)[0].count() == 5


def test_versions(spark):
    a = spark.createDataFrame([("f", "1"), ("g", "2")], "file_path string, sha string")
    b = spark.createDataFrame([("f", "3"), ("h", "4")], "file_path string, sha string")
    assert versions.diff_snapshots(a, a).count() == 0
    log = versions.commit_delta(a.limit(0), a, 1).unionByName(versions.commit_delta(a, b, 2))
    assert sorted(versions.as_of(log, 1).collect()) == sorted(a.collect()) and sorted(versions.as_of(log, 2).collect()) == sorted(b.collect())
    assert versions.tree_hash(a.withColumn("k", F.lit(1)), ["k"]).first()["tree_sha"] != versions.tree_hash(b.withColumn("k", F.lit(1)), ["k"]).first()["tree_sha"]
    same = memories(spark).limit(1).unionByName(memories(spark).limit(1).withColumn("created_at", F.lit("2024-01-01").cast("timestamp")))
    assert same.select(versions.blob_hash("content")).distinct().count() == 1 and same.select(versions.blob_hash("content", parity=True)).distinct().count() == 2


def test_importers_and_dependencies(spark):
    c = spark.createDataFrame(
        [("a.py", 1, "f", "function", "import b\nfrom os.path import join", [("b.g", 3), ("f2", 4)]), ("a.py", 9, "f2", "function", "pass", []), ("b.py", 1, "g", "function", "import numpy", [])],
        "file_path string, start_line int, name string, type string, content string, calls array<struct<target:string,line:int>>",
    )
    d = {r["file_path"]: r for r in graph.dependency_graph(c).collect()}
    assert (d["a.py"]["imports"], d["a.py"]["external"], d["a.py"]["callees"], d["a.py"]["unused_names"]) == ("b,os.path", "os.path", "b.g,f2", "f")
    assert (d["b.py"]["external"], d["b.py"]["imported_by"], d["b.py"]["callers"], d["b.py"]["unused"]) == ("numpy", "a.py", "a.py:f", 0)
    used = {(r["file_path"], r["kind"], r["name"]) for r in graph.defined_and_used(c).collect()}
    assert ("b.py", "external", "g") in used and ("a.py", "unused", "f") in used and ("a.py", "unused", "f2") not in used
    found = graph.find_importers(c, spark.createDataFrame([("b",), ("x.path",), ("",)], "module string"))
    assert {(r["module"], r["file_path"], r["line"]) for r in found.collect()} == {("b", "a.py", 1), ("x.path", "a.py", 1)}


@pytest.mark.parametrize("paired", [0, 1000])
def test_components_of_random_graphs_equal_brute_force(spark, monkeypatch, paired):
    monkeypatch.setattr(graph, "PAIRED", paired)
    rnd = random.Random(7)
    for n, m in ((12, 14),) if paired == 0 else ((12, 14), (25, 40)):
        edges = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)}
        reach = {u: {u2 for u2 in ()} for u in range(n)}
        for u in range(n):
            todo = [u]
            while todo:
                for a, b in edges:
                    if a == todo[0] and b not in reach[u]:
                        reach[u].add(b)
                        todo.append(b)
                todo.pop(0)
        wanted = {}
        for u in range(n):
            own = {v for v in reach[u] if u in reach[v]}
            if own:
                wanted[u] = (min(own), len(own))
        got = graph.circular_dependencies(spark.createDataFrame(list(edges), "u int, v int")).collect()
        assert {r["node"]: (r["cycle"], r["size"]) for r in got} == wanted
    line = spark.createDataFrame([(1, 2), (2, 3)], "u int, v int")
    assert tuple(graph.dependency_kind(line.select(F.col("u").alias("module")), line).first()) == (2, 0, "DAG")


def test_commits(spark):
    log = spark.createDataFrame([(1, "a", "x", False)], "seq int, file_path string, sha string, deleted boolean")
    refs = spark.createDataFrame([("branch", "main", "0", 1)], "kind string, name string, sha string, seq int")
    staged = spark.createDataFrame([("a", "x"), ("b", "y")], "file_path string, sha string")
    after, now, stats = versions.commit(log, refs, staged, "main", 2)
    assert after.count() == 2 and tuple(stats.first()) == (2, 2) and versions.list_refs(now).first()["seq"] == 2
    with pytest.raises(ValueError):
        versions.commit(log, refs, staged.limit(0), "main", 2)
    commits = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None)], "sha string, parent string")
    heads = spark.createDataFrame([("main", "c")], "name string, sha string")
    assert [r["sha"] for r in versions.walk(commits, heads, 2).orderBy("depth").collect()] == ["c", "b"]


def test_names_as_text(spark):
    m = memories(spark).withColumns({"agent_id": F.lit("a"), "persons": F.lit("Ann, Bob ,"), "location": F.lit("Rome")})
    r = reports.agent_stats(m, spark.createDataFrame([("a",)], "agent_id string")).first()
    assert (r["persons"], r["locations"], r["documents"]) == (2, 1, 1)


def test_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), ("p", "q")], "u string, v string")
    assert {(r["node"], r["cycle"], r["size"]) for r in graph.circular_dependencies(e).collect()} == {("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("x", "x", 1)}
    assert graph.circular_dependencies(e.limit(0)).count() == 0


def test_definitions(spark):
    f = spark.createDataFrame([("a.py", "class A:\n    def m(self, x):\n        return g(x)\n\ndef f(): pass\n"), ("b.py", "def broken(:"), ("c.py", "")], "file_path string, content string")
    rows = {(r["file_path"], r["name"], r["kind"], r["start_line"], r["end_line"]) for r in chunk_definitions(f).collect()}
    assert rows == {("a.py", "A", "class", 1, 3), ("a.py", "A.m", "method", 2, 3), ("a.py", "f", "function", 5, 5), ("b.py", "", "file", 1, 1)}


def test_line_proximity_and_intent(spark):
    assert one(spark, cs.line_proximity(F.lit(10), F.lit(50), F.array(F.lit(20)))) == 0.5 + 0.4 * 0.5
    assert one(spark, cs.line_proximity(F.lit(10), F.lit(50), F.array(F.lit(55)))) == 0.3
    assert one(spark, cs.line_proximity(F.lit(10), F.lit(50), F.array().cast("array<int>"))) == 0.0
    assert [one(spark, cs.detect_intent(F.lit(t))) for t in ("at line 5", "list files", "where is it", "hash", "one two three four")] == ["line", "broad", "usage", "symbol", "concept"]


def test_evaluate(spark):
    e = spark.createDataFrame([(1, "c", "a"), (1, "c", "b")], "query_id int, category string, name string")
    f = spark.createDataFrame([(1, "a", 1), (1, "z", 2)], "query_id int, name string, rank int")
    r = cs.evaluate_retrieval(f, e).first()
    assert (r["relevance"], r["position"], r["passed"], r["verdict"]) == (50.0, 50.0, 1, "fair")


def test_rules(spark):
    m = memories(spark)
    assert {(r["id"], r["topic"]) for r in reports.auto_remember(m).collect()} == {("2", "dates")}
    assert one(spark, reports.should_remember(F.lit("I prefer my project"))[1]) == 0.7
    assert math.isclose(reports.token_savings(spark.createDataFrame([("a", "s", "hit", "f", 1)], "agent_id string, session_id string, action string, file_path string, tokens long"), spark.createDataFrame([], "agent_id string, file_path string, tokens long")).first()["hit_rate"], 100.0)


def test_sources(spark, tmp_path):
    m = memories(spark).withColumns({"agent_id": F.lit("a"), "memory_type": F.lit("semantic")})
    io.export_memories(m, f"{tmp_path}/m")
    assert io.read_memories(spark, f"{tmp_path}/m").count() == 3
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"x = '\xff'\n")
    row = io.read_corpus(spark, f"{tmp_path}/src", "*.py").first()
    assert row["content"] == "x = '\ufffd'\n" and row["size_bytes"] == 8


def test_caps(spark):
    s = spark.createDataFrame([("a", 0, 10), ("a", 5, 15), ("a", 10, 12)], "k string, start int, end int")
    r = streams.concurrency_caps(s, ["k"], 1).first()
    assert (r["most"], r["over"]) == (2, 2)
