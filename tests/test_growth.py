"""What steps hand on between stages and hold at once grows no faster than the rows that they read."""

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from recollect.operators import code_search as cs
from recollect.operators import definitions, grouped, maintain, memory_search
from recollect.plans import registry
from tests.conftest import SF


def shuffled(spark, run) -> int:
    """Rows that the stages of run() shuffled."""
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    run()
    after = stages()
    return sum(after.apply(i).shuffleWriteRecords() for i in range(after.size()) if after.apply(i).stageId() not in before)


def test_a_chunk_leaves_tasks_as_one_row(spark):
    """A chunk's words aren't rows: before, each of the 60 words of a chunk that the query has was a shuffled row."""
    text = " ".join(f"word{k}" for k in range(60))
    c = spark.range(2000).select(F.col("id").alias("ord"), F.concat(F.lit("d"), F.col("id") % 7, F.lit(".md")).alias("file_path"), F.concat(F.lit("c"), "id").alias("name"), F.lit("block").alias("type"), F.lit(text).alias("content"), F.lit("").alias("summary"))
    c = c.withColumn("keywords", F.array().cast("array<string>"))
    q = cs.prepared_queries(spark.createDataFrame([(1, text), (2, text + " d3.md")], "query_id int, query string"), 5, {})
    found: list = []
    rows = shuffled(spark, lambda: found.extend(cs.term_idf(cs.lowered(c), q).collect()))
    assert {(r["query_id"], round(r["idf"], 6)) for r in found if r["term"] == "word5"} == {(1, 1.0), (2, 1.0)}
    print(f"{rows} rows shuffled for 2000 chunks")
    assert rows < 20_000


def test_postings_of_chunks(spark):
    """Each flag of a text, over one block of texts and over several; a null keyword leaves the rest of its chunk."""
    rows = [
        (1, "a.PY", "store.addUser", "Reset the\tpassword now", "x = get/it\nuser_id", ["userStore", None]), (2, None, None, None, None, None),
        (3, "b.py", "past", "the password", "σ past ünd naïve", ["ΑΣ.Be"]), (4, "b.py", "stored", "", "", []),
    ]
    c = spark.createDataFrame(rows, "ord int, file_path string, name string, summary string, content string, keywords array<string>").withColumn("type", F.lit("block"))
    asked = [("term", x) for x in ("store", "user", "adduser", "past", "password", "user_id", "ας", "be", "stor", "na")] + [("route", "t/it"), ("bigram", "the password"), ("bigram", "word now")]
    texts = cs.asked_texts(spark.createDataFrame(asked, "sort string, text string"))
    names = {r["t"]: r["text"] for r in texts.collect()}
    want = {
        1: {"store": "bag in_name related within", "user": "bag within", "adduser": "bag in_name within", "password": "bag in_summary", "user_id": "bag in_content", "stor": "related within", "t/it": "route", "word now": "bigram"},
        2: {}, 3: {"past": "bag whole in_content in_name within", "password": "bag in_summary", "ας": "bag", "be": "bag", "na": "bag in_content", "the password": "bigram"},
        4: {"store": "within", "stor": "within"},
    }
    for size in (3, 100):
        got = {r["ord"]: {names[x["t"]]: {f for i, f in enumerate(cs.FEATURES) if x["bits"] >> i & 1} for x in r["found"]} for r in cs.postings_of(cs.lowered(c), texts, size).collect()}
        assert got == {k: {t: set(v.split()) for t, v in x.items()} for k, x in want.items()}


def test_index_keys_make_no_automata(spark, monkeypatch):
    """Automata are made of symbols alone: before, all keys of the index were collected too, one automaton after another."""
    made = []
    real = cs.automata
    monkeypatch.setattr(cs, "automata", lambda patterns, size=cs.PATTERNS: (made.append(1) or x for x in real(patterns, size)))
    index = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("symbol"), F.lit("f.py").alias("file_path")).unionByName(spark.createDataFrame([("ük", "g.py"), ("xk7y", "h.py"), ("", "g.py")], "symbol string, file_path string"))
    c = spark.createDataFrame([(1, "f.py", "n", "see ak7b", []), (2, "g.py", "n", "see k7 and ükk", []), (3, "h.py", "n", "k7", [])], "ord int, file_path string, name string, content string, keywords array<string>")
    symbols = spark.createDataFrame([("ak7b",), ("k7",), ("ükk",)], "symbol string")
    assert {(r["symbol"], r["ord"]) for r in cs.symbol_references(c, index, symbols, size=100).collect()} == {("ak7b", 1), ("k7", 1), ("k7", 3), ("ükk", 2)}
    assert len(made) == 2


def test_large_files_are_parsed_in_parts(monkeypatch):
    """Parts give the definitions of the whole file, wherever they are cut, and a large file needs memory for its rows alone."""
    text = "import a\r\nx = '''\ndef no(): pass\nclass no: pass\n'''\n@d(\n1)\nclass A:\n    def m(self, x):\n        s = \"\"\"\n@ b\ndef no2(): pass\n\"\"\"\n        return g(x)\n\nif x:\n    def f(): pass\nelse:\n    def h(): k.l()\rasync def q(a, *, b): await r()\n\x0cdef last(): pass"
    whole = list(definitions.definitions_of(text))
    assert [x[0] for x in whole] == ["A", "A.m", "f", "h", "q", "last"] and [x[2] for x in whole] == [6, 9, 17, 19, 20, 21]
    for part in (1, 7, 40):
        monkeypatch.setattr(definitions, "PART", part)
        assert list(definitions.definitions_of(text)) == whole
        assert definitions.batches_of("f", text + "\ndef broken(:")[0].to_pylist() == [{"hash": "f", "name": "", "kind": "file", "start_line": 1, "end_line": text.count("\n") + 2, "parameters": [], "calls": []}]
    monkeypatch.undo()
    large = "\n".join(f"@app.route('/x')\ndef part_{k}(a, b):\n    rows = self.db.query('x')\n    return part_{k}(rows, a)" for k in range(20_000))
    tracemalloc.start()
    rows = sum(b.num_rows for b in definitions.batches_of("f", large))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    print(f"{peak:.0f} MB of Python objects for {len(large) / 1e6:.1f} MB of text")
    assert rows == 20_000 and peak < 20


def test_small_files_give_work_to_all_cores(spark):
    """A file that can't be split was one task, whatever its rows cost."""
    for name in ("embedding_text", "enrich_keywords", "qa_hints"):
        assert registry.QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_words_to_hash_are_not_rows(spark):
    """An item is one row between stages, whatever its words: before, each bucket of its words was one. Rows of an id are added up."""
    items = spark.range(500).select(F.col("id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.translate((k * 977 + F.col("id")).cast("string"), "0123456789", "abcdefghij")), " ").alias("content"))
    odd = spark.createDataFrame([(1000, "Alpha beta"), (1000, "ALPHA"), (1001, "12 ü"), (1002, None)], "id long, content string")
    found: list = []
    rows = shuffled(spark, lambda: found.extend(maintain.hash_embed(items.unionByName(odd), 64).collect()))
    got = {r["id"]: r["embedding"] for r in found}
    assert len(got) == 501 and sorted(x for x in got[1000] if x) == [1 / 5**0.5, 2 / 5**0.5] and rows < 1000


def test_cosines_are_whole_and_dealt_out(spark, tmp_path, monkeypatch):
    """An id that comes twice gives its two rows a query, not four; each block of vectors is a task of its own; the pairs of a row
    follow each other in small batches, so that a file's ids take a sixth of a byte a pair here (before, 0.28)."""
    monkeypatch.setattr(memory_search, "BLOCK", 256)
    monkeypatch.setattr(memory_search, "LEAVING", 16)
    spark.read.parquet(f"{SF}/embeddings.parquet").createOrReplaceTempView("given")
    shifted = "union all select vec_id + 1000 * k, transform(embedding, (x, i) -> cast(x + i % (k + 2) as float)), label from given lateral view explode(sequence(1, 3)) as k"
    spark.sql(f"select vec_id, embedding, label from given {shifted} union all select 3, array_repeat(0.5f, 64), 0").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    made = registry.QUERIES["cosine"](spark, str(tmp_path))
    made.write.parquet(f"{tmp_path}/out")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    con.sql(f"create view ours as select vec_id, query_id, cosine from '{tmp_path}/out/*.parquet'")
    con.sql(f"create view theirs as {registry.SQL['cosine']}")
    ours, theirs = (con.sql(f"select * from {t} order by all").fetchnumpy() for t in ("ours", "theirs"))
    assert len(ours["cosine"]) == len(theirs["cosine"]) == 2001 * 100
    assert (ours["vec_id"] == theirs["vec_id"]).all() and (ours["query_id"] == theirs["query_id"]).all() and abs(ours["cosine"] - theirs["cosine"]).max() < 2e-6
    files = con.sql(f"select file_name, sum(total_compressed_size) filter (path_in_schema <> 'cosine'), sum(num_values) filter (path_in_schema = 'cosine') from parquet_metadata('{tmp_path}/out/*.parquet') group by 1").fetchall()
    print(f"{sum(f[1] for f in files)} bytes of ids for {sum(f[2] for f in files)} pairs in {len(files)} files")
    assert len(files) == 8 and max(f[2] for f in files) < 400 * 100
    assert sum(f[1] for f in files) < 0.2 * sum(f[2] for f in files)


def test_best_matches_of_a_block(spark, monkeypatch):
    """The best of each query and block, ties by ord, with vectors of another length, zero vectors and none."""
    m = spark.createDataFrame([(str(i), i) for i in range(9)], "id string, ord long")
    x = [[1.0, 0.0], [2.0, 0.0], [1.0, 1.0], [0.0, 0.0], [-1.0, 0.0], [1.0, 0.0, 0.0], None, [0.0, 3.0]]
    v = spark.createDataFrame([(str(i), e) for i, e in enumerate(x)], "id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None)], "query_id int, embedding array<double>")
    found = lambda *a: sorted(tuple(r) for r in memory_search.semantic_matches(m, v, q, *a).collect())
    assert found(2) == [(1, "0", 0, 1.0), (1, "1", 1, 1.0), (2, "0", 0, 0.0), (2, "1", 1, 0.0), (3, "5", 5, 0.0)]
    every = [(1, str(i), i, s) for i, s in ((0, 1.0), (1, 1.0), (2, 0.707107), (3, 0.0), (4, -1.0), (7, 0.0))] + [(2, str(i), i, 0.0) for i in (0, 1, 2, 3, 4, 7)] + [(3, "5", 5, 0.0)]
    assert found(None, -1.0) == every
    monkeypatch.setattr(memory_search, "BLOCK", 1)
    monkeypatch.setattr(memory_search, "QUERY_BLOCK", 1)
    monkeypatch.setattr(memory_search, "SENT", 0)
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert found(None, -1.0) == every
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_keyword_words_are_looked_up_once(spark, monkeypatch):
    """Queries of the same words are one, and a token that comes again in another block isn't searched again; sums by parts, without
    the product of matrices or in pieces of one memory are the same."""
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "xyz"]
    rows = [(str(i), i, " ".join(words[(i * k) % 24] for k in range(1, 9)), [words[i % 24]], [], "topic", 0.1 * (i % 5)) for i in range(60)]
    schema = "id string, ord long, content string, keywords array<string>, persons array<string>, topic string, importance double"
    m = spark.createDataFrame(rows, schema)
    q = spark.createDataFrame([(i, " ".join(words[(i % 4) * 5 : (i % 4) * 5 + 6])) for i in range(40)], "query_id int, query string")
    asked = []
    monkeypatch.setattr(memory_search, "grouped_top", lambda held, groups, *a, real=memory_search.grouped_top, **k: real(held, (asked.append(len(g.numbers)) or g for g in groups), *a, **k))
    assert memory_search.keyword_search(m, q, 3).count() == 120 and asked == [4]

    lowered = [{"id": r[0], "ord": r[1], "weight": r[6], "l_content": r[2], "l_topic": r[5], "l_keywords": r[3], "l_persons": r[4]} for r in rows]
    found = []
    for packed, often, cells in ((True, 96, 1 << 16), (True, 0, 1), (False, 0, 1 << 16)):
        group = memory_search.AskedWords(np.arange(4), [words[k * 5 : k * 5 + 6] for k in range(4)])
        group.packed, group.often = packed, group.often[:often]
        monkeypatch.setattr(memory_search, "CELLS", cells)
        best, seen = grouped.Best(np.full(4, 0.3), 3), []
        monkeypatch.setattr(memory_search, "_found", lambda automaton, texts, real=memory_search._found, seen=seen: seen.extend(texts) or real(automaton, texts))
        for at in range(0, 60, 20):
            group.add(pa.array(lowered[at : at + 20]), best)
        assert len(seen) == len(set(seen)) == 25
        best.cut()
        found.append([c.tolist() for c in best.parts[0]])
    assert found[0] == found[1] == found[2] and len(found[0][0]) == 12
