"""Stored logs and pages: exact, and with little read; CSV, bundles and ids of imports; long histories."""

import random

from pyspark.sql import functions as F

from recollect.operators import stored, versions
from recollect.sources import io


def test_state_from_a_snapshot_and_few_deltas(spark, tmp_path):
    rnd, rows, state, states = random.Random(4), [], {}, {}
    for seq in range(1, 61):
        for f in rnd.sample([f"f{i}" for i in range(30)], 3):
            gone = f in state and rnd.random() < 0.3
            rows.append((seq, f, f"{f}-{seq}", gone))
            state.pop(f, None) if gone else state.update({f: f"{f}-{seq}"})
        states[seq] = dict(state)
    log = spark.createDataFrame(rows, stored.LOG)
    one, many = f"file://{tmp_path}/one", f"file://{tmp_path}/many"
    stored.store_log(log, one, 10)
    for seq in range(1, 25):
        stored.append_commit(many, log.where(F.col("seq") == seq), seq, 10)
    of = lambda df: {r["file_path"]: r["sha"] for r in df.collect()}
    for seq in (1, 9, 10, 11, 20, 24, 59, 60):
        assert of(stored.state_at(spark, one, seq, 10)) == states[seq] == of(versions.as_of(log, seq))
        if seq <= 24:
            assert of(stored.state_at(spark, many, seq, 10)) == states[seq]
    # a late commit reads one snapshot and the one commit behind it, of 60
    late = spark.read.schema(stored.LOG + ", part long, seq_of_commit long").parquet(f"{one}/deltas")
    assert stored.files_read(late.where("part >= 5 and part <= 5 and seq_of_commit <= 51")) <= 0.1 * stored.files_read(late)
    stored.store_log(log.limit(0), f"file://{tmp_path}/none", 10)


def test_pages_read_their_ranges(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "a", "a", "b", "c"]), rnd.randrange(50), i) for i in range(2000)] + [("a", 7, -1), (None, 3, -2)]
    df = spark.createDataFrame(rows, "k string, t int, i int")
    pages = stored.Pages(df, ["k"], [("t", True), ("i", False)], f"file://{tmp_path}/p", 100)
    for offset, limit in ((0, 5), (390, 25), (1190, 100), (5000, 5)):
        got = {(r["k"], r["rank"], r["i"], r["total"]) for r in pages.page(offset, limit).collect()}
        want = set()
        for k in ("a", "b", "c"):
            own = sorted(((-t, i) for x, t, i in rows if x == k))
            want |= {(k, n, i, len(own)) for n, (_, i) in enumerate(own, 1) if offset < n <= offset + limit}
        assert {x for x in got if x[0] is not None} == want
    inside = pages.starts().where("before < 1295 and before + n > 1190")
    assert inside.count() <= 3 < pages.counts.count() / 4


def test_csv_bundle_and_ids(spark, tmp_path):
    rows = [("a", "1", 1, 'a "quoted", text\nof two lines', "semantic", ["x", "y,z"], [], None, 0.5), ("b", "2", 2, "", None, None, ["Ann"], "", None), ("b", "3", 3, None, None, [], None, "t", 1.0)]
    m = spark.createDataFrame(rows, "agent_id string, id string, ord long, content string, memory_type string, keywords array<string>, persons array<string>, topic string, importance double").withColumn("created_at", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    for kind in ("csv", "json", "parquet"):
        io.export_memories(m, f"file://{tmp_path}/{kind}", kind)
        got = io.read_memories(spark, f"file://{tmp_path}/{kind}", kind)
        assert sorted(map(repr, got.select(m.columns).collect())) == sorted(map(repr, m.collect()))
    io.export_bundle(m, m.select("agent_id", "id", "content"), m.select("agent_id", "id"), f"file://{tmp_path}/bundle")
    read = io.import_bundle(spark, f"file://{tmp_path}/bundle", "agent_id string, id string, content string", "agent_id string, id string")
    assert {k: v.count() for k, v in read.items()} == {"memories": 3, "documents": 3, "checkpoints": 3}
    now = F.lit("2024-05-01").cast("timestamp")
    ids = lambda df: sorted((r["source_id"], r["id"]) for r in io.import_memories(df, now)[0].collect())
    twice = m.unionByName(m)
    assert ids(twice) == ids(twice.repartition(3)) and len({i for _, i in ids(twice)}) == 2


def test_long_histories(spark):
    """2,500 commits in a row: over Spark's levels of recursion."""
    commits = spark.createDataFrame([(f"c{i}", f"c{i - 1}" if i else None) for i in range(2500)], "sha string, parent string")
    heads = spark.createDataFrame([("main", "c2499"), ("old", "c5"), ("none", "x")], "name string, sha string")
    found = {(r["name"], r["depth"]): r["sha"] for r in versions.walk(commits, heads, 2000).collect()}
    assert found == {("main", d): f"c{2499 - d}" for d in range(2000)} | {("old", d): f"c{5 - d}" for d in range(6)}
