"""Collocations, clusters and the classifier: against brute force, on odd rows, and by held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from recollect.llm import classifier, collocations, clusters, queries, runs, shared
from tests.conftest import SF


def brute_phrases(rows, top, longest, least, share):
    """(lang, rank, phrase, a, l, r, n, score) of rows (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    frequent = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for p, a in frequent.items():
        inside = any(len(q) > len(p) and q[0] == p[0] and 100 * b >= share * a and any(q[i : i + len(p) - 1] == p[1:] for i in range(1, len(q))) for q, b in frequent.items())
        if not inside:
            cuts = [(math.floor(Fraction(10**6 * a * a, f[p[: k + 1]] * f[(p[0], *p[k + 1 :])])), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1)]
            score, _, left, right = min(cuts)
            out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}


def odd_rows():
    rnd = random.Random(3)
    words = ["The", "cat", "SAT", "é", "日本", "ÀB", "x\x0by", "don't", "a" * 3000]
    rows = [(None, None), ("en", ""), ("en", " \t\n.,"), (None, "the cat. the cat, the cat"), ("fr", "the cat"), ("en", "a" * 100_000)]
    for _ in range(120):
        rows.append((rnd.choice(["en", "en", "de", None]), "".join(rnd.choice(words[:-1]) + rnd.choice([" ", "  ", "\t", ". ", ",", "\n", " "]) for _ in range(rnd.randrange(1, 60)))))
    return rows + rows[-5:] + [("en", "w1 w2 w3 " * 4000)]


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations_equal_brute_force(spark, longest):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(7) for c in ("h1", "key", "a", "n", "word", "rank", "salt")})
    got = collocations.collocations(docs, top=15, longest=longest, least=4, share=60).collect()
    assert {tuple(r) for r in got} == brute_phrases(rows, 15, longest, 4, 60) and len(got) == len({tuple(r) for r in got})
    assert collocations.collocations(docs.limit(0), top=5).count() == 0
    assert collocations.collocations(docs.limit(2), top=5).count() == 0


def test_collocations_of_texts_in_parts(monkeypatch):
    """A long text cut into parts anywhere has the phrases of the whole."""
    rnd = random.Random(9)
    text = "".join(rnd.choice(["aa", "b", "cc", "d" * 40]) + rnd.choice([" ", ". ", "  "]) for _ in range(3000)).encode()
    for size in (30, 333, 10_000):
        monkeypatch.setattr(collocations, "parts", lambda t, s, size=size: runs.parts(t, s, size))
        monkeypatch.setattr(collocations, "SIZE", 10)
        held = list(collocations.shards_of(["x"], [text], 3, 0))
        words = Counter()
        for _, _, hashes, _, distinct, counts in held:
            words.update(dict(zip(distinct, counts.tolist())))
        bits = [np.full(collocations.SLOTS, 2**64 - 1, np.uint64)] * 2
        name = {int(h): w for row in held for h, w in zip(row[2], row[4])}
        found, three = Counter(), Counter()
        for ids, lead, hashes, *_ in held:
            for n, into in ((1, found), (2, three)):
                columns, counts = collocations.occurring(ids, lead, hashes, bits[:n])
                for *key, c in zip(*columns, counts):
                    into[tuple(name[int(h)] for h in key)] += int(c)
        pieces = [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.]", text.decode())]
        assert words == Counter(w for p in pieces for w in p)
        assert found == Counter(t for p in pieces for t in zip(p, p[1:])) and three == Counter(t for p in pieces for t in zip(p, p[1:], p[2:]))
        columns = [np.array([h for h, w in sorted(name.items())])] * 3
        grid = np.array(np.meshgrid(*columns)).reshape(3, -1)
        both = np.concatenate([grid, np.unique(grid[:2], axis=1)[[0, 1, 1]]], 1)
        trie = collocations.DoubleArray(list(both), np.repeat([3, 2], [grid.shape[1], both.shape[1] - grid.shape[1]]))
        into = np.zeros(len(trie.base), np.int64)
        for ids, lead, hashes, *_ in held:
            trie.counts(ids, lead, hashes, into)
        told = {tuple(name[h] for h in k): a for k, a in zip(*(trie.told(0, into)[c].to_pylist() for c in ("key", "a")))}
        assert told == dict(found | three)


def test_double_array_of_many_words():
    """Wide and narrow nodes, several digits: every phrase counts once, others never."""
    rnd = np.random.default_rng(2)
    hashes = np.unique(rnd.integers(-(2**62), 2**62, 70_000))
    first = np.concatenate([np.full(40_000, hashes[5]), rnd.choice(hashes, 60_000)])
    second = np.concatenate([hashes[:40_000], rnd.choice(hashes, 60_000)])
    pairs = np.unique(np.stack([first, second]), axis=1)
    trie = collocations.DoubleArray([pairs[0], pairs[1]], np.full(pairs.shape[1], 2))
    asked = np.concatenate([pairs, np.stack([rnd.choice(hashes, 50_000), rnd.choice(hashes, 50_000)])], 1)
    local, ids = np.unique(asked, return_inverse=True)
    stream = np.insert(ids.reshape(asked.shape).T + 1, 2, 0, axis=1).ravel()
    into = np.zeros(len(trie.base), np.int64)
    trie.counts(stream, 0, local, into)
    known = set(map(tuple, pairs.T.tolist()))
    want = Counter(p for p in map(tuple, asked.T.tolist()) if p in known)
    assert {tuple(k): a for k, a in zip(*(trie.told(0, into)[c].to_pylist() for c in ("key", "a")))} == want


def brute_clusters(rows, k, rounds, size):
    """rows: (id, vector). (id, cluster, distance, cluster inertia, inertia, hash) in whole numbers of Python."""
    kept = [(i, [math.floor(1024 * float(v)) for v in x]) for i, x in rows if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [x for _, x in sorted(kept, key=key)[:k]]
    square = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    nearest = lambda x: min(range(len(centroids)), key=lambda c: (square(x, centroids[c]), c))
    for _ in range(rounds):
        groups: dict = {}
        for _, x in kept:
            groups.setdefault(nearest(x), []).append(x)
        centroids = [[sum(v) // len(groups[c]) for v in zip(*groups[c])] if c in groups else old for c, old in enumerate(centroids)]
    told = [(i, c := nearest(x), square(x, centroids[c])) for i, x in kept]
    own = Counter()
    for _, c, d in told:
        own[c] += d
    whole = lambda v: v if v < 2**63 else None
    return sorted([(i, c, min(d, 2**63 - 1), whole(own[c]), whole(sum(own.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in told], key=repr)


def test_clusters_equal_brute_force(spark):
    rnd = random.Random(4)
    vector = lambda: [rnd.gauss(0, 1) for _ in range(5)]
    rows = [(i, vector()) for i in range(150)] + [(None, vector()), (None, None), (7, [1.0] * 5), (7, [1.0] * 5), (7, [1.0] * 5), (3, vector())]
    rows += [(900, [1.0, None, 1.0, 1.0, 1.0]), (901, [float("nan")] * 5), (902, [float("inf")] * 5), (903, [1.0] * 4), (904, []), (905, [3e6, -3e6, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(7) for c in ("id", "x", "zone", "cluster", "d", "n")})
    for k, rounds, bits in ((8, 10, 8), (3, 2, 4), (200, 1, 8), (1, 3, 2), (4, 0, 8)):
        got = clusters.clusters(df, k=k, rounds=rounds, size=5, bits=bits).collect()
        assert sorted(map(tuple, got), key=repr) == brute_clusters(rows, k, rounds, 5)
    assert clusters.clusters(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [0.5] * 5) for i in range(20)], "vec_id long, embedding array<float>")
    assert {(r["cluster"], r["distance"]) for r in clusters.clusters(same, size=5).collect()} == {(0, 0)}


def test_clusters_fetch_only_open_rows(spark):
    """On clustered vectors most rows are decided by their cells, and whole zones aren't read."""
    rnd = np.random.default_rng(5)
    x = np.concatenate([rnd.normal(c * 3, 0.2, (300, 16)) for c in range(-3, 4)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = clusters.whole_vectors(df, 16, 1024, "vec_id", "embedding")
    centroids = [np.floor(1024 * x[300 * k : 300 * (k + 1)].mean(0)).astype(int).tolist() for k in range(7)]
    file = clusters.VaFile(rows, centroids, clusters.marks(rows, 16, 6))
    moved = [[v + 3 for v in c] for c in centroids]
    gain, n, fetched = file.moves(centroids, moved)
    exact = [clusters.nearest(np.array([r["x"] for r in file.rows.collect()]), c)[0] for c in (centroids, moved)]
    assert n == (np.bincount(exact[1], minlength=7) - np.bincount(exact[0], minlength=7)).tolist()
    assert sum(fetched.values()) < len(x) // 2 and len(fetched) < file.rows.select("zone").distinct().count()
    plan = file.rows.where(F.col("zone").isin(list(fetched))).select("cells", "x")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [zone" in plan or "zone#" in plan.split("PartitionFilters")[1][:40]


def test_op12_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(60).collect()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, clusters.clusters(df).collect()), key=repr) == brute_clusters(rows, 8, 10, 64)


def test_classifier_by_held_out_labels(spark):
    got = {r["doc_id"]: r for r in queries.op13_classifier(spark, SF.replace("0.001", "0.01")).collect()}
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    assert len(got) == docs.count() and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    told = [(got[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    good, bad = [g["score"] for g, y in told if y == 1], [g["score"] for g, y in told if y == 0]
    assert sum(a > b for a in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert sum(g["predicted"] == y for g, y in told) >= 0.9 * len(told)


def test_classifier_odd_rows(spark):
    rows = [(None, "a b c"), (1, None), (2, ""), (3, "one two three"), (3, "one two three"), (4, "one two three"), (5, "x" * 200_000), (6, "w1 w2, " * 60_000)] + [(i, f"good words {i}") for i in range(10, 40)] + [(i, "bad | bad |") for i in range(40, 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("y", "x", "n", "bucket", "score")})
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(10, 70)] + [(None, 1, 0), (11, None, 0), (12, 5, 0), (13, 0, 0), (13, 0, 0)], "doc_id long, quality int, toxic int")
    got = classifier.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4)}) == 1 and len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert all(r["predicted"] == (r["doc_id"] < 40) for r in got if (r["doc_id"] or 0) >= 14)
    few = classifier.quality_scores(docs, labels.where("quality = 1 and doc_id < 13")).collect()
    assert len({round(r["score"], 9) for r in few}) == 1
    assert len({r["score"] for r in classifier.quality_scores(docs, labels.limit(0)).collect()}) == 1
    assert classifier.quality_scores(docs.limit(0), labels).count() == 0


def test_trie_counts_by_slices_of_a_shard(monkeypatch):
    """Positions moved on 7 at a time: the counts of all at once, at the cuts too."""
    from recollect.llm import collocations as c

    rnd = np.random.default_rng(2)
    hashes, ids = np.arange(10, 16), rnd.integers(0, 7, 500).astype(np.int32)
    pairs = [(a, b) for a in hashes for b in hashes]
    trie = c.DoubleArray([np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])], np.full(len(pairs), 2))
    monkeypatch.setattr(c, "MOVED", 7)
    into = np.zeros(len(trie.base), np.int64)
    trie.counts(ids, 0, hashes, into)
    told = trie.told(0, into).to_pydict()
    want = {}
    for a, b in zip(ids, ids[1:]):
        if a and b:
            want[int(hashes[a - 1]), int(hashes[b - 1])] = want.get((int(hashes[a - 1]), int(hashes[b - 1])), 0) + 1
    assert {tuple(k): n for k, n in zip(told["key"], told["a"])} == want


def test_shards_stand_in_small_row_groups(spark, tmp_path, monkeypatch):
    """Shards of one task: a row group ends at its size after any shard, and not only after a hundred."""
    monkeypatch.setattr(collocations, "SHARD_GROUP", 1 << 16, raising=False)
    docs = spark.range(6).coalesce(1).selectExpr("'en' as lang", "concat_ws(' ', transform(sequence(1L, 800000L), x -> concat('w', pmod(x * 7919 + id, 5000)))) as text")
    monkeypatch.setattr(collocations, "written", lambda df, name, **k: shared.written(df, name, path=f"{tmp_path}/{name}", **k))
    held = collocations.shards(docs, 3, 0, "lang", "text")
    groups = [pq.ParquetFile(f).metadata for f in tmp_path.glob("shards/*.parquet")]
    assert held.count() == sum(m.num_rows for m in groups) >= 6
    assert max(m.row_group(k).num_rows for m in groups for k in range(m.num_row_groups)) == 1
