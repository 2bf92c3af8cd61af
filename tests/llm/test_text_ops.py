"""BPE, token files, token counts, quality rules: against the library, brute force and hand-made rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recollect.llm import bpe as bpe_module
from recollect.llm import queries, quality, token_counts, token_files
from tests.conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "Hello wörld's", "ΑΣ Σ <|endoftext|>x<|startoftext|>", "é ́ a\x1cb\x1d c\x85d", "aaaa" * 300, "İstanbul ǅ ß ﬁ Ⅳ ²½ ٣٤", "日本語 テスト👍🏽 ‍ zero​width",
    "don't WE'LL I'M x's 's 't", " a b ﻿\x00\x01", "word " * 5000, "<|endoftext|>", "a,b. c...",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_docs(spark):
    """Nulls in every column, odd texts, repeated rows and ids, and columns with clashing names."""
    rows = [(i if i % 5 else None, t, None, "s", 1) for i, t in enumerate(ODD)] + [(3, ODD[3], None, "s", 1), (3, ODD[3], None, "s", 1), (3, "other", "en", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(7) for c in ("id", "key", "ids", "row", "n_words", "place", "kept")})


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_bpe_equals_library(spark, library):
    docs = odd_docs(spark)
    rows = bpe_module.bpe(docs, PATH).collect()
    texts = [r["text"] for r in docs.select("text").collect()]
    assert [list(r["ids"]) for r in rows] == [ids_of(library, t) for t in texts]
    assert [r["decoded"] for r in rows] == [library.decode(ids_of(library, t), skip_special_tokens=False) for t in texts]
    assert bpe_module.bpe(docs.limit(0), PATH).count() == 0


def test_bpe_random_texts(library):
    c, rnd = bpe_module.codec(PATH), random.Random(5)
    for _ in range(1500):
        text = "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0, 0x300), rnd.randrange(0x300, 0xD7FF), rnd.randrange(0xE000, 0x1FFFF)])) for _ in range(rnd.randrange(1, 40)))
        assert c.encode(text) == ids_of(library, text)


def test_bpe_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe_module, "CACHE", 3)
    c = bpe_module.Codec(PATH)
    text = "several words that are more than the cache and several words again"
    assert c.encode(text) == ids_of(library, text)


def test_op9_query(spark, library):
    rows = {r["doc_id"]: r for r in queries.op9_bpe(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = ids_of(library, r["text"])
        got = rows[r["doc_id"]]
        assert got["n_tokens"] == len(ids) and got["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def expected_files(library, docs):
    """docs: (id, text, hash of the text), which is the order of the files."""
    out, start = [], 0
    for key, text, _ in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[2])):
        ids = [*ids_of(library, text), 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, library, tmp_path):
    docs = odd_docs(spark)
    token_files.write_token_files(docs, f"{tmp_path}/f", PATH)
    got = sorted(map(tuple, token_files.file_digests(spark, f"{tmp_path}/f").collect()), key=lambda r: r[1])
    assert got == expected_files(library, [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64("text")).collect()])
    few = token_files.read_token_files(spark, f"{tmp_path}/f", [4, 99]).collect()
    assert [r["id"] for r in few] == [4] and np.frombuffer(few[0]["data"], "<u4").tolist() == [*ids_of(library, ODD[4]), 2]
    token_files.write_token_files(docs.limit(0), f"{tmp_path}/empty", PATH)
    assert token_files.file_digests(spark, f"{tmp_path}/empty").count() == 0


def test_op3_query(spark, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.xxhash64("text")).collect()]
    assert sorted(map(tuple, queries.op3_token_files(spark, SF).collect()), key=lambda r: r[1]) == expected_files(library, docs)


def test_token_files_random_texts(library, monkeypatch):
    """Latin and other letters, contractions, symbols, special tokens, white space of all kinds; a cache that overflows."""
    monkeypatch.setattr(token_files, "CACHE", 50)
    e, rnd = token_files.Encoder(PATH), random.Random(6)
    latin = [*map(chr, range(1, 0x250)), "'s", "'T", "'", " ", " ", "<|endoftext|>"]
    some = [*map(chr, range(32, 127)), *" " * 20, "\u0301", "\u2003", "\u03a3", "\U0001f642", "'re", "\x1c", "\x85", "\xa0"]
    texts = ["".join(rnd.choice(latin if k % 2 else some) for _ in range(rnd.randrange(60))) for k in range(4000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.serialized(pa.array(texts), b"")] == [ids_of(library, t) for t in texts]
    assert e.serialized(pa.array([None, "a" * 300_000, "b " * 300_000]).slice(1), b"\2\0\0\0")[0] == np.array([*ids_of(library, "a" * 300_000), 2], "<u4").tobytes()


def test_rows_of_one_id_are_split(spark, tmp_path):
    for k, key in enumerate((5, None)):
        docs = spark.createDataFrame([(key, f"text number {i % 100}") for i in range(4000)], "doc_id long, text string")
        token_files.write_token_files(docs, f"{tmp_path}/{k}", PATH)
        parts = spark.read.parquet(f"{tmp_path}/{k}/blocks").groupBy("part").agg(F.sum(F.size("ids")).alias("n")).collect()
        assert len(parts) == 4 and max(r["n"] for r in parts) < 2500


def test_dictionary_helps_and_is_named(spark, tmp_path):
    token_files.write_token_files(spark.read.parquet(f"{SF}/documents.parquet"), f"{tmp_path}/f", PATH)
    d = spark.read.parquet(f"{tmp_path}/f/dictionary").first()
    assert len(d["dictionary"]) > 1000 and hashlib.sha256(d["dictionary"]).hexdigest() == d["dict_sha256"]
    assert spark.read.parquet(f"{tmp_path}/f/blocks").select("dict_sha256").distinct().collect()[0][0] == d["dict_sha256"]


def best_tokens(word, scores, byte_score):
    """Fewest tokens of the best segmentation, by trying all pieces that end at each place."""
    text = token_counts.MARK + word
    best = [(0, 0)]
    for d in range(1, len(text) + 1):
        width = len(text[d - 1].encode())
        options = [(best[d - 1][0] + width * byte_score, -(best[d - 1][1] + width))]
        options += [(best[s][0] + scores[text[s:d]], -(best[s][1] + 1)) for s in range(d) if text[s:d] in scores]
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_token_counts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores, byte_score = token_counts.unigram_scores(path)
    docs = odd_docs(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet").limit(60), allowMissingColumns=True)
    for r, text in zip(token_counts.token_counts(docs, path).collect(), [r["text"] for r in docs.select("text").collect()]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        counts = {w: best_tokens(w, scores, byte_score) for w in set(words)}
        assert (r["n_pretokens"], r["n_tokens"], r["n_chars"]) == (len(words), sum(counts[w] for w in words), len(text or ""))
    assert token_counts.token_counts(docs.limit(0), path).count() == 0
    assert queries.op1_token_counts(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_trie_computes_shared_prefixes_once():
    scores = {token_counts.MARK: -1, token_counts.MARK + "ab": -2, "c": -1, "d": -3}
    t = token_counts.Trie(scores, -100)
    assert t.count("abc") == 2 and len(t.best) == 5  # the root, the mark, a, b, c
    assert t.count("abd") == 2 and len(t.best) == 6


def test_long_words_make_no_nodes():
    scores, byte_score = token_counts.unigram_scores(public_tokenizers.path("piece_bpe_32k.model"))
    t, rnd = token_counts.Trie(scores, byte_score), random.Random(9)
    for n in (64, 200, 3000):
        word = "".join(rnd.choice("aeinorst_é日") for _ in range(n))
        assert t.count(word) == best_tokens(word, scores, byte_score)
    assert t.count("word" * 100_000) > 0 and len(t.best) == 1


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    counts = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if counts[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_base(spark):
    texts = [*ODD, "a b c a b c", "x\ny\nx\n\n \nx", "w " * 100, "a b c d a b c e a b"]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_words", F.lit(1))
    rows = {r["row"]["doc_id"]: r for r in quality.quality(docs).collect()}
    for i, t in enumerate(texts):
        r, b = rows[i], base(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == b
        assert r["base_failed"] == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and r["kept"] == (not r["base_failed"])
    assert quality.quality(docs.limit(0)).count() == 0


def test_quality_estimates_equal_numpy(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(400, 4)) * [0.2, 0.1, 0.3, 0.2] + [1.6, 0.2, 0.1, 0.3]
    x[:60] += [0, 4, 0, 0]
    rows = spark.createDataFrame([("c", *map(float, r)) for r in x], "cell string, x0 double, x1 double, x2 double, x3 double")
    r = quality.estimates(rows, ["cell"], 1.0).first()
    cov = np.cov(x.T, bias=True) + np.diag(np.square(quality.FLOORS))
    assert np.allclose([r[f"m{i}"] for i in range(4)], x.mean(0)) and math.isclose(r["logdet"], np.linalg.slogdet(cov)[1], rel_tol=1e-9)
    lower = np.linalg.cholesky(cov)
    assert np.allclose([r[f"l{i}{j}"] for i in range(4) for j in range(i + 1)], [lower[i, j] for i in range(4) for j in range(i + 1)])
    found = quality.covariance_determinants(rows)
    d = [v["d2"] for v in quality.with_distance(rows, found, ["cell"]).orderBy("x1").collect()]
    out = sorted(d)[-60:]
    assert min(out) > 5 * np.median(d)  # the planted group lies far out though it is 15 % of the rows


def numpy_verdicts(docs):
    """(kept, distance) of each (text, lang, source): minimum covariance determinants of its cell, in numpy."""
    stats = [base(t) for t, _, _ in docs]
    good = [n >= 50 and 100 * k <= 50 * n for n, _, _, _, k in stats]
    x = {i: np.array([math.log(c / n), math.log1p(100 * s / c), math.log1p(100 * d / n), math.asin(math.sqrt(k / n))]) for i, (n, c, s, d, k) in enumerate(stats) if good[i]}
    fine, coarse = Counter(docs[i][1:] for i in x), Counter(docs[i][1] for i in x)
    cell = {i: docs[i][1:] if fine[docs[i][1:]] >= 60 else docs[i][1] if coarse[docs[i][1]] >= 60 else 0 for i in x}
    members = {c: np.array([x[i] for i in x if c == 0 or c == docs[i][1:] or c == docs[i][1]]) for c in set(cell.values())}
    if len(x) < 60:
        return [(g, None) for g in good]
    floors = np.array(quality.FLOORS)

    def estimate(rows, factor):
        return rows.mean(0), np.cov(rows.T, bias=True) * factor + np.diag(floors**2)

    def distance(rows, found):
        return np.round(np.einsum("ij,jk,ik->i", rows - found[0], np.linalg.inv(found[1]), rows - found[0]), 6)

    def nearest(rows, d, share):
        bins = np.floor(32 * np.log2(1 + d))
        order = np.sort(bins)
        return rows[bins <= order[math.ceil(share * len(rows)) - 1]]

    now = {}
    for c, rows in members.items():
        for start in (0, 1):
            d = np.round(np.square(rows[:, 1:] / floors[1:]).sum(1), 6) if start else np.zeros(len(rows))
            now[c, start] = estimate(nearest(rows, d, 0.5), 1.0)
    before, logdet = [], lambda found: np.linalg.slogdet(found[1])[1]
    for _ in range(quality.STEPS):
        total = sum(round(logdet(f), 6) for f in now.values())
        if any(abs(total - t) < 1e-7 for t in before):
            break
        before.append(total)
        now = {(c, k): estimate(nearest(members[c], distance(members[c], f), quality.H), quality.CONSISTENT) for (c, k), f in now.items()}
    final = {}
    for c, rows in members.items():
        best = min((now[c, k] for k in (0, 1)), key=logdet)
        final[c] = estimate(rows[distance(rows, best) <= quality.REWEIGHT], quality.CONSISTENT_REWEIGHT)
    d = {i: float(distance(v[None], final[cell[i]])[0]) for i, v in x.items()}
    return [(g and d[i] <= quality.CUTOFF, d.get(i)) for i, g in enumerate(good)]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_quality_verdicts_equal_numpy(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = {r["row"]["doc_id"]: r for r in quality.quality(docs).collect()}
    docs = docs.collect()
    for r, (kept, distance) in zip(docs, numpy_verdicts([(r["text"], r["lang"], r["source"]) for r in docs])):
        got = rows[r["doc_id"]]
        assert got["kept"] == kept and (got["distance"] is None) == (distance is None)
        assert distance is None or math.isclose(got["distance"], distance, rel_tol=1e-4, abs_tol=1e-4)


def test_quality_judges_rare_cells(spark):
    rnd = random.Random(5)
    clean = lambda: " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(3, 9))) for _ in range(120))
    junk = lambda: " ".join(w + "###$$$" for w in clean().split())
    cells = [("en", "web", 150, 0), ("en", "rare", 9, 1), ("xx", "web", 4, 1), (None, None, 3, 1)]
    rows = [(make(), lang, source) for lang, source, good, bad in cells for make in [clean] * good + [junk] * bad]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    judged = {r["row"]["doc_id"]: r for r in quality.quality(docs).collect()}
    for i, (text, _, _) in enumerate(rows):
        assert not judged[i]["base_failed"] and judged[i]["distance"] is not None
        assert judged[i]["kept"] == ("#" not in text)
    few = quality.quality(docs.where("doc_id >= 150")).collect()  # a whole table of under 60 rows
    assert len(few) == 19 and all(r["kept"] and r["distance"] is None for r in few)


def test_op7_rejects_junk_and_keeps_clean(spark):
    sf = SF.replace("0.001", "0.01")
    rows = queries.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0 and r["n_symbols"] > 0.05 * r["word_chars"]]
    assert sum(good) / len(good) > 0.99 and (not bad or sum(bad) / len(bad) < 0.05)
