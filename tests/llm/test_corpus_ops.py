"""Near-duplicates, substrings, decontamination, pages, shards, archive and pipeline: against brute force on small tables."""

import gzip
import hashlib
import html as html_module
import itertools
import random
import shutil
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recollect.llm import components, decontaminate, html_text, near_dups, queries, resharding, substrings, warc
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    """Documents with columns whose names clash with those that the operators make."""
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    return d.withColumns({c: F.lit(9) for c in ("id", "key", "row", "kept", "place", "places", "node", "__n", "__id", "__key", "__text", "__lang", "group")})


def random_words(rnd, n, size=40):
    return [f"w{rnd.randrange(size)}" for _ in range(n)]


# ---- substrings


def removed(rows):
    """(n_words, n_removed, kept text) of each row by comparing all windows."""
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {k + j for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for j in range(50)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_substrings_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    passages = [random_words(rnd, rnd.choice([49, 50, 51, 80, 300]), rnd.choice([1, 2, 5, 1000])) for _ in range(6)]
    rows = [(None, " ".join(passages[0] * 3)), (5, None), (6, ""), (7, " \n "), (8, "a " * 400), (9, "a " * 390), (9, "a  " * 391), (10, "a b " * 200), (11, "b a " * 150), (4, "a b " * 99)]
    for i in range(30):
        parts = [random_words(rnd, rnd.randrange(0, 60), 1000) for _ in range(3)]
        text = parts[0] + rnd.choice(passages) + parts[1] + rnd.choice(passages) + parts[2]
        rows.append((i + 20, " ".join(text)))
    rows += [rows[12], rows[12], (3, rows[15][1]), (99, rows[15][1])]
    got = substrings.remove_repeats(docs_of(spark, rows))
    assert sorted([(r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()], key=str) == removed(rows)


def test_substrings_empty_and_joins_without_broadcast(spark, monkeypatch):
    assert substrings.remove_repeats(docs_of(spark, [(1, "x")]).limit(0)).count() == 0
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", 0)
    rnd = random.Random(9)
    p = random_words(rnd, 120, 1000)
    rows = [(1, " ".join(p)), (2, " ".join(["x", *p[:100], "y"])), (3, " ".join(p[10:90]))]
    got = substrings.remove_repeats(docs_of(spark, rows))
    assert sorted([(r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()], key=str) == removed(rows)


def test_equal_stretches_have_equal_symbols():
    rnd = np.random.default_rng(1)
    shared = rnd.integers(0, 1 << 60, 400).astype(np.uint64)
    a, b = (np.concatenate([rnd.integers(0, 1 << 60, n).astype(np.uint64), shared, rnd.integers(0, 1 << 60, 70).astype(np.uint64)]) for n in (33, 90))
    found = []
    for h, at in ((a, 33), (b, 90)):
        name, start, end, low, high = substrings.symbols(h, np.zeros(len(h), np.int64))
        found.append({(n, s - at, e - at) for n, s, e, lo, hi in zip(name.tolist(), start, end, low, high) if lo >= at and hi <= at + 400})
    assert found[0] == found[1] and len(found[0]) > 40


# ---- near duplicates


def brute_classes(rows, common=frozenset()):
    sets = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        if i is not None and w:
            sets.setdefault(i, []).append(Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))))
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations([(i, c) for i, cs in sets.items() for c in cs], 2):
        both = sum((a & b).values())
        if i != j and both >= 0.8 * (sum(a.values()) + sum(b.values()) - both):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return {i: root(i) for i in parent}


def edited(rnd, words, n):
    words = list(words)
    for k in rnd.sample(range(len(words)), n):
        words[k] = f"e{rnd.randrange(10**6)}"
    return words


@pytest.mark.parametrize("block", [2, 128])
def test_near_dups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    monkeypatch.setattr(near_dups, "STRENGTH", 0.0)  # plain counts, as in the brute force
    rnd = random.Random(2)
    rows = [(None, "some text without an id"), (1, None), (2, ""), (3, " "), (4, "a b"), (5, "a  b"), (6, "a b c"), (7, "w " * 3000), (8, "w " * 2990)]
    key = 10
    for size in (30, 120, 400):
        text = random_words(rnd, size, 10**6)
        for edits in (0, 0, 1, 1, 2, 3, 5, size // 12):
            rows.append((key, " ".join(edited(rnd, text, edits))))
            key += 1
    rows += [rows[12], (key, " ".join(random_words(rnd, 200, 10**6))), (key, rows[15][1])]
    got = {r["id"]: r["class_id"] for r in near_dups.classes(docs_of(spark, rows)).collect()}
    assert got == brute_classes(rows)
    kept = near_dups.one_of_each(docs_of(spark, rows)).select("doc_id").collect()
    assert sorted(r[0] for r in kept if r[0] is not None) == sorted(set(brute_classes(rows).values())) and sum(r[0] is None for r in kept) == 1
    assert near_dups.classes(docs_of(spark, rows).limit(0)).count() == 0


def test_op5_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in queries.op5_near_dups(spark, SF).collect()}
    assert got == brute_classes([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_near_dups_of_repeated_ids(spark):
    """Each text of an id counts: 3 is like the first text of 1, and 2 like the second; 9 has very many rows of one id."""
    rnd = random.Random(11)
    a, b = (random_words(rnd, 60, 10**6) for _ in range(2))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(edited(rnd, b, 1))), (3, " ".join(edited(rnd, a, 1))), (4, "quite another text of several words")]
    rows += [(9, " ".join(random_words(rnd, 30, 10**6))) for _ in range(300)]
    got = {r["id"]: r["class_id"] for r in near_dups.classes(docs_of(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 9: 9}
    assert sorted(r[0] for r in near_dups.one_of_each(docs_of(spark, rows)).select("doc_id").collect()) == [1, 4, 9]


def test_long_documents_have_few_common_shingles(spark):
    rnd = random.Random(12)
    rows = spark.createDataFrame([(" ".join(random_words(rnd, 2000, 10**6)),) for _ in range(80)], "text string")
    assert len(near_dups.common_shingles(rows)[0]) == 0


def test_common_shingles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "UNIT", 300)  # many units
    monkeypatch.setattr(near_dups, "LEAST_DF", 1)
    rnd = random.Random(4)
    common = "one two three four five six"
    texts = [" ".join([*random_words(rnd, 20, 10**6), *(common.split() if i % 9 == 0 else [])]) for i in range(300)]
    code, idf = near_dups.common_shingles(spark.createDataFrame([(t,) for t in texts], "text string"))
    df = Counter(s for t in texts for s in set(near_dups.shingles([t])[0].tolist()))
    wanted = {c: n for c, n in df.items() if n > 3}
    assert set(code.tolist()) == set(wanted) and len(wanted) == 2
    assert np.allclose(idf, 1 - 0.25 * np.log(34 / 3) / np.log(100))


def test_sampling_estimates_weighted_similarity():
    rnd = np.random.default_rng(0)
    code = rnd.integers(0, 1 << 62, 600).astype(np.uint64)
    code.sort()
    both = near_dups.bands(np.concatenate([code[:500], code[100:]]), np.concatenate([np.full(500, 2.0), np.full(500, 2.0)]), np.repeat([0, 1], 500), 2)
    assert (both[0] == both[1]).mean() < 0.5  # 400 / 600 to the power of 6 is 0.09
    same = near_dups.bands(np.concatenate([code, code]), np.ones(1200), np.repeat([0, 1], 600), 2)
    assert (same[0] == same[1]).all()
    a, b = (code[:500], np.full(500, 2.0)), (code[100:], np.full(500, 1.0))
    assert abs(near_dups.similarity(a, b) - 400 / (1000 + 500 - 400)) < 1e-12


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 200)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_substrings_of_repeated_rows_grow_in_proportion(spark):
    """300 equal rows of one id beside a document that has their passage: places are kept once."""
    rnd = random.Random(21)
    text = " ".join(random_words(rnd, 300, 10**6))
    rows = [(1, text)] + [(2, text + " end")] * 300
    once = substrings.repeated_windows(docs_of(spark, rows).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), "text")).collect()
    assert len(once) == 1 and sum(p["n"] for p in once[0]["places"]) == 251
    got = substrings.remove_repeats(docs_of(spark, rows), columns=["doc_id"]).groupBy("row.doc_id", "n_removed", "kept").count().collect()
    assert sorted((r["doc_id"], r["n_removed"], r["kept"], r["count"]) for r in got) == [(1, 0, text, 1), (2, 300, "end", 300)]


def test_long_texts(spark):
    """A text of megabytes goes through near-duplicates, substrings and the index beside short ones."""
    rnd = random.Random(22)
    long = random_words(rnd, 400_000, 10**6)
    rows = [(1, " ".join(long)), (2, " ".join(edited(rnd, long, 30))), (3, "a few words"), (4, "x" * 2_000_000)]
    assert {r["id"]: r["class_id"] for r in near_dups.classes(docs_of(spark, rows)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    got = substrings.remove_repeats(docs_of(spark, rows), columns=["doc_id"]).select("row.doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got), key=str) == removed(rows)
    items = spark.createDataFrame([(7, " ".join(long[300_000:300_010]))], "item_id long, text string")
    assert {r["id"]: r["n_hit"] for r in decontaminate.contamination(docs_of(spark, rows), items).collect()} == {1: 10, 2: 10, 3: 0, 4: 0}


# ---- decontamination

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_hits(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = TERM.findall((text or "").translate(LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, found = TERM.findall((text or "").translate(LOWER)), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if k + n <= len(w) and tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "block"), [(400_000, 2_000_000), (60, 40)])
def test_contamination_equals_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rnd = random.Random(3)
    items = [(1, " ".join(random_words(rnd, 30, 9))), (2, "Élan VITAL x1"), (3, ""), (None, " ".join(random_words(rnd, 12, 9))), (4, None), (2, " ".join(random_words(rnd, 11, 9))), (10, "w1")]
    docs = [(None, "élan"), (1, None), (2, ""), (3, "Élan, vital--X1 élan vital x1"), (4, "ÉLAN vital x1"), (5, items[0][1].upper()), (5, items[0][1].upper())]
    docs += [(k + 6, " ".join([*random_words(rnd, 15, 9), *items[rnd.choice([0, 3, 5])][1].split()[rnd.randrange(3) :], *random_words(rnd, 5, 50)])) for k in range(20)]
    found = decontaminate.contamination(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted([(r["id"], r["n_words"], r["n_hit"], list(r["items"])) for r in found.collect()], key=str) == brute_hits(docs, items)
    left = decontaminate.clean(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted([r["doc_id"] for r in left.collect()], key=str) == sorted([i for i, _, n, _ in brute_hits(docs, items) if not n], key=str)


def test_proximity_and_empty_tables(spark):
    item = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    docs = docs_of(spark, [(1, "x a b c extra d e f g h i j"), (2, "a b c d e f g h i j"), (3, "a c b d e f g h j i"), (4, "a b c d e j"), (5, "j i h g f e d c b a")])
    rows = {r["id"]: (r["n_hit"], r["n_near"] > 0) for r in decontaminate.contamination(docs, item, slop=2).collect()}
    assert rows == {1: (0, True), 2: (10, False), 3: (0, True), 4: (0, False), 5: (0, False)}
    assert decontaminate.contamination(docs.limit(0), item).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(docs, item.limit(0)).collect()} == {0}
    with pytest.raises(ValueError):
        decontaminate.contamination(docs, item, slop=99)


# ---- pages


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_extract_by_hand(spark):
    nav = "<div><ul><li><a href='/a'>Home</a></li></ul></div>"
    rows = [(i, "http://h.example/%d" % i, page(f"{nav}<p>Own {i}</p><section>Ring of\nsites</section>")) for i in range(6)]
    rows += [
        (10, "http://k.example/1", page("<header>Site</header><main><h1>A &amp; B</h1><p>one<br>two <b>th</b>ree<p>four &eacute;</main><aside>no</aside><footer>no</footer>")),
        (11, None, page("<article><header><h1>Head</h1></header><p>x</p><div class='comments'><p>reader</p></div><form>f</form><script>if(a<b)</script></article><div id='cookie-notice'>c</div>")),
        (12, "http://k.example/2", None),
        (13, "http://k.example/3", ""),
        (14, "no host", "plain <b>text</b>"),
        (15, "http://k.example/4", "<article><p>cut off <p>here &lt;"),
        (16, "http://k.example/5", page("<article>" + "<p>long </p>" * 3000 + "</article>")),
        (16, "http://k.example/5", page("<article>" + "<p>long </p>" * 3000 + "</article>")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "host", "row", "blocks")})
    got = sorted([(r["row"]["page_id"], r["text"]) for r in html_text.extract(pages).collect()], key=str)
    wanted = [(i, f"Own {i}") for i in range(6)] + [(10, "A & B one two three four é"), (11, "Head x"), (12, ""), (13, ""), (14, "plain text"), (15, "cut off here <"), (16, " ".join(["long"] * 3000)), (16, " ".join(["long"] * 3000))]
    assert got == sorted(wanted, key=str)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_extract_keeps_articles_in_marked_wraps():
    text = lambda body: " ".join(t for t, inside, *_ in html_text.parse(page(body)).blocks if inside)
    article = "<article><h1>Head</h1><p>own text</article>"
    assert text(f"<div class='content has-sidebar'>{article}</div>") == "Head own text"
    assert text(f"<div id='sidebar'>{article}</div>") == "Head own text"
    assert text(f"<form id='page'><main><form>{article}</form></main></form>") == "Head own text"
    assert text(f"<div class='advert'>Buy{article}") == "Head own text"
    assert text("<article><h2 id='related-work'>Related work</h2><h2 id='discussion'>Discussion</h2><section id='advertising-history'><p>Old adverts</section></article>") == "Related work Discussion Old adverts"
    # what is marked stays out: comments in and beside an article, also as articles of their own
    comments = "<div class='comments'><article>reader</article></div>"
    assert text(f"{article}{comments}") == text(f"<main>{article}{comments}</main>") == "Head own text"
    assert text(f"<div class='sidebar'>{article}{comments}</div>") == "Head own text"
    assert text("<article><p>x</p><section class='comments'><p>reader</section></article>") == "x"
    blocks = [t for t, *_ in html_text.parse(page("<div class='has-sidebar'><p>no article</p><div id='cookie-notice'>c</div><form>f</form></div>")).blocks]
    assert blocks == ["no article"]


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, f"http://c.example/{i}", page("<p>Ring of sites</p><p>The same text</p>")) for i in range(4)]
    rows += [(i, f"http://c.example/{i}", page(f"<p>Ring of sites</p><p>Own {i}</p>")) for i in range(4, 7)]
    got = {r["row"]["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "The same text" if i < 4 else f"Own {i}" for i in range(7)}


def site(rnd, host, n, wrap):
    """Pages of a host: its own blocks between template blocks, some of them on only a part of the pages."""
    template = [(f"<div><p>{' '.join(random_words(rnd, 6, 10**6))}</p></div>", share) for share in (1.0, 0.9, 0.5, 0.3, 0.1)]
    out = []
    for i in range(n):
        own = [f"<p>{' '.join(random_words(rnd, 30, 10**6))}</p>" for _ in range(3)]
        parts = own + [t for t, share in template if rnd.random() < share]
        rnd.shuffle(parts)
        out.append((i, f"http://{host}/{i}", page(wrap.format("".join(parts)))))
    return out


def brute_texts(rows):
    """Main texts of pages made of paragraphs: counts of all paragraphs over all distinct pages of a host, in plain Python."""
    blocks = {i: re.findall(r"<p>(.*?)</p>", h) for i, _, h in rows}
    count = Counter(b for found in {tuple(v) for v in blocks.values()} for b in set(found))
    pages = len({tuple(v) for v in blocks.values()})
    inside = "<article>" in rows[0][2]
    template = {b for b, n in count.items() if (n >= 20 and n >= 0.5 * pages if inside else n >= 3 and n >= 0.2 * pages)}
    return {i: " ".join(b for b in v if b not in template) for i, v in blocks.items()}


@pytest.mark.parametrize("wrap", ["<div>{}</div>", "<article>{}</article>", "{}"])
def test_templates_equal_brute_force(spark, wrap):
    rows = site(random.Random(31), "t.example", 60, wrap)
    got = {r["row"]["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == brute_texts(rows)
    assert any(len(re.findall("<p>", h)) > len(re.findall(r"(?:\S+ ){29}\S+", got[i])) for i, _, h in rows)  # the counts have deleted something


def test_near_copies_of_an_article_stay(spark):
    rnd = random.Random(32)
    same = [f"<p>{' '.join(random_words(rnd, 30, 10**6))}</p>" for _ in range(4)]
    rows = [(i, f"http://n.example/{i}", page(f"<article>{''.join(same)}<p>edit {i}</p></article>")) for i in range(40)]
    got = {r["row"]["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: re.sub(r"</?p>", " ", "".join(same) + f"edit {i}").replace("  ", " ").strip() for i in range(40)}


def test_comments_and_what_stands_beside_the_article():
    text = lambda body: " ".join(t for t, inside, *_ in html_text.parse(page(body)).blocks if inside)
    article = "<article><p>the text of the page</p></article>"
    assert text(f"<main><h1>Title</h1><div>crumbs</div>{article}<div>below</div></main>") == "Title the text of the page"
    assert text(f"<main>{article}<article class='comment'>reader</article></main>") == "the text of the page"
    assert text("<main><p>a long text that is the page's own, and a short teaser beside it</p><article>teaser</article></main>").startswith("a long text")
    assert text("<article class='comment featured'><p>alone</p></article>") == "alone"


def test_deep_and_long_pages():
    began = time.process_time()
    deep = html_text.parse("<div>x" * 100_000)
    assert len(deep.blocks) == 100_000 and len({h for _, _, h, _ in deep.blocks}) == 100_000
    assert len(html_text.parse("<article>" + "<p>word <b>bold</b>" * 100_000).blocks) == 100_000
    assert html_text.parse("<p>" + "long " * 400_000).blocks[0][0] == "long " * 399_999 + "long"
    assert time.process_time() - began < 30


def test_op2_query(spark):
    got = {r["page_id"]: r["text"] for r in queries.op2_html_text(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [re.sub(r"\s+", " ", html_module.unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)[^>]*>", article)]
        assert got[r["page_id"]] == " ".join(x for x in blocks if x)


# ---- shards


def test_flow_moves_the_fewest_bytes():
    rnd = random.Random(1)
    for _ in range(30):
        n, m = rnd.randrange(1, 6), rnd.randrange(1, 6)
        supply = [rnd.randrange(0, 50) for _ in range(n)]
        capacity = resharding.level([0] * m, sum(supply))
        flow = resharding.min_cost_flow(supply, capacity, lambda i, j: 0 if i == j else 1)
        assert [sum(r) for r in flow] == supply and all(sum(r[j] for r in flow) <= capacity[j] for j in range(m))
        moved = sum(flow[i][j] for i in range(n) for j in range(m) if i != j)
        assert moved == sum(supply) - sum(min(supply[k], capacity[k]) for k in range(min(n, m)))


def test_level():
    assert resharding.level([0, 0, 0], 10) == [4, 3, 3] and resharding.level([10, 0, 2], 4) == [0, 3, 1] and sum(resharding.level([5, 5], 0)) == 0


def check_shards(rows, texts, n):
    assert Counter((r["row"]["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    slots = defaultdict(list)
    sums = Counter({k: 0 for k in range(n)})
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sums[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))
    return sums


def test_resharding(spark):
    rnd = random.Random(6)
    texts = [(i, "é" * rnd.choice([0, 3, 30, 300])) for i in range(400)] + [(None, None), (7, None), (7, "x"), (7, "x"), (8, "long " * 3000)]
    docs = docs_of(spark, texts).withColumn("old", F.lit(1)).withColumn("shard", F.lit(2))
    rows = resharding.reshard_files(docs, 6, F.pmod("doc_id", F.lit(4))).collect()
    sums = check_shards(rows, texts, 6)
    rest = sorted(sums.values())[:-1]  # one shard holds the long text alone
    assert max(rest) - min(rest) <= 608 and max(sums.values()) == 15008
    same = resharding.reshard_files(docs.where("doc_id < 400 and doc_id <> 7 and doc_id <> 8"), 1, F.lit(0))  # nothing moves
    assert same.count() == 398
    assert resharding.reshard_files(docs.limit(0), 6, F.lit(0)).count() == 0


def test_documents_move_few_bytes(spark):
    """Against all assignments of a few documents, large ones among them, whose loads are as near or nearer: what moves is the
    least, give or take a document."""
    rnd = random.Random(16)
    for _ in range(6):
        n = rnd.choice([2, 3])
        docs = [(rnd.randrange(3), k, rnd.choice([20, 50, 100, 400])) for k in range(7)]
        rows = spark.createDataFrame([(old, k, size) for old, k, size in docs], "old int, place long, size long")
        got = {r["place"]: r["shard"] for r in resharding.reshard(rows, n).collect()}
        spread = lambda to: (lambda sums: max(sums) - min(sums))([sum(d[2] for d, s in zip(docs, to) if s == k) for k in range(n)])  # noqa: B023, E731
        moved = lambda to: sum(size for (old, _, size), s in zip(docs, to) if old != s)  # noqa: B023, E731
        ours = [got[k] for _, k, _ in docs]
        best = min(moved(to) for to in itertools.product(range(n), repeat=len(docs)) if spread(to) <= spread(ours))
        largest = max(size for _, _, size in docs)
        assert moved(ours) <= best + largest and spread(ours) <= 2 * largest


def test_op4_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op4_resharding(spark, SF).collect()
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
    sums = Counter()
    for r in rows:
        sums[r["shard"]] += r["size"]
    largest = max(len((t or "").encode()) + 8 for _, t in docs)
    assert len(sums) == 24 and max(sums.values()) - min(sums.values()) <= largest


# ---- templates by shape


def test_names_of_containers():
    """Containers whose names say comments or adverts go, on pages with and without an article; what only looks like it stays."""
    text = lambda html: " ".join(b[0] for b in html_text.parse(html).blocks)
    for bad in ("<div class='comment-thread'>x</div>", "<section id='reader-comments'>x</section>", "<div class='ad-slot'>x</div>", "<div class='ad-banner'>x</div>", "<ul id='comments-list'><li>x</ul>", "<div class='comment-body'>x</div>"):
        assert text(f"<article><p>own{bad}</article>") == text(f"<p>own{bad}") == "own"
    assert text("<article class='has-comments'><p class='alert'>must read<div class='body with-ads'>own</div></article>") == "must read own"


def test_shapes_of_a_site(spark):
    """Comments, adverts and notices with another text on each page and names that no rule knows vanish by their counts; containers
    of content, and what stands on few pages, stay. Without counts, all of it would stay."""
    rnd = random.Random(11)
    words = lambda n: " ".join(rnd.choice("red green blue stone river lamp table cloud seven".split()) + str(rnd.randrange(900)) for _ in range(n))
    pages, want, junk = [], {}, []
    for site in range(3):
        for k in range(12):
            own = [words(30) for _ in range(rnd.randrange(3, 6))]
            lead, note, alert, rare = words(6), words(5), words(4), words(7)
            junk = [words(8) for _ in range(3)]
            body = f"<h1 class='zq1'>Title {site} {k}</h1><div class='lead'>{lead}</div>" + "".join(f"<p>{x}</p>" for x in own[:1]) + f"<div class='zq{k}'><b>who{k}</b> {junk[0]}</div>"
            body += f"<div class='xk-zone'><div class='xk-unit'>{junk[1]}</div></div><p class='notice'>{note}</p>" + "".join(f"<p>{x}</p>" for x in own[1:])
            body += (f"<section class='vv{k}'><p>{junk[2]}</p></section>") + (f"<div class='once'>{rare}</div><p class='alert'>{alert}</p>" if k == 3 else "")
            i = site * 100 + k
            pages.append((i, f"http://site{site}.example/{k}", f"<html><body><article>{body}</article></body></html>"))
            want[i] = " ".join([f"Title {site} {k}", lead, *own, *([rare, alert] if k == 3 else [])])
    alone = (999, "http://alone.example/1", "<article><p>own text</p><div class='zq1'>stays, as nothing else is known of its host</div></article>")
    want[999] = "own text stays, as nothing else is known of its host"
    df = spark.createDataFrame([*pages, alone, *pages[:2]], "page_id long, url string, html string")
    rows = html_text.extract(df, columns=["page_id"]).select("row.page_id", "text").collect()
    assert len(rows) == len(pages) + 3 and [(r["text"], want[r["page_id"]]) for r in rows if r["text"] != want[r["page_id"]]] == []
    without = {i: " ".join(b[0] for b in html_text.parse(html).blocks) for i, _, html in pages}
    changed = sum(without[i] != want[i] for i in without)
    print(f"counts change {changed} of {len(pages)} results of sites with articles")
    assert changed == len(pages)


# ---- archive


def test_audit_finds_all_damage_and_only_that(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    rows = [(i, f"http://x/{i}", "<p>" + "é" * (i % 700)) for i in range(3000)] + [(None, None, None), (5, "http://x/5", ""), (5, "http://x/5", ""), (-3, "http://x/\r\n", "\r\n\r\nWARC/1.1"), (4, "", "y" * 3_000_000)]
    rows += [(None, "http://n/", "same")] * 500
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("offset", "file", "value", "place")})
    got = warc.fixity(pages, f"file://{tmp_path}/w").collect()
    assert len(got) == len(rows) and Counter((r["page_id"], r["url"]) for r in got) == Counter((i, u and u.replace("\r", "%0D").replace("\n", "%0A")) for i, u, _ in rows)
    kinds = {0: "changed", 1: "changed", 2: "missing"}
    assert all(r["status"] == ("ok" if r["page_id"] is None else kinds.get(r["page_id"] % 61, "ok")) for r in got)
    # from the stored bytes at each offset alone, its record
    files = {r["file"]: r["content"] for r in warc.stored(spark, f"file://{tmp_path}/w/first").collect()}
    assert len(files) > 3
    for r in got:
        stored = files[r["file"]][r["offset"] : r["offset"] + r["stored"]]
        record = gzip.decompress(stored)
        assert hashlib.sha256(stored).hexdigest() == r["stored_sha256"] and (len(record), hashlib.sha256(record).hexdigest()) == (r["length"], r["sha256"])
    for file, content in files.items():  # each file is one gzip file, and holds nothing else
        assert sorted((r["offset"], r["offset"] + r["stored"] + 20) for r in got if r["file"] == file)[-1][1] == len(content)
        assert gzip.decompress(content).count(b"WARC-Type: resource") == sum(r["file"] == file for r in got)
    known = warc.index(spark, f"file://{tmp_path}/w/first")
    assert warc.audit(known, known).count() == 0
    nine = known.where("page_id = 9").first()
    record = gzip.decompress(files[nine["file"]][nine["offset"] : nine["offset"] + nine["stored"]]).decode()
    assert record.startswith("WARC/1.1\r\n") and "Content-Length: 21\r\n" in record and record.split("\r\n\r\n", 1)[1] == "<p>" + "é" * 9 + "\r\n\r\n"
    assert warc.fixity(pages.limit(0), f"file://{tmp_path}/e").count() == 0


def test_audit_of_stored_bytes(spark, tmp_path):
    """Flipped bits, a cut file, a lost file, added and moved records, foreign records: found as such, and nothing else."""
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>text {i} " + "é" * (i % 90)) for i in range(400)], "page_id long, url string, html string").repartition(4)
    warc.archive(pages, f"file://{tmp_path}/a")
    shutil.copytree(tmp_path / "a", tmp_path / "b")
    rows = sorted(warc.index(spark, f"file://{tmp_path}/a").collect(), key=lambda r: (r["file"], r["offset"]))
    names = {int(p.parent.name[5:]): p for p in (tmp_path / "b").rglob("part-*")}
    by_file = {f: [r for r in rows if r["file"] == f] for f in names}
    one, two, three, four = sorted(names)
    data = bytearray(names[one].read_bytes())
    want = set()
    for r, at in ((by_file[one][3], 15), (by_file[one][10], 0), (by_file[one][20], 40)):  # a header, a magic number, the deflated bytes
        data[r["offset"] + at] ^= 4
        want.add((one, r["offset"], "unreadable", "first"))
    names[one].write_bytes(bytes(data))
    cut = by_file[two][50]
    names[two].write_bytes(names[two].read_bytes()[: cut["offset"] + cut["stored"] // 2])
    want |= {(two, cut["offset"], "truncated", "first")} | {(two, r["offset"], "missing", "first") for r in by_file[two][51:]}
    names[three].unlink()
    want |= {(three, r["offset"], "missing", "first") for r in by_file[three]}
    foreign = warc.member(b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    content, lost, other = names[four].read_bytes(), by_file[four][9], by_file[four][30]
    at = by_file[four][5]["offset"]
    changed = warc.member(gzip.decompress(content[other["offset"] : other["offset"] + other["stored"]]).replace(b"text", b"TEXT"))
    content = content[:at] + foreign + warc.EMPTY + content[at : lost["offset"]] + content[lost["offset"] + lost["stored"] + 20 : other["offset"]] + changed + content[other["offset"] + other["stored"] :]
    names[four].write_bytes(content)
    want |= {(four, at, "extra", "second"), (four, lost["offset"], "missing", "first"), (four, other["offset"], "changed", "first")}
    replica = warc.index(spark, f"file://{tmp_path}/b")
    assert {tuple(r) for r in warc.audit(warc.index(spark, f"file://{tmp_path}/a"), replica).collect()} == want
    ids = {r["record_id"]: r["state"] for r in replica.collect()}
    assert ids["<urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>"] == "ok"
    # a file that isn't zipped, with a record that is cut off
    plain = b"WARC/1.0\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert [(at, state) for at, _, _, state in warc.members(plain + plain[:-9])] == [(0, "ok"), (len(plain), "truncated")]
    assert [x[3] for x in warc.members(b"garbage")] == ["unreadable"] and not list(warc.members(b""))
    assert warc.told(0, b"x", b"WARC/1.0\r\nContent-Length: x\r\n\r\n", "ok")[3] == "unreadable"


# ---- pipeline


def test_pipeline_stages_equal_brute_force(spark):
    """Each stage on its own input, as the driver runs them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, SF).persist()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "near_duplicates":
            assert set(after) == set(brute_classes(before).values())
        elif name == "substring_dedup":
            assert {i: t for i, t in after.items()} == {i: (kept if n else dict(before)[i]) for i, _, n, kept in removed(before)}
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(after) == {i for i, _, n, _ in brute_hits(before, items) if not n}
        elif name == "encoding":
            assert {r["doc_id"] for r in out.collect()} == {i for i, _ in before}
        docs = out
    final = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, final)) == sorted(map(tuple, docs.collect()))


def test_pipeline_handles_odd_rows(spark):
    rnd = random.Random(8)
    text = " ".join(random_words(rnd, 90, 10**6))
    docs = docs_of(spark, [(None, text), (1, None), (2, ""), (3, text), (3, text), (4, text + " more words"), (5, " ".join(random_words(rnd, 80, 10**6)))])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0
        if k < 4:
            assert out.columns == docs.columns
        docs = out
    assert sorted([r["doc_id"] for r in docs.collect()], key=str) == [3, 5, None]


def test_digests_of_kept_words(spark):
    rows = queries.op8_substrings(spark, SF).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    wanted = [(i, n, m, hashlib.sha256(kept.encode()).hexdigest()) for i, n, m, kept in removed(docs)]
    assert sorted(map(tuple, rows)) == sorted(wanted)
