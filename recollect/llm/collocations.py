"""Phrase collocation mining: broadcast double-array tries of Apriori-safe candidates, walked by all text positions at once.

Texts are read once and kept as shards: about 4 MB of text as numbers of words, with the shard's own distinct words, their
hashes and counts. Level by level, a phrase is a candidate if it occurs and its parts of one word less are frequent; that is
told by bitmaps of fixed size, which can only let too many through. The candidates that reach the least count in capped sums go
into double-array tries of a bounded number of phrases; a task moves the states of all positions of a shard on by a word at a
time and counts the accepting states, and Spark sums the counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.llm.runs import SIZE, classes, gathered, numbered, parts, runs
from recollect.llm.shared import release, written

#: Classes of bytes: of words (0), between words (1), between pieces (2).
KINDS = classes(b" \t", b".,;:!?\n\x0b\x0c\r")
_SEPARATOR = re.compile(rb"[ \t.,;:!?\n-\r]")
#: Longs of a bitmap (8 MB), phrases of a trie, children from which a node has a range of its own, salts of the top lists.
SLOTS, PHRASES, WIDE, SALTS = 1 << 20, 2_000_000, 32, 32
#: Rows of documents, shards, and rows of phrases of an Arrow batch.
ROWS, SHARDS, TOLD = 512, 1, 1 << 15
#: Bytes of a row group of shards, of which a task holds one at a time.
SHARD_GROUP = 1 << 23
#: States that all tasks together tell of a range; positions of a shard that are moved on together.
SUMMED, MOVED = 1 << 22, 1 << 17


def shard(text: bytes, starts: list[int], langs: list[str], lead: int, salt: int) -> tuple[list, np.ndarray]:
    """A shard's row, and the starts of its words: ids of words with 0 between pieces, how many ids repeat the shard before,
    and the distinct words with hash, language and count (less those repeated)."""
    low = np.frombuffer(text.lower(), np.uint8)
    kind = KINDS[low]
    begin, end = runs(kind)
    word = kind[begin] == 0
    cuts = np.concatenate([[0], np.cumsum(kind[begin] == 2)])
    before = cuts[:-1][word]
    begin, end = begin[word], end[word]
    number, distinct = numbered(low, kind == 0, end - begin)
    lang = np.searchsorted(starts, begin, "right") - 1
    names = sorted(set(langs))
    places = {x: i for i, x in enumerate(names)}
    lang = np.array([places[x] for x in langs])[lang]
    pairs, number = np.unique(lang * max(len(distinct), 1) + number, return_inverse=True)
    counts = np.bincount(number[lead:], minlength=len(pairs))
    which, words = pairs // max(len(distinct), 1), [distinct[i] for i in pairs % max(len(distinct), 1)]
    seeds = [xxhash.xxh3_64_intdigest(x.encode(), salt) for x in names]
    hashes = np.array([xxhash.xxh3_64_intdigest(w, seeds[k]) for w, k in zip(words, which.tolist())], np.uint64).view(np.int64)
    breaks = np.flatnonzero(np.diff(before)) + 1
    ids = np.insert(number + 1, breaks, 0).astype(np.int32)
    return [ids, lead, hashes, [names[k] for k in which], [w.decode("utf-8", "surrogatepass") for w in words], counts], begin


def shards_of(langs: list[str], texts: list[bytes], longest: int, salt: int) -> Iterator[list]:
    """Shards of some whole documents. A long document alone is cut between words; a part begins with the last words of the
    part before, so that no phrase is lost and none counts twice."""
    if len(texts) > 1 or len(texts[0]) <= SIZE:
        yield shard(b"\n".join(texts), [0, *np.cumsum([len(t) + 1 for t in texts])[:-1].tolist()], langs, 0, salt)[0]
        return
    back, lead = 0, 0
    for begin, end in parts(texts[0], _SEPARATOR):
        row, at = shard(texts[0][begin - back : end], [0], langs, lead, salt)
        yield row
        last = len(row[0]) - 1 - (np.flatnonzero(row[0] == 0)[-1] if (row[0] == 0).any() else -1)
        lead = min(longest - 1, last)
        back = end - (begin - back) - int(at[-lead]) if lead else 0


_SHARD = "ids array<int>, lead int, hashes array<bigint>, langs array<string>, words array<string>, counts array<bigint>"


def shards(docs: DataFrame, longest: int, salt: int, lang_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for langs, texts in gathered(batches, 1, 0):
            for ids, lead, hashes, names, words, counts in shards_of(langs, texts, longest, salt):
                one = lambda x, kind: pa.array([x], pa.list_(kind))
                yield pa.RecordBatch.from_arrays([one(ids, pa.int32()), pa.array([lead], pa.int32()), one(hashes, pa.int64()), one(names, pa.string()), one(words, pa.string()), one(counts, pa.int64())], ["ids", "lead", "hashes", "langs", "words", "counts"])
            release()

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, _SHARD), "shards", rows=ROWS, group=SHARD_GROUP)


def word_counts(held: DataFrame) -> DataFrame:
    """(h, lang, word, f, clash) of all distinct words of a language; clash: another word has the same hash."""
    each = held.select(F.explode(F.arrays_zip("hashes", "langs", "words", "counts")).alias("x")).select(F.col("x.hashes").alias("h"), F.struct("x.langs", "x.words").alias("w"), F.col("x.counts").alias("n"))
    found = each.groupBy("h").agg(F.min("w").alias("w"), F.max("w").alias("v"), F.sum("n").alias("f"))
    return written(found.select("h", F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), "f", (F.col("w") != F.col("v")).alias("clash")), "collocation-words")


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit value for each row of hashes."""
    out = columns[0].view(np.uint64).copy()
    for c in columns[1:]:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(32))


def bitmap(phrases: DataFrame, columns: list[str]) -> np.ndarray:
    """Bits of the hashes of phrases: SLOTS longs at most, whatever the number of phrases."""

    def run(batches):
        for batch in batches:
            key = mixed([c.to_numpy() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(6)) & np.uint64(SLOTS - 1)).cast(pa.int32()), pa.array((np.uint64(1) << (key & np.uint64(63))).view(np.int64))], ["slot", "bits"])

    found = phrases.select(*columns).mapInArrow(run, "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(SLOTS, np.uint64)
    out[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def held_by(bits: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    key = mixed(columns)
    return (bits[(key >> np.uint64(6)) & np.uint64(SLOTS - 1)] >> (key & np.uint64(63))) & np.uint64(1) > 0


def occurring(ids: np.ndarray, lead: int, hashes: np.ndarray, bits: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes and counts of a shard's distinct phrases of len(bits) + 1 words whose parts of one word less the bitmaps hold."""
    good = np.concatenate([[False], held_by(bits[0], [hashes])]) if len(hashes) else np.zeros(1, bool)
    first = np.where(good[ids], ids, 0).astype(np.int64)
    words, state, wide = [np.concatenate([[0], hashes])], first, len(hashes) + 1
    for level in range(2, len(bits) + 2):
        left, right = state[:-1], first[level - 1 :]
        # a phrase of n words ends in one of n - 1 that must be frequent too: the state at the next place
        live = (left > 0) & (right > 0) & (state[1:] > 0)
        live = live if level <= len(bits) else live & (np.arange(len(live)) >= lead - level + 1)
        if level > len(bits):
            keys, counts = np.unique(left[live] * wide + right[live], return_counts=True)
        else:
            keys, back = np.unique(left[live] * wide + right[live], return_inverse=True)
        words = [w[keys // wide] for w in words] + [np.concatenate([[0], hashes])[keys % wide]]
        if level <= len(bits):
            ok = held_by(bits[level - 1], words)
            renumbered = np.where(ok, np.cumsum(ok), 0)
            state = np.zeros(len(live), np.int64)
            state[live] = renumbered[back]
            words = [np.concatenate([[0], w[ok]]) for w in words]
    return words, counts


def candidates(held: DataFrame, bits: list[np.ndarray], least: int) -> DataFrame:
    """(h1, ...) of the phrases of len(bits) + 1 words that are frequent: each shard tells how often it has one, `least` at most."""
    sent = held.sparkSession.sparkContext.broadcast(bits)
    names = [f"h{i}" for i in range(1, len(bits) + 2)]

    def run(batches):
        for batch in batches:
            for ids, lead, hashes in zip(batch.column(0), batch.column(1), batch.column(2)):
                words, counts = occurring(ids.values.to_numpy(), lead.as_py(), hashes.values.to_numpy(), sent.value)
                columns = [*words, np.minimum(counts, least).astype(np.int32)]
                for k in range(0, len(counts), TOLD):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + TOLD]) for c in columns], [*names, "n"])
                release()

    rows = held.select("ids", "lead", "hashes").mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", n int")
    found = written(rows.groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(*names), "candidates", rows=SHARDS)
    sent.destroy()
    return found


class DoubleArray:
    """A trie over words, built by numpy. A word is its number among the sorted hashes; a first word's state is that number, and
    each further word takes a step for each of its base-256 digits: to base[state] + digit, if check there is the state."""

    def __init__(self, columns: list[np.ndarray], sizes: np.ndarray):
        """columns: hashes of the words of each phrase, as long as sizes tells."""
        self.hashes = np.unique(np.concatenate([c[sizes > k] for k, c in enumerate(columns)]))
        n = max(len(self.hashes), 1)
        self.digits = max(1, -(-(n - 1).bit_length() // 8))
        self.base, self.check = np.zeros(n, np.int32), np.full(n, -1, np.int32)
        codes = [np.searchsorted(self.hashes, c) for c in columns]
        state, self.levels = codes[0].astype(np.int64), len(columns)
        accepting, self.spans = [], [(0, n)]
        for level in range(1, len(columns)):
            on = sizes > level
            for k in reversed(range(self.digits)):
                digit = (codes[level][on] >> 8 * k) & 255
                begin = len(self.base)
                state[on] = self.step(state[on], digit)
            self.spans.append((begin, len(self.base)))
            accepting.append(state[sizes == level + 1])
        self.base, self.check = np.append(self.base, np.zeros(256, np.int32)), np.append(self.check, np.full(256, -1, np.int32))
        self.accept = np.zeros(len(self.base), bool)
        self.accept[np.concatenate(accepting)] = True

    def step(self, parents: np.ndarray, digits: np.ndarray) -> np.ndarray:
        """Add transitions, in a new stretch of the arrays, and give their states."""
        edges, back = np.unique(parents * 256 + digits, return_inverse=True)
        nodes, first, sizes = np.unique(edges >> 8, return_index=True, return_counts=True)
        digit, start = edges & 255, len(self.base)
        wide = sizes >= WIDE
        low = digit[first]
        spans = np.where(wide, digit[first + sizes - 1] - low + 1, 0)
        bases = np.where(wide, np.cumsum(spans) - spans - low + 255, 0)  # wide nodes have ranges of their own
        offset, room = int(spans.sum()) + 255, 2 * int(sizes[~wide].sum()) + 256
        used, rnd = np.zeros(room + 256, bool), np.random.default_rng(1)
        for top, least in ((WIDE, 16), (16, 8), (8, 4), (4, 3), (3, 2), (2, 1)):
            open_ = np.flatnonzero((sizes < top) & (sizes >= least))
            while len(open_):
                own = sizes[open_]
                base = rnd.integers(0, room, len(open_))
                owner = np.repeat(np.arange(len(open_)), own)
                slot = base[owner] + digit[np.repeat(first[open_], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)]
                fails = used[slot]
                one = np.zeros(len(slot), bool)
                one[np.unique(slot, return_index=True)[1]] = True
                lost = np.bincount(owner[fails | ~one], minlength=len(open_)) > 0
                bases[open_[~lost]] = offset + base[~lost]
                used[slot[~lost[owner]]] = True
                open_ = open_[lost]
        size = offset + room + 256
        self.base, self.check = np.append(self.base, np.zeros(size, np.int32)), np.append(self.check, np.full(size, -1, np.int32))
        self.base[nodes] = start + bases
        slots = self.base[edges >> 8] + digit
        self.check[slots] = edges >> 8
        return slots[back].astype(np.int64)

    def counts(self, ids: np.ndarray, lead: int, hashes: np.ndarray, into: np.ndarray) -> None:
        """Add how often each accepting state is reached, with MOVED positions of a shard moved on together."""
        at = np.searchsorted(self.hashes, hashes)
        at = np.where(at < len(self.hashes), at, 0)
        code = np.concatenate([[-1], np.where(self.hashes[at] == hashes, at, -1)]).astype(np.int32)[ids] if len(self.hashes) else np.full(len(ids), -1, np.int32)
        for begin in range(0, len(ids), MOVED):
            self.move(code, np.flatnonzero(code[begin : begin + MOVED] >= 0) + begin, lead, into)

    def move(self, code: np.ndarray, place: np.ndarray, lead: int, into: np.ndarray) -> None:
        state = code[place]
        for level in range(1, self.levels):
            on = place + level < len(code)
            place, state = place[on], state[on]
            on = code[place + level] >= 0
            place, state = place[on], state[on]
            for k in reversed(range(self.digits)):
                slot = self.base[state] + ((code[place + level] >> 8 * k) & 255)
                on = self.check[slot] == state
                place, state = place[on], slot[on]
            reached, n = np.unique(state[place >= lead - level], return_counts=True)
            into[reached] += n

    def phrases(self, level: int, states: np.ndarray) -> list[np.ndarray]:
        """Hashes of the words that lead to states of a level, read off the arrays from the end."""
        words: list[np.ndarray] = []
        for _ in range(level):
            code = np.zeros(len(states), np.int64)
            for k in range(self.digits):
                above = self.check[states].astype(np.int64)
                code += (states - self.base[above]) << 8 * k
                states = above
            words.append(self.hashes[code])
        return [self.hashes[states], *reversed(words)]

    def told(self, begin: int, counts: np.ndarray) -> pa.Table:
        """(key array<bigint>, a) of the accepting states with counts, which are of the states from one on."""
        found, end = [], begin + len(counts)
        for level, (low, high) in enumerate(self.spans):
            low, high = max(low, begin), min(high, end)
            states = low + np.flatnonzero(self.accept[low:high] & (counts[low - begin : high - begin] > 0)) if low < high else np.zeros(0, np.int64)
            words = np.stack(self.phrases(level, states), 1)
            offsets = np.arange(len(states) + 1, dtype=np.int32) * (level + 1)
            found.append(pa.table([pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.ravel())), pa.array(counts[states - begin])], ["key", "a"]))
        return pa.concat_tables(found)


def counted(held: DataFrame, phrases: DataFrame, longest: int) -> DataFrame:
    """(key, a): how often each phrase (h1, ...; null behind its end) occurs. Blocks of phrases with the same first two words are
    sent one after another, each as a trie of about PHRASES phrases, and each reads the shards once.

    A task tells the states that it has reached, with counts, in a row for each range of states; the rows of a range, one from each
    task, are summed up. Ranges get shorter with the number of shards, so that those of all tasks together stay bounded.
    """
    names, spark = [f"h{i}" for i in range(1, longest + 1)], held.sparkSession
    blocks, width = max(1, -(-phrases.count() // PHRASES)), max(256, SUMMED // max(1, held.count()))
    phrases, out = phrases.withColumn("block", F.pmod(F.xxhash64("h1", "h2"), F.lit(blocks))), []
    for block in range(blocks):
        some = phrases.where(F.col("block") == block).select(*names).toArrow()
        if not some.num_rows:
            continue
        sizes = sum(np.asarray(some[c].is_valid()).astype(np.int64) for c in names)
        trie = DoubleArray([some[c].fill_null(0).to_numpy() for c in names], sizes)
        sent = spark.sparkContext.broadcast(trie)

        def run(batches, sent=sent):
            trie = sent.value
            into = np.zeros(len(trie.base), np.int64)
            for batch in batches:
                for ids, lead, hashes in zip(batch.column(0), batch.column(1), batch.column(2)):
                    trie.counts(ids.values.to_numpy(), lead.as_py(), hashes.values.to_numpy(), into)
                release()
            for begin in range(0, len(into), width):
                on = np.flatnonzero(into[begin : begin + width])
                if len(on):
                    yield pa.RecordBatch.from_arrays([pa.array([begin // width], pa.int32()), pa.array([on], pa.list_(pa.int32())), pa.array([into[begin + on]], pa.list_(pa.int64()))], ["range", "at", "n"])

        def summed(key, table):
            total, begin = np.zeros(width, np.int64), key[0].as_py() * width
            for at, n in zip(table["at"], table["n"]):
                total[at.values.to_numpy()] += n.values.to_numpy()
            trie = sent.value  # noqa: B023
            return trie.told(begin, total[: len(trie.base) - begin])

        rows = held.select("ids", "lead", "hashes").mapInArrow(run, "range int, at array<int>, n array<bigint>")
        out.append(written(rows.groupBy("range").applyInArrow(summed, "key array<bigint>, a bigint"), "phrase-counts", rows=SHARDS))
        sent.destroy()
    none = spark.createDataFrame([], "key array<bigint>, a bigint")
    return reduce(DataFrame.unionByName, out, none)


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    return left.join(right.hint("merge"), on, how)


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, a, l, r, score): of all cuts of a phrase that with the least score, of these the first."""
    n = F.size("key")
    cuts = phrases.select("key", "a", F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("key", F.lit(1), F.col("k")), "right": F.slice("key", F.col("k") + 1, n - F.col("k"))})
    cuts = merged(cuts, counts.select(F.col("key").alias("left"), F.col("a").alias("l")), "left")
    cuts = merged(cuts, counts.select(F.col("key").alias("right"), F.col("a").alias("r")), "right")
    score = F.expr("(1000000BD * cast(a as decimal(16, 0)) * cast(a as decimal(16, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    best = cuts.groupBy("key").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    return best.select("key", "a", "c.l", "c.r", "c.score")


def standing(phrases: DataFrame, share: int) -> DataFrame:
    """Phrases whose words don't lie inside a longer one that occurs at least share / 100 as often. A phrase of one word more
    that holds it occurs as often as any longer one, so these decide."""
    n = F.size("key")
    ends = F.array(F.slice("key", F.lit(1), n - 1), F.slice("key", F.lit(2), n - 1))
    inside = phrases.where(n > 2).select(F.explode(ends).alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    return merged(phrases, inside, "key", "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * share, F.lit(True))).drop("longer")


def collocations(docs: DataFrame, top: int, longest: int = 3, least: int = 10, share: int = 50, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Of each language the first `top` phrases of 2 to `longest` words: (lang, rank, phrase, a, l, r, n, score).

    A-Z are lowered; pieces end at . , ; : ! ? and line ends, words at spaces and tabs; a null text is empty, a null language is
    `und`. a, l, r count a phrase and its two parts, n all words of the language; score = floor(10^6 a a / (l r)), the least of all
    cuts. Phrases under `least` are none; one inside a longer one of at least `share` % of its count is left out. Order: score and
    a from above, phrase by bytes. Counts cover all rows, repeated ones too; an empty table, or one without frequent phrases,
    gives an empty table; other columns are not read.
    """
    for salt in range(8):
        held = shards(docs, longest, salt, lang_col, text_col)
        words = word_counts(held)
        if words.where("clash").isEmpty():
            break
    frequent = words.where(F.col("f") >= least).select(F.col("h").alias("h1"))
    bits, found = [], []
    for _ in range(1, longest):
        bits.append(bitmap(frequent, frequent.columns))
        frequent = candidates(held, bits, least)
        found.append(frequent)
    all_of = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    phrases = written(counted(held, all_of, longest), "phrases")
    counts = phrases.unionByName(words.where(F.col("f") >= least).select(F.array("h").alias("key"), F.col("f").alias("a")))
    kept = written(scored(standing(phrases, share), counts), "scored")
    each = merged(kept.select("key", F.posexplode("key").alias("place", "h")), words.select("h", "lang", "word"), "h")
    named = each.groupBy("key").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = merged(kept, named, "key").drop("key").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for keys in (["lang", "salt"], ["lang"]):  # a language's first rows are among those of its parts
        rows = first_of(rows, keys, order, top)
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return merged(rows, sizes, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def first_of(rows: DataFrame, keys: list[str], order: list[Column], top: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
