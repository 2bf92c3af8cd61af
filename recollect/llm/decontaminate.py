"""Benchmark decontamination by a distributed positional inverted index.

The index is a table of shards. A shard holds some whole documents and, for each term in them, the sorted places at
which it stands; places run through the shard's documents with a gap between two of them. It knows nothing of any
benchmark. A search sends the windows of a block of test items to all shards. In each shard a window is answered from
its rarest term on: that term's places, moved to where the window would begin (give or take the slop), are intersected with
the moved places of the next rarest, until none is left or all terms agree (an exact phrase, or a proximity match if some
agree only within the slop).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.shared import new_path, pieces, result, temporary, written

WINDOW = 10
#: A shard closes at so many words or documents.
SHARD_WORDS, SHARD_DOCS = 400_000, 2_048
#: Places between two documents of a shard; words may be out of place by less.
GAP = 16
#: Words of the test items that one search sends to the shards; more are searched block by block, one after another.
BLOCK_WORDS = 250_000
SHARDS = "shard long, ids array<long>, keys array<long>, begins binary, terms binary, counts binary, places binary"
SPAN = "array<struct<item:string,start:int,length:int,exact:boolean>>"
#: A-Z become a-z; what can't stand in a word becomes a space. Other bytes (of UTF-8) stay.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words (ASCII letters and digits, and all that isn't ASCII)."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split(b" ") if text else []
    words = [w for w in words if w]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pack(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the index of all whole texts to a new folder; no shuffle. Null and empty texts are documents without words."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32  # of the next shard
        ids: list = []
        keys: list = []
        texts: list[np.ndarray] = []
        size = 0

        def shard():
            begins = np.cumsum([0, *(len(t) + GAP for t in texts)]).astype(np.int64)
            words = np.concatenate(texts) if texts else np.empty(0, np.uint64)
            place = np.arange(len(words)) + GAP * np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            order = np.argsort(words, kind="stable")
            terms, first = np.unique(words[order], return_index=True)
            sorted_places = place[order].astype(np.int32)
            data = [begins, terms, np.diff(np.append(first, len(words))).astype(np.int32), np.diff(sorted_places, prepend=np.int32(0))]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([keys], pa.list_(pa.int64())), *(pa.array([pack(x)], pa.binary()) for x in data)], names)

        names = [x.split()[0] for x in SHARDS.split(", ")]
        for batch in pieces(batches, 2):
            for key, i, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                ids.append(i)
                keys.append(key)
                texts.append(terms_of(text))
                size += len(texts[-1])
                if size >= SHARD_WORDS or len(ids) >= SHARD_DOCS:
                    yield shard()
                    number, ids, keys, texts, size = number + 1, [], [], [], 0
        if ids:
            yield shard()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    rows.mapInArrow(run, SHARDS).write.option("compression", "none").parquet(path)


class Windows:
    """The windows of test items as an array of term numbers, padded by -1, and the item of each."""

    def __init__(self, items: list[tuple[str, str | None]]):
        self.names, parts, owner, sizes = [name for name, _ in items], [np.empty((0, WINDOW), np.uint64)], [], []
        for k, (_, text) in enumerate(items):
            terms = terms_of(text)
            n = min(WINDOW, len(terms))
            if n:
                found = np.lib.stride_tricks.sliding_window_view(terms, n)
                parts.append(np.pad(found, ((0, 0), (0, WINDOW - n))))
                owner += [k] * len(found)
                sizes += [n] * len(found)
        self.owner, self.sizes = np.array(owner, np.int64), np.array(sizes, np.int64)
        self.terms, number = np.unique(np.concatenate(parts), return_inverse=True)
        self.number = np.where(np.arange(WINDOW) < self.sizes[:, None], number.reshape(-1, WINDOW), -1).astype(np.int32)


def near(sorted_places: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
    """Which of the wanted places have one of the sorted places at a distance of slop at most."""
    at = np.searchsorted(sorted_places, wanted - slop)
    return (at < len(sorted_places)) & (sorted_places[np.minimum(at, len(sorted_places) - 1)] <= wanted + slop)


def match(windows: Windows, begins, terms, counts, places, slop: int) -> dict[int, list[tuple]]:
    """Spans (item, first word, words, exact) by document of a shard."""
    found: dict[int, list[tuple]] = {}
    if not len(terms) or not len(windows.owner):
        return found
    ends = np.cumsum(counts)
    at = np.minimum(np.searchsorted(terms, windows.terms), len(terms) - 1)
    count = np.where(terms[at] == windows.terms, counts[at], 0)
    seen = np.append(count, np.iinfo(np.int32).max)[windows.number]  # of padding: never the least
    moved = np.cumsum(places)

    def of(term: int) -> np.ndarray:
        return moved[ends[at[term]] - counts[at[term]] : ends[at[term]]]

    for w in np.flatnonzero(seen.min(axis=1) > 0):
        size = int(windows.sizes[w])
        rarest = np.argsort(seen[w, :size], kind="stable")
        number = windows.number[w]
        # the rarest word may be out of place by the slop; the first is not, as a match begins with it
        start = of(number[rarest[0]]) - rarest[0]
        if slop and rarest[0]:
            start = np.unique(start[:, None] + np.arange(-slop, slop + 1))
            start = start[near(of(number[0]), start, 0)]
        exact = np.ones(len(start), bool)
        for k in rarest:
            own = of(number[k])
            here = near(own, start + k, slop)
            start = start[here]
            exact = exact[here] & near(own, start + k, 0)
            if not len(start):
                break
        if len(start):
            doc = np.searchsorted(begins, start, "right") - 1
            first = start - begins[np.maximum(doc, 0)]
            length = np.diff(begins)[np.minimum(np.maximum(doc, 0), len(begins) - 2)] - GAP
            for d, f, n, e in zip(doc.tolist(), first.tolist(), length.tolist(), exact.tolist()):
                if d >= 0 and f + size <= n:
                    found.setdefault(d, []).append((windows.names[windows.owner[w]], f, size, e))
    return found


def search(index: DataFrame, items: list[tuple[str, str | None]], slop: int = 0) -> DataFrame:
    """(shard, place, id, key, n_words, spans) of every document of the index for one block of test items."""
    windows = index.sparkSession.sparkContext.broadcast(Windows(items))
    kind = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("exact", pa.bool_())]))

    def run(batches):
        for batch in batches:
            for row in (x for k in range(batch.num_rows) for x in batch.slice(k, 1).to_pylist()):
                begins = unpack(row["begins"], np.int64)
                found = match(windows.value, begins, unpack(row["terms"], np.uint64), unpack(row["counts"], np.int32), unpack(row["places"], np.int32), slop)
                n = len(row["ids"])
                spans = [[dict(zip(("item", "start", "length", "exact"), s)) for s in found.get(d, ())] for d in range(n)]
                columns = [pa.array([row["shard"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(row["ids"], pa.int64()), pa.array(row["keys"], pa.int64()), pa.array(np.diff(begins) - GAP, pa.int64()), pa.array(spans, kind)]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "place", "id", "key", "n_words", "spans"])

    return index.mapInArrow(run, f"shard long, place int, id long, key long, n_words long, spans {SPAN}")


def covered(spans: Column) -> Column:
    """Words in the union of spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(state, s):
        end = s["start"] + s["length"]
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["n"] + F.greatest(end - F.greatest(s["start"], state["end"]), F.lit(0))).alias("n"))

    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))))
    return F.aggregate(ordered, start, add, lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, path: str | None = None, slop: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index the documents and look for all test items (item_id, text) in them.

    Gives (id, key, n_words, spans, n_hit, items, n_near), a row for each document row; key is xxhash64 of the text.
    n_hit counts words in exact matches, items are the sorted distinct ids (as strings) with one, n_near counts words in
    proximity matches: a window's first word stands there, and each other word slop words at most from its place. Null and empty texts have no words, on either side;
    an item with a null id has the empty name; repeated rows and items count as they stand; empty tables give no match.
    Terms are 64-bit hashes of words.
    """
    if not 0 <= slop < GAP:
        raise ValueError(f"slop must be from 0 to {GAP - 1}")
    spark = docs.sparkSession
    path = path or new_path(spark, "positions")
    build_index(docs, path, id_col, text_col)
    index = spark.read.schema(SHARDS).parquet(path)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).distinct()
    words = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 2 + 1
    blocks = -(-words // BLOCK_WORDS)
    if blocks == 1:
        out = search(index, [tuple(r) for r in items.collect()], slop)  # of a bounded size
    else:
        # each block's hits are written before the next block's windows are made
        hits = [written(search(index, [tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()], slop).where("size(spans) > 0"), "hits") for b in range(blocks)]
        more = reduce(DataFrame.unionByName, hits).groupBy(F.col("shard").alias("__shard"), F.col("place").alias("__place")).agg(F.flatten(F.collect_list("spans")).alias("more"))
        every = search(index, [], slop).drop("spans")
        out = every.join(written(more, "all-hits").hint("merge"), (F.col("shard") == F.col("__shard")) & (F.col("place") == F.col("__place")), "left")
        out = out.select("id", "key", "n_words", F.coalesce("more", F.array().cast(SPAN)).alias("spans"))
    exact = F.filter("spans", lambda s: s["exact"])
    return out.select("id", "key", "n_words", "spans").withColumns({
        "n_hit": covered(exact),
        "items": F.sort_array(F.array_distinct(F.transform(exact, lambda s: s["item"]))),
        "n_near": covered(F.filter("spans", lambda s: ~s["exact"])),
    })


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document rows, all columns, without those that hold a window of a test item."""
    with temporary(docs.sparkSession):
        found = contamination(docs, benchmark, id_col=id_col, text_col=text_col).where("n_hit > 0").select(F.col("id").alias("hit_id"), F.col("key").alias("hit_key"))
        found = result(found.distinct(), "contaminated")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("key"))
    on = F.col("id").eqNullSafe(F.col("hit_id")) & F.col("key").eqNullSafe(F.col("hit_key"))
    return rows.join(found.hint("merge"), on, "left_anti").select("row.*")
