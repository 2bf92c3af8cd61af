"""Substring dedup by recompression.

A text's words become symbols. Rounds then name runs of one symbol, and pairs of a left and a right symbol (a bit of
the symbol's hash says which it is in that round), until symbols reach about FULL words. A name is a 64-bit hash of
what it stands for, so all tasks of the cluster give equal content equal names without asking each other. With each
symbol goes the range of words that its making has looked at; where two texts share that range, they share the symbol.

So each window of WINDOW words is stood for by one of the symbols whose whole range lies in it (the one with the least
hash): equal windows choose equal symbols. A symbol that stands in two documents reveals windows that may be
repeated; only those windows are then compared themselves. A window without such a symbol stands for itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.shared import bounded_join, pieces, result, temporary, written

WINDOW = 50
#: Rounds of pairs, and the words at which a symbol is left as it is.
ROUNDS, FULL = 7, 8
FAR = 1 << 40
#: Bytes of zstandard frames of texts that a stage works on at once.
FRAMES = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)  # odd: has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_SEEDS = np.arange(1, ROUNDS + 1, dtype=np.uint64) * _MULT  # modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and where each text begins (with the end)."""
    digest = xxhash.xxh3_64_intdigest
    parts = [np.fromiter(map(digest, w), np.uint64, len(w)) for w in map(words_of, texts)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.cumsum([0, *map(len, parts)])


def symbols(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Names, first words, words after the last, and ranges of the symbols; doc: the text of each word."""
    n = len(h)
    fresh = np.ones(n, bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(fresh)
    end = np.append(start[1:], n)
    run = (end - start).astype(np.uint64)
    name, d = np.where(run > 1, mix(h[start] + run * _MULT), h[start]), doc[start]
    border = np.ones(len(d) + 1, bool)  # before each symbol, and after the last
    border[1:-1] = d[1:] != d[:-1]
    low, high = np.where(border[:-1], -FAR, start - 1), np.where(border[1:], FAR, end + 1)
    for step in range(ROUNDS):
        side = (mix(name + _SEEDS[step]) & np.uint64(1)).astype(np.int8)
        side[end - start >= FULL] = 2
        first = np.zeros(len(name), bool)
        first[:-1] = (side[:-1] == 0) & (side[1:] == 1) & ~border[1:-1]
        second = np.zeros(len(name), bool)
        second[1:] = first[:-1]
        # a left symbol that stays alone has looked at the next symbol, a right one at that before
        after_low, after_high = np.append(low[1:], -FAR), np.append(high[1:], FAR)
        before_low, before_high = np.append(-FAR, low[:-1]), np.append(FAR, high[:-1])
        left, right = side == 0, (side == 1) & ~second
        new_low, new_high = low.copy(), high.copy()
        new_low[left], new_high[left] = np.minimum(low, after_low)[left], np.maximum(high, after_high)[left]
        new_low[right], new_high[right] = np.minimum(low, before_low)[right], np.maximum(high, before_high)[right]
        new_high[left & border[1:]] = FAR
        new_low[right & border[:-1]] = -FAR
        after = np.append(name[1:], np.uint64(0))
        name = np.where(first, mix(name * _MULT + mix(after)), name)
        end = np.where(first, np.append(end[1:], n), end)
        stay = ~second
        name, start, end, low, high, d = name[stay], start[stay], end[stay], new_low[stay], new_high[stay], d[stay]
        border = np.ones(len(d) + 1, bool)
        border[1:-1] = d[1:] != d[:-1]
    return name, start, end, low, high


class Spans:
    """Hashes of stretches of words: differences of prefix sums, moved to the same power."""

    def __init__(self, h: np.ndarray):
        powers = np.full(len(h) + 1, _MULT, np.uint64)
        powers[0] = 1
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h) * np.cumprod(powers)[:-1])])
        back = np.full(len(h) + 1, _INVERSE, np.uint64)
        back[0] = 1
        self.back = np.cumprod(back)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def windows(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Spans]:
    """Of all windows inside one text: text, place of the first word in all words, stand-in symbol, whether it begins a
    run of windows with one stand-in; where texts begin; and the hashes of stretches."""
    h, begin = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(begin))
    last = np.maximum(begin[1:] - WINDOW, begin[:-1] - 1)  # of each text, the last place at which a window begins
    place = np.flatnonzero(np.arange(len(h)) <= last[doc]) if len(h) else np.empty(0, np.int64)
    if not len(place):
        return place, place, np.empty(0, np.uint64), np.empty(0, bool), begin, Spans(h)
    spans = Spans(h)
    name, start, _, low, high = symbols(h, doc)
    a, b = np.maximum(high - WINDOW, begin[doc[start]]), np.minimum(low, last[doc[start]]) + 1
    usable = np.flatnonzero(a < b)
    usable = usable[np.argsort(mix(name[usable]), kind="stable")[::-1]]
    chosen = np.full(len(h), -1, np.int64)
    for s, i, j in zip(usable.tolist(), a[usable].tolist(), b[usable].tolist()):
        chosen[i:j] = s  # the least hash comes last and stays
    chosen = chosen[place]
    stand_in = np.where(chosen >= 0, name[chosen], spans.of(place, place + WINDOW))
    fresh = np.ones(len(place), bool)
    fresh[1:] = (chosen[1:] != chosen[:-1]) | (chosen[1:] < 0) | (place[1:] != place[:-1] + 1)
    return doc[place], place, stand_in, fresh, begin, spans


def lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """Values, ordered by owner, as one Arrow list for each owner."""
    ends = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def packed(rows: DataFrame) -> DataFrame:
    """Rows with their last column, text, as zstandard frames: texts go through two shuffles, and these are smaller."""
    columns, kinds = rows.columns[:-1], [f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns[:-1]]

    def run(batches):
        made = zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches, len(columns)):
            data = [None if t is None else made.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(columns))), pa.array(data, pa.binary())], [*columns, "data"])

    return rows.mapInArrow(run, ", ".join([*kinds, "data binary"]))


def unpacked(column: pa.Array) -> list[str | None]:
    made = zstandard.ZstdDecompressor()
    return [None if d is None else made.decompress(d).decode("utf-8", "surrogatepass") for d in column.to_pylist()]


def stand_ins(rows: DataFrame) -> DataFrame:
    """(id, key, symbols) of the rows (id, key, text) that have a window."""

    def run(batches):
        for batch in pieces(batches, 2):
            doc, _, symbol, first, _, _ = windows(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(symbol[first].view(np.int64), doc[first], batch.num_rows)], ["id", "key", "symbols"])

    return rows.mapInArrow(run, "id long, key long, symbols array<long>").where("size(symbols) > 0")


def revealed_runs(rows: DataFrame) -> DataFrame:
    """(id, key, symbol, run, place, hashes) of rows (id, key, data, symbols): the runs of windows that one of the symbols
    stands for. run is the hash of all words of the run, hashes those of its windows, from place on."""

    def run(batches):
        for batch in pieces(batches, 2, size=FRAMES):
            doc, place, symbol, fresh, begin, spans = windows(unpacked(batch.column(2)))
            ends = batch.column(3).offsets.to_numpy()
            wanted = batch.column(3).flatten().to_numpy().view(np.uint64)
            ends = ends - ends[0]
            hit = np.zeros(len(doc), bool)
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            for k in range(batch.num_rows):
                hit[cut[k] : cut[k + 1]] = np.isin(symbol[cut[k] : cut[k + 1]], wanted[ends[k] : ends[k + 1]])
            first = np.flatnonzero(fresh & hit)
            number = np.cumsum(fresh)[hit]  # the run of each window of a hit
            size = np.bincount(np.unique(number, return_inverse=True)[1], minlength=len(first)) if len(first) else np.empty(0, np.int64)
            own = spans.of(place[hit], place[hit] + WINDOW)
            start = place[first]
            hashes = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(own.view(np.int64)))
            taken = pa.array(doc[first])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(taken),
                    batch.column(1).take(taken),
                    pa.array(symbol[first].view(np.int64)),
                    pa.array(spans.of(start, start + size + WINDOW - 1).view(np.int64)),
                    pa.array((start - begin[doc[first]]).astype(np.int32)),
                    hashes,
                ],
                ["id", "key", "symbol", "run", "place", "hashes"],
            )

    return rows.mapInArrow(run, "id long, key long, symbol long, run long, place int, hashes array<long>")


#: So many keys are broadcast at most; more are joined by sort-merge.
BROADCAST_ROWS = 1_000_000


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(id, key, places array<struct<place, n>>), once for equal rows: of rows (id, key, text), the windows (n from place on) that also start
    in a row with a smaller id.

    Runs of windows with equal words are compared as a whole. Where a symbol stands for runs of different words (at an
    edit, or at the end of a passage), one run of each content is compared window by window.
    """
    rows = rows.where("id is not null and text is not null")
    once = packed(rows.select("id", "key", "text")).groupBy("id", "key").agg(F.min("data").alias("data"))  # equal rows count once
    with temporary(rows.sparkSession):  # the symbols are done with when the runs are told
        found = written(stand_ins(rows), "substring-symbols")
        each = found.select("id", "key", F.explode(F.array_distinct("symbols")).alias("symbol"))
        shared = each.groupBy("symbol").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("symbol")
        revealing = each.join(shared.hint("merge"), "symbol").groupBy("id", "key").agg(F.collect_set("symbol").alias("symbols"))
        told = result(revealed_runs(once.join(revealing.hint("merge"), ["id", "key"]).select("id", "key", "data", "symbols")), "substring-runs")

    runs = told.select("id", "key", "symbol", "run", "place", F.size("hashes").alias("n"))
    contents = written(runs.groupBy("symbol", "run").agg(F.min("id").alias("low")), "substring-contents")
    whole = runs.join(contents.hint("merge"), ["symbol", "run"]).where("low < id").select("id", "key", "place", "n")

    several = written(contents.groupBy("symbol").agg(F.count("*").alias("m"), F.min("low").alias("least"), F.max("low").alias("most")).where("m > 1 and least < most").select("symbol"), "substring-several")
    unclear = bounded_join(contents, several, "symbol", "left_semi", BROADCAST_ROWS)
    # only a content's first document can lose single windows of it: the others lose the whole run
    single = bounded_join(told, several, "symbol", "left_semi", BROADCAST_ROWS).join(written(unclear, "substring-unclear").hint("merge"), ["symbol", "run"]).where("id = low")
    single = written(single.select("id", "key", "symbol", "place", F.posexplode("hashes").alias("at", "hash")), "substring-singles")
    # equal windows have equal stand-ins, so that windows, as runs, are compared by two hashes of different making
    first = written(single.groupBy("symbol", "hash").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("symbol", "hash", "low"), "substring-firsts")
    parts = single.join(first.hint("merge"), ["symbol", "hash"]).where("low < id").select("id", "key", (F.col("place") + F.col("at")).alias("place"), F.lit(1).alias("n"))
    return whole.unionByName(parts).groupBy("id", "key").agg(F.collect_list(F.struct("place", "n")).alias("places"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, unchanged: bool = False) -> DataFrame:
    """Remove each word inside a window of WINDOW words that also starts in a document with a smaller id.

    Gives (row struct of the columns named, n_words, n_removed, kept), a row for each row: kept holds the words that
    stay, joined by one space; with `unchanged`, a text that loses nothing is kept as it is. Null texts have no words. Rows with a null id, or without a window, lose
    nothing and take nothing from others. Rows with the same id never take words from each other. An empty table
    gives an empty table. A copy or passage may stand in any number of documents: only minima are gathered by hash.
    """
    key = F.xxhash64(F.col("text"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).select("id", key.alias("key"), "text")
    with temporary(docs.sparkSession):
        places = result(repeated_windows(rows).withColumnsRenamed({"id": "__id", "key": "__key"}), "substring-places")
    kept_columns = F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("row")
    all_rows = packed(docs.select(kept_columns, F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text")))
    joined = all_rows.join(places.hint("merge"), (F.col("id") == F.col("__id")) & (F.col("key") == F.col("__key")), "left").select("row", "data", "places")
    kind = joined.schema["row"].dataType

    def run(batches):
        for batch in pieces(batches, 1, size=FRAMES):
            n_words, n_removed, kept = [], [], []
            for text, at in zip(unpacked(batch.column(1)), batch.column(2)):
                words = words_of(text)
                if at.is_valid:
                    cover = np.zeros(len(words) + 1, np.int64)
                    first, n = at.values.field("place").to_numpy(), at.values.field("n").to_numpy()
                    np.add.at(cover, first, 1)
                    np.add.at(cover, first + n + WINDOW - 1, -1)
                    stay = np.cumsum(cover)[:-1] == 0
                    left = [w for w, s in zip(words, stay.tolist()) if s]
                else:
                    left = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(text if unchanged and len(left) == len(words) else b" ".join(left).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["row", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, f"row {kind.simpleString()}, n_words long, n_removed long, kept string")
