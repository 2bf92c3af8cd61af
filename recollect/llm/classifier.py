"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

A word's index vector has a few +1 and -1, told by its hash; its context vector sums the index vectors of the words around all its
occurrences in all documents. Words share BUCKETS vectors by hash, so what every task needs has a fixed size, and no word is left
out. The sums are whole numbers, so they don't hang on the order of tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.runs import SIZE, classes, gathered, numbered, parts, runs
from recollect.llm.shared import written

#: Vectors of words, their length, nonzero components of an index vector, words on each side that are a word's context.
BUCKETS, WIDTH, NONZERO, AROUND = 1 << 15, 32, 4, 2
#: Classes of bytes: signs (0), white space (1), letters, digits and bytes of other scripts (2), line ends (3).
KINDS = classes(b" \t\x0b\x0c\r", bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]), b"\n")
_SPACE = re.compile(rb"[ \t-\r]")
#: Hidden units, steps and rate of the fit; one in so many of the sample sets the temperature; distinct words a worker remembers.
HIDDEN, STEPS, RATE, CALIBRATION, KNOWN = 32, 800, 0.01, 5, 500_000
#: One in so many rows is held out.
HELD_OUT = 5
#: Labelled rows that the network is fitted on, at most: those with the least hash of doc_id.
SAMPLE = 20_000
#: Rows of documents of an Arrow batch.
ROWS = 512


def buckets(text: bytes, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's words (runs of letters, of signs, of line ends; capitals count), and where the words start."""
    data = np.frombuffer(text, np.uint8)
    kind = KINDS[data]
    begin, end = runs(kind)
    word = kind[begin] != 1
    begin, end = begin[word], end[word]
    number, distinct = numbered(data, kind != 1, end - begin)
    if len(known) > KNOWN:
        known.clear()
    known.update((w, xxhash.xxh3_64_intdigest(w) % BUCKETS) for w in distinct if w not in known)
    return np.array([known[w] for w in distinct], np.int64)[number], begin


def index_vectors() -> np.ndarray:
    """NONZERO components of +1 or -1 for each bucket, by a fixed generator."""
    rnd = np.random.default_rng(13)
    out = np.zeros((BUCKETS, WIDTH), np.int8)
    at = rnd.random((BUCKETS, WIDTH)).argsort(1)[:, :NONZERO]
    np.put_along_axis(out, at, rnd.choice(np.array([-1, 1], np.int8), at.shape), 1)
    return out


def documents_of(texts: list[bytes], known: dict[bytes, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, number of the text) of the words of some whole texts; one long text comes in parts."""
    if len(texts) > 1 or len(texts[0]) <= SIZE:
        found, at = buckets(b" ".join(texts), known)
        starts = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        yield found, np.searchsorted(starts, at, "right") - 1
        return
    for begin, end in parts(texts[0], _SPACE):
        found, _ = buckets(texts[0][begin:end], known)
        yield found, np.zeros(len(found), np.int64)


def word_vectors(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, weights) of the buckets: context sums of all documents, centred and of length 1, and smooth inverse frequencies."""
    names = [f"v{i}" for i in range(WIDTH)]

    def run(batches):
        index, total, n, known = index_vectors(), np.zeros((BUCKETS, WIDTH), np.int64), np.zeros(BUCKETS, np.int64), {}
        for _, texts in gathered(batches, 0, 0):
            for word, doc in documents_of(texts, known):
                if not len(word):
                    continue
                # rows of zeros between documents, so that none is the other's context
                gap = AROUND * (doc + 1)
                place = np.arange(len(word)) + gap
                own = np.zeros((place[-1] + 1 + AROUND, WIDTH), np.int8)
                own[place] = index[word]
                around = np.zeros((len(word), WIDTH), np.int8)
                for k in range(1, AROUND + 1):
                    around += own[place + k]
                    around += own[place - k]
                order = np.argsort(word.astype(np.uint16), kind="stable")
                counts = np.bincount(word, minlength=BUCKETS)
                met = np.flatnonzero(counts)
                total[met] += np.add.reduceat(around[order], np.cumsum(counts[met]) - counts[met], 0, np.int32)
                n += counts
        on = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(n[on]), *[pa.array(total[on, d]) for d in range(WIDTH)]], ["bucket", "n", *names])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long, " + ", ".join(f"{c} long" for c in names))
    found = written(rows.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ["n", *names]]), "word-vectors", rows=ROWS).toArrow()  # BUCKETS rows at most
    n, total = np.zeros(BUCKETS), np.zeros((BUCKETS, WIDTH))
    at = found["bucket"].to_numpy()
    n[at], total[at] = found["n"].to_numpy(), np.stack([found[c].to_numpy() for c in names], 1)
    share = n / max(n.sum(), 1)
    vector = total / np.maximum(n, 1)[:, None] - share @ (total / np.maximum(n, 1)[:, None])
    vector[n == 0] = 0
    vector /= np.maximum(np.sqrt((vector**2).sum(1)), 1e-12)[:, None]
    return vector.astype(np.float32), 1e-3 / (1e-3 + share)


def pooled(batches: Iterator[pa.RecordBatch], vector: np.ndarray, weight: np.ndarray) -> Iterator[tuple[list, np.ndarray]]:
    """Keys and pools of documents (key, text): weighted mean and deviation of word vectors, mean agreement of successive words,
    logarithm of the words. A text without words has zeros."""
    known: dict[bytes, int] = {}
    weighted = np.concatenate([vector * weight[:, None], vector**2 * weight[:, None], weight[:, None]], 1).astype(np.float32)
    for keys, texts in gathered(batches, 1, 0):
        sums, pairs, n = np.zeros((len(texts), 2 * WIDTH + 1)), np.zeros(len(texts)), np.zeros(len(texts))
        for word, doc in documents_of(texts, known):
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            if len(word):
                sums[doc[first]] += np.add.reduceat(weighted[word], first, 0)
            same, near = doc[1:] == doc[:-1], vector[word]
            pairs += np.bincount(doc[1:][same], np.einsum("ij,ij->i", near[1:], near[:-1])[same], len(texts))
            n += np.bincount(doc, minlength=len(texts))
        total = np.maximum(sums[:, -1:], 1e-12)
        mean = sums[:, :WIDTH] / total
        deviation = np.sqrt(np.maximum(sums[:, WIDTH:-1] / total - mean**2, 0))
        yield keys, np.concatenate([mean, deviation, (pairs / np.maximum(n - 1, 1))[:, None], np.log1p(n)[:, None]], 1)


@dataclass
class Network:
    """Two layers over standardised pools; a probability is that of the second layer's value over the temperature."""

    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def value(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh(((x - self.centre) / self.scale) @ a + b) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.value(x) / self.temperature, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, calibrating: np.ndarray) -> Network:
    """Fit the layers on the rows not set aside (Adam on the cross entropy, weights decayed), then the temperature on those that
    are: the one of a fixed grid with the least cross entropy. With labels of one kind only, the score is their smoothed share."""
    rnd, width = np.random.default_rng(7), x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    constant = Network(np.zeros(width), np.ones(width), [np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.array(np.log(share / (1 - share)))], 1.0)
    train, rest = (x[~calibrating], y[~calibrating]), (x[calibrating], y[calibrating])
    if len(set(train[1].tolist())) < 2:
        return constant
    x, y = train
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - centre) / scale
    layers = [rnd.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rnd.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    first, second = [np.zeros_like(v) for v in layers], [np.zeros_like(v) for v in layers]
    for step in range(1, STEPS + 1):
        a, b, c, d = layers
        h = np.tanh(z @ a + b)
        error = (1 / (1 + np.exp(-np.clip(h @ c + d, -500, 500))) - y) / len(y)
        back = np.outer(error, c) * (1 - h * h)
        slopes = [z.T @ back + 1e-4 * a, back.sum(0), h.T @ error + 1e-4 * c, error.sum()]
        for k, g in enumerate(slopes):
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
            layers[k] = layers[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    network = Network(centre, scale, layers, 1.0)
    if len(rest[1]):
        value, sign = network.value(rest[0]), 2 * rest[1] - 1
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
        network.temperature = float(grid[np.argmin([np.logaddexp(0, -sign * value / t).mean() for t in grid])])
    return network


def held_out(id_col: str) -> Column:
    """Whether the crc32 of an id as text has remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, vector: np.ndarray, weight: np.ndarray, id_col: str, text_col: str, label_col: str) -> Network:
    """The network of a sample of labelled rows that aren't held out."""
    order = lambda *c: [F.xxhash64(F.lit("sample"), F.col(id_col)), *c]
    told = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("long").alias(id_col), F.col(label_col).cast("int").alias("y")).distinct()
    told = written(told.orderBy(*order(F.col(id_col), F.col("y"))).limit(SAMPLE), "labelled", rows=ROWS)
    own = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text")).join(F.broadcast(told.select(id_col).distinct()), id_col, "left_semi")

    def run(batches):
        for keys, x in pooled(batches, vector, weight):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], [id_col, "x"])

    rows = own.mapInArrow(run, f"{id_col} long, x array<double>").join(F.broadcast(told), id_col).orderBy(*order(F.col(id_col), F.col("y"), F.col("x"))).limit(SAMPLE)
    rows = rows.select(id_col, "x", "y", (F.pmod(F.xxhash64(F.lit("temperature"), F.col(id_col)), F.lit(CALIBRATION)) == 0).alias("c")).toArrow()
    if not rows.num_rows:
        return fit(np.zeros((0, 2 * WIDTH + 2)), np.zeros(0), np.zeros(0, bool))
    x = np.array(rows["x"].combine_chunks().flatten().to_numpy()).reshape(rows.num_rows, -1)
    return fit(x, rows["y"].to_numpy().astype(np.float64), rows["c"].to_numpy(zero_copy_only=False))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted) of every row, from its whole text alone.

    Word vectors and frequencies come from all documents, held out or not; labels only from rows that aren't held out: at most
    SAMPLE rows, those with the least hash of their id, of which one in CALIBRATION sets the temperature. Null texts are empty, and
    an empty text has a score as well; rows with equal texts have equal scores, repeated ids stay rows of their own, a null id isn't
    held out. Labels other than 0 and 1, and those of a null id, are left out; an id with both labels counts for both. Without
    labels of both kinds the score is their smoothed share for all. An empty table gives an empty table.
    """
    vector, weight = word_vectors(docs, text_col)
    network = trained(docs, labels, vector, weight, id_col, text_col, label_col)

    def run(batches):
        for keys, x in pooled(batches, vector, weight):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(network.score(x))], [id_col, "score"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(run, f"{id_col} long, score double")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
