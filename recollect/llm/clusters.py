"""Centroid clustering over a VA-file: vectors as one small cell for each dimension, beside the vectors themselves.

For each centroid a lookup table gives, for each dimension and cell, the least and the greatest part of its distance; their sums
are an interval that holds the distance of every vector in those cells. Where one centroid's interval ends before the others
begin, the cells alone decide; only the other vectors are fetched. Rows lie in zones (folders) by how clearly the cells decided
when the file was written, so a round reads the cells of all rows, but vectors only from zones that hold an undecided row.

A round needs no stored assignment: the cells decide the centroid of a row before and after a move alike, and only rows that are
undecided or that changed add to the sums. All integers are exact; bounds are floats with a margin for their rounding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.shared import new_path, written

#: Bands of clearness in a zone's name; rows of an Arrow batch; components beyond are held as this bound.
BANDS, ROWS, MOST = 8, 8192, 1 << 62
#: Below this size all sums of squares fit 64 bits; larger components are computed with whole numbers of Python.
PLAIN = 1 << 27


def whole_vectors(vectors: DataFrame, size: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, x array<bigint>) of vectors with so many components, none null or non-finite: floor(scale * component)."""
    v = F.col(vector_col)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST)))
    return vectors.where((F.size(v) == size) & finite).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(held(x)).cast("long")).alias("x"))


def seeds(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k rows with the least hash of salt and id; rows without an id come last, equal ids by their components."""
    order = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    return [list(r["x"]) for r in rows.withColumn("hash", order).orderBy(F.col("hash").asc_nulls_last(), "x").limit(k).collect()]


def marks(rows: DataFrame, size: int, bits: int) -> np.ndarray:
    """Edges of 2^bits cells in each dimension: its least value, quantiles of all rows, and its greatest value plus one."""
    n = 1 << bits
    each = rows.select(F.posexplode("x").alias("d", "v")).groupBy("d")
    told = each.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", [i / n for i in range(1, n)], 4 * n).alias("q")).collect()
    out = np.zeros((size, n + 1), np.int64)
    for r in told:
        out[r["d"]] = [r["low"], *r["q"], r["high"] + 1]
    return np.maximum.accumulate(out, 1)


def cells_of(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Cells of vectors: value v lies in cell c if edges[c] <= v < edges[c + 1]."""
    return np.stack([np.searchsorted(edges[d, 1:-1], x[:, d], "right") for d in range(x.shape[1])], 1).astype(np.uint8)


class Bounds:
    """Lookup tables of the distances to some centroids, less what all have in common: that to their mean."""

    def __init__(self, centroids: list[list[int]], edges: np.ndarray):
        c = np.array(centroids, np.float64)
        mean = c.mean(0)
        low, high = edges[:, :-1] - mean[:, None], np.maximum(edges[:, 1:] - 1, edges[:, :-1]) - mean[:, None]
        slope = -2 * (c - mean)
        # |x - c|^2 = |x - m|^2 - 2 (x - m)(c - m) + |c - m|^2, and only the last two differ among the centroids
        a, b = slope[:, :, None] * low, slope[:, :, None] * high
        self.base = ((c - mean) ** 2).sum(1)
        self.low, self.high = np.minimum(a, b), np.maximum(a, b)  # (centroid, dimension, cell)
        # beyond 2^40 floats say too little: no row is decided then
        sure = max(abs(int(edges.min())), abs(int(edges.max()))) < 1 << 40
        self.margin = 1e-11 * (np.maximum(np.abs(a), np.abs(b)).max(2).sum(1).max() + self.base.max() + 1) if sure else np.inf
        self.table = np.ascontiguousarray(np.concatenate([self.low, self.high]).transpose(1, 2, 0))

    def intervals(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.base)
        total = np.zeros((len(cells), 2 * n))
        for d in range(cells.shape[1]):
            total += self.table[d][cells[:, d]]
        return total[:, :n] + self.base, total[:, n:] + self.base

    def decide(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroid with the least upper bound, and the gap between it and the least lower bound of the others, in units of
        the widest interval; 0 if they overlap, and then the row isn't decided."""
        low, high = self.intervals(cells)
        best, rows = high.argmin(1), np.arange(len(cells))
        width = (high - low).max(1) + self.margin
        top = high[rows, best]
        low[rows, best] = np.inf
        gap = low.min(1) - top - self.margin
        return best, np.where(gap > 0, gap, 0) / width if len(low[0]) > 1 and self.margin < np.inf else np.zeros(len(best))


def squared(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances of rows to centroids."""
    c = np.array(centroids, object)
    if not len(x) or max(abs(int(x.max())), abs(int(x.min())), max(abs(v) for row in centroids for v in row)) < PLAIN:
        c = c.astype(np.int64)
        return np.stack([((x - row) ** 2).sum(1) for row in c], 1) if len(x) else np.zeros((0, len(c)), np.int64)
    return np.stack([((x.astype(object) - row) ** 2).sum(1) for row in c], 1)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (ties: the smaller number), and its squared distance."""
    d = squared(x, centroids)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best]


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def cells_matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


def _sums(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, size: int) -> Iterator[pa.RecordBatch]:
    """(cluster, d, total, n) of (rows, cluster, sign): a task's sums; n is the signed number of rows."""
    total, n = np.zeros((k, size), object), np.zeros(k, np.int64)
    for x, cluster, sign in parts:
        plain = not len(x) or max(abs(int(x.max())), abs(int(x.min()))) < PLAIN
        for c in range(k):
            on = cluster == c
            n[c] += int(sign[on].sum())
            total[c] += (x[on] * sign[on, None]).sum(0).astype(object) if plain else (x[on].astype(object) * sign[on, None]).sum(0)
    c, d = np.divmod(np.arange(k * size), size)
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array([Decimal(int(v)) for v in total.ravel()], pa.decimal128(38, 0)), pa.array(n[c])], ["cluster", "d", "total", "n"])


def gathered_sums(rows: DataFrame, run: Callable, k: int, size: int) -> tuple[list[list[int]], list[int]]:
    """Sums of all tasks: a row for each cluster and dimension reaches the driver."""
    total, n = [[0] * size for _ in range(k)], [0] * k
    found = rows.mapInArrow(run, "cluster int, d int, total decimal(38, 0), n long").groupBy("cluster", "d").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    for r in found.collect():
        total[r["cluster"]][r["d"]], n[r["cluster"]] = int(r["total"]), r["n"]
    return total, n


def means(total: list[list[int]], n: list[int], before: list[list[int]]) -> list[list[int]]:
    return [[v // m for v in t] if m else old for t, m, old in zip(total, n, before)]


class VaFile:
    """The written file: (zone, id, cells, x) in folders by zone, and the edges of the cells."""

    def __init__(self, rows: DataFrame, centroids: list[list[int]], edges: np.ndarray):
        self.size, self.edges = len(edges), edges
        size = self.size

        def run(batches):
            bounds = Bounds(centroids, edges)  # made by each task: the tables are larger than what they are made from
            for batch in batches:
                x = matrix(batch.column(1), size)
                cells = cells_of(x, edges)
                best, gap = bounds.decide(cells)
                band = np.where(gap > 0, np.minimum(1 + np.floor(np.minimum(gap, 9) * 4), BANDS - 1), 0).astype(np.int32)
                flat = cells.tobytes()
                packed = pa.array([flat[i : i + size] for i in range(0, len(flat), size)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32) * BANDS + band), batch.column(0), packed, batch.column(1)], ["zone", "id", "cells", "x"])

        path = new_path(rows.sparkSession, "va-file")
        kind = "zone int, id long, cells binary, x array<bigint>"
        self.rows = rows.mapInArrow(run, kind).hint("rebalance", "zone")  # a large zone is split, small ones share tasks
        self.rows.write.partitionBy("zone").parquet(path)
        self.rows = rows.sparkSession.read.schema("id long, cells binary, x array<bigint>, zone int").parquet(path)

    def moves(self, old: list[list[int]], new: list[list[int]]) -> tuple[list[list[int]], list[int], dict[int, int]]:
        """What the sums of each centroid gain when rows go from the nearest of `old` to that of `new`, and the rows of each zone
        that had to be fetched. First all cells are read, then the vectors of zones with such rows."""
        edges, size, k = self.edges, self.size, len(new)

        def open_rows(bounds: list[Bounds], cells: np.ndarray) -> np.ndarray:
            (a, gap), (b, other) = (x.decide(cells) for x in bounds)
            return np.flatnonzero((gap == 0) | (other == 0) | (a != b))

        def look(batches):
            bounds = [Bounds(old, edges), Bounds(new, edges)]
            for batch in batches:
                found = open_rows(bounds, cells_matrix(batch.column(1), size))
                zones, n = np.unique(batch.column(0).to_numpy()[found], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(zones, pa.int32()), pa.array(n, pa.int64())], ["zone", "n"])

        def fetch(batches):
            def each():
                bounds = [Bounds(old, edges), Bounds(new, edges)]
                for batch in batches:
                    found = open_rows(bounds, cells_matrix(batch.column(0), size))
                    x = matrix(batch.column(1).take(pa.array(found)), size)
                    (a, _), (b, _) = nearest(x, old), nearest(x, new)
                    on = a != b
                    yield np.concatenate([x[on], x[on]]), np.concatenate([a[on], b[on]]), np.repeat([-1, 1], on.sum())

            yield from _sums(each(), k, size)

        counts = self.rows.select("zone", "cells").mapInArrow(look, "zone int, n long").groupBy("zone").agg(F.sum("n").alias("n"))
        needed = {r["zone"]: r["n"] for r in counts.collect()}  # BANDS zones for each centroid at most
        total, n = gathered_sums(self.rows.where(F.col("zone").isin(list(needed))).select("cells", "x"), fetch, k, size) if needed else ([[0] * size] * k, [0] * k)
        return total, n, needed

    def assigned(self, centroids: list[list[int]]) -> DataFrame:
        """(id, cluster, distance) of all rows; a decided row is compared with its own centroid alone."""
        edges, size, k = self.edges, self.size, len(centroids)

        def run(batches):
            bounds = Bounds(centroids, edges)
            for batch in batches:
                best, gap = bounds.decide(cells_matrix(batch.column(1), size))
                x = matrix(batch.column(2), size)
                distance = np.zeros(len(best), object)
                open_ = gap == 0
                best[open_], distance[open_] = nearest(x[open_], centroids)
                for c in range(k):
                    on = ~open_ & (best == c)
                    distance[on] = squared(x[on], [centroids[c]])[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array([min(int(v), (1 << 63) - 1) for v in distance], pa.int64())], ["id", "cluster", "distance"])

        return self.rows.select("id", "cells", "x").mapInArrow(run, "id long, cluster int, distance long")


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, bits: int = 8, salt: str = "3:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """k-means in whole numbers: (id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each vector of
    `size` components, none null or non-finite; other vectors are left out.

    Components count as floor(scale * x). Centroids start at the rows with the least sha256 of salt and id; `rounds` times all rows
    go to the nearest centroid (ties: the smaller number) and it moves to floor(sum / count), or stays if it has none. Fewer rows
    than k give fewer centroids. Rows with a null or repeated id stay rows of their own (null ids start no centroid unless too few
    rows have one). Components over 2^62 count as that, a distance over a long as the greatest long, and an inertia over it is
    null. An empty table gives an empty table; other columns are not read.
    """
    rows, spark = whole_vectors(vectors, size, scale, id_col, vector_col), vectors.sparkSession
    centroids = seeds(rows, k, salt)
    if not centroids:
        return spark.createDataFrame([], f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    k = len(centroids)

    def all_sums(batches):
        def each():
            for batch in batches:
                x = matrix(batch.column(0), size)
                yield x, nearest(x, centroids)[0], np.ones(len(x), np.int64)

        yield from _sums(each(), k, size)

    if rounds:
        total, n = gathered_sums(rows.select("x"), all_sums, k, size)
        old, new = centroids, means(total, n, centroids)
    else:
        old = new = centroids
    file = VaFile(rows, new, marks(rows, size, bits))
    for _ in range(rounds - 1):
        if new == old:
            break  # no row moves any more
        gain, more, _ = file.moves(old, new)
        total = [[a + b for a, b in zip(t, g)] for t, g in zip(total, gain)]
        n = [a + b for a, b in zip(n, more)]
        old, new = new, means(total, n, new)
    found = written(file.assigned(new), "clusters", rows=ROWS)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38, 0)")).alias("s")).collect()}
    whole = lambda v: v if v < 1 << 63 else None
    told = [(c, whole(sums.get(c, 0)), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(new)]
    each = F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, centroid_sha256 string"))  # k rows
    out = found.join(each, "cluster").withColumn("inertia", F.lit(whole(sum(sums.values()))).cast("long"))
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
