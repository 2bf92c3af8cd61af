"""Minimum-cost-flow resharding: new shards of near equal bytes with the fewest bytes moved.

The flow is solved between old and new shards, on as many nodes as there are shards, over the bytes of all documents. It
can't split a document, and that tells only for large ones: documents of a share of 1 / (64 new shards) of all bytes or more,
few by arithmetic, each follow the first flow whole, and a second flow between the room that they leave and the other
documents makes up for it. These lie in blocks by size class and hash, and only the blocks' totals are gathered.

An old shard's blocks stand in a line, large documents first. The bytes that stay are taken from its front, and what
each new shard gets is a stretch of the rest; a document goes where its middle byte lies. So cuts fall among small
documents, and shards differ by little more than a document.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.llm.shared import bounded_join, new_path, result, temporary, written

#: A document is large from total / (LARGE x new shards) bytes on; so there are LARGE x new shards of them at most.
LARGE = 64
#: Hash parts of each size class of an old shard: at least so many, and one for so many rows of the table.
PARTS, PART_ROWS = 64, 4_000_000
#: More blocks than this are joined by sort-merge and not broadcast.
BROADCAST_BLOCKS = 100_000


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[list[int]]:
    """Units from each source to each sink at the least total cost: shortest augmenting paths with potentials.

    All supply is sent; the capacities must hold it. The graph has a node for each shard, whatever the rows.
    """
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]  # to, left, cost, place of the way back

    def add(a: int, b: int, units: int, price: int) -> None:
        graph[a].append([b, units, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, units in enumerate(supply):
        add(source, i, units, 0)
        for j in range(m):
            add(i, n + j, units, cost(i, j))
    for j, units in enumerate(capacity):
        add(n + j, sink, units, 0)
    potential, left = [0] * (n + m + 2), sum(supply)
    while left:
        far: list = [None] * (n + m + 2)
        way: list = [None] * (n + m + 2)
        far[source], queue, done = 0, [(0, source)], set()
        while queue:
            d, a = heapq.heappop(queue)
            if a in done:
                continue
            done.add(a)
            for k, (b, units, price, _) in enumerate(graph[a]):
                if units and (far[b] is None or d + price + potential[a] - potential[b] < far[b]):
                    far[b], way[b] = d + price + potential[a] - potential[b], (a, k)
                    heapq.heappush(queue, (far[b], b))
        if far[sink] is None:
            raise ValueError("the capacities don't hold the supply")
        potential = [p + f if f is not None else p for p, f in zip(potential, far)]
        push, b = left, sink
        while b != source:
            a, k = way[b]
            push, b = min(push, graph[a][k][1]), a
        b = sink
        while b != source:
            a, k = way[b]
            graph[a][k][1] -= push
            graph[b][graph[a][k][3]][1] += push
            b = a
        left -= push
    return [[next(graph[n + j][back][1] for b, _, _, back in graph[i] if b == n + j) for j in range(m)] for i in range(n)]


def level(loads: list[int], total: int) -> list[int]:
    """What each shard gets of total so that the loads become as equal as they can (given loads only grow)."""
    order = sorted(range(len(loads)), key=lambda i: loads[i])
    used, height, left = 0, 0, total
    for used in range(1, len(order) + 1):
        height = sum(loads[i] for i in order[:used]) + total
        if used == len(order) or height <= loads[order[used]] * used:
            break
    out = [0] * len(loads)
    for rank, i in enumerate(order[:used]):
        out[i] = height // used + (rank < height % used) - loads[i]
        if out[i] < 0:
            out[i] = 0
    left = total - sum(out)
    out[order[0]] += left  # a rounding unit
    return out


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def follow(flow: list[list[int]], names: list[int], n_new: int, large: list[tuple[int, int, int]]) -> list[int]:
    """New shards of large documents (old, place, size; largest first) by the flow: a document stays home if it has room in
    what stays there, or if it has room nowhere and not less than elsewhere; else it takes the most room in what is moved to a shard."""
    stay = {old: row[old] for old, row in zip(names, flow) if old < n_new}
    come = [sum(row[j] for old, row in zip(names, flow) if old != j) for j in range(n_new)]
    out = []
    for old, _, size in large:
        most = max(range(n_new), key=lambda j: (come[j], -j))
        room = stay.get(old, 0)
        if old < n_new and (room >= size or (room >= come[most] and size > come[most])):
            out.append(old)
            stay[old] -= size
        else:
            out.append(most)
            come[most] -= size
    return out


def plan(rows: DataFrame, n_new: int) -> tuple[DataFrame, DataFrame, list[list[int]]]:
    """Large documents' shards, stretches (old, low, high, shard) of the old shards' lines of other documents, and their flow.

    rows: (old, place, size). Gathers the large documents, at most LARGE x n_new, and totals for each old shard.
    """
    spark = rows.sparkSession
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    large_from = total // (LARGE * n_new) + 1
    small = F.when(F.col("size") < large_from, F.col("size")).otherwise(0)
    sums = rows.groupBy("old").agg(F.sum("size").alias("n"), F.sum(small).alias("small")).orderBy("old").collect()  # a row for each old shard
    names, price = [r["old"] for r in sums], lambda i, j: 0 if names[i] == j else 1
    first = min_cost_flow([r["n"] for r in sums], level([0] * n_new, total), price) if sums else []
    large = [tuple(r) for r in rows.where(F.col("size") >= large_from).select("old", "place", "size").orderBy(F.desc("size"), "place", "old").collect()]
    where = [(*doc, shard) for doc, shard in zip(large, follow(first, names, n_new, large))]
    loads = [0] * n_new
    for _, _, size, shard in where:
        loads[shard] += size
    supply = [r["small"] for r in sums]
    flow = min_cost_flow(supply, level(loads, sum(supply)), price) if supply else []
    stretches = []
    for i, old in enumerate(names):
        low = 0
        for j in sorted(range(n_new), key=lambda j: (j != old, j)):  # what stays comes first
            if flow[i][j]:
                stretches.append((old, low, low + flow[i][j], j))
                low += flow[i][j]
    return (
        spark.createDataFrame(where, "old int, place long, size long, shard int").select("old", "place", "size", "shard"),
        spark.createDataFrame(stretches, "old int, low long, high long, shard int"),
        flow,
    )


def lay_out(docs: DataFrame, old: Column, path: str, text_col: str = "text") -> DataFrame:
    """Write shard files as they are before: (row struct of all columns, place, size, text_crc32, old), no shuffle.

    old gives the present shard of a row (null: 0). place numbers the rows, so that equal rows are told apart. The
    checksum of a null text is that of an empty one.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.monotonically_increasing_id().alias("place"),
        size_of(F.col(text_col)).alias("size"),
        F.coalesce(F.crc32(F.col(text_col)), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(old.cast("int"), F.lit(0)).alias("old"),
    )
    rows.write.option("compression", "zstd").partitionBy("old").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def reshard(rows: DataFrame, n_new: int) -> DataFrame:
    """Assign every row (place, size, old) to a new shard: (place, size, old, shard, slot).

    slot counts a shard's rows from 0 without a gap, in the order of (old, block, place). An empty table gives an
    empty table. No window takes more than a block: blocks are prefix-summed by their totals.
    """
    rows = rows.select("place", "size", "old")
    large, stretches, _ = plan(rows, n_new)
    size_class = 63 - F.floor(F.log2(F.col("size").cast("double"))).cast("int")
    parts = max(PARTS, rows.count() // PART_ROWS)
    blocks = rows.withColumn("block", size_class.cast("long") * parts + F.pmod(F.xxhash64("place"), F.lit(parts)))
    large = F.broadcast(large.select(F.col("place").alias("__place"), F.col("shard").alias("large")))  # LARGE x n_new rows at most
    blocks = written(blocks.join(large, F.col("place") == F.col("__place"), "left").drop("__place"), "reshard-blocks")
    small = blocks.where("large is null")
    totals = small.groupBy("old", "block").agg(F.sum("size").alias("n"))
    before = W.partitionBy("old").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = written(totals.select("old", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "reshard-starts")
    inside = W.partitionBy("old", "block").orderBy(F.desc("size"), "place").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = bounded_join(small.withColumn("offset", offset), starts, ["old", "block"], "inner", BROADCAST_BLOCKS)
    middle = F.col("base") + F.col("offset") + F.floor(F.col("size") / 2)
    stretches = F.broadcast(stretches.withColumnRenamed("old", "__old"))  # a row for each transfer between two shards
    moved = placed.join(stretches, (F.col("old") == F.col("__old")) & (middle >= F.col("low")) & (middle < F.col("high")))
    columns = ["place", "size", "old", "block"]
    assigned = written(moved.select(*columns, "shard").unionByName(blocks.where("large is not null").select(*columns, F.col("large").alias("shard"))), "reshard-placed")
    counts = assigned.groupBy("shard", "old", "block").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("shard").orderBy("old", "block").rowsBetween(W.unboundedPreceding, -1)
    bases = written(counts.select("shard", "old", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "reshard-slots")
    rank = F.row_number().over(W.partitionBy("shard", "old", "block").orderBy("place")) - 1
    out = assigned.withColumn("rank", rank).join(bases.hint("merge"), ["shard", "old", "block"])
    return out.select("place", "size", "old", "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot"))


def rewrite(rows: DataFrame, assigned: DataFrame, path: str) -> DataFrame:
    """Write the files of the shards that lose or gain a row, and read them back: (row, size, text_crc32, slot, shard).

    Shards that keep just their rows are not written again: their old files stay in use.
    """
    spark = rows.sparkSession
    changed = assigned.where("old <> shard")
    shards = changed.select(F.col("shard").alias("__shard")).unionByName(changed.select(F.col("old").alias("__shard"))).distinct()
    moving = assigned.join(F.broadcast(shards), F.col("shard") == F.col("__shard"), "left_semi")  # a row for each shard
    both = rows.select("row", "place", "text_crc32", "size").join(moving.select("place", "shard", "slot").hint("merge"), "place")
    out = both.select("row", "size", "text_crc32", "slot", "shard")
    out.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def reshard_files(docs: DataFrame, n_new: int, old: Column) -> DataFrame:
    """Lay the rows out as old gives, reshard, rewrite: (row, size, text_crc32, slot, shard) of all files then in use."""
    spark = docs.sparkSession
    rows = lay_out(docs, old, new_path(spark, "old-shards"))
    with temporary(spark):
        assigned = result(reshard(rows, n_new), "resharded")
    new = rewrite(rows, assigned, new_path(spark, "new-shards"))
    moved = assigned.where("old <> shard")
    touched = [r[0] for r in moved.select("shard").unionByName(moved.select(F.col("old").alias("shard"))).distinct().collect()]  # a row for each shard
    left = rows.where(~F.col("old").isin(touched)) if touched else rows
    if left.isEmpty():
        return new
    kept = left.select("row", "place", "size", "text_crc32").join(assigned.select("place", "slot", "shard").hint("merge"), "place")
    return new.unionByName(kept.select("row", "size", "text_crc32", "slot", "shard"))
