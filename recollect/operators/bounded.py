"""Exact first rows of many queries over blocks of rows, of which only those are scored whose bound can reach the rows found.

Rows and queries are gathered in blocks. A bound says how much a query can score in a block at most; the blocks with a query's best
bounds are scored first, and what it finds there sets a floor: its k-th score. Only blocks whose bound reaches the floor are
scored then, so that the rows in between are pairs of queries and blocks, and the best rows of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions.tables import top_rows, written

#: Queries of a block, summaries of blocks that meet queries at once, blocks of a query that are scored first, blocks of queries that
#: are sent to all tasks at a time.
QUERY_BLOCK, SUMMARIES, FIRST, SENT = 512, 64, 2, 16
#: Added to bounds, for the rounding of scores.
SLACK = 1e-3


def asked_in_blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> DataFrame:
    """(qblock, queries array<struct>) of queries with a `number`."""
    n = max(1, -(-queries.count() // size))
    return written(queries.groupBy(F.pmod(F.xxhash64("number"), F.lit(n)).cast("int").alias("qblock")).agg(F.collect_list(F.struct(*queries.columns)).alias("queries")), "asked")


def summary_packs(summaries: DataFrame) -> DataFrame:
    """(summaries array<struct>) of rows (block, ...): SUMMARIES or so in a row."""
    n = max(1, -(-summaries.count() // SUMMARIES))
    return written(summaries.groupBy(F.pmod(F.xxhash64("block"), F.lit(n)).alias("pack")).agg(F.collect_list(F.struct(*summaries.columns)).alias("summaries")).select("summaries"), "summaries")


def bounds_of(summaries: DataFrame, asked: DataFrame, bound: Callable[[pa.StructArray, pa.StructArray], Iterator[tuple]]) -> DataFrame:
    """(number, qblock, block, bound) of every query and block. bound() gives (numbers, blocks, bounds) of a pack and a block of
    queries; pairs that it leaves out can't score."""

    def run(batches):
        for batch in batches:
            for pack, qblock, queries in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                numbers, blocks, values = bound(pack.values, queries.values)
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([qblock] * len(numbers), pa.int32()), pa.array(blocks, pa.int64()), pa.array(values, pa.float64())], ["number", "qblock", "block", "bound"])

    pairs = summary_packs(summaries).crossJoin(asked.select("qblock", "queries"))
    return pairs.mapInArrow(run, "number long, qblock int, block long, bound double")


def bounded_top(bounds: DataFrame, held: DataFrame, asked: DataFrame, score: Callable[[pa.StructScalar, pa.StructArray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], kinds: str, depth: int, order: list[Column], first: int = FIRST, name: str = "bounded") -> DataFrame:
    """Rows (number, score, ...) that hold the first `depth` rows of each query in the order given, which begins with the score.

    held: (block, rows struct) and asked: (qblock, queries) are written tables; score() gives the best rows in a block of the
    queries with some numbers (in order), at least those that reach the queries' floors. Blocks of queries are sent to the tasks that
    hold the blocks of rows, some at a time, so that rows are moved once for all of these; rows under a floor don't leave a task.
    """
    width = len(held.columns)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                needs = batch.column(width + 1)[row].values
                numbers, floors = needs.field("number").to_numpy(), needs.field("floor").to_numpy()
                at = np.argsort(numbers)
                numbers, floors = numbers[at], floors[at]
                for found in score({c: batch.column(k)[row] for k, c in enumerate(batch.schema.names[:width])}, batch.column(width)[row].values, numbers, floors):
                    yield found.filter(pc.greater_equal(found["score"], pa.array(floors[np.searchsorted(numbers, found["number"].to_numpy())])))

    qblocks = sorted(r[0] for r in asked.select("qblock").collect())  # numbers alone
    groups = [qblocks[k : k + SENT] for k in range(0, len(qblocks), SENT)]

    def scored(needs: DataFrame, table: str) -> DataFrame:
        out = []
        for group in groups:  # SENT x QUERY_BLOCK queries
            each = needs.where(F.col("qblock").isin(group)).groupBy("block", "qblock").agg(F.collect_list(F.struct("number", "floor")).alias("needs"))  # a block of queries
            pairs = each.join(held.hint("merge"), "block").join(F.broadcast(asked.where(F.col("qblock").isin(group))), "qblock")
            out.append(written(pairs.select(*held.columns, "queries", "needs").mapInArrow(run, kinds), table))
        return reduce(DataFrame.unionByName, out, held.sparkSession.createDataFrame([], kinds))

    ranked = written(bounds.withColumn("place", F.row_number().over(W.partitionBy("number").orderBy(F.col("bound").desc(), "block"))), f"{name}-bounds")
    seeds = scored(ranked.where(F.col("place") <= first).withColumn("floor", F.lit(float("-inf"))), f"{name}-first")
    floor = top_rows(seeds, ["number"], order, depth).groupBy("number").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= depth).select("number", "floor")
    rest = ranked.where(F.col("place") > first).join(floor.hint("merge"), "number", "left").where(F.col("floor").isNull() | (F.col("bound") + SLACK >= F.col("floor")))
    rest = written(rest.select("number", "qblock", "block", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")), f"{name}-open")
    return seeds.unionByName(scored(rest, f"{name}-rows"))
