"""Searching all rows for a stated set of queries: every shard of rows stays where it is and meets all queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard, and queries that meet it at a time.
SHARD, BLOCK = 65_536, 2_048

Found = tuple[np.ndarray, np.ndarray, np.ndarray]
Searcher = Callable[[np.ndarray, np.ndarray], Found]


def finite(vector: Column) -> Column:
    """True for a vector that is not null and has neither null nor non-finite components."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(ok, F.lit(False))


def search(rows: DataFrame, queries: DataFrame, index: Callable[[np.ndarray, np.ndarray], Searcher], score: str) -> DataFrame:
    """(query_id, vec_id, score) that ``index`` finds for ``queries`` in every shard of ``rows``, both (vec_id, v).

    ``index(ids, vectors)`` is built once for a shard; what it returns is called with the ids and vectors of one block of
    queries after another. Rows are shuffled once and only queries are copied, once to each shard. Vectors shorter than
    the shard's longest end in zeros; what a query has beyond that width meets nothing and is left out.
    """
    n = rows.count()
    shards = max(-(-n // SHARD), min(-(-n // 2_048), rows.sparkSession.sparkContext.defaultParallelism), 1)
    # Consecutive numbers within each input partition fill shards evenly, whatever the keys are.
    left = rows.select("vec_id", "v", F.lit(0).alias("asks"), F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"))
    right = queries.select("vec_id", "v", F.lit(1).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    placed = left.unionByName(right).repartitionById(shards, F.col("shard")).sortWithinPartitions("asks")
    number = np.int64 if score == "long" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, searcher, width = [], None, 0
        for batch in batches:
            split = int(np.searchsorted(batch.column("asks").to_numpy(), 1))
            if split:
                held.append(batch.slice(0, split))
            if split == batch.num_rows or not held and searcher is None:
                continue
            if searcher is None:
                ids = np.concatenate([x.column("vec_id").to_numpy() for x in held])
                width = max(longest(x.column("v")) for x in held)
                searcher = index(ids, np.concatenate([matrix(x.column("v"), width) for x in held]))
                held = []
            for at in range(split, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                found = searcher(block.column("vec_id").to_numpy(), matrix(block.column("v"), width))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.from_numpy_dtype(kind)) for x, kind in zip(found, (np.int64, np.int64, number))], names=["query_id", "vec_id", "score"])

    return placed.select("vec_id", "v", "asks").mapInArrow(run, f"query_id long, vec_id long, score {score}")


def longest(column: pa.ListArray) -> int:
    return int(np.diff(column.offsets.to_numpy()).max(initial=0))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """List column as a matrix of doubles; shorter vectors end in zeros, longer ones are cut."""
    out = np.zeros((len(column), width))
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    size = np.diff(at)
    row, place = np.repeat(np.arange(len(size)), size), np.arange(at[0], at[-1]) - np.repeat(at[:-1], size)
    inside = place < width
    out[row[inside], place[inside]] = flat[at[0] : at[-1]][inside]
    return out


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, rank, vec_id, score) of all shards; at most k rows a query come from each."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best per query, ties to the smaller id. The three arrays run in parallel."""
    order = np.lexsort((ids, -score, query))
    first = np.concatenate(([True], query[order][1:] != query[order][:-1])) if len(order) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[place < k]
