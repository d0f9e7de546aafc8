"""Exact top-k search by MaxScore over impact-ordered postings.

A vector's components are terms, its value at a term is the posting's impact. For a query the contribution of a term
lies between bounds that the shard's largest and smallest impact give. Terms are sorted by the width of those bounds.
The k-th best score so far is the threshold: terms whose bounds together cannot lift a row over it are non-essential.
Essential postings are accumulated for all rows of the shard; the others are probed, a few terms at a time, only for
rows that are still competitive. The first threshold comes from the rows at the head of the strongest postings.
Shards give k rows a query at most and are merged.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do null ids; a missing
component counts as 0; a query id that repeats is one query; its own rows are no candidates; fewer candidates than k
are all returned; ties go to the smaller id; an empty table gives no rows; other columns are not read. Scores must fit
a long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.llm import blocks

#: Rows per posting and postings that give the first threshold; terms probed between two checks of the bound.
HEAD, STRONGEST, STEP = 16, 8, 6


def _best(q: np.ndarray, impacts: np.ndarray, heads: tuple[np.ndarray, np.ndarray], hi: np.ndarray, lo: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of every row that is not below the k-th best score."""
    up, down = np.maximum(q * hi, q * lo), np.minimum(q * hi, q * lo)
    order = np.argsort(down - up, kind="stable")
    # Rows at the heads of the strongest postings, scored in full.
    seeds = np.unique(np.concatenate([heads[0 if q[t] > 0 else 1][t] for t in order[:STRONGEST]]))
    seeds = seeds[~np.isin(seeds, own)]
    scored = q @ impacts[:, seeds]
    threshold = np.partition(scored, -k)[-k] if len(scored) >= k else -np.inf
    rest = np.concatenate((np.cumsum(up[order][::-1])[::-1], [0.0]))
    # Essential terms: as many of the widest as are needed so that the bounds of all others stay under the threshold
    # even where the essential ones give their least.
    least = np.concatenate(([0.0], np.cumsum(down[order])))
    essential = int(np.argmax(least + rest < threshold)) if (least + rest < threshold).any() else len(order)
    essential = min(max(essential, 1), len(order))
    score = q[order[:essential]] @ impacts[order[:essential]]
    score[own] = -np.inf
    alive = np.flatnonzero(score + rest[essential] >= threshold)
    score = score[alive]
    for at in range(essential, len(order), STEP):
        terms = order[at : at + STEP]
        score = score + q[terms] @ impacts[np.ix_(terms, alive)]
        keep = score + rest[min(at + STEP, len(order))] >= threshold
        alive, score = alive[keep], score[keep]
    real = score > -np.inf
    alive, score = alive[real], score[real]
    if len(score) > k:
        keep = score >= np.partition(score, -k)[-k]
        alive, score = alive[keep], score[keep]
    return alive, score


def _index(ids: np.ndarray, vectors: np.ndarray, k: int, scale: int) -> blocks.Searcher:
    """Postings of one shard, and the search in them."""
    v = np.floor(vectors * scale)
    width, most = v.shape[1], float(np.abs(v).max(initial=0)) * max(v.shape[1], 1)
    n = min(HEAD, len(ids))
    by_id = np.argsort(ids, kind="stable")
    sorted_ids = ids[by_id]
    postings: dict[type, np.ndarray] = {}

    def search(query_ids: np.ndarray, q: np.ndarray) -> blocks.Found:
        q = np.floor(q * scale)
        bound = most * float(np.abs(q).max(initial=0))
        if bound >= 2**53:
            raise OverflowError("scores need more than 53 bits")
        # Sums of whole numbers below 2**24 are exact in single precision too.
        kind = np.float32 if bound < 2**24 else np.float64
        if kind not in postings:
            postings[kind] = np.ascontiguousarray(v.T, kind)
        impacts, q = postings[kind], q.astype(kind)
        hi, lo = impacts.max(axis=1, initial=-np.inf), impacts.min(axis=1, initial=np.inf)
        heads = (np.argpartition(-impacts, n - 1, axis=1)[:, :n], np.argpartition(impacts, n - 1, axis=1)[:, :n])
        first, last = np.searchsorted(sorted_ids, query_ids), np.searchsorted(sorted_ids, query_ids, "right")
        found: tuple[list, list, list] = ([], [], [])
        for i in range(len(q)):
            own = by_id[first[i] : last[i]]
            if width == 0:
                at, score = np.setdiff1d(np.arange(len(ids)), own), np.zeros(len(ids) - len(own), kind)
            else:
                at, score = _best(q[i], impacts, heads, hi, lo, own, k)
            keep = np.lexsort((ids[at], -score))[:k]
            for column, x in zip(found, (np.full(len(keep), query_ids[i]), ids[at[keep]], score[keep].astype(np.int64))):
                column.append(x)
        return tuple(map(np.concatenate, found))

    return search


def maxscore_top_k(rows: DataFrame, k: int, is_query: Column, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) from (vec_id, embedding): the k largest inner products of floor(scale * x)."""
    clean = rows.where(blocks.finite(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), is_query.alias("q"))
    queries = clean.where("q").select("vec_id", "v").dropDuplicates(["vec_id"])
    found = blocks.search(clean.select("vec_id", "v"), queries, lambda ids, vectors: _index(ids, vectors, k, scale), "long")
    return blocks.merged(found, k)


ORACLE = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM clean q JOIN clean c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
