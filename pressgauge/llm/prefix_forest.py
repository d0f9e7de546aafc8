"""Approximate nearest neighbours by a hash-prefix forest.

Every tree hashes a vector to a long string of digits: each digit is the corner, of a cross-polytope turned at random in
``CORNERS`` dimensions, that is nearest to the vector. A shard of the index keeps each tree's strings in a sorted array.

A query descends every tree to its longest matching prefix. Then all trees ascend together, a digit at a time, until the
rows under the prefixes, counted per tree, are ``AGREEMENT`` times as many as wanted: dense surroundings end the ascent at
long prefixes, thin ones at short. Of the rows met there, those are scored that most trees have in common with the query,
a tree counting again where it matches a digit more; among equals the smaller ids. Scores are inner products of the
original vectors in double precision.

The number of rows wanted grows with the power 2/3 of the shard's, so the share that is scored falls as shards grow. The
turns come from a seed and need no sample; every row is indexed and no bucket is capped. Rows that are copies of each
other have equal strings and are taken in the order of their ids, as the result has them.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids; a
missing component counts as 0; a query id that repeats is one query; its own rows are no candidates; if a shard has
fewer rows than wanted all are scored; ties go to the smaller id; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.llm import blocks

TREES, DIGITS = 96, 6
#: Dimensions of a digit's cross-polytope, which has twice as many corners.
CORNERS = 16
#: Rows scored per query in a shard of n rows: WANTED * n ** (2 / 3).
WANTED = 2.2
#: How often, over all trees, a row must be met for each row that is wanted.
AGREEMENT = 6
#: Rows hashed at once.
HASHED = 1024


class Forest:
    """The trees of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int, wanted: float, seed: int, k: int):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.k, self.trees = ids[by_id], vectors[by_id], k, trees
        self.wanted = max(k, int(np.ceil(wanted * len(ids) ** (2 / 3))))
        rng, width = np.random.default_rng(seed), vectors.shape[1]
        self.corners = min(CORNERS, max(width, 1))
        self.bits = (2 * self.corners - 1).bit_length()
        count = trees * DIGITS
        turns = [np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(-(-count * self.corners // max(width - width % self.corners, 1)))] if width else []
        # A turn serves several digits, each on dimensions of its own.
        columns = [t[:, j : j + self.corners] for t in turns for j in range(0, width - self.corners + 1, self.corners)]
        self.planes = np.concatenate(columns[:count], axis=1).astype(np.float32) if columns else np.zeros((0, 0), np.float32)
        strings = self.strings(self.vectors)
        self.order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """Hash strings (tree, vector) as integers whose first digit is the highest."""
        out = np.zeros((self.trees, len(vectors)), np.int64)
        if not self.planes.size:
            return out
        for at in range(0, len(vectors), HASHED):
            turned = (vectors[at : at + HASHED].astype(np.float32) @ self.planes).reshape(-1, self.trees * DIGITS, self.corners)
            axis = np.abs(turned).argmax(axis=2)
            positive = np.take_along_axis(turned, axis[:, :, None], axis=2)[:, :, 0] > 0
            digits = (positive * self.corners + axis).reshape(-1, self.trees, DIGITS)
            out[:, at : at + HASHED] = (digits << (self.bits * np.arange(DIGITS - 1, -1, -1))).sum(axis=2).T
        return out

    def under(self, strings: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one place (tree, query) of the rows under the prefixes of so many digits."""
        shift = self.bits * (DIGITS - digits)
        low = (strings >> shift) << shift
        ends = [(np.searchsorted(s, x), np.searchsorted(s, x + (1 << shift))) for s, x in zip(self.sorted, low)]
        return np.array([a for a, _ in ends]), np.array([b for _, b in ends])

    def levels(self, strings: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Digits at which the ascent of each query ends, and the places under the prefixes of every length."""
        places = [self.under(strings, d) for d in range(DIGITS + 1)]
        level = np.zeros(strings.shape[1], np.int64)
        for d, (a, b) in enumerate(places):
            level[(b - a).sum(axis=0) >= AGREEMENT * self.wanted] = d
        return level, places

    def candidates(self, query_ids: np.ndarray, q: np.ndarray):
        """(query, rows to score), query by query."""
        level, places = self.levels(self.strings(q))
        n = len(self.ids)
        for i, d in enumerate(level.tolist()):
            # Trees that match one digit more count a row again; without a shared digit every row is met once.
            met = [self.order[t, a:b] for x in (d, min(d + 1, DIGITS)) for t, (a, b) in enumerate(zip(places[x][0][:, i].tolist(), places[x][1][:, i].tolist()))]
            count = np.bincount(np.concatenate(met), minlength=n)
            a, b = np.searchsorted(self.ids, query_ids[i]), np.searchsorted(self.ids, query_ids[i], "right")
            key = count * np.int64(n) + np.arange(n - 1, -1, -1)
            key[a:b] = -1
            rows = np.argpartition(-key, self.wanted)[: self.wanted] if self.wanted < n else np.arange(n)
            yield i, rows[key[rows] >= n * (d > 0)]

    def __call__(self, query_ids: np.ndarray, q: np.ndarray) -> blocks.Found:
        """The k best candidates of every query by exact scores."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i, rows in self.candidates(query_ids, q):
            rows = np.sort(rows)
            score = np.einsum("ij,ij->i", np.broadcast_to(q[i], (len(rows), q.shape[1])), self.vectors[rows])
            best = np.lexsort((rows, -score))[: self.k]
            out.append((np.full(len(best), query_ids[i]), self.ids[rows[best]], score[best]))
        return tuple(np.concatenate(x) for x in zip(*out))


def forest_top_k(rows: DataFrame, k: int, is_query: Column, trees: int = TREES, wanted: float = WANTED, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) from (vec_id, embedding)."""
    nonzero = F.exists("embedding", lambda x: x != 0)
    clean = rows.where(blocks.finite(F.col("embedding")) & nonzero & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), is_query.alias("q")
    )
    queries = clean.where("q").select("vec_id", "v").dropDuplicates(["vec_id"])
    found = blocks.search(clean.select("vec_id", "v"), queries, lambda ids, vectors: Forest(ids, vectors, trees, wanted, seed, k), "double")
    return blocks.merged(found, k)
