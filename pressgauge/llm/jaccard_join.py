"""N-gram Jaccard join by prefix filters under several global token orders.

Words are runs of bytes other than ASCII white space with A-Z folded. A document's set holds its distinct k-word
shingles; a document with fewer words is one item, a blank or null one has the empty set and links with nothing.
Two documents link when ``100 * |A & B| >= percent * |A | B|``.

If two sets of n and m <= n shingles link, their prefixes of n - ceil(t n) + l and m - ceil(t m) + l shingles share l
shingles at least, under every global order of the shingles. The plan:

1. One pass hashes every whole text to its set's size and digest. Documents with equal sets are one node from here on.
2. Under the order of the hashes themselves long prefixes (l about (1 - t) n) are posted by shingle, packed (see
   ``postings``). A node of whose prefix fewer than l shingles are posted by other nodes can link to nothing and goes.
   The sets of the nodes left are written once.
3. Over these sets the frequent shingles are counted. Three global orders are applied: rare shingles first, then by
   hash; rare first, then by another hash; and by a third hash alone. Nodes meet by the shingles of their short prefixes
   (l = 1) under the first order, within length and position bounds. Candidate pairs are narrow rows until their
   prefixes under the second and the third order have been found to overlap as well; only then the sets are joined and
   the intersection is counted.

Groups of near copies meet through hubs and families (see ``linking``), never as all pairs of a key.

Edge cases: null text and blank text have n_shingles 0 and their own doc_id as component; rows that repeat a doc_id
are separate documents; null doc_ids take part and a component of only such rows has a null component_id; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.llm import words as W
from pressgauge.llm.linking import link
from pressgauge.llm.postings import shared
from pressgauge.llm.scratch import Workspace, cut, small_batches, small_side

#: Multipliers whose products mix the hashes for the second and third global order.
MIXES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
#: Shingles that more nodes hold than this, and than a share of 1 / MOST_FREQUENT of all, are ordered by frequency; that
#: makes MOST_FREQUENT of them at most.
FREQUENT, MOST_FREQUENT = 64, 200_000


def _spare(n, percent: int):
    """Shingles of a set of n that a partner may lack."""
    return n - -(-percent * n // 100)


def _least_shared(n: int, percent: int) -> int:
    """Shingles of n's long prefix that a partner's long prefix holds at least; the smallest partner has ceil(t n)."""
    return _spare(-(-percent * n // 100), percent) + 1


def text_hash() -> Column:
    """Tells texts apart where rows repeat a doc_id or have none."""
    return F.xxhash64(F.col("text").cast("string"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash().alias("text_hash"))


def node_sizes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_hash, node, n) of every row; node is the digest of the set, null if that is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size = [], []
            for _, data, at in W.chunks(batch.column("text")):
                for u in W.row_sets(data, at, k):
                    size.append(len(u))
                    node.append(W.digest(u))
            n = np.array(size, np.int64)
            nodes = pa.array(np.array(node, np.uint64).view(np.int64), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), nodes, pa.array(n)], names=["doc_id", "text_hash", "node", "n"])

    return _texts(docs).mapInArrow(run, "doc_id long, text_hash long, node long, n long")


def shared_nodes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, n_shared): shingles of the long prefixes under the first order that other nodes' prefixes hold."""

    def units(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, data, at in W.chunks(batch.column("text")):
            tokens, owners = [], []
            for u in W.row_sets(data, at, k):
                if n := len(u):
                    u_ = u[: 2 * _spare(n, percent) + 1]
                    tokens.append(u_)
                    owners.append(np.full(len(u_), W.digest(u), np.uint64))
            if tokens:
                yield np.concatenate(tokens), np.concatenate(owners)

    found = shared(docs.select(F.col("text").cast("string").alias("text")), units)
    return found.select(F.col("owner").alias("node"), F.col("n").alias("n_shared"))


def node_sets(texts: DataFrame, k: int) -> DataFrame:
    """(node, items): whole sets in the order of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, at in W.chunks(batch.column("text")):
                got = [u for u in W.row_sets(data, at, k) if len(u)]
                nodes = pa.array([W.digest(u).view(np.int64) for u in got], pa.int64())
                yield pa.RecordBatch.from_arrays([nodes, W.ragged([u.view(np.int64) for u in got], pa.int64())], names=["node", "items"])

    return texts.select("text").mapInArrow(run, "node long, items array<long>")


def frequent_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles in order, and the logarithms of their counts; at most ``MOST_FREQUENT`` of them."""
    total = sets.agg(F.sum(F.size("items").cast("long"))).first()[0] or 0
    counts = sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("c"))
    rows = counts.where(F.col("c") > max(FREQUENT, total // MOST_FREQUENT)).toArrow()
    items, c = rows.column("item").to_numpy().view(np.uint64), rows.column("c").to_numpy()
    order = np.argsort(items)
    return items[order], np.log2(c[order]).astype(np.uint8)


def order_prefixes(sets: DataFrame, percent: int, frequent) -> DataFrame:
    """(node, n, first, second, third): the short prefixes under the three orders, the latter two as 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, level = frequent.value
        for batch in batches:
            column = batch.column("items")
            items, size = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.value_lengths().to_numpy(zero_copy_only=False)
            rank = np.zeros(len(items), np.uint8)
            if len(often):
                at = np.minimum(np.searchsorted(often, items), len(often) - 1)
                rank[often[at] == items] = level[at[often[at] == items]] + 1
            found: tuple[list, list, list] = ([], [], [])
            end = np.cumsum(size)
            for a, b in zip((end - size).tolist(), end.tolist()):
                u, r, p = items[a:b], rank[a:b], _spare(b - a, percent) + 1
                found[0].append(u[np.argsort(r, kind="stable")[:p]].view(np.int64))
                found[1].append(u[np.lexsort((u * MIXES[0], r))[:p]].astype(np.uint32).view(np.int32))
                found[2].append(u[np.argsort(u * MIXES[1])[:p]].astype(np.uint32).view(np.int32))
            lists = [W.ragged(f, kind) for f, kind in zip(found, (pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(size, pa.int32()), *lists], names=["node", "n", "first", "second", "third"])

    return sets.mapInArrow(run, "node long, n int, first array<long>, second array<int>, third array<int>")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id) for every row; component_id is the smallest doc_id reachable by links."""
    return jaccard_rows(docs, k, percent).select("doc_id", "n_shingles", "component_id", "set_id")


def jaccard_rows(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``jaccard_components`` with each row's text_hash and its group, a node, which is null for the empty set."""
    small_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession, "jaccard")
    sized = cut(node_sizes(docs, k), "sizes")
    rows = sized.select("doc_id", "text_hash", "node", F.col("n").alias("n_shingles"))
    nodes = sized.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.min("doc_id").alias("first_doc"), F.min("text_hash").alias("text_hash"))

    least = F.ceil(F.lit(percent) * F.col("n") / 100)
    least = least - F.ceil(F.lit(percent) * least / 100) + 1
    near = nodes.join(shared_nodes(docs, k, percent), "node").where(F.col("n_shared") >= least)
    near = work.cut(near.select("node", "text_hash"), "near-nodes")
    wanted = small_side(near.select(F.col("text_hash").alias("_text")))
    texts = _texts(docs)
    texts = texts.join(wanted, texts["text_hash"] == F.col("_text"), "left_semi")
    sets = work.cut(node_sets(texts, k).dropDuplicates(["node"]), "sets")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(sets))
    orders = work.cut(order_prefixes(sets, percent, frequent), "orders")
    tokens = orders.select("node", "n", F.posexplode("first").alias("pos", "key"))
    shared_keys = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    members = work.cut(tokens.join(shared_keys, "key"), "members")

    def fits(x: str, y: str) -> Column:
        n, m, p, q = (F.col(f"{s}{c}").cast("long") for s, c in ((x, "n"), (y, "n"), (x, "pos"), (y, "pos")))
        most = F.least(n - p, m - q)
        # At the first key that two nodes share, the intersection lies from here on.
        return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (most * (100 + percent) >= (n + m) * percent)

    def meets(pairs: DataFrame) -> DataFrame:
        """Pairs whose prefixes overlap under the second and third order as well."""
        side = lambda c: orders.select(F.col("node").alias(c), F.col("second").alias(f"{c}_2"), F.col("third").alias(f"{c}_3"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.where(F.arrays_overlap("a_2", "b_2") & F.arrays_overlap("a_3", "b_3")).select(pairs.columns)

    labels = link(work, members, sets, percent, fits, meets, orders.select("node", F.col("first").alias("keys")))
    classes = nodes.select("node", "first_doc").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = classes.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = cut(classes.join(lowest, "component").select("node", "component_id", "component"), "classes")
    work.close()
    return rows.join(named, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("node").alias("set_id"),
        "text_hash",
        F.col("component").alias("group"),
    )
