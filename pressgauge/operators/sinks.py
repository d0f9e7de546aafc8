"""Keyed writes as plans: upserts and insert-ignore against a stored state, and moving the links of a bridge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def newest(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, that with the largest ``order``; combined before the shuffle."""
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("_new")).select(*keys, "_new.*")


def upsert(state: DataFrame, batch: DataFrame, keys: list[str], order: str, content: list[str]) -> DataFrame:
    """The state after a batch, with ``action``: kept, inserted, changed (its content differs) or unchanged.

    Rows of the batch with one key count as the last of them. A changed row takes all columns of the batch; an unchanged
    one stays as it was stored. State and batch have the same columns.
    """
    last = newest(batch, keys, order).select(batch.columns).alias("b")
    state = state.select(batch.columns).alias("s")
    both = state.withColumn("_old", F.lit(True)).alias("s").join(last.withColumn("_new", F.lit(True)).alias("b"), keys, "full_outer")
    differs = F.lit(False)
    for c in content:
        differs = differs | ~F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}"))
    action = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").when(differs, "changed").otherwise("unchanged")
    fresh = action.isin("inserted", "changed")
    return both.select(*keys, *[F.when(fresh, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in batch.columns if c not in keys], action.alias("action"))


def insert_ignore(state: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of a batch that a unique key lets in: the first of each key that the state does not hold."""
    rest = [c for c in batch.columns if c not in keys]
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(order, *rest)).alias("_new")).select(*keys, "_new.*")
    held = state.select(*keys).distinct()
    return first.join(held, _same(first, held, keys), "left_anti").select(batch.columns)


def move_links(links: DataFrame, pairs: DataFrame, owner: str, target: str) -> DataFrame:
    """The bridge (owner, target) after every target of ``pairs`` (old, new) was replaced; links that meet become one."""
    moved = links.join(pairs, links[target] == pairs["old"], "left")
    return moved.select(owner, F.coalesce("new", target).alias(target)).distinct()


def orphans(items: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Items that no link names any more."""
    return items.join(links.select(key), key, "left_anti")
