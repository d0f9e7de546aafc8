"""Mixing sources to target weights, with DataFrame functions only.

Sizes are counts of words (runs other than ASCII white space). Sources in code point order, null last, weigh 1, 2, 3
and so on in turn and share all words in proportion. A target stops at ``most`` times its source's size and the excess
is shared again by weight until no target is above. The water level of that sharing is found in one pass: sources in
order of most * size / weight are full as long as the level that the others would get is not below their own.

Each document is emitted floor(rate) times, and once more with probability rate - floor(rate), decided by a hash of
its doc_id and a seed; rate is target / source size. A rerun takes the same copies.

Edge cases: a null text has size 0; a source without words gets target 0 and its documents are taken 0 words with no
copy; null sources form one source; a null doc_id hashes like an empty one; rows that repeat a doc_id share their draw;
other columns stay as they are in ``mixed`` and internal names start with ``_mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.llm.scratch import cut, small_side

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(_mix_source, source_size, target) from (_mix_source, source_size), a row per source."""
    # One row per source from here on: the windows below order source totals, never documents.
    rank = F.row_number().over(Window.orderBy(F.col("_mix_source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    by_name = sizes.withColumn("weight", weight)
    ratio = F.col("source_size") * float(most) / F.col("weight")
    in_order = Window.orderBy(F.col("ratio"), F.col("_mix_source").asc_nulls_last())
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.col("all_words") - F.col("full_before")) / F.col("weight_left")
    filled = (
        by_name.withColumn("ratio", ratio)
        .withColumn("all_words", F.sum("source_size").over(whole).cast("double"))
        .withColumn("full_before", F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)).cast("double"))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", level)
        .withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(whole)["level"])
    )
    shared = F.when(F.col("ratio") < F.col("level"), F.col("source_size") * float(most)).otherwise(F.least(F.col("weight") * F.col("level"), F.col("source_size") * float(most)))
    return filled.select("_mix_source", "source_size", F.coalesce(shared, F.lit(0.0)).alias("target"))


def mixed(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``docs`` with _mix_size, _mix_source_size, _mix_target and _mix_copies (how often the mix takes the row)."""
    sized = docs.withColumn("_mix_size", word_count(F.col("text").cast("string"))).withColumn("_mix_key", F.col("source").cast("string"))
    # One row per source, written once: its count decides whether it can be sent to the documents, whose texts then
    # need no shuffle.
    totals = cut(sized.groupBy(F.col("_mix_key").alias("_mix_source")).agg(F.sum("_mix_size").alias("source_size")), "sources")
    plan = targets(totals, weights, most).select("_mix_source", F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"))
    rate = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(draw(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return (
        sized.join(small_side(plan), F.col("_mix_key").eqNullSafe(F.col("_mix_source")))
        .withColumn("_mix_copies", F.least(copies, F.lit(most)).cast("int"))
        .drop("_mix_key", "_mix_source")
    )


def emit(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of ``docs``."""
    copies = F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))
    return mixed(docs, seed, weights, most).where("_mix_copies > 0").select(*[F.col(f"`{c}`") for c in docs.columns], copies.alias("_mix_copy")).drop("_mix_copy")


def digest(docs: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per document."""
    return mixed(docs, seed).select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"),
        F.col("_mix_copies").alias("copies"),
    )


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sized GROUP BY source
), steps AS (
  SELECT *, source_size * 3.0::DOUBLE / weight AS ratio,
         (sum(source_size) OVER ())::DOUBLE AS all_words,
         coalesce(sum(source_size * 3) OVER o, 0)::DOUBLE AS full_before,
         sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weight_left
  FROM totals
  WINDOW o AS (ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (
  SELECT (all_words - full_before) / weight_left AS level FROM steps
  WHERE ratio >= (all_words - full_before) / weight_left ORDER BY ratio, level LIMIT 1
), plan AS (
  SELECT source, source_size,
         CASE WHEN ratio < level THEN source_size * 3.0::DOUBLE ELSE least(weight * level, source_size * 3.0::DOUBLE) END AS target
  FROM steps, water
), rated AS (
  SELECT s.doc_id, s.size, p.source_size, p.target,
         CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('42:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       (size * least(floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END, 3))::BIGINT AS taken,
       least(floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END, 3)::INTEGER AS copies
FROM rated
"""
