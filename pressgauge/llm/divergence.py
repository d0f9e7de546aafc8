"""Audit of how the sources of a language diverge in their use of terms.

Terms are runs of ASCII letters and characters beyond ASCII, with A-Z folded. A language keeps the terms that at least
``least`` of its documents hold. Every (lang, source) group and every language gives each kept term the smoothed share
p = 1 + floor(10^9 * (count + 1) / (N + V)), and two shares diverge by floor((p - q)^2 / q).

Plan:

1. Tasks count terms per chunk of text with Arrow's exact dictionaries; Spark sums the counts per (lang, source, term)
   before and after a shuffle, so a frequent term or source is a row per task.
2. A kept term is one row: the array of its counts by the source's index in the language, zeros left out.
3. Higher-order functions turn each such vector into the contributions of its pairs of sources, which are summed map-side
   per (lang, source, source). Where a source lacks the term its share is a constant of the source; what such terms add
   follows from that constant and from how often each count occurs (a histogram), so a term emits pairs only of the
   sources that hold it.

All arithmetic is on integers: the share is divided out in three steps of 1,000, which stays within 64 bits for counts up
to 9 * 10^15, and an overflow is an error, never a wrong value.

Edge cases: null text, lang and source count as empty; groups without terms take part with counts of 0; a language without
kept terms has pairs of value 0 and no terms; one with a single source has no pairs; rows that repeat a doc_id are
documents of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.llm import words as W
from pressgauge.llm.scratch import cut, small_side

CHUNK = 8 << 20
_TERM = np.ones(256, bool)
_TERM[:128] = False
_TERM[65:91] = _TERM[97:123] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _group_codes(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """A code per row for its (lang, source), and both by code."""
    lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
    n = max(len(source.dictionary), 1)
    pair = lang.indices.to_numpy().astype(np.int64) * n + source.indices.to_numpy()
    found, code = np.unique(pair, return_inverse=True)
    return code, lang.dictionary.take(pa.array(found // n)), source.dictionary.take(pa.array(found % n))


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term, a row per group, term and chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, langs, sources = _group_codes(batch)
            for first, data, at in W.chunks(batch.column("text"), CHUNK):
                start, end, row = W.spans(data, at, ~_TERM)
                if not len(start):
                    continue
                body = np.ascontiguousarray(_FOLD[data[_TERM[data]]])
                edges = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
                terms = pa.Array.from_buffers(pa.large_utf8(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(body)]).dictionary_encode()
                width = len(terms.dictionary)
                held, often = np.unique(row * width + terms.indices.to_numpy(), return_counts=True)
                key, back = np.unique(group[first + held // width] * width + held % width, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.take(pa.array(key // width)),
                        sources.take(pa.array(key // width)),
                        terms.dictionary.take(pa.array(key % width)).cast(pa.utf8()),
                        pa.array(np.bincount(back, weights=often).astype(np.int64)),
                        pa.array(np.bincount(back).astype(np.int64)),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / total), digit by digit to the base of 1,000; total is at least count + 1."""
    out, rest = F.lit(0).cast("long"), count + 1
    for _ in range(3):
        out = out * 1000 + _div(rest * 1000, total)
        rest = rest * 1000 % total
    return out + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def diverge(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def wide_vectors(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, term, vector, n) of the kept terms, with vector array<struct<s, n>> by source index s; and per language

    (lang, sources, size, all, totals, kept, floors): its sources in order, N + V of each and of the language, V, and the
    shares of a count of 0.
    """
    slim = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    known = slim.select("lang", "source").distinct().groupBy("lang").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    known = cut(known, "sources")
    place = known.select("lang", F.posexplode("sources").alias("s", "source"))
    counted = count_terms(slim).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    entries = counted.join(small_side(place), ["lang", "source"])
    by_term = entries.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("s", "n"))).alias("vector"), F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vectors = cut(by_term.where(F.col("docs") >= least).select("lang", "term", "vector", "n"), "vectors")
    kept = vectors.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("words"))
    sums = vectors.select("lang", F.explode("vector").alias("e")).groupBy("lang", "e.s").agg(F.sum("e.n").alias("n"))
    whole = place.join(sums, ["lang", "s"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("s", F.coalesce("n", F.lit(0)).alias("n")))).alias("sums"))
    plan = known.join(whole, "lang").join(kept, "lang", "left")
    v = F.coalesce("kept", F.lit(0).cast("long"))
    # Without kept terms there are no shares; 1 stands in for a total that nothing is divided by.
    plan = plan.select("lang", "sources", v.alias("kept"), F.greatest(F.coalesce("words", F.lit(0)) + v, F.lit(1)).alias("all"), F.transform("sums", lambda x: F.greatest(x["n"] + v, F.lit(1))).alias("totals"))
    zero = F.lit(0).cast("long")
    return vectors, cut(plan.withColumn("floors", F.transform("totals", lambda t: F.when(F.col("kept") > 0, share(zero, t)).otherwise(1))), "languages")


def _at(array: str, index: Column) -> Column:
    return F.get(F.col(array), index)


def pair_values(vectors: DataFrame, plan: DataFrame) -> DataFrame:
    """(lang, i, j, value): the divergence of source i from source j, summed over all kept terms."""
    side = small_side(plan, size=8 * F.size("sources"))
    placed = vectors.join(side, "lang")
    others = lambda s: F.filter(F.sequence(F.lit(0), F.size("sources") - 1), lambda x: x != s)
    # Both sources lack the term, as if all terms were such.
    base = plan.select("lang", "kept", "floors", "sources", F.explode(F.sequence(F.lit(0), F.size("sources") - 1)).alias("i"))
    base = base.withColumn("j", F.explode(others(F.col("i"))))
    base = base.select("lang", "i", "j", (F.col("kept") * diverge(_at("floors", F.col("i")), _at("floors", F.col("j")))).alias("value"))
    # One of both holds it: every count of a source once, times the number of terms with that count.
    often = vectors.select("lang", F.explode("vector").alias("e")).groupBy("lang", "e.s", "e.n").agg(F.count(F.lit(1)).alias("terms"))
    one = often.join(side, "lang").withColumn("p", share(F.col("n"), _at("totals", F.col("s")))).withColumn("f", _at("floors", F.col("s")))

    def alone(x: Column) -> Column:
        q = _at("floors", x)
        there = F.struct(F.col("s").alias("i"), x.alias("j"), ((diverge(F.col("p"), q) - diverge(F.col("f"), q)) * F.col("terms")).alias("value"))
        back = F.struct(x.alias("i"), F.col("s").alias("j"), ((diverge(q, F.col("p")) - diverge(q, F.col("f"))) * F.col("terms")).alias("value"))
        return F.array(there, back)

    one = one.select("lang", F.explode(F.flatten(F.transform(others(F.col("s")), alone))).alias("c")).select("lang", "c.*")
    # Both hold it: what the two parts above have added too much or too little.
    shares = F.transform("vector", lambda e: F.struct(e["s"].alias("s"), share(e["n"], _at("totals", e["s"])).alias("p"), _at("floors", e["s"]).alias("f")))

    def together(a: Column, b: Column) -> Column:
        more = diverge(a["p"], b["p"]) - diverge(a["p"], b["f"]) - diverge(a["f"], b["p"]) + diverge(a["f"], b["f"])
        return F.struct(a["s"].alias("i"), b["s"].alias("j"), more.alias("value"))

    pairs = F.flatten(F.transform("shares", lambda a: F.transform(F.filter("shares", lambda b: b["s"] != a["s"]), lambda b: together(a, b))))
    both = placed.where(F.size("vector") > 1).select("lang", shares.alias("shares")).select("lang", F.explode(pairs).alias("c")).select("lang", "c.*")
    both = both.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    return base.unionByName(one).unionByName(both).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def term_values(vectors: DataFrame, plan: DataFrame) -> DataFrame:
    """(lang, source, term, value) of kept terms that a source uses more than its language does."""
    side = small_side(plan, size=8 * F.size("sources"))
    q = share(F.col("n"), F.col("all"))
    rows = vectors.join(side, "lang").select("lang", "term", q.alias("q"), "sources", "totals", F.explode("vector").alias("e"))
    rows = rows.withColumn("p", share(F.col("e.n"), _at("totals", F.col("e.s")))).where("p > q")
    return rows.select("lang", _at("sources", F.col("e.s")).alias("source"), "term", diverge(F.col("p"), F.col("q")).alias("value"))


def divergence(docs: DataFrame, least: int = 3, most_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of a source with all others, and its ``most_terms`` leading terms."""
    vectors, plan = wide_vectors(docs, least)
    named = pair_values(vectors, plan).join(small_side(plan.select("lang", "sources"), size=8 * F.size("sources")), "lang")
    pairs = named.select("lang", _at("sources", F.col("i")).alias("source"), F.lit("pair").alias("part"), _at("sources", F.col("j")).alias("item"), "value")
    terms = term_values(vectors, plan).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= most_terms))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS count,
         (1 + 1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT // (s.n + l.v)::HUGEINT)::BIGINT AS p,
         (1 + 1000000000 * (k.n + 1)::HUGEINT // (l.n + l.v)::HUGEINT)::BIGINT AS q
  FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) x ON x.lang = a.lang AND x.source = a.source AND x.other = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE count > 0 AND p > q
), both_parts AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
WHERE part = 'pair' OR rank <= 200
"""
