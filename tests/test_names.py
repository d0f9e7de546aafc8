"""Case forms of names, and names and numbers held against texts."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from pressgauge.operators import entities, grounding

FORMS = [
    ("kosova", "kosoves", "location", True), ("kosova", "kosoven", "location", True), ("kosovo", "kosova", "location", True), ("serbia", "serbise", "location", True), ("shqiperia", "shqiperine", "location", True),
    ("hashim thaci", "hashim thacit", "person", True), ("edi rama", "edi rames", "person", True), ("donald trump", "donald trumpit", "person", True),
    ("albin kurti", "arben kurti", "person", False), ("kosova", "kosovare", "location", False), ("iran", "irak", "location", False), ("kosova", "kosovo", "person", False),
    ("policia", "policise", "organization", False), ("rama", "rame", "person", False), ("berat", "berane", "location", False), ("serbia", "serbian", "location", False),
]


def longest_stem_rule(a, b, kind):
    """The rule by the longest common stem of both last words."""
    if a == b:
        return True
    (head, x), (other, y) = (k.rpartition(" ")[::2] for k in (a, b))
    n = next((i for i, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
    if kind not in ("person", "location") or head != other or n < (3 if head else 4):
        return False
    endings = {*entities.ENDINGS, *("o" if kind == "location" else "")}
    fits = lambda e: e in endings and (e not in ("ne", "se") or x[n - 1] == "i") and (e != "n" or x[n - 1] != "a")
    return fits(x[n:]) and fits(y[n:])


def test_case_forms_share_a_key_exactly_by_the_longest_stem(spark):
    rng = random.Random(8)
    made = {"".join(rng.choice(("", "ana ", "ana e ")) + rng.choice(("kos", "kosi", "kosa", "rami", "ramas")) + rng.choice(("", "v", "t")) + rng.choice((*entities.ENDINGS, "o", "ine", "er"))) for _ in range(250)}
    pairs = [(a, b, k, longest_stem_rule(a, b, k)) for a in sorted(made) for b in sorted(made)[::7] for k in ("person", "location")] + FORMS
    df = spark.createDataFrame(pairs, "a string, b string, kind string, same boolean")
    meets = F.arrays_overlap(entities.form_keys(F.col("a"), F.col("kind")), entities.form_keys(F.col("b"), F.col("kind")))
    assert df.where(meets != F.col("same")).limit(5).collect() == [] and sum(p[3] for p in pairs) > 200


def test_forms_merge_to_the_most_mentioned_under_a_good_name(spark):
    rows = [
        (15, "location", "kosoves", "Kosovës", 2474), (18, "location", "kosova", "Kosova", 2316), (114, "location", "kosove", "Kosovë", 1313), (32, "location", "kosoven", "Kosovën", 525),
        (40, "person", "hashim thaci", "Hashim Thaçi", 217), (41, "person", "hashim thacit", "Hashim Thaçit", 900), (50, "organization", "policia", "Policia", 5), (51, "organization", "policise", "Policisë", 4),
        (60, "location", "vitomirice te peja", "Vitomiricë të Peja", 1), (61, "location", "vitomirice te pejes", "Vitomiricë të Pejës", 9), (70, "person", "kosova", "Kosova", 1),
    ]
    got = {r.id: (r.keep_id, r.name, r.group_mentions) for r in entities.merge_forms(spark.createDataFrame(rows, "id long, type string, key string, name string, mentions long")).collect()}
    assert {got[i] for i in (15, 18, 114, 32)} == {(15, "Kosova", 6628)}
    assert got[40] == got[41] == (41, "Hashim Thaçi", 1117) and got[50] == (50, "Policia", 5) and got[51] == (51, "Policisë", 4)
    # After a joining word the form used most is shown.
    assert got[60] == got[61] == (61, "Vitomiricë të Pejës", 10) and got[70] == (70, "Kosova", 1)


def test_name_forms_need_no_bucket_in_memory(spark):
    names = spark.createDataFrame([(1, "location", "prishtina", "Prishtina", 5), (2, "location", "prishtines", "Prishtinës", 9)], "id long, type string, key string, name string, mentions long")
    assert "FlatMapGroupsInPandas" not in entities.merge_forms(names)._jdf.queryExecution().toString()


def test_a_stored_form_is_found_the_same_name_first(spark):
    stored = spark.createDataFrame([(3, "location", "kosoves"), (9, "location", "kosova"), (1, "person", "kosova"), (5, "location", "kosoven")], "id long, type string, key string")
    wanted = spark.createDataFrame([("location", "kosova"), ("location", "kosove"), ("location", "peja"), ("organization", "kosova"), ("location", "")], "type string, key string")
    assert {(r.type, r.key, r.id) for r in entities.stored_forms(wanted, stored).collect()} == {("location", "kosova", 9), ("location", "kosove", 3), ("location", "peja", None), ("organization", "kosova", None)}
    assert entities.stored_forms(wanted.limit(0), stored).count() == 0


def plain_grounded(name, kind, text):
    tokens = lambda x: re.findall("[0-9a-z]+", x.lower())
    held, long = set(tokens(text)), {t for t in tokens(name) if len(t) >= 3}

    def meets(t):
        if t in held or (len(t) >= 5 and any(len(h) >= 5 and h[:5] == t[:5] for h in held)):
            return True
        for h in held:
            n = next((i for i, (c, d) in enumerate(zip(t, h)) if c != d), min(len(t), len(h)))
            if n >= 3 and t[n:] in grounding.ENDINGS and h[n:] in grounding.ENDINGS:
                return True
        return False

    if not long:
        return bool(tokens(name)) and all(t in held for t in tokens(name))
    hits = sum(map(meets, long))
    return hits == len(long) if kind == "person" else 2 * hits >= len(long)


def test_grounding_equals_the_rule(spark):
    rng = random.Random(4)
    stems = ["kin", "kina", "hag", "zvic", "bel", "prisht", "mini", "ab"]
    word = lambda: rng.choice(stems) + rng.choice((*grounding.ENDINGS, "x", "ox"))
    texts = {i: " ".join(word() for _ in range(rng.randint(0, 6))) for i in range(120)}
    names = sorted({(i, " ".join(word() for _ in range(rng.randint(1, 3))).title(), rng.choice(["person", "location", None])) for i in texts for _ in range(4)}, key=str)
    names += [(1, "BE", "organization"), (2, "--", "person"), (None, "Kina", "person"), (3, None, "person"), (999, "Kina", "location")]
    got = grounding.grounded(spark.createDataFrame(names, "doc_id long, name string, type string"), spark.createDataFrame([*texts.items(), (500, None)], "doc_id long, text string"))
    got = {(r.doc_id, r.name, r.type): r.grounded for r in got.collect()}
    assert got == {(i, n, t): plain_grounded(n, t, texts.get(i, "")) for i, n, t in names if n is not None}
    assert 50 < sum(got.values()) < len(got) - 100


def rows_of(plan, node):
    """Rows that the nodes of a name put out."""
    own = plan.metrics().apply("numOutputRows").value() if plan.nodeName() == node else 0
    return own + sum(rows_of(plan.children().apply(i), node) for i in range(plan.children().size()))


def test_words_that_no_name_asks_for_make_no_rows(spark):
    """A thousand words that are not asked for, beside a name each and beside more names than are looked up by their first letters."""
    letters = "bcdfghjklmnpqrstvwxz"
    names = [f"{a}{b}{c}{a}" for a in letters[:5] for b in "aeiou" for c in letters[:5]]
    texts = {i: " ".join(f"{i}word{k:04d}" for k in range(1000)) for i in range(4)}
    texts |= {5: texts[1] + " ostani", 6: " ".join([texts[2], *names[::2]])}
    asked = [(i, "Osman", "person") for i in texts] + [(6, n.title(), "location") for n in names]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = grounding.grounded(spark.createDataFrame(asked, "doc_id long, name string, type string"), spark.createDataFrame([*texts.items()], "doc_id long, text string"))
        got = {(r.doc_id, r.name): r.grounded for r in df.collect()}
        rows = rows_of(df._jdf.queryExecution().executedPlan(), "Generate")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 0 < rows < 1500
    assert got == {(i, n): plain_grounded(n, t, texts[i]) for i, n, t in asked} and sum(got.values()) == 63
    assert len(names) > grounding.STARTS


@pytest.mark.parametrize("summary,missing", [
    ("Ministrja Osmani takoi 12 deputetë. Qeveria foli.", {"Osmani"}), ("Kurti dhe Osmanit folën për 12,5 milionë.", {"12,5", "Osmanit"}), ("Prishtinës i duhen 12.", set()),
    ("Foli “Berisha” dhe pastaj Berisha në Prishtinën.", {"Berisha"}), (None, set()), ("", set()), ("Në BE dhe UN 1.5.", {"1.5."}),
])
def test_words_of_a_summary_that_its_text_lacks(spark, summary, missing):
    texts = spark.createDataFrame([(1, "Kurti u takua në Prishtina me 12 deputetë, qeveria miratoi 12.5 pika.")], "doc_id long, text string")
    got = grounding.ungrounded_words(spark.createDataFrame([(1, summary)], "doc_id long, summary string"), texts).collect()
    assert {r.word for r in got} == missing


def test_items_leave_with_their_analysis_or_when_none_can_come(spark, tmp_path):
    """Three micro-batches: analyses in time, too late, missing, and items that still wait."""
    from pressgauge.streaming.micro_batch import await_analyses, run_to_table

    at = lambda h, m=0: f"2024-01-0{1 + h // 24} {h % 24:02d}:{m:02d}:00"
    batches = [
        ([(1, at(0)), (2, at(1)), (3, at(2))], [(1, at(5, 59))]),
        ([(4, at(9))], [(2, at(7, 1)), (4, at(9))]),
        ([(5, at(20)), (6, at(23))], [(5, at(20, 30)), (9, at(22))]),
    ]
    for n, (items, analyses) in enumerate(batches):
        spark.createDataFrame(items, "id long, at string").select("id", F.to_timestamp("at").alias("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/items/{n}")
        spark.createDataFrame(analyses, "item long, done string").select("item", F.to_timestamp("done").alias("done")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/analyses/{n}")
    source = lambda name, kind: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}")
    told = run_to_table(await_analyses(source("items", "id long, at timestamp"), source("analyses", "item long, done timestamp"), lateness="1 hour"), spark, "append")
    got = {r.id: r.done and r.done.strftime("%H:%M") for r in told.collect()}
    # 2 was analysed a minute too late and 3 never; 6 still waits.
    assert got == {1: "05:59", 2: None, 3: None, 4: "09:00", 5: "20:30"}
