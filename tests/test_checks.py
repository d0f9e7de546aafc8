"""Isolation of checks, stems of classes, and feed documents of every kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgauge.functions import text as T
from pressgauge.plans import checks, operations, texts
from pressgauge.sources import feeds


def test_a_check_that_raises_stops_no_other(spark):
    def broken(_):
        raise ValueError("broken")

    got = checks.run_checks(spark, {"one": lambda _: ("pass", "1"), "crash": broken, "two": lambda _: ("warn", "2")}).collect()
    assert [tuple(r) for r in got] == [("one", "pass", "1"), ("crash", "fail", "ValueError: broken"), ("two", "warn", "2")]


def test_classes_by_stems_whole_words_and_order(spark):
    classes = {"votes": ("elect", "vote$"), "fires": ("fire", "blaze$"), "weather": ("storm",)}
    texts = {1: "elections vote votes", 2: "fire blazed storm", 3: "storm elect", 4: "nothing here", 5: "fires blaze election elected voted", 6: None, 7: "bonfire"}
    df = spark.createDataFrame(list(texts.items()), "id long, key string")
    got = {r["id"]: (r["class"], r["tone"]) for r in T.classified(df, "id", "key", classes, ("good",), ("storm", "fire")).collect()}
    # Ties go to the class that stands first.
    assert got == {1: ("votes", 0.0), 2: ("fires", -0.6), 3: ("votes", -0.3), 4: (None, 0.0), 5: ("votes", -0.3), 6: (None, 0.0), 7: (None, 0.0)}


def test_feed_documents_of_every_kind_keep_marks(spark):
    html = '<html><title>A &amp; B "quoted" ]]> \x01</title><img alt="" src="http://e/i?a=1&b=2"></html>'
    pages = spark.createDataFrame([(i, f"http://e/{i}?x=1&y=2", html) for i in range(3)] + [(3, None, None)], "page_id long, url string, html string")
    rows = {r.file: r for r in feeds.parse_bodies(feeds.feed_documents(pages)).collect()}
    assert set(rows) == {"0", "1", "2", "3"} and not any(r.malformed for r in rows.values())
    assert {rows[k].title for k in "012"} == {'A &amp; B "quoted" ]]>'} and {rows[k].link for k in "012"} == {f"http://e/{k}?x=1&y=2" for k in "012"}
    assert rows["0"].image == "http://e/i?a=1&b=2" and rows["0"].tags == ["a", "b"] and rows["3"].title is None and rows["3"].link is None
    empty = feeds.parse_bodies(spark.createDataFrame([("p", None)], "path string, content binary"))
    assert empty.select(F.count("*")).first()[0] == 0


def test_checks_of_the_last_day_are_all_there(spark):
    got = {r["check_name"]: r["status"] for r in operations.quality_checks(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == 10 and {"rule_based_share", "story_backlog", "ungrounded_entities", "low_confidence", "foreign_domains"} < set(got)


def test_the_summary_tells_of_all_checks(spark):
    row = operations.quality_summary(spark, "/root/testdata/sf0.01").first()
    assert row["passed"] + sum(len(row[c].split(",")) for c in ("warnings", "failures") if row[c]) == 10


def test_validation_has_all_its_rules(spark):
    got = {r["reason"] for r in texts.validation(spark, "/root/testdata/sf0.01").select("reason").distinct().collect()}
    assert "missing_url" in got
