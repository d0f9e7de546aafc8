"""Headline rules, validation and keyed writes on small cases."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pressgauge.functions import checks, headlines
from pressgauge.functions import text as T
from pressgauge.operators import sinks
from pressgauge.plans import updates

EDITED = [
    ("ministri hap nje hetim te ri per naften", "ministri hap nje hetim te ri per nafte"),
    ("kuvendi miraton projektlijgin per energjine", "kuvendi miraton projektligjin per energjine"),
    ("video kuvendi miraton ligjin per energjine", "kuvendi miraton ligjin per energjine"),
    ("kreu i bashkise viziton shkollen e re", "kreu i bashkise viziton sot shkollen e re".replace(" sot", " serish")),
    ("shoqatanderkombetare kerkon masa te reja", "shoqata nderkombetare kerkon masa te reja"),
    ("kreu i bashkise viziton shkollen e re", "kreu te bashkise viziton shkollen e re"),
]
OTHER = [
    ("tre te plagosur ne aksident ne qytet", "dy te plagosur ne aksident ne qytet"),
    ("aksident ne qytet 3 te plagosur sonte", "aksident ne qytet 5 te plagosur sonte"),
    ("live numerohen votat ne te gjitha qendrat", "live numerohen votat ne disa qendrat"),
    ("kryetari do te marre pjese ne takim", "kryetari nuk do te marre pjese ne takim"),
    ("zjarr i madh ne prizren digjen shtepi", "zjarr i madh ne gjakove digjen shtepi"),
    ("dosja e privatizimit te madh pjesa ii", "dosja e privatizimit te madh pjesa iii"),
    ("moti per neser", "moti per sot"),
    ("kryetari takon ambasadorin ne zyre", "kryetari takon ambasadorin e ri gjerman ne zyre"),
]


@pytest.mark.parametrize("a,b", EDITED)
def test_edited_headlines(a, b):
    assert headlines.is_revision(a.split(), b.split()) and headlines.is_revision(b.split(), a.split())


@pytest.mark.parametrize("a,b", OTHER)
def test_other_headlines(a, b):
    assert not headlines.is_revision(a.split(), b.split()) and not headlines.is_revision(b.split(), a.split())


def distance(a, b):
    """Edit distance by its definition."""
    if not a or not b:
        return len(a) + len(b)
    return min(distance(a[1:], b) + 1, distance(a, b[1:]) + 1, distance(a[1:], b[1:]) + (a[0] != b[0]))


def test_letters_apart_equals_the_definition():
    rng = random.Random(6)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(24)]
    assert all(headlines.letters_apart(a, b) == distance(a, b) for a, b in combinations(words, 2))


def test_alignment_costs():
    cost = lambda a, b: headlines.alignment_cost(a.split(), b.split())
    assert cost("kuvendi miraton ligjin", "kuvendi miraton ligjin") == 0
    assert cost("video kuvendi miraton", "kuvendi miraton") == 0
    assert cost("kuvendi miraton ligjin", "kuvendi miraton ligji") == headlines.CHANGED
    assert cost("kuvendi miraton", "kuvendi me miraton") == headlines.PARTICLE
    assert cost("kuvendi miraton", "kuvendi serish miraton") == headlines.WORD
    assert cost("shoqata nderkombetare", "shoqatanderkombetare") == headlines.SPLIT
    assert cost("kuvendi miraton 3 ligje", "kuvendi miraton 4 ligje") >= headlines.NEVER
    assert cost("nje dy", "krejt tjeter") >= headlines.NEVER


def test_stems_drop_the_first_ending_that_leaves_three_letters(spark):
    words = {"kurti": "kurt", "kurtin": "kurt", "prizrenit": "prizr", "ramas": "rama", "presidenti": "presid", "vite": "vit", "as": "as", "covid19": "covid19"}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in rows} == words


def test_upsert_and_insert_ignore(spark):
    kind = "k string, v int, t int"
    state = spark.createDataFrame([("a", 1, 0), ("b", 2, 0), ("c", 3, 0), (None, 4, 0)], kind)
    batch = spark.createDataFrame([("a", 1, 1), ("b", 7, 1), ("b", 9, 2), ("d", 5, 1), ("d", 5, 1)], kind)
    got = {(r.k, r.v, r.action) for r in sinks.upsert(state, batch, ["k"], "t", ["v"]).collect()}
    assert got == {("a", 1, "unchanged"), ("b", 9, "changed"), ("c", 3, "kept"), (None, 4, "kept"), ("d", 5, "inserted")}
    assert [tuple(r) for r in sinks.insert_ignore(state, batch, ["k"], "t").collect()] == [("d", 5, 1)]
    links = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y")], "o int, e string")
    assert {tuple(r) for r in sinks.move_links(links, spark.createDataFrame([("y", "x")], "old string, new string"), "o", "e").collect()} == {(1, "x"), (2, "x")}
    assert [r.e for r in sinks.orphans(spark.createDataFrame([("x",), ("z",)], "e string"), links, "e").collect()] == ["z"]


def test_addresses_and_times(spark):
    urls = {
        "https://a.example/x": None, "http://a.example:8080": None, "ftp://a.example": "unsupported_scheme", "javascript:alert(1)": "unsupported_scheme",
        "http://u:p@a.example/": "credentials", "https:///x": "missing_host", "http://localhost:80/": "local_host", "http://x.local": "local_host",
        "http://10.1.2.3/": "private_address", "http://172.20.0.1": "private_address", "http://172.40.0.1": None, "http://[::1]/": "private_address", "": "unsupported_scheme",
    }
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", checks.url_issue(F.col("u")).alias("i")).collect()
    assert {r.u: r.i for r in rows} == urls
    times = {"Mon, 01 Jan 2024 00:00:07 GMT": 1704067207, "2024-01-01T02:00:07+02:00": 1704067207, "2024-01-01T00:00:07Z": 1704067207, "2024-01-01": 1704067200, "soon": None, "": None}
    rows = spark.createDataFrame([(t,) for t in times], "t string").select("t", F.unix_timestamp(checks.feed_time(F.col("t"))).alias("e")).collect()
    assert {r.t: r.e for r in rows} == times


def test_unknown_orders_are_refused(spark):
    with pytest.raises(ValueError):
        updates.sorted_page(spark, "/root/testdata/sf0.001", sort="id; DROP")
