"""Order-dependent operators and readers against small references."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pressgauge.functions import headlines
from pressgauge.functions import text as T
from pressgauge.operators import dedup
from pressgauge.plans import operations, stories
from pressgauge.sources import feeds


def test_a_copy_is_no_root(spark):
    """A chain of near repetitions is measured from the accepted item, not from the copy before."""
    rows = [(1, "a", 0), (2, "a", 40), (3, "a", 80), (4, "a", 120), (5, "b", 10)]
    items = spark.createDataFrame(rows, "id long, k string, t long")
    got = {tuple(r) for r in dedup.accepted_chain(items, ["k"], "t", "id", 50).collect()}
    assert got == {(2, 1), (4, 3)}


def test_chains_do_not_depend_on_row_order(spark):
    rng = random.Random(1)
    rows = [(i, f"k{rng.randint(0, 5)}", rng.randint(0, 1000)) for i in range(300)]
    wanted = None
    for _ in range(2):
        rng.shuffle(rows)
        got = sorted(map(tuple, dedup.accepted_chain(spark.createDataFrame(rows, "id long, k string, t long"), ["k"], "t", "id", 60).collect()))
        assert wanted in (None, got)
        wanted = got
    best, expected = {}, []
    for i, k, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if k in best and t - best[k][1] <= 60:
            expected.append((i, best[k][0]))
        else:
            best[k] = (i, t)
    assert wanted == sorted(expected)


def test_headline_revisions():
    assert headlines.is_revision("the budget vote is delayed".split(), "the budget vote is delayed again".split())
    assert not headlines.is_revision("budget vote delayed again".split(), "budget vote delayed until monday".split())
    assert not headlines.is_revision("3 hurt in a fire".split(), "4 hurt in a fire".split())
    assert not headlines.is_revision("a b c d e".split(), "f g h i j".split())



def brute_copies(rows, window=48 * 3600):
    def grams(key):
        return {f"  {w} "[i : i + 3] for w in key.split() for i in range(len(w) + 1)}

    noise, roots = {"live", "video", "foto", "update"}, {}
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    for n, (i, source, at, key) in enumerate(rows):
        near = []
        for j, other, then, title in rows[:n]:
            x, y = grams(key), grams(title)
            if other != source and at - then <= window and len(key.split()) >= 4 and 10 * len(x & y) >= 8 * len(x | y):
                near.append((-len(x & y) / len(x | y), then, j, title))
        for _, _, j, title in sorted(near)[:5]:
            if all(w in noise or len(w) <= 2 for w in set(key.split()) ^ set(title.split())):
                roots[i] = roots.get(j, j)
                break
    return roots


def test_copies_in_other_outlets(spark):
    """Titles with noise words link to the root across outlets, in item order; brute force decides."""
    rng = random.Random(8)
    stems = ["ministers approve the national budget after long debate", "storm floods coastal village and closes many roads overnight", "fire in town hall"]
    rows = []
    for i in range(90):
        words = rng.choice(stems).split()
        words.insert(rng.randint(0, len(words)), rng.choice(["live", "video", "of", "tonight", ""]))
        rows.append((i, f"s{rng.randint(0, 2)}", rng.randint(0, 30) * 12 * 3600, " ".join(w for w in words if w)))
    got = dict(map(tuple, dedup.cross_outlet_copies(spark.createDataFrame(rows, "id long, source string, epoch long, key string")).collect()))
    assert got == brute_copies(rows) and len(got) > 20


def test_whole_titles_are_compared(spark):
    """Two titles that differ after their 80th letter only."""
    a = "same words at the start " * 5
    row = spark.createDataFrame([(a + "tail one", a + "tail two", a + "another end")], "a string, b string, c string").select(
        T.bounded_distance(F.col("a"), F.col("b"), 5), T.bounded_distance(F.col("a"), F.col("c"), 2), T.jaccard(T.trigrams(F.col("a")), T.trigrams(F.col("b"))) < 1
    ).first()
    assert tuple(row) == (3, 3, True)


def test_perspective_gap_rule(spark):
    rows = [(6, 0, 7), (1, 6, 8), (3, 3, 6), (2, 0, 2)]
    got = spark.createDataFrame(rows, "l int, r int, n int").select(stories.perspective_gap(F.col("l"), F.col("r"), F.col("n"))).collect()
    assert [r[0] for r in got] == ["right", "left", None, None]


def test_grades(spark):
    got = spark.createDataFrame([(0.05,), (0.2,), (0.5,)], "v double").select(operations.grade(F.col("v"), 0.1, 0.3)).collect()
    assert [r[0] for r in got] == ["pass", "warn", "fail"]


def test_foreign_links_are_found_by_their_hosts(spark):
    html = '<a href="/in">a</a><a href="https://www.example.com/x">b</a><a href="http://m.example.com">c</a><a class="k" href="//other.org/y">d</a>'
    pages = spark.createDataFrame([("https://www.example.com/p", html), ("http://third.net/", '<a href="https://example.com:80/">e</a>')], "url string, html string")
    assert tuple(operations.foreign_links(pages).first()) == (5, 2, 0.4, "warn")


def test_a_hot_key_is_dealt_out_by_gaps(spark):
    """Rows of one key are in different segments where a gap exceeds the window, and only there if they can link."""
    times = [0, 40, 95, 400, 450, 900]
    rows = {r.t: r._segment for r in dedup.segments(spark.createDataFrame([("a", t) for t in times], "k string, t long"), ["k"], "t", 50).collect()}
    assert len(rows) == 6 and len(set(rows.values())) == 3
    assert rows[0] == rows[40] == rows[95] and rows[400] == rows[450]


def test_text_functions(spark):
    row = spark.createDataFrame([("Çafé — DÉJÀ  vu!", "http://www.Example.com/a/b/amp/?utm_source=x&b=2&a=1#t")], "t string, u string").select(
        T.normalize_key(F.col("t")), T.canonical_url(F.col("u")), T.near_verbatim(F.lit("big fire in town"), F.lit("big fire town live")), T.jaccard(T.trigrams(F.lit("word")), T.trigrams(F.lit("word")))
    ).first()
    assert tuple(row) == ("cafe deja vu", "https://example.com/a/b?a=1&b=2", True, 1.0)


def test_feeds_survive_syntax_errors(spark, tmp_path):
    good = b"<rss><channel><item><title>A</title><link>http://e/a</link><guid>1</guid><category>x</category><description>&lt;img src='http://e/i.png'&gt;</description></item>"
    (tmp_path / "ok.xml").write_bytes(good + b"</channel></rss>")
    (tmp_path / "cut.xml").write_bytes(good + b"<item><title>B")
    (tmp_path / "atom.xml").write_bytes(b"<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>C</title><link href='http://e/c'/><id>c</id><updated>2024-01-01</updated></entry></feed>")
    rows = {(r.file.rpartition("/")[2], r.title): r for r in feeds.read_feeds(spark, str(tmp_path)).collect()}
    assert set(rows) == {("ok.xml", "A"), ("cut.xml", "A"), ("atom.xml", "C")}
    assert rows["ok.xml", "A"].image == "http://e/i.png" and rows["cut.xml", "A"].malformed and rows["atom.xml", "C"].link == "http://e/c"


def test_clean_text():
    from pressgauge.functions.clean import clean

    assert clean("<p>Caf\u00c3\u00a9 &amp; bar</p>\u200b<script>x<y</script>  e\u0301") == "Caf\u00e9 & bar \u00e9"
    assert clean(None) is None and clean("") == ""


def test_excerpt(spark):
    from pressgauge.functions.clean import excerpt

    got = spark.createDataFrame([("short",), ("word " * 100,), ("x" * 400,)], "t string").select(excerpt(F.col("t"), 50)).collect()
    assert [r[0] for r in got] == ["short", " ".join(["word"] * 10) + "\u2026", "x" * 50 + "\u2026"]
