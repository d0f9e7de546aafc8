"""Searches and archives against brute force, and what damage leaves of an archive."""

from __future__ import annotations

import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressgauge.llm import maxscore, prefix_forest, warc

VECTORS = "vec_id long, embedding array<float>, label int, score double, rank int, v array<double>"


def vectors(spark, n, seed=3, repeat=()):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 16)], 0, 0.0, 0, None) for i in range(n)]
    rows += [(n + i, rows[j][1], 0, 0.0, 0, None) for i, j in enumerate(repeat)]
    rows += [(900_000, None, 0, 0.0, 0, None), (900_050, [float("nan")] * 16, 0, 0.0, 0, None), (900_100, [None] * 16, 0, 0.0, 0, None), (None, rows[0][1], 0, 0.0, 0, None)]
    return spark.createDataFrame(rows, VECTORS)


def brute(df, step, k, change):
    ok = [(r.vec_id, change(np.array(r.embedding, float))) for r in df.collect() if r.vec_id is not None and r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding)]
    out = {}
    for q, x in ok:
        if q % step == 0:
            out[q] = sorted(((-float(x @ y), i) for i, y in ok if i != q))[:k]
    return out


def test_maxscore_equals_brute_force(spark):
    df = vectors(spark, 500, repeat=[7] * 40 + [50] * 3)
    got = maxscore.maxscore_top_k(df, 5, F.col("vec_id") % 50 == 0).collect()
    wanted = brute(df, 50, 5, lambda x: np.floor(256 * x))
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == Counter((q, i + 1, v, int(-s)) for q, best in wanted.items() for i, (s, v) in enumerate(best))


def test_maxscore_with_few_candidates(spark):
    assert maxscore.maxscore_top_k(vectors(spark, 3), 5, F.col("vec_id") % 50 == 0).count() == 2
    assert maxscore.maxscore_top_k(vectors(spark, 3).limit(0), 5, F.col("vec_id") % 50 == 0).count() == 0


def test_forest_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = prefix_forest.forest_top_k(df, 20, F.col("vec_id") % 20 == 0).collect()
    wanted = brute(df, 20, 20, lambda x: x)
    true = {(q, v): -s for q, best in wanted.items() for s, v in best}
    hits = [r for r in got if (r.query_id, r.vec_id) in true]
    assert len(hits) >= 0.9 * len(true) and len(got) == len(true)
    assert all(abs(r.score - true[r.query_id, r.vec_id]) < 1e-12 for r in hits)


def test_forest_on_copies_and_gaps(spark):
    df = vectors(spark, 60, repeat=[20] * 50)
    got = prefix_forest.forest_top_k(df, 20, F.col("vec_id") % 20 == 0).collect()
    best = [r for r in got if r.query_id == 20]
    assert [r.vec_id for r in sorted(best, key=lambda r: r.rank)] == list(range(60, 80))
    assert prefix_forest.forest_top_k(df.limit(0), 20, F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    rows = [(3, "http://e/3", "<p>same"), (1, "http://e/1", "<p>same"), (2, None, None), (4, "a\n b", ""), (None, "http://e/n", "<p>same"), (5, "é", "ü€"), (5, "é", "ü€")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, file string, at int")
    got = warc.round_trip(spark, pages, least).collect()
    wanted = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        same = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
        first = min(same) if len(body) >= least else page_id
        full = page_id == first
        wanted.append((page_id, len(body), warc.sha1_base32(body), "response" if full else "revisit", None if full else first))
    assert Counter(map(tuple, got)) == Counter(wanted)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def gz(data):
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def test_salvage_recovers_all_but_the_damaged():
    records = [warc.build_record(i, f"http://e/{i}", random.Random(i).randbytes(3000), None, "2024-01-01T00:00:00Z") for i in range(30)]
    members = [gz(r) for r in records]
    at = [sum(map(len, members[:i])) for i in range(31)]
    blob = bytearray(b"".join(members))
    blob[at[7] + 500] ^= 255
    blob[at[12]] = 0
    blob[at[20] + len(members[20]) - 6] ^= 1
    blob = bytes(blob[: at[25]]) + b"junk\x1f\x8b\x08junk" + bytes(blob[at[25] : -20])
    found = list(warc.salvage(io.BytesIO(blob)))
    assert [f["page_id"] for f in found if not f["damage"]] == [i for i in range(29) if i not in (7, 12, 20)]
    gaps = [(f["at"], f["size"]) for f in found if f["damage"]]
    assert gaps == [(at[7], len(members[7])), (at[12], len(members[12])), (at[20], len(members[20])), (at[25], 11), (at[29] + 11, len(members[29]) - 20)]
    assert sum(f["size"] for f in found) == len(blob)


def test_salvage_of_plain_and_empty_archives():
    records = [warc.build_record(i, None, b"x" * i, None, "2024-01-01T00:00:00Z") for i in range(6)]
    blob = b"".join(records[:3]) + b"torn" + b"".join(records[3:])
    found = list(warc.salvage(io.BytesIO(blob)))
    assert [f["page_id"] for f in found if not f["damage"]] == list(range(6))
    assert [(f["at"], f["size"]) for f in found if f["damage"]] == [(sum(map(len, records[:3])), 4)]
    assert list(warc.salvage(io.BytesIO(b""))) == []
    assert [f["damage"] is not None for f in warc.salvage(io.BytesIO(b"no archive at all"))] == [True]


def test_gap_log(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gz(warc.build_record(1, None, b"one", None, "2024-01-01T00:00:00Z")) + b"\0" * 50)
    files = spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "file string")
    rows = warc.read_archives(files)
    assert [r["size"] for r in warc.quarantined(rows).collect()] == [50]
    assert [bytes(r.payload) for r in rows.where("damage is null").collect()] == [b"one"]
