"""Every query against the checking engine on the same files, and invariants of those that SQL cannot express."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from pressgauge.plans import registry
from pressgauge.plans.bindings import Range

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(df):
    df = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    plain = lambda v: round(float(v), 5) if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool) else v
    return sorted(tuple(map(str, (plain(v) for v in r))) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, spark, engine):
    got = registry.queries()[name](spark, SF).toPandas()
    wanted = engine.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert len(got) == len(wanted)
    assert normal(got) == normal(wanted)


def test_every_query_has_a_plan_without_cross_products(spark):
    for name in ("q8_top_entities", "q10_co_occurrence", "q14_sources_compare", "q20_related_stories"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan


def test_previous_range_has_equal_length():
    from datetime import date

    r = Range(date(2024, 1, 8), date(2024, 1, 14))
    assert (r.previous().start, r.previous().end) == (date(2024, 1, 1), date(2024, 1, 7))


def test_filters_reach_the_scan(spark):
    plan = registry.queries()["q2_volume"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan
