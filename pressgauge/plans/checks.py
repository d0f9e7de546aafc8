"""The check run: every quality check over its own table, graded, isolated from the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.plans import names, operations

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def _within(sql: str) -> str:
    return f"({sql})"


@query(
    "dq10_ungrounded_names",
    f"""SELECT count(*) AS names, count(*) FILTER (WHERE NOT grounded) AS ungrounded, round(count(*) FILTER (WHERE NOT grounded)::DOUBLE / nullif(count(*), 0), 6) AS observed,
    CASE WHEN count(*) FILTER (WHERE NOT grounded)::DOUBLE / nullif(count(*), 0) > 0.15 THEN 'warn' ELSE 'pass' END AS status FROM {_within(names.ORACLE["n26_grounded_names"])}""",
)
def ungrounded_names(spark: SparkSession, sf_dir: str, warn: float = 0.15) -> DataFrame:
    """Share of the names in titles that the text below does not hold."""
    n = names.grounded_names(spark, sf_dir).agg(F.count(F.lit(1)).alias("names"), F.count_if(~F.col("grounded")).alias("ungrounded"))
    rate = F.col("ungrounded") / F.nullif(F.col("names"), F.lit(0))
    return n.select("names", "ungrounded", F.round(rate, 6).alias("observed"), operations.grade(rate, warn, None).alias("status"))


_STALE = "SELECT CASE WHEN count(*) FILTER (WHERE NOT stale) = 0 THEN 'fail' WHEN count(*) FILTER (WHERE stale) > 0 THEN 'warn' ELSE 'pass' END AS status, count(*) FILTER (WHERE stale) AS observed FROM"


@query("dq11_stale_outlets", f"{_STALE} {_within(operations.ORACLE['dq11_source_freshness'])}")
def stale_outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlets without a recent article: a warning if there are any, a failure if all are."""
    n = operations.source_freshness(spark, sf_dir).agg(F.count_if(~F.col("stale")).alias("fresh"), F.count_if("stale").alias("observed"))
    return n.select(F.when(F.col("fresh") == 0, "fail").when(F.col("observed") > 0, "warn").otherwise("pass").alias("status"), "observed")


@query(
    "x3_busy_short_feeds",
    f"""WITH f AS {_within(operations.ORACLE["dq12_feed_overflow"])}, {operations._FETCHES}, longest AS (SELECT source_id, max(items_seen) AS longest FROM fetches WHERE ok GROUP BY 1)
    SELECT source_id, full_fetches, longest FROM (SELECT source_id, count(*) AS full_fetches FROM f GROUP BY 1) JOIN longest USING (source_id) WHERE longest < 40 AND full_fetches > 10""",
)
def busy_short_feeds(spark: SparkSession, sf_dir: str, shortest: int = 40, most: int = 10) -> DataFrame:
    """Outlets with a short feed that came full of new items more than ten times."""
    full = operations.feed_overflow(spark, sf_dir).groupBy("source_id").agg(F.count(F.lit(1)).alias("full_fetches"))
    longest = operations.fetches(spark, sf_dir).where("ok").groupBy("source_id").agg(F.max("items_seen").alias("longest"))
    return full.join(longest, "source_id").where((F.col("longest") < shortest) & (F.col("full_fetches") > most))


def run_checks(spark: SparkSession, checks: dict, *args) -> DataFrame:
    """(check, status, detail) of every check; one that raises is a failed row and stops none of the others.

    A check is a function of the session and ``args`` that returns (status, detail); each runs its own aggregation and
    gives one row, so what comes to the driver is a row per check.
    """
    rows = []
    for name, check in checks.items():
        try:
            status, detail = check(spark, *args)
        except Exception as error:
            status, detail = "fail", f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"
        rows.append((name, status, detail))
    return spark.createDataFrame(rows, "check string, status string, detail string")


#: Checks of one row with a status, and the column told as their detail.
ONE_ROW = {
    "foreign_domains": (operations.foreign_domains, "dq14_foreign_domains", "foreign_links"),
    "stale_outlets": (stale_outlets, "dq11_stale_outlets", "observed"),
    "ungrounded_names": (ungrounded_names, "dq10_ungrounded_names", "ungrounded"),
    "volume_anomaly": (operations.volume_anomaly, "dq13_volume_anomaly", "today"),
}


def _graded(check, detail: str):
    def run(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
        row = check(spark, sf_dir).first()
        return row["status"], str(row[detail])

    return run


def _rows_sql() -> str:
    one = [f"SELECT '{n}' AS \"check\", status, CAST({d} AS VARCHAR) AS detail FROM {_within({**operations.ORACLE, **ORACLE}[sql])}" for n, (_, sql, d) in ONE_ROW.items()]
    counted = f"SELECT check_name, status, '' FROM {_within(operations._check_sql(operations._BOUND))}"
    return " UNION ALL ".join([*one, counted])


@query("dq17_isolated_checks", _rows_sql())
def check_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of real columns in one run: those from one scan of the last day, and those over tables of their own."""
    single = run_checks(spark, {n: _graded(f, d) for n, (f, _, d) in ONE_ROW.items()}, sf_dir)
    last_day = operations.quality_checks(spark, sf_dir, checks=operations._BOUND).select(F.col("check_name").alias("check"), "status", F.lit("").alias("detail"))
    return single.unionByName(last_day)
