"""Micro-batches of arriving articles: late items, deduplication by key, and daily counts kept up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.session import read_table, shared_dir

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return keep


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream of files with event time in ``at``."""
    schema = read_table(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 4)
    # The source takes folders: the table's own where it is one, else its parent narrowed to the file.
    single = read_table(spark, sf_dir, "events").select(F.col("_metadata.file_path").alias("f")).limit(1).first()
    if single is not None and single.f.rstrip("/").endswith("/events.parquet"):
        files = files.option("pathGlobFilter", "events.parquet")
        stream = files.parquet(sf_dir)
    else:
        stream = files.parquet(f"{sf_dir}/events.parquet")
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """Drain a stream into a table below the shared folder; each batch replaces or extends it by its number."""
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        # A batch that runs again after a failure writes the same files again.
        target = f"{base}/table" if mode == "complete" else f"{base}/table/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    started = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).foreachBatch(write).start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


@query("t6_stream_daily_counts", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS topic, count(*) AS articles, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per UTC day and topic, as a tumbling window kept complete after every batch."""
    counts = event_stream(spark, sf_dir).groupBy(F.window("at", "1 day").alias("w"), F.col("event_type").alias("topic")).agg(F.count(F.lit(1)).alias("articles"), F.sum("value").alias("total"))
    table = run_to_table(counts.select(F.to_date("w.start").alias("day"), "topic", "articles", "total"), spark, "complete")
    return table.select(F.col("day").cast("string").alias("day"), "topic", "articles", F.round("total", 4).alias("total"))


@query("t5_stream_dedup", "SELECT event_type AS topic, count(DISTINCT CAST(user_id AS VARCHAR) || '/' || CAST(event_id % 500 AS VARCHAR)) AS items FROM events GROUP BY 1")
def deduplicated(spark: SparkSession, sf_dir: str, lateness: str = "60 days") -> DataFrame:
    """Items left per topic when an outlet's repeated keys within the watermark are dropped."""
    keyed = event_stream(spark, sf_dir).withColumn("item_key", F.col("event_id") % 500).withWatermark("at", lateness)
    once = keyed.dropDuplicatesWithinWatermark(["event_type", "user_id", "item_key"]).select("event_type", "user_id", "item_key")
    return run_to_table(once, spark, "append").groupBy(F.col("event_type").alias("topic")).agg(F.count(F.lit(1)).alias("items"))


@query("t3_late_items", "SELECT count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-17 00:00:00') AS too_old, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-17 00:00:00') AS accepted FROM events")
def late_items(spark: SparkSession, sf_dir: str, as_of: str = "2024-01-31 00:00:00", days: int = 14) -> DataFrame:
    """Items rejected for their age, counted rather than dropped without a trace."""
    edge = F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS")
    judged = event_stream(spark, sf_dir).select((F.col("at") < edge).alias("old"))
    return run_to_table(judged, spark, "append").agg(F.count_if("old").alias("too_old"), F.count_if(~F.col("old")).alias("accepted"))


def await_analyses(items: DataFrame, analyses: DataFrame, wait_minutes: int = 360, lateness: str = "2 days") -> DataFrame:
    """(id, at, done) of the stream ``items`` (id, at) as soon as each may be clustered.

    An item leaves with the time of its analysis (``analyses``: item, done) when that comes within the wait, and with null
    once the watermark says that none can come any more. Rows later than ``lateness`` are dropped by the watermark; the
    state holds the items of the wait and the lateness only.
    """
    left = items.select("id", "at").withWatermark("at", lateness)
    right = analyses.select(F.col("item"), F.col("done")).withWatermark("done", lateness)
    in_time = (F.col("id") == F.col("item")) & (F.col("done") >= F.col("at")) & (F.col("done") <= F.col("at") + F.expr(f"INTERVAL {wait_minutes} MINUTES"))
    return left.join(right, in_time, "left_outer").select("id", "at", "done")


@query(
    "t8_awaited_analyses",
    """WITH i AS (SELECT event_id AS id, event_type AS topic, ts AS came FROM events), a AS (SELECT event_id AS item, ts + to_minutes(event_id % 600) AS done FROM events WHERE event_id % 10 <> 0),
    w AS (SELECT least((SELECT max(came) FROM i), (SELECT max(done) FROM a)) - INTERVAL 2 DAY - INTERVAL 360 MINUTE AS edge)
    SELECT topic, count(*) FILTER (WHERE done <= came + INTERVAL 360 MINUTE) AS analysed, count(*) FILTER (WHERE (done IS NULL OR done > came + INTERVAL 360 MINUTE) AND date_trunc('millisecond', came) <= edge) AS given_up
    FROM i LEFT JOIN a ON id = item, w GROUP BY 1""",
)
def awaited_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items per topic that left with their analysis, and those that left without one after six hours.

    Those without one that may still get it are in neither number.
    """
    e = event_stream(spark, sf_dir)
    items = e.select(F.col("event_id").alias("id"), "at")
    done = F.col("at") + F.expr("make_dt_interval(0, 0, event_id % 600, 0)")
    analyses = event_stream(spark, sf_dir).where("event_id % 10 <> 0").select(F.col("event_id").alias("item"), done.alias("done"))
    left = run_to_table(await_analyses(items, analyses), spark, "append")
    topics = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("topic"))
    return left.join(topics, "id").groupBy("topic").agg(F.count("done").alias("analysed"), F.count_if(F.col("done").isNull()).alias("given_up"))


@query(
    "s10_upsert",
    """WITH s AS (SELECT user_id AS source_id, event_id % 500 AS item_key, event_id, md5(event_type) AS content FROM events),
    old AS (SELECT source_id, item_key, arg_max(content, event_id) AS content FROM s WHERE event_id < 5000 GROUP BY 1, 2), new AS (SELECT source_id, item_key, arg_max(content, event_id) AS content FROM s WHERE event_id >= 5000 GROUP BY 1, 2)
    SELECT CASE WHEN old.content IS NULL THEN 'new' WHEN new.content IS NULL THEN 'kept' WHEN old.content <> new.content THEN 'changed' ELSE 'same' END AS outcome, count(*) AS items
    FROM old FULL JOIN new USING (source_id, item_key) GROUP BY 1""",
)
def upsert(spark: SparkSession, sf_dir: str, split: int = 5000) -> DataFrame:
    """Outcome of merging a batch into the stored items by outlet and key; changed content is queued again."""
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), (F.col("event_id") % 500).alias("item_key"), "event_id", F.md5(F.col("event_type").cast("binary")).alias("content"))
    side = lambda d, c: d.groupBy("source_id", "item_key").agg(F.max_by("content", "event_id").alias(c))
    merged = side(e.where(F.col("event_id") < split), "old").join(side(e.where(F.col("event_id") >= split), "new"), ["source_id", "item_key"], "full")
    outcome = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "kept").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return merged.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("items"))
