"""Volume, topics, tone, entities and search over articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressgauge.plans.bindings import AS_OF, EVENT_RANGE, EVENT_SQL, STAR_RANGE, STAR_SQL, TODAY, Range, event_articles, star_articles, star_entities, star_mentions
from pressgauge.session import checkpointed

QUERIES, ORACLE = {}, {}
_E, _S = EVENT_RANGE, STAR_RANGE


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def between(rng: Range, column: str = "published_date") -> str:
    return f"{column} BETWEEN DATE '{rng.start}' AND DATE '{rng.end}'"


def day(c: str = "day") -> Column:
    return F.col(c).cast("string").alias("day")


def growth(now: Column, before: Column, least: int) -> Column:
    """Change against the previous period, damped for small counts."""
    return (now - before) / F.greatest(before, F.lit(least)).cast("double")


@query(
    "q1_overview",
    f"""WITH {EVENT_SQL}, here AS (SELECT * FROM articles WHERE {between(_E)}),
    best AS (SELECT topic, count(*) AS n FROM here WHERE status = 'succeeded' GROUP BY topic ORDER BY n DESC, topic LIMIT 1),
    ent AS (SELECT entity_id, count(*) AS n FROM here GROUP BY entity_id ORDER BY n DESC, entity_id LIMIT 1)
    SELECT count(*) AS articles, count(DISTINCT coalesce(duplicate_of_id, id)) AS unique_stories,
      count(*) FILTER (WHERE published_date = DATE '{TODAY}') AS today, count(*) FILTER (WHERE published_date = DATE '{TODAY}' - 1) AS yesterday,
      count(DISTINCT source_id) AS sources, count(*) FILTER (WHERE status = 'succeeded') AS enriched,
      count(*) FILTER (WHERE label = 'negative') AS negative, count(*) FILTER (WHERE label = 'positive') AS positive,
      round(avg(score), 6) AS avg_tone, max(epoch) AS last_epoch, (SELECT count(*) FROM articles) AS all_time,
      (SELECT topic FROM best) AS top_topic, round((SELECT n FROM best)::DOUBLE / count(*) FILTER (WHERE status = 'succeeded'), 6) AS top_share,
      (SELECT entity_id FROM ent) AS top_entity FROM here""",
)
def overview(spark: SparkSession, sf_dir: str, rng: Range = _E) -> DataFrame:
    """Headline numbers of a range; the top topic's share is of enriched articles."""
    every = event_articles(spark, sf_dir)
    a = every.where(rng.holds(F.col("published_date")))
    done = F.col("status") == "succeeded"
    main = a.agg(
        F.count(F.lit(1)).alias("articles"),
        F.countDistinct(F.coalesce("duplicate_of_id", "id")).alias("unique_stories"),
        F.count_if(F.col("published_date") == F.lit(TODAY)).alias("today"),
        F.count_if(F.col("published_date") == F.date_sub(F.lit(TODAY), 1)).alias("yesterday"),
        F.countDistinct("source_id").alias("sources"),
        F.count_if(done).alias("enriched"),
        F.count_if(F.col("label") == "negative").alias("negative"),
        F.count_if(F.col("label") == "positive").alias("positive"),
        F.round(F.avg("score"), 6).alias("avg_tone"),
        F.max("epoch").alias("last_epoch"),
    )
    best = a.where(done).groupBy("topic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic").limit(1)
    entity = a.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity_id").limit(1)
    # One-row sides.
    out = main.join(every.agg(F.count(F.lit(1)).alias("all_time"))).join(best.select(F.col("topic").alias("top_topic"), "n")).join(entity.select(F.col("entity_id").alias("top_entity")))
    return out.withColumn("top_share", F.round(F.col("n") / F.col("enriched"), 6)).drop("n")


@query(
    "q2_volume",
    f"""WITH {EVENT_SQL}, days AS (SELECT CAST(unnest(generate_series(DATE '{_E.start}', DATE '{_E.end}', INTERVAL 1 DAY)) AS DATE) AS day),
    n AS (SELECT published_date AS day, count(*) AS n, count(DISTINCT coalesce(duplicate_of_id, id)) AS stories FROM articles WHERE {between(_E)} GROUP BY 1)
    SELECT CAST(day AS VARCHAR) AS day, coalesce(n, 0) AS articles, coalesce(stories, 0) AS stories,
      round(avg(coalesce(n, 0)) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS ma7 FROM days LEFT JOIN n USING (day)""",
)
def volume(spark: SparkSession, sf_dir: str, rng: Range = _E) -> DataFrame:
    """Daily counts with gaps filled and a moving average over seven days."""
    a = event_articles(spark, sf_dir).where(rng.holds(F.col("published_date")))
    n = a.groupBy(F.col("published_date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.coalesce("duplicate_of_id", "id")).alias("stories"))
    # The window runs over one row per calendar day of the range.
    week = Window.orderBy("day").rowsBetween(-6, 0)
    filled = rng.calendar(spark).join(n, "day", "left").withColumn("articles", F.coalesce("n", F.lit(0)))
    return filled.select(day(), "articles", F.coalesce("stories", F.lit(0)).alias("stories"), F.round(F.avg("articles").over(week), 6).alias("ma7"))


for _by in ("topic", "source_id"):

    def _volume_by(spark: SparkSession, sf_dir: str, by: str = _by, rng: Range = _E) -> DataFrame:
        """Daily counts by outlet or topic; null keys are dropped and gaps stay."""
        a = event_articles(spark, sf_dir).where(rng.holds(F.col("published_date")) & F.col(by).isNotNull())
        return a.groupBy(F.col("published_date").alias("day"), by).agg(F.count(F.lit(1)).alias("articles")).select(day(), by, "articles")

    query(f"q3_volume_by_{_by}", f"WITH {EVENT_SQL} SELECT CAST(published_date AS VARCHAR) AS day, {_by}, count(*) AS articles FROM articles WHERE {between(_E)} AND {_by} IS NOT NULL GROUP BY 1, 2")(_volume_by)


def _topics_sql(rng: Range) -> str:
    return f"""WITH {EVENT_SQL}, dims AS (SELECT DISTINCT event_type AS topic FROM events),
    cur AS (SELECT topic, count(*) AS n, avg(score) AS tone, count(*) FILTER (WHERE label = 'negative') AS negative, count(*) FILTER (WHERE label = 'positive') AS positive
      FROM articles WHERE status = 'succeeded' AND {between(rng)} GROUP BY topic),
    prev AS (SELECT topic, count(*) AS n FROM articles WHERE status = 'succeeded' AND {between(rng.previous())} GROUP BY topic)
    SELECT topic, coalesce(cur.n, 0) AS articles, coalesce(prev.n, 0) AS previous, round(coalesce(cur.n, 0)::DOUBLE / (SELECT sum(n) FROM cur), 6) AS share,
      round(tone, 6) AS avg_tone, coalesce(negative, 0) AS negative, coalesce(positive, 0) AS positive,
      round((coalesce(cur.n, 0) - coalesce(prev.n, 0))::DOUBLE / greatest(coalesce(prev.n, 0), 5), 6) AS change
    FROM dims LEFT JOIN cur USING (topic) LEFT JOIN prev USING (topic)"""


def topic_periods(a: DataFrame, dims: DataFrame, rng: Range) -> DataFrame:
    """Counts of this and the previous period in one scan, a row for every topic of ``dims``."""
    now, before = rng.holds(F.col("published_date")), rng.previous().holds(F.col("published_date"))
    n = (
        a.where((F.col("status") == "succeeded") & (now | before))
        .groupBy("topic")
        .agg(
            F.count_if(now).alias("articles"),
            F.count_if(before).alias("previous"),
            F.avg(F.when(now, F.col("score"))).alias("tone"),
            F.count_if(now & (F.col("label") == "negative")).alias("negative"),
            F.count_if(now & (F.col("label") == "positive")).alias("positive"),
        )
    )
    whole = Window.partitionBy()
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("articles", "previous", "negative", "positive")]
    filled = dims.join(n, "topic", "left").select("topic", *counts, F.round("tone", 6).alias("avg_tone"))
    return filled.withColumn("share", F.round(F.col("articles") / F.sum("articles").over(whole), 6)).withColumn("change", F.round(growth(F.col("articles"), F.col("previous"), 5), 6))


@query("q4_topics", _topics_sql(Range(_E.start.replace(day=16), _E.end)))
def topics(spark: SparkSession, sf_dir: str, rng: Range = Range(_E.start.replace(day=16), _E.end)) -> DataFrame:
    """Topics of a range against the period before; shares are of classified articles, empty topics stay."""
    a = event_articles(spark, sf_dir)
    return topic_periods(a, event_articles(spark, sf_dir, hidden=True).select("topic").distinct(), rng)


_WEEK = Range(TODAY.replace(day=24), TODAY)


@query("q5_topic_momentum", f"SELECT topic, articles, previous, change FROM ({_topics_sql(_WEEK)}) WHERE articles >= 5")
def topic_momentum(spark: SparkSession, sf_dir: str, rng: Range = _WEEK, least: int = 5) -> DataFrame:
    """Topics of the last week by growth."""
    return topics(spark, sf_dir, rng).where(F.col("articles") >= least).select("topic", "articles", "previous", "change").orderBy(F.desc("change"), "topic")


_TOPIC = "1-URGENT"


@query(
    "q6_topic_series",
    f"""WITH {STAR_SQL}, days AS (SELECT CAST(unnest(generate_series(DATE '{_S.start}', DATE '{_S.end}', INTERVAL 1 DAY)) AS DATE) AS day),
    n AS (SELECT published_date AS day, count(*) AS n, avg(score) AS tone FROM articles WHERE topic = '{_TOPIC}' AND {between(_S)} GROUP BY 1)
    SELECT CAST(day AS VARCHAR) AS day, coalesce(n, 0) AS articles, round(tone, 6) AS avg_tone FROM days LEFT JOIN n USING (day)""",
)
def topic_series(spark: SparkSession, sf_dir: str, topic: str = _TOPIC, rng: Range = _S) -> DataFrame:
    """One topic's daily counts and tone with gaps filled."""
    a = star_articles(spark, sf_dir).where(rng.holds(F.col("published_date")) & (F.col("topic") == topic))
    n = a.groupBy(F.col("published_date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("tone"))
    return rng.calendar(spark).join(n, "day", "left").select(day(), F.coalesce("n", F.lit(0)).alias("articles"), F.round("tone", 6).alias("avg_tone"))


@query(
    "q6_topic_entities",
    f"""WITH {STAR_SQL} SELECT entity_id, name, count(*) AS mentions FROM articles JOIN mentions USING (id) JOIN entities USING (entity_id)
    WHERE topic = '{_TOPIC}' AND {between(_S)} GROUP BY 1, 2 ORDER BY mentions DESC, entity_id LIMIT 15""",
)
def topic_entities(spark: SparkSession, sf_dir: str, topic: str = _TOPIC, rng: Range = _S, limit: int = 15) -> DataFrame:
    """The entities most often named under a topic."""
    a = star_articles(spark, sf_dir).where(rng.holds(F.col("published_date")) & (F.col("topic") == topic))
    n = star_mentions(spark, sf_dir, a).groupBy("entity_id").agg(F.count(F.lit(1)).alias("mentions"))
    best = n.orderBy(F.desc("mentions"), "entity_id").limit(limit)
    return best.join(star_entities(spark, sf_dir).select("entity_id", "name"), "entity_id").select("entity_id", "name", "mentions")


@query("q6_topic_outlets", f"WITH {STAR_SQL} SELECT n_name AS outlet, count(*) AS articles FROM articles JOIN nation ON source_id = n_nationkey WHERE topic = '{_TOPIC}' AND {between(_S)} GROUP BY 1")
def topic_outlets(spark: SparkSession, sf_dir: str, topic: str = _TOPIC, rng: Range = _S) -> DataFrame:
    """A topic's articles per outlet."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    n = star_articles(spark, sf_dir).where(rng.holds(F.col("published_date")) & (F.col("topic") == topic)).groupBy("source_id").agg(F.count(F.lit(1)).alias("articles"))
    return n.join(nation, n["source_id"] == nation["n_nationkey"]).select(F.col("n_name").alias("outlet"), "articles")


@query(
    "q8_top_entities",
    f"""WITH {STAR_SQL}, cur AS (SELECT entity_id, count(*) AS mentions, sum(score) / count(score) AS tone, count(DISTINCT source_id) AS outlets
      FROM articles JOIN mentions USING (id) WHERE {between(_S)} GROUP BY 1),
    page AS (SELECT * FROM cur JOIN entities USING (entity_id) ORDER BY mentions DESC, entity_id LIMIT 20),
    prev AS (SELECT entity_id, count(*) AS n FROM articles JOIN mentions USING (id) WHERE {between(_S.previous())} GROUP BY 1)
    SELECT entity_id, name, type, mentions, round(tone, 6) AS avg_tone, outlets, coalesce(prev.n, 0) AS previous,
      round((mentions - coalesce(prev.n, 0))::DOUBLE / greatest(coalesce(prev.n, 0), 3), 6) AS change FROM page LEFT JOIN prev USING (entity_id)""",
)
def top_entities(spark: SparkSession, sf_dir: str, rng: Range = _S, kind: str | None = None, text: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of entities by mentions with tone, outlets and change; both periods are counted in one pass."""
    now = rng.holds(F.col("published_date"))
    every = star_articles(spark, sf_dir).where(now | rng.previous().holds(F.col("published_date"))).select("id", "source_id", "score", now.alias("now"))
    names = star_entities(spark, sf_dir)
    if kind:
        names = names.where(F.col("type") == kind)
    if text:
        names = names.where(F.col("name").contains(text.lower()))
    # Two levels, so that distinct outlets need no second shuffle of single mentions.
    per_outlet = (
        every.join(star_mentions(spark, sf_dir, every), "id")
        .groupBy("entity_id", "source_id")
        .agg(F.count_if("now").alias("m"), F.count_if(~F.col("now")).alias("p"), F.sum(F.when(F.col("now"), F.col("score"))).alias("s"), F.count(F.when(F.col("now"), F.col("score"))).alias("k"))
    )
    cur = per_outlet.groupBy("entity_id").agg(
        F.sum("m").alias("mentions"), F.sum("p").alias("previous"), (F.sum("s") / F.sum("k")).alias("tone"), F.count_if(F.col("m") > 0).alias("outlets")
    )
    page = cur.where("mentions > 0").join(names, "entity_id").orderBy(F.desc("mentions"), "entity_id").offset(offset).limit(limit)
    change = F.round(growth(F.col("mentions"), F.col("previous"), 3), 6)
    return page.select("entity_id", "name", "type", "mentions", F.round("tone", 6).alias("avg_tone"), "outlets", "previous", change.alias("change"))


@query(
    "q9_entity_spikes",
    f"""WITH {EVENT_SQL}, cur AS (SELECT source_id AS entity_id, count(*) AS x FROM articles
      WHERE published_at > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND published_at <= TIMESTAMP '{AS_OF}' GROUP BY 1 HAVING count(*) >= 5),
    daily AS (SELECT source_id AS entity_id, published_date, count(*) AS n FROM articles
      WHERE published_at > TIMESTAMP '{AS_OF}' - INTERVAL 29 DAY AND published_at <= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR GROUP BY 1, 2),
    base AS (SELECT entity_id, sum(n) / 28.0::DOUBLE AS mean, sqrt(greatest(sum(n * n) / 28.0::DOUBLE - (sum(n) / 28.0::DOUBLE) * (sum(n) / 28.0::DOUBLE), 0)) AS sd FROM daily GROUP BY 1)
    SELECT entity_id, x, round(coalesce(mean, 0), 6) AS mean, round((x - coalesce(mean, 0)) / greatest(coalesce(sd, 0), 1), 6) AS z,
      (x - coalesce(mean, 0)) / greatest(coalesce(sd, 0), 1) >= 3 AS is_spike FROM cur LEFT JOIN base USING (entity_id)""",
)
def entity_spikes(spark: SparkSession, sf_dir: str, as_of: str = AS_OF, baseline: int = 28, least: int = 5, threshold: float = 3.0) -> DataFrame:
    """Entities named far more often in the last day than on the days before; days without a mention count as zero."""
    a = event_articles(spark, sf_dir).drop("entity_id").withColumnRenamed("source_id", "entity_id")
    now, at = F.to_timestamp(F.lit(as_of)), F.col("published_at")
    edge = now - F.expr("INTERVAL 24 HOURS")
    cur = a.where((at > edge) & (at <= now)).groupBy("entity_id").agg(F.count(F.lit(1)).alias("x")).where(F.col("x") >= least)
    past = a.where((at > now - F.expr(f"INTERVAL {baseline + 1} DAYS")) & (at <= edge))
    daily = past.groupBy("entity_id", "published_date").agg(F.count(F.lit(1)).alias("n"))
    days = F.lit(float(baseline))
    base = daily.groupBy("entity_id").agg((F.sum("n") / days).alias("m"), (F.sum(F.col("n") * F.col("n")) / days).alias("q"))
    mean = F.coalesce("m", F.lit(0.0))
    sd = F.coalesce(F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))), F.lit(0.0))
    z = (F.col("x") - mean) / F.greatest(sd, F.lit(1.0))
    return cur.join(base, "entity_id", "left").select("entity_id", "x", F.round(mean, 6).alias("mean"), F.round(z, 6).alias("z"), (z >= threshold).alias("is_spike"))


@query(
    "q10_co_occurrence",
    f"""WITH {STAR_SQL}, here AS (SELECT m.* FROM mentions m JOIN articles USING (id) WHERE {between(_S)}),
    pairs AS (SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS n FROM here x JOIN here y ON x.id = y.id AND x.entity_id < y.entity_id GROUP BY 1, 2 HAVING count(*) >= 1)
    SELECT a, b, ea.name AS name_a, eb.name AS name_b, n FROM pairs JOIN entities ea ON a = ea.entity_id JOIN entities eb ON b = eb.entity_id ORDER BY n DESC, a, b LIMIT 30""",
)
def co_occurrence(spark: SparkSession, sf_dir: str, rng: Range = _S, limit: int = 30, least: int = 1) -> DataFrame:
    """Unordered pairs of entities by the articles that name both; names are joined after counting."""
    here = star_mentions(spark, sf_dir, star_articles(spark, sf_dir).where(rng.holds(F.col("published_date"))))
    # An article names a bounded number of entities, so the pairs of an article are built from its list.
    listed = here.groupBy("id").agg(F.array_sort(F.collect_list("entity_id")).alias("e")).where(F.size("e") > 1)
    first = listed.select("e", F.posexplode("e").alias("i", "a"))
    pairs = first.select("a", F.explode(F.expr("slice(e, i + 2, size(e))")).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    best = pairs.where(F.col("n") >= least).orderBy(F.desc("n"), "a", "b").limit(limit)
    names = star_entities(spark, sf_dir).select("entity_id", "name")
    best = best.join(names.select(F.col("entity_id").alias("a"), F.col("name").alias("name_a")), "a").join(names.select(F.col("entity_id").alias("b"), F.col("name").alias("name_b")), "b")
    return best.select("a", "b", "name_a", "name_b", "n")


@query(
    "q11_sentiment_series",
    f"""WITH {EVENT_SQL}, days AS (SELECT CAST(unnest(generate_series(DATE '{_E.start}', DATE '{_E.end}', INTERVAL 1 DAY)) AS DATE) AS day),
    n AS (SELECT published_date AS day, count(*) AS n, sum(score) AS s, count(*) FILTER (WHERE label = 'negative') AS negative, count(*) FILTER (WHERE label = 'neutral') AS neutral,
      count(*) FILTER (WHERE label = 'positive') AS positive FROM articles WHERE {between(_E)} GROUP BY 1)
    SELECT CAST(day AS VARCHAR) AS day, coalesce(negative, 0) AS negative, coalesce(neutral, 0) AS neutral, coalesce(positive, 0) AS positive, round(s / n, 6) AS average,
      round(sum(s) OVER w / nullif(sum(n) OVER w, 0), 6) AS ma7 FROM days LEFT JOIN n USING (day) WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def sentiment_series(spark: SparkSession, sf_dir: str, rng: Range = _E) -> DataFrame:
    """Daily tone counts, average and an article-weighted moving average."""
    a = event_articles(spark, sf_dir).where(rng.holds(F.col("published_date")))
    kinds = ("negative", "neutral", "positive")
    n = a.groupBy(F.col("published_date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), *[F.count_if(F.col("label") == k).alias(k) for k in kinds])
    week = Window.orderBy("day").rowsBetween(-6, 0)
    ma = F.sum("s").over(week) / F.nullif(F.sum("n").over(week), F.lit(0))
    return rng.calendar(spark).join(n, "day", "left").select(day(), *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds], F.round(F.col("s") / F.col("n"), 6).alias("average"), F.round(ma, 6).alias("ma7"))


@query(
    "q11_sentiment_by_source",
    f"WITH {EVENT_SQL} SELECT source_id, count(*) AS articles, round(avg(score), 6) AS average, count(*) FILTER (WHERE label = 'negative') AS negative, count(*) FILTER (WHERE label = 'positive') AS positive FROM articles WHERE {between(_E)} GROUP BY 1",
)
def sentiment_by_source(spark: SparkSession, sf_dir: str, rng: Range = _E) -> DataFrame:
    """Tone per outlet."""
    a = event_articles(spark, sf_dir).where(rng.holds(F.col("published_date")))
    return a.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("articles"), F.round(F.avg("score"), 6).alias("average"), F.count_if(F.col("label") == "negative").alias("negative"), F.count_if(F.col("label") == "positive").alias("positive")
    )


@query(
    "q12_entity_series",
    f"""WITH {EVENT_SQL}, n AS (SELECT published_date AS day, count(*) AS mentions, avg(CASE WHEN status = 'succeeded' THEN score END) AS tone FROM articles WHERE entity_id = 7 AND {between(_E)} GROUP BY 1),
    days AS (SELECT CAST(unnest(generate_series(DATE '{_E.start}', DATE '{_E.end}', INTERVAL 1 DAY)) AS DATE) AS day)
    SELECT CAST(day AS VARCHAR) AS day, coalesce(mentions, 0) AS mentions, round(tone, 6) AS tone,
      round((SELECT sum(tone * mentions) / sum(mentions) FROM n), 6) AS overall FROM days LEFT JOIN n USING (day)""",
)
def entity_series(spark: SparkSession, sf_dir: str, entity: int = 7, rng: Range = _E) -> DataFrame:
    """One entity's days; the overall tone weighs daily means by mentions over all mentions, days without tone included."""
    a = event_articles(spark, sf_dir).where(rng.holds(F.col("published_date")) & (F.col("entity_id") == entity))
    n = a.groupBy(F.col("published_date").alias("day")).agg(F.count(F.lit(1)).alias("m"), F.avg(F.when(F.col("status") == "succeeded", F.col("score"))).alias("tone"))
    whole = Window.partitionBy()
    overall = F.sum(F.col("tone") * F.col("m")).over(whole) / F.sum("m").over(whole)
    return rng.calendar(spark).join(n, "day", "left").select(day(), F.coalesce("m", F.lit(0)).alias("mentions"), F.round("tone", 6).alias("tone"), F.round(overall, 6).alias("overall"))


@query(
    "q12_entity_co_mentions",
    f"""WITH {STAR_SQL}, top AS (SELECT entity_id FROM articles JOIN mentions USING (id) WHERE {between(_S)} GROUP BY 1 ORDER BY count(*) DESC, entity_id LIMIT 1),
    here AS (SELECT m.* FROM mentions m JOIN articles USING (id) WHERE {between(_S)})
    SELECT y.entity_id, count(*) AS shared FROM here x JOIN here y ON x.id = y.id AND x.entity_id <> y.entity_id WHERE x.entity_id = (SELECT entity_id FROM top) GROUP BY 1 ORDER BY shared DESC, y.entity_id LIMIT 12""",
)
def entity_co_mentions(spark: SparkSession, sf_dir: str, rng: Range = _S, limit: int = 12) -> DataFrame:
    """Entities named together with the entity named most; that entity's articles are found before the join."""
    here = star_mentions(spark, sf_dir, star_articles(spark, sf_dir).where(rng.holds(F.col("published_date"))))
    top = here.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity_id").limit(1).select(F.col("entity_id").alias("top"))
    mine = here.join(F.broadcast(top), F.col("entity_id") == F.col("top")).select("id", "top")
    both = here.join(mine, "id").where(F.col("entity_id") != F.col("top"))
    return both.groupBy("entity_id").agg(F.count(F.lit(1)).alias("shared")).orderBy(F.desc("shared"), "entity_id").limit(limit)


_BEFORE = _WEEK.previous()


@query(
    "q13_sentiment_shift",
    f"""WITH {EVENT_SQL}, t AS (SELECT topic, count(*) FILTER (WHERE {between(_WEEK)}) AS n, count(*) FILTER (WHERE {between(_BEFORE)}) AS previous_n,
      avg(score) FILTER (WHERE {between(_WEEK)}) AS tone, avg(score) FILTER (WHERE {between(_BEFORE)}) AS previous_tone FROM articles GROUP BY 1)
    SELECT topic, n, previous_n, round(tone, 6) AS tone, round(previous_tone, 6) AS previous_tone, round(tone - previous_tone, 6) AS shift FROM t WHERE n >= 5 AND previous_n >= 5""",
)
def sentiment_shift(spark: SparkSession, sf_dir: str, rng: Range = _WEEK, least: int = 5) -> DataFrame:
    """Mean tone of the last week minus that of the week before, per topic, in one scan."""
    now, before = rng.holds(F.col("published_date")), rng.previous().holds(F.col("published_date"))
    t = (
        event_articles(spark, sf_dir)
        .where(now | before)
        .groupBy("topic")
        .agg(F.count_if(now).alias("n"), F.count_if(before).alias("previous_n"), F.avg(F.when(now, F.col("score"))).alias("a"), F.avg(F.when(before, F.col("score"))).alias("b"))
        .where((F.col("n") >= least) & (F.col("previous_n") >= least))
    )
    return t.select("topic", "n", "previous_n", F.round("a", 6).alias("tone"), F.round("b", 6).alias("previous_tone"), F.round(F.col("a") - F.col("b"), 6).alias("shift")).orderBy(F.abs("shift").desc(), "topic")


@query(
    "q22_article_search",
    f"""WITH {STAR_SQL}, hit AS (SELECT * FROM articles a WHERE {between(_S)} AND topic = '{_TOPIC}'
      AND EXISTS (SELECT 1 FROM mentions m JOIN entities e USING (entity_id) WHERE m.id = a.id AND e.name LIKE '%ring%'))
    SELECT id, topic, CAST(published_date AS VARCHAR) AS day, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY published_date DESC, id DESC LIMIT 20""",
)
def article_search(spark: SparkSession, sf_dir: str, rng: Range = _S, topic: str | None = _TOPIC, entity_text: str | None = "ring", limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of articles under optional filters, newest first, with the number of all hits."""
    hit = star_articles(spark, sf_dir).where(rng.holds(F.col("published_date")))
    if topic:
        hit = hit.where(F.col("topic") == topic)
    if entity_text is not None:
        named = star_mentions(spark, sf_dir, hit).join(star_entities(spark, sf_dir).where(F.col("name").contains(entity_text)), "entity_id").select("id")
        hit = hit.join(named, "id", "left_semi")
    # The hits are found once; both the page and their number read what was found.
    hit = checkpointed(hit.select("id", "topic", "published_date"))
    total = hit.agg(F.count(F.lit(1)).alias("total"))
    page = hit.orderBy(F.desc("published_date"), F.desc("id")).offset(offset).limit(limit)
    return page.join(total).select("id", "topic", day("published_date"), "total")


@query(
    "q23_article_detail",
    f"""WITH {EVENT_SQL}, me AS (SELECT id, coalesce(duplicate_of_id, id) AS root, story_id FROM articles WHERE id = 4235)
    SELECT a.id, a.topic, a.entity_id, a.epoch, a.id = me.id AS is_self FROM articles a, me WHERE a.duplicate_of_id = me.root OR a.id = me.root OR a.story_id = me.story_id OR a.id = me.id ORDER BY a.epoch DESC, a.id LIMIT 11""",
)
def article_detail(spark: SparkSession, sf_dir: str, article: int = 4235, related: int = 10) -> DataFrame:
    """An article and those related to it by copy root or story."""
    a = event_articles(spark, sf_dir)
    me = a.where(F.col("id") == article).select(F.col("id").alias("me"), F.coalesce("duplicate_of_id", "id").alias("root"), F.col("story_id").alias("mine"))
    near = a.join(F.broadcast(me), (F.col("duplicate_of_id") == F.col("root")) | (F.col("id") == F.col("root")) | (F.col("story_id") == F.col("mine")) | (F.col("id") == F.col("me")))
    return near.select("id", "topic", "entity_id", "epoch", (F.col("id") == F.col("me")).alias("is_self")).orderBy(F.desc("epoch"), "id").limit(related + 1)


@query("q24_followed_countries", f"WITH {EVENT_SQL} SELECT DISTINCT source_country AS country FROM articles_all WHERE NOT is_hidden OR source_id % 10 <> 0")
def followed_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries with an active outlet or visible articles."""
    a = event_articles(spark, sf_dir, hidden=True)
    return a.where(~F.col("is_hidden") | (F.col("source_id") % 10 != 0)).select(F.col("source_country").alias("country")).distinct()


@query("q25_taxonomy", "SELECT event_type AS topic, count(*) AS events FROM events GROUP BY 1")
def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics there are."""
    return event_articles(spark, sf_dir, hidden=True).groupBy("topic").agg(F.count(F.lit(1)).alias("events"))


@query(
    "q32_comparable_history",
    f"""WITH {EVENT_SQL} SELECT source_id, count(*) FILTER (WHERE {between(_WEEK)}) AS n, count(*) FILTER (WHERE {between(_BEFORE)}) AS previous,
    count(*) FILTER (WHERE {between(_BEFORE)}) >= 0.5 * count(*) FILTER (WHERE {between(_WEEK)}) AS comparable FROM articles GROUP BY 1""",
)
def comparable_history(spark: SparkSession, sf_dir: str, rng: Range = _WEEK) -> DataFrame:
    """Whether an outlet's earlier period is long enough to compare with."""
    now, before = rng.holds(F.col("published_date")), rng.previous().holds(F.col("published_date"))
    n = event_articles(spark, sf_dir).groupBy("source_id").agg(F.count_if(now).alias("n"), F.count_if(before).alias("previous"))
    return n.withColumn("comparable", F.col("previous") >= 0.5 * F.col("n"))
