"""Stories: events that several outlets cover. Feed, coverage, first reports, blindspots and outlet profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressgauge.plans.bindings import AS_OF, EVENT_RANGE, EVENT_SQL, Range, event_articles

QUERIES, ORACLE = {}, {}
_R = EVENT_RANGE
_BETWEEN = f"published_date BETWEEN DATE '{_R.start}' AND DATE '{_R.end}'"
#: Articles of one story lie within a few days of its first one.
MARGIN_DAYS = 3
_AS_OF_EPOCH = 1706659200


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def bias_group(c: Column) -> Column:
    return F.when(c.isin("left", "lean_left"), "left").when(c == "center", "center").when(c.isin("right", "lean_right"), "right").otherwise("unrated")


def factuality_group(c: Column) -> Column:
    return F.when(c.isin("very_high", "high"), "high").when(c == "mixed", "mixed").when(c.isin("low", "very_low"), "low").otherwise("unrated")


_BIAS = "CASE WHEN source_bias IN ('left', 'lean_left') THEN 'left' WHEN source_bias = 'center' THEN 'center' WHEN source_bias IN ('right', 'lean_right') THEN 'right' ELSE 'unrated' END"
_FACT = "CASE WHEN source_factuality IN ('very_high', 'high') THEN 'high' WHEN source_factuality = 'mixed' THEN 'mixed' WHEN source_factuality IN ('low', 'very_low') THEN 'low' ELSE 'unrated' END"

_FIRST_SQL = f"""WITH {EVENT_SQL}, marked AS (
  SELECT *, first_value(source_id) OVER w AS first_source, first_value(epoch) OVER w AS first_epoch FROM articles WINDOW w AS (PARTITION BY story_id ORDER BY epoch, id)
), firsts AS (
  SELECT story_id, count(DISTINCT source_id) AS outlets, count(*) AS articles, min(epoch) AS first_epoch, max(epoch) AS last_epoch,
    CASE WHEN bool_or(estimated AND source_id <> first_source AND epoch <= first_epoch + 1800) THEN NULL ELSE min(first_source) END AS first_source
  FROM marked GROUP BY story_id
)"""


def story_heads(a: DataFrame) -> DataFrame:
    """A row per story: outlets, articles, span and the outlet that reported first.

    The first outlet is left open where another outlet's article with an estimated time lies within half an hour.
    """
    # One row per story and outlet first: a story's list holds its outlets, never its articles.
    by_outlet = a.groupBy("story_id", "source_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("epoch", "id")).alias("f"), F.max("epoch").alias("last"), F.min(F.when(F.col("estimated"), F.col("epoch"))).alias("guess")
    )
    stories = by_outlet.groupBy("story_id").agg(
        F.count("source_id").alias("outlets"),
        F.sum("n").alias("articles"),
        F.min(F.struct("f.epoch", "f.id", "source_id")).alias("first"),
        F.max("last").alias("last_epoch"),
        F.collect_list(F.struct("source_id", "guess")).alias("guesses"),
    )
    unsure = F.exists("guesses", lambda g: (g["source_id"] != F.col("first.source_id")) & F.coalesce(g["guess"] <= F.col("first.epoch") + 1800, F.lit(False)))
    return stories.select("story_id", "outlets", "articles", F.col("first.epoch").alias("first_epoch"), "last_epoch", F.when(~unsure, F.col("first.source_id")).alias("first_source"))


def near_range(a: DataFrame, rng: Range) -> DataFrame:
    """Articles that may belong to a story with an article in the range."""
    return a.where(F.col("published_date").between(F.date_sub(F.lit(rng.start), MARGIN_DAYS), F.date_add(F.lit(rng.end), MARGIN_DAYS)))


@query("q19_first_reports", f"{_FIRST_SQL} SELECT * FROM firsts")
def first_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories with their first reporter."""
    return story_heads(event_articles(spark, sf_dir))


@query(
    "q14_sources_compare",
    f"""{_FIRST_SQL}, mine AS (SELECT a.*, f.outlets, f.first_source FROM articles a JOIN firsts f USING (story_id) WHERE {_BETWEEN}),
    tops AS (SELECT source_id, topic, count(*) AS n, row_number() OVER (PARTITION BY source_id ORDER BY count(*) DESC, topic) AS rk FROM mine GROUP BY 1, 2),
    lists AS (SELECT source_id, string_agg(topic || ':' || n, ',' ORDER BY rk) AS top_topics FROM tops WHERE rk <= 5 GROUP BY 1),
    outlets AS (SELECT DISTINCT source_id, source_country AS country FROM articles_all)
    SELECT o.source_id, country, count(m.id) AS articles, count(m.id) FILTER (WHERE duplicate_of_id IS NULL) AS originals, round(avg(score), 6) AS avg_tone, max(epoch) AS last_epoch,
      count(DISTINCT m.story_id) AS stories, count(DISTINCT m.story_id) FILTER (WHERE m.outlets >= 2 AND m.first_source = o.source_id) AS first_reports,
      round(count(m.id) / {float(_R.days)}, 6) AS per_day, min(top_topics) AS top_topics
    FROM outlets o LEFT JOIN mine m USING (source_id) LEFT JOIN lists l USING (source_id) GROUP BY 1, 2""",
)
def sources_compare(spark: SparkSession, sf_dir: str, rng: Range = _R, topics: int = 5) -> DataFrame:
    """Outlets side by side; those without an article in the range stay with zeros."""
    every = near_range(event_articles(spark, sf_dir), rng)
    heads = story_heads(every).select("story_id", F.col("outlets").alias("k"), "first_source")
    mine = every.where(rng.holds(F.col("published_date"))).join(heads, "story_id")
    led = (F.col("k") >= 2) & (F.col("first_source") == F.col("source_id"))
    # The join left the rows together by story, so a row per outlet and story needs no shuffle.
    each = mine.groupBy("story_id", "source_id").agg(
        F.count(F.lit(1)).alias("articles"), F.count_if(F.col("duplicate_of_id").isNull()).alias("originals"), F.sum("score").alias("tone"), F.count("score").alias("toned"),
        F.max("epoch").alias("last_epoch"), F.max(led).alias("led"),
    )
    n = each.groupBy("source_id").agg(
        F.sum("articles").alias("articles"),
        F.sum("originals").alias("originals"),
        F.round(F.try_divide(F.sum("tone"), F.sum("toned")), 6).alias("avg_tone"),
        F.max("last_epoch").alias("last_epoch"),
        F.count(F.lit(1)).alias("stories"),
        F.count_if("led").alias("first_reports"),
    )
    rank = Window.partitionBy("source_id").orderBy(F.desc("n"), "topic")
    tops = mine.groupBy("source_id", "topic").agg(F.count(F.lit(1)).alias("n")).withColumn("rk", F.row_number().over(rank)).where(F.col("rk") <= topics)
    label = F.concat_ws(":", "topic", F.col("n").cast("string"))
    lists = tops.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("rk", label.alias("t")))).alias("l")).select("source_id", F.array_join(F.col("l.t"), ",").alias("top_topics"))
    outlets = event_articles(spark, sf_dir, hidden=True).select("source_id", F.col("source_country").alias("country")).distinct()
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("articles", "originals", "stories", "first_reports")]
    return outlets.join(n, "source_id", "left").join(lists, "source_id", "left").select(
        "source_id", "country", *counts, "avg_tone", "last_epoch", F.round(F.coalesce("articles", F.lit(0)) / float(rng.days), 6).alias("per_day"), "top_topics"
    )


@query(
    "q15_story_feed",
    f"""WITH {EVENT_SQL}, s AS (SELECT story_id, count(DISTINCT source_id) AS outlets, count(*) AS articles, min(epoch) AS first_epoch, max(epoch) AS last_epoch,
      min(published_date) AS day FROM articles GROUP BY 1 HAVING count(DISTINCT source_id) >= 2 AND bool_or(source_country = 'C1') AND min(published_date) BETWEEN DATE '{_R.start}' AND DATE '{_R.end}'),
    scored AS (SELECT *, outlets * power(0.5::DOUBLE, greatest({_AS_OF_EPOCH} - last_epoch, 0) / 3600.0::DOUBLE / {max(12.0, 8.0 * _R.days)}::DOUBLE) AS score, count(*) OVER () AS total FROM s)
    SELECT story_id, outlets, articles, first_epoch, last_epoch, round(score, 6) AS score, total FROM scored ORDER BY scored.score DESC, story_id LIMIT 20""",
)
def story_feed(spark: SparkSession, sf_dir: str, rng: Range = _R, min_sources: int = 2, country: str | None = "C1", as_of_epoch: int = _AS_OF_EPOCH, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of stories by outlets, halved as they age. A country filter keeps whole stories; a page past the end has no rows."""
    s = near_range(event_articles(spark, sf_dir), rng).groupBy("story_id").agg(
        F.countDistinct("source_id").alias("outlets"),
        F.count(F.lit(1)).alias("articles"),
        F.min("epoch").alias("first_epoch"),
        F.max("epoch").alias("last_epoch"),
        F.min("published_date").alias("day"),
        F.bool_or(F.col("source_country") == country).alias("followed") if country else F.lit(True).alias("followed"),
    )
    s = s.where((F.col("outlets") >= min_sources) & F.col("followed") & rng.holds(F.col("day")))
    half_life = max(12.0, 8.0 * rng.days)
    age = F.greatest(F.lit(as_of_epoch) - F.col("last_epoch"), F.lit(0)) / 3600.0
    scored = s.withColumn("s", F.col("outlets") * F.pow(F.lit(0.5), age / half_life))
    page = scored.orderBy(F.desc("s"), "story_id").offset(offset).limit(limit)
    return page.join(s.agg(F.count(F.lit(1)).alias("total"))).select("story_id", "outlets", "articles", "first_epoch", "last_epoch", F.round("s", 6).alias("score"), "total")


def outlet_coverage(a: DataFrame) -> DataFrame:
    """(story_id, outlet and its groups): every outlet once per story, whatever number of articles it has."""
    return a.select("story_id", "source_id", "source_country", bias_group(F.col("source_bias")).alias("bias"), factuality_group(F.col("source_factuality")).alias("factuality")).distinct()


@query(
    "q16_story_cards",
    f"""WITH {EVENT_SQL}, outlets AS (SELECT DISTINCT story_id, source_id, source_country, {_BIAS} AS bias, {_FACT} AS factuality FROM articles),
    cover AS (SELECT story_id, count(*) AS outlets, {', '.join(f"count(*) FILTER (WHERE bias = '{b}') AS bias_{b}" for b in ('left', 'center', 'right', 'unrated'))},
      {', '.join(f"count(*) FILTER (WHERE factuality = '{b}') AS factuality_{b}" for b in ('high', 'mixed', 'low', 'unrated'))}, count(DISTINCT source_country) AS regions FROM outlets GROUP BY 1),
    tone AS (SELECT story_id, count(*) AS articles, {', '.join(f"count(*) FILTER (WHERE label = '{k}') AS tone_{k}" for k in ('negative', 'neutral', 'positive'))}, arg_min(id, epoch * 1000000 + id) AS representative FROM articles GROUP BY 1)
    SELECT * FROM cover JOIN tone USING (story_id)""",
)
def story_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of every story counted over distinct outlets, tone counted over articles."""
    a = event_articles(spark, sf_dir)
    sides = [F.count_if(F.col("bias") == b).alias(f"bias_{b}") for b in ("left", "center", "right", "unrated")]
    grades = [F.count_if(F.col("factuality") == b).alias(f"factuality_{b}") for b in ("high", "mixed", "low", "unrated")]
    cover = outlet_coverage(a).groupBy("story_id").agg(F.count(F.lit(1)).alias("outlets"), *sides, *grades, F.size(F.collect_set("source_country")).cast("long").alias("regions"))
    tone = a.groupBy("story_id").agg(
        F.count(F.lit(1)).alias("articles"), *[F.count_if(F.col("label") == k).alias(f"tone_{k}") for k in ("negative", "neutral", "positive")], F.min_by("id", F.struct("epoch", "id")).alias("representative")
    )
    return cover.join(tone, "story_id")


def perspective_gap(left: Column, right: Column, rated: Column, least: int = 3) -> Column:
    """The side that is missing: one side has 60 % or more of the rated outlets, the other at most 15 %."""
    enough = rated >= least
    return F.when(enough & (left >= 0.6 * rated) & (right <= 0.15 * rated), "right").when(enough & (right >= 0.6 * rated) & (left <= 0.15 * rated), "left")


@query(
    "q17_perspective_blindspots",
    f"""WITH {EVENT_SQL}, outlets AS (SELECT DISTINCT story_id, source_id, {_BIAS} AS bias FROM articles),
    n AS (SELECT story_id, count(*) FILTER (WHERE bias <> 'unrated') AS rated, count(*) FILTER (WHERE bias = 'left') AS l, count(*) FILTER (WHERE bias = 'right') AS r FROM outlets GROUP BY 1)
    SELECT story_id, rated, l AS left_outlets, r AS right_outlets, CASE WHEN l >= 0.6 * rated AND r <= 0.15 * rated THEN 'right' ELSE 'left' END AS missing FROM n
    WHERE rated >= 3 AND ((l >= 0.6 * rated AND r <= 0.15 * rated) OR (r >= 0.6 * rated AND l <= 0.15 * rated))""",
)
def perspective_blindspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories that one side of the rated outlets hardly covers."""
    n = (
        outlet_coverage(event_articles(spark, sf_dir))
        .groupBy("story_id")
        .agg(F.count_if(F.col("bias") != "unrated").alias("rated"), F.count_if(F.col("bias") == "left").alias("left_outlets"), F.count_if(F.col("bias") == "right").alias("right_outlets"))
    )
    return n.withColumn("missing", perspective_gap(F.col("left_outlets"), F.col("right_outlets"), F.col("rated"))).where("missing is not null")


@query(
    "q17_region_blindspots",
    f"""WITH {EVENT_SQL}, s AS (SELECT story_id, count(DISTINCT source_id) AS outlets, count(*) FILTER (WHERE status = 'succeeded') AS analysed FROM articles GROUP BY 1),
    named AS (SELECT story_id, named_country AS country, count(*) AS n FROM articles WHERE status = 'succeeded' GROUP BY 1, 2)
    SELECT story_id, country, n, outlets FROM named JOIN s USING (story_id) WHERE outlets >= 3 AND n >= 0.5 * analysed
      AND country IN (SELECT DISTINCT source_country FROM articles_all) AND NOT EXISTS (SELECT 1 FROM articles a WHERE a.story_id = named.story_id AND a.source_country = named.country)""",
)
def region_blindspots(spark: SparkSession, sf_dir: str, least: int = 3) -> DataFrame:
    """Stories that name a followed country which none of their outlets is from."""
    a = event_articles(spark, sf_dir)
    done = F.col("status") == "succeeded"
    s = a.groupBy("story_id").agg(F.countDistinct("source_id").alias("outlets"), F.count_if(done).alias("analysed"), F.collect_set("source_country").alias("covering"))
    named = a.where(done).groupBy("story_id", F.col("named_country").alias("country")).agg(F.count(F.lit(1)).alias("n"))
    followed = event_articles(spark, sf_dir, hidden=True).select(F.col("source_country").alias("country")).distinct()
    hit = named.join(s, "story_id").where((F.col("outlets") >= least) & (F.col("n") >= 0.5 * F.col("analysed")) & ~F.array_contains("covering", F.col("country")))
    return hit.join(followed, "country", "left_semi").select("story_id", "country", "n", "outlets")


@query(
    "q18_story_detail",
    f"""WITH {EVENT_SQL}, big AS (SELECT story_id FROM articles GROUP BY 1 ORDER BY count(*) DESC, story_id LIMIT 1)
    SELECT id, source_id, epoch, label, entity_id, row_number() OVER (ORDER BY epoch, id) = 1 AS is_first FROM articles WHERE story_id = (SELECT story_id FROM big)""",
)
def story_detail(spark: SparkSession, sf_dir: str, story: str | None = None) -> DataFrame:
    """Members of one story in order; the largest story if none is named."""
    a = event_articles(spark, sf_dir)
    if story:
        members = a.where(F.col("story_id") == story)
    else:
        big = a.groupBy("story_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "story_id").limit(1).select("story_id")
        members = a.join(F.broadcast(big), "story_id", "left_semi")
    order = Window.partitionBy("story_id").orderBy("epoch", "id")
    return members.select("id", "source_id", "epoch", "label", "entity_id", (F.row_number().over(order) == 1).alias("is_first"))


@query(
    "q20_related_stories",
    f"""WITH {EVENT_SQL}, big AS (SELECT story_id, min(epoch) AS t0 FROM articles GROUP BY 1 ORDER BY count(*) DESC, story_id LIMIT 1),
    mine AS (SELECT DISTINCT entity_id FROM articles WHERE story_id = (SELECT story_id FROM big)),
    other AS (SELECT story_id, min(epoch) AS t0 FROM articles GROUP BY 1)
    SELECT a.story_id, count(DISTINCT a.entity_id) AS shared FROM articles a JOIN mine USING (entity_id) JOIN other o ON o.story_id = a.story_id
    WHERE a.story_id <> (SELECT story_id FROM big) AND abs(o.t0 - (SELECT t0 FROM big)) <= 259200 GROUP BY 1 HAVING count(DISTINCT a.entity_id) >= 2 ORDER BY shared DESC, a.story_id LIMIT 6""",
)
def related_stories(spark: SparkSession, sf_dir: str, limit: int = 6) -> DataFrame:
    """Stories within three days that share two entities or more with the largest story."""
    a = event_articles(spark, sf_dir)
    heads = a.groupBy("story_id").agg(F.count(F.lit(1)).alias("n"), F.min("epoch").alias("at"))
    me = heads.orderBy(F.desc("n"), "story_id").limit(1).select(F.col("story_id").alias("me"), F.col("at").alias("mine_at"))
    near = heads.join(F.broadcast(me), (F.col("story_id") != F.col("me")) & (F.abs(F.col("at") - F.col("mine_at")) <= MARGIN_DAYS * 86400)).select("story_id")
    entities = a.join(F.broadcast(me), F.col("story_id") == F.col("me")).select("entity_id").distinct()
    shared = a.join(near, "story_id").join(F.broadcast(entities), "entity_id").groupBy("story_id").agg(F.countDistinct("entity_id").alias("shared"))
    return shared.where(F.col("shared") >= 2).orderBy(F.desc("shared"), "story_id").limit(limit)


@query(
    "q21_source_profile",
    f"""{_FIRST_SQL}, mine AS (SELECT DISTINCT source_id, story_id FROM articles),
    multi AS (SELECT count(*) AS n FROM firsts WHERE outlets >= 2)
    SELECT source_id, count(*) AS stories, round(count(*) FILTER (WHERE outlets >= 2)::DOUBLE / (SELECT n FROM multi), 6) AS coverage_share,
      count(*) FILTER (WHERE outlets >= 2 AND first_source = source_id) AS first_reports, count(*) FILTER (WHERE outlets = 1) AS exclusives FROM mine JOIN firsts USING (story_id) GROUP BY 1""",
)
def source_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every outlet's stories, share of the multi-outlet stories, first reports and exclusives."""
    a = event_articles(spark, sf_dir)
    heads = story_heads(a).select("story_id", "outlets", "first_source")
    many = F.col("outlets") >= 2
    mine = a.select("source_id", "story_id").distinct().join(heads, "story_id")
    n = mine.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("stories"), F.count_if(many).alias("m"), F.count_if(many & (F.col("first_source") == F.col("source_id"))).alias("first_reports"), F.count_if(F.col("outlets") == 1).alias("exclusives")
    )
    total = heads.agg(F.count_if(many).alias("all_multi"))
    return n.join(total).select("source_id", "stories", F.round(F.col("m") / F.col("all_multi"), 6).alias("coverage_share"), "first_reports", "exclusives")


@query(
    "q21_source_overlap",
    f"""WITH {EVENT_SQL}, mine AS (SELECT DISTINCT source_id, story_id FROM articles)
    SELECT b.source_id AS other, count(*) AS shared FROM mine a JOIN mine b USING (story_id) WHERE a.source_id = 7 AND b.source_id <> 7 GROUP BY 1 ORDER BY shared DESC, other LIMIT 8""",
)
def source_overlap(spark: SparkSession, sf_dir: str, source: int = 7, limit: int = 8) -> DataFrame:
    """The outlets that share most stories with one outlet."""
    pairs = event_articles(spark, sf_dir).select("source_id", "story_id").distinct()
    mine = pairs.where(F.col("source_id") == source).select("story_id")
    others = pairs.where(F.col("source_id") != source).join(mine, "story_id", "left_semi")
    return others.groupBy(F.col("source_id").alias("other")).agg(F.count(F.lit(1)).alias("shared")).orderBy(F.desc("shared"), "other").limit(limit)


@query("q28_sitemap_stories", f"{_FIRST_SQL} SELECT story_id, outlets, last_epoch FROM firsts WHERE outlets >= 2 AND first_epoch >= {_AS_OF_EPOCH} - 7776000 ORDER BY last_epoch DESC, story_id LIMIT 45000")
def sitemap_stories(spark: SparkSession, sf_dir: str, days: int = 90, limit: int = 45_000) -> DataFrame:
    """Multi-outlet stories of the last 90 days, newest first, at most as many as a sitemap may list."""
    s = story_heads(event_articles(spark, sf_dir)).where((F.col("outlets") >= 2) & (F.col("first_epoch") >= _AS_OF_EPOCH - days * 86400))
    return s.orderBy(F.desc("last_epoch"), "story_id").limit(limit).select("story_id", "outlets", "last_epoch")


@query(
    "q30_reading_bias",
    f"""WITH {EVENT_SQL}, reads AS (SELECT entity_id AS reader, {_BIAS} AS bias FROM articles),
    n AS (SELECT reader, count(*) AS opened, count(*) FILTER (WHERE bias <> 'unrated') AS rated, count(*) FILTER (WHERE bias = 'left') AS l, count(*) FILTER (WHERE bias = 'right') AS r FROM reads GROUP BY 1)
    SELECT reader, opened, rated, CASE WHEN rated >= 5 AND l >= 0.6 * rated AND r <= 0.15 * rated THEN 'right' WHEN rated >= 5 AND r >= 0.6 * rated AND l <= 0.15 * rated THEN 'left' END AS missing FROM n""",
)
def reading_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side that a reader's opened articles leave out, from five rated articles on."""
    reads = event_articles(spark, sf_dir).select(F.col("entity_id").alias("reader"), bias_group(F.col("source_bias")).alias("bias"))
    n = reads.groupBy("reader").agg(F.count(F.lit(1)).alias("opened"), F.count_if(F.col("bias") != "unrated").alias("rated"), F.count_if(F.col("bias") == "left").alias("l"), F.count_if(F.col("bias") == "right").alias("r"))
    return n.select("reader", "opened", "rated", perspective_gap(F.col("l"), F.col("r"), F.col("rated"), 5).alias("missing"))


@query(
    "q31_leading_segment",
    f"""WITH {EVENT_SQL}, outlets AS (SELECT DISTINCT story_id, source_id, {_BIAS} AS bias FROM articles), n AS (SELECT story_id, bias, count(*) AS n FROM outlets GROUP BY 1, 2),
    ranked AS (SELECT *, sum(n) OVER (PARTITION BY story_id) AS total, row_number() OVER (PARTITION BY story_id ORDER BY (bias = 'unrated'), n DESC, bias) AS rk FROM n)
    SELECT story_id, bias AS segment, round(n::DOUBLE / total, 6) AS share FROM ranked WHERE rk = 1 AND bias <> 'unrated'""",
)
def leading_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest rated group of outlets of every story and its share of all outlets."""
    n = outlet_coverage(event_articles(spark, sf_dir)).groupBy("story_id", "bias").agg(F.count(F.lit(1)).alias("n"))
    rated = F.when(F.col("bias") != "unrated", F.struct((-F.col("n")).alias("o"), "bias", "n"))
    best = n.groupBy("story_id").agg(F.min(rated).alias("b"), F.sum("n").alias("total")).where("b is not null")
    return best.select("story_id", F.col("b.bias").alias("segment"), F.round(F.col("b.n") / F.col("total"), 6).alias("share"))


@query(
    "q33_due_summaries",
    f"""{_FIRST_SQL}, known AS (SELECT *, CASE WHEN articles % 3 = 0 THEN NULL ELSE last_epoch - (articles % 5) * 3600 END AS summary_epoch, outlets - articles % 5 AS summary_outlets FROM firsts WHERE outlets >= 2)
    SELECT story_id, outlets, last_epoch, summary_epoch IS NULL AS is_new FROM known
    WHERE summary_epoch IS NULL OR (outlets - summary_outlets >= 3 AND last_epoch - summary_epoch > 7200) ORDER BY is_new DESC, outlets DESC, last_epoch DESC, story_id LIMIT 200""",
)
def due_summaries(spark: SparkSession, sf_dir: str, limit: int = 200) -> DataFrame:
    """The queue of stories whose summary is missing, or old with three outlets or more come in since."""
    s = story_heads(event_articles(spark, sf_dir)).where(F.col("outlets") >= 2)
    at = F.when(F.col("articles") % 3 != 0, F.col("last_epoch") - (F.col("articles") % 5) * 3600)
    s = s.withColumn("summary_epoch", at).withColumn("summary_outlets", F.col("outlets") - F.col("articles") % 5).withColumn("is_new", F.col("summary_epoch").isNull())
    due = s.where(F.col("is_new") | ((F.col("outlets") - F.col("summary_outlets") >= 3) & (F.col("last_epoch") - F.col("summary_epoch") > 7200)))
    return due.orderBy(F.desc("is_new"), F.desc("outlets"), F.desc("last_epoch"), "story_id").limit(limit).select("story_id", "outlets", "last_epoch", "is_new")


@query(
    "q34_enrichment_queue",
    f"""{_FIRST_SQL}, lead AS (SELECT story_id, arg_min(id, epoch * 1000000 + id) AS head FROM articles GROUP BY 1),
    tiers AS (SELECT a.id, a.epoch, CASE WHEN a.status = 'failed' THEN 0 WHEN f.outlets >= 2 AND a.id = l.head THEN 1 WHEN f.outlets >= 2 THEN 2 ELSE 3 END AS tier
      FROM articles a JOIN firsts f USING (story_id) JOIN lead l USING (story_id))
    SELECT id, tier FROM tiers ORDER BY tier, epoch DESC, id DESC LIMIT 500""",
)
def enrichment_queue(spark: SparkSession, sf_dir: str, limit: int = 500) -> DataFrame:
    """Articles in the order they are to be analysed: never analysed, headline, other front page, the rest."""
    a = event_articles(spark, sf_dir)
    heads = a.groupBy("story_id").agg(F.countDistinct("source_id").alias("outlets"), F.min_by("id", F.struct("epoch", "id")).alias("head"))
    many = F.col("outlets") >= 2
    tier = F.when(F.col("status") == "failed", 0).when(many & (F.col("id") == F.col("head")), 1).when(many, 2).otherwise(3)
    return a.join(heads, "story_id").withColumn("tier", tier).orderBy("tier", F.desc("epoch"), F.desc("id")).limit(limit).select("id", "tier")


@query(
    "q7_analysis_mode",
    f"""WITH {EVENT_SQL}, r AS (SELECT *, 'm' || CAST(id % 3 AS VARCHAR) AS model, id % 6 = 0 AS by_rules FROM articles WHERE status = 'succeeded' AND {_BETWEEN}),
    modal AS (SELECT model FROM r WHERE NOT by_rules GROUP BY 1 ORDER BY count(*) DESC, model LIMIT 1)
    SELECT count(*) AS analysed, count(*) FILTER (WHERE by_rules) AS by_rules, round(count(*) FILTER (WHERE by_rules)::DOUBLE / count(*), 6) AS rule_share, (SELECT model FROM modal) AS modal_model FROM r""",
)
def analysis_mode(spark: SparkSession, sf_dir: str, rng: Range = _R) -> DataFrame:
    """Share of rule-based analyses and the model used most."""
    r = event_articles(spark, sf_dir).where((F.col("status") == "succeeded") & rng.holds(F.col("published_date")))
    r = r.select(F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("model"), (F.col("id") % 6 == 0).alias("rules"))
    main = r.agg(F.count(F.lit(1)).alias("analysed"), F.count_if("rules").alias("by_rules"), F.round(F.count_if("rules") / F.count(F.lit(1)), 6).alias("rule_share"))
    modal = r.where(~F.col("rules")).groupBy("model").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "model").limit(1)
    return main.join(modal.select(F.col("model").alias("modal_model")))
