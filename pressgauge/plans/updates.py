"""Writes, repairs, validation and membership filters over the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressgauge.functions import checks as V
from pressgauge.operators import sinks
from pressgauge.plans.bindings import AS_OF, EVENT_SQL, event_articles
from pressgauge.session import read_table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


@query("f3_outlets_and_ids", f"WITH {EVENT_SQL} SELECT source_id, count(*) AS articles FROM articles WHERE source_id IN (1, 3, 5, 8) OR id IN (4, 77, 4235) GROUP BY 1")
def outlets_and_ids(spark: SparkSession, sf_dir: str, outlets: tuple[int, ...] = (1, 3, 5, 8), ids: tuple[int, ...] = (4, 77, 4235)) -> DataFrame:
    """Articles of a list of outlets or of a list of ids, per outlet."""
    a = event_articles(spark, sf_dir).where(F.col("source_id").isin(*outlets) | F.col("id").isin(*ids))
    return a.groupBy("source_id").agg(F.count(F.lit(1)).alias("articles"))


CONNECTORS = ("ring", "small", "large")


@query("f9_connector_names", f"SELECT p_partkey AS entity_id, p_name AS name FROM part WHERE list_has_any(string_split(p_name, ' '), {list(CONNECTORS)})")
def connector_names(spark: SparkSession, sf_dir: str, connectors: tuple[str, ...] = CONNECTORS) -> DataFrame:
    """Entities whose name holds one of the connecting words."""
    p = read_table(spark, sf_dir, "part")
    return p.where(F.arrays_overlap(F.split("p_name", " "), F.array(*map(F.lit, connectors)))).select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))


@query("f11_visible_images", "SELECT s_suppkey AS source_id, s_acctbal >= 0 AS show_images, CASE WHEN s_acctbal >= 0 THEN 'https://img.example/' || s_name END AS image_url FROM supplier")
def visible_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outlet's image, only where it lets images be shown."""
    show = F.col("s_acctbal") >= 0
    return read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("source_id"), show.alias("show_images"), F.when(show, F.concat(F.lit("https://img.example/"), "s_name")).alias("image_url")
    )


@query(
    "f12_lens_regions",
    """WITH n AS (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY c DESC, s_nationkey) AS place FROM n)
    SELECT CASE WHEN place <= 5 THEN CAST(s_nationkey AS VARCHAR) ELSE 'other' END AS region, CAST(sum(c) AS BIGINT) AS outlets FROM r GROUP BY 1""",
)
def lens_regions(spark: SparkSession, sf_dir: str, most: int = 5) -> DataFrame:
    """Outlets by region; regions after the largest few are one group."""
    n = read_table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("c"))
    largest = n.orderBy(F.desc("c"), "s_nationkey").limit(most).select(F.col("s_nationkey").alias("k"))
    named = n.join(F.broadcast(largest), n["s_nationkey"] == F.col("k"), "left")
    return named.groupBy(F.coalesce(F.col("k").cast("string"), F.lit("other")).alias("region")).agg(F.sum("c").alias("outlets"))


#: Orders that a page may be asked for; nothing else reaches the plan.
SORTS = {"newest": ("epoch", False), "oldest": ("epoch", True), "tone": ("score", False)}


@query("k2_sorted_page", f"WITH {EVENT_SQL} SELECT id, round(score, 6) AS score FROM articles ORDER BY articles.score DESC, id LIMIT 25")
def sorted_page(spark: SparkSession, sf_dir: str, sort: str = "tone", limit: int = 25) -> DataFrame:
    """A page in one of the allowed orders; an unknown one is refused."""
    if sort not in SORTS:
        raise ValueError(f"unknown order: {sort}")
    column, ascending = SORTS[sort]
    return event_articles(spark, sf_dir).orderBy([column, "id"], ascending=[ascending, True]).limit(limit).select("id", F.round("score", 6).alias("score"))


_STATE = "SELECT o_orderkey AS item_key, o_orderstatus AS status, o_totalprice AS total, 0 AS fetched FROM orders WHERE o_orderkey % 3 <> 0"
_BATCH = "SELECT o_orderkey AS item_key, o_orderstatus AS status, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS total, 1 AS fetched FROM orders WHERE o_orderkey % 2 = 0"


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A stored state and a batch of fetched items, of which some are new and some have changed."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    k = F.col("item_key")
    batch = o.where(k % 2 == 0).withColumn("total", F.when(k % 5 == 0, F.col("total") + 1).otherwise(F.col("total")))
    return o.where(k % 3 != 0).withColumn("fetched", F.lit(0)), batch.withColumn("fetched", F.lit(1))


@query(
    "s10_upserted_state",
    f"""WITH s AS ({_STATE}), b AS ({_BATCH}), j AS (SELECT coalesce(s.item_key, b.item_key) AS item_key, CASE WHEN b.item_key IS NULL THEN 'kept' WHEN s.item_key IS NULL THEN 'inserted'
      WHEN s.total IS DISTINCT FROM b.total OR s.status IS DISTINCT FROM b.status THEN 'changed' ELSE 'unchanged' END AS action, s.status AS s1, b.status AS b1, s.total AS s2, b.total AS b2, s.fetched AS s3, b.fetched AS b3
      FROM s FULL JOIN b ON s.item_key = b.item_key)
    SELECT item_key, action, CASE WHEN action IN ('inserted', 'changed') THEN b1 ELSE s1 END AS status, CASE WHEN action IN ('inserted', 'changed') THEN b2 ELSE s2 END AS total, CASE WHEN action IN ('inserted', 'changed') THEN b3 ELSE s3 END AS fetched FROM j""",
)
def upserted_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item table after a fetch: new items in, changed ones replaced and queued again, others as they were."""
    state, batch = _stored(spark, sf_dir)
    return sinks.upsert(state, batch.unionByName(batch.withColumn("fetched", F.lit(0)).withColumn("total", F.lit(0.0))), ["item_key"], "fetched", ["status", "total"])


@query("s11_inserted_once", f"WITH s AS ({_STATE}), b AS ({_BATCH}) SELECT * FROM b WHERE item_key NOT IN (SELECT item_key FROM s)")
def inserted_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a batch that are new to the state; a key that is there is left alone."""
    state, batch = _stored(spark, sf_dir)
    return sinks.insert_ignore(state, batch.unionByName(batch.withColumn("fetched", F.lit(2))), ["item_key"], "fetched")


_PAIRS = "SELECT p_partkey AS old, p_partkey - p_partkey % 4 AS new FROM part WHERE p_partkey % 4 <> 0"


@query(
    "d14_moved_links",
    f"""WITH pairs AS ({_PAIRS}), moved AS (SELECT DISTINCT l_orderkey AS id, coalesce(new, l_partkey) AS entity_id FROM lineitem LEFT JOIN pairs ON l_partkey = old)
    SELECT entity_id, count(*) AS links FROM moved GROUP BY 1""",
)
def moved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links per entity after forms of one name were merged."""
    li = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("entity_id"))
    key = F.col("p_partkey")
    pairs = read_table(spark, sf_dir, "part").where(key % 4 != 0).select(key.alias("old"), (key - key % 4).alias("new"))
    return sinks.move_links(li, pairs, "id", "entity_id").groupBy("entity_id").agg(F.count(F.lit(1)).alias("links"))


@query("d14_orphans", "SELECT c_custkey AS entity_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01')")
def orphan_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities without a link since a day."""
    links = read_table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1998-06-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("entity_id"))
    return sinks.orphans(read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id")), links, "entity_id")


_URLS = """urls AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'ftp://a.example/x' WHEN 1 THEN 'http://user:pw@a.example/' WHEN 2 THEN 'https://localhost/x' WHEN 3 THEN 'http://192.168.0.7/feed'
  WHEN 4 THEN 'https:///nohost' WHEN 5 THEN 'http://news.internal/a' WHEN 6 THEN 'http://8.8.8.8/feed' ELSE url END AS url FROM pages)"""


@query(
    "n7_url_issues",
    f"""WITH {_URLS} SELECT page_id, CASE WHEN page_id % 8 = 0 THEN 'unsupported_scheme' WHEN page_id % 8 = 1 THEN 'credentials' WHEN page_id % 8 IN (2, 5) THEN 'local_host' WHEN page_id % 8 = 3 THEN 'private_address'
      WHEN page_id % 8 = 4 THEN 'missing_host' END AS issue FROM urls""",
)
def url_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an address may not be fetched or linked, null where it may."""
    i = F.col("page_id") % 8
    bad = ("ftp://a.example/x", "http://user:pw@a.example/", "https://localhost/x", "http://192.168.0.7/feed", "https:///nohost", "http://news.internal/a", "http://8.8.8.8/feed")
    url = F.coalesce(*[F.when(i == k, F.lit(b)) for k, b in enumerate(bad)], F.col("url"))
    return read_table(spark, sf_dir, "pages").select("page_id", V.url_issue(url).alias("issue"))


@query(
    "n8_parsed_dates",
    "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(floor(epoch(ts)) AS BIGINT) - CASE event_id % 5 WHEN 2 THEN 7200 ELSE 0 END END AS epoch FROM events",
)
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times from the texts that feeds give: RFC 822, ISO 8601 with an offset, with Z or with none (UTC); others are null."""
    e = read_table(spark, sf_dir, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("t"))
    i = F.col("event_id") % 5
    text = (
        F.when(i == 0, F.date_format("t", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(i == 1, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(i == 2, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .when(i == 3, F.date_format("t", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.lit("yesterday"))
    )
    return e.select("event_id", F.unix_timestamp(V.feed_time(text)).alias("epoch"))


@query("n27_proper_names", r"SELECT p_partkey AS entity_id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part WHERE p_partkey % 3 = 0 AND len(list_filter(string_split(upper(p_name), ' '), lambda w: regexp_matches(w, '^[A-Z0-9]'))) > 0")
def proper_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in which some word begins with a capital or a digit."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    p = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), name.alias("name"))
    return p.where(V.is_proper_name(F.col("name")))


@query(
    "n30_repaired_output",
    """WITH j AS (SELECT event_id, value / 50 AS tone, event_type AS label, ['C' || user_id % 3, 'c' || user_id % 3, 'XYZ'] AS countries FROM events)
    SELECT event_id, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, tone)), 6) AS tone, array_to_string(list_sort(list_distinct(list_filter(list_transform(countries, lambda c: upper(c)), lambda c: length(c) = 2))), ',') AS countries,
      CASE WHEN (label = 'error' AND tone > 0.15) OR (label = 'purchase' AND tone < -0.15) THEN 'neutral' ELSE label END AS label, tone > 1 OR tone < -1 AS clamped FROM j""",
)
def repaired_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output made valid: tones clamped, country codes of two letters once each, a label that its tone contradicts neutral."""
    e = read_table(spark, sf_dir, "events")
    country = lambda c: F.concat(F.lit(c), (F.col("user_id") % 3).cast("string"))
    tone = F.col("value") / 50
    contradiction = ((F.col("event_type") == "error") & (tone > 0.15)) | ((F.col("event_type") == "purchase") & (tone < -0.15))
    return e.select(
        "event_id",
        F.round(V.clamped(tone), 6).alias("tone"),
        F.array_join(V.country_codes(F.array(country("C"), country("c"), F.lit("XYZ"))), ",").alias("countries"),
        F.when(contradiction, "neutral").otherwise(F.col("event_type")).alias("label"),
        ((tone > 1) | (tone < -1)).alias("clamped"),
    )


@query(
    "n31_parsed_json",
    """WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{"k": "x"}' WHEN 2 THEN '{"k": ' ELSE '[1]' END AS raw, props FROM events)
    SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 4 <> 0 OR json_extract(props, '$.k') IS NULL AS invalid FROM t""",
)
def parsed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of JSON text; text that does not parse, or has another type there, is marked and stays."""
    i = F.col("event_id") % 4
    raw = F.when(i == 0, F.col("props")).when(i == 1, F.lit('{"k": "x"}')).when(i == 2, F.lit('{"k": ')).otherwise(F.lit("[1]"))
    k = F.from_json(raw, "k long", {"mode": "PERMISSIVE"})["k"]
    return read_table(spark, sf_dir, "events").select("event_id", k.alias("k"), k.isNull().alias("invalid"))


@query(
    "n40_json_fields",
    """SELECT event_id, json_extract_string(props, '$.k') AS k, json_array_length('[' || event_id % 3 || ',2]') AS items, '{"id":' || event_id || ',"topic":"' || event_type || '"}' AS packed FROM events""",
)
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON field as text, the length of a JSON list, and columns packed to JSON."""
    listed = F.concat(F.lit("["), (F.col("event_id") % 3).cast("string"), F.lit(",2]"))
    packed = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("topic")))
    return read_table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.json_array_length(listed).cast("long").alias("items"), packed.alias("packed"))


@query(
    "d11_refreshed_stories",
    f"""WITH {EVENT_SQL}, t AS (SELECT story_id, topic, named_country, count(*) AS n FROM articles GROUP BY 1, 2, 3), m AS (SELECT story_id, named_country, row_number() OVER (PARTITION BY story_id ORDER BY n DESC, named_country) AS rk FROM t)
    SELECT a.story_id, min(a.epoch) AS first_epoch, max(a.epoch) AS last_epoch, CAST(min(a.published_date) AS VARCHAR) AS day, min(m.named_country) AS modal_country,
      coalesce(max(CASE WHEN a.id % 13 = 0 THEN a.id END), min(a.id)) AS representative FROM articles a JOIN m ON a.story_id = m.story_id AND rk = 1 GROUP BY 1""",
)
def refreshed_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span, local day, most frequent country and representative of every story; a stored representative stays if it is a member."""
    a = event_articles(spark, sf_dir)
    modal = a.groupBy("story_id", "named_country").agg(F.count(F.lit(1)).alias("n"))
    modal = modal.groupBy("story_id").agg(F.min(F.struct(-F.col("n"), "named_country")).alias("m")).select("story_id", F.col("m.named_country").alias("modal_country"))
    stored = F.max(F.when(F.col("id") % 13 == 0, F.col("id")))
    span = a.groupBy("story_id").agg(
        F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"), F.min("published_date").cast("string").alias("day"), F.coalesce(stored, F.min("id")).alias("representative")
    )
    return span.join(modal, "story_id")


@query(
    "x4_backfilled_images",
    """WITH new AS (SELECT page_id, regexp_extract(html, '<img[^>]*src="([^"]+)"', 1) AS found FROM pages)
    SELECT p.page_id, coalesce(CASE WHEN p.page_id % 2 = 0 THEN 'kept-' || p.page_id END, nullif(new.found, '')) AS image_url FROM pages p LEFT JOIN new USING (page_id)""",
)
def backfilled_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images filled in from the pages' own; a stored one is never overwritten."""
    p = read_table(spark, sf_dir, "pages")
    found = F.nullif(F.regexp_extract("html", '<img[^>]*src="([^"]+)"', 1), F.lit(""))
    stored = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("kept-"), F.col("page_id").cast("string")))
    return p.select("page_id", F.coalesce(stored, found).alias("image_url"))


@query(
    "x6_newest_wording",
    f"""WITH {EVENT_SQL} SELECT coalesce(duplicate_of_id, id) AS root, arg_max(topic || ' ' || id, epoch * 1000000 + id) AS title, arg_max(CASE WHEN id % 2 = 0 THEN 'x' || id END, epoch * 1000000 + id) FILTER (WHERE id % 2 = 0) AS excerpt FROM articles_all GROUP BY 1""",
)
def newest_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root takes the title of its newest revision, and its excerpt if one of them has any."""
    a = event_articles(spark, sf_dir, hidden=True)
    at = F.struct("epoch", "id")
    own = F.col("id").cast("string")
    return a.groupBy(F.coalesce("duplicate_of_id", "id").alias("root")).agg(
        F.max_by(F.concat_ws(" ", "topic", own), at).alias("title"), F.max_by(F.concat(F.lit("x"), own), F.when(F.col("id") % 2 == 0, at)).alias("excerpt")
    )


@query("x13_methods", "SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'rules' ELSE 'ai' END AS method, count(*) AS n FROM events GROUP BY 1, 2")
def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether rules or a model made an analysis, by its provider."""
    e = read_table(spark, sf_dir, "events").withColumn("provider", F.when(F.col("user_id") % 3 == 0, "rules").otherwise("model"))
    return e.groupBy("user_id", F.when(F.col("provider") == "rules", "rules").otherwise("ai").alias("method")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "x15_attempt_states",
    """WITH t AS (SELECT event_id % 5000 AS article_id, event_id, event_type, row_number() OVER (PARTITION BY event_id % 5000 ORDER BY event_id) AS attempt, row_number() OVER (PARTITION BY event_id % 5000 ORDER BY event_id DESC) AS back, count(*) OVER (PARTITION BY event_id % 5000) AS n FROM events)
    SELECT article_id, event_id AS current_attempt, n AS attempts, CASE WHEN event_type = 'error' AND n >= 3 THEN 'failed' WHEN event_type = 'error' THEN 'pending' WHEN event_type = 'click' THEN 'skipped' ELSE 'succeeded' END AS status FROM t WHERE back = 1""",
)
def attempt_states(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    """The current attempt of every article and the state that it leads to: errors wait until attempts are used up, refusals are skipped."""
    e = read_table(spark, sf_dir, "events")
    last = e.groupBy((F.col("event_id") % 5000).alias("article_id")).agg(F.max("event_id").alias("current_attempt"), F.count(F.lit(1)).alias("attempts"), F.max_by("event_type", "event_id").alias("outcome"))
    state = F.when((F.col("outcome") == "error") & (F.col("attempts") >= most), "failed").when(F.col("outcome") == "error", "pending").when(F.col("outcome") == "click", "skipped").otherwise("succeeded")
    return last.select("article_id", "current_attempt", "attempts", state.alias("status"))


@query("x17_requeued", f"WITH {EVENT_SQL} SELECT id FROM articles_all WHERE id IN (4, 77, 4235) OR source_id < 3 OR (status = 'failed' AND topic = 'error')")
def requeued(spark: SparkSession, sf_dir: str, ids: tuple[int, ...] = (4, 77, 4235), prompt_before: int = 3) -> DataFrame:
    """Articles to analyse again: by id, by an old prompt, or failed."""
    a = event_articles(spark, sf_dir, hidden=True)
    return a.where(F.col("id").isin(*ids) | (F.col("source_id") < prompt_before) | ((F.col("status") == "failed") & (F.col("topic") == "error"))).select("id")


@query("x19_spent_today", f"SELECT round(coalesce(sum(value), 0), 6) AS spent FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AND ts < TIMESTAMP '{AS_OF}'")
def spent_today(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    """Cost since midnight UTC of the day that ends at ``as_of``."""
    end = F.lit(as_of).cast("timestamp_ntz")
    e = read_table(spark, sf_dir, "events").where((F.col("ts") >= end - F.expr("INTERVAL 1 DAY")) & (F.col("ts") < end))
    return e.agg(F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 6).alias("spent"))


@query(
    "x22_registry_issues",
    """WITH r AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN 'twice' ELSE s_name END AS slug, s_acctbal > 0 AS rated, CASE WHEN s_suppkey % 2 = 0 THEN 'note' END AS note, CASE WHEN s_suppkey % 7 <> 0 THEN 'https://feed' END AS feed FROM supplier),
    c AS (SELECT slug, count(*) AS n FROM r GROUP BY 1)
    SELECT id, array_to_string(list_filter([CASE WHEN rated AND note IS NULL THEN 'rating_without_note' END, CASE WHEN feed IS NULL THEN 'enabled_without_feed' END, CASE WHEN n > 1 THEN 'slug_not_unique' END], lambda x: x IS NOT NULL), ',') AS issues FROM r JOIN c USING (slug)""",
)
def registry_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with entries of the outlet registry."""
    i = F.col("s_suppkey")
    r = read_table(spark, sf_dir, "supplier").select(
        i.alias("id"), F.when(i % 9 == 0, "twice").otherwise(F.col("s_name")).alias("slug"), (F.col("s_acctbal") > 0).alias("rated"), F.when(i % 2 == 0, "note").alias("note"), F.when(i % 7 != 0, "https://feed").alias("feed")
    )
    repeated = r.groupBy("slug").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = r.join(repeated, "slug", "left")
    issues = F.array_compact(
        F.array(
            F.when(F.col("rated") & F.col("note").isNull(), "rating_without_note"), F.when(F.col("feed").isNull(), "enabled_without_feed"), F.when(F.col("n").isNotNull(), "slug_not_unique")
        )
    )
    return found.select("id", F.array_join(issues, ",").alias("issues"))


@query(
    "t13_sent_alerts",
    """WITH RECURSIVE a AS (SELECT DISTINCT event_type AS key, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour FROM events WHERE event_type = 'error'),
    sent(key, hour) AS (SELECT key, min(hour) FROM a GROUP BY 1 UNION ALL SELECT s.key, (SELECT min(b.hour) FROM a b WHERE b.key = s.key AND b.hour > s.hour + 6) FROM sent s WHERE (SELECT min(b.hour) FROM a b WHERE b.key = s.key AND b.hour > s.hour + 6) IS NOT NULL)
    SELECT key, count(*) AS sent FROM sent GROUP BY 1""",
)
def sent_alerts(spark: SparkSession, sf_dir: str, quiet: int = 6) -> DataFrame:
    """Alerts that go out: one is held back while the last of its key that went out is at most six hours old."""
    from pressgauge.operators import dedup

    e = read_table(spark, sf_dir, "events").where("event_type = 'error'")
    a = e.select(F.col("event_type").alias("key"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("hour")).distinct()
    # One alert a key and hour, so the hour numbers it within its key.
    held = dedup.accepted_chain(a.withColumn("id", F.col("hour")), ["key"], "hour", "id", quiet)
    out = a.join(held, a["hour"] == held["item"], "left_anti")
    return out.groupBy("key").agg(F.count(F.lit(1)).alias("sent"))


@query(
    "d7_validated_items",
    r"""WITH p AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')) AS title, url FROM pages)
    SELECT page_id, CASE WHEN title = '' THEN 'missing_title' WHEN length(title) < 15 THEN 'title_too_short' WHEN url IS NULL OR url = '' THEN 'missing_url' WHEN NOT regexp_matches(url, '^https?://[^/?#]+') THEN 'invalid_url' ELSE 'accepted' END AS state FROM p""",
)
def validated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One terminal state for every fetched page, from its own title and address; the first rule that fails decides."""
    title = F.trim(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r"\s+", " "))
    state = (
        F.when(title == "", "missing_title")
        .when(F.length(title) < 15, "title_too_short")
        .when(F.coalesce("url", F.lit("")) == "", "missing_url")
        .when(V.url_issue(F.col("url")).isNotNull(), "invalid_url")
        .otherwise("accepted")
    )
    return read_table(spark, sf_dir, "pages").select("page_id", state.alias("state"))


@query(
    "q22_title_search",
    r"""WITH p AS (SELECT page_id, trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^0-9a-z]+', ' ', 'g')) AS key FROM pages) SELECT page_id FROM p WHERE contains(key, 'the') ORDER BY page_id DESC LIMIT 20""",
)
def title_search(spark: SparkSession, sf_dir: str, text: str = "The", limit: int = 20) -> DataFrame:
    """Pages whose folded title holds the folded words of a search, newest first."""
    key = F.trim(F.regexp_replace(F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), "[^0-9a-z]+", " "))
    wanted = F.trim(F.regexp_replace(F.lower(F.lit(text)), "[^0-9a-z]+", " "))
    return read_table(spark, sf_dir, "pages").where(F.contains(key, wanted)).select("page_id").orderBy(F.desc("page_id")).limit(limit)


@query(
    "x5_first_images",
    """WITH c AS (SELECT user_id, event_id, regexp_extract(props, '"k":\\s*(-?\\d+)', 1) AS k FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rk FROM c WHERE k <> '') SELECT user_id, k AS image FROM r WHERE rk = 1""",
)
def first_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest captured value of every outlet."""
    k = F.regexp_extract("props", r'"k":\s*(-?\d+)', 1)
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", k.alias("k")).where("k <> ''")
    return e.groupBy("user_id").agg(F.max_by("k", "event_id").alias("image"))
