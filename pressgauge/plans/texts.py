"""Text functions and deduplication layers over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressgauge.functions import clean as C
from pressgauge.functions import text as T
from pressgauge.functions.vocabulary import ENDINGS, NOISE, STOPWORDS
from pressgauge.operators import clustering, dedup
from pressgauge.plans.bindings import event_articles
from pressgauge.session import read_table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news items: the first line is the title, an item every half hour."""
    d = read_table(spark, sf_dir, "documents")
    line = F.trim(F.split_part("text", F.lit("\n"), F.lit(1)))
    return d.select("doc_id", "source", "lang", line.alias("title"), (F.col("doc_id") * 1800).alias("epoch"), "text")


_TITLES = "titles AS (SELECT doc_id, source, lang, trim(split_part(text, chr(10), 1), ' ') AS title, doc_id * 1800 AS epoch, text FROM documents)"
_KEY = "trim(regexp_replace(replace(translate(lower({c}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), 'ß', 'ss'), '[^0-9a-z]+', ' ', 'g'), ' ')"


@query("n4_normalize_key", f"WITH {_TITLES} SELECT doc_id, {_KEY.format(c='title')} AS title_key, length({_KEY.format(c='text')}) AS text_key_length FROM titles")
def normalized_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded keys of titles and whole texts."""
    return titles(spark, sf_dir).select("doc_id", T.normalize_key(F.col("title")).alias("title_key"), F.length(T.normalize_key(F.col("text"))).alias("text_key_length"))


@query("n5_sha256", "SELECT doc_id, sha256(coalesce(source, '') || chr(31) || coalesce(text, '')) AS content_hash FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of outlet and whole text."""
    return read_table(spark, sf_dir, "documents").select("doc_id", T.sha256_of(F.col("source"), F.col("text")).alias("content_hash"))


@query(
    "n6_canonical_url",
    r"""WITH p AS (SELECT page_id, url || '?utm_source=x&b=2&a=' || CAST(page_id % 3 AS VARCHAR) || '&fbclid=9&dclid=1&_ga=2&pk_kw=3&MTM_x=4&ref_src=5&amp=1&page=' || CAST(page_id AS VARCHAR) || '#top' AS url FROM pages)
    SELECT page_id, 'https://' || regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1, 'i')), '^www\.', '') ||
      regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1, 'i'), '(/amp)?/+$|/amp$', '') || '?' ||
      array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^(utm_|pk_|mtm_)') AND lower(split_part(x, '=', 1)) NOT IN ('fbclid', 'gclid', 'dclid', 'msclkid', 'mc_cid', 'mc_eid', 'igshid', 'ocid', 'ref', 'ref_src', '_ga', '_gl', 'amp', 'output', 'share', 's_cid', 'cmpid', 'yclid'))), '&') AS canonical,
      regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1, 'i')), '^www\.', '') AS host FROM p""",
)
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses with tracking parameters put on, made canonical."""
    url = F.concat("url", F.lit("?utm_source=x&b=2&a="), (F.col("page_id") % 3).cast("string"), F.lit("&fbclid=9&dclid=1&_ga=2&pk_kw=3&MTM_x=4&ref_src=5&amp=1&page="), F.col("page_id").cast("string"), F.lit("#top"))
    p = read_table(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    return p.select("page_id", T.canonical_url(F.col("url")).alias("canonical"), T.url_host(F.col("url")).alias("host"))


@query("n12_title_distance")
def title_distances(spark: SparkSession, sf_dir: str, limit: int = 2) -> DataFrame:
    """Edit distance between neighbouring whole titles' keys, ``limit + 1`` where it exceeds the limit."""
    t = titles(spark, sf_dir).select("doc_id", T.normalize_key(F.col("title")).alias("t"))
    n = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return t.join(n, "doc_id").select("doc_id", T.bounded_distance(F.col("t"), F.col("u"), limit).alias("distance"))


@query(
    "n13_title_similarity",
    f"""WITH {_TITLES}, k AS (SELECT doc_id, list_distinct(flatten(list_transform(list_filter(string_split({_KEY.format(c='title')}, ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM titles)
    SELECT a.doc_id, round(coalesce(len(list_intersect(a.g, b.g))::DOUBLE / nullif(len(list_distinct(list_concat(a.g, b.g))), 0), 0), 6) AS similarity FROM k a JOIN k b ON b.doc_id = a.doc_id + 7""",
)
def title_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram similarity of whole titles seven items apart."""
    k = titles(spark, sf_dir).select("doc_id", T.trigrams(T.normalize_key(F.col("title"))).alias("g"))
    n = k.select((F.col("doc_id") - 7).alias("doc_id"), F.col("g").alias("h"))
    return k.join(n, "doc_id").select("doc_id", F.round(T.jaccard(F.col("g"), F.col("h")), 6).alias("similarity"))


def _stem_sql(w: str) -> str:
    """The stem of a word in SQL."""
    cut = f"substr({w}, 1, 6)"
    endings = " ".join(f"WHEN ends_with({cut}, '{e}') AND length({cut}) - {len(e)} >= 3 THEN substr({cut}, 1, length({cut}) - {len(e)})" for e in ENDINGS)
    return f"CASE WHEN regexp_matches({w}, '[0-9]') THEN {w} {endings} ELSE {cut} END"


_DULL = ", ".join(f"'{w}'" for w in sorted(STOPWORDS | NOISE))


@query(
    "n17_tokens",
    f"""WITH {_TITLES}, w AS (SELECT doc_id, list_filter(string_split({_KEY.format(c='title')}, ' '), lambda w: CASE WHEN regexp_full_match(w, '[0-9]+') THEN length(w) >= 2 ELSE length(w) >= 3 AND NOT list_contains([{_DULL}], w) END) AS words FROM titles)
    SELECT doc_id, array_to_string(list_transform(words, lambda w: {_stem_sql('w')}), ' ') AS tokens FROM w""",
)
def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stemmed title tokens."""
    return titles(spark, sf_dir).select("doc_id", F.array_join(T.tokens(F.col("title")), " ").alias("tokens"))


@query(
    "n24_keyword_classes",
    f"""WITH {_TITLES}, k AS (SELECT doc_id, {_KEY.format(c='text')} AS k FROM titles),
    n AS (SELECT doc_id, len(regexp_extract_all(k, '\\b(tion|ing)[a-z]*')) AS a, len(regexp_extract_all(k, '\\b(her|oth|the)[a-z]*')) AS b, len(regexp_extract_all(k, '\\b(at|on|in)[a-z]*')) AS c,
      len(regexp_extract_all(k, '\\b(hea|sha)[a-z]*')) AS pos, len(regexp_extract_all(k, '\\b(idiot|trash|scum)[a-z]*')) AS neg FROM k)
    SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN NULL WHEN a >= b AND a >= c THEN 'reports' WHEN b >= c THEN 'people' ELSE 'places' END AS class, round(greatest(-0.9::DOUBLE, least(0.9::DOUBLE, (pos - neg) * 0.3::DOUBLE)), 6) AS tone FROM n""",
)
def keyword_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule-based class and tone of whole texts."""
    return T.classified(titles(spark, sf_dir).select("doc_id", T.normalize_key(F.col("text")).alias("key")), "doc_id", "key")


@query("d1_last_in_batch", "SELECT user_id AS source_id, event_id % 500 AS item_key, max(event_id) AS kept FROM events GROUP BY 1, 2")
def last_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of items with one outlet and key the last of the batch stays."""
    a = event_articles(spark, sf_dir, hidden=True).select("source_id", (F.col("id") % 500).alias("item_key"), "id")
    return dedup.keep_last(a, ["source_id", "item_key"], "id").select("source_id", "item_key", F.col("id").alias("kept"))


@query("d2_same_address", "SELECT md5(split_part(url, '?', 1)) AS address, min(page_id) AS kept, count(*) - 1 AS dropped FROM pages GROUP BY 1")
def same_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of pages with one address the earliest stays."""
    p = read_table(spark, sf_dir, "pages").groupBy(F.md5(F.split_part("url", F.lit("?"), F.lit(1)).cast("binary")).alias("address"))
    return p.agg(F.min("page_id").alias("kept"), (F.count(F.lit(1)) - 1).alias("dropped"))


@query("d3_title_copies")
def title_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of one outlet whose title an accepted item within 48 hours already had."""
    t = titles(spark, sf_dir).select("doc_id", "source", F.sha2(T.normalize_key(F.col("title")), 256).alias("hash"), "epoch")
    return dedup.accepted_chain(t, ["source", "hash"], "epoch", "doc_id", 48 * 3600)


@query("d4_headline_revisions")
def headline_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items folded into an earlier one of the same outlet with almost the same headline within three hours."""
    a = event_articles(spark, sf_dir)
    words = F.concat_ws(" ", "topic", F.lit("report of the day number"), (F.floor(F.col("epoch") / 7200) % 50).cast("string"), F.when(F.col("id") % 3 == 0, "corrected"))
    return dedup.fold_revisions(a.select("id", "source_id", "epoch", words.alias("title")))


@query(
    "d5_cross_source_copies",
    """WITH d AS (SELECT doc_id, source, text, min(doc_id) OVER (PARTITION BY text) AS root FROM documents)
    SELECT d.doc_id, d.root FROM d JOIN documents r ON r.doc_id = d.root WHERE d.doc_id <> d.root AND d.source <> r.source""",
)
def cross_source_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbatim copies in other outlets, linked to the first; both rows stay."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    roots = d.groupBy("h").agg(F.min_by("source", "doc_id").alias("root_source"), F.min("doc_id").alias("root"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return d.join(roots, "h").where((F.col("doc_id") != F.col("root")) & (F.col("source") != F.col("root_source"))).select("doc_id", "root")


@query("d5_near_copies")
def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose title another outlet had almost word for word within 48 hours, linked to the root; both rows stay."""
    t = titles(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", "epoch", T.normalize_key(F.col("title")).alias("key"))
    return dedup.cross_outlet_copies(t)


@query(
    "d6_enrichment_cache",
    """WITH e AS (SELECT event_id AS id, md5(event_type || '|' || CAST(event_id % 40 AS VARCHAR)) AS input_hash FROM events)
    SELECT id, input_hash, lag(id) OVER (PARTITION BY input_hash ORDER BY id) AS reused_from FROM e""",
)
def enrichment_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest earlier result with the same input, never the item's own."""
    a = event_articles(spark, sf_dir, hidden=True).select("id", F.md5(F.concat_ws("|", "topic", (F.col("id") % 40).cast("string")).cast("binary")).alias("input_hash"))
    return a.withColumn("reused_from", F.lag("id").over(Window.partitionBy("input_hash").orderBy("id")))


@query(
    "d7_validation",
    f"""WITH {_TITLES} SELECT doc_id, CASE WHEN title = '' THEN 'rejected' WHEN length(title) < 15 THEN 'rejected' WHEN doc_id % 97 = 0 THEN 'rejected' ELSE 'accepted' END AS status,
      CASE WHEN title = '' THEN 'missing_title' WHEN length(title) < 15 THEN 'title_too_short' WHEN doc_id % 97 = 0 THEN 'missing_url' END AS reason FROM titles""",
)
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One terminal state with its reason for every item, the first rule that fails deciding."""
    reason = F.when(F.col("title") == "", "missing_title").when(F.length("title") < 15, "title_too_short").when(F.col("doc_id") % 97 == 0, "missing_url")
    return titles(spark, sf_dir).select("doc_id", F.when(reason.isNull(), "accepted").otherwise("rejected").alias("status"), reason.alias("reason"))


@query("n19_document_terms")
def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF weights of titles and beginnings of texts."""
    return clustering.vectors(clustering.terms(titles(spark, sf_dir).select("doc_id", "title", "text"))).select("doc_id", "term", F.round("w", 6).alias("weight"))


@query("n1_clean_text")
def cleaned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of pages without markup, and its excerpt."""
    text = C.clean_text(F.col("html"))
    return read_table(spark, sf_dir, "pages").select("page_id", text.alias("text")).select("page_id", F.length("text").alias("characters"), C.excerpt(F.col("text")).alias("excerpt"))


@query(
    "n9_resolved_times",
    """WITH e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seen, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 1000 WHEN 2 THEN CAST(floor(epoch(ts)) AS BIGINT) + 700 ELSE CAST(floor(epoch(ts)) AS BIGINT) - 60 END AS parsed FROM events),
    j AS (SELECT *, CASE WHEN parsed IS NULL THEN 'missing' WHEN parsed < 946684800 THEN 'too_old' WHEN parsed > seen + 600 THEN 'in_future' END AS issue FROM e)
    SELECT event_id, CASE WHEN issue IS NULL THEN parsed ELSE seen END AS published, issue IS NOT NULL AS estimated, issue FROM j""",
)
def resolved_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication times with implausible ones replaced."""
    e = event_articles(spark, sf_dir, hidden=True).select(F.col("id").alias("event_id"), F.col("epoch").alias("seen"))
    k = F.col("event_id") % 5
    e = e.withColumn("parsed", F.when(k == 0, F.lit(None)).when(k == 1, F.lit(1000)).when(k == 2, F.col("seen") + 700).otherwise(F.col("seen") - 60))
    at, estimated, issue = C.resolved_time(F.col("parsed"), F.col("seen"))
    return e.select("event_id", at.alias("published"), estimated.alias("estimated"), issue.alias("issue"))


@query(
    "n10_item_keys",
    f"""WITH {_TITLES} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'g' || doc_id WHEN doc_id % 3 = 1 THEN md5('link' || doc_id) ELSE md5(title || '|' || epoch) END AS item_key FROM titles""",
)
def item_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item's identity: its own id, else its link, else title and time."""
    i, own = F.col("doc_id"), F.col("doc_id").cast("string")
    guid = F.when(i % 3 == 0, F.concat(F.lit("g"), own))
    link = F.when(i % 3 == 1, F.md5(F.concat(F.lit("link"), own).cast("binary")))
    last = F.md5(F.concat_ws("|", "title", F.col("epoch").cast("string")).cast("binary"))
    return titles(spark, sf_dir).select("doc_id", F.coalesce(guid, link, last).alias("item_key"))


@query(
    "n25_rule_entities",
    r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b[A-Z][a-z]+(?: [A-Z][a-z]+)+'))) AS name FROM documents",
)
def rule_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of capitalised words of every text."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+"), F.lit(0)))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.explode(names).alias("name"))


@query(
    "n35_quota_pacing",
    "SELECT user_id, count(*) AS used, greatest(ceil(greatest(100 - count(*), 0)::DOUBLE / greatest(user_id % 7, 1)), 1)::BIGINT AS next_run FROM events GROUP BY 1",
)
def quota_pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls per outlet that the next run may make."""
    n = event_articles(spark, sf_dir, hidden=True).groupBy(F.col("source_id").alias("user_id")).agg(F.count(F.lit(1)).alias("used"))
    return n.select("user_id", "used", C.quota_per_run(F.col("used"), F.lit(100), F.col("user_id") % 7).cast("long").alias("next_run"))
