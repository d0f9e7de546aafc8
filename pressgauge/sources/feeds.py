"""Reading feeds and pages: RSS, Atom and news sitemaps to fixed columns, feed links of pages, and field profiles."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.session import read_table

QUERIES, ORACLE = {}, {}
ENTRY = "file string, title string, link string, id string, summary string, published string, author string, tags array<string>, image string, malformed boolean"
#: Longest field kept, and most tags.
CLIP, TAGS = 20_000, 20


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _first(node: ET.Element, *names: str) -> str | None:
    for child in node.iter():
        if child is not node and _local(child.tag) in names and (child.text or "").strip():
            return child.text.strip()[:CLIP]
    return None


def _entry(node: ET.Element) -> dict:
    links = [c for c in node if _local(c.tag) == "link"]
    href = next((c.get("href") for c in links if c.get("href") and c.get("rel", "alternate") == "alternate"), None)
    pictures = {_local(c.tag): c for c in reversed(list(node.iter())) if c.get("url")}
    image = next((pictures[k].get("url") for k in ("content", "thumbnail", "enclosure") if k in pictures), None)
    summary = _first(node, "description", "summary", "encoded")
    if image is None and (found := re.search(r"<img[^>]+src=[\"']([^\"']+)", summary or "")):
        image = found[1]
    tags = [t for c in node if _local(c.tag) == "category" and (t := (c.get("term") or c.text or "").strip())]
    return {
        "title": _first(node, "title"), "link": href or _first(node, "link", "loc"), "id": _first(node, "guid", "id"), "summary": summary,
        "published": _first(node, "pubdate", "published", "updated", "date", "publication_date"), "author": _first(node, "creator", "author", "name"), "tags": tags[:TAGS], "image": image,
    }


def parse_feed(body: bytes) -> tuple[list[dict], bool]:
    """Entries, and whether the document broke off: what precedes a syntax error is kept."""
    parser, entries, stack, broken = ET.XMLPullParser(("start", "end")), [], [], False
    try:
        parser.feed(body)
        parser.close()
    except ET.ParseError:
        broken = True
    try:
        for event, node in parser.read_events():
            if event == "start":
                stack.append(node)
            elif _local(node.tag) in ("item", "entry", "url"):
                entries.append(_entry(node))
    except ET.ParseError:
        broken = True
    return entries, broken


def parse_bodies(bodies: DataFrame) -> DataFrame:
    """Rows (path, content) of feed documents as rows of the fixed entry schema; a task holds one document at a time."""
    names = [c.split()[0] for c in ENTRY.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            held = []
            for file, body in zip(files["path"], files["content"]):
                entries, broken = parse_feed(bytes(body) if body is not None else b"")
                held += [{"file": file, **e, "malformed": broken} for e in entries]
                if len(held) > 1_000:
                    yield pd.DataFrame(held, columns=names)
                    held = []
            yield pd.DataFrame(held, columns=names)

    return bodies.select("path", "content").mapInPandas(run, ENTRY)


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Feed files as rows of the fixed entry schema; a file is read by one task."""
    return parse_bodies(spark.read.format("binaryFile").load(path))


def feed_documents(pages: DataFrame) -> DataFrame:
    """(path, content): every page (page_id, url, html) as a feed of one entry: RSS, Atom and a news sitemap in turn."""
    safe = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    title, link = safe(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)), F.replace(safe(F.col("url")), F.lit('"'), F.lit("&quot;"))
    image = F.replace(safe(F.regexp_extract("html", r'<img[^>]+src="([^"]+)"', 1)), F.lit('"'), F.lit("&quot;"))
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    number = F.col("page_id").cast("string")
    rss = F.concat(
        F.lit('<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Outlet</title><item><title>'), title, F.lit("</title><link>"), link, F.lit("</link><guid>"), number,
        F.lit("</guid><pubDate>"), at, F.lit('</pubDate><dc:creator>desk</dc:creator><category>a</category><category>b</category><enclosure url="'), image, F.lit('"/></item></channel></rss>'),
    )
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>Outlet</title><entry><title>'), title, F.lit('</title><link rel="alternate" href="'), link, F.lit('"/><id>'), number, F.lit("</id><updated>"), at,
        F.lit("</updated><author><name>desk</name></author><category term=\"a\"/></entry></feed>"),
    )
    sitemap = F.concat(
        F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:n="http://www.google.com/schemas/sitemap-news/0.9"><url><loc>'), link, F.lit("</loc><n:news><n:publication_date>"), at,
        F.lit("</n:publication_date><n:title>"), title, F.lit("</n:title></n:news></url></urlset>"),
    )
    body = F.when(F.col("page_id") % 3 == 0, rss).when(F.col("page_id") % 3 == 1, atom).otherwise(sitemap)
    return pages.select(number.alias("path"), F.encode(body, "UTF-8").alias("content"))


_CLEAN = r"nullif(regexp_replace(regexp_replace({c}, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '^\s+|\s+$', '', 'g'), '')"


@query(
    "s2_feed_entries",
    rf"""WITH p AS (SELECT page_id, page_id % 3 AS kind, {_CLEAN.format(c="regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title, {_CLEAN.format(c="url")} AS url,
      {_CLEAN.format(c="regexp_extract(html, '<img[^>]+src=" + chr(34) + "([^" + chr(34) + "]+)" + chr(34) + "', 1)")} AS image FROM pages)
    SELECT CAST(page_id AS VARCHAR) AS file, left(title, {CLIP}) AS title, url AS link, CASE WHEN kind < 2 THEN CAST(page_id AS VARCHAR) END AS id,
      strftime(make_timestamp((1704067200 + page_id * 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS published, CASE WHEN kind < 2 THEN 'desk' END AS author,
      CASE kind WHEN 0 THEN 'a,b' WHEN 1 THEN 'a' ELSE '' END AS tags, CASE WHEN kind = 0 THEN image END AS image, false AS malformed FROM p""",
)
def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of RSS, Atom and sitemap documents that hold the pages' titles, addresses and images."""
    found = parse_bodies(feed_documents(read_table(spark, sf_dir, "pages")))
    return found.select("file", "title", "link", "id", "published", "author", F.array_join("tags", ",").alias("tags"), "image", "malformed")


def links_of(html: Column) -> Column:
    """Distinct addresses of a page's anchors."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]+)"'), F.lit(1)))


@query("s6_page_links", r"""SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a\s[^>]*href="([^"]+)"', 1))) AS link FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page."""
    return read_table(spark, sf_dir, "pages").select("page_id", F.explode(links_of(F.col("html"))).alias("link"))


@query("s5_first_image", r"""SELECT page_id, nullif(regexp_extract(html, '<img[^>]+src="([^"]+)"', 1), '') AS image, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages""")
def first_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First image and title of every page."""
    empty = lambda c: F.when(c != "", c)
    return read_table(spark, sf_dir, "pages").select(
        "page_id", empty(F.regexp_extract("html", r'<img[^>]+src="([^"]+)"', 1)).alias("image"), empty(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)).alias("title")
    )


@query(
    "s12_field_profile",
    """SELECT source, count(*) AS items, round(avg(CASE WHEN text IS NOT NULL AND text <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS text_coverage, count(*) - count(DISTINCT text) AS repeated,
    min(doc_id) AS oldest, max(doc_id) AS newest, round(avg(length(text)), 4) AS avg_length FROM documents GROUP BY 1""",
)
def field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, repetitions and span of every outlet's items in one aggregate; texts are compared by their hashes."""
    d = read_table(spark, sf_dir, "documents").withColumn("h", F.sha2("text", 256))
    filled = F.when(F.col("text").isNotNull() & (F.col("text") != ""), 1.0).otherwise(0.0)
    return d.groupBy("source").agg(
        F.count(F.lit(1)).alias("items"), F.round(F.avg(filled), 6).alias("text_coverage"), (F.count(F.lit(1)) - F.countDistinct("h")).alias("repeated"),
        F.min("doc_id").alias("oldest"), F.max("doc_id").alias("newest"), F.round(F.avg(F.length("text")), 4).alias("avg_length"),
    )
