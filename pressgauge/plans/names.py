"""Names in texts: their case forms, and whether they stand in the text that they head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.functions import text as T
from pressgauge.operators import entities, grounding
from pressgauge.plans.texts import _KEY, _TITLES, titles
from pressgauge.session import read_table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


CAPITALISED = r"\p{Lu}\p{Ll}{2,}"


def places(rows: DataFrame) -> DataFrame:
    """(id, type, key, name, mentions) of the capitalised words of whole texts, taken as places; ids are hashes of keys."""
    words = rows.select(F.explode(F.regexp_extract_all("text", F.lit(f"({CAPITALISED})"), F.lit(1))).alias("name"))
    key = T.normalize_key(F.col("name"))
    named = words.select("name", key.alias("key")).where("key <> ''").groupBy("key").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("mentions"))
    return named.select(F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 15), 16, 10).cast("long").alias("id"), F.lit("location").alias("type"), "key", "name", "mentions")


def _list(values: tuple[str, ...]) -> str:
    return "(VALUES " + ", ".join(f"('{v}')" for v in values) + ")"


_ALL = (*entities.ENDINGS, entities.PLACE_ENDING)


def _places_sql(table: str, name: str) -> str:
    return f"""{name}_words AS (SELECT unnest(regexp_extract_all(text, '{CAPITALISED}')) AS name FROM {table}),
    {name} AS (SELECT ('0x' || substr(md5(key), 1, 15))::BIGINT AS id, key, min(name) AS name, count(*) AS mentions
      FROM (SELECT name, {_KEY.format(c="name")} AS key FROM {name}_words) WHERE key <> '' GROUP BY key),
    {name}_forms AS (SELECT id, key, stem AS form FROM (SELECT id, key, e, left(key, length(key) - length(e)) AS stem FROM {name}, {_list(_ALL)} v(e) WHERE suffix(key, e))
      WHERE length(stem) >= 4 AND CASE e WHEN 'ne' THEN suffix(stem, 'i') WHEN 'se' THEN suffix(stem, 'i') WHEN 'n' THEN NOT suffix(stem, 'a') ELSE true END
      UNION ALL SELECT id, key, '=' || key FROM {name})"""


@query(
    "d16_case_variants",
    f"""WITH {_places_sql("conversations", "wanted")}, {_places_sql("documents", "stored")},
    least AS (SELECT form, min(id) AS id FROM stored_forms GROUP BY form)
    SELECT w.key, arg_min(l.id, CASE WHEN l.form = '=' || w.key THEN 0 ELSE 1 END * 10000000000000000000::HUGEINT + l.id) AS id
    FROM wanted_forms w LEFT JOIN least l USING (form) GROUP BY w.key""",
)
def case_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words of conversations with the word of the documents that they are, or are a case form of."""
    stored, wanted = (places(read_table(spark, sf_dir, t)) for t in ("documents", "conversations"))
    return entities.stored_forms(wanted, stored).select("key", "id")


@query(
    "d13_entity_forms",
    f"""WITH RECURSIVE {_places_sql("documents", "n")},
    least AS (SELECT form, min(id) AS least FROM n_forms GROUP BY form),
    links AS (SELECT DISTINCT id AS a, least AS b FROM n_forms JOIN least USING (form) WHERE id <> least),
    both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT id AS a, id AS b FROM n UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
    grouped AS (SELECT n.*, g."group" FROM n JOIN (SELECT a, min(b) AS "group" FROM reach GROUP BY a) g ON n.id = g.a),
    ends AS (SELECT "group", min(key) AS low, max(key) AS high FROM grouped GROUP BY "group"),
    common AS (SELECT "group", (SELECT coalesce(max(i), 0) FROM range(1, length(low) + 1) t(i) WHERE left(low, i) = left(high, i)) AS common FROM ends),
    ranked AS (SELECT *, substr(key, common + 1) AS ending FROM grouped JOIN common USING ("group")),
    best AS (SELECT "group", arg_max(id, (mentions::HUGEINT << 64) - id) AS keep_id, sum(mentions)::BIGINT AS group_mentions,
      max(struct_pack(a := CASE WHEN {" OR ".join(f"suffix(ending, '{e}')" for e in entities.OBLIQUE)} THEN 0 ELSE 1 END, b := CASE WHEN suffix(ending, 'a') THEN 1 ELSE 0 END, m := mentions, name := name)).name AS name
      FROM ranked GROUP BY "group")
    SELECT id, keep_id, best.name, group_mentions FROM grouped JOIN best USING ("group")""",
)
def entity_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words of all documents, the case forms of one name merged."""
    return entities.merge_forms(places(read_table(spark, sf_dir, "documents")))


def _rest(text: Column) -> Column:
    return F.regexp_replace(text, r"^[^\n]*\n?", "")


_RUNS = r"\p{Lu}[\p{L}]+(?: \p{Lu}[\p{L}]+)*"
_GROUND = rf"""rest AS (SELECT doc_id, regexp_replace(text, '^[^\n]*\n?', '') AS text FROM documents),
    held AS (SELECT DISTINCT doc_id, unnest(string_split({_KEY.format(c="text")}, ' ')) AS t FROM rest),
    one AS (SELECT doc_id, name, type, token, exact FROM (SELECT *, unnest(CASE WHEN exact THEN all_tokens ELSE long_tokens END) AS token FROM named)),
    stems AS (SELECT DISTINCT token, e, left(token, length(token) - length(e)) AS stem FROM (SELECT token FROM one UNION SELECT t FROM held), {_list(grounding.ENDINGS)} v(e) WHERE suffix(token, e) AND length(token) - length(e) >= 3),
    found AS (
      SELECT o.doc_id, o.name, o.type, o.token FROM one o JOIN held h ON h.doc_id = o.doc_id AND h.t = o.token
      UNION SELECT o.doc_id, o.name, o.type, o.token FROM one o JOIN held h ON h.doc_id = o.doc_id AND left(h.t, 5) = left(o.token, 5) AND length(o.token) >= 5 AND length(h.t) >= 5 WHERE NOT o.exact
      UNION SELECT o.doc_id, o.name, o.type, o.token FROM one o JOIN stems a ON a.token = o.token JOIN held h ON h.doc_id = o.doc_id JOIN stems b ON b.token = h.t AND b.stem = a.stem
        WHERE NOT o.exact AND (a.e = b.e OR left(a.e, 1) <> left(b.e, 1) OR (a.e <> 'er' AND b.e <> 'er'))),
    hits AS (SELECT doc_id, name, type, count(*) AS hits FROM found GROUP BY ALL),
    told AS (SELECT n.doc_id, n.name, n.type, len(wanted) > 0 AND CASE WHEN exact OR n.type = 'person' THEN coalesce(hits, 0) = len(wanted) ELSE coalesce(hits, 0) * 2 >= len(wanted) END AS grounded
      FROM (SELECT *, CASE WHEN exact THEN all_tokens ELSE long_tokens END AS wanted FROM named) n LEFT JOIN hits h ON h.doc_id = n.doc_id AND h.name = n.name AND h.type = n.type)"""
_TOKENS = f"SELECT *, list_filter(all_tokens, lambda x: length(x) >= 3) AS long_tokens, len(list_filter(all_tokens, lambda x: length(x) >= 3)) = 0 AS exact FROM (SELECT *, list_distinct(list_filter(string_split({_KEY.format(c='name')}, ' '), lambda x: x <> '')) AS all_tokens FROM {{source}})"


@query(
    "n26_grounded_names",
    rf"""WITH {_TITLES}, runs AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(title, '{_RUNS}')) AS name FROM titles),
    typed AS (SELECT doc_id, name, CASE WHEN contains(name, ' ') THEN 'person' ELSE 'location' END AS type FROM runs),
    named AS ({_TOKENS.format(source="typed")}), {_GROUND}
    SELECT doc_id, name, type, grounded FROM told""",
)
def grounded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised runs of titles, two words or more taken as persons, and whether the text below holds them."""
    runs = titles(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("title", F.lit(f"({_RUNS})"), F.lit(1))).alias("name"))
    typed = runs.withColumn("type", F.when(F.col("name").contains(" "), "person").otherwise("location"))
    return grounding.grounded(typed, read_table(spark, sf_dir, "documents").select("doc_id", _rest(F.col("text")).alias("text")))


@query("n32_ungrounded_words")
def ungrounded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and numbers of titles that the text below does not hold."""
    below = read_table(spark, sf_dir, "documents").select("doc_id", _rest(F.col("text")).alias("text"))
    return grounding.ungrounded_words(titles(spark, sf_dir).select("doc_id", F.col("title").alias("summary")), below)
