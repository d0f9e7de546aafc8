"""Grammatical case forms of names: finding the stored form of a name, and merging the forms already stored.

Two names of one person or one place are forms of one name if all words but the last are the same and the last words share
a stem, of four letters or three after another word, that both continue with case endings only. Every name is put under a
key per such stem; for these endings two names share a key exactly if their longest common stem is one, so keys decide
without looking at pairs. Names of other types are forms of themselves only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.operators.components import components
from pressgauge.session import checkpointed

# Endings of case and definiteness, folded; places have one more, endings of oblique cases, and words that
# join the parts of a name.
ENDINGS = ("", "a", "e", "i", "u", "n", "s", "t", "en", "es", "in", "it", "ut", "un", "se", "ne")
PLACE_ENDING = "o"
OBLIQUE = ("s", "n", "t", "se", "ne")
CONNECTORS = ("i", "e", "te", "se", "ne")
#: Letters of the shortest stem of a single word, and of a last word after others.
STEM, STEM_AFTER = 4, 3


def _head(key: Column) -> Column:
    return F.regexp_extract(key, "^(.*) ", 1)


def _last(key: Column) -> Column:
    return F.substring_index(key, " ", -1)


def form_keys(key: Column, kind: Column) -> Column:
    """The keys that the forms of a name share: its type, first words and each stem of its last word."""
    head, last = _head(key), _last(key)
    least = F.when(head == "", STEM).otherwise(STEM_AFTER)
    out = []
    for e in (*ENDINGS, PLACE_ENDING):
        stem = F.substring(last, F.lit(1), F.length(last) - len(e))
        ok = last.endswith(e) & (F.length(last) - len(e) >= least)
        # "ne" and "se" follow an i, "n" no a.
        if e in ("ne", "se"):
            ok = ok & stem.endswith("i")
        elif e == "n":
            ok = ok & ~stem.endswith("a")
        elif e == PLACE_ENDING:
            ok = ok & (kind == "location")
        out.append(F.when(ok, F.concat_ws("|", kind, head, stem)))
    inflected = F.array_compact(F.array(*out))
    whole = F.array(F.concat_ws("|", kind, F.lit("="), key))
    return F.when(kind.isin("person", "location"), F.array_union(inflected, whole)).otherwise(whole)


def stored_forms(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """(type, key, id): each of the names ``wanted`` (type, key) with the stored one (id, type, key) that it is a form of.

    A stored name that is the same comes first, else the smallest id of another form; null where there is none.
    """
    asked = wanted.select("type", "key").where("key <> ''").distinct()
    keyed = asked.select("type", "key", F.explode(form_keys(F.col("key"), F.col("type"))).alias("form"))
    least = stored.select("id", F.explode(form_keys(F.col("key"), F.col("type"))).alias("form"), F.col("key").alias("k"))
    # One row per form key: the smallest id; the name itself has a key of its own.
    least = least.groupBy("form").agg(F.min("id").alias("id"))
    found = keyed.join(least, "form").withColumn("same", F.col("form") == F.concat_ws("|", "type", F.lit("="), "key"))
    best = found.groupBy("type", "key").agg(F.min(F.struct(~F.col("same"), "id")).alias("best"))
    return asked.join(best, ["type", "key"], "left").select("type", "key", F.col("best.id").alias("id"))


def merge_forms(names: DataFrame) -> DataFrame:
    """(id, keep_id, name, group_mentions) from (id, type, key, name, mentions): what every stored name is merged to.

    Of a group the name mentioned most keeps its id (the smaller on ties). It is shown by its best form: one that is not
    oblique, for a place then one that ends in "a", then the form used most, then the last by its letters; names with a
    joining word among their first words are shown by the form used most. Names in no group are merged to themselves.
    """
    keyed = names.select("id", F.explode(form_keys(F.col("key"), F.col("type"))).alias("form"))
    least = keyed.groupBy("form").agg(F.min("id").alias("least"))
    links = keyed.join(least, "form").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    groups = checkpointed(components(links, checkpointed))
    grouped = names.join(groups, names["id"] == groups["node"], "left").withColumn("group", F.coalesce("component", "id")).drop("node", "component")
    last = _last(F.col("key"))
    # The stem common to all forms of a group: that of its first and last form in order of letters.
    ends = grouped.groupBy("group").agg(F.min(last).alias("low"), F.max(last).alias("high"))
    common = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length("low"), F.lit(1))), F.lit(0), lambda n, i: F.when(F.substring("low", F.lit(1), i) == F.substring("high", F.lit(1), i), i).otherwise(n))
    ending = F.substring(last, F.col("common") + 1, F.length(last))
    oblique = F.lit(False)
    for e in OBLIQUE:
        oblique = oblique | ending.endswith(e)
    joined = F.exists(F.split(_head(F.col("key")), " "), lambda w: w.isin(*CONNECTORS))
    rank = F.struct(
        F.when(joined, 0).otherwise((~oblique).cast("int")), F.when(joined, 0).otherwise(((F.col("type") == "location") & ending.endswith("a")).cast("int")), "mentions", "name"
    )
    ranked = grouped.join(ends.withColumn("common", common).select("group", "common"), "group").withColumn("rank", rank)
    best = ranked.groupBy("group").agg(F.max(F.struct("mentions", -F.col("id"))).alias("keep"), F.max("rank").alias("shown"), F.sum("mentions").alias("group_mentions"))
    kept = best.select("group", (-F.col("keep.col2")).alias("keep_id"), F.col("shown.name").alias("name"), "group_mentions")
    return grouped.select("id", "group").join(kept, "group").select("id", "keep_id", "name", "group_mentions")
