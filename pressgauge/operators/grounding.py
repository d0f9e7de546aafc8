"""Whether names and numbers stand in the texts they are said to come from.

A name's tokens of three letters or more are looked for among the tokens of its text: the same token, one with the same
first five letters, or one that has a stem of three letters or more in common where both continue with case endings only.
A person needs all tokens, any other name half of them; a name of shorter tokens only needs each of them as it is.

Two tokens meet exactly if they share a match key: one of their beginnings or of their short stems (longer stems hold the
same beginning). A text lies in one row with the keys that its names ask for and is cut to those of its own tokens there,
so that only keys which are found become rows; names meet them by a join.

Edge cases: null texts hold nothing; a name without letters or digits is not grounded; a null name is left out; rows that
repeat a text are one text each for its names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.functions import text as T

#: Letters of the shortest token that counts, of a beginning, and of the shortest stem.
TOKEN, BEGINNING, STEM = 3, 5, 3
#: First letters of a document's names up to which a text's tokens are looked for among them.
STARTS = 64
# Endings of case and definiteness, folded; the empty one stands for the bare stem.
ENDINGS = (
    "", "a", "e", "i", "u", "n", "s", "t", "en", "es", "et", "in", "it", "is", "ut", "un", "us",
    "ra", "re", "ri", "er", "ja", "je", "ve", "ne", "se", "te", "ave", "eve",
)
# What ends a sentence, a word, and a number.
SENTENCE_END, NUMBER = r'[.!?:;…"“”«»]\s*$', r"\d+(?:[.,:]\d+)*"
WORD = r"[\p{L}][\p{L}\p{N}_'’-]*|\d[\d.,:]*"


def folded_tokens(text: Column) -> Column:
    """Distinct folded tokens of letters and digits."""
    return F.array_distinct(F.filter(F.split(T.normalize_key(F.coalesce(text, F.lit(""))), " "), lambda w: w != ""))


def match_keys(token: Column) -> Column:
    """Keys of a token, of which two tokens share one exactly if they meet.

    A short token has itself; others have their beginning and each stem of three or four letters that an ending follows.
    Two endings after one stem are still endings after all the letters that both words share, whichever letter that is,
    but for "er": beside another ending in "e" it would leave "r". So these two have one key of a stem each, others both.
    """
    out = [F.when(F.length(token) < TOKEN, F.concat(F.lit("="), token)), F.when(F.length(token) >= BEGINNING, F.concat(F.lit("^"), F.substring(token, 1, BEGINNING)))]
    for n in range(STEM, BEGINNING):
        stem, rest = F.substring(token, 1, n), F.substring(token, n + 1, BEGINNING)
        fits = (F.length(token) >= n) & rest.isin(*ENDINGS)
        out.append(F.when(fits & (rest != "er"), F.concat(F.lit("~"), stem)))
        out.append(F.when(fits & ((rest == "er") | ~rest.startswith("e")), F.concat(F.lit("~"), stem, F.lit("+"))))
    return F.array_compact(F.array(*out))


def held_keys(text: Column, wanted: Column, starts: Column) -> Column:
    """The keys of ``wanted`` that a text's tokens have; ``starts`` are the first letters of all names' tokens."""
    tokens = folded_tokens(text)
    # Tokens that meet have their first letters in common; for long lists, keys are cheaper than looking there.
    near = F.when(F.size(starts) <= STARTS, F.filter(tokens, lambda t: F.array_contains(starts, F.substring(t, 1, STEM)))).otherwise(tokens)
    return F.array_intersect(wanted, F.flatten(F.transform(near, match_keys)))


def grounded(names: DataFrame, texts: DataFrame) -> DataFrame:
    """``names`` (doc_id, name, type) with ``grounded``, against ``texts`` (doc_id, text)."""
    asked = names.select("doc_id", "name", "type").where("name is not null").distinct()
    tokens = folded_tokens(F.col("name"))
    long = F.filter(tokens, lambda t: F.length(t) >= TOKEN)
    asked = asked.withColumn("wanted", F.when(F.size(long) > 0, long).otherwise(tokens)).withColumn("exact", F.size(long) == 0)
    one = asked.select("doc_id", "name", "type", "exact", F.explode("wanted").alias("token"))
    keyed = one.select("*", F.explode(match_keys(F.col("token"))).alias("key")).select("doc_id", "name", "type", "token", "key")
    sought = keyed.groupBy("doc_id").agg(F.collect_set("key").alias("keys"), F.collect_set(F.substring("token", 1, STEM)).alias("starts"))
    held = texts.join(sought, "doc_id").select("doc_id", F.explode(held_keys(F.col("text"), F.col("keys"), F.col("starts"))).alias("key"))
    found = keyed.join(held, ["doc_id", "key"]).select("doc_id", "name", "type", "token").distinct()
    hits = found.groupBy("doc_id", "name", "type").agg(F.count(F.lit(1)).alias("hits")).select(F.col("doc_id").alias("_doc"), F.col("name").alias("_name"), F.col("type").alias("_type"), "hits")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("name") == F.col("_name")) & F.col("type").eqNullSafe(F.col("_type"))
    n, got = F.size("wanted"), F.coalesce("hits", F.lit(0))
    enough = F.when(F.col("exact") | F.coalesce(F.col("type") == "person", F.lit(False)), got == n).otherwise(got * 2 >= n)
    return asked.join(hits, same, "left").select("doc_id", "name", "type", ((n > 0) & enough).alias("grounded"))


def ungrounded_words(summaries: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, word) of the names and numbers of ``summaries`` (doc_id, summary) that their ``texts`` do not hold.

    Names are capitalised words past the start of a sentence; numbers must stand in the text as they are written.
    """
    # A mark before each word tells where sentences begin: the text between two words ends one or not.
    words = F.regexp_extract_all("summary", F.lit(f"({WORD})"), F.lit(1))
    gaps = F.split("summary", WORD)
    placed = summaries.where("summary is not null").select("doc_id", F.posexplode(words).alias("i", "word"), gaps.alias("gaps"))
    starts = (F.col("i") == 0) | F.get("gaps", F.col("i")).rlike(SENTENCE_END)
    placed = placed.select("doc_id", "word", starts.alias("starts"))
    name = placed.where(F.col("word").rlike(r"^\p{Lu}") & ~F.col("starts") & (F.size(F.filter(folded_tokens(F.col("word")), lambda t: F.length(t) >= TOKEN)) > 0))
    name = name.select("doc_id", F.col("word").alias("name"), F.lit("person").alias("type")).distinct()
    number = placed.where(F.col("word").rlike(r"^\d")).select("doc_id", F.col("word").alias("word"), F.regexp_replace("word", r"[.,:]+$", "").alias("number")).distinct()
    numbers = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({NUMBER})"), F.lit(1))).alias("number")).distinct()
    strange = number.join(numbers, ["doc_id", "number"], "left_anti").select("doc_id", "word")
    return grounded(name, texts).where("not grounded").select("doc_id", F.col("name").alias("word")).unionByName(strange)
