"""Scalar text functions as Catalyst expressions: keys, hashes, URLs, tokens, similarities, keyword classes and tone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.functions.vocabulary import ENDINGS, NOISE, STOPWORDS

# Latin letters with marks and their base letters, in the same order.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def fold(text: Column) -> Column:
    """Lower case without the marks of the listed Latin letters; ß becomes ss."""
    return F.replace(F.translate(F.lower(text), _MARKED, _PLAIN), F.lit("ß"), F.lit("ss"))


def normalize_key(text: Column) -> Column:
    """Folded words of letters and digits, single-spaced. Text of punctuation only gives an empty key."""
    return F.trim(F.regexp_replace(fold(text), "[^0-9a-z]+", " "))


def sha256_of(*parts: Column) -> Column:
    """SHA-256 of the parts joined by the unit separator; null counts as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


# Query parameters, and beginnings of parameters, that only track the reader or choose a view.
TRACKING = (
    "fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "ocid", "ref", "ref_src",
    "_ga", "_gl", "amp", "output", "share", "s_cid", "cmpid", "yclid",
)
TRACKING_BEGINNINGS = ("utm_", "pk_", "mtm_")


def canonical_url(url: Column) -> Column:
    """https, no www, no fragment, no tracking parameters, sorted parameters, no trailing slash; null for other schemes."""
    ok = url.rlike(r"(?i)^https?://[^/?#]+")
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#]+)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"(?i)^https?://[^/?#]+([^?#]*)", 1), r"(/amp)?/+$|/amp$", "")
    pairs = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.array_sort(F.filter(pairs, lambda p: (p != "") & ~name(p).rlike("^(" + "|".join(TRACKING_BEGINNINGS) + ")") & ~name(p).isin(*TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(ok, F.concat(F.lit("https://"), host, path, query))


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#]+)", 1)), r"^www\.", "")


def trigrams(key: Column) -> Column:
    """Distinct padded trigrams of the words of a key: two spaces before a word and one after it."""
    padded = F.transform(F.filter(F.split(key, " "), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets held as arrays; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def bounded_distance(a: Column, b: Column, limit: int) -> Column:
    """Edit distance of two whole texts, ``limit + 1`` where it exceeds the limit."""
    d = F.levenshtein(a, b, limit)
    return F.when(d < 0, limit + 1).otherwise(d)


def near_verbatim(a: Column, b: Column, noise: frozenset[str] = NOISE) -> Column:
    """Whether two keys differ in noise words and words of one or two letters only."""
    x, y = F.split(a, " "), F.split(b, " ")
    differ = F.array_union(F.array_except(x, y), F.array_except(y, x))
    return F.forall(differ, lambda w: w.isin(*sorted(noise)) | w.rlike("^[a-z]{1,2}$"))


def stem(token: Column) -> Column:
    """The first six letters without the first of the endings that leaves three; tokens with digits stay whole."""
    cut = F.substring(token, 1, 6)
    out = cut
    for e in reversed(ENDINGS):
        out = F.when(cut.endswith(e) & (F.length(cut) - len(e) >= 3), F.substring(cut, F.lit(1), F.length(cut) - len(e))).otherwise(out)
    return F.when(token.rlike("[0-9]"), token).otherwise(out)


def tokens(text: Column, max_words: int | None = None) -> Column:
    """Stems of the (first) words of a text without stopwords, labels, short words and one-digit numbers."""
    words = F.split(normalize_key(text), " ")
    if max_words is not None:
        words = F.slice(words, 1, max_words)
    dull = sorted(STOPWORDS | NOISE)
    wanted = lambda w: F.when(w.rlike("^[0-9]+$"), F.length(w) >= 2).otherwise((F.length(w) >= 3) & ~w.isin(*dull))
    return F.transform(F.filter(words, wanted), lambda w: stem(w))


# Keyword classes and tone words of the rules classifier over the synthetic prose, in order of precedence.
CLASSES = {"reports": ("tion", "ing"), "people": ("her", "oth", "the"), "places": ("at", "on", "in")}
NEGATIVE, POSITIVE = ("idiot", "trash", "scum"), ("hea", "sha")


def stem_pattern(stems: tuple[str, ...]) -> str:
    """A pattern for words of a key that begin with one of the stems; "$" ends a stem that must be a whole word."""
    parts = [re.escape(s[:-1]) + r"(?![0-9a-z])" if s.endswith("$") else re.escape(s) for s in stems]
    return r"(?<![0-9a-z])(?:" + "|".join(parts) + ")"


def classified(texts: DataFrame, key: str, text: str, classes: dict[str, tuple[str, ...]] = CLASSES, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> DataFrame:
    """(key, class, tone) of a column of normalized keys; the stems are parameters, a class being any number of them.

    The class is that with the most matches, the first on ties and null without any. The tone is 0.3 for each positive
    match more than negative ones, within 0.9 either way. Matches are counted where the text lies; nothing is shuffled.
    """
    count = lambda stems: F.coalesce(F.regexp_count(F.col(text), F.lit(stem_pattern(stems))), F.lit(0))
    n = texts.select(key, F.array(*[F.struct(count(s).alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, (c, s) in enumerate(classes.items())]).alias("_n"), (count(positive) - count(negative)).alias("_tone"))
    best = F.array_max("_n")
    return n.select(key, F.when(best["n"] > 0, best["c"]).alias("class"), F.round(F.greatest(F.lit(-0.9), F.least(F.lit(0.9), F.col("_tone") * 0.3)), 6).alias("tone"))
