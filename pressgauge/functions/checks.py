"""Validation and repair of single values as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IPv4 ranges that are not public, and endings of local host names.
_PRIVATE = r"^(0|10|127|169\.254|172\.(1[6-9]|2\d|3[01])|192\.168|192\.0\.[02]|198\.1[89]|198\.51\.100|203\.0\.113|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])|2(2[4-9]|[345]\d))\."
_LOCAL = r"(^|\.)localhost$|\.(local|internal)$"


def url_issue(url: Column) -> Column:
    """Why an absolute address may not be used: scheme, host, credentials or a place that is not public; null if it may."""
    whole = F.trim(url)
    place = F.regexp_extract(whole, r"(?i)^https?://([^/?#]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(place, r"([^@]*)$", 1)), r":\d*$", "")
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    return (
        F.when(whole.isNull() | ~whole.rlike("(?i)^https?:"), "unsupported_scheme")
        .when(F.contains(place, F.lit("@")), "credentials")
        .when(host == "", "missing_host")
        .when(host.rlike(_LOCAL), "local_host")
        .when((bare.rlike(r"^\d+\.\d+\.\d+\.\d+$") & bare.rlike(_PRIVATE)) | (F.contains(bare, F.lit(":")) & bare.rlike("^(::1?$|f[cd]|fe[89ab])")), "private_address")
    )


#: Forms of times in feeds: RFC 822 with a zone or offset, ISO 8601 with one, and ISO 8601 without, which is UTC.
TIME_FORMS = ("EEE, d MMM yyyy HH:mm:ss z", "EEE, d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def feed_time(text: Column) -> Column:
    """The time that a text of one of the usual forms names, in the session's UTC; null for others."""
    plain = F.trim(text)
    # Week days say nothing beyond the date, and the parser takes none.
    short = F.regexp_replace(plain, r"^[A-Za-z]{3},\s*", "")
    forms = [f.removeprefix("EEE, ") for f in TIME_FORMS]
    return F.coalesce(*[F.try_to_timestamp(short, F.lit(f)) for f in dict.fromkeys(forms)])


def is_proper_name(name: Column) -> Column:
    """Whether some word begins with a capital or a digit."""
    return F.exists(F.split(name, " "), lambda w: w.rlike(r"^[\p{Lu}0-9]"))


def clamped(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def country_codes(codes: Column) -> Column:
    """Codes of two characters in upper case, each once, in order."""
    upper = F.transform(codes, lambda c: F.upper(F.trim(c)))
    return F.array_sort(F.array_distinct(F.filter(upper, lambda c: F.length(c) == 2)))
