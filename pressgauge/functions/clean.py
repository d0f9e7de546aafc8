"""Cleaning of markup and dates: the steps that Catalyst lacks run as one Arrow-batched function."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_TAG = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
_DROP = re.compile("[​-‏⁠﻿\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def _reread(run: re.Match) -> str:
    try:
        return run[0].encode("cp1252").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return run[0]


def repair_encoding(text: str) -> str:
    """Runs beyond ASCII that are UTF-8 read as Latin-1 are read again; anything else stays."""
    return re.sub(r"[^\x00-\x7f]+", _reread, text)


def clean(text: str | None) -> str | None:
    """Text without markup, entities, control and zero-width characters, composed and single-spaced."""
    if text is None:
        return None
    plain = repair_encoding(html.unescape(_TAG.sub(" ", text)))
    return " ".join(_DROP.sub("", unicodedata.normalize("NFC", plain)).split())


@F.pandas_udf(StringType())
def clean_text(texts: pd.Series) -> pd.Series:
    return texts.map(clean, na_action="ignore")


def excerpt(text: Column, most: int = 300) -> Column:
    """At most so many characters, cut after a word if one ends past 60 %, with an ellipsis where cut."""
    head = F.substring(text, 1, most)
    whole = F.regexp_replace(head, r"\s+\S*$", "")
    cut = F.when(F.length(whole) >= 0.6 * most, whole).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


def resolved_time(parsed: Column, seen: Column) -> tuple[Column, Column, Column]:
    """(time, estimated, issue) in seconds: an absent, ancient or future time is replaced by when the item was seen."""
    issue = F.when(parsed.isNull(), "missing").when(parsed < 946684800, "too_old").when(parsed > seen + 600, "in_future")
    return F.when(issue.isNull(), parsed).otherwise(seen), issue.isNotNull(), issue


def quota_per_run(used: Column, limit: Column, runs_left: Column) -> Column:
    """Calls that the next run may make so that the rest of a day's quota lasts, one at least."""
    return F.greatest(F.ceil(F.greatest(limit - used, F.lit(0)) / F.greatest(runs_left, F.lit(1))), F.lit(1))
