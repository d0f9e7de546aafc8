"""Fill-in-the-middle rewriting of texts.

A text becomes an array of code points (UTF-32). A token is white space and the word after it, so one begins at the text's
start and wherever white space follows something else: comparing neighbouring classes finds them all at once. Two of the
n + 1 borders, drawn by a hash of seed and doc_id, cut the text into prefix, middle and suffix.

Forms: ``plain`` is the text itself; ``psm`` is <P>prefix<S>suffix<M>middle; ``spm`` is <S>suffix<P>prefix<M>middle. Texts
that are empty or hold a marker stay plain, so the first marker of each kind in an output is the one that was set: markers
begin with "<", end with ">" and overlap neither each other nor text that holds none.

Every row is rewritten where it lies; nothing is shuffled, and one text at a time is held as code points.

Edge cases: null text counts as empty (plain, n = 0); a text of white space only is one token; a null doc_id draws like an
empty one; rows that repeat a doc_id draw alike and keep a row each; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm import words as W

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text that go back to Spark at once.
CHUNK = 4 << 20
_MARK = {m: np.array([ord(c) for c in m], "<u4") for m in (PREFIX, SUFFIX, MIDDLE)}
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def borders(points: np.ndarray) -> np.ndarray:
    """Where tokens begin, and the end of the text."""
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    inner = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    return np.concatenate(([0], inner, [len(points)])) if len(points) else np.zeros(1, np.int64)


def rewrite(text: str, draws: tuple[int, int, int, int], plain: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, code points of the prefix, of the middle, output) by four draws."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    at = borders(points)
    n = len(at) - 1
    if not n or draws[2] % 100 >= 100 - plain or any(m in text for m in _MARK):
        return n, "plain", None, None, text
    a, b = sorted(int(at[h % (n + 1)]) for h in draws[:2])
    prefix, middle, suffix = points[:a], points[a:b], points[b:]
    form = "spm" if draws[3] % 100 < spm else "psm"
    first = (_MARK[SUFFIX], suffix, _MARK[PREFIX], prefix) if form == "spm" else (_MARK[PREFIX], prefix, _MARK[SUFFIX], suffix)
    return n, form, a, b - a, np.concatenate([*first, _MARK[MIDDLE], middle]).tobytes().decode("utf-32-le")


def rebuild(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE, 1)
    if form == "spm":
        suffix, prefix = head[len(SUFFIX) :].split(PREFIX, 1)
    else:
        prefix, suffix = head[len(PREFIX) :].split(SUFFIX, 1)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, seed: int = 42, plain: int = 50, spm: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output); ``plain`` percent of the texts stay as they are, ``spm``
    percent of the others have their suffix first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, at in W.chunks(batch.column("text"), CHUNK):
                some = batch.slice(row, len(at) - 1)
                found = []
                for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist()):
                    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
                    draws = tuple(int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))
                    found.append(rewrite(text or "", draws, plain, spm))
                n, form, prefix, middle, output = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def restored(rewritten: DataFrame) -> DataFrame:
    """``rewritten`` with ``text``, rebuilt from output and form alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, at in W.chunks(batch.column("output"), CHUNK):
                some = batch.slice(row, len(at) - 1)
                text = [rebuild(o, f) for o, f in zip(some.column("output").to_pylist(), some.column("form").to_pylist())]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(text, pa.string())], names=[*some.schema.names, "text"])

    return rewritten.mapInArrow(run, f"{SCHEMA}, text string")


def digest(docs: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) per document."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return restored(fill_in_middle(docs, seed)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("text").alias("restored_sha256")
    )


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
  FROM documents
), d AS (
  SELECT doc_id, text, tokens, len(tokens)::BIGINT AS n,
         ('0x' || substr(h, 1, 8))::BIGINT % (len(tokens) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(tokens) + 1) AS c2,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4
  FROM t
), p AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 50 THEN 'plain'
              WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(tokens[1:least(c1, c2)], '') AS prefix,
         array_to_string(tokens[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
         array_to_string(tokens[greatest(c1, c2) + 1:], '') AS suffix
  FROM d
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
