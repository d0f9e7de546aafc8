"""Token ids in ORC files: run-length encoded integers, row indexes and Bloom filters on document ids.

Documents are dealt out by ranges of doc_id, so that files in name order hold ascending ids, and each task writes its
range as one file whose stripes Spark reads in parallel and prunes by their statistics, row index and Bloom filter.
A row has the document's ids (with the end id), and the number of ids before it and up to its end in its file; a file's
first id comes from the totals of the files before it, one row per file, for which no ids are read.

Word parts that repeat are encoded once per chunk of text, and once per Python worker as long as they stay in a cache
of bounded size, which those used longest ago leave first. A cut between parts lies at ASCII white space, or between
ASCII letters or digits and punctuation, where the tokenizer's own rules always cut as well.

Edge cases: null text counts as empty and has the end id only; null doc_ids come first; rows that repeat a doc_id
follow each other in the order of their texts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.llm import words as W
from pressgauge.llm.scratch import new_dir

#: Distinct word parts that a Python worker keeps encoded.
CACHE = 300_000
#: Word parts that the tokenizer sees as one text.
GROUP = 250
_loaded: dict = {}


class PartEncoder:
    """Encodes distinct word parts with the tokenizers library."""

    def __init__(self, config: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_buffer(config)
        self.model.encode_special_tokens = True
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        # Parts used of late and, before the last turnover, those used before them.
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        # Parts are folded and cut before the model sees them, which only a model that does the same allows.
        whole, parts = self._each(["Ab cD1, e\tF;g"])[0], self._each(["ab", "cd1", ",", "e", "f", ";", "g"])
        if whole != b"".join(parts) or not self.ends[np.frombuffer(parts[0], "<u4")[-1]]:
            raise ValueError("the tokenizer must fold A-Z, drop white space, cut at punctuation and mark word ends with </w>")

    @classmethod
    def of(cls, config: bytes) -> PartEncoder:
        key = hash(config)
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = cls(config)
        return _loaded[key]

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, texts: list[str]) -> list[bytes]:
        """Parts of letters only: one pre-token each, whose last id, and no other, ends a word."""
        ids = np.array(self.model.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, "<u4")
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(texts) or stop[-1] != len(ids):
            return self._each(texts)
        raw, at = ids.tobytes(), [0, *(stop * 4).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def encode(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each part as little-endian 32-bit integers."""
        found = list(map(self.cache.get, parts))
        missing = [i for i, x in enumerate(found) if x is None]
        for i in missing:
            found[i] = self.older.get(parts[i])
        new = [i for i in missing if found[i] is None]
        # No part has a line feed, so that all are decoded at once.
        texts = b"\n".join([parts[i] for i in new]).decode().split("\n") if new else []
        letters = list(map(str.isalpha, texts))
        for want, how in ((True, self._letters), (False, self._each)):
            at = [i for i, x in zip(new, letters) if x is want]
            group = [t for t, x in zip(texts, letters) if x is want]
            for k in range(0, len(group), GROUP):
                for i, ids in zip(at[k : k + GROUP], how(group[k : k + GROUP])):
                    found[i] = ids
        # A part that is used again outlasts the turnover, so that frequent parts stay encoded.
        while missing:
            room = CACHE // 2 - len(self.cache)
            some, missing = missing[:room], missing[room:]
            self.cache.update((parts[i], found[i]) for i in some)
            if len(self.cache) >= CACHE // 2:
                self.cache, self.older = {}, self.cache
        return found


def encode_column(column: pa.Array, encoder: PartEncoder, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, number of ids per row) for chunks of rows."""
    for _, data, at in W.chunks(column, 8 << 20):
        data, start, end, row = W.folded_parts(data, at)
        parts, index = W.distinct(data, start, end)
        got = encoder.encode(parts)
        length = np.array([len(g) // 4 for g in got] + [1], np.int64)
        ids = np.frombuffer(b"".join(got) + np.array([end_id], "<u4").tobytes(), "<u4")
        offset = np.cumsum(length) - length
        # The end id is one more part after the last part of every row.
        last = np.searchsorted(row, np.arange(len(at) - 1), "right")
        index = np.insert(index, last, len(parts))
        row = np.insert(row, last, np.arange(len(at) - 1))
        yield W.gather(ids, offset, length, index), np.bincount(row, weights=length[index], minlength=len(at) - 1).astype(np.int64)


def write_token_orc(docs: DataFrame, path: str, config: bytes, end_id: int, row_stride: int = 1000, stripe_bytes: int = 8 << 20) -> None:
    """Encode every text and write (doc_id, before, after, ids) in ascending doc_id order."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = PartEncoder.of(shared.value), 0
        for batch in batches:
            row = 0
            for ids, n in encode_column(batch.column("text"), encoder, end_id):
                at = np.concatenate(([0], np.cumsum(n)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, len(n)),
                        pa.array(before + at[:-1]),
                        pa.array(before + at[1:]),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32))),
                    ],
                    names=["doc_id", "before", "after", "ids"],
                )
                row, before = row + len(n), before + int(at[-1])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = slim.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    (
        ordered.mapInArrow(run, "doc_id long, before long, after long, ids array<int>")
        .write.format("orc")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", 0)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", row_stride)
        .option("orc.stripe.size", stripe_bytes)
        .save(path)
    )


def read_token_orc(spark, path: str) -> DataFrame:
    """(doc_id, before, ids, file): filters on doc_id reach the stripes' statistics and Bloom filters."""
    rows = spark.read.schema("doc_id long, before long, ids array<int>").orc(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    return rows.select("doc_id", "before", "ids", number.alias("file"))


def token_digest(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at, raw = lists.offsets.to_numpy(), memoryview(lists.values.to_numpy().astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("before"), batch.column("file"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "before", "file", "n_tokens", "ids_crc32"],
            )

    rows = read_token_orc(spark, path).mapInArrow(run, "doc_id long, before long, file int, n_tokens long, ids_crc32 long")
    ends = spark.read.schema("after long").orc(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    totals = ends.groupBy(number.alias("file")).agg(F.max("after").alias("total"))
    # One row per file.
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("file", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return rows.join(base, "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read_back(docs: DataFrame, config: bytes, end_id: int = 1) -> DataFrame:
    path = new_dir(docs.sparkSession, "token-orc")
    write_token_orc(docs, path, config, end_id)
    return token_digest(docs.sparkSession, path)
