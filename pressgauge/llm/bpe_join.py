"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table.

1. Tasks pack documents into blocks. A block's pre-tokens are its words; it keeps its distinct words, and for every
   document the positions: the sequence of its words' indices in the block.
2. A block's distinct words are dealt out by word, so that each distinct word of the corpus meets in one task, which
   encodes it once and sends the ids back to the blocks that asked. A word comes at most once per block, however
   frequent it is.
3. Per block, ids are joined to the positions, which gives every document's ids.

Decoding looks each id up in the table of token bytes, whose size is the vocabulary's.

The pre-token pattern never matches across the start of a white-space run, so it runs on distinct pieces (white space
and the word after it) instead of on every occurrence.

Edge cases: null text counts as empty and gives no ids; rows that repeat a doc_id, and null doc_ids, keep a row each;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm import words as W

#: Bytes of text per block; a longer text is a block of its own.
BLOCK = 24 << 20
#: Distinct words that a worker keeps encoded between the blocks it reads.
KNOWN = 300_000
_loaded: dict = {}

SHIPPED = "block long, bucket int, kind int, n int, data binary"


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def _codec(raw: bytes, pattern: str):
    key = hash((raw, pattern))
    if key not in _loaded:
        import tiktoken

        ranks = read_ranks(raw)
        _loaded.clear()
        _loaded[key] = ranks, tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


def _press(x: np.ndarray) -> bytes:
    """Integers below 2**32 as compressed byte planes, after their number and the compressed size."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    body = pa.compress(planes, "zstd", asbytes=True)
    return len(x).to_bytes(8, "little") + len(body).to_bytes(8, "little") + body


def _pressed_size(raw: bytes) -> int:
    return 16 + int.from_bytes(raw[8:16], "little")


def _unpress(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[16 : _pressed_size(raw)], 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def _join_bytes(items: list[bytes]) -> bytes:
    """A list of byte strings as one compressed value."""
    body = b"".join(items)
    return _press(np.array([len(i) for i in items], np.int64)) + len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def _split_bytes(raw: bytes) -> list[bytes]:
    n = _pressed_size(raw)
    ends = np.cumsum(_unpress(raw).astype(np.int64)).tolist()
    body = pa.decompress(raw[n + 8 :], int.from_bytes(raw[n : n + 8], "little"), "zstd", asbytes=True)
    return [body[a:b] for a, b in zip([0, *ends], ends)]


def _pack(block: int, ids: list[pa.Array], texts: list[pa.Array], find, buckets: int) -> Iterator[tuple]:
    """The rows of one block: kind 0 holds its documents and positions, kind 1 the distinct words of a bucket."""
    words: dict[bytes, int] = {}
    flow, counts = [], []
    for column in texts:
        for _, data, at in W.chunks(column):
            start, end, row = W.pieces(data, at)
            parts, index = W.distinct(data, start, end)
            found, length = [], np.empty(len(parts), np.int64)
            for i, part in enumerate(parts):
                got = find(part.decode())
                length[i] = len(got)
                found += [words.setdefault(w, len(words)) for w in map(str.encode, got)]
            offset = np.cumsum(length) - length
            flow.append(W.gather(np.array(found, np.uint32), offset, length, index))
            counts.append(np.bincount(row, weights=length[index], minlength=len(at) - 1).astype(np.int64))
    sequence = np.concatenate(flow) if flow else np.zeros(0, np.uint32)
    # Indices by falling frequency are small numbers, which compress best.
    often = np.argsort(-np.bincount(sequence, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.uint32)
    rank[often] = np.arange(len(words), dtype=np.uint32)
    listed = list(words)
    listed = [listed[i] for i in often.tolist()]
    bucket = np.zeros(0, np.int64)
    if listed:
        data = np.frombuffer(b"".join(listed), np.uint8)
        end = np.cumsum([len(w) for w in listed])
        bucket = (W.hashes(data, np.concatenate(([0], end[:-1])), end) % np.uint64(buckets)).astype(np.int64)
    # Words leave, and their ids come back, in bucket order; the block keeps which index each of them has.
    order = np.argsort(bucket, kind="stable")
    doc_ids = pa.concat_arrays(ids)
    known = doc_ids.is_valid().to_numpy(zero_copy_only=False)
    keys = doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes() + known.astype(np.uint8).tobytes()
    steps = np.diff(order, prepend=0) % (1 << 32)
    pieces = [pa.compress(keys, "zstd", asbytes=True), _press(np.concatenate(counts) if counts else np.zeros(0)), _press(steps), _press(rank[sequence])]
    yield block, -1, 0, len(doc_ids), len(pieces[0]).to_bytes(8, "little") + b"".join(pieces)
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
    for b in np.unique(bucket).tolist():
        some = [listed[i] for i in order[cuts[b] : cuts[b + 1]]]
        yield block, b, 1, len(some), _join_bytes(some)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["block", "bucket", "kind", "n", "data"])


def encode(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(doc_id, ids) with ids array<int>, one row per document."""
    return _assembled(docs, ranks, pattern, digests=False)


def _assembled(docs: DataFrame, ranks: bytes, pattern: str, digests: bool) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        block, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            column = batch.column("text")
            _, at = W.flat(column)
            row = 0
            while row < len(column):
                to = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK - size, "right")) - 1)
                ids.append(batch.column("doc_id").slice(row, to - row))
                texts.append(column.slice(row, to - row))
                size += int(at[to] - at[row])
                row = to
                if size >= BLOCK or row < len(column):
                    for x in _pack(block, ids, texts, find, buckets):
                        yield _batch([x])
                    block, ids, texts, size = block + 1, [], [], 0
        if ids:
            for x in _pack(block, ids, texts, find, buckets):
                yield _batch([x])

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for batch in batches:
            rows = []
            for block, bucket, kind, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                if kind:
                    once = _codec(shared.value, pattern)[1].encode_ordinary
                    words, got = _split_bytes(data), []
                    if len(known) > KNOWN:
                        known.clear()
                    for w in words:
                        if w not in known:
                            known[w] = np.array(once(w.decode()), "<u4").tobytes()
                        got.append(known[w])
                    data = _press(np.array([len(g) // 4 for g in got])) + _press(np.frombuffer(b"".join(got), "<u4"))
                    n = len(got)
                rows.append((block, bucket, kind, n, data))
            if rows:
                yield _batch(rows)

    table = {}

    def token_bytes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not table:
            by_id = {i: t for t, i in _codec(shared.value, pattern)[0].items()}
            length = np.array([len(by_id.get(i, b"")) for i in range(max(by_id) + 1)], np.int64)
            table["all"] = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(len(length))), np.uint8), np.cumsum(length) - length, length
        return table["all"]

    def assemble(group: pa.Table) -> pa.Table:
        data, bucket, kind = (group.column(c).to_pylist() for c in ("data", "bucket", "kind"))
        whole = data[kind.index(0)]
        at = 8 + int.from_bytes(whole[:8], "little")
        rows = group.column("n").to_pylist()[kind.index(0)]
        keys = pa.decompress(whole[8:at], 9 * rows, "zstd", asbytes=True)
        doc_ids = pa.array(np.frombuffer(keys[: 8 * rows], "<i8"), mask=np.frombuffer(keys[8 * rows :], np.uint8) == 0)
        parts = []
        for _ in range(3):
            size = _pressed_size(whole[at : at + 16])
            parts.append(_unpress(whole[at : at + size]))
            at += size
        counts, sequence = parts[0].astype(np.int64), parts[2]
        order = np.cumsum(parts[1].astype(np.int64)) % (1 << 32)
        lengths, values = [], []
        for _, raw in sorted((bu, d) for bu, k, d in zip(bucket, kind, data) if k):
            half = _pressed_size(raw)
            lengths.append(_unpress(raw[:half]))
            values.append(_unpress(raw[half:]))
        length = np.concatenate(lengths).astype(np.int64) if lengths else np.zeros(0, np.int64)
        value = np.concatenate(values) if values else np.zeros(0, np.uint32)
        offset = np.cumsum(length) - length
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        length, offset = length[back], offset[back]
        out = {"doc_id": doc_ids}
        sizes, hashes, decoded, ids = [], [], [], []
        at = np.concatenate(([0], np.cumsum(counts)))
        # A few documents at a time: what is held does not grow with the block's ids.
        row = 0
        while row < rows:
            to = max(row + 1, int(np.searchsorted(at, at[row] + (1 << 18), "right")) - 1)
            some = sequence[at[row] : at[to]]
            n = np.concatenate(([0], np.cumsum(length[some])))[at[row : to + 1] - at[row]]
            got = W.gather(value, offset, length, some).astype("<u4")
            sizes.append(np.diff(n))
            if digests:
                raw = got.tobytes()
                text, where, width = token_bytes()
                plain = W.gather(text, where, width, got).tobytes()
                m = np.concatenate(([0], np.cumsum(width[got])))[n]
                hashes += [hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(n.tolist(), n[1:].tolist())]
                decoded += [hashlib.sha256(plain[i:j]).hexdigest() for i, j in zip(m.tolist(), m[1:].tolist())]
            else:
                ids += [got[i:j].view(np.int32) for i, j in zip(n.tolist(), n[1:].tolist())]
            row = to
        if not digests:
            return pa.table(out | {"ids": W.ragged(ids, pa.int32())})
        return pa.table(out | {"n_tokens": pa.array(np.concatenate(sizes).astype(np.int64)), "ids_sha256": hashes, "decoded_sha256": decoded})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = slim.mapInArrow(pack, SHIPPED)
    # Documents of a block (bucket -1) only pass through; they are spread by block.
    by_word = F.when(F.col("kind") == 1, F.col("bucket")).otherwise(F.xxhash64("block"))
    encoded = packed.repartition(by_word).mapInArrow(encode_words, SHIPPED)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>"
    return encoded.groupBy("block").applyInArrow(assemble, schema)


def decode(ids: DataFrame, ranks: bytes) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), by the token-byte table."""
    shared = ids.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = {i: t for t, i in read_ranks(shared.value).items()}
        for batch in batches:
            text = [None if x is None else b"".join(by_id[i] for i in x).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per document."""
    return _assembled(docs, ranks, pattern, digests=True)
