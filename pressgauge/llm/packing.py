"""Packing token ids into training sequences by best-fit decreasing.

Tasks encode their documents and pack them in blocks of some MB of text, so nothing is shuffled and no plan of all
documents exists anywhere. In a block

1. a document longer than a sequence is first cut into full sequences and a rest;
2. rests, longest first, go to the open sequence with the least capacity that still holds them, found in a segment tree
   indexed by remaining capacity; if there is none, a new sequence is opened;
3. sequences that would still be padded by more than ``slack`` tokens are opened again: their pieces are laid end to end
   and cut at the sequence length. What is left of that in the end is cut at powers of two, which need no padding.

So no sequence is padded by more than ``slack`` tokens, whatever the lengths are; only documents of sequences opened again
are cut more than their length demands.

A sequence takes documents of one block, which lie near each other in the input: where neighbours are alike, deal the
documents out at random before packing.

Text is cut into pieces at the start of white space, and before ASCII punctuation other than the apostrophe that follows
an ASCII letter or digit, where the byte-level pattern always cuts as well; a chunk's distinct pieces are encoded once,
and once per Python worker as long as they stay in a cache of bounded size.

Edge cases: null text counts as empty and is one piece with the end id only; rows that repeat a doc_id, and null doc_ids,
are documents of their own; a text longer than a block is a block; an empty table gives no rows; other columns are not
read. Sequence ids hold the input partition and a running number: a rerun over the same files gives the same sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm import words as W

#: Bytes of ids (four each) that are packed together.
BLOCK = 16 << 20
#: Distinct pieces that a Python worker keeps encoded, in two generations of half as many.
CACHE = 300_000
#: Ids of sequences that go to Spark at once.
SEND = 1 << 19
_loaded: dict = {}

PIECES = "pieces array<struct<doc_id: long, start: long, length: long, doc_tokens: long, offset: long>>"
SCHEMA = f"sequence_id long, ids array<int>, {PIECES}"


class ByteEncoder:
    """Encodes distinct pieces of text with a byte-level tokenizer of the tokenizers library."""

    def __init__(self, config: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_buffer(config)
        self.model.encode_special_tokens = True
        vocabulary = self.model.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)  # a byte-level token has a character per byte
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        probe = [b"a", b" B1", b".", b" c", b",\"d7", b"-e", b"\n\n c\xc3\xa9's", b"  ", b"\t<x", b">"]
        if np.concatenate(self._each(probe)).tolist() != self._each([b"".join(probe)])[0].tolist():
            raise ValueError("the tokenizer must be byte-level and cut wherever white space begins, and between letters or digits and punctuation")

    @classmethod
    def of(cls, config: bytes) -> ByteEncoder:
        key = hash(config)
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = cls(config)
        return _loaded[key]

    def _each(self, parts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]

    def _together(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of parts that begin with white space and do not end with it, encoded as one text."""
        ids = np.array(self.model.encode_batch_fast([b"".join(parts).decode()], add_special_tokens=False)[0].ids, np.uint32)
        ends, reached = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))), np.cumsum(self.width[ids])
        stop = np.searchsorted(reached, ends) + 1
        if stop[-1] == len(ids) and np.array_equal(reached[stop - 1], ends):
            return ids, np.diff(stop, prepend=0)
        one_by_one = self._each(parts)
        return np.concatenate(one_by_one), np.array([len(x) for x in one_by_one])

    def encode(self, parts: list[bytes], plain: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offset, number of ids) of each part.

        ``plain`` parts may be encoded together; parts that come ``again`` are kept for later calls.
        """
        young, old = self.young, self.old
        known = [young.get(p) or old.get(p) for p in parts]
        new = np.fromiter((x is None for x in known), bool, len(parts))
        offset, length = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        hits = [x for x in known if x is not None]
        values = [np.frombuffer(b"".join(hits), np.uint32)]
        at = len(values[0])
        length[~new] = np.fromiter(map(len, hits), np.int64, len(hits)) // 4
        offset[~new] = np.cumsum(length[~new]) - length[~new]
        for group, joined in ((np.flatnonzero(new & plain), True), (np.flatnonzero(new & ~plain), False)):
            for k in range(0, len(group), 1000):
                some = group[k : k + 1000]
                listed = [parts[i] for i in some.tolist()]
                if joined:
                    ids, n = self._together(listed)
                else:
                    each = self._each(listed)
                    ids, n = np.concatenate(each), np.array([len(x) for x in each])
                length[some], offset[some] = n, at + np.cumsum(n) - n
                values.append(ids)
                at += len(ids)
        flat = np.concatenate(values)
        kept = np.flatnonzero(again)[: CACHE // 2].tolist()
        if len(young) + len(kept) > CACHE // 2:
            self.old, self.young = young, {}
        self.young.update((parts[i], known[i] or flat[offset[i] : offset[i] + length[i]].tobytes()) for i in kept)
        return flat, offset, length


def encode_rows(column: pa.Array, encoder: ByteEncoder, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, number of ids per row) for chunks of rows, the end id after each row's ids."""
    for _, data, at in W.chunks(column, 8 << 20):
        start, end, row = W.pieces(data, at, punctuation=True)
        edges = pa.py_buffer(np.append(start, len(data)).astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, edges, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        index, distinct = coded.indices.to_numpy(), coded.dictionary
        plain = np.zeros(len(distinct), bool)
        if len(distinct):
            # A piece that begins with ASCII white space and does not end with white space of any kind.
            edge = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1]
            body = np.frombuffer(distinct.buffers()[2], np.uint8)
            plain = W.SPACE[body[edge[:-1]]] & ~W.white(body[: edge[-1]])[edge[1:] - 1]
        ids, offset, length = encoder.encode(distinct.to_pylist(), plain, np.bincount(index, minlength=len(distinct)) > 1)
        rows = np.arange(len(at) - 1)
        # The end id is one more piece after the last of every row.
        last = np.searchsorted(row, rows, "right")
        index = np.insert(index, last, len(distinct))
        ids, offset, length = np.append(ids, np.uint32(end_id)), np.append(offset, len(ids)), np.append(length, 1)
        per_piece = length[index]
        edge = np.concatenate(([0], np.cumsum(per_piece)))
        counts = np.diff(edge[np.concatenate(([0], last + rows + 1))])
        yield W.gather(ids, offset, length, index), counts


class OpenSequences:
    """Open sequences by remaining capacity: a segment tree whose nodes tell whether a capacity below them is there."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, remaining: int, sequence: int) -> None:
        self.stacks[remaining].append(sequence)
        node = remaining + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(remaining capacity, sequence) of the tightest open sequence for ``need`` tokens, which is open no more."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        remaining = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return remaining, self.stacks[remaining].pop()


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of indices of ``lengths``, none of which is above the capacity."""
    open_, out = OpenSequences(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = open_.take(lengths[i])
        if found is None:
            found = capacity, len(out)
            out.append([])
        out[found[1]].append(i)
        if found[0] > lengths[i]:
            open_.put(found[0] - lengths[i], found[1])
    return out


def plan(lengths: np.ndarray, capacity: int, slack: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, first token, tokens) for documents of these lengths."""
    out, rests = [], []
    for i, n in enumerate(lengths.tolist()):
        whole = n // capacity * capacity
        out += [[(i, at, capacity)] for at in range(0, whole, capacity)]
        if n > whole:
            rests.append((i, whole, n - whole))
    again = []
    for sequence in best_fit([r[2] for r in rests], capacity):
        used = sum(rests[k][2] for k in sequence)
        loose = capacity - used > slack and used & (used - 1)
        (again if loose else out).append([rests[k] for k in sequence])
    queue = [piece for sequence in again for piece in sequence]
    left = sum(n for _, _, n in queue)
    current, room = [], 0
    for i, at, n in queue:
        while n:
            if not room:
                # A full sequence, or the largest power of two below what is left.
                room = min(capacity, 1 << (left.bit_length() - 1)) if left < capacity else capacity
                current = []
                out.append(current)
            take = min(n, room)
            current.append((i, at, take))
            at, n, room, left = at + take, n - take, room - take, left - take
    return out


def pack(docs: DataFrame, config: bytes, end_id: int, capacity: int = 2048, pad_id: int = 0, slack: int | None = None) -> DataFrame:
    """(sequence_id, ids, pieces): a row per sequence, padded with ``pad_id`` to ``capacity`` unless its length is a power of two."""
    shared = docs.sparkSession.sparkContext.broadcast(config)
    slack = capacity // 64 if slack is None else slack

    def sequences(doc_ids: list[pa.Array], ids: list[np.ndarray], counts: list[np.ndarray], base: int) -> Iterator[pa.RecordBatch]:
        keys, flat, length = pa.concat_arrays(doc_ids), np.concatenate(ids), np.concatenate(counts)
        first = np.concatenate(([0], np.cumsum(length)))
        planned = plan(length, capacity, slack)
        k = 0
        while k < len(planned):
            some, size = [], 0
            while k < len(planned) and size < SEND:
                used = sum(p[2] for p in planned[k])
                some.append((planned[k], used, used if used & (used - 1) == 0 else capacity))
                size += some[-1][2]
                k += 1
            piece = np.array([p for s, _, _ in some for p in s], np.int64).reshape(-1, 3)
            per = np.array([len(s) for s, _, _ in some], np.int64)
            used, padded = (np.array([s[j] for s in some], np.int64) for j in (1, 2))
            values = np.full(int(padded.sum()), pad_id, np.int32)
            start = np.cumsum(padded) - padded
            before = np.cumsum(piece[:, 2]) - piece[:, 2]
            offset = before - np.repeat(before[np.cumsum(per) - per], per)
            to = np.repeat(np.repeat(start, per) + offset - before, piece[:, 2]) + np.arange(int(used.sum()))
            values[to] = W.gather(flat, first[piece[:, 0]] + piece[:, 1], piece[:, 2], np.arange(len(piece))).astype(np.int32)
            edges = lambda n: pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
            fields = [keys.take(pa.array(piece[:, 0])), pa.array(piece[:, 1]), pa.array(piece[:, 2]), pa.array(length[piece[:, 0]]), pa.array(offset)]
            struct = pa.StructArray.from_arrays(fields, names=["doc_id", "start", "length", "doc_tokens", "offset"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(base + k - len(some) + np.arange(len(some))),
                    pa.ListArray.from_arrays(edges(padded), pa.array(values)),
                    pa.ListArray.from_arrays(edges(per), struct),
                ],
                names=["sequence_id", "ids", "pieces"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base = ByteEncoder.of(shared.value), TaskContext.get().partitionId() << 40
        doc_ids, ids, counts, size = [], [], [], 0
        for batch in batches:
            row = 0
            for some, n in encode_rows(batch.column("text"), encoder, end_id):
                doc_ids.append(batch.column("doc_id").slice(row, len(n)))
                ids.append(some)
                counts.append(n)
                row, size = row + len(n), size + 4 * len(some)
                if size >= BLOCK:
                    for out in sequences(doc_ids, ids, counts, base):
                        yield out
                        base += len(out)
                    doc_ids, ids, counts, size = [], [], [], 0
        if doc_ids:
            yield from sequences(doc_ids, ids, counts, base)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def digest(packed: DataFrame) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece, from the sequences alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, pieces = batch.column("ids"), batch.column("pieces")
            doc_id, start, length, doc_tokens, offset = pieces.flatten().flatten()
            per = np.diff(pieces.offsets.to_numpy())
            where = np.repeat(lists.offsets.to_numpy()[:-1].astype(np.int64), per) + offset.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy().astype("<u4"))).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(where.tolist(), length.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [doc_id, start, length, pa.array(crc, pa.int64()), doc_tokens, pa.array(np.repeat(batch.column("sequence_id").to_numpy(), per)), offset],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return packed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
