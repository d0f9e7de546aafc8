"""Substring deduplication by paragraph MinHash banding.

A document is a row's doc_id and exact text. Three kinds of removals are found, each among what the ones before leave:

1. ``text``: texts that are equal to that of a smaller doc_id go whole if they have ``MIN_RUN`` words or more.
2. ``line``: paragraphs are lines of ``MIN_RUN`` words or more, compared as sets of word shingles. MinHash bands, tuned
   for high recall at the wanted similarity, deal them to keys; lines that collide are verified by their exact Jaccard
   similarity and joined to components. Bands are posted packed (see ``postings``), so only lines that share a band are
   looked at again, and large groups meet by hubs and families (see ``linking``).
3. ``passage``: a passage may start and end anywhere in a line, so every run of ``MIN_RUN`` words that stood earlier
   goes. Two passes find all of them. The first picks seeds by winnowing: of every ``MIN_RUN - SEED + 1`` neighbouring
   ``SEED``-word shingles that with the least hash, so that texts which share ``MIN_RUN`` words share a seed there. The
   second posts the digests of those runs whose least shingle is a seed that repeats. The words of a run and of the place
   that keeps it are then read again and compared, so nothing goes that does not stand elsewhere word for word. As a passage of similarity 0.8 or
   more over ``SEED``-word shingles has an unchanged run of ``MIN_RUN`` words at least, every near copy is met as well;
   changed words between two removed runs go with them if the passage kept has the two runs in the same order and the
   similarity over both is high enough.

In every class the occurrence with the smallest doc_id, then text and position, stays and the others are removals. Runs
that touch a removed line never keep a passage for others, and removed texts and lines are not looked at further, so a
removal always rests on words that stay.

Words are runs of bytes other than ASCII white space with A-Z folded. Edge cases: null or blank texts have no
paragraphs and stay as they are; rows that repeat doc_id and text are one document, copies of a text under other ids
are not; null doc_ids come first; a document of which no word is left is dropped, other columns stay as they are,
except that n_chars, where present, follows the text; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.llm import words as W
from pressgauge.llm.linking import link
from pressgauge.llm.postings import partitions, range_bits, ranges, shared, short
from pressgauge.llm.scratch import Workspace, cut, small_batches, small_side

#: Words of the shortest paragraph and of the shortest run that is removed.
MIN_RUN = 20
#: Bands and rows: two lines of similarity 0.8 collide with probability 1 - (1 - 0.8**3)**20 = 0.9999994.
BANDS, ROWS = 20, 3
#: Words of a seed shingle.
SEED = 5
#: Bytes of text whose words a task looks at together.
CHUNK = 1 << 20
#: Postings of several chunks that are packed together.
TOGETHER = 1 << 17
#: Hits that a batch between Python and Spark holds.
HITS = 50_000
#: Copies of texts and other single numbers may be broadcast up to so many.
BROADCAST_IDS = 2_000_000

_ODD = np.random.default_rng(23).integers(1, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_NO_ID = -(2**63)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _packed(a: Column, b: Column) -> Column:
    """Two small numbers as one, so that lists of them are as short in rows that are sent around as they are counted."""
    return F.shiftleft(a.cast("long"), 32) + b.cast("long")


def _unpacked(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and both numbers of all entries of a column of lists of ``_packed`` ones."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    both = column.flatten().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), size), both >> 32, both & 0xFFFFFFFF


def _member(x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``x`` are among ``wanted``, where few are: their last bits rule out nearly all others before any search."""
    out, wanted = np.zeros(len(x), bool), np.sort(wanted)
    if len(wanted):
        last, marks = np.uint64((1 << 20) - 1), np.zeros(1 << 20, bool)
        marks[(wanted & last).astype(np.int64)] = True
        some = np.flatnonzero(marks[(x & last).astype(np.int64)])
        at = np.minimum(np.searchsorted(wanted, x[some]), len(wanted) - 1)
        out[some[wanted[at] == x[some]]] = True
    return out


def _slim(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row); ``row`` tells documents apart, also where doc_ids repeat or are null."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.withColumn("row", F.xxhash64("doc_id", "text"))


class Text:
    """Words of a chunk of rows with their hashes, lines and rows."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data = data
        self.start, self.end, self.row = W.spans(data, at)
        self.h = W.hashes(data, self.start, self.end, lower=True)
        self.first = np.searchsorted(self.row, np.arange(len(at)))
        self.base = at
        newline = np.flatnonzero((data == 10) | (data == 13))
        self.line = np.searchsorted(newline, self.start)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one word of every paragraph."""
        n = len(self.h)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.flatnonzero(np.concatenate(([True], (self.row[1:] != self.row[:-1]) | (self.line[1:] != self.line[:-1]))))
        stop = np.append(new[1:], n)
        keep = stop - new >= MIN_RUN
        return new[keep], stop[keep]

    def line_sets(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct shingles of all paragraphs one after another, where each begins, and their digests."""
        a, b = self.lines()
        if not len(a):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        size = b - a - k + 1
        items = W.gather(W.shingles(self.h, k), a, size, np.arange(len(a)))
        of = np.repeat(np.arange(len(a)), size)
        # Paragraphs and the first bits of items in one number are sorted faster; later bits decide only where those agree.
        key = of.astype(np.uint64) << np.uint64(40) | items >> np.uint64(24)
        order = np.argsort(key)
        if len(a) >= 1 << 24 or ((key[order[1:]] == key[order[:-1]]) & (items[order[1:]] != items[order[:-1]])).any():
            order = np.lexsort((items, of))
        items, of = items[order], of[order]
        keep = np.concatenate(([True], (items[1:] != items[:-1]) | (of[1:] != of[:-1])))
        items, of = items[keep], of[keep]
        first = np.searchsorted(of, np.arange(len(a)))
        return items, first, W.digests(items, first)

    def bounds(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, first byte and end byte in the row of the words from a to b - 1."""
        row = self.row[a]
        return row, (self.start[a] - self.base[row]).astype(np.int32), (self.end[b - 1] - self.base[row]).astype(np.int32)

    def removed(self, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For every place between words how many words before it lie in the given byte spans of rows."""
        inside = np.zeros(len(self.h) + 1, np.int64)
        a = np.searchsorted(self.start, starts + self.base[rows])
        b = np.searchsorted(self.start, ends + self.base[rows])
        np.add.at(inside, a, 1)
        np.add.at(inside, b, -1)
        return np.concatenate(([0], np.cumsum(np.cumsum(inside)[:-1] > 0)))

    def runs(self, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words, least shingle and removed words of all runs of ``MIN_RUN`` words in one row, but for removed runs."""
        g, w = W.shingles(self.h, SEED), MIN_RUN - SEED + 1
        m = max(0, len(g) - w + 1)
        least = g[:m].copy()
        for j in range(1, w):
            np.minimum(least, g[j : j + m], out=least)
        gone = removed[MIN_RUN : MIN_RUN + m] - removed[:m]
        at = np.flatnonzero((self.row[:m] == self.row[MIN_RUN - 1 :][:m]) & (gone < MIN_RUN))
        return at, least[at], gone[at]

    def digests(self, at: np.ndarray) -> np.ndarray:
        digest = np.zeros(len(at), np.uint64)
        for j in range(MIN_RUN):
            digest = W.mix(digest * np.uint64(0x9E3779B97F4A7C15) + self.h[at + j])
        return digest


def _bands(items: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash band keys (paragraph, band)."""
    x = (items >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(first), BANDS), np.uint64)
    for band in range(BANDS):
        for r in range(ROWS):
            least = np.minimum.reduceat(x * _ODD[band * ROWS + r], first)
            out[:, band] = W.mix(out[:, band] * np.uint64(31) + least)
    return W.mix(out + np.arange(BANDS, dtype=np.uint64))


def _band_lists(items: np.ndarray, first: np.ndarray) -> pa.ListArray:
    bands = _bands(items, first) if len(first) else np.zeros((0, BANDS), np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(first) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel().view(np.int64)))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Text]]:
    """First row, number of rows and words of the chunks of a batch."""
    for first, data, at in W.chunks(batch.column("text"), CHUNK):
        yield first, len(at) - 1, Text(data, at)


def copies(docs: DataFrame) -> DataFrame:
    """(row, keep_doc_id) of the documents whose text a smaller doc_id has as well, null ids being the smallest."""
    ids = _slim(docs).where("text is not null").select("doc_id", "row", F.xxhash64("text").alias("text_hash"))
    # min() passes over nulls, the smallest struct does not.
    least = ids.groupBy("text_hash").agg(F.min(F.struct("doc_id")).alias("keep"), F.max(F.struct("doc_id")).alias("last")).where(~F.col("keep").eqNullSafe(F.col("last")))
    same = ids.join(least.drop("last"), "text_hash").where(~F.col("doc_id").eqNullSafe(F.col("keep.doc_id")))
    return same.select("row", F.col("keep.doc_id").alias("keep_doc_id"), "text_hash").distinct()


def whole_texts(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Removals of copied texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, text in _texts(batch):
                size = np.diff(text.first)
                some = np.flatnonzero(size >= MIN_RUN)
                _, start, end = text.bounds(text.first[some], text.first[some + 1])
                took = batch.select(["doc_id", "row"]).take(pa.array(some + first))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(start), pa.array(end), pa.array(size[some].astype(np.int32))], names=["doc_id", "row", "start", "end", "n_words"])

    rows = _slim(docs).join(small_side(gone.select("row"), limit=BROADCAST_IDS), "row", "left_semi").select("doc_id", "row", "text")
    spans = rows.mapInArrow(run, "doc_id long, row long, start int, end int, n_words int").distinct()
    return spans.join(gone, "row").select("doc_id", "row", "start", "end", "n_words", F.lit("text").alias("kind"), F.col("text_hash").alias("class_id"), "keep_doc_id")


def line_units(rows: DataFrame, k: int) -> DataFrame:
    """(doc_id, row, start, end, n_words, digest, bands) of every paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, text in _texts(batch):
                a, b = text.lines()
                row, start, end = text.bounds(a, b)
                took = batch.select(["doc_id", "row"]).take(pa.array(row + first))
                items, at, digest = text.line_sets(k)
                columns = [pa.array(start), pa.array(end), pa.array((b - a).astype(np.int32)), pa.array(digest.view(np.int64)), _band_lists(items, at)]
                yield pa.RecordBatch.from_arrays([*took.columns, *columns], names=["doc_id", "row", "start", "end", "n_words", "digest", "bands"])

    return rows.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, start int, end int, n_words int, digest long, bands array<long>")


def line_sets(rows: DataFrame, k: int) -> DataFrame:
    """(node, items, bands) of every paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, text in _texts(batch):
                items, first, digest = text.line_sets(k)
                sets = pa.ListArray.from_arrays(pa.array(np.append(first, len(items)).astype(np.int32)), pa.array(items.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), sets, _band_lists(items, first)], names=["node", "items", "bands"])

    return rows.select("text").mapInArrow(run, "node long, items array<long>, bands array<long>")


def near_lines(work: Workspace, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Removals among paragraphs."""

    def units(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        owners = batch.column("digest").to_numpy().view(np.uint64)
        yield batch.column("bands").flatten().to_numpy().view(np.uint64), np.repeat(owners, BANDS)

    lines = work.cut(line_units(rows, k), "lines")
    place = F.struct("doc_id", "row", "start")
    nodes = work.cut(lines.groupBy("digest").agg(F.min(place).alias("first"), F.count_distinct("row", "start").alias("n")), "line-nodes")
    near = work.cut(nodes.join(shared(lines.select("digest", "bands"), units, together=TOGETHER).select("owner"), nodes["digest"] == F.col("owner"), "left_semi"), "near-lines")
    holders = small_side(near.select(F.col("first.row").alias("row")).distinct(), limit=BROADCAST_IDS)
    sets = line_sets(rows.join(holders, "row", "left_semi"), k)
    sets = sets.join(small_side(near.select(F.col("digest").alias("node")), limit=BROADCAST_IDS), "node", "left_semi")
    sets = work.cut(sets.dropDuplicates(["node"]), "line-sets")
    bands = sets.select(F.explode("bands").alias("key"), "node", F.size("items").alias("n"))
    keys = bands.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    members = work.cut(bands.join(keys, "key"), "line-members")

    def fits(x: str, y: str) -> Column:
        n, m = F.col(f"{x}n"), F.col(f"{y}n")
        return F.least(n, m) * 100 >= F.greatest(n, m) * percent

    labels = link(work, members, sets.select("node", "items"), percent, fits, lambda pairs: pairs, sets.select("node", F.col("bands").alias("keys")))
    named = nodes.join(labels, nodes["digest"] == labels["node"], "left").select("digest", "first", "n", F.coalesce("component", "digest").alias("class_id"))
    kept = named.groupBy("class_id").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).where("n > 1")
    classes = work.cut(named.join(kept.select("class_id", "keep"), "class_id").select("digest", "class_id", "keep"), "line-classes")
    found = lines.join(classes, "digest").where(~place.eqNullSafe(F.col("keep")))
    return found.select("doc_id", "row", "start", "end", "n_words", F.lit("line").alias("kind"), "class_id", F.col("keep.doc_id").alias("keep_doc_id")).distinct()


def _span_arrays(batch: pa.RecordBatch, first: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a chunk, starts and ends of the spans in column ``cuts``."""
    some = batch.column("cuts").slice(first, n)
    size = pc.fill_null(pc.list_value_length(some), 0).to_numpy(zero_copy_only=False)
    flat = some.flatten()
    start, end = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
    return np.repeat(np.arange(n), size), start, end


def repeated_seeds(rows: DataFrame) -> DataFrame:
    """(row, seeds array<binary>): the short forms of those seeds of a document that stand elsewhere or twice in it."""

    def units(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids = batch.column("row").to_numpy().view(np.uint64)
        for first, n, text in _texts(batch):
            at, least, _ = text.runs(text.removed(*_span_arrays(batch, first, n)))
            if not len(at):
                continue
            # Neighbouring runs have their least shingle in common as long as it is the same place.
            g, w = W.shingles(text.h, SEED), MIN_RUN - SEED + 1
            picked = np.concatenate(([True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)))
            seed, row = least[picked], text.row[at[picked]]
            owner = ids[first + row]
            # Places of a seed in its document: a second owner stands for the second place.
            is_seed = _member(g, seed)
            place = np.flatnonzero(is_seed & (text.row[: len(g)] == text.row[SEED - 1 :][: len(g)]))
            order = np.lexsort((g[place], text.row[place]))
            p = place[order]
            twice = p[1:][(g[p[1:]] == g[p[:-1]]) & (text.row[p[1:]] == text.row[p[:-1]])]
            yield np.concatenate((seed, g[twice])), np.concatenate((owner, ids[first + text.row[twice]] ^ np.uint64(1)))

    return shared(rows.select("row", "text", "cuts"), units, lists=True, together=TOGETHER).select(F.col("owner").alias("row"), F.col("tokens").alias("seeds"))


_PLACES = [("ids", np.int64), ("rows", np.int64), ("words", np.int32), ("starts", np.int32), ("ends", np.int32), ("touched", np.uint8)]


def _table(columns: dict[str, np.ndarray], order: np.ndarray) -> dict[str, np.ndarray]:
    return {c: x[order] for c, x in columns.items()}


def _ranked(digest: np.ndarray, places: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Distinct places in order of digests, untouched and early ones first, and for each the index of its digest's first."""
    order = np.lexsort((places["words"], places["rows"], places["ids"], places["touched"], digest))
    d, p = digest[order], _table(places, order)
    if len(d):
        keep = np.concatenate(([True], (d[1:] != d[:-1]) | (p["rows"][1:] != p["rows"][:-1]) | (p["words"][1:] != p["words"][:-1])))
        d, p = d[keep], _table(p, np.flatnonzero(keep))
    new = np.concatenate(([True], d[1:] != d[:-1])) if len(d) else np.zeros(0, bool)
    return d, p, np.flatnonzero(new)[np.cumsum(new) - 1] if len(d) else np.zeros(0, np.int64)


HIT = "doc_id long, row long, word int, start int, end int, digest long, keep_id long, keep_row long, keep_word int, keep_end int, keeper int"


def _hits(digest: np.ndarray, p: dict[str, np.ndarray], of: np.ndarray, keeper: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Places that are not the first of their digest, with that first. ``keeper``: 0 it stays, 1 and 2 it is a chunk's."""
    found = np.flatnonzero(of != np.arange(len(of)))
    for a in range(0, len(found), HITS):
        again = found[a : a + HITS]
        first = of[again]
        ids = [pa.array(p["ids"][x], mask=p["ids"][x] == _NO_ID) for x in (again, first)]
        columns = [ids[0], *(pa.array(p[c][again]) for c in ("rows", "words", "starts", "ends")), pa.array(digest[again].view(np.int64))]
        columns += [ids[1], *(pa.array(p[c][first]) for c in ("rows", "words", "ends")), pa.array(keeper[again])]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in HIT.split(", ")])


def run_hits(rows: DataFrame, lists: DataFrame, digest_bits: int = 64) -> DataFrame:
    """``HIT`` rows: runs of ``MIN_RUN`` words whose digest stood earlier, and the run that keeps them.

    Runs are posted packed by ranges of their digests. Within a chunk of texts equal runs are one posting; the others
    follow it (``keeper`` 1, or 2 if it touches a removed line) and take over what becomes of it.
    """
    bits = range_bits(rows.sparkSession)
    mask = np.uint64((1 << 64) - (1 << (64 - digest_bits)))
    schema = pa.schema([("range", pa.int32()), ("keys", pa.binary()), *[(c, pa.binary()) for c, _ in _PLACES], ("first", pa.binary())])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row_ids = pc.fill_null(batch.column("doc_id"), _NO_ID).to_numpy(), batch.column("row").to_numpy()
            for first, n, text in _texts(batch):
                at, least, gone = text.runs(text.removed(*_span_arrays(batch, first, n)))
                some = batch.column("seeds").slice(first, n)
                packed = [b"".join(x) for x in some.to_pylist()]
                wanted = np.frombuffer(b"".join(packed), np.uint32).astype(np.uint64)
                wanted |= np.repeat(np.arange(n, dtype=np.uint64), [len(x) // 4 for x in packed]) << np.uint64(32)
                have = short(least, bits).astype(np.uint64) | text.row[at].astype(np.uint64) << np.uint64(32)
                keep = _member(have, wanted)
                at, gone = at[keep], gone[keep]
                if not len(at):
                    continue
                row, start, end = text.bounds(at, at + MIN_RUN)
                places = dict(zip((c for c, _ in _PLACES), (ids[first + row], row_ids[first + row], (at - text.first[row]).astype(np.int32), start, end, (gone > 0).astype(np.uint8))))
                d, p, of = _ranked(text.digests(at) & mask, places)
                own = of == np.arange(len(of))
                q, tops = _table(p, np.flatnonzero(own)), d[own]
                out = [(r, tops[a:b].tobytes(), *[q[c][a:b].tobytes() for c, _ in _PLACES], None) for r, a, b in ranges(tops, bits)]
                if not own.all():
                    # Followers travel with the run they follow, whole groups together.
                    many = np.flatnonzero(np.bincount(of, minlength=len(of))[of] > 1)
                    back = np.searchsorted(many, of[many]).astype(np.int32)
                    # They meet nothing there, so any range will do; the chunk's least digest would name the same for all.
                    dealt = (int(p["rows"][0]) & 0x7FFFFFFF) >> max(0, 31 - bits)
                    out.append((dealt, d[many].tobytes(), *[p[c][many].tobytes() for c, _ in _PLACES], back.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts = [], {c: [] for c, _ in _PLACES}
        for batch in batches:
            for x in batch.to_pylist():
                if x["first"] is None:
                    keys.append(np.frombuffer(x["keys"], np.uint64))
                    for c, kind in _PLACES:
                        parts[c].append(np.frombuffer(x[c], kind))
                else:
                    p = {c: np.frombuffer(x[c], kind) for c, kind in _PLACES}
                    of = np.frombuffer(x["first"], np.int32)
                    yield from _hits(np.frombuffer(x["keys"], np.uint64), p, of, 1 + p["touched"][of].astype(np.int32))
        if keys:
            d, p, of = _ranked(np.concatenate(keys), {c: np.concatenate(v) for c, v in parts.items()})
            # A first run that touches a removed line keeps nothing.
            of = np.where(p["touched"][of] > 0, np.arange(len(of)), of)
            yield from _hits(d, p, of, np.zeros(len(of), np.int32))

    lists = small_side(lists, F.aggregate("seeds", F.lit(0), lambda n, x: n + F.octet_length(x)), limit=BROADCAST_IDS)
    some = rows.join(lists, "row").select("doc_id", "row", "text", "cuts", "seeds")
    packed = some.mapInArrow(post, "range int, keys binary, " + ", ".join(f"{c} binary" for c, _ in _PLACES) + ", first binary")
    return packed.repartition(partitions(rows.sparkSession), "range").mapInArrow(meet, HIT)


def _plain(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words in lower case with one blank between those of a row, and where each begins and ends."""
    keep, low = ~W.SPACE[data], _FOLD[data]
    after = end[end < len(data)]
    after = after[~keep[after]]
    keep[after], low[after] = True, 32
    place = np.cumsum(keep)
    return low[keep].tobytes(), place[start] - 1, place[end - 1]


def same_words(work: Workspace, rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Those of ``runs`` whose words are, one by one, those that the document which keeps them has there.

    Runs are found by digests; this reads the words of both places again. A place is read once however many runs it keeps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in W.chunks(batch.column("text"), CHUNK):
                start, end, of = W.spans(data, at)
                low, begin, stop = _plain(data, start, end)
                row, a, b = _unpacked(batch.column("places").slice(first, len(at) - 1))
                word = np.searchsorted(of, np.arange(len(at) - 1))[row]
                read = [hashlib.blake2b(low[i:j], digest_size=16).digest() for i, j in zip(begin[word + a].tolist(), stop[word + b - 1].tolist())]
                two = np.frombuffer(b"".join(read), "<i8").reshape(-1, 2)
                took = batch.column("row").take(pa.array(row + first))
                yield pa.RecordBatch.from_arrays([took, pa.array(a << 32 | b), pa.array(two[:, 0]), pa.array(two[:, 1])], names=["at_row", "place", "x", "y"])

    word, stop, shift = F.col("word"), F.col("stop"), F.col("shift")
    runs = runs.withColumn("_a", _packed(word, stop)).withColumn("_b", _packed(word + shift, stop + shift))
    places = runs.select("row", F.col("_a").alias("place")).unionByName(runs.select(F.col("keep_row").alias("row"), F.col("_b").alias("place")))
    places = work.cut(places.groupBy("row").agg(F.collect_set("place").alias("places")), "places")
    # Texts without places stay where they are, also if places are too many to be sent around.
    some = rows.select("row", "text").join(small_side(places.select("row"), limit=BROADCAST_IDS), "row", "left_semi")
    read = some.join(small_side(places, F.size("places") * 8), "row").mapInArrow(run, "at_row long, place long, x long, y long").dropDuplicates(["at_row", "place"])
    read = work.cut(read, "read")
    one = read.select(F.col("at_row").alias("row"), F.col("place").alias("_a"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    other = read.select(F.col("at_row").alias("keep_row"), F.col("place").alias("_b"), "x", "y")
    kept = runs.join(one, ["row", "_a"]).join(other, ["keep_row", "_b"])
    return kept.where("x = _x and y = _y").drop("_a", "_b", "_x", "_y", "x", "y")


def repeated_runs(work: Workspace, rows: DataFrame, percent: int, digest_bits: int = 64) -> DataFrame:
    """Removals of passages that stood earlier word for word, and of changed words between two of them.

    ``digest_bits`` are the bits of a run's digest that decide what is compared word by word.
    """
    hits = work.cut(run_hits(rows, work.cut(repeated_seeds(rows), "seeds"), digest_bits), "hits")
    final, followers = hits.where("keeper = 0"), hits.where("keeper > 0")
    became = final.select(F.col("row").alias("keep_row"), F.col("word").alias("keep_word"), *[F.col(c).alias(f"_{c}") for c in ("keep_id", "keep_row", "keep_word", "keep_end")])
    moved = followers.join(became, ["keep_row", "keep_word"], "left").where("_keep_row is not null or keeper = 1")
    pick = lambda c: F.when(F.col("_keep_row").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    moved = moved.select("doc_id", "row", "word", "start", "end", "digest", *[pick(c) for c in ("keep_id", "keep_row", "keep_word", "keep_end")])
    again = final.drop("keeper").unionByName(moved)
    # Neighbouring runs that stand in the same way in the text that keeps them are one piece, whose words are compared.
    text = Window.partitionBy("row").orderBy("word")
    again = again.withColumn("shift", F.col("keep_word") - F.col("word"))
    joined = (F.lag("keep_row").over(text) == F.col("keep_row")) & (F.lag("shift").over(text) == F.col("shift")) & (F.lag("word").over(text) >= F.col("word") - 1)
    again = again.withColumn("new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("piece", F.sum("new").over(text))
    pieces = again.groupBy("row", "piece").agg(
        F.first("doc_id").alias("doc_id"), F.min("word").alias("word"), (F.max("word") + MIN_RUN).alias("stop"), F.min("start").alias("start"), F.max("end").alias("end"), F.first("shift").alias("shift"),
        F.min_by("digest", "word").alias("digest"), F.first("keep_row").alias("keep_row"), F.first("keep_id").alias("keep_id"), F.min_by("keep_end", "word").alias("keep_end"),
    )
    pieces = same_words(work, rows, work.cut(pieces, "pieces"))
    # Neighbouring pieces of a text that itself keeps them, which shift by every period, are one passage too.
    joined = (F.lag("keep_row").over(text) == F.col("keep_row")) & (F.col("keep_row") == F.col("row")) & (F.lag("stop").over(text) >= F.col("word") + MIN_RUN - 1)
    pieces = pieces.withColumn("new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(text))
    runs = pieces.groupBy("row", "run").agg(
        F.first("doc_id").alias("doc_id"), F.min("word").alias("word"), F.max("stop").alias("stop"), F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("shift", "word").alias("shift"),
        F.min_by("digest", "word").alias("class_id"), F.first("keep_row").alias("keep_row"), F.first("keep_id").alias("keep_doc_id"), F.min_by("keep_end", "word").alias("keep_end"),
    )
    runs = work.cut(runs, "runs")
    own = F.col("keep_row") == F.col("row")
    # A text that repeats itself within MIN_RUN words keeps its first run whole.
    over = F.when(own, F.greatest(F.lit(0), MIN_RUN + F.col("shift"))).otherwise(0)
    plain = runs.withColumn("n_words", (F.col("stop") - F.col("word") - over).cast("int")).withColumn("start", F.when(over > 0, F.col("keep_end")).otherwise(F.col("start")))
    names = ["doc_id", "row", "start", "end", "n_words", F.lit("passage").alias("kind"), "class_id", "keep_doc_id"]
    before = {c: F.lag(c).over(Window.partitionBy("row").orderBy("word")) for c in ("word", "stop", "end", "shift", "keep_row")}
    pairs = runs.select("*", *[c.alias(f"p_{n}") for n, c in before.items()])
    pairs = pairs.where((F.col("p_keep_row") == F.col("keep_row")) & ~own & (F.col("word") > F.col("p_stop")) & (F.col("word") + F.col("shift") >= F.col("p_stop") + F.col("p_shift")))
    less = SEED - 1
    common = F.col("p_stop") - F.col("p_word") + F.col("stop") - F.col("word") - 2 * less
    both = 2 * (F.col("stop") - F.col("p_word") - less) + F.col("shift") - F.col("p_shift")
    near = pairs.where(common * 100 >= (both - common) * percent)
    between = near.withColumn("n_words", (F.col("word") - F.col("p_stop")).cast("int")).withColumn("end", F.col("start")).withColumn("start", F.col("p_end"))
    return plain.select(*names).unionByName(between.select(*names))


def removals(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, row, start, end, n_words, kind, class_id, keep_doc_id): byte spans to remove, which may overlap."""
    small_batches(docs.sparkSession)
    work, early = Workspace(docs.sparkSession, "paragraphs"), Workspace(docs.sparkSession, "paragraph-lines")
    gone = work.cut(copies(docs), "copies")
    rows = _slim(docs).where("text is not null").join(small_side(gone.select("row"), limit=BROADCAST_IDS), "row", "left_anti")
    lines = work.cut(whole_texts(docs, gone).unionByName(near_lines(early, rows, k, percent)), "lines-out")
    early.close()
    cuts = lines.where("kind = 'line'").groupBy("row").agg(F.collect_list(_packed(F.col("start"), F.col("end"))).alias("cuts"))
    cuts = small_side(work.cut(cuts, "cuts"), F.size("cuts") * 8, limit=BROADCAST_IDS)
    unpack = lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("start"), x.bitwiseAND(0xFFFFFFFF).cast("int").alias("end"))
    rows = rows.join(cuts, "row", "left").withColumn("cuts", F.transform("cuts", unpack))
    found = cut(lines.unionByName(repeated_runs(work, rows, percent)), "removals")
    work.close()
    return found


def without(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans cut out of their texts; documents of which no word is left are dropped."""
    lists = cut(spans.groupBy(F.col("row").alias("_row")).agg(F.collect_list(_packed(F.col("start"), F.col("end"))).alias("_cut")), "spans")
    names = docs.columns
    lists = small_side(lists, F.size("_cut") * 8, limit=BROADCAST_IDS)
    # A struct keeps the columns of ``docs`` apart from those of the join, whatever their names.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("d"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("_row"))
    joined = keyed.join(lists, "_row", "left")
    untouched = joined.where(F.col("_cut").isNull()).select("d.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = dict(zip(names, batch.column("d").flatten()))
            column, texts, keep = whole["text"], [], [np.zeros(0, bool)]
            for first, data, at in W.chunks(column):
                row, start, end = _unpacked(batch.column("_cut").slice(first, len(at) - 1))
                inside = np.zeros(len(data) + 1, np.int64)
                np.add.at(inside, at[row] + start, 1)
                np.add.at(inside, at[row] + end, -1)
                left = np.cumsum(inside[:-1]) == 0
                to, words = (np.concatenate(([0], np.cumsum(x)))[at] for x in (left, left & ~W.SPACE[data]))
                keep.append((np.diff(to) == np.diff(at)) | (np.diff(words) > 0))
                texts.append(pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(data[left])]))
            new = pa.concat_arrays(texts) if texts else pa.array([], pa.string())
            changed = {"text": new}
            if "n_chars" in names:
                changed["n_chars"] = pc.utf8_length(new)
            out = pa.table({c: changed[c].cast(x.type) if c in changed else x for c, x in whole.items()}).filter(pa.array(np.concatenate(keep)))
            yield from out.to_batches()

    touched = joined.where(F.col("_cut").isNotNull() & F.col("d.text").isNotNull()).select("d", "_cut").mapInArrow(run, docs.schema)
    return untouched.unionByName(touched)


def dedup_passages(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without repeated texts, lines and passages."""
    return without(docs, removals(docs, k, percent))
