"""Finding tokens that several owners hold, by one shuffle of packed postings.

A token is a 64-bit hash, its owner a 64-bit id. Every task sorts the (token, owner) pairs of a chunk of rows, packs
those of a range of tokens into one row, and Spark shuffles the rows by range. Within a chunk a token that two owners
hold is settled at once, so at most one posting per chunk and token is shuffled, however frequent the token is.

Tokens are shuffled with 32 bits beside those of their range. Two tokens that agree in all of them count as one, which
can only make an owner look more shared than it is; callers check exactly afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Units = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]

_SCHEMA = pa.schema([("range", pa.int32()), ("tokens", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary())])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bits(spark: SparkSession) -> int:
    """Leading bits of a token that name its range: some sixteen ranges per shuffle partition, which level out."""
    return max(4, (16 * partitions(spark) - 1).bit_length())


def short(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits of a token behind those of its range."""
    return (tokens >> np.uint64(32 - bits)).astype(np.uint32)


def ranges(tokens: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, first, last + 1) of sorted tokens."""
    of = (tokens >> np.uint64(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else of
    yield from zip(of[at].tolist(), at.tolist(), [*at[1:].tolist(), len(of)])


def _distinct(tokens: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order of tokens, the first pair of every token, and how many pairs its token has."""
    order = np.lexsort((owners, tokens))
    t, o = tokens[order], owners[order]
    if len(t):
        keep = np.concatenate(([True], (t[1:] != t[:-1]) | (o[1:] != o[:-1])))
        t, o = t[keep], o[keep]
    first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
    return t, o, first, np.diff(np.append(first, len(t)))


def _counted(owners: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners in order, how many tokens each has, and the tokens in that order."""
    order = np.argsort(owners, kind="stable")
    o, n = np.unique(owners, return_counts=True)
    return o, n, tokens[order]


def _gathered(batches: Iterator[pa.RecordBatch], units: Units, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The units of all batches, joined until they are ``least`` tokens."""
    held, size = [], 0
    for batch in batches:
        for unit in units(batch):
            held.append(unit)
            size += len(unit[0])
            if size >= least:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def shared(rows: DataFrame, units: Units, lists: bool = False, together: int = 0) -> DataFrame:
    """(owner long, n long[, tokens array<binary>]) of the owners with tokens that other owners hold too.

    ``units`` gives tokens and owners of a batch of ``rows``, a chunk at a time; owners are never zero. Chunks of fewer
    than ``together`` tokens are joined. ``n`` counts
    shared tokens, at least as many as there are; ``tokens`` are the ``short`` forms of the shared ones, packed. The number
    of partitions is what Spark's number of shuffle partitions says, so that setting has to follow the input as for any
    other shuffle: a task holds the postings of one partition.
    """
    bits = range_bits(rows.sparkSession)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, owners in _gathered(batches, units, together):
            t, o, first, count = _distinct(tokens, owners)
            if not len(t):
                continue
            many = count > 1
            of = np.repeat(many, count)
            owner, n, held = _counted(o[of], short(t[of], bits))
            t, o = t[first], np.where(many, np.uint64(0), o[first])
            head = short(t, bits)
            out = [(r, head[a:b].tobytes(), o[a:b].tobytes(), None) for r, a, b in ranges(t, bits)]
            if len(owner):
                out.append((int(owner[0] & np.uint64(0x7FFFFFFF)) >> max(0, 31 - bits), held.tobytes() if lists else b"", owner.tobytes(), n.astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, known = [], [], []
        for batch in batches:
            for r, t, o, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                who = np.frombuffer(o, np.uint64)
                if n is None:
                    keys.append(np.frombuffer(t, np.uint32).astype(np.uint64) | np.uint64(r << 32))
                    owners.append(who)
                else:
                    known.append((who, np.frombuffer(n, np.uint32), np.frombuffer(t, np.uint32)))
        k, o, first, count = _distinct(np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
        # Owner zero sorts first: the token is known to be shared.
        many = (count > 1) | (o[first] == 0) if len(first) else np.zeros(0, bool)
        of = np.repeat(many, count) & (o != 0)
        known.append(_counted(o[of], k[of].astype(np.uint32)))
        for owner, n, toks in known:
            for a in range(0, len(owner), 50_000):
                own, num = owner[a : a + 50_000], n[a : a + 50_000].astype(np.int64)
                columns = [pa.array(own.view(np.int64)), pa.array(num)]
                if lists:
                    from_ = int(n[:a].sum())
                    at = from_ + np.concatenate(([0], np.cumsum(num)))
                    columns.append(pa.array([toks[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["owner", "n", "tokens"][: len(columns)])

    packed = rows.mapInArrow(post, "range int, tokens binary, owners binary, counts binary")
    met = packed.repartition(partitions(rows.sparkSession), "range").mapInArrow(meet, "owner long, n long" + ", tokens binary" * lists)
    return met.groupBy("owner").agg(F.sum("n").alias("n"), *[F.collect_list("tokens").alias("tokens")] * lists)
