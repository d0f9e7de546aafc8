"""Word positions and 64-bit word hashes of whole Arrow text columns, computed with numpy inside Spark tasks.

A word is a run of bytes other than ASCII white space. Memory is bounded by ``CHUNK`` bytes or the longest single
text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 4 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_COEF = np.random.default_rng(11).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows with about ``most`` bytes together, at least one row each."""
    data, at = flat(column)
    row, n = 0, len(at) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, data[at[row] : at[to]], at[row : to + 1] - at[row]
        row = to


def spans(data: np.ndarray, at: np.ndarray, stop: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~stop[data]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    joined = inside[1:] & inside[:-1] & ~cut[1:n]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~joined
    last[:-1] &= ~joined
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, most: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each span's bytes; ``lower`` folds A-Z."""
    out, table, k = np.empty(len(start), np.uint64), _LOWER if lower else _BYTE, 0
    while k < len(start):
        to = max(k + 1, int(np.searchsorted(end, start[k] + most, "right")))
        lo, hi = int(start[k]), int(end[to - 1])
        up, down = _power_tables(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * up[: hi - lo], out=total[1:])
        a, b = start[k:to] - lo, end[k:to] - lo
        out[k:to] = (total[b] - total[a]) * down[a]
        k = to
    return mix(out)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes, over row boundaries too; the caller keeps those inside a row."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m] * _COEF[0]
    for j in range(1, k):
        out = out + h[j : j + m] * _COEF[j]
    return mix(out)


def sequence(h: np.ndarray) -> np.uint64:
    """A hash of a short sequence of words as one item."""
    return mix(np.array([(h * _COEF[: len(h)]).sum() + np.uint64(len(h))], np.uint64))[0]


def row_sets(data: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row its sorted distinct k-word shingles with A-Z folded; a shorter row is one item, a blank one none."""
    start, end, row = spans(data, at)
    h = hashes(data, start, end, lower=True)
    first = np.searchsorted(row, np.arange(len(at)))
    sh = shingles(h, k)
    for i in range(len(at) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            u = np.sort(sh[a : b - k + 1])
            yield u[np.concatenate(([True], u[1:] != u[:-1]))]
        elif b > a:
            yield np.array([sequence(h[a:b])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def digest(u: np.ndarray) -> np.uint64:
    """A 64-bit digest of a set of hashes."""
    return mix(np.array([mix(u ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum() + np.uint64(len(u))], np.uint64))[0]


def digests(items: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``digest`` of each of the sets that begin at ``first``, none of them empty."""
    if not len(first):
        return np.zeros(0, np.uint64)
    total = np.add.reduceat(mix(items ^ np.uint64(0xA5A5A5A55A5A5A5A)), first)
    return mix(total + np.diff(np.append(first, len(items))).astype(np.uint64))


def ragged(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from arrays."""
    at = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(values) if values else np.zeros(0), kind))


# White space beyond ASCII, as UTF-8: fixed values of the Unicode White_Space property.
_WIDE_SPACE = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE_CODES = np.array(sorted(int.from_bytes(c.encode(), "big") for c in _WIDE_SPACE), np.int64)


def white(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space in the Unicode sense."""
    out = SPACE[data]
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        wide = data.astype(np.int64)
        two = lead[(data[lead] == 0xC2) & (lead + 1 < len(data))]
        two = two[np.isin((wide[two] << 8) | wide[two + 1], _WIDE_CODES)]
        three = lead[(data[lead] != 0xC2) & (lead + 2 < len(data))]
        three = three[np.isin((wide[three] << 16) | (wide[three + 1] << 8) | wide[three + 2], _WIDE_CODES)]
        for at, length in ((two, 2), (three, 3)):
            for j in range(length):
                out[at + j] = True
    return out


def pieces(data: np.ndarray, at: np.ndarray, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of pieces that cover all bytes: white space and the word after it; a row's last may be blank.

    With ``punctuation`` they are cut before ASCII punctuation, but for the apostrophe, that follows an ASCII letter or digit.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = white(data)
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    first = first[:-1]
    first[1:] |= blank[1:] & ~blank[:-1]
    if punctuation:
        kind = _CLASS[data]
        first[1:] |= (kind[1:] == 2) & (kind[:-1] == 1)
    start = np.flatnonzero(first)
    return start, np.append(start[1:], len(data)), np.searchsorted(at, start, "right") - 1


# Classes for splitting words where every tokenizer rule splits too: 1 ASCII letters and digits, 2 ASCII punctuation
# other than the apostrophe, 3 anything that needs its neighbours.
_CLASS = np.full(256, 3, np.uint8)
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
    _CLASS[_c] = 1
for _c in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~":
    _CLASS[_c] = 2


def folded_parts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z folded before ASCII, and start, end, row of word parts cut between ASCII letters and punctuation."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, none
    plain = np.ones(len(data), bool)
    plain[:-1] = data[1:] < 0x80
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    plain[:-1] |= cut[1:-1]
    data = np.where(plain & (data >= 65) & (data <= 90), data | 0x20, data).astype(np.uint8)
    kind = _CLASS[data]
    kind[SPACE[data]] = 0
    inside = kind > 0
    joined = inside[1:] & inside[:-1] & ~cut[1 : len(data)] & ~((kind[1:] + kind[:-1] == 3) & inside[1:] & inside[:-1])
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~joined
    last[:-1] &= ~joined
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return data, start, end, np.searchsorted(at, start, "right") - 1


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct spans, frequent ones first, and for every span its index among them."""
    if not len(start):
        return [], np.zeros(0, np.int64)
    h = hashes(data, start, end) ^ (end - start).astype(np.uint64)
    # As np.unique does, but with a sort that need not be stable: any span stands for its equals.
    by_hash = np.argsort(h)
    h = h[by_hash]
    new = np.concatenate(([True], h[1:] != h[:-1]))
    first, inverse = np.flatnonzero(new), np.empty(len(h), np.int64)
    inverse[by_hash] = np.cumsum(new) - 1
    where, count = by_hash[first], np.diff(np.append(first, len(h)))
    order = np.argsort(-count, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    raw, a, b = data.tobytes(), start[where[order]].tolist(), end[where[order]].tolist()
    return [raw[i:j] for i, j in zip(a, b)], rank[inverse]


def gather(values: np.ndarray, offset: np.ndarray, length: np.ndarray, index: np.ndarray) -> np.ndarray:
    """values[offset[i] : offset[i] + length[i]] for every i of ``index``, one after another."""
    n = length[index]
    total = int(n.sum())
    if not total:
        return values[:0]
    shift = offset[index] - (np.cumsum(n) - n)
    return values[np.repeat(shift, n) + np.arange(total)]
