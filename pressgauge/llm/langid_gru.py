"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads texts in windows of ``SPAN`` bytes (A-Z folded), byte by byte in both directions across words, and
labels every position with probabilities of the languages. A document's probabilities are the mean over all positions of
its whole text that hold a letter (an ASCII letter or a byte beyond ASCII). It is trained in numpy by backpropagation
through time on a bounded, hash-chosen sample of labelled documents (about ``DOCS_PER_LANG`` documents of each language,
one stretch of ``STRETCH`` characters from each).

Edge cases: null, blank or letterless text is ``und`` with score 0, as is everything if no labelled row can be learned
from; null languages are not learned; rows that repeat a doc_id, and null doc_ids, keep a row each; an empty table gives
no rows. Only doc_id, text and (for learning) lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.llm import words as W
from pressgauge.llm.scratch import cut, small_batches, small_side

DOCS_PER_LANG, STRETCH = 400, 2_000
HIDDEN, SPAN, STEPS, BATCH = 8, 64, 300, 128
#: Windows that run through the network together.
AT_ONCE = 4_096


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place of the hyperbolic tangent; its slope at a value s is (1 - |s|)**2."""
    y = np.abs(x)
    y += 1
    return np.divide(x, y, out=y)


def _gate(x: np.ndarray) -> np.ndarray:
    y = _squash(x)
    y *= 0.5
    y += 0.5
    return y


class ByteGru:
    """Gated recurrent units in both directions over equally long byte sequences, and a softmax at every position.

    Arrays over time hold a (unit, row) matrix for every position, so that work on a unit runs over contiguous rows.
    """

    def __init__(self, languages: list[str], seed: int = 3):
        rng, h = np.random.default_rng(seed), HIDDEN
        self.languages = languages
        self.p = {}
        for side in "fb":
            self.p[f"x{side}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.p[f"u{side}"] = rng.normal(0, h**-0.5, (h, 3 * h)).astype(np.float32)
        self.p["o"] = rng.normal(0, 0.2, (2 * h, len(languages))).astype(np.float32)
        self.p["c"] = np.zeros(len(languages), np.float32)

    def _run(self, x: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (time, unit, row) of one direction; ``x`` is (time, row) in reading order."""
        table, u, h = np.ascontiguousarray(self.p[f"x{side}"].T), np.ascontiguousarray(self.p[f"u{side}"].T), HIDDEN
        state = np.zeros((h, x.shape[1]), table.dtype)
        states, saved = np.empty((len(x), *state.shape), table.dtype), []
        for t in range(len(x)):
            a, g = np.take(table, x[t], axis=1), u @ state
            a[: 2 * h] += g[: 2 * h]
            gates = _gate(a[: 2 * h])
            z, r, inner = gates[:h], gates[h:], g[2 * h :]
            new = a[2 * h :]
            new += r * inner
            new = _squash(new)
            if keep:
                saved.append((state, z, r, new, inner))
            state = states[t] = new + z * (state - new)
        return states, saved

    def _logits(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """(time, language, row) from the states of both directions in reading order."""
        o = self.p["o"].T
        return o[:, :HIDDEN] @ forward + o[:, HIDDEN:] @ backward + self.p["c"][:, None]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(time, language, row) for byte sequences (row, time)."""
        x = np.ascontiguousarray(x.T)
        forward, _ = self._run(x, "f", False)
        backward, _ = self._run(x[::-1], "b", False)
        e = self._logits(forward, backward[::-1])
        e -= e.max(axis=1, keepdims=True)
        np.exp(e, out=e)
        e /= e.sum(axis=1, keepdims=True)
        return e

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions and its gradients, by backpropagation through time."""
        h, o = HIDDEN, self.p["o"]
        time, rows = x.shape[1], x.shape[0]
        reading = {"f": x.T, "b": x.T[::-1]}
        runs = {side: self._run(reading[side], side, True) for side in "fb"}
        forward, backward = runs["f"][0], runs["b"][0][::-1]
        logits = self._logits(forward, backward)
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        d = e / e.sum(axis=1, keepdims=True)
        loss = float(-np.log(d[:, y, np.arange(rows)] + 1e-9).mean())
        d[:, y, np.arange(rows)] -= 1
        d /= time * rows
        grad = {"o": np.concatenate([np.einsum("thr,tlr->hl", s, d, optimize=True) for s in (forward, backward)]), "c": d.sum((0, 2))}
        outer = {"f": o[:h] @ d, "b": (o[h:] @ d)[::-1]}
        for side in "fb":
            u, saved, flow = self.p[f"u{side}"], runs[side][1], np.zeros((h, rows), d.dtype)
            du, inputs = np.zeros_like(u), np.empty((time, 3 * h, rows), d.dtype)
            for t in range(time - 1, -1, -1):
                old, z, r, new, inner = saved[t]
                flow = flow + outer[side][t]
                dn = flow * (1 - z) * (1 - np.abs(new)) ** 2
                dz = flow * (old - new) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                dr = dn * inner * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                dg = np.concatenate((dz, dr, dn * r))
                inputs[t, : 2 * h], inputs[t, 2 * h :] = dg[: 2 * h], dn
                du += old @ dg.T
                flow = flow * z + u @ dg
            flat = reading[side].ravel()
            order = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.diff(flat[order].astype(np.int16), prepend=-1))
            dx = np.zeros_like(self.p[f"x{side}"])
            dx[flat[order[first]]] = np.add.reduceat(inputs.transpose(0, 2, 1).reshape(-1, 3 * h)[order], first)
            grad[f"u{side}"], grad[f"x{side}"] = du, dx
        return loss, grad

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = 0.03, seed: int = 1) -> list[float]:
        """Adam over batches of windows ``x`` of languages ``y``, every language drawn equally often."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(y == i) for i in range(len(self.languages))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            some = np.array([rng.choice(by[i]) for i in rng.integers(0, len(by), BATCH)])
            loss, grad = self.gradients(x[some], y[some])
            losses.append(loss)
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (window, byte) of the folded texts that lie between the offsets, filled up with spaces, and their rows."""
    size = np.diff(at)
    n = -(-size // SPAN)
    row = np.repeat(np.arange(len(size)), n)
    start = at[row] + SPAN * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    place = start[:, None] + np.arange(SPAN)
    x = _FOLD[data[np.minimum(place, len(data) - 1)]] if len(data) else np.zeros((0, SPAN), np.uint8)
    x[place >= at[row + 1][:, None]] = 32
    return x, row


def learn(docs: DataFrame, usable: Column) -> ByteGru | None:
    """Train on the sample of labelled documents for which ``usable`` holds; None if there is none."""
    small_batches(docs.sparkSession)
    key = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(17))
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & usable)
    labelled = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), key.alias("k"))
    # A row is drawn if its key is low enough, so no group of rows is gathered; a few more than wanted are expected.
    counts = small_side(cut(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages"))
    drawn = labelled.join(counts, "lang").where(F.pmod("k", F.lit(1 << 30)) < F.lit((1 << 30) * 1.3 * DOCS_PER_LANG) / F.col("n"))
    at = F.pmod("k", F.greatest(F.length("text") - STRETCH, F.lit(1)))
    rows = drawn.select("lang", "k", F.substring("text", (at + 1).cast("int"), F.lit(STRETCH)).alias("t")).dropDuplicates(["lang", "k"]).collect()
    languages, taken, xs, ys = sorted({r.lang for r in rows}), {}, [], []
    for lang, _, text in sorted((r.lang, r.k, r.t) for r in rows):
        if taken.setdefault(lang, 0) < DOCS_PER_LANG:
            taken[lang] += 1
            data = np.frombuffer(text.encode(), np.uint8)
            x, _ = windows(data, np.array([0, len(data)]))
            xs.append(x[_LETTER[x].any(axis=1)])
            ys.append(np.full(len(xs[-1]), languages.index(lang)))
    x, y = (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros((0, SPAN), np.uint8), np.zeros(0, int))
    seen = np.unique(y)
    if not len(seen):
        return None
    model = ByteGru([languages[i] for i in seen])
    model.train(x, np.searchsorted(seen, y))
    return model


def pooled(model: ByteGru, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean probabilities (row, language) over the letters of each text; zeros for a text without."""
    total, n = np.zeros((len(at) - 1, len(model.languages))), np.zeros(len(at) - 1)
    x, row = windows(data, at)
    for k in range(0, len(x), AT_ONCE):
        part, of = x[k : k + AT_ONCE], row[k : k + AT_ONCE]
        letter = _LETTER[part].T
        some = np.einsum("tlr,tr->rl", model.probabilities(part), letter.astype(np.float32)).astype(np.float64)
        np.add.at(total, of, some)
        np.add.at(n, of, letter.sum(axis=0))
    return total / np.maximum(n, 1)[:, None]


def _scores(gru: ByteGru | None, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, languages and shares of every chunk of a column of texts."""
    for row, data, at in W.chunks(column, 1 << 20):
        rows = len(at) - 1
        names, score = np.full(rows, "und", object), np.zeros(rows)
        if gru is not None:
            share = pooled(gru, data, at)
            inside = np.concatenate(([0], np.cumsum(_LETTER[_FOLD[data]])))
            plain = np.concatenate(([0], np.cumsum(_LETTER[_FOLD[data]] & (data < 128))))
            known = plain[at[1:]] > plain[at[:-1]]
            # Bytes beyond ASCII need a look at the characters.
            for i in np.flatnonzero(~known & (inside[at[1:]] > inside[at[:-1]])).tolist():
                known[i] = any(c.isalpha() for c in data[at[i] : at[i + 1]].tobytes().decode())
            best = share.argmax(axis=1)
            names = np.where(known, np.array(gru.languages, object)[best], "und")
            score = np.where(known, np.minimum(share[np.arange(rows), best], 1.0), 0.0)
        yield row, names, score


def predict(docs: DataFrame, model: ByteGru | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, names, score in _scores(shared.value, batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(names)), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def certain(docs: DataFrame, model: ByteGru | None, least: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has letters and whose best language holds ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, names, score in _scores(shared.value, batch.column("text")):
                yield batch.slice(row, len(names)).filter(pa.array((names != "und") & (score >= least), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); documents of the held-out fold are never learned from."""
    model = learn(docs, ~held_out(F.col("doc_id"), folds, fold))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score")
