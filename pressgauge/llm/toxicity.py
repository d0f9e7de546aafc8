"""Toxicity by noisy-channel deobfuscation: restore disguised words with a character language model, then score them.

The channel lets a writer swap letters for look-alikes, put separators or spaces between the letters of a word, and
repeat letters. A suspicious token spans a lattice: every character may be one of the letters it can stand for, be
dropped as a separator, or be dropped as a repetition, each at a cost. Viterbi finds the cheapest path under a trigram
model of characters counted over all documents. Spaces are in a second lattice over the letters so restored: runs of
single letters, marks around them left out, and any number of neighbouring tokens that together spell a weighted word are
cut into words anew. Its arcs are words, which cost what the character model says, or ``KNOWN`` at most if they have a
weight; an arc over a space pays for dropping it.

Words and word beginnings of the restored text are features. Their weights are smoothed log ratios of document
frequencies in toxic and other documents, over a bounded, hash-chosen sample of labelled documents (about ``SAMPLE`` of
either label, equal texts once). A document's score is a logistic function, fitted on the same sample, of the weights it gathers.

Edge cases: null or empty text has the score of a document without evidence; without labelled rows of both kinds
every score is 0; labels that repeat a doc_id count once, the larger one, and of rows that repeat a doc_id the smallest
text is learned from; such rows, and null doc_ids, keep a score each; an empty table gives no rows. Only doc_id, text
and (for learning) labels are read.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.llm import words as W

#: Labelled documents of either kind that features are counted on; share and number of toxic ones a feature
#: must occur in.
SAMPLE, LEAST_SHARE, LEAST = 6_000, 0.03, 6
#: Lengths of word beginnings used as features.
BEGINNINGS = (4, 5, 6)
#: Single letters in a row that are read as words spelled out.
SPELLED = 4
#: Marks around a token that are not part of it.
MARKS = ".,;:!?\"'()[]{}<>*%&#$~-_|/\\=+"

# Letters that a character may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "µ": "u",
}
SEPARATORS = set(".-_*~'`^,:;/\\#=")
#: Costs (negative log probabilities) of a swap, of dropping a separator or a repetition, and of keeping a symbol.
SWAP, DROP, REPEAT, SYMBOL = 1.0, 0.5, 0.7, 12.0
#: Costs of a word that has a weight and of dropping a space; letters of the longest word between spaced-out letters.
KNOWN, JOIN, LONGEST = 6.0, 0.5, 24

_DOUBLED, _TRIPLED = re.compile(r"(.)\1+", re.DOTALL), re.compile(r"(.)\1\1", re.DOTALL)

SYMBOLS = 28  # a-z, other letters, word edge
EDGE, OTHER = 27, 26


def symbol(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else OTHER


def count_characters(docs: DataFrame) -> np.ndarray:
    """Trigram counts of folded letters with word edges over all documents; the table has SYMBOLS**3 cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(256, EDGE, np.int64)
        table[97:123] = table[65:91] = np.arange(26)
        table[128:192] = -1  # later bytes of a character
        table[192:] = OTHER
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, data, at in W.chunks(batch.column("text")):
                code = table[data]
                code[at[1:-1][at[1:-1] < len(code)]] = EDGE
                code = code[code >= 0]
                if len(code) > 2:
                    total += np.bincount((code[:-2] * SYMBOLS + code[1:-1]) * SYMBOLS + code[2:], minlength=len(total))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(SYMBOLS**3)
    for r in rows:
        total[r.cell] = r.n
    return total


def character_costs(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b), smoothed by the bigram and unigram shares."""
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1)) + 1
    p1 = one / one.sum()
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    return -np.log((three + 20 * p2[None]) / (three.sum(axis=2, keepdims=True) + 20))


def suspicious(core: str) -> bool:
    """Letters mixed with symbols or digits, or a letter three times in a row."""
    if core.isalpha():
        return _TRIPLED.search(core) is not None
    return any(c.isalpha() for c in core) or sum(c in LOOKS_LIKE for c in core) >= 3


def restore(token: str, cost: np.ndarray) -> str:
    """The cheapest reading of a folded token."""
    # State: the last two letters kept (as symbols) and the last character; value: (cost, letters as a chain).
    states: dict[tuple[int, int, str], tuple[float, tuple]] = {(EDGE, EDGE, ""): (0.0, ())}
    for c in token:
        new: dict[tuple[int, int, str], tuple[float, tuple]] = {}
        readings = [(c, 0.0)] if c.isalpha() else [(x, SWAP) for x in LOOKS_LIKE.get(c, "")] + [("", DROP if c in SEPARATORS else SYMBOL)]
        for (a, b, last), (paid, text) in states.items():
            for letter, extra in readings:
                if letter:
                    s = symbol(letter)
                    options = [((b, s, letter), paid + extra + cost[a, b, s], (text, letter))]
                    if letter == last:
                        options.append(((a, b, last), paid + extra + REPEAT, text))
                else:
                    options = [((a, b, last), paid + extra, text)]
                for key, total, now in options:
                    if key not in new or total < new[key][0]:
                        new[key] = (total, now)
        states = new
    chain = min(((paid + cost[a, b, EDGE], key) for key, (paid, _) in states.items() for a, b, _ in [key]))[1]
    out, text = [], states[chain][1]
    while text:
        text, letter = text
        out.append(letter)
    return "".join(reversed(out))


def word_cost(word: str, cost: np.ndarray, known: Container[str] = ()) -> float:
    """What a word costs under the character model, or as one that has a weight."""
    a = b = EDGE
    total = 0.0
    for s in (*map(symbol, word), EDGE):
        total += cost[a, b, s]
        a, b = b, s
    return min(total, KNOWN) if single(word) in known else total


def respace(parts: list[str], cost: np.ndarray, known: Container[str]) -> list[str]:
    """The cheapest words of letters that stood apart in ``parts``; words end where parts end."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for j in range(1, len(parts) + 1):
        arcs, word = [], ""
        for i in range(j - 1, -1, -1):
            word = parts[i] + word
            if len(word) > LONGEST and i < j - 1:
                break
            arcs.append((best[i][0] + word_cost(word, cost, known) + JOIN * (j - 1 - i), i))
        best.append(min(arcs))
    out, j = [], len(parts)
    while j:
        i = best[j][1]
        out.append("".join(parts[i:j]))
        j = i
    return out[::-1]


def single(word: str) -> str:
    """Doubled letters written once, as a restored word may have lost one."""
    return _DOUBLED.sub(r"\1", word)


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    word = single(word)
    return [word, *(f"{word[:n]}~" for n in BEGINNINGS if len(word) > n)] if len(word) > 2 else []


@dataclass
class Model:
    cost: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    slope: float = 0.0
    offset: float = -30.0


_POWER = np.uint64(0x9E3779B97F4A7C15)


def _number(word: str) -> tuple[np.uint64, np.uint64]:
    """A polynomial of the word's characters, and the factor by which what follows is to be multiplied."""
    total, factor = np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        for c in word:
            total, factor = total + factor * np.uint64(ord(c)), factor * _POWER
    return total, factor


class Reader:
    """Words of chunks of text, each distinct token read once; ``known`` are words with a weight."""

    def __init__(self, cost: np.ndarray, known: Container[str] = ()):
        self.cost, self.known, self.seen = cost, known, {}
        self.spelled = np.unique(np.array([_number(w)[0] for w in known], np.uint64))
        self.begun = np.unique(np.array([_number(w[:n])[0] for w in known for n in range(1, len(w) + 1)], np.uint64))
        self.inside = {w[i:j] for w in known for i in range(len(w)) for j in range(i + 1, len(w) + 1)}

    def look(self, part: bytes) -> tuple[list[str], str, str]:
        """The words that a token stands for, plain and restored; the single character that it is but for marks; and what
        it adds to a weighted word that it may be a part of."""
        found = self.seen.get(part)
        if found is None:
            token = part.decode().lower()
            plain = token.isalpha()
            core = token if plain else token.strip(MARKS)
            whole = token if plain else token.strip(".,;:?\"'()[]{}<>%&#~-_/\\=")
            got = [core] if core else []
            if whole and suspicious(whole):
                got = [x for x in dict.fromkeys([*got, restore(whole, self.cost)]) if x]
            alone = token if len(token) == 1 else core
            piece = got[-1] if got and len(got[-1]) <= LONGEST else ""
            if piece not in self.inside:
                piece = single(piece)
            found = got, alone if len(alone) == 1 else "", piece if piece in self.inside else ""
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[part] = found
        return found

    def _letters_apart(self, alone: list[str], index: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, str]]:
        """Words of runs of ``SPELLED`` or more tokens in one row that are a single character but for marks around it."""
        one = np.array([bool(x) for x in alone], bool)[index] if len(index) else np.zeros(0, bool)
        if one.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], (one * (row + 1)), [0]))))
            for a, b in zip(edge, edge[1:]):
                if one[a] and b - a >= SPELLED:
                    letters = restore("".join(alone[k] for k in index[a:b].tolist()), self.cost)
                    for word in respace(list(letters), self.cost, self.known):
                        yield int(row[a]), word

    def _parts_apart(self, texts: list[str], index: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, str]]:
        """Weighted words that neighbouring tokens spell together, where the lattice joins them.

        Tokens are followed as long as they begin a weighted word, so their number has no bound but the word's letters.
        """
        if not len(self.spelled) or not len(index):
            return
        number, factor = np.zeros(len(texts), np.uint64), np.ones(len(texts), np.uint64)
        for k, text in enumerate(texts):
            if text:
                number[k], factor[k] = _number(text)
        among = lambda x, of: of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x
        usable = np.array([bool(t) for t in texts])[index]
        at = np.flatnonzero(usable & among(number[index], self.begun))
        total, scale, n = number[index[at]], factor[index[at]], 1
        while len(at):
            inside = at + n < len(index)
            at, total, scale = at[inside], total[inside], scale[inside]
            last = at + n
            total, scale = total + scale * number[index[last]], scale * factor[index[last]]
            goes_on = usable[last] & (row[at] == row[last]) & among(total, self.begun)
            at, total, scale, n = at[goes_on], total[goes_on], scale[goes_on], n + 1
            for i in at[among(total, self.spelled)].tolist():
                parts = [texts[k] for k in index[i : i + n].tolist()]
                if len(words := respace(parts, self.cost, self.known)) == 1:
                    yield int(row[i]), words[0]

    def read(self, column: pa.Array) -> Iterator[tuple[int, int, list[list[str]], np.ndarray, np.ndarray, list[tuple[int, str]]]]:
        """(first row, rows, words of each distinct token, token index, row of each token, (row, word set apart))."""
        for first, data, at in W.chunks(column):
            start, end, row = W.spans(data, at)
            parts, index = W.distinct(data, start, end)
            looks = [self.look(p) for p in parts]
            listed, alone, texts = ([x[i] for x in looks] for i in range(3))
            yield first, len(at) - 1, listed, index, row, [*self._letters_apart(alone, index, row), *self._parts_apart(texts, index, row)]


def _pick(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """(doc_id, text, y): about SAMPLE labelled documents of either kind, drawn by a hash of the id, one row for each."""
    y = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    y = y.where("y in (0, 1)")
    counts = y.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    drawn = y.join(F.broadcast(counts), "y").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(float(SAMPLE << 30)) / F.col("n"))
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = texts.join(F.broadcast(drawn.select("doc_id", "y")), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    # A text counts once, however many of the documents drawn have it.
    return picked.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y"))


def learn(docs: DataFrame, labels: DataFrame, usable: Column) -> Model:
    spark = docs.sparkSession
    cost = character_costs(count_characters(docs))
    model = Model(cost)
    picked = _pick(docs, labels, usable)
    shared = spark.sparkContext.broadcast(cost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            y = batch.column("y").to_numpy()
            for first, rows, listed, index, row, spaced in reader.read(batch.column("text")):
                found: list[set[str]] = [set() for _ in range(rows)]
                for r, i in zip(row.tolist(), index.tolist()):
                    for word in listed[i]:
                        found[r].update(features(word))
                for r, word in spaced:
                    found[r].update(features(word))
                names = [f for s in found for f in s]
                kind = np.repeat(y[first : first + rows], [len(s) for s in found])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kind.astype(np.int32))], names=["f", "y"])

    n = {r.y: r.n for r in picked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return model
    count = picked.select("text", "y").mapInArrow(run, "f string, y int").groupBy("f").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    # At most 1 / LEAST_SHARE * (features of a document) features pass, however large the vocabulary.
    least = max(LEAST, round(LEAST_SHARE * n[1]))
    strong = count.where((F.col("t") >= least) & (F.col("t") * n[0] >= 20 * (F.col("c") + 0.5) * n[1]))
    model.weights = {r.f: float(np.log((r.t + 0.5) / (n[1] + 1)) - np.log((r.c + 0.5) / (n[0] + 1))) for r in strong.collect()}
    evidence = _gather(picked, model, ["y"])
    rows = sorted((r.z, r.y) for r in evidence.select("z", "y").collect())
    z, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    balance = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    slope, offset = 0.5, -2.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))
        g = np.array([((p - y) * z * balance).sum() + 1e-4 * slope, ((p - y) * balance).sum() + 1e-4 * offset])
        h = p * (1 - p) * balance
        hess = np.array([[(h * z * z).sum() + 1e-4, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-4]])
        step = np.linalg.solve(hess, g)
        slope, offset = slope - float(np.clip(step[0], -1, 1)), offset - float(np.clip(step[1], -1, 1))
    model.slope, model.offset = slope, offset
    return model


def _gather(docs: DataFrame, model: Model, carried: list[str]) -> DataFrame:
    """(doc_id, carried, z): the strongest weight of every distinct weighted token of a text, added up."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.weights
        reader = Reader(shared.value.cost, {w for w in weights if not w.endswith("~") and len(w) >= 4})
        # All features of a word begin like it.
        heads = {f[:3] for f in weights}
        weigh = lambda words: max((weights.get(f, 0.0) for w in words if single(w)[:3] in heads for f in features(w)), default=0.0)
        for batch in batches:
            for first, rows, listed, index, row, spaced in reader.read(batch.column("text")):
                w = np.array([weigh(x) for x in listed]) if listed else np.zeros(0)
                hit = np.flatnonzero(w[index] > 0) if len(index) else np.zeros(0, int)
                pair = np.unique(row[hit] * max(len(w), 1) + index[hit])
                z = np.bincount(pair // max(len(w), 1), weights=w[pair % max(len(w), 1)], minlength=rows) if len(pair) else np.zeros(rows)
                for r, word in sorted(set(spaced)):
                    z[r] += weigh([word])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, rows), *[batch.column(c).slice(first, rows) for c in carried], pa.array(z)], names=["doc_id", *carried, "z"]
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carried, F.col("text").cast("string").alias("text"))
    kinds = dict(slim.dtypes)
    return slim.mapInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in ("doc_id", *carried)] + ["z double"]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row."""
    p = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("z") + F.lit(model.offset))))
    return _gather(docs, model, []).select("doc_id", p.alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels of the held-out fold are never learned from."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold
    model = learn(docs, labels, ~held)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
