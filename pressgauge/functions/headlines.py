"""Whether one headline is another one edited: the cheapest alignment of their words, priced by a small table."""

from __future__ import annotations

import re
from functools import lru_cache

from pressgauge.functions.vocabulary import CONTENT, NOISE, RUNNING

#: Words of the shortest headline that can be a revision.
SHORTEST = 5
#: Prices of edits: a word changed, a particle come or gone, two words for one, any other word come or gone.
CHANGED, PARTICLE, SPLIT, WORD, NEVER = 2, 2, 4, 3, 1000
#: What an edited headline may cost: two changes, or one and a word more or less.
BUDGET = 5
#: Letters that a slip may touch, by the length of the shorter word.
SLIPS = ((4, 0), (7, 1), (10**6, 2))
_FIXED = re.compile(r".*\d.*|[ivxlc]{2,}")


@lru_cache(1 << 16)
def letters_apart(a: str, b: str) -> int:
    """Edit distance of two words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(a: str, b: str) -> bool:
    """A word mistyped, one with another ending (five letters and three fifths in common), or a particle for a particle."""
    if max(len(a), len(b)) <= 2:
        return (a + b).isalpha()
    slips = next(n for below, n in SLIPS if min(len(a), len(b)) < below)
    if slips and letters_apart(a, b) <= slips:
        return True
    long = max(len(a), len(b))
    stem = max(5, -(-3 * long // 5))
    return a[:stem] == b[:stem] and min(len(a), len(b)) >= stem


def price(gone: tuple[str, ...], come: tuple[str, ...]) -> int:
    """What it costs that these words took the place of those; numbers, counts, negations and days have no price."""
    words = gone + come
    if all(w in NOISE for w in words):
        return 0
    if any(w in CONTENT or _FIXED.fullmatch(w) for w in words):
        return NEVER
    if not gone or not come:
        return PARTICLE if len(words[0]) <= 2 else WORD
    if not alike("".join(gone), "".join(come)):
        return NEVER
    return CHANGED if len(words) == 2 else SPLIT


def alignment_cost(old: list[str], new: list[str]) -> int:
    """Price of the cheapest way from one list of words to the other, word by word, two for one, or one for two."""
    best = {(0, 0): 0}
    for i in range(len(old) + 1):
        for j in range(len(new) + 1):
            found = [best.get((i, j), NEVER)]
            if i and j and old[i - 1] == new[j - 1]:
                found.append(best[i - 1, j - 1])
            for m, n in ((1, 1), (1, 0), (0, 1), (2, 1), (1, 2)):
                if i >= m and j >= n and best[i - m, j - n] <= BUDGET:
                    found.append(best[i - m, j - n] + price(tuple(old[i - m : i]), tuple(new[j - n : j])))
            best[i, j] = min(found)
    return best[len(old), len(new)]


def is_revision(old: list[str], new: list[str]) -> bool:
    """Whether ``new`` is ``old`` with slips corrected, endings changed, words split or joined, or one word more or less."""
    if old == new:
        return True
    if min(len(old), len(new)) < SHORTEST or abs(len(old) - len(new)) > BUDGET or not RUNNING.isdisjoint(old + new):
        return False
    return alignment_cost(old, new) <= BUDGET
