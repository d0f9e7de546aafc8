"""Documents that are awkward in every way the operators promise to bear."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, n int, size long, target double, embedding string, a string, b string, score double, start int"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def rows() -> list[tuple]:
    base, passage = prose(1, 120), prose(2, 80)
    words = base.split()
    texts = [
        (1, base), (2, base), (3, " ".join([*words[:60], "changed", *words[61:]])), (4, base.upper()), (5, prose(5, 90)), (5, prose(5, 90)),
        (6, None), (7, ""), (8, " \n\t "), (9, "one two"), (10, "One  TWO"), (None, prose(11, 40)), (12, "x" * 60_000 + " " + prose(12, 30_000)),
        (13, f"{prose(13, 50)} {passage} {prose(14, 40)}"), (14, f"{prose(15, 30)}\n{passage}\n{prose(16, 60)}"), (15, passage), (16, "123 456 !!! 789"), (17, "é ñ ü ß ÇA İstanbul don't 's　ok\x1c<|endoftext|>"),
    ]
    out = []
    for i, (doc_id, text) in enumerate(texts):
        lang, source = (None if i % 5 == 4 else "en"), (None if i % 7 == 6 else f"s{i % 3}")
        out.append((doc_id, text, lang, source, None if text is None else len(text), i, "k", i, i, float(i), "e", "a", "b", 0.5, 0))
    return out


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
