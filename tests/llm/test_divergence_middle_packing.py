"""Source divergence, fill-in-middle and packing against plain versions, on awkward rows too."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pressgauge.llm import divergence, fill_middle, packing
from pressgauge.llm.queries import tokenizer_file
from tests.llm.conftest import SCHEMA


def texts_of(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.select("doc_id", "text", "lang", "source").collect()]


def plain_divergence(rows, least=3, most=200):
    groups, documents, counts = set(), defaultdict(set), defaultdict(Counter)
    for i, (_, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            term = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in term)
            documents[lang, term].add(i)
            counts[lang, source][term] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept = {t for (x, t), d in documents.items() if x == lang and len(d) >= least}
        sources = sorted(s for x, s in groups if x == lang)
        whole = Counter()
        for s in sources:
            whole += Counter({t: n for t, n in counts[lang, s].items() if t in kept})

        def share(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        q = share(whole)
        p = {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", x[2], -x[0], k + 1) for k, x in enumerate(sorted(pairs))}
            out |= {(lang, s, "term", x[2], -x[0], k + 1) for k, x in enumerate(sorted(terms)[:most])}
    return out


def found_divergence(df, **options):
    found = divergence.divergence(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len({tuple(r) for r in found}) == len(found)
    return {tuple(r) for r in found}


def test_divergence_of_awkward_rows(messy):
    assert found_divergence(messy) == plain_divergence(texts_of(messy))
    assert found_divergence(messy, least=1, most_terms=3) == plain_divergence(texts_of(messy), 1, 3)


def test_divergence_with_a_hot_source_and_uneven_counts(spark):
    rng = random.Random(3)
    words = ["Alpha", "beta", "ÉTÉ", "été", "gamma2delta", "x", "日本", "ß", "ẞ", "o'neil"]
    rows = []
    for i in range(300):
        source = "hot" if i % 3 == 0 else rng.choice(["b", "c", None, "", "é", "Z"])
        rows.append((i % 40, " ".join(rng.choices(words, k=rng.randint(0, 12), weights=[30, 20, 5, 5, 4, 3, 2, 1, 1, 1])), rng.choice(["en", None, "de"]), source))
    rows += [(1, "lonely words here", "it", "only"), (2, "no kept terms", "xx", "a"), (3, None, "xx", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    assert found_divergence(df) == plain_divergence(rows)


def test_divergence_of_no_documents(no_docs):
    assert divergence.divergence(no_docs).collect() == []


def test_shares_of_large_counts_are_exact(spark):
    big = [(c, c + 1 + e) for c in (0, 7, 10**9, 10**12 + 7, 9 * 10**15 - 100) for e in (0, 1, 10**6 + 3)]
    df = spark.createDataFrame(big, "c long, t long").withColumn("p", divergence.share(F.col("c"), F.col("t")))
    assert all(r.p == 1 + 10**9 * (r.c + 1) // r.t for r in df.collect())


def plain_middle(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


AWKWARD = ["", " ", "\n\n", "a", " a", "a ", "a\x0bb\x0cc", "<P", "<<P>", "x <S> y", "<M>", "S> a <P", "    wide", "😀 \U0001f468‍\U0001f469 é", "\x00 \x1c a", "<|endoftext|> <", "> <P < S>"]


def test_fill_in_middle_equals_a_plain_version_and_is_undone(spark, messy):
    extra = [(i, AWKWARD[i % len(AWKWARD)], None, None) + (None,) * 11 for i in range(300)]
    df = messy.unionByName(spark.createDataFrame(extra, SCHEMA)).repartition(3)
    got = fill_middle.restored(fill_middle.fill_in_middle(df)).collect()
    want = Counter((r[0], *plain_middle(r[0], r[1]), r[1] or "") for r in texts_of(df))
    assert Counter(tuple(r) for r in got) == want
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_fill_in_middle_of_no_documents(no_docs):
    assert fill_middle.digest(no_docs).collect() == []


def test_borders_are_those_of_the_pattern():
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice("ab \n\té　") for _ in range(rng.randint(0, 12)))
        ends = [m.end() for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)]
        assert fill_middle.borders(np.frombuffer(text.encode("utf-32-le"), "<u4")).tolist() == [0, *ends]


@pytest.fixture(scope="module")
def config():
    return tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole(config):
    from tokenizers import Tokenizer

    model = Tokenizer.from_buffer(config)
    model.encode_special_tokens = True
    return lambda text: [*model.encode(text or "", add_special_tokens=False).ids, 1]


def check_packing(rows, packed, pieces, whole, capacity):
    """Every id lies in exactly one piece, sequences are gapless and padded as promised; the padding's share."""
    want = Counter((i, tuple(whole(t))) for i, t, *_ in rows)
    by_sequence, crc = {}, Counter()
    for r in packed:
        assert r.sequence_id not in by_sequence
        used = sum(p.length for p in r.pieces)
        assert [p.offset for p in r.pieces] == [sum(q.length for q in r.pieces[:k]) for k in range(len(r.pieces))]
        assert 0 < used <= capacity and len(r.ids) == (used if used & (used - 1) == 0 else capacity)
        assert all(i == 0 for i in r.ids[used:])
        by_sequence[r.sequence_id] = used, len(r.ids)
        for p in r.pieces:
            ids = r.ids[p.offset : p.offset + p.length]
            crc[p.doc_id, p.start, p.length, zlib.crc32(np.array(ids, "<u4").tobytes()), p.doc_tokens, r.sequence_id, p.offset] += 1
    assert crc == Counter(tuple(r) for r in pieces)
    # Pieces of rows with equal ids are interchangeable; together they must make up exactly those rows.
    need = Counter()
    for (doc_id, ids), n in want.items():
        for k, i in enumerate(ids):
            need[doc_id, len(ids), k, i] += n
    have = Counter()
    for r in packed:
        for p in r.pieces:
            for k, i in enumerate(r.ids[p.offset : p.offset + p.length]):
                have[p.doc_id, p.doc_tokens, p.start + k, i] += 1
    assert have == need
    return sum(b - a for a, b in by_sequence.values()) / max(1, sum(b for _, b in by_sequence.values()))


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing_of_awkward_rows(spark, messy, config, whole, capacity):
    extra = [(i, t, None, None) + (None,) * 11 for i, t in enumerate(AWKWARD)]
    df = messy.unionByName(spark.createDataFrame(extra, SCHEMA)).coalesce(2)
    rows = texts_of(df)
    packed = packing.pack(df, config, 1, capacity)
    share = check_packing(rows, packed.collect(), packing.digest(packed).collect(), whole, capacity)
    assert share <= 1 / 64


def test_packing_of_no_documents(no_docs, config):
    assert packing.digest(packing.pack(no_docs, config, 1)).collect() == []


def test_packing_pads_little_whatever_the_lengths():
    rng = random.Random(9)
    tables = [[1100] * 500, [1] * 5000, [2049] * 300, [1366] * 301, [rng.randint(1, 6000) for _ in range(3000)], [700, 700, 700], [5], [2048, 4096, 1]]
    for lengths in tables:
        planned = packing.plan(np.array(lengths), 2048, 32)
        used = [sum(n for _, _, n in s) for s in planned]
        assert all(0 < u <= 2048 and (2048 - u <= 32 or u & (u - 1) == 0) for u in used)
        pieces = sorted(p for s in planned for p in s)
        at = defaultdict(int)
        for i, start, n in pieces:
            assert start == at[i] and n > 0
            at[i] += n
        assert [at[i] for i in range(len(lengths))] == lengths


def test_best_fit_takes_the_tightest_open_sequence():
    rng = random.Random(4)
    for _ in range(50):
        capacity = rng.choice([7, 8, 100, 2048])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
        room, out = [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [r for r in room if r[0] >= lengths[i]]
            tightest = min((r[0] for r in fits), default=None)
            # Of equally tight ones the last that came to this capacity.
            chosen = max((r for r in fits if r[0] == tightest), key=lambda r: r[2], default=None)
            if chosen is None:
                chosen = [capacity, len(out), 0]
                out.append([])
                room.append(chosen)
            out[chosen[1]].append(i)
            chosen[0] -= lengths[i]
            chosen[2] = max((r[2] for r in room), default=0) + 1
        assert packing.best_fit(lengths, capacity) == out


def test_packing_equals_the_tokenizer_on_every_kind_of_break(config, whole):
    import pyarrow as pa

    rng = random.Random(2)
    alphabet = ["a", "B", "1", " ", "  ", "\n", "\t", "é", "'s", "'", "!", " ", "　", "😀", "\x1c", "\x85", "<|endoftext|>", "don't", "\x00"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 15))) for _ in range(2000)]
    encoder = packing.ByteEncoder(config)
    got = []
    for ids, n in packing.encode_rows(pa.array(texts), encoder, 1):
        at = np.concatenate(([0], np.cumsum(n)))
        got += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    assert got == [whole(t) for t in texts]


def test_a_word_is_encoded_once_whatever_punctuation_follows(config, whole):
    encoder, seen = packing.ByteEncoder(config), []
    kept = encoder.encode
    encoder.encode = lambda parts, *rest: (seen.extend(parts), kept(parts, *rest))[1]
    texts = ["a cat, a cat. a cat; a cat!\" U.S. 3.5% x-y don't 'tis rock'n'roll é, é. ü'd “cat” cat…. (cat) cat),  cat,  x ", None, ".", "cat", ".cat"]
    ids, n = zip(*packing.encode_rows(pa.array(texts), encoder, 1))
    assert seen.count(b" cat") == 1 and not {b" cat,", b" cat.", b" cat;"} & set(seen)
    wanted = [whole(t) for t in texts]
    assert np.concatenate(n).tolist() == [len(w) for w in wanted] and np.concatenate(ids).tolist() == [i for w in wanted for i in w]
