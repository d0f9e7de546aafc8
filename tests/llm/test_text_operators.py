"""Operators on documents against brute force, on messy and synthetic documents."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pressgauge.llm import words as W
from pressgauge.llm import bpe_join, langid_gru, mixing, paragraph_dedup, queries, token_orc, toxicity
from pressgauge.llm.jaccard_join import jaccard_components
from pressgauge.llm.scratch import Workspace

FOLD = {c: c + 32 for c in range(65, 91)}


def words(text):
    return [w.translate(FOLD) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows, k, percent):
    """[(doc_id, set size, smallest doc_id reachable)] in row order."""
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, j in {(i, j) for v in where.values() for i in v for j in v if i < j}:
        common = len(sets[i] & sets[j])
        if common * 100 >= percent * (len(sets[i]) + len(sets[j]) - common):
            parent[find(j)] = find(i)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    low = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return [(rows[i][0], len(sets[i]), low[find(i)]) for i in range(len(rows))]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_components_equal_brute_force(messy, spark, sf_dir, k, percent):
    docs = messy.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    rows = [tuple(r) for r in docs.collect()]
    got = jaccard_components(docs, k, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(rows, k, percent))


def test_jaccard_of_an_empty_table(no_docs):
    assert jaccard_components(no_docs).count() == 0


def test_dense_group_of_unlike_neighbours(spark):
    """A chain of near copies, each close to the next only, is one component."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(f"v{i // 2}_{j}" if j < 6 * i else w for j, w in enumerate(base))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_components(docs, 4, 85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(rows, 4, 85))


def test_token_orc_round_trip(messy, no_docs, spark):
    from tokenizers import Tokenizer

    config = queries.tokenizer_file("word_bpe_49k.json")
    model = Tokenizer.from_buffer(config)
    model.encode_special_tokens = True
    got = token_orc.encode_and_read_back(messy, config, end_id=1).collect()
    wanted = []
    for r in messy.collect():
        ids = model.encode(r.text or "", add_special_tokens=False).ids + [1]
        wanted.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(wanted)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted([r.doc_id for r in got], key=lambda i: (i is not None, i))
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:i]) for i in range(len(ordered))]
    assert token_orc.encode_and_read_back(no_docs, config).count() == 0


def test_token_orc_files_prune_by_doc_id(messy, tmp_path):
    path = str(tmp_path / "tokens")
    token_orc.write_token_orc(messy, path, queries.tokenizer_file("word_bpe_49k.json"), 1)
    found = token_orc.read_token_orc(messy.sparkSession, path).where("doc_id = 12")
    assert found.count() == 1
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,12)]" in plan


def test_bpe_equals_tiktoken_and_decodes(messy, no_docs):
    import tiktoken

    ranks = queries.tokenizer_file("byte_bpe_50k.tiktoken")
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_join.read_ranks(ranks), special_tokens={})
    wanted = []
    for r in messy.collect():
        ids = np.array(codec.encode_ordinary(r.text or ""), "<u4")
        wanted.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = bpe_join.digest(messy, ranks, public_tokenizers.PATTERN).collect()
    assert Counter(map(tuple, got)) == Counter(wanted)
    back = bpe_join.decode(bpe_join.encode(messy, ranks, public_tokenizers.PATTERN), ranks).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r.doc_id, r.text or "") for r in messy.collect())
    assert bpe_join.digest(no_docs, ranks, public_tokenizers.PATTERN).count() == 0


def test_mixing_shares_and_limits(messy, no_docs):
    rows = mixing.digest(messy).collect()
    assert len(rows) == messy.count()
    sizes = {r.doc_id: len(words(r.text)) for r in messy.collect()}
    assert all(r["size"] == sizes[r.doc_id] and r.taken <= 3 * r["size"] for r in rows)
    by_source = defaultdict(lambda: [0, 0.0])
    sources = {(r.doc_id, r.text): r.source for r in messy.collect()}
    assert None in sources.values()
    for total, target in {(r.source_size, r.target) for r in rows}:
        assert target <= 3 * total + 1e-6
        by_source["all"][0] += total
        by_source["all"][1] += target
    assert math.isclose(by_source["all"][0], by_source["all"][1])
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.digest(messy).collect()))
    emitted = mixing.emit(messy)
    assert emitted.columns == messy.columns
    assert emitted.count() == sum(r.copies for r in rows)
    assert mixing.digest(no_docs).count() == 0


def test_language_of_held_out_documents(spark, messy, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 600")
    got = {r.doc_id: r for r in langid_gru.identify(docs).collect()}
    rows = docs.collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in held) and sum(g.held_out for g in got.values()) == len(held)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)
    model = langid_gru.learn(docs, F.lit(True))
    odd = {r.doc_id: r for r in langid_gru.predict(messy, model).collect()}
    assert len(langid_gru.predict(messy, model).collect()) == messy.count()
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (6, 7, 8, 16))
    assert all(0 <= r.score <= 1 for r in odd.values())
    assert langid_gru.identify(no_docs).count() == 0
    assert {r.lang_pred for r in langid_gru.identify(messy.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_recurrent_gradients_match_differences():
    model = langid_gru.ByteGru(["a", "b"])
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = np.array([list(b" abc "), list(b" xbz ")], np.uint8), np.array([0, 1])
    _, grad = model.gradients(x, y)
    rng = np.random.default_rng(0)
    for name in model.p:
        flat, g = model.p[name].ravel(), grad[name].ravel()
        for i in rng.choice(np.flatnonzero(np.abs(g) > 1e-7) if (np.abs(g) > 1e-7).any() else len(g), 3):
            old = flat[i]
            flat[i] = old + 1e-3
            up = model.gradients(x, y)[0]
            flat[i] = old - 1e-3
            down = model.gradients(x, y)[0]
            flat[i] = old
            assert abs((up - down) / 2e-3 - g[i]) < 1e-3


def test_toxicity_finds_disguised_words(spark, messy, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 700")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = toxicity.learn(docs, labels, ~held)
    assert [toxicity.restore(w, model.cost) for w in ("l0s3r", "st.u.p.i.d", "looooser", "tr@sh", "cl0wn")] == ["loser", "stupid", "loser", "trash", "clown"]
    clean = prose_of(300)
    planted = [(1, clean), (2, clean.replace(" the ", " the l0s3r and ", 1) + " what a st.u.p.i.d m0r0n you tr@sh cl0wn"), (3, clean + " you i d i o t and l o s e r and s c u m"), (4, None), (5, ""), (None, "x " * 20_000)]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(planted, "doc_id long, text string"), model).collect()}
    assert got[2] >= 0.7 and got[3] >= 0.7 and got[1] < 0.7 and got[4] == got[5] < 0.7
    scored = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    known = [(r.toxic, scored[r.doc_id]) for r in labels.collect() if r.doc_id in scored]
    assert sum(s.predicted for t, s in known if t) >= 0.5 * sum(t for t, _ in known)
    assert sum(s.predicted for t, s in known if not t) <= 0.02 * len(known)
    assert toxicity.toxicity(messy, labels.limit(0)).select("score").distinct().count() == 1
    assert toxicity.toxicity(no_docs, labels).count() == 0


def prose_of(n):
    from tests.llm.conftest import prose

    return prose(99, n)


def repeated_windows(rows, k=50):
    where = defaultdict(set)
    for doc_id, text in rows:
        w = words(text)
        for i in range(len(w) - k + 1):
            where[tuple(w[i : i + k])].add(doc_id)
    return {d for v in where.values() if len(v) > 1 for d in v}


def test_passages_go_and_clean_texts_stay(messy, no_docs):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    spans = paragraph_dedup.removals(messy).collect()
    assert repeated_windows(rows) <= {r.doc_id for r in spans} | {r.keep_doc_id for r in spans}
    out = paragraph_dedup.dedup_passages(messy)
    assert out.columns == messy.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert not repeated_windows(kept)
    clean = {(5, prose_5()), (6, None), (7, ""), (8, " \n\t "), (9, "one two"), (10, "One  TWO"), (16, "123 456 !!! 789")}
    assert clean <= set(kept)
    assert any(d == 1 and t == rows_text(rows, 1) for d, t in kept) and 2 not in {d for d, _ in kept}
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
    assert paragraph_dedup.dedup_passages(no_docs).count() == 0


def prose_5():
    from tests.llm.conftest import prose

    return prose(5, 90)


def rows_text(rows, doc_id):
    return next(t for d, t in rows if d == doc_id)


def test_near_lines_are_found(spark):
    """Lines at a similarity of 0.8 or more go, lines below stay."""
    from tests.llm.conftest import prose

    base = prose(50, 100).split()
    near = [*base[:50], "other", *base[51:]]
    far = [w if i % 6 else f"new{i}" for i, w in enumerate(base)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, "Intro\n" + " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    found = {(r.doc_id, r.keep_doc_id) for r in paragraph_dedup.removals(docs).collect() if r.kind == "line"}
    assert found == {(2, 1)}


def covered(spans, rows, least=20):
    """Words of each row in a removal, and words in a run of ``least`` words that stood earlier, by brute force."""
    removed, wanted, seen = defaultdict(set), defaultdict(set), set()
    for n, (doc_id, text) in enumerate(rows):
        at = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        w = words(text)
        for r in spans:
            if r.doc_id == doc_id:
                removed[n] |= {i for i, (a, b) in enumerate(at) if r.start <= a and b <= r.end}
        for i in range(len(w) - least + 1):
            if tuple(w[i : i + least]) in seen:
                wanted[n] |= set(range(i, i + least))
            seen.add(tuple(w[i : i + least]))
    return removed, wanted


def test_every_repeated_run_of_twenty_words_goes_whole(spark):
    """Passages of 20 to 60 words anywhere in a line, and equal short lines; brute force names every word."""
    from tests.llm.conftest import prose

    passages = [prose(200 + i, 20 + i) for i in range(41)]
    rows = [(1, " ".join(prose(300 + i, 7 + i % 9) + " " + p for i, p in enumerate(passages)))]
    rows += [(2 + i, f"{prose(400 + i, 3 + i)} {p} {prose(500 + i, 5)}") for i, p in enumerate(passages)]
    rows += [(60, f"{prose(600, 9)}\n{prose(601, 20)}\n{prose(602, 8)}"), (61, f"{prose(601, 20)}\n{prose(603, 9)}")]
    spans = paragraph_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    removed, wanted = covered(spans, rows)
    assert {n: v for n, v in removed.items() if v} == dict(wanted)


def test_passages_of_rows_without_ids_and_periodic_texts(spark):
    from tests.llm.conftest import prose

    passage, base = prose(700, 40), prose(701, 100).split()
    rows = [(None, f"{passage} {prose(702, 9)}"), (None, f"{passage} {prose(703, 9)}"), (5, "la " * 90)]
    rows += [(6, prose(704, 9) + " " + " ".join(base)), (7, prose(705, 9) + " " + " ".join([*base[:50], "other", *base[51:]]) + " " + prose(706, 60))]
    left = {(r.doc_id, len(words(r.text))) for r in paragraph_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {(None, 49), (None, 9), (5, 20), (6, 109), (7, 69)}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_large_groups_of_near_copies_equal_brute_force(spark, k, percent):
    """Groups with a variant that many share and edits that some share, so that families have to decide."""
    import random

    rng, rows = random.Random(5), []
    for group in range(2):
        base = [f"g{group}w{rng.randint(0, 10**6)}" for _ in range(150)]
        variant = [f"v{group}{j}" if 20 <= j < 26 else w for j, w in enumerate(base)]
        for _ in range(60):
            text = list(base if rng.random() < 0.6 else variant)
            for _ in range(rng.randint(0, 12)):
                text[rng.randrange(150)] = f"e{rng.randint(0, 10**7) if rng.random() < 0.7 else rng.randint(0, 40)}"
            rows.append((len(rows), " ".join(text)))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(rows, k, percent))


def test_runs_whose_digests_collide_stay(spark):
    """With digests of a few bits, runs of unlike words fall together; only what stands elsewhere word for word goes."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    # Of many five-word shingles that with the least hash, which is picked in every run that holds it.
    many = [[word() for _ in range(5)] for _ in range(400)]
    data = np.frombuffer(" ".join(" ".join(x) for x in many).encode(), np.uint8)
    start, end, _ = W.spans(data, np.array([0, len(data)]))
    seed = many[int(W.shingles(W.hashes(data, start, end, lower=True), 5)[::5].argmin())]
    passage = [word() for _ in range(40)]
    # All texts share a five-word seed now and then, which makes their runs candidates; one passage does repeat.
    plain = [" ".join(w for _ in range(12) for w in [*(word() for _ in range(14)), *seed]) for _ in range(40)]
    texts = [*plain, " ".join([word(), *passage, word()]), " ".join([*(word() for _ in range(9)), *passage])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = paragraph_dedup._slim(docs).withColumn("cuts", F.lit(None).cast("array<struct<start:int,end:int>>"))
    for bits in (6, 64):
        spans = paragraph_dedup.repeated_runs(Workspace(spark, "collide"), rows, 80, bits).collect()
        if bits == 64:
            assert {(r.doc_id, r.n_words, r.keep_doc_id) for r in spans} == {(41, 40, 40)}
        else:
            hits = paragraph_dedup.run_hits(rows, paragraph_dedup.repeated_seeds(rows), bits).where("doc_id < 40").count()
            assert hits > 100 and {r.doc_id for r in spans} <= {40, 41}
