"""The methods inside the operators against plain versions of themselves."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressgauge.llm import langid_gru, paragraph_dedup, postings, prefix_forest, toxicity
from pressgauge.llm.jaccard_join import jaccard_components
from tests.llm.conftest import prose
from tests.llm.test_text_operators import brute_components, words


def test_shared_tokens_equal_plain_counts(spark):
    """Owners over several chunks, with tokens that one, two or all owners hold."""
    rng = random.Random(3)
    held = {o: {1 << 50} | {rng.randrange(400) << 52 for _ in range(rng.randint(1, 9))} for o in range(1, 90)}
    rows = spark.createDataFrame([(o, sorted(t)) for o, t in held.items()] + [(5, sorted(held[5]))], "o long, t array<long>").repartition(7)

    def units(batch):
        for o, t in zip(batch.column("o").to_pylist(), batch.column("t").to_pylist()):
            yield np.array(t, np.uint64), np.full(len(t), o, np.uint64)

    often = Counter(t for tokens in held.values() for t in tokens)
    wanted = {o: {t for t in tokens if often[t] > 1} for o, tokens in held.items()}
    bits = postings.range_bits(spark)
    got = {r.owner: r for r in postings.shared(rows, units, lists=True).collect()}
    assert {o: set(np.frombuffer(b"".join(r.tokens), np.uint32).tolist()) for o, r in got.items()} == {
        o: set(postings.short(np.array(sorted(t), np.uint64), bits).tolist()) for o, t in wanted.items() if t
    }
    assert all(got[o].n >= len(t) for o, t in wanted.items() if t)


def test_jaccard_of_many_repeated_rows(spark):
    """A thousand equal rows and rows of one id are one node; near copies of them link."""
    base = prose(20, 60).split()
    near = " ".join([*base[:57], "x", "y", "z"])
    rows = [(i % 3, " ".join(base)) for i in range(1000)] + [(7, near), (8, " ".join(base).upper()), (9, prose(21, 60))]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, 85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(rows, 4, 85))


def test_pooled_probabilities_equal_a_plain_loop():
    """Windows and their pooling against one position after another, for texts of many lengths."""
    model = langid_gru.ByteGru(["a", "b", "c"])
    texts = ["", "x", "123 !", "Ab cd " * 30, "é" * 70, "z" * 64, "q" * 129]
    raw = [t.encode() for t in texts]
    at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    got = langid_gru.pooled(model, np.frombuffer(b"".join(raw), np.uint8), at)
    squash = lambda x: x / (1 + np.abs(x))
    sig = lambda x: 0.5 * squash(x) + 0.5

    def states(span, side):
        table, u, h, out = model.p[f"x{side}"], model.p[f"u{side}"], langid_gru.HIDDEN, []
        s = np.zeros(h)
        for c in span if side == "f" else span[::-1]:
            a, g = table[c], s @ u
            z, r = sig(a[:h] + g[:h]), sig(a[h : 2 * h] + g[h : 2 * h])
            s = (1 - z) * squash(a[2 * h :] + r * g[2 * h :]) + z * s
            out.append(s)
        return out if side == "f" else out[::-1]

    for i, r in enumerate(raw):
        folded, probs = bytes(c + 32 if 65 <= c <= 90 else c for c in r), []
        for k in range(0, len(folded), langid_gru.SPAN):
            span = folded[k : k + langid_gru.SPAN].ljust(langid_gru.SPAN)
            for c, f, b in zip(span, states(span, "f"), states(span, "b")):
                if 97 <= c <= 122 or c >= 128:
                    e = np.exp(np.concatenate((f, b)) @ model.p["o"] + model.p["c"])
                    probs.append(e / e.sum())
        assert np.allclose(got[i], np.mean(probs, axis=0) if probs else 0, atol=1e-4)


def all_readings(token):
    """Every reading of a token with its channel cost and the letters before it was read."""
    paths = [(0.0, "", "")]
    for c in token:
        new = []
        for paid, text, last in paths:
            if c.isalpha():
                choices = [(c, 0.0)]
            else:
                choices = [(x, toxicity.SWAP) for x in toxicity.LOOKS_LIKE.get(c, "")]
                new.append((paid + (toxicity.DROP if c in toxicity.SEPARATORS else toxicity.SYMBOL), text, last))
            for letter, extra in choices:
                new.append((paid + extra, text + letter, letter))
                if letter == last:
                    new.append((paid + extra + toxicity.REPEAT, text, last))
        paths = new
    return [(paid, text) for paid, text, _ in paths]


def test_restored_tokens_are_the_cheapest_of_all_readings():
    rng = np.random.default_rng(2)
    cost = toxicity.character_costs(rng.integers(0, 50, toxicity.SYMBOLS**3).astype(float))
    for token in ("l0s3r", "a.b", "1d1ot", "loooser", "$tup1d", "x", "...", "tr@@sh", "b4a-d", "||"):
        price = {}
        for paid, text in all_readings(token):
            price[text] = min(price.get(text, math.inf), paid + toxicity.word_cost(text, cost))
        got = toxicity.restore(token, cost)
        assert price[got] <= min(price.values()) + 1e-9


def test_respaced_words_are_the_cheapest_of_all_cuts():
    rng = np.random.default_rng(4)
    cost = toxicity.character_costs(rng.integers(0, 50, toxicity.SYMBOLS**3).astype(float))
    for parts in (list("youloser"), ["lo", "ser"], ["a", "tra", "sh", "b"]):
        best = math.inf
        for cuts in itertools.product((0, 1), repeat=len(parts) - 1):
            found, dropped = [parts[0]], 0
            for part, apart in zip(parts[1:], cuts):
                if apart:
                    found.append(part)
                else:
                    found[-1] += part
                    dropped += 1
            best = min(best, sum(toxicity.word_cost(w, cost, {"loser", "trash"}) for w in found) + toxicity.JOIN * dropped)
        got = toxicity.respace(parts, cost, {"loser", "trash"})
        assert "".join(got) == "".join(parts)
        assert math.isclose(sum(toxicity.word_cost(w, cost, {"loser", "trash"}) for w in got) + toxicity.JOIN * (len(parts) - len(got)), best)


@pytest.fixture(scope="module")
def toxic_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return toxicity.learn(docs, labels, F.lit(True))


def test_words_in_any_number_of_parts():
    """Every way of cutting a weighted word into parts is seen, with marks around letters and letters beyond ASCII."""
    import pyarrow as pa

    counts = np.ones(toxicity.SYMBOLS**3)
    reader = toxicity.Reader(toxicity.character_costs(counts), {"worthles", "zonar", "bastard"})
    told = lambda text: {w for *_, spaced in reader.read(pa.array([text])) for _, w in spaced}
    for parts in ("wo r th le s", "w orthle s", "ba s t a rd", "bast ard", "b a st ard"):
        assert "".join(parts.split()) in told(f"they say {parts} again"), parts
    assert "zonar" in told("un z o n a r! si") and "bastard" in told("« b a s t a r d » ,")
    assert told("they say bast again ard and wo") == set() and told("b a") == set()
    assert "á" in "".join(told("z o n á r"))


def test_spaced_out_words_are_toxic(spark, toxic_model):
    spaced = ["he is l o s e r", "you l o s e r!", "(i d i o t.) he is", "*l* *o* *s* *e* *r*", "such an i di o t you are", "you t ra s h", "l 0 s 3 r, t r @ s h!", "y o u l o s e r i d i o t t r a s h", "s u c h a l o s e r", "you lo ser and id iot and tra sh", "l o s e r " + "x" * 5000]
    clean = ["he is here", "a b c d e f g", "the or an in of to", "lo and ser", prose(31, 200)]
    rows = [(i, t) for i, t in enumerate(spaced + clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxic_model).collect()}
    assert all(got[i] >= 0.7 for i in range(len(spaced))), got
    assert all(got[i] < 0.7 for i in range(len(spaced), len(rows))), got


def test_toxicity_with_clashing_columns(spark, messy):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 13)], "doc_id long, toxic int")
    odd = messy.withColumns({c: F.lit(1) for c in ("y", "_id", "z", "f", "k", "r", "row", "_cut", "_row")})
    assert toxicity.toxicity(odd, labels).count() == messy.count()


def test_line_components_equal_all_pairs(spark):
    """Classes of paragraphs against exact Jaccard similarities of all pairs."""
    rng, rows = random.Random(8), []
    for group in range(6):
        base = prose(800 + group, 30 + 8 * group).split()
        for copy in range(5):
            line = [w if rng.random() > 0.012 * copy else f"e{rng.randrange(10**6)}" for w in base]
            rows.append((len(rows), f"{prose(900 + len(rows), 6)}\n{' '.join(line)}\n{prose(950 + len(rows), 7)}"))
    lines = [(i, line) for i, t in rows for line in t.split("\n") if len(words(line)) >= 20]
    classes = {d: low for d, _, low in brute_components(lines, 5, 80)}
    spans = paragraph_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = {(r.doc_id, r.keep_doc_id) for r in spans if r.kind == "line"}
    assert found == {(d, low) for d, low in classes.items() if d != low}


def test_no_passage_is_removed_everywhere(spark):
    """A passage whose keeper goes as a near line stays in the next text that holds it."""
    base, passage = prose(40, 600).split(), prose(41, 30)
    rows = [(1, " ".join(base)), (2, " ".join([*base[:300], *passage.split(), *base[300:]])), (3, f"{prose(42, 40)} {passage} {prose(43, 40)}")]
    left = paragraph_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert any(passage in r.text for r in left)
    assert {r.doc_id for r in left} == {1, 3}


def test_every_repeated_run_is_left_once(spark):
    """Every run of 20 words that stood in several documents is still there in one, where lines do not differ."""
    rng, rows = random.Random(9), []
    passages = [prose(60 + i, 24) for i in range(8)]
    for i in range(24):
        rows.append((i, "\n".join(f"{prose(1000 + 10 * i + j, 9)} {rng.choice(passages)} {prose(2000 + 10 * i + j, 9)}" for j in range(3))))
    rows.append((30, rows[4][1]))
    left = [words(r.text) for r in paragraph_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    runs = {tuple(w[i : i + 20]) for w in left for i in range(len(w) - 19)}
    for p in passages:
        w = words(p)
        if any(p in t for _, t in rows):
            assert all(tuple(w[i : i + 20]) in runs for i in range(5))


def test_texts_that_differ_in_white_space_alone(spark):
    """Rows of one doc_id with the same words have spans of their own; the first of them keeps what no other text has."""
    a, b = prose(44, 75), prose(45, 60)
    rows = [(1, f"{a} {b}"), (5, f"é  {a}"), (5, f"é {a}"), (5, re.sub(" ", "\t ", f"é {a}"))]
    left = paragraph_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(words(r.text)) for r in left if r.doc_id == 5) == Counter({("é",): 1})


def test_removal_with_clashing_columns(messy):
    odd = messy.withColumns({c: F.lit(1) for c in ("row", "_cut", "_row", "d", "cuts", "seeds", "digest")})
    assert paragraph_dedup.dedup_passages(odd).columns == odd.columns


def forest_recall(ids, v, ask):
    """Recall of the twenty nearest, the share of rows scored, and the digits at which the ascents ended."""
    forest = prefix_forest.Forest(ids, v, prefix_forest.TREES, prefix_forest.WANTED, 5, 20)
    scored = sum(len(rows) for _, rows in forest.candidates(ids[ask], v[ask])) / (len(ask) * len(ids))
    q, r, score = forest(ids[ask], v[ask])
    place = {i: k for k, i in enumerate(ids.tolist())}
    assert np.allclose(score, [v[place[a]] @ v[place[b]] for a, b in zip(q.tolist(), r.tolist())])
    truth = v[ask] @ v.T
    truth[np.arange(len(ask)), ask] = -9
    best = np.argsort(-truth, axis=1, kind="stable")[:, :20]
    found = set(zip(q.tolist(), r.tolist()))
    recall = np.mean([(a, b) in found for a, row in zip(ids[ask].tolist(), ids[best].tolist()) for b in row])
    return recall, scored, forest.levels(forest.strings(v[ask]))[0]


@pytest.mark.parametrize("n", [500, 2000, 8000, 20000])
def test_forest_prunes_and_finds(n):
    """On directions without any structure, for all queries."""
    rng = np.random.default_rng(1)
    v = rng.standard_normal((n, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    recall, scored, _ = forest_recall(np.arange(n), v, np.arange(0, n, 20))
    assert recall >= 0.9 and scored <= 0.3


def test_forest_ascends_further_where_rows_are_thin():
    """Around dense centres the ascent ends at long prefixes, elsewhere at short ones."""
    rng = np.random.default_rng(2)
    parts = [c + spread * rng.standard_normal((size, 64)) for size, spread in ((2000, 0.1), (2000, 0.3), (2000, 0.6)) for c in rng.standard_normal((1, 64))]
    v = np.concatenate([*parts, rng.standard_normal((3000, 64))])
    v /= np.linalg.norm(v, axis=1)[:, None]
    recall, scored, levels = forest_recall(np.arange(len(v)), v, np.arange(0, len(v), 40))
    assert recall >= 0.85 and scored <= 0.3 and len(set(levels.tolist())) >= 3


def test_token_files_skip_row_groups(spark, tmp_path):
    """A look-up by doc_id reads a row group, not the table."""
    from pressgauge.llm import queries, token_orc

    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of number "), F.col("id").cast("string")).alias("text"))
    path = str(tmp_path / "tokens")
    token_orc.write_token_orc(docs, path, queries.tokenizer_file("word_bpe_49k.json"), 1)
    found = token_orc.read_token_orc(spark, path).where("doc_id = 2222")
    assert len(found.collect()) == 1
    plan = found._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaf = plan.collectLeaves().head()
    assert leaf.metrics().apply("numOutputRows").value() <= 2000


def test_tokenizers_that_keep_case_are_refused():
    from pressgauge.llm import queries, token_orc

    with pytest.raises(ValueError):
        token_orc.PartEncoder(queries.tokenizer_file("byte_bpe_50k.json"))


def test_ragged_and_wide_vectors(spark):
    """Missing components count as 0, in rows and queries alike."""
    from pressgauge.llm import maxscore

    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, int(rng.integers(1, 90)))]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    v = np.zeros((120, 90))
    for i, x in rows:
        v[i, : len(x)] = x
    w = np.floor(256 * v)
    got = maxscore.maxscore_top_k(df, 5, F.col("vec_id") % 50 == 0).collect()
    wanted = {(q, r + 1, int(i), int(w[q] @ w[i])) for q in (0, 50, 100) for r, i in enumerate(sorted((j for j in range(120) if j != q), key=lambda j: (-(w[q] @ w[j]), j))[:5])}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == wanted
    near = prefix_forest.forest_top_k(df, 20, F.col("vec_id") % 20 == 0).collect()
    assert all(abs(r.score - v[r.query_id] @ v[r.vec_id]) < 1e-9 for r in near) and len(near) == 6 * 20


def test_shuffle_files_go_with_the_table_that_is_written(spark):
    from pressgauge.llm.scratch import CLEANUP, Workspace

    def blocks():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return manager.getAllFiles().mkString(" ").count("shuffle_")

    before, kept, work = blocks(), spark.conf.get(CLEANUP), Workspace(spark, "cleanup")
    table = work.cut(spark.range(1000).repartition(4, F.col("id")), "dealt")
    assert blocks() <= before and spark.conf.get(CLEANUP) == kept and table.count() == 1000
    work.close()


def test_frequent_word_parts_stay_encoded(monkeypatch):
    """A part that every chunk holds is encoded once, however many others come by."""
    from pressgauge.llm import queries, token_orc

    monkeypatch.setattr(token_orc, "CACHE", 40)
    encoder, seen = token_orc.PartEncoder(queries.tokenizer_file("word_bpe_49k.json")), Counter()
    for name in ("_each", "_letters"):
        monkeypatch.setattr(encoder, name, lambda texts, f=getattr(encoder, name): [seen.update(texts), f(texts)][1])
    chunks = [["often", "!!", *(f"w{'abcdefghij'[k]}{'abcdefghijklmnopqrst'[i]}" for i in range(18))] for k in range(10)]
    got = [encoder.encode([p.encode() for p in c]) for c in chunks]
    assert seen["often"] == 1 and len(encoder.cache) + len(encoder.older) <= 40
    assert all(ids == token_orc.PartEncoder._each(encoder, c) for c, ids in zip(chunks, got))


def test_token_totals_read_no_ids(spark, tmp_path):
    from pressgauge.llm import queries, token_orc

    path = str(tmp_path / "tokens")
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).repartition(3)
    token_orc.write_token_orc(docs, path, queries.tokenizer_file("word_bpe_49k.json"), 1)
    plan = token_orc.token_digest(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert [s.count("ids") for s in re.findall(r"ReadSchema: (struct<.*?>)\s", plan)].count(0) == 1


def test_a_node_meets_few_hubs_however_many_keys_it_has(spark, monkeypatch):
    """Near copies that share most of twenty keys meet the same few hubs under all of them."""
    from pressgauge.llm import linking
    from pressgauge.llm.scratch import Workspace

    rng = random.Random(3)
    keys = [(key, node) for node in range(200) for key in range(20) if rng.random() < 0.7]
    members = spark.createDataFrame([(k, n, 30, n) for k, n in keys], "key long, node long, n int, component long")
    sets = spark.createDataFrame([(n, [*range(29), 1000 + n]) for n in range(200)], "node long, items array<long>")
    work, tables = Workspace(spark, "hubs"), {}
    monkeypatch.setattr(work, "cut", lambda df, name, f=work.cut: tables.setdefault(name, f(df, name)))
    linking.families(work, members, 1, sets, lambda pairs: pairs, 80)
    assert tables["family-pairs"].count() <= 200 * 8
    # The busiest members are hubs of nearly all keys that they have.
    assert tables["leading"].count() == 0 and tables["family"].count() > 0


def test_packed_places_and_few_among_many():
    from pressgauge.llm.paragraph_dedup import _member, _plain
    from pressgauge.llm.words import spans

    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 22, 5000, dtype=np.uint64) << np.uint64(3)
    for wanted in (x[::9], x[:0], rng.integers(0, 1 << 25, 700, dtype=np.uint64)):
        assert (_member(x, wanted) == np.isin(x, wanted)).all()
    texts = [b"One  TWO\tthree", b"", b"\xc3\x89 four", b" five\n"]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    start, end, row = spans(data, at)
    low, begin, stop = _plain(data, start, end)
    first = np.searchsorted(row, np.arange(5))
    assert [low[begin[a] : stop[b - 1]] for a, b in zip(first, first[1:]) if b > a] == [b" ".join(t.lower().split()) for t in texts if t.split()]


def test_lists_that_go_around_are_as_small_as_they_are_counted(spark):
    """Spans are one number each: rows with lists of structs would be several times what ``small_side`` counts."""
    docs = spark.createDataFrame([(i, "same line " * 30 + f"\nend {i}") for i in range(4)], "doc_id long, text string")
    spans = paragraph_dedup.removals(docs)
    plan = paragraph_dedup.without(docs, spans)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and re.search(r"_cut#\d+", plan)
    assert paragraph_dedup._packed(F.col("a"), F.col("b")) is not None
    got = spark.createDataFrame([(3, 7), (0, 2**31 - 1)], "a int, b int").select(paragraph_dedup._packed(F.col("a"), F.col("b")).alias("x"))
    assert [(r.x >> 32, r.x & 0xFFFFFFFF) for r in got.collect()] == [(3, 7), (0, 2**31 - 1)]


def test_a_passage_that_many_unlike_lines_hold_makes_few_pairs(spark, monkeypatch):
    """Lines that share a common passage, and with it keys, are compared only where they share rare items too."""
    from pressgauge.llm import linking
    from pressgauge.llm.scratch import Workspace

    common = list(range(60))
    sets = [(n, [*common, *range(1000 * n, 1000 * n + 30)]) for n in range(1, 121)]
    # The last one is a near copy of the first.
    sets[-1] = (120, [*sets[0][1][:-2], 7_000_001, 7_000_002])
    nodes = spark.createDataFrame([(n, n, len(items)) for n, items in sets], "node long, component long, n long")
    items = spark.createDataFrame(sets, "node long, items array<long>")
    got = linking.sharing_rare(nodes, items, 80).select("x_node", "y_node").collect()
    assert {tuple(r) for r in got} == {(1, 120)}
    # With all of the way there: keys of all of them, no family that settles them.
    members = spark.createDataFrame([(k, n, len(i)) for k in range(3) for n, i in sets], "key long, node long, n int")
    work, tables = Workspace(spark, "rare"), {}
    monkeypatch.setattr(linking, "SMALL", 1)
    cut = Workspace.cut
    monkeypatch.setattr(Workspace, "cut", lambda self, df, name: tables.setdefault(name, []).append(df := cut(self, df, name)) or df)
    monkeypatch.setattr(Workspace, "close", lambda self: None)
    labels = linking.link(work, members, items, 80, lambda x, y: F.lit(True), lambda pairs: pairs, members.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys")))
    assert {(r.node, r.component) for r in labels.collect()} == {(1, 1), (120, 1)}
    assert sum(t.count() for t in tables["pairs"]) <= 10


def test_followers_of_all_chunks_are_dealt_out(spark, monkeypatch):
    """What repeats within a chunk goes to many ranges, not all to that of the least digest; batches of hits are bounded."""
    monkeypatch.setattr(paragraph_dedup, "HITS", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        docs = spark.createDataFrame([(i, f"{prose(7000 + i, 300)} {prose(9000 + i, 5)} {prose(7000 + i, 300)}") for i in range(40)], "doc_id long, text string").repartition(4)
        rows = paragraph_dedup._slim(docs).withColumn("cuts", F.expr("cast(null as array<struct<start: int, end: int>>)"))
        hits = paragraph_dedup.run_hits(rows, paragraph_dedup.repeated_seeds(rows))
        dealt = hits.where("keeper > 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r["count"] for r in dealt) == 40 * 281 and len(dealt) >= 2
