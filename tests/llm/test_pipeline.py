"""Stages of the pipeline one by one on their own inputs, and all together."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from pressgauge.llm import mixing
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_text_operators import brute_components, repeated_windows


def test_stages_on_messy_documents(spark, messy):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    by = dict(corpus_pipeline.STAGES)
    kept = by["language ID"](spark, messy, "").cache()
    assert kept.columns == messy.columns
    gone = {r.doc_id for r in messy.collect()} - {r.doc_id for r in kept.collect()}
    assert gone == {6, 7, 8, 16}
    single = by["n-gram Jaccard join"](spark, kept, "").cache()
    assert single.columns == messy.columns
    groups = brute_components([(r.doc_id, r.text) for r in kept.collect()], 5, 80)
    assert Counter(r.doc_id for r in single.collect()) == Counter({low for _, _, low in groups})
    clean = by["substring dedup"](spark, single, "").cache()
    assert clean.columns == messy.columns
    assert not repeated_windows([(r.doc_id, r.text) for r in clean.collect()])
    mixed = by["mixing"](spark, clean, "").cache()
    assert mixed.columns == messy.columns
    assert mixed.count() == sum(r.copies for r in mixing.digest(clean).collect())
    tokens = by["byte-level BPE"](spark, mixed, "")
    assert tokens.count() == mixed.count()


def test_stages_on_an_empty_table(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def with_ids(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), n, "k", n, n, 1.0, "e", "a", "b", 0.5, 0) for n, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


def test_rejected_rows_take_no_others_of_their_id(spark):
    """Null and repeated ids whose rows differ: a row's fate is its own."""
    clean = [(None, prose(50 + i, 40)) for i in range(4)] + [(3, prose(60 + i, 40)) for i in range(3)]
    docs = with_ids(spark, clean + [(None, None), (None, "123 !"), (3, " "), (3, "456")])
    kept = corpus_pipeline.keep_languages(spark, docs, "")
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(clean)


def test_one_row_per_group_whatever_its_ids(spark):
    """A null-id copy takes no other null-id row with it, and near copies of one id or of none leave one row."""
    words = prose(70, 120).split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    alone = [prose(80 + i, 60) for i in range(4)]
    only_null, one_id = prose(90, 120).split(), prose(91, 120).split()
    edit = lambda w: " ".join([*w[:60], "changed", *w[61:]])
    rows = [(1, " ".join(words)), (None, " ".join(words)), (None, near), (None, alone[0]), (None, alone[1]), (7, alone[2]), (7, alone[3])]
    rows += [(None, " ".join(only_null)), (None, edit(only_null)), (9, " ".join(one_id)), (9, edit(one_id)), (9, edit(one_id)), (7, " ".join(words)), (12, None), (12, "")]
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.one_per_group(spark, with_ids(spark, rows), "").collect())
    assert got == Counter(got.keys())
    fixed = {(1, " ".join(words)), (None, alone[0]), (None, alone[1]), (7, alone[2]), (7, alone[3]), (12, None), (12, "")}
    assert fixed <= set(got) and len(got) == len(fixed) + 2
    assert sum(i is None and t in (" ".join(only_null), edit(only_null)) for i, t in got) == 1
    assert sum(i == 9 for i, _ in got) == 1


def test_the_whole_pipeline_runs(spark, tmp_path):
    """``run`` over a table of files: every stage's decisions show in the end."""
    clean = [(i, prose(100 + i, 60)) for i in range(8)]
    words = prose(200, 120).split()
    rows = [*clean, (20, " ".join(words)), (21, " ".join([*words[:60], "changed", *words[61:]])), (22, None), (23, "123 456"), (24, prose(300, 40) + " " + " ".join(words[:60]))]
    with_ids(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = Counter(r.doc_id for r in out.collect())
    assert set(got) <= {*range(8), 20, 24} and max(got.values()) <= 3 and len(got) >= 5
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert out.where("n_tokens = 0").count() == 0


def test_of_equal_rows_the_same_one_stays(spark):
    """Rows that agree in doc_id and text, but not in source: whatever their order, one of them stays, always the same."""
    text = prose(400, 50)
    rows = [(1, text, "en", s, len(text), 0, "k", 0, 0, 1.0, "e", "a", "b", 0.5, 0) for s in ("s3", "s1", None, "s2")]
    kept = set()
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        got = corpus_pipeline.one_per_group(spark, spark.createDataFrame(order, SCHEMA).repartition(2), "").collect()
        assert len(got) == 1 and got[0].text == text
        kept.add(got[0].source)
    assert len(kept) == 1
