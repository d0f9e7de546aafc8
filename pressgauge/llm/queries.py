"""The operators of this subpackage as queries over the synthetic tables, with the parameters that their contracts fix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.llm import bpe_join, divergence, fill_middle, langid_gru, maxscore, mixing, packing, paragraph_dedup, prefix_forest, token_orc, toxicity, warc
from pressgauge.llm.jaccard_join import jaccard_components


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> bytes:
    """A vocabulary file of the installed public tokenizers, read once on the driver and shipped to the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as ORC in doc_id order and read back."""
    return token_orc.encode_and_read_back(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)


def op2_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors by integer inner product, for every vector whose id is divisible by 50."""
    return maxscore.maxscore_top_k(_table(spark, sf_dir, "embeddings"), k=5, is_query=F.col("vec_id") % 50 == 0)


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written and read back by the salvage reader."""
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def op4_bpe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document by a shuffle of distinct words, and its decoding."""
    import public_tokenizers

    return bpe_join.digest(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    found = jaccard_components(_table(spark, sf_dir, "documents"), k=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op6_langid_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; those whose crc32(doc_id) is divisible by 5 are held out."""
    return langid_gru.identify(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; those whose crc32(doc_id) leaves 1 by 3 are held out."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte spans of lines and passages that repeat, all but the first of each class, over all documents."""
    return paragraph_dedup.removals(_table(spark, sf_dir, "documents"))


def op9_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty near neighbours by inner product, for every vector whose id is divisible by 20."""
    return prefix_forest.forest_top_k(_table(spark, sf_dir, "embeddings"), k=20, is_query=F.col("vec_id") % 20 == 0)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 1, 2, 3 with at most three passes over a source."""
    return mixing.digest(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language diverge in their terms, by pairs of sources and by leading terms."""
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rewritten for filling in its middle, and rebuilt from that."""
    return fill_middle.digest(_table(spark, sf_dir, "documents"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids packed into sequences of 2,048 tokens, a row per piece."""
    return packing.digest(packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=1))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_orc": op1_token_orc,
    "op2_maxscore_top_k": op2_maxscore_top_k,
    "op3_warc_salvage": op3_warc_salvage,
    "op4_bpe_join": op4_bpe_join,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_langid_gru": op6_langid_gru,
    "op7_toxicity": op7_toxicity,
    "op8_paragraph_dedup": op8_paragraph_dedup,
    "op9_prefix_forest": op9_prefix_forest,
    "op10_source_mixing": op10_source_mixing,
    "op11_source_divergence": op11_source_divergence,
    "op12_fill_middle": op12_fill_middle,
    "op13_best_fit_packing": op13_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_maxscore_top_k": maxscore.ORACLE,
    "op3_warc_salvage": warc.ORACLE,
    "op10_source_mixing": mixing.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op12_fill_middle": fill_middle.ORACLE,
}
