"""The training-corpus pipeline: language ID, near duplicates, repeated passages, mixing, tokens.

Every stage takes the documents that its predecessor kept, with all their columns, and returns documents; the last
returns a row of token digests per document it was given. A stage is judged on its own input, so copies that the mix
repeats on purpose are tokenized as often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.llm import bpe_join, langid_gru, mixing, paragraph_dedup
from pressgauge.llm.jaccard_join import jaccard_rows, text_hash
from pressgauge.llm.queries import tokenizer_file
from pressgauge.llm.scratch import cut, small_side

#: Language ID rejects documents without letters and those whose best language holds less than this share.
LEAST_LANGUAGE_SCORE = 0.35


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID; documents that it rejects go. The decision stays with its row, so ids may repeat or be null."""
    return langid_gru.certain(docs, langid_gru.learn(docs, F.lit(True)), LEAST_LANGUAGE_SCORE)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five words at 0.8; of each group one row stays, that with the smallest doc_id, null last.

    Rows are told apart by doc_id and text; documents without words are in no group and all stay.
    """
    texts = jaccard_rows(docs, k=5, percent=80).where("group is not null").groupBy("group", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    texts = cut(texts, "group-texts")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    first = texts.groupBy("group").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("texts"))
    # Texts that go, and those of which a single row stays; all other rows are read past this list.
    open_ = texts.join(first.where("texts > 1"), "group", "left").withColumn("goes", F.col("first").isNotNull() & (order != F.col("first")))
    listed = open_.where("goes or n > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"), F.col("goes").alias("_goes"))
    listed = small_side(cut(listed, "dropped"))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (text_hash() == F.col("_text"))
    marked = docs.join(listed, same, "left")
    single = marked.where(F.col("_goes").isNull()).select(*docs.columns)
    repeated = marked.where(~F.col("_goes")).select(*docs.columns)
    # Texts are shuffled only if a row that stays has copies of itself. Of rows that agree in doc_id and text that with the
    # smallest other columns stays, so that reruns keep the same one.
    if listed.where("not _goes").isEmpty():
        return single
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_")))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return single.unionByName(repeated.groupBy("doc_id", "text").agg(F.min_by(whole, others).alias("_row")).select("_row.*"))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: repeated lines and passages are cut out of all documents but the first that holds them."""
    return paragraph_dedup.dedup_passages(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to source weights; a document comes out as often as the mix takes it."""
    return mixing.emit(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE encoding and decoding, a row per document and copy."""
    import public_tokenizers

    return bpe_join.digest(docs, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", keep_languages),
    ("n-gram Jaccard join", one_per_group),
    ("substring dedup", drop_passages),
    ("mixing", mix),
    ("byte-level BPE", tokens),
]

#: The network of the first stage cannot be written in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES one after another over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, "stage")
    return docs
