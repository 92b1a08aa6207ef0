"""A corpus pipeline of the training-data operators: quality, language, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), docs having the columns of ``documents``, and works on all rows that the one
before kept. The first three return the rows of docs that stay, unchanged; the last returns the packed pieces. Rows with
a null doc_id can't be named by a decision and stay; rows that repeat a doc_id stay or go together. Empty tables, null
texts and extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm import best_fit, hamming_dedup, kn_quality, language_id
from murmura.llm.common import near_ids, save


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    ids = save(rejected.where("doc_id IS NOT NULL").select("doc_id").distinct(), "rejected")
    return near_ids(docs, ids, "doc_id", "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is too high for their language go."""
    return _without(docs, kn_quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where(~F.col("accepted")))


#: Of sf0.1's 10,000 documents, learnt ones included, 7 score less, all of at most 109 characters; texts in languages that
#: weren't learnt and random letters scored 0.22 to 0.29.
KNOWN_LANGUAGE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that the kernel model knows go: without a letter, or with a low score."""
    found = language_id.identify(docs)
    return _without(docs, found.where((F.col("lang_pred") == "und") | (F.col("score") < KNOWN_LANGUAGE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return _without(docs, hamming_dedup.near_duplicates(docs, percent=75).where(~F.col("kept")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, tokenised and packed into sequences of 4096 tokens."""
    import public_tokenizers

    return best_fit.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("quality classifier", quality), ("language ID", language), ("near-duplicates", near_duplicates), ("best-fit packing", packing)]

#: SQL can express neither the models nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; what each keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
