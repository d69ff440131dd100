"""The corpus pipeline: quality rules, language identification, SimHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and reread as the next one's docs. All
but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import language, packing, repetition, simhash, substrings
from corpusloom.llm.common import Bitmap, fresh, saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or repeat themselves too much. A null or empty text has too few words
    and goes; repeated rows and a null id are judged like any other."""
    return repetition.verdicts(docs).where("kept").select(docs.columns)


#: Least score of a text that is in a known language. Of the texts of 50 words and more, none of 9,528 on sf0.1 is below
#: it, and 5 of 15,000 on check_s, which mix two languages; of texts of random letters about 95 % are, of base64 all.
LEAST_SCORE = 0.4


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no known language: without a letter, or with a score under LEAST_SCORE. A missing lang is
    filled with the predicted one. Where no document has a lang, nothing is known to compare with, and only documents
    without a letter go, a null text among them. Repeated rows and a null id are judged like any other."""
    model = language.fit(docs.select("doc_id", "text", "lang"))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.identify(docs, model)
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).withColumn("lang", F.coalesce("lang", "lang_pred"))
    return found.select(docs.columns)


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group, once if its row is repeated; rows with a null id stay.

    Only documents whose id a bitmap has of those that go or come twice are moved; the others are passed by."""
    found = saved(simhash.near_duplicates(docs.select("doc_id", "text")), "groups")
    ids = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and(F.col("doc_id") == F.col("component_id")).alias("first"))
    told = saved(ids.where("n > 1 OR NOT first"), "told")
    hit = fresh("hit", docs)
    marked = Bitmap(told, "doc_id").marked(docs, "doc_id", hit)
    some = marked.where(hit).join(told.where("NOT first").select("doc_id"), "doc_id", "left_anti").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return marked.where(~F.col(hit)).select(docs.columns).unionByName(some)


def passages_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document holds; a document left without a word goes."""
    cut = substrings.without(docs, substrings.passages(docs.select("doc_id", "text")))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("language", identified), ("near_dedup", near_deduplicated), ("substring_dedup", passages_cut), ("packing", packed)]

#: Suffix arrays, fitted machines and packing aren't SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
