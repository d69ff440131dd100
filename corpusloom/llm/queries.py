"""The thin queries over the operators of this package, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embeddings, language, packing, repetition, simhash, substrings, toxicity, url_lists
from .common import fold, saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.fit(documents, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    nodes, index = chat.format_tree(conversations, path)
    return chat.read_back(nodes, index, path)


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return bpe.decode(coded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat")


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = language.fit(documents.where(~held_out).select("doc_id", "text", "lang"))
    return language.identify(documents.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: List events for op9: what each distinct host and each distinct host with first path part has been through. Days are
#: counted from 2023-01-01 and come from the md5 of the pattern.
LIST_EVENTS = """
WITH parsed AS (
  SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]+/([^/?#]+)', 1) AS part
  FROM pages WHERE url IS NOT NULL
), patterns AS (
  SELECT DISTINCT 'host' AS kind, host AS pattern FROM parsed WHERE host <> ''
  UNION SELECT DISTINCT 'domain', regexp_extract(host, '([^.]+[.][^.]+)$', 1) FROM parsed WHERE host LIKE '%.%'
  UNION SELECT DISTINCT 'prefix', concat(host, '/', part) FROM parsed WHERE host <> '' AND part <> ''
), numbered AS (SELECT kind, pattern, {number} AS n FROM patterns WHERE pattern <> ''),
events AS (
  SELECT 'spam' AS list, kind, pattern, 'block' AS verdict, 'add' AS action, n % 400 AS day FROM numbered WHERE n % 3 = 0
  UNION ALL SELECT 'spam', kind, pattern, 'block', 'remove', n % 400 + 20 + n % 97 FROM numbered WHERE n % 3 = 0
  UNION ALL SELECT 'spam', kind, pattern, 'block', 'add', n % 400 + 150 + n % 97 FROM numbered WHERE n % 6 = 0
  UNION ALL SELECT 'adult', kind, pattern, 'block', 'add', n % 500 FROM numbered WHERE n % 5 = 1
  UNION ALL SELECT 'partners', kind, pattern, 'allow', 'add', n % 300 FROM numbered WHERE n % 4 = 2
  UNION ALL SELECT 'partners', kind, pattern, 'allow', 'remove', n % 300 + 200 FROM numbered WHERE n % 4 = 2
)
"""


@query
def op9_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    sql = LIST_EVENTS.format(number="CAST(conv(substr(md5(pattern), 1, 6), 16, 10) AS BIGINT)")
    sql += "SELECT list, kind, pattern, verdict, action, timestamp_seconds(1672531200 + 86400 * day) AS at FROM events"
    events = saved(spark.sql(sql.replace("FROM pages", "FROM {pages}"), pages=pages), "list-events")
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(1672531200 + 3600 * ((F.col("page_id") * 7919) % (24 * 700))))
    return url_lists.judge(captures, events).select("page_id", "blocked", "n_active", "pattern", "lists")


ORACLES["op9_url_lists"] = (
    LIST_EVENTS.format(number="CAST(concat('0x', substr(md5(pattern), 1, 6)) AS BIGINT)")
    + """, intervals AS (
  SELECT list, kind, pattern, verdict, action, day AS a, lead(day) OVER (PARTITION BY list, kind, pattern, verdict ORDER BY day, action DESC) AS z FROM events
), captures AS (
  SELECT page_id, (page_id * 7919) % (24 * 700) AS h, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]+/([^?#]*)', 1) AS path FROM pages
), hits AS (
  SELECT c.page_id, i.list, i.pattern, i.verdict FROM captures c JOIN intervals i
  ON i.action = 'add' AND i.a * 24 <= c.h AND (i.z IS NULL OR c.h < i.z * 24) AND c.host <> ''
  AND (i.kind = 'host' AND c.host = i.pattern OR i.kind = 'domain' AND (c.host = i.pattern OR ends_with(c.host, concat('.', i.pattern)))
    OR i.kind = 'prefix' AND starts_with(concat(c.host, '/', c.path, '/'), concat(i.pattern, '/')))
), found AS (
  SELECT page_id, count(*) AS n_active, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM hits GROUP BY page_id
), best AS (
  SELECT page_id, pattern, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, CASE WHEN verdict = 'block' THEN 1 ELSE 0 END DESC, pattern DESC) AS r FROM hits
)
SELECT c.page_id, coalesce(b.verdict = 'block', false) AS blocked, coalesce(f.n_active, 0) AS n_active, b.pattern, coalesce(f.lists, '') AS lists
FROM captures c LEFT JOIN found f ON c.page_id = f.page_id LEFT JOIN best b ON c.page_id = b.page_id AND b.r = 1
"""
)
