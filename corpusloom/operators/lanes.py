"""Retrieval lanes: each gives (lane, filepath, chunk_id, text, rank), ranks from 0."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import DEFAULT
from corpusloom.functions import paths, vectors
from corpusloom.functions.text import query_tokens, tokens
from corpusloom.plans.lineage import cut


def ranked(df: DataFrame, *order: Column, top: int, lane: str | None = None) -> DataFrame:
    """The first rows in an order, with their rank. The limit is taken before the numbering, which then sees top rows."""
    out = df.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)
    return out.withColumn("lane", F.lit(lane)) if lane else out


def nearest(vectors_of: DataFrame, query: list[float], top: int = DEFAULT.lane_top, metric: str = "l2", key: str = "chunk_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """RET-01, RET-02, RET-03: exact nearest neighbours of a query vector; the scope is filtered before the top."""
    distance = vectors.l2(F.col(vector), vectors.literal(query)) if metric == "l2" else 1 - vectors.cosine(F.col(vector), vectors.literal(query))
    scoped = vectors_of if where is None else vectors_of.where(where)
    near = scoped.withColumn("distance", distance)
    return ranked(near, F.col("distance"), F.col(key), top=top)


def _times(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == term))


def bm25(chunks: DataFrame, query: str, top: int | None = DEFAULT.lane_top, match: str = "any", text: str = "text", key: str = "chunk_id", k1: float = DEFAULT.bm25_k1, b: float = DEFAULT.bm25_b) -> DataFrame:
    """RET-04, RET-05: Okapi BM25 over distinct query tokens, of chunks that have any (or all) of them.

    Only query tokens are counted, in one scan of the texts that shuffles nothing; the counts, a few numbers a chunk, are
    kept, sum up to one row of statistics and are scored. Texts are joined to the chunks that made the top.
    idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    terms = [*dict.fromkeys(query_tokens(query))]
    if not terms:
        return ranked(chunks.where("false").withColumn("score", F.lit(0.0)), F.desc("score"), F.col(key), top=top or 1)
    rest = [c for c in chunks.columns if c != text]
    own = chunks.withColumn("_t", tokens(F.coalesce(F.col(text), F.lit(""))))
    own = cut(own.select(*rest, F.size("_t").alias("_n"), *(_times("_t", t).alias(f"_tf{i}") for i, t in enumerate(terms))))
    stats = own.agg(F.count("*").alias("n"), F.avg("_n").alias("avg"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"d{i}") for i in range(len(terms)))).first()
    n, average = stats["n"], stats["avg"] or 1.0
    score, has = F.lit(0.0), None
    for i in range(len(terms)):
        tf, df = F.col(f"_tf{i}").cast("double"), stats[f"d{i}"]
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        score = score + F.lit(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_n") / average))
        hit = tf > 0
        has = hit if has is None else (has | hit if match == "any" else has & hit)
    scored = own.where(has).select(*rest, score.alias("score"))
    # scores are compared as rounded, so equal chunks tie whatever the order of sums
    best = ranked(scored, F.desc(F.round("score", 9)), F.col(key), top=top) if top else scored
    return best.join(chunks.select(key, text), key).select(*chunks.columns, *[c for c in best.columns if c not in chunks.columns])


def path_hits(path: Column, query: str) -> Column:
    """RET-06: how many of the query's tokens (three characters or more, repeats count) are words of the path."""
    words = F.split(F.regexp_replace(F.lower(path), r"[^\p{L}\p{N}]", " "), " ")
    wanted = query_tokens(query, DEFAULT.path_token_least)
    return F.size(F.filter(F.array(*map(F.lit, wanted)), lambda t: F.array_contains(words, t))) if wanted else F.lit(0)


def representatives(chunks: DataFrame) -> DataFrame:
    """WIN-02, JOI-03: a file's first chunk."""
    return chunks.groupBy("filepath").agg(F.min("chunk_id").alias("chunk_id"), F.min_by("text", "chunk_id").alias("text"))


def path_lane(chunks: DataFrame, query: str, top: int | None = DEFAULT.lane_top) -> DataFrame:
    """RET-06: files whose path has at least two query tokens, by hits, then path."""
    hit = chunks.withColumn("hits", path_hits(F.col("filepath"), query)).where(F.col("hits") >= DEFAULT.path_hits_least)
    files = hit.groupBy("filepath").agg(F.max("hits").alias("hits"), F.min("chunk_id").alias("chunk_id"), F.min_by("text", "chunk_id").alias("text"))
    return ranked(files, F.desc("hits"), F.col("filepath"), top=top) if top else files


def path_pins(hits: DataFrame, pins: int = DEFAULT.path_pins) -> DataFrame:
    """RET-07: the first files among those with the most hits."""
    most = hits.agg(F.max("hits").alias("hits"))
    return hits.join(F.broadcast(most), "hits", "left_semi").orderBy("filepath").limit(pins).select("filepath")


def integrity_lane(chunks: DataFrame, query: str) -> DataFrame:
    """RET-08: error pages whose path shares a query token, at rank 0 of the path lane."""
    pages = chunks.where(paths.is_error_page(F.col("text"), in_bytes=False) & (path_hits(F.col("filepath"), query) >= 1))
    return representatives(pages).withColumn("rank", F.lit(0)).withColumn("lane", F.lit("path"))


def candidate_lane(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """RET-09: graph candidates (filepath, rank) with their first chunk; a file without one still uses up its rank."""
    return candidates.select("filepath", "rank").join(representatives(chunks), "filepath").withColumn("lane", F.lit("kg"))


def best_chunk(chunks: DataFrame, query: str) -> DataFrame:
    """RET-10: each file's best chunk by BM25, else its first."""
    scored = bm25(chunks, query, top=None).groupBy("filepath").agg(F.max_by("chunk_id", F.struct(F.round("score", 9), -F.col("chunk_id"))).alias("best"))
    return chunks.groupBy("filepath").agg(F.min("chunk_id").alias("first")).join(scored, "filepath", "left").select("filepath", F.coalesce("best", "first").alias("chunk_id"))


def sparse_scores(weights: DataFrame, query: DataFrame) -> DataFrame:
    """RET-11: dot products of sparse vectors (key, term, weight) with a query (term, weight)."""
    return weights.join(query.select("term", F.col("weight").alias("q")), "term").groupBy("key").agg(F.sum(F.col("weight") * F.col("q")).alias("score"))


def merged_ranks(rows: DataFrame, k: int = DEFAULT.rrf_k, top: int = 10) -> DataFrame:
    """RET-12: two indices' rankings (lane, filepath, rank from 1), each lane's file once, fused; the first ten."""
    best = rows.groupBy("lane", "filepath").agg(F.min("rank").alias("rank"))
    fused = best.groupBy("filepath").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))
    return fused.orderBy(F.desc(F.round("score", 12)), "filepath").limit(top)
