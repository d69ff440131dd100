"""Fusion, priors, boosts and the order of results. Every order is total: ties go to the path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import DEFAULT
from corpusloom.functions import paths


def fused(lanes: DataFrame, k: int = DEFAULT.rrf_k) -> DataFrame:
    """RNK-01: a file's score is the sum over its lanes of 1 / (60 + best rank), ranks from 0."""
    best = lanes.groupBy("filepath", "lane").agg(F.min("rank").alias("rank"))
    return best.groupBy("filepath").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def with_priors(scores: DataFrame, priors: DataFrame, cap: float = DEFAULT.prior_cap) -> DataFrame:
    """RNK-02: a prior between 0 and the cap, for files that are there already."""
    prior = F.coalesce(F.least(F.greatest(F.col("prior"), F.lit(0.0)), F.lit(cap)), F.lit(0.0))
    return scores.join(priors.select("filepath", "prior"), "filepath", "left").withColumn("score", F.col("score") + prior).drop("prior")


def best_texts(lanes: DataFrame, n: int = 1) -> DataFrame:
    """RNK-03: a file's first n different chunk texts by rank, a line each."""
    one = lanes.groupBy("filepath", "text").agg(F.min("rank").alias("rank"))
    own = one.withColumn("i", F.row_number().over(Window.partitionBy("filepath").orderBy("rank", "text"))).where(F.col("i") <= n)
    return own.groupBy("filepath").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n").alias("text"))


def by_score(score: str = "score") -> tuple[Column, Column]:
    """RNK-04."""
    return F.desc(F.round(score, 12)), F.col("filepath")


def reranked(hits: DataFrame, scorer, top: int = DEFAULT.rerank_top) -> DataFrame:
    """RNK-05: the first hits with their scores replaced by scorer(text column); RNK-06 is not to call it."""
    return hits.orderBy(*by_score()).limit(top).withColumn("score", scorer(F.col("text")))


def revalidated(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """RNK-07: hits whose chunk still is in that file."""
    return hits.join(chunks.select("chunk_id", "filepath"), ["chunk_id", "filepath"], "left_semi")


def scaled(score: Column, by: Column | float) -> Column:
    """A factor over one helps whatever the sign."""
    by = F.lit(by) if isinstance(by, float) else by
    return F.when(score >= 0, score * by).otherwise(score / by)


def comention_boost(hits: DataFrame, edges: DataFrame, by: float = DEFAULT.comention) -> DataFrame:
    """RNK-08: hits that share an entity with another hit. Entities are counted, not paired."""
    own = edges.select(F.col("from_path").alias("filepath"), "to_path").distinct().join(hits.select("filepath").distinct(), "filepath", "left_semi")
    shared = own.groupBy("to_path").agg(F.count("*").alias("n")).where("n > 1")
    boosted = own.join(shared, "to_path", "left_semi").select("filepath").distinct().withColumn("boost", F.lit(True))
    return hits.join(boosted, "filepath", "left").withColumn("score", F.when(F.col("boost"), scaled(F.col("score"), by)).otherwise(F.col("score"))).drop("boost")


def salience(last_accessed: Column, accesses: Column, now_ms: int) -> Column:
    """RNK-09: from recency (half a fortnight's, 0.5 if never accessed) and the number of accesses."""
    age = F.greatest((F.lit(now_ms) - last_accessed) / 86_400_000.0, F.lit(0.0))
    recency = F.when(last_accessed.isNull(), 0.5).otherwise(F.pow(F.lit(0.5), age / DEFAULT.half_life_days))
    return 1 + DEFAULT.recency_weight * (recency - 0.5) + DEFAULT.access_weight * F.log(1 + F.greatest(F.coalesce(accesses, F.lit(0)), F.lit(0)))


def access_stats(log: DataFrame) -> DataFrame:
    """RNK-10: when a file was last accessed and how often, from the append-only log (filepath, at)."""
    return log.groupBy("filepath").agg(F.max("at").alias("last_accessed"), F.count("*").alias("accesses"))


def logged(hits: DataFrame, now_ms: int) -> DataFrame:
    """RNK-10: what a search appends to the log."""
    return hits.select("filepath", F.lit(now_ms).cast("long").alias("at"))


def final_order(hits: DataFrame, pins: DataFrame | None = None, limit: int = DEFAULT.limit, output: str = "model_output") -> DataFrame:
    """RNK-11, RNK-12, RNK-13: pinned files first; of error pages the best takes the last place if none is inside the
    limit; then the limit, outputs left out. hits (filepath, score, text) are a search's, at most a few hundred."""
    own = hits.where(~paths.in_output(F.col("filepath"), output))
    own = own.join(pins.select("filepath").withColumn("pinned", F.lit(1)), "filepath", "left") if pins is not None else own.withColumn("pinned", F.lit(None).cast("int"))
    own = own.withColumn("rn", F.row_number().over(Window.orderBy(F.desc_nulls_last("pinned"), *by_score())))
    error = paths.is_error_page(F.col("text"))
    every = Window.partitionBy()
    own = own.withColumn("first_error", F.min(F.when(error, F.col("rn"))).over(every)).withColumn("n", F.count("*").over(every))
    reserve = (F.lit(limit) >= 2) & (F.col("first_error") > limit) & (F.col("rn") == F.col("first_error"))
    place = F.when(reserve, F.lit(limit) - 0.5).otherwise(F.col("rn").cast("double"))
    out = own.withColumn("rank", F.row_number().over(Window.orderBy(place)) - 1).where(F.col("rank") < limit)
    return out.drop("rn", "first_error", "n", "pinned")


def annotated(hits: DataFrame) -> DataFrame:
    """RNK-15: an error page says so instead of its text."""
    label = paths.error_label(F.col("text"))
    return hits.withColumn("text", F.when(label.isNotNull(), F.format_string("[%s is an error page: %s]", F.col("filepath"), label)).otherwise(F.col("text")))


def attached(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """RNK-14: the whole text of each hit, joined after the limit."""
    return hits.join(documents.select("filepath", F.col("text").alias("document")), "filepath", "left")
