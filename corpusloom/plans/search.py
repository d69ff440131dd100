"""A whole search as one plan: lanes, fusion, priors, rerank, boosts, order, limit, delivery."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import DEFAULT
from corpusloom.functions import paths
from corpusloom.operators import graph, lanes, rank
from corpusloom.plans.lineage import cut


@dataclass
class Index:
    """Tables of an index; a lane whose tables are missing is left out."""

    chunks: DataFrame
    vectors: DataFrame | None = None
    code_vectors: DataFrame | None = None
    edges: DataFrame | None = None
    entities: DataFrame | None = None
    communities: DataFrame | None = None
    access_log: DataFrame | None = None


def _small(df: DataFrame) -> DataFrame:
    """Matched entities, at most 32 rows, as a local table."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


#: A search has no more hits than its lanes have rows.
MOST = 8 * DEFAULT.lane_top
#: Which lane's chunk stands for a file that several lanes found.
LANES = ("text", "code", "fts", "path", "integrity", "kg")


def representatives(rows: DataFrame) -> DataFrame:
    """(filepath, chunk_id): each file's chunk of the first lane that has it, the best ranked one."""
    place = F.coalesce(F.array_position(F.array(*(F.lit(x) for x in LANES)), F.col("lane")), F.lit(0))
    place = F.when(place == 0, len(LANES) + 1).otherwise(place)
    return rows.groupBy("filepath").agg(F.min(F.struct(place.alias("lane"), "rank", "chunk_id")).alias("x")).select("filepath", F.col("x.chunk_id").alias("chunk_id"))


def search(index: Index, query: str, vector: list[float] | None = None, code_vector: list[float] | None = None, prefix: str | None = None, limit: int = DEFAULT.limit, now_ms: int | None = None, reranker=None, profile: str = "local", current: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """(rank, filepath, score, text). profile `server` (RNK-16) has only the text lane, by cosine, and the keyword lane, of
    which all terms must match; no priors, pins, reserved place, limit or labels of error pages; reranker, co-mention
    boost and salience as in the local one. current: chunks as they are now; a hit whose chunk isn't among them goes
    (RNK-07). documents (filepath, text): the column document is joined to what is left (RNK-14)."""
    chunks = index.chunks.where(paths.in_scope(F.col("filepath"), prefix) & ~paths.is_digest(F.col("filepath")))
    server = profile == "server"
    columns = ["lane", "filepath", "chunk_id", "text", "rank"]
    found = [lanes.bm25(chunks, query, match="all" if server else "any").withColumn("lane", F.lit("fts")).select(columns)]
    for name, table, v in (("text", index.vectors, vector), ("code", None if server else index.code_vectors, code_vector)):
        if table is not None and v is not None:
            near = lanes.nearest(table.join(chunks.select("chunk_id", "filepath"), "chunk_id") if prefix else table, v, metric="cosine" if server else "l2")
            found.append(near.select("chunk_id", "rank").join(chunks.select("chunk_id", "filepath", "text"), "chunk_id").withColumn("lane", F.lit(name)).select(columns))
    pins = matched = None
    if not server:
        own = cut(lanes.path_lane(chunks, query))
        found.append(own.withColumn("lane", F.lit("path")).select(columns))
        found.append(lanes.integrity_lane(chunks, query).select(columns))
        pins = lanes.path_pins(own)
        if index.edges is not None:
            matched = _small(graph.matched_entities(index.entities, query))
            found.append(lanes.candidate_lane(graph.candidates(index.edges, index.communities, matched, prefix), chunks).select(columns))
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    rows = cut(rows)  # a few hundred rows, that several steps read
    hits = rank.fused(rows)
    if index.edges is not None and not server:
        hits = cut(rank.with_priors(hits, graph.priors(index.edges, index.communities, matched, hits)))
    hits = hits.join(rank.best_texts(rows), "filepath")
    if reranker is not None:
        hits = rank.reranked(hits, reranker)
    if current is not None:
        hits = rank.revalidated(hits.join(representatives(rows), "filepath"), current).drop("chunk_id")
    if index.edges is not None:
        hits = rank.comention_boost(hits, index.edges)
    if index.access_log is not None and now_ms is not None:
        stats = rank.access_stats(index.access_log)
        hits = hits.join(stats, "filepath", "left").withColumn("score", rank.scaled(F.col("score"), rank.salience(F.col("last_accessed"), F.col("accesses"), now_ms))).drop("last_accessed", "accesses")
    if server:
        hits = lanes.ranked(hits, *rank.by_score(), top=MOST)
    else:
        hits = rank.annotated(rank.final_order(hits, pins, limit))
    if documents is not None:
        hits = rank.attached(hits, documents)
    return hits.select("rank", "filepath", "score", "text", *(["document"] if documents is not None else []))
