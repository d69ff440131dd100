"""The file-entity graph: candidates and priors by one hop, PageRank, projection, hubs, labels, edges, symbols."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import DEFAULT
from corpusloom.functions import paths
from corpusloom.functions.text import graph_tokens
from corpusloom.plans.lineage import dropped, stored

C = DEFAULT


def matched_entities(entities: DataFrame, query: str, cap: int = C.entity_cap) -> DataFrame:
    """GRF-02: for each query token, in order, the shortest names that hold it, at most 32 a token and 32 overall."""
    words = graph_tokens(query)
    if not words:
        return entities.select("path", "name").where("false")
    hit = F.filter(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(words))), lambda x: F.contains(F.lower("name"), x["t"]))
    rows = entities.select("path", "name", F.explode(hit).alias("x")).select("path", "name", F.col("x.i").alias("i"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.length("name"), "name", "path"))).where(F.col("r") <= cap)
    first = rows.groupBy("path", "name").agg(F.min(F.struct("i", "r")).alias("place"))
    return first.orderBy("place", "path").limit(cap).select("path", "name")


def direct_counts(edges: DataFrame, matched: DataFrame, prefix: str | None = None) -> DataFrame:
    """GRF-03: files by how many of the matched entities they hold. At most 32 entities go round."""
    own = edges.where(paths.in_scope(F.col("from_path"), prefix))
    return own.join(F.broadcast(matched.select(F.col("path").alias("to_path"))), "to_path", "left_semi").groupBy(F.col("from_path").alias("filepath")).agg(F.count_distinct("to_path").alias("direct"))


def related_entities(edges: DataFrame, files: DataFrame, matched: DataFrame) -> DataFrame:
    """GRF-04: other entities of these files, by how many of the files hold them."""
    own = edges.select(F.col("from_path").alias("filepath"), "to_path").distinct().join(files.select("filepath").distinct(), "filepath", "left_semi")
    return own.join(F.broadcast(matched.select(F.col("path").alias("to_path"))), "to_path", "left_anti").groupBy("to_path").agg(F.count("*").alias("files"))


def neighbour_counts(edges: DataFrame, related: DataFrame, prefix: str | None = None) -> DataFrame:
    """GRF-05: files by how many related entities they hold."""
    own = edges.where(paths.in_scope(F.col("from_path"), prefix)).select(F.col("from_path").alias("filepath"), "to_path").distinct()
    return own.join(related.select("to_path"), "to_path", "left_semi").groupBy("filepath").agg(F.count("*").alias("neighbours"))


def community_weights(communities: DataFrame, direct: DataFrame) -> DataFrame:
    """GRF-08: a community's weight, the direct counts of its files, and its size; those with weight."""
    sizes = communities.groupBy("community_id").agg(F.count_distinct("file_path").alias("size"))
    weights = communities.select("community_id", F.col("file_path").alias("filepath")).distinct().join(direct, "filepath").groupBy("community_id").agg(F.sum("direct").alias("weight"))
    return weights.join(sizes, "community_id")


def penalty(size: Column) -> Column:
    """GRF-09: what a very large community loses."""
    return F.least(F.greatest((size - C.community_free) / float(C.community_span), F.lit(0.0)), F.lit(1.0)) * C.community_penalty


def _share(value: Column, most: str) -> Column:
    return F.least(F.lit(1.0), F.coalesce(value, F.lit(0)) / F.greatest(F.coalesce(F.col(most), F.lit(1)), F.lit(1)))


def community_scores(communities: DataFrame, weights: DataFrame) -> DataFrame:
    """Each file's best community score, weights over the largest."""
    most = weights.agg(F.max("weight").alias("w"))
    scored = weights.crossJoin(F.broadcast(most)).select("community_id", (C.community_weight * F.col("weight") / F.col("w") - penalty(F.col("size"))).alias("s"))  # one row
    return communities.select("community_id", F.col("file_path").alias("filepath")).join(scored, "community_id").groupBy("filepath").agg(F.greatest(F.max("s"), F.lit(0.0)).alias("community"))


def priors(edges: DataFrame, communities: DataFrame, matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """GRF-06: a file's prior: its share of direct hits, of neighbour hits (half without direct ones) and its best
    community (half without direct hits too). Largest counts are those of the candidates."""
    files = candidates.select("filepath").distinct()
    direct_all = direct_counts(edges, matched)
    direct = direct_all.join(files, "filepath", "left_semi")
    near = neighbour_counts(edges, related_entities(edges, direct, matched)).join(files, "filepath", "left_semi")
    own = community_scores(communities, community_weights(communities, direct_all))
    most = direct.agg(F.max("direct").alias("max_direct")).crossJoin(near.agg(F.max("neighbours").alias("max_near")))  # one row
    rows = files.join(direct, "filepath", "left").join(near, "filepath", "left").join(own, "filepath", "left").crossJoin(F.broadcast(most))
    has = F.coalesce(F.col("direct"), F.lit(0)) > 0
    score = C.direct_weight * _share(F.col("direct"), "max_direct") + C.neighbour_weight * _share(F.col("neighbours"), "max_near") * F.when(has, 1.0).otherwise(0.5)
    score = score + F.coalesce(F.col("community"), F.lit(0.0)) * F.when(has, 1.0).otherwise(0.5)
    return rows.select("filepath", F.least(score, F.lit(C.prior_cap)).alias("prior")).where("prior > 0")


def candidates(edges: DataFrame, communities: DataFrame, matched: DataFrame, prefix: str | None = None, limit: int = 80) -> DataFrame:
    """GRF-07: files worth looking at: by direct hits, by neighbours, by community; each once, with its best reason."""
    direct = direct_counts(edges, matched, prefix)
    near = neighbour_counts(edges, related_entities(edges, direct, matched), prefix).join(direct, "filepath", "left_anti")
    weights = community_weights(communities, direct)
    by_direct = direct.orderBy(F.desc("direct"), "filepath").limit(40).withColumn("m", F.max("direct").over(Window.partitionBy()))
    by_direct = by_direct.select("filepath", F.lit(0).alias("reason"), (C.direct_weight * F.least(F.lit(1.0), F.col("direct") / F.col("m"))).alias("score"))
    by_near = near.orderBy(F.desc("neighbours"), "filepath").limit(40).withColumn("m", F.max("neighbours").over(Window.partitionBy()))
    by_near = by_near.select("filepath", F.lit(1).alias("reason"), (C.neighbour_weight * F.least(F.lit(1.0), F.col("neighbours") / F.col("m"))).alias("score"))
    most = weights.agg(F.max("weight").alias("w"))
    scored = weights.crossJoin(F.broadcast(most)).select("community_id", "weight", F.greatest(C.community_weight * F.col("weight") / F.col("w") - penalty(F.col("size")), F.lit(0.0)).alias("score"))  # one row
    own = communities.where(paths.in_scope(F.col("file_path"), prefix)).select("community_id", F.col("file_path").alias("filepath")).distinct()
    own = own.withColumn("r", F.row_number().over(Window.partitionBy("community_id").orderBy("filepath"))).where("r <= 8")
    by_community = own.join(scored, "community_id").orderBy(F.desc("weight"), "community_id", "filepath").limit(80).select("filepath", F.lit(2).alias("reason"), "score").where("score > 0")
    every = by_direct.unionByName(by_near).unionByName(by_community)
    best = every.groupBy("filepath").agg(F.min(F.struct((-F.col("score")).alias("s"), "reason")).alias("x")).select("filepath", F.col("x.reason").alias("reason"), (-F.col("x.s")).alias("score"))
    order = (F.desc(F.round("score", 12)), F.col("reason"), F.col("filepath"))
    return best.orderBy(*order).limit(min(limit, 80)).withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def pagerank(edges: DataFrame, seeds: DataFrame, restart: float = C.ppr_restart, rounds: int = C.ppr_rounds, most_edges: int | None = None, block: int = 1 << 19) -> DataFrame:
    """GRF-10: personalised PageRank over the undirected graph with an entry for each edge row, from the seeds (path)
    that occur, for a fixed number of rounds; (filepath, mass) of files over the largest. The reference's bound on the
    number of edges is an option; without it any graph is walked.

    Mass goes from entities to files and back, so the files of the last round depend on the entities of the round before,
    these on those two rounds earlier, and so on: of each two rounds the walk makes one over the entities. Files next to
    each other by path share entities, so a range of files, of about `block` edges, is a block: a row with arrays of its
    edges. Entities are dealt into as many blocks by hash, and what goes between two blocks is one row with an array, a
    number for each entity that both hold. Each step is written as a table, after which its shuffle files go, and the one
    before is removed. A file isn't parted: its edges are in one block."""
    restart, rounds = min(max(restart, 0.05), 0.95), min(rounds, 200)
    empty = edges.select(F.col("from_path").alias("filepath"), F.lit(0.0).alias("mass")).where("false")
    rows = edges.count()
    if rounds < 1 or not rows or most_edges and rows > most_edges:
        return empty
    parts = max(1, -(-rows // block))
    ranges = edges.select("from_path", "to_path").repartitionByRange(parts, "from_path")
    built = stored(ranges.mapInArrow(_block, "b long, at binary, lens binary, sizes binary, paths array<string>, names array<string>, counts array<long>"), "ppr-files")
    held = built.select("b", F.posexplode(F.arrays_zip("names", "counts")).alias("j", "x")).select("b", "j", F.col("x.names").alias("to_path"), F.col("x.counts").alias("n"))
    held = held.join(seeds.select(F.col("path").alias("to_path")).distinct().withColumn("seed", F.lit(True)), "to_path", "left")
    # an entity's number is its first place
    place, same = F.shiftleft("b", 28).bitwiseOR(F.col("j")), Window.partitionBy("to_path")
    held = held.select("b", "j", F.coalesce("seed", F.lit(False)).alias("seed"), place.alias("place"), F.min(place).over(same).alias("e"), F.sum("n").over(same).alias("d"))
    held = held.select("b", "j", "e", "d", "seed", (F.col("seed") & (F.col("e") == F.col("place"))).alias("first"), F.pmod(F.xxhash64("e"), F.lit(parts)).alias("q"))
    held = stored(held, "ppr-entities")
    count = held.where("first").count()
    if not count:
        dropped(built)
        dropped(held)
        return empty
    files = stored(built.drop("names", "counts").groupBy("b").cogroup(held.select("b", "j", "e", "q").groupBy("b")).applyInArrow(_file_block, "b long, at binary, lens binary, sizes binary, paths array<string>, keys binary, widths binary"), "ppr-blocks")
    dropped(built)
    entities = stored(held.select("b", "e", "d", "seed", "q").groupBy("q").applyInArrow(_entity_block, "q long, at binary, d binary, seeds binary, keys binary, widths binary"), "ppr-near")
    dropped(held)

    def to_files(left, right) -> tuple:
        """The block, its files' mass, and each edge's file."""
        import numpy as np

        x = _arrays(left)
        file = np.repeat(np.arange(len(x["lens"])), x["lens"])
        return x, (1 - restart) * np.bincount(file, _taken(x, right, "q")[x["at"]], len(x["lens"])), file

    def to_entities(left, right):
        import numpy as np

        x, r, file = to_files(left, right)
        return _given(left, x, "b", "q", (1 - restart) * np.bincount(x["at"], (r / np.maximum(x["sizes"], 1))[file], x["widths"].sum()))

    def summed(start: float):
        """What comes to entities and what starts there, over their degrees, for each block that holds them."""

        def run(left, right):
            import numpy as np

            x = _arrays(left)
            mass = np.bincount(x["at"], _taken(x, right, "b"), len(x["d"]))
            mass[x["seeds"]] += start
            return _given(left, x, "q", "b", (mass / x["d"])[x["at"]])

        return run

    def last(left, right):
        import pyarrow as pa

        _, r, _ = to_files(left, right)
        return pa.table({"filepath": left["paths"].combine_chunks().flatten(), "r": r}).filter(pa.array(r > 0))

    moved, mass = "b long, q long, z binary", None
    for i in range((rounds + 1) // 2):
        sent = files.drop("paths").groupBy("b").cogroup(mass.groupBy("b")).applyInArrow(to_entities, moved) if i else edges.sparkSession.createDataFrame([], moved)
        start = (1.0 if not i and rounds % 2 else restart) / count
        before, mass = mass, stored(entities.groupBy("q").cogroup(sent.groupBy("q")).applyInArrow(summed(start), moved), "ppr-mass")
        if before is not None:
            dropped(before)
    dropped(entities)
    total = stored(files.groupBy("b").cogroup(mass.groupBy("b")).applyInArrow(last, "filepath string, r double"), "ppr-sum")
    dropped(files)
    dropped(mass)
    return total.crossJoin(F.broadcast(total.agg(F.max("r").alias("m")))).where("m > 0").select("filepath", (F.col("r") / F.col("m")).alias("mass"))  # one row


def _block(batches):
    """A partition of edges as one row: `at`, the entity of each edge by files; of each file its edges that have an entity
    (lens) and all (sizes); of each entity its edges, those without a file too (counts)."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    batches = [x for x in batches if x.num_rows]
    if not batches:
        return
    (f, paths), (e, names) = ((c.indices.fill_null(-1).to_numpy(), c.dictionary) for c in (pa.concat_arrays([x.column(k) for x in batches]).dictionary_encode() for k in (0, 1)))
    linked = (f >= 0) & (e >= 0)
    file, at = f[linked], e[linked]
    sizes, counts = np.bincount(f[f >= 0], minlength=len(paths)), np.bincount(e[e >= 0], minlength=len(names))
    raw = {"at": at[np.argsort(file, kind="stable")], "lens": np.bincount(file, minlength=len(paths)), "sizes": sizes}
    lists = {"paths": paths, "names": names, "counts": pa.array(counts, pa.int64())}
    one = {"b": pa.array([TaskContext.get().partitionId()], pa.int64())} | _binary(raw)
    yield pa.RecordBatch.from_pydict(one | {k: pa.ListArray.from_arrays([0, len(v)], v) for k, v in lists.items()})


def _file_block(left, right):
    """The block with its entities in the order of their blocks (keys, of so many of its entities: widths) and numbers."""
    import numpy as np
    import pyarrow as pa

    j, e, q = (right[k].to_numpy() for k in "jeq")
    order, rank = np.lexsort((e, q)), np.empty(len(j), np.int32)
    rank[j[order]] = np.arange(len(j))
    keys, widths = np.unique(q, return_counts=True)
    at = np.frombuffer(left["at"][0].as_buffer(), np.int32)
    return pa.table({k: left[k] for k in ("b", "lens", "sizes", "paths")} | _binary({"at": rank[at], "keys": keys, "widths": widths}))


def _entity_block(own):
    """The entities of a block in one row: their degrees, which are seeds, and, by blocks of files (keys, widths) and
    numbers, the places of those that each holds."""
    import numpy as np
    import pyarrow as pa

    b, e = own["b"].to_numpy(), own["e"].to_numpy()
    order = np.lexsort((e, b))
    first, at = np.unique(e[order], return_index=True, return_inverse=True)[1:]
    keys, widths = np.unique(b, return_counts=True)
    d, seeds = own["d"].to_numpy()[order][first], np.flatnonzero(own["seed"].to_numpy()[order][first])
    return pa.table({"q": own["q"].slice(0, 1)} | _binary({"at": at, "d": d, "seeds": seeds, "keys": keys, "widths": widths}))


#: The arrays of blocks.
KINDS = {"at": "int32", "lens": "int32", "sizes": "int32", "seeds": "int32", "widths": "int32", "d": "int64", "keys": "int64"}


def _binary(arrays: dict) -> dict:
    import pyarrow as pa

    return {k: pa.array([v.astype(KINDS[k]).tobytes()], pa.binary()) for k, v in arrays.items()}


def _arrays(left) -> dict:
    import numpy as np

    return {k: np.frombuffer(left[k][0].as_buffer(), KINDS[k]) for k in left.column_names if k in KINDS}


def _taken(x: dict, right, other: str):
    """The numbers that came from the other blocks, in the order of keys; zero from those that sent none."""
    import numpy as np

    ends = np.cumsum(x["widths"])
    values, place = np.zeros(x["widths"].sum()), dict(zip(x["keys"].tolist(), zip((ends - x["widths"]).tolist(), ends.tolist(), strict=True), strict=True))
    for key, z in zip(right[other].to_pylist(), right["z"].to_pylist(), strict=True):
        low, high = place[key]
        values[low:high] = np.frombuffer(z)
    return values


def _given(left, x: dict, own: str, other: str, values):
    """A row for each other block that gets anything."""
    import numpy as np
    import pyarrow as pa

    pieces = zip(x["keys"].tolist(), np.split(values, np.cumsum(x["widths"]))[:-1], strict=True)
    rows = [(key, z.tobytes()) for key, z in pieces if z.any()]
    out = {own: pa.array([left[own][0].as_py()] * len(rows), pa.int64()), other: pa.array([k for k, _ in rows], pa.int64()), "z": pa.array([z for _, z in rows], pa.binary())}
    return pa.table([out[k] for k in "bqz"], names=list("bqz"))


def pagerank_prior(mass: DataFrame, candidate_files: DataFrame) -> DataFrame:
    """GRF-11: 0.12 of the mass; nothing for files without, even if that is all of them."""
    return candidate_files.select("filepath").distinct().join(mass, "filepath", "left").select("filepath", (C.ppr_weight * F.coalesce("mass", F.lit(0.0))).alias("prior"), (F.coalesce("mass", F.lit(0.0)) > 0).alias("connected"))


def projection(edges: DataFrame, least: int = C.entity_files_least, most: int = C.entity_files_most) -> DataFrame:
    """GRF-12: (a, b, w): files that share entities; entities of more than 64 files tell nothing and are left out, which
    also bounds the pairs of a group."""
    own = edges.select("from_path", "to_path").distinct()
    degree = own.groupBy("to_path").agg(F.count("*").alias("n")).where(F.col("n").between(least, most))
    kept = own.join(degree.select("to_path"), "to_path", "left_semi")
    a, b = kept.withColumnRenamed("from_path", "a"), kept.withColumnRenamed("from_path", "b")
    return a.join(b, "to_path").where("a < b").groupBy("a", "b").agg(F.count("*").alias("w"))


def shared_files(edges: DataFrame, least: int = C.entity_files_least, most: int = C.entity_files_most) -> DataFrame:
    """(members): the files, ascending, of each entity that has a pair in `projection`. The edges move once, and of an
    entity of too many files no more than one over is held."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by entity and file, the file that is null first. What a batch ends in goes on with the next."""
        held = None
        for batch in itertools.chain(batches, [None]):
            parts = [x for x in (held, batch) if x is not None and x.num_rows]
            if not parts:
                continue
            own, to = (pa.concat_arrays([x.column(name) for x in parts]) for name in ("from_path", "to_path"))
            fresh = np.append(True, np.asarray(pc.not_equal(to.slice(1), to.slice(0, len(to) - 1))))
            other = pc.coalesce(pc.not_equal(own.slice(1), own.slice(0, len(own) - 1)), pc.is_valid(own.slice(1)))
            kept = np.flatnonzero(fresh | np.append(True, np.asarray(other)))
            to, own, start = to.take(pa.array(kept)), own.take(pa.array(kept)), np.flatnonzero(fresh[kept])
            if batch is None:
                start = np.append(start, len(own))
            else:
                held = pa.RecordBatch.from_arrays([own.slice(start[-1], most + 1), to.slice(start[-1], most + 1)], names=["from_path", "to_path"])
            number, valid = np.diff(start), np.asarray(pc.is_valid(own))
            files = number - ~valid[start[:-1]]
            good = (number >= least) & (number <= most) & (files >= 2)
            picked = own.slice(0, start[-1]).filter(pa.array(np.repeat(good, number) & valid[: start[-1]]))
            ends = pa.array(np.concatenate([[0], np.cumsum(files[good])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, picked)], names=["members"])

    own = edges.select("from_path", "to_path").where("to_path IS NOT NULL").repartition("to_path").sortWithinPartitions("to_path", "from_path")
    return own.mapInArrow(run, f"members array<{edges.schema['from_path'].dataType.simpleString()}>")


def knn_edges(files: DataFrame, k: int = C.knn_neighbours, key: str = "filepath", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """GRF-13: the pairs (a, b), a < b, of each file with its k nearest by cosine (ties to the smaller key). Exact: every
    block of vectors meets every other in a task of its own by matrix products, and each task keeps k for a file."""
    import numpy as np
    import pandas as pd

    rows = files.select(F.col(key).alias("k"), F.col(vector).alias("v")).where(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0))
    blocks = max(1, -(-rows.count() // block))
    own = rows.withColumn("own", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    left = own.select("k", "v", "own", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")).withColumn("side", F.lit(0))
    right = own.select("k", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("own"), F.col("own").alias("other")).withColumn("side", F.lit(1))

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1].sort_values("k")
        if not len(a) or not len(b):
            return pd.DataFrame({"k": a.k[:0], "n": a.k[:0], "s": []})
        x, y = (np.stack(f.v.to_list()).astype(float) for f in (a, b))
        x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
        s = x @ y.T
        names, to = a.k.to_numpy(), b.k.to_numpy()
        s[names[:, None] == to[None, :]] = -np.inf
        at = np.argsort(-np.round(s, 12), axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"k": np.repeat(names, at.shape[1]), "n": to[at].ravel(), "s": np.take_along_axis(s, at, 1).ravel()})
        return out[np.isfinite(out.s)]

    kind = files.schema[key].dataType.simpleString()
    near = left.unionByName(right).groupBy("own", "other").applyInPandas(top, f"k {kind}, n {kind}, s double")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc(F.round("s", 12)), "n"))).where(F.col("r") <= k)
    return best.select(F.least("k", "n").alias("a"), F.greatest("k", "n").alias("b")).distinct()


def densified(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """GRF-13: one more for each near pair, whether it had an edge or not."""
    return pairs.select("a", "b", F.col("w").cast("double").alias("w")).unionByName(near.select("a", "b", F.lit(1.0).alias("w"))).groupBy("a", "b").agg(F.sum("w").alias("w"))


def weighted_degrees(pairs: DataFrame) -> DataFrame:
    """GRF-14: a self-loop counts twice."""
    return pairs.select(F.col("a").alias("node"), "w").unionAll(pairs.select(F.col("b").alias("node"), "w")).groupBy("node").agg(F.sum("w").alias("degree"))


def modularity(pairs: DataFrame, partition: DataFrame) -> DataFrame:
    """GRF-21: of a partition (node, community); self-loops aren't in the numerator."""
    a, b = (partition.select(F.col("node").alias(k), F.col("community").alias(f"c{k}")) for k in "ab")
    inside = pairs.where("a <> b").join(a, "a").join(b, "b").where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("inside"))
    total = pairs.agg(F.sum("w").alias("m"))
    degrees = weighted_degrees(pairs).join(partition, "node").groupBy("community").agg(F.sum("degree").alias("d"))
    squares = degrees.agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("squares"))
    return inside.crossJoin(total).crossJoin(squares).select((F.col("inside") / F.col("m") - F.col("squares") / (4.0 * F.col("m") * F.col("m"))).alias("modularity"))  # one row each


def projection_modularity(edges: DataFrame, partition: DataFrame, least: int = C.entity_files_least, most: int = C.entity_files_most) -> DataFrame:
    """GRF-21 of the projection (GRF-12) without making its pairs: an entity of n files gives n (n - 1) / 2 to the weight,
    n - 1 to each file's degree, and to each community the pairs among its files. Rows are the edges', not their pairs'."""
    own = edges.select(F.col("from_path").alias("node"), F.col("to_path").alias("entity")).repartition("node").distinct()
    place = partition.where("node IS NOT NULL").repartition("node").groupBy("node", "community").agg(F.count("*").alias("m"))
    # a file counts once among its entity's files, however many communities it has
    place = place.withColumn("one", F.when(F.row_number().over(Window.partitionBy("node").orderBy("community")) == 1, 1).otherwise(0))
    rows = own.join(place, "node", "left").select("entity", "community", "m", F.coalesce("one", F.lit(1)).alias("one"), F.col("node").isNotNull().alias("named"))
    by = rows.where("entity IS NOT NULL").repartition("entity").groupBy("entity", "community").agg(F.sum("one").alias("every"), F.sum(F.when(F.col("named"), F.col("one"))).alias("files"), F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    whole = Window.partitionBy("entity")
    by = by.withColumn("every", F.sum("every").over(whole)).withColumn("n", F.sum("files").over(whole)).withColumn("first", F.row_number().over(whole.orderBy("community")) == 1).where(F.col("every").between(least, most))
    pairs = (F.col("m") * F.col("m") - F.col("mm")) / 2
    sums = by.groupBy("community").agg(
        F.sum(F.when(F.col("first"), F.col("n") * (F.col("n") - 1) / 2)).alias("m"),
        F.sum(F.when(F.col("community").isNotNull(), pairs)).alias("inside"),
        F.sum((F.col("n") - 1) * F.col("m")).alias("d"),
    )
    return sums.agg(F.nullif(F.sum("m"), F.lit(0.0)).alias("m"), F.coalesce(F.sum("inside"), F.lit(0.0)).alias("inside"), F.sum(F.col("d").cast("double") * F.col("d")).alias("squares")).select((F.col("inside") / F.col("m") - F.col("squares") / (4.0 * F.col("m") * F.col("m"))).alias("modularity"))


def dense_ids(partition: DataFrame) -> DataFrame:
    """GRF-20: communities numbered by size, then old id."""
    sizes = partition.groupBy("community").agg(F.count("*").alias("n"))
    ids = sizes.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "community")) - 1)
    return partition.join(ids, "community").select("node", F.col("id").alias("community"))


def hubs(edges: DataFrame, quantile: float = C.hub_quantile) -> DataFrame:
    """GRF-22: entities in strictly more files than the one at floor((n - 1) * quantile) of the sorted degrees. Degrees
    are counted by value first, so the sort is over distinct degrees."""
    degree = edges.select("from_path", "to_path").distinct().groupBy("to_path").agg(F.count("*").alias("degree"))
    by_value = degree.groupBy("degree").agg(F.count("*").alias("n"))
    upto = by_value.withColumn("upto", F.sum("n").over(Window.orderBy("degree"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    limit = upto.where(F.col("upto") > F.floor((F.col("total") - 1) * quantile)).agg(F.min("degree").alias("limit"))
    return degree.crossJoin(F.broadcast(limit)).where("degree > limit").select("to_path", "degree")  # one row


def god_nodes(edges: DataFrame, communities: DataFrame, hub: DataFrame, top: int = C.god_nodes, tiers: DataFrame | None = None) -> DataFrame:
    """GRF-23: each community's first entities that are no hubs, by degree inside (by tier first, if tiers are given)."""
    own = edges.select(F.col("from_path").alias("file_path"), "to_path").distinct().join(communities.select("file_path", "community_id"), "file_path")
    count = own.groupBy("community_id", "to_path").agg(F.count("*").alias("degree")).join(hub.select("to_path"), "to_path", "left_anti")
    count = count.join(tiers, "to_path", "left").withColumn("tier", F.coalesce("tier", F.lit(2))) if tiers is not None else count.withColumn("tier", F.lit(0))
    order = Window.partitionBy("community_id").orderBy("tier", F.desc("degree"), "to_path")
    return count.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top).select("community_id", F.col("to_path").alias("entity_path"), "rank", "degree")


def tier(kind: Column) -> Column:
    """GRF-23."""
    return F.when(kind.isin("Concept", "Organization", "Project"), 0).when(kind.isin("Task", "Decision"), 1).otherwise(2)


def topic_listing(communities: DataFrame, gods: DataFrame, topics: int = 30, files: int = 25) -> DataFrame:
    """GRF-28: the largest communities as folders of their first files; a label or a file name that is taken gets a
    number."""
    sizes = communities.groupBy("community_id").agg(F.count("*").alias("n"))
    label = gods.where("rank = 0").select("community_id", paths.slug_of(F.col("entity_path")).alias("label"))
    top = sizes.orderBy(F.desc("n"), "community_id").limit(topics).join(label, "community_id", "left").withColumn("label", F.coalesce("label", F.concat(F.lit("topic-"), F.col("community_id").cast("string"))))
    again = F.row_number().over(Window.partitionBy("label").orderBy("community_id"))
    top = top.withColumn("topic", F.when(again == 1, F.col("label")).otherwise(F.concat("label", F.lit("-"), F.col("community_id").cast("string"))))
    own = communities.join(F.broadcast(top.select("community_id", "topic")), "community_id").withColumn("r", F.row_number().over(Window.partitionBy("community_id").orderBy("file_path"))).where(F.col("r") <= files)
    own = own.withColumn("base", paths.base_name(F.col("file_path")))
    number = F.row_number().over(Window.partitionBy("community_id", "base").orderBy("file_path")) - 1
    stem, ext = F.regexp_extract("base", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("base", r"(\.[^.]*)$", 1)
    return own.select("topic", F.when(number == 0, F.col("base")).otherwise(F.concat(stem, F.lit("-"), number.cast("string"), ext)).alias("name"), "file_path")


def clean_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """GRF-30: ends trimmed, not empty, different, and both known."""
    own = relations.withColumn("source", F.trim("source")).withColumn("target", F.trim("target")).where("source <> '' AND target <> '' AND source <> target")
    names = entities.select(F.col("name"))
    return own.join(names.withColumnRenamed("name", "source"), "source", "left_semi").join(names.withColumnRenamed("name", "target"), "target", "left_semi")


def replaced_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """GRF-31: the files of `new` get its edges instead of theirs; one for each key."""
    kept = edges.join(new.select("from_path").distinct(), "from_path", "left_anti")
    return kept.unionByName(new.dropDuplicates(["from_path", "to_path", "edge_kind"]))


def upserted_entities(entities: DataFrame, new: DataFrame) -> DataFrame:
    """GRF-31: the last writer (seq) of an entity wins."""
    every = entities.unionByName(new)
    rest = [c for c in every.columns if c not in ("path", "seq")]
    return every.groupBy("path").agg(F.max_by(F.struct(*rest), "seq").alias("x"), F.max("seq").alias("seq")).select("path", "x.*", "seq")


def enclosing(definitions: DataFrame, spots: DataFrame, span: int = 256) -> DataFrame:
    """GRF-33, JOI-09: the narrowest definition (file, name, start, end) strictly around each spot (file, id, start, end).
    A range join by buckets of lines: a definition is entered in each bucket it spans."""
    d = definitions.select("file", F.col("name").alias("parent"), F.col("start").alias("d0"), F.col("end").alias("d1"), F.explode(F.sequence(F.floor(F.col("start") / span), F.floor(F.col("end") / span))).alias("bucket"))
    s = spots.withColumn("bucket", F.floor(F.col("start") / span))
    inside = (F.col("d0") <= F.col("start")) & (F.col("d1") >= F.col("end")) & ((F.col("d0") < F.col("start")) | (F.col("d1") > F.col("end")))
    found = s.join(d, ["file", "bucket"]).where(inside).groupBy("file", "id").agg(F.min_by("parent", F.struct(F.col("d1") - F.col("d0"), "d0", "parent")).alias("parent"))
    return spots.select("file", "id").join(found, ["file", "id"], "left")


def resolved(references: DataFrame, symbols: DataFrame, block: int = 56) -> DataFrame:
    """GRF-34: references (source, name, kind) to symbols (path, name, kind) of the same simple name and a fitting kind.
    Symbols are joined in blocks, and each block meets all sources before the next: a written column then repeats the same
    few targets, and the file takes a small part of the space that it takes with all targets of a source in a row."""
    callable_, type_ = ("function", "method"), ("class", "interface", "struct", "enum", "trait")
    class_of = F.when(F.col("kind").isin(*callable_), "calls").when(F.col("kind").isin(*type_), "types")
    wanted = F.when(F.col("kind") == "calls", "calls").when(F.col("kind").isin("inherits", "uses"), "types")
    r = references.select("source", paths.last_ident(F.col("name")).alias("simple"), wanted.alias("fits"), F.col("kind").alias("relation")).where("fits IS NOT NULL").distinct()
    s = symbols.select(F.col("path").alias("target"), paths.last_ident(F.col("name")).alias("simple"), class_of.alias("fits")).where("fits IS NOT NULL").distinct()
    # a pair comes twice only by two names: of those symbols alone the pairs are made distinct, the others' aren't moved
    names = s.where("target IS NOT NULL").groupBy("target", "fits").agg(F.count("*").alias("names"))
    s = s.join(names, ["target", "fits"])
    place = F.row_number().over(Window.partitionBy("simple", "fits").orderBy("target"))
    blocks = s.where("names = 1").withColumn("block", F.floor((place - 1) / block)).groupBy("simple", "fits", "block").agg(F.collect_list("target").alias("targets"))
    # by merge, whatever the sizes: its left side is the outer loop
    found = blocks.hint("merge").join(r, ["simple", "fits"]).select("source", F.explode("targets").alias("target"), "relation")
    several = r.join(s.where("names > 1"), ["simple", "fits"]).select("source", "target", "relation").distinct()
    found = found.unionByName(several).where(F.col("source") != F.col("target"))
    strong = F.col("relation") == "inherits"
    return found.withColumn("confidence", F.when(strong, "EXTRACTED").otherwise("INFERRED")).withColumn("confidence_score", F.when(strong, 1.0).otherwise(0.8))


def build_lane(path: Column, has_source: Column) -> Column:
    """GRF-36: code with a source on disk is parsed, anything else read by a model."""
    return F.when((paths.file_type(path) == "code") & has_source, "ast").otherwise("llm")


def report(edges: DataFrame, relations: DataFrame, entities: DataFrame, surprising: tuple[str, ...] = ("contradicts", "supersedes", "depends_on", "causes"), top: int = 12) -> DataFrame:
    """GRF-27: (section, key, value) rows: most connected entities, relations by type, surprising ones, isolated entities
    and the ambiguous share."""
    degree = edges.groupBy("to_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "to_path").limit(top).select(F.lit("degree").alias("section"), F.col("to_path").alias("key"), F.col("n").cast("double").alias("value"))
    kinds = relations.groupBy("relation").agg(F.count("*").alias("n")).select(F.lit("relations"), "relation", F.col("n").cast("double"))
    odd = relations.where(F.col("relation").isin(*surprising)).orderBy(F.desc("confidence_score"), "source", "target").limit(10).select(F.lit("surprising"), F.concat_ws(" -> ", "source", "target"), F.col("confidence_score").cast("double"))
    alone = entities.join(edges.select(F.col("to_path").alias("path")).distinct(), "path", "left_anti").agg(F.count("*").cast("double").alias("n")).select(F.lit("isolated"), F.lit("entities"), "n")
    unsure = relations.agg((100.0 * F.count_if(F.col("confidence") == "AMBIGUOUS") / F.greatest(F.count("*"), F.lit(1))).alias("n")).select(F.lit("ambiguous"), F.lit("percent"), "n")
    return degree.union(kinds).union(odd).union(alone).union(unsure)


def graph_json(edges: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """GRF-26, SNK-03: one JSON row: sorted nodes, edges and relations, with counts and confidences. It is an artefact
    for one workspace; larger graphs are written as tables."""
    def gathered(df: DataFrame, cols: list[str], name: str) -> DataFrame:
        return df.agg(F.sort_array(F.collect_set(F.struct(*cols))).alias(name))

    stats = edges.agg(F.count_distinct("from_path").alias("files"), F.count("*").alias("edges"))
    confidence = edges.groupBy("confidence").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("confidence", "n")))).alias("confidence"))
    size = entities.agg(F.count("*").alias("entities"))
    parts = gathered(entities, ["path", "name", "kind"], "nodes").crossJoin(gathered(edges, ["from_path", "to_path", "edge_kind"], "links")).crossJoin(gathered(relations, ["source", "target", "relation"], "relations"))
    one = parts.crossJoin(stats).crossJoin(size).crossJoin(confidence)  # one row each
    return one.select(F.to_json(F.struct("nodes", "links", "relations", F.struct("files", "entities", "edges", "confidence").alias("stats"))).alias("json"))


def digest(files: DataFrame, communities: DataFrame, gods: DataFrame, samples: int = 4, dirs: int = 20) -> DataFrame:
    """GRF-25, SNK-03: (line_no, line): topics with sample files, then the directory map."""
    own = communities.withColumn("r", F.row_number().over(Window.partitionBy("community_id").orderBy("file_path"))).withColumn("n", F.count("*").over(Window.partitionBy("community_id")))
    text = own.where(F.col("r") <= samples).groupBy("community_id", "n").agg(F.array_join(F.sort_array(F.collect_list("file_path")), ", ").alias("files"))
    label = gods.where("rank = 0").select("community_id", paths.slug_of(F.col("entity_path")).alias("label"))
    topics = text.join(label, "community_id", "left").select(F.lit(0).alias("part"), F.col("community_id").cast("long").alias("o"), F.concat(F.lit("- "), F.coalesce("label", F.lit("topic")), F.lit(": "), "files", F.when(F.col("n") > samples, F.concat(F.lit(" +"), (F.col("n") - samples).cast("string"), F.lit(" more"))).otherwise("")).alias("line"))
    folders = directory_map(files, dirs).select(F.lit(1).alias("part"), (-F.col("files")).alias("o"), F.format_string("- %s (%d)", "dir", "files").alias("line"))
    return topics.union(folders).withColumn("line_no", F.row_number().over(Window.orderBy("part", "o", "line"))).select("line_no", "line")


def directory_map(files: DataFrame, most: int = 20) -> DataFrame:
    """AGG-08."""
    return files.groupBy(paths.top_dir(F.col("filepath")).alias("dir")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "dir").limit(most)
