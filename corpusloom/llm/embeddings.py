"""Near-duplicate embeddings by sorted projection passes.

Only vectors of one label are compared; a vector that is null, zero or empty, or holds a null, NaN or infinity, or has
no label, links with nothing. Vectors of other lengths aren't comparable. Equal vectors are one class, pre-aggregated
to the least id and a count.

Each pass gives a class representative a code of 64 concatenated random hashes (the signs of products with random
directions, of the vector less the mean of its label's unit vectors: vectors that share a direction, as text embeddings
do, all have like signs otherwise) and sorts label, pass and code lexicographically over the cluster; every vector is
compared, in double precision, with the `window` next ones. Verified pairs are united within a task and, across passes,
as components, so what leaves a task grows with its rows. With a background cosine c (the mean over the label's pairs), a
pair at the threshold t has about cosine (t - c) / (1 - c) from the mean, by which two vectors agree on a hash with
probability p (0.88 for t = 0.93, c = 0), so they share the first hashes that tell `window` neighbours apart from the
rest, log2(classes of the label / window) of them, in a share of the passes that falls with the label's size. Each
label has as many passes as find a pair at the threshold without other links with probability `recall`; 20 at least.
Without a given window it is doubled, up to 512, while a label would need over 40 passes. The window goes on over the
ends of the sorted partitions. recall_of() measures recall for sampled queries against all vectors of their label.

An exact check follows, which gives each class its number of links; no pair is emitted. A component's members lie in
blocks of `block` neighbours by code, a row for each block with its centre and the largest angle from it. By these most
pairs of blocks are decided as a whole: all linked, or none. Only blocks of the other pairs meet in a task and are
compared vector by vector. Rows are as many as blocks and pairs of blocks (for 8,000 members of one component 32 and
528); the comparisons of a component that no bound decides grow with the square of its size.

Edge cases: an empty table gives an empty result; repeated rows count as links of one another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, least_labels, saved, whole_groups


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    return _unit(column.flatten().to_numpy(False).astype(np.float64).reshape(-1, dim))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _codes(x: np.ndarray, passes: int, seed: int) -> np.ndarray:
    """A 64-bit code of signs for each vector and pass, as signed numbers in the order of their bits."""
    directions = np.random.default_rng(seed).standard_normal((x.shape[1], passes * 64))
    bits = np.packbits((x @ directions > 0).reshape(len(x), passes, 64), axis=2)
    return (bits.view(">u8")[..., 0].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def classes_of(df: DataFrame, vec_id: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, label, k1, k2; keys null if the row can't link) and classes (label, k1, k2, first, copies, v)."""
    v = F.col(vector)
    good = F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = F.coalesce(good, F.lit(False))
    rows = df.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.when(good, F.xxhash64(v)).alias("k1"), F.when(good, F.xxhash64(F.lit("k2"), F.size(v), v)).alias("k2"), F.when(good, v).alias("v"))
    classes = rows.where("k1 IS NOT NULL AND id IS NOT NULL").groupBy("label", "k1", "k2").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("v").alias("v"))
    return rows.drop("v"), classes


def passes_for(classes: int, threshold: float, window: int, recall: float, least: int = 20, background: float = 0.0) -> int:
    """Passes by which a pair at the threshold in a label of so many classes is found with probability recall. background:
    the mean cosine of the label's pairs."""
    inner = (threshold - background) / max(1 - background, 1e-9)
    agree = 1 - math.acos(min(max(inner, -1.0), 1.0)) / math.pi
    one = agree ** max(0.0, math.log2(max(classes, 1) / window))
    return least if one >= 1 else max(least, math.ceil(math.log(1 - recall) / math.log1p(-one)))


def passes_column(threshold: float, window: int, recall: float, least: int = 20):
    """passes_for() of the columns n and background, 400 at most where no number of passes would do (a label whose
    background is about the threshold)."""
    inner = (F.lit(threshold) - F.col("background")) / F.greatest(1 - F.col("background"), F.lit(1e-9))
    agree = 1 - F.acos(F.least(F.greatest(inner, F.lit(-1.0)), F.lit(1.0))) / math.pi
    one = F.pow(agree, F.greatest(F.lit(0.0), F.log2(F.col("n") / window)))
    needed = F.ceil(F.lit(math.log(1 - recall)) / F.log1p(-F.least(one, F.lit(1 - 1e-12))))
    return F.least(F.greatest(needed, F.lit(least)), F.lit(400)).cast("int")


def label_means(classes: DataFrame) -> DataFrame:
    """(label, dim, n, mean, background) of the unit vectors of each label and length, summed up before they move."""
    schema = T.StructType([classes.schema["label"], T.StructField("dim", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.DoubleType()))])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("label").dictionary_encode()
            code, size = np.asarray(found.indices), np.asarray(batch.column("v").value_lengths())
            for dim in np.unique(size).tolist():
                own = np.flatnonzero(size == dim)
                x = _matrix(batch.column("v").take(pa.array(own)), dim)
                labels, inverse = np.unique(code[own], return_inverse=True)
                totals = np.zeros((len(labels), dim))
                np.add.at(totals, inverse, x)
                yield pa.RecordBatch.from_arrays([found.dictionary.take(pa.array(labels)), pa.array(np.full(len(labels), dim, np.int32)), pa.array(np.bincount(inverse).astype(np.int64)), pa.array(list(totals), pa.list_(pa.float64()))], names=schema.names)

    parts = classes.select("label", "v").mapInArrow(summed, schema)
    # the sizes come with the first component, so that they are counted once
    sums = parts.select("label", "dim", "n", F.posexplode("total").alias("pos", "x")).groupBy("label", "dim", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    means = sums.groupBy("label", "dim").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", (F.col("x") / F.col("n")).alias("m")))).alias("m"))
    return means.select("label", "dim", "n", F.col("m.m").alias("mean"), F.aggregate("m.m", F.lit(0.0), lambda t, x: t + x * x).alias("background"))


def found_links(classes: DataFrame, threshold: float, window: int, seed: int) -> DataFrame:
    """(a, b) of representatives, united within each task: as components, the verified pairs of all passes. classes have
    their label's mean and its number of passes."""
    kind, element = classes.schema["first"].dataType, classes.schema["v"].dataType
    label = classes.schema["label"]
    coded = T.StructType([label, T.StructField("dim", T.IntegerType()), T.StructField("pass", T.IntegerType()), T.StructField("code", T.LongType()), T.StructField("first", kind), T.StructField("v", element)])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                size = np.asarray(batch.column("v").value_lengths())
                for dim in np.unique(size).tolist():
                    part = batch.filter(pa.array(size == dim))
                    label = part.column("label").dictionary_encode().indices.to_numpy(False)
                    for code in np.unique(label).tolist():
                        own = part.filter(pa.array(label == code))
                        passes = own.column("passes")[0].as_py()
                        codes = _codes(_matrix(own.column("v"), dim) - np.asarray(own.column("mean")[0].as_py()), passes, seed)
                        at = pa.array(np.repeat(np.arange(own.num_rows), passes))
                        yield pa.RecordBatch.from_arrays([own.column("label").take(at), pa.array(np.full(len(at), dim, np.int32)), pa.array(np.tile(np.arange(passes, dtype=np.int32), own.num_rows)), pa.array(codes.ravel()), own.column("first").take(at), own.column("v").take(at)], names=coded.names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = pa.Table.from_batches([batch.slice(i, 4096)])
                part = (pa.concat_tables([tail, part]) if tail is not None else part).combine_chunks()
                tail = part.slice(max(0, part.num_rows - window))
                get = lambda c, part=part: part.column(c).combine_chunks() if part.column(c).num_chunks != 1 else part.column(c).chunk(0)
                dims, run = get("dim").to_numpy(), get("pass").to_numpy()
                group = get("label").dictionary_encode().indices.to_numpy(False)
                first, vectors = get("first"), get("v")
                for dim in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == dim)
                    x = _matrix(vectors.take(pa.array(at)), dim)
                    a, b = [], []
                    for t in range(1, min(window, len(at) - 1) + 1):
                        near = (np.einsum("ij,ij->i", x[:-t], x[t:]) >= threshold) & (run[at[:-t]] == run[at[t:]]) & (group[at[:-t]] == group[at[t:]])
                        a.append(np.flatnonzero(near))
                        b.append(a[-1] + t)
                    if a:
                        low = least_labels(np.concatenate(a), np.concatenate(b), len(at))
                        own = np.flatnonzero(low < np.arange(len(at)))
                        if len(own):
                            yield pa.RecordBatch.from_arrays([first.take(pa.array(at[own])), first.take(pa.array(at[low[own]]))], names=["a", "b"])

    all_passes = saved(classes.select("label", "first", "v", "mean", "passes").mapInArrow(code, coded), "passes")
    order = ["label", "dim", "pass", "code", "first"]
    links = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    ends = T.StructType([*links, *coded, *(T.StructField(c, T.IntegerType()) for c in ("part", "head", "tail"))])

    def with_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links, and the first and last rows of the partition with their places counted from its start and its end."""
        head, tail, n = [], [], 0

        def watched():
            nonlocal n, tail
            for batch in batches:
                if batch.num_rows:
                    if n < window:
                        head.append(batch.slice(0, window - n))
                    n += batch.num_rows
                    tail = pa.Table.from_batches([*tail, batch.slice(max(0, batch.num_rows - window))])
                    tail = tail.slice(max(0, tail.num_rows - window)).to_batches()
                yield batch

        def filled(columns: dict, size: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, types[c]) for c in ends.names], names=ends.names)

        types = {}
        for found in compare(watched()):
            types = types or {c: found.schema.field(c).type if c in links.names else t for c, t in [*((c, None) for c in links.names), *zip(coded.names, head[0].schema.types, strict=True), *((c, pa.int32()) for c in ("part", "head", "tail"))]}
            yield filled({c: found.column(c) for c in links.names}, found.num_rows)
        if not n:
            return
        types = types or {**{c: head[0].schema.field("first").type for c in links.names}, **dict(zip(coded.names, head[0].schema.types, strict=True)), **{c: pa.int32() for c in ("part", "head", "tail")}}
        part = TaskContext.get().partitionId()
        for held, side in ((head, "head"), (tail, "tail")):
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            at = np.arange(rows.num_rows, dtype=np.int32)
            place = at if side == "head" else at[::-1].copy()
            yield filled({**{c: rows.column(c) for c in coded.names}, "part": pa.array(np.full(rows.num_rows, part, np.int32)), side: pa.array(place)}, rows.num_rows)

    ordered = all_passes.repartitionByRange(*order).sortWithinPartitions(*order)
    told = saved(ordered.mapInArrow(with_ends, ends), "ends")
    # a partition's end meets the starts of those after it that lie in its window: the next one, and more behind short ones
    sizes = [(r.part, r.n) for r in told.where("head IS NOT NULL").groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()]  # one row a partition
    meets = []
    for i, (part, _) in enumerate(sizes):
        ahead = 0
        for after, n in sizes[i + 1 :]:
            if ahead >= window:
                break
            meets.append((part, after))
            ahead += n
    inside = told.where("part IS NULL").select("a", "b")
    if not meets:
        return inside
    pairs = told.sparkSession.createDataFrame(meets, "bound int, part int")
    starts = told.where("head IS NOT NULL").join(F.broadcast(pairs), "part").select("bound", *order, "v")
    stops = told.where("tail IS NOT NULL").select(F.col("part").alias("bound"), *order, "v")
    over = stops.unionByName(starts).repartition("bound").sortWithinPartitions("bound", *order)
    return inside.unionByName(over.select(*coded.names).mapInArrow(compare, links))


def exact_counts(members: DataFrame, threshold: float, block: int, seed: int = 11) -> DataFrame:
    """(first, linked): for each of members (component, first, copies, v) the copies in other classes of its component
    that reach the threshold."""
    kind, element = members.schema["first"].dataType, members.schema["v"].dataType.elementType
    raw = "<f4" if isinstance(element, T.FloatType) else "<f8"
    limit, sure = math.acos(min(max(threshold, -1.0), 1.0)), 1e-6
    fields = [T.StructField("component", members.schema["component"].dataType), T.StructField("block", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("firsts", T.ArrayType(kind)), T.StructField("copies", T.ArrayType(T.LongType())), T.StructField("v", T.BinaryType()), T.StructField("centre", T.ArrayType(T.DoubleType())), T.StructField("radius", T.DoubleType())]
    blocked = T.StructType(fields)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The place of each member in its component's order."""
        for batch in batches:
            size = np.asarray(batch.column("v").value_lengths())
            code = np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(size).tolist():
                own = size == dim
                code[own] = _codes(_matrix(batch.column("v").filter(pa.array(own)), dim), 1, seed).ravel()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], names=[*batch.schema.names, "code"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for rows, bounds in whole_groups(batches, ["component"]):
            first, copies, vectors, component = (rows.column(c).combine_chunks() for c in ("first", "copies", "v", "component"))
            for i, j in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                dim = len(vectors[i])
                for a in range(i, j, block):
                    n = min(block, j - a)
                    own = vectors.slice(a, n)
                    x = _matrix(own, dim)
                    centre = x.sum(0)
                    centre = centre / (np.sqrt(centre @ centre) or 1.0)
                    radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
                    numbers = own.flatten().to_numpy(False).astype(raw).tobytes()
                    yield pa.RecordBatch.from_arrays([component.slice(a, 1), pa.array([number], pa.int64()), pa.array([dim], pa.int32()), pa.array([first.slice(a, n).to_pylist()], pa.list_(first.type)), pa.array([copies.slice(a, n).to_pylist()], pa.list_(pa.int64())), pa.array([numbers], pa.binary()), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius])], names=blocked.names)
                    number += 1

    coded = T.StructType([*members.select("component", "first", "copies", "v").schema.fields, T.StructField("code", T.LongType())])
    order = ["component", "code", "first"]
    blocks = members.select("component", "first", "copies", "v").mapInArrow(placed, coded).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = saved(blocks.mapInArrow(cut, blocked), "blocks")
    heads = blocks.select("component", "block", "centre", "radius", F.aggregate("copies", F.lit(0).cast("long"), lambda t, x: t + x).alias("total"))
    one, two = (heads.select("component", *(F.col(c).alias(c + k) for c in ("block", "centre", "radius", "total"))) for k in "ab")
    angle = F.acos(F.least(F.greatest(F.aggregate(F.zip_with("centrea", "centreb", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x), F.lit(-1.0)), F.lit(1.0)))
    pairs = one.join(two, "component").where("blocka <= blockb").withColumn("angle", F.when(F.col("blocka") == F.col("blockb"), 0.0).otherwise(angle))
    reach = F.col("radiusa") + F.col("radiusb")
    pairs = saved(pairs.where(F.col("angle") - reach <= limit + sure).select("blocka", "blockb", "totala", "totalb", (F.col("angle") + reach <= limit - sure).alias("all")), "block-pairs")
    # a block whose vectors all link with another's has its copies; with its own, those but each one's
    whole = pairs.where("all")
    whole = whole.select(F.col("blocka").alias("block"), F.col("totalb").alias("n"), (F.col("blocka") == F.col("blockb")).cast("long").alias("own")).union(whole.where("blocka < blockb").select("blockb", "totala", F.lit(0).cast("long")))
    whole = whole.groupBy("block").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
    side = lambda k: blocks.select(*(F.col(c).alias(c + k) for c in ("block", "dim", "copies", "v")))
    meet = pairs.where("NOT all").select("blocka", "blockb").join(side("a"), "blocka").join(side("b"), "blockb")
    counts = T.StructType([T.StructField("block", T.LongType()), T.StructField("linked", T.ArrayType(T.LongType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, dim, ca, cb, va, vb in zip(*(batch.column(c) for c in ("blocka", "blockb", "dima", "copiesa", "copiesb", "va", "vb")), strict=True):
                left, right = (_unit(np.frombuffer(v.as_py(), raw).astype(np.float64).reshape(-1, dim.as_py())) for v in (va, vb))
                near = left @ right.T >= threshold
                if a.as_py() == b.as_py():
                    np.fill_diagonal(near, False)
                else:
                    out.append((b.as_py(), np.asarray(ca.values) @ near))
                out.append((a.as_py(), near @ np.asarray(cb.values)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int64()))], names=counts.names)

    found = meet.mapInArrow(count, counts).select("block", F.posexplode("linked").alias("pos", "linked")).groupBy("block", "pos").agg(F.sum("linked").alias("linked"))
    every = blocks.select("block", F.posexplode(F.arrays_zip("firsts", "copies")).alias("pos", "m")).select("block", "pos", F.col("m.firsts").alias("first"), F.col("m.copies").alias("copies"))
    told = every.join(whole, "block", "left").join(found, ["block", "pos"], "left")
    return told.select("first", (F.coalesce("linked", F.lit(0)) + F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(0)) * F.col("copies")).alias("linked"))


def recall_of(df: DataFrame, result: DataFrame, queries: Column | str, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93) -> float:
    """The share of links of the vectors that `queries` (a condition) picks, by brute force against all vectors of their
    label, whose ends are in one component of result. The picked vectors, a stated set, are broadcast."""
    good = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull())
    unit = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    own, rest = (x.select(F.col(label).alias("l"), F.col(vec_id).alias("id" + k), F.col(vector).alias("v" + k)) for x, k in ((good.where(queries), "a"), (good, "b")))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    links = rest.join(F.broadcast(own), "l").where("ida <> idb").where(dot >= threshold * unit(F.col("va")) * unit(F.col("vb")))
    of = lambda k: result.select(F.col(vec_id).alias("id" + k), F.col("component_id").alias("c" + k))
    row = links.join(of("a"), "ida").join(of("b"), "idb").agg(F.count("*").alias("n"), F.count_if(F.col("ca") == F.col("cb")).alias("k")).first()
    return row["k"] / row["n"] if row["n"] else 1.0


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, passes: int | None = None, window: int | None = None, block: int = 256, seed: int = 11, recall: float = 0.999) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row. Without a number of passes it follows from recall, and without
    a window (32 to 512) that does too."""
    rows, classes = classes_of(df, vec_id, vector, label)
    rows, classes = saved(rows, "vectors"), saved(classes, "classes")
    means = saved(label_means(classes), "means")
    if window is None:
        widths = (32, 64, 128, 256, 512)
        most = means.agg(*(F.max(passes_column(threshold, w, recall)).alias(f"w{w}") for w in widths)).first()  # five numbers
        window = next((w for w in widths if (most[f"w{w}"] or 0) <= 40), widths[-1])
    means = means.withColumn("passes", F.lit(passes).cast("int") if passes else passes_column(threshold, window, recall))
    coded = classes.withColumn("dim", F.size("v")).join(means.select("label", "dim", "mean", "passes"), ["label", "dim"])
    found = saved(components(found_links(coded, threshold, window, seed)), "components")
    members = classes.join(found, F.col("first") == F.col("node")).select("component", "first", "copies", "v")
    counts = exact_counts(members, threshold, block, seed)
    told = classes.select("label", "k1", "k2", "first", "copies").join(found, F.col("first") == F.col("node"), "left").join(counts, "first", "left")
    told = told.select("label", "k1", "k2", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    joined = rows.join(told, ["label", "k1", "k2"], "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
