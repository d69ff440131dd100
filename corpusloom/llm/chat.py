"""Chat formatting over a prefix tree.

A turn is `<turn ROLE>TEXT</turn>`; inside role and text `\\`, `<` and `>` get a `\\` before them, so a bare `<` is always
the template's and the text comes back by dropping each `\\` before the character it guards. Header, text and footer are
encoded apart, so the loss mask (texts of assistants) ends at token ends.

Conversations that share their first turns share nodes: a node is known by a hash chained over role and text of the
turns so far. Equal conversations are one leaf (pre-aggregated). Leaves are range-sorted by their path, the hashes from
the root on; a parent's path begins its children's, so this is depth-first order, and a leaf emits just the nodes that
it doesn't share with the leaf before it. Across partitions that is the last path of the partition before: one row a
partition goes round. Each node is emitted once, with its start in the stream, position ids that go on from its
parent's, and the intervals of the stream that it may attend to: its ancestors', joined to as few as touch.

Reading back goes the way a model would: a conversation is what its last node attends to, and that node, laid out by the
position ids, which have to be gapless.

Edge cases: a null text or role is empty; repeated rows of a turn are all kept, ordered by role and text; each row with
a null conv_id is a conversation of its own; an empty table has no nodes; extra columns take no part. A conversation, being
one sequence, is laid out by one task; no group of conversations is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_level
from .common import saved, whole_groups

HEAD, MIDDLE, FOOT = "<turn ", ">", "</turn>"
_GUARD, _BACK = regex.compile(r"[\\<>]"), regex.compile(r"\\(.)", regex.DOTALL)
_TURN = regex.compile(r"<turn ((?:[^\\<>]|\\.)*+)>((?:[^\\<>]|\\.)*+)</turn>", regex.DOTALL)
NODE = 16


def guard(text: str) -> str:
    return _GUARD.sub(r"\\\g<0>", text)


def unguard(text: str) -> str:
    return _BACK.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    found, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"not a turn at {at}")
        found.append((unguard(m[1]), unguard(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a turn at {at}")
    return found


def chained(turns: list[tuple[str, str]]) -> list[bytes]:
    """The node of each turn."""
    out, h = [], b""
    for role, text in turns:
        a, b = role.encode(), text.encode()
        h = hashlib.blake2b(h + len(a).to_bytes(8, "little") + a + b, digest_size=NODE).digest()
        out.append(h)
    return out


def paths(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, leaf, path (nodes side by side), turns (role and text)."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    alone = F.when(F.col(conv_id).isNull(), F.monotonically_increasing_id())
    grouped = conversations.select(F.col(conv_id).alias("conv_id"), alone.alias("alone"), one.alias("one")).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("one")).alias("turns")).drop("alone")
    turns = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    schema = T.StructType([T.StructField("conv_id", conversations.schema[conv_id].dataType), T.StructField("leaf", T.BinaryType()), T.StructField("path", T.BinaryType()), T.StructField("turns", turns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[(t["role"], t["text"]) for t in c] for c in batch.column("turns").to_pylist()]
            nodes = [chained(r) for r in rows]
            told = pa.array([[{"role": a, "text": b} for a, b in r] for r in rows], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([n[-1] for n in nodes], pa.binary()), pa.array([b"".join(n) for n in nodes], pa.binary()), told], names=schema.names)

    return grouped.mapInArrow(run, schema)


def format_tree(conversations: DataFrame, tokenizer: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """nodes (node, depth, start, length, position, attends_to, ids, loss) and conversations (conv_id, leaf, path).

    ids and loss are binary: little-endian unsigned 32-bit ids, and a byte for each, 1 under the loss. position is the
    first token's position id. attends_to has [start, end) intervals of the stream, of the ancestors; within a node
    attention is causal."""
    every = saved(paths(conversations, conv_id, turn, role, text), "paths")
    leaves = every.groupBy("leaf").agg(F.first("path").alias("path"), F.first("turns").alias("turns"))
    ordered = saved(leaves.repartitionByRange("path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id()), "leaves")
    ends = ordered.groupBy("part").agg(F.max("path").alias("end"))
    before = ends.select("part", F.lag("end").over(Window.orderBy("part")).alias("end"))  # a row for each partition
    by_path = Window.partitionBy("part").orderBy("path")
    with_last = ordered.withColumn("last", F.lag("path").over(by_path)).join(F.broadcast(before), "part")
    with_last = with_last.withColumn("last", F.coalesce("last", "end", F.lit(b"")))
    schema = T.StructType([*(T.StructField(c, T.BinaryType()) for c in ("leaf", "node")), *(T.StructField(c, T.IntegerType()) for c in ("part", "shared", "depth")), T.StructField("offset", T.LongType()), T.StructField("within", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("loss", T.BinaryType())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, at_part, within = byte_level(tokenizer), None, 0  # a partition's rows come in one task, in order
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                rows, strings = [], []
                for leaf, path, last, part, turns in zip(*(batch.column(c).to_pylist() for c in ("leaf", "path", "last", "part", "turns")), strict=True):
                    shared = next((i for i in range(len(path) // NODE) if path[i * NODE : i * NODE + NODE] != last[i * NODE : i * NODE + NODE]), len(path) // NODE)
                    for i in range(shared, len(turns)):
                        t = turns[i]
                        rows.append((leaf, path[i * NODE : (i + 1) * NODE], part, shared, i, t["role"] == "assistant"))
                        strings += [HEAD + guard(t["role"]) + MIDDLE, guard(t["text"]), FOOT]
                if not rows:
                    continue
                ids, bounds = coder.encode(pa.array(strings, pa.large_string()))
                out, offset, leaf = [], 0, None
                for n, (own, node, part, shared, depth, said) in enumerate(rows):
                    a, b, c, d = bounds[3 * n : 3 * n + 4].tolist()
                    offset = 0 if own != leaf else offset
                    leaf = own
                    within = 0 if part != at_part else within
                    at_part = part
                    out.append((own, node, part, shared, depth, offset, within, d - a, ids[a:d].astype("<u4").tobytes(), bytes(b - a) + (b"\1" if said else b"\0") * (c - b) + bytes(d - c)))
                    offset += d - a
                    within += d - a
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(),) * 2 + (pa.int32(),) * 3 + (pa.int64(),) * 3 + (pa.binary(),) * 2, strict=True)], names=schema.names)

    emitted = saved(with_last.mapInArrow(emit, schema), "nodes")
    # starts: places in a partition, and the sums of the partitions before
    totals = emitted.groupBy("part").agg(F.sum("length").alias("n"))
    offsets = totals.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))  # a row for each partition
    placed = emitted.join(F.broadcast(offsets), "part").withColumn("start", F.col("base") + F.col("within")).withColumn("begin", F.col("start") - F.col("offset"))
    # the ancestors that a leaf shares, from wherever they were emitted
    shared = emitted.where("shared > 0 AND offset = 0").select("leaf", "shared").join(ordered.select("leaf", "path"), "leaf").select("leaf", F.explode(F.transform(F.sequence(F.lit(0), F.col("shared") - 1), lambda i: F.substring(F.col("path"), i * NODE + 1, F.lit(NODE)))).alias("node"))
    spans = shared.join(placed.select("node", "start", "length"), "node").groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct(F.col("start").alias("start"), (F.col("start") + F.col("length")).alias("end")))).alias("spans"))
    spans = spans.select("leaf", _touching(F.col("spans")).alias("spans"), F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("above"))
    joined = placed.join(spans, "leaf", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    own = F.when(F.col("offset") > 0, F.array(F.struct(F.col("begin").alias("start"), F.col("start").alias("end")))).otherwise(none)
    nodes = joined.select("node", "depth", "start", "length", (F.coalesce("above", F.lit(0)) + F.col("offset")).alias("position"), _touching(F.concat(F.coalesce("spans", none), own)).alias("attends_to"), "ids", "loss")
    return saved(nodes, "tree"), every.select("conv_id", "leaf", "path")


def _touching(spans):
    """Sorted intervals with those that touch joined."""
    start = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done, s):
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] == s["start"])
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.try_element_at(done, F.lit(-1))["start"].alias("start"), s["end"].alias("end"))))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, start, add)


def read_back(nodes: DataFrame, index: DataFrame, tokenizer: str, tile: int = 1024) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the stream alone: of each
    conversation's last node the intervals that it attends to, and itself; the nodes that start in them, looked up by
    tiles of the stream; laid out by their position ids. A gap or an overlap of positions is an error."""
    leaves = index.select("leaf").distinct().join(nodes.select(F.col("node").alias("leaf"), "start", "length", "attends_to"), "leaf")
    itself = F.array(F.struct(F.col("start"), (F.col("start") + F.col("length")).alias("end")))
    spans = leaves.select("leaf", F.explode(F.concat("attends_to", itself)).alias("s")).select("leaf", F.col("s.start").alias("lo"), F.col("s.end").alias("hi")).where("lo < hi")
    asked = spans.select("leaf", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / tile), F.floor((F.col("hi") - 1) / tile))).alias("tile"))
    placed = nodes.select(F.floor(F.col("start") / tile).alias("tile"), "start", "length", "position", "ids", "loss")
    tokens = asked.join(placed, "tile").where("lo <= start AND start + length <= hi").select("leaf", "position", "length", "ids", "loss")
    schema = T.StructType([T.StructField("leaf", T.BinaryType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = byte_level(tokenizer).merges
        for rows, bounds in whole_groups(batches, ["leaf"]):
            ids, loss, out = rows.column("ids").to_pylist(), rows.column("loss").to_pylist(), []
            position, length = rows.column("position").to_numpy(), rows.column("length").to_numpy()
            for i, j in pairwise(bounds.tolist()):
                if (position[i:j] != np.cumsum(length[i:j]) - length[i:j]).any():
                    raise ValueError("a conversation's positions have a gap")
                own = np.frombuffer(b"".join(ids[i:j]), "<u4").astype(np.int64)
                mask = np.frombuffer(b"".join(loss[i:j]), np.uint8) > 0
                formatted = held.decode(own, np.array([0, len(own)]))[0]
                learned = unguard(held.decode(own[mask], np.array([0, int(mask.sum())]))[0])
                turns = parse(formatted)
                out.append((rows.column("leaf")[i].as_py(), len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=schema.names)

    told = tokens.repartition("leaf").sortWithinPartitions("leaf", "position").mapInArrow(run, schema)
    return index.select("conv_id", "leaf").join(told, "leaf").drop("leaf")
