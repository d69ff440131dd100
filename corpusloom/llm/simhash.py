"""SimHash near-duplicates: fingerprints, and links between fingerprints that differ in at most two bits.

Fingerprints. Texts are lower-cased in A-Z; words are `[^\\x20\\x09-\\x0D]+`; the XXH64 (seed 42) of each run of three
words, joined by spaces, votes for its bits; a bit is set if more than half vote for it. A text of fewer words is one
run; a text without words, or null, has fingerprint zero, which is linked like any other.

Links. Equal fingerprints are one class (pre-aggregated to the least id). A distinct fingerprint is embedded as the
bit counts of its 32 segments of two bits. Flipping a bit moves one count by one, so the Manhattan distance of two
embeddings is a lower bound of the differing bits. Each count is kept in unary (00, 01, 11), so that distance is the bit
count of an exclusive or, and a step of one along an axis flips one bit.

The embeddings are range-joined on three grids. The axes are cut into three thirds, and a grid's coordinates are the
counts of two of them. Of a distance of at most two, the two thirds that have least of it have one at most, so in some
grid both lie in one cell or in neighbouring cells, one step apart. Each embedding is entered in its own cell of each
grid and looks up that cell and the neighbours. A step changes the sum of the coordinates by one, so of two neighbours
one is odd; only the odd one looks at its neighbours, and each pair comes up once. It is taken in the first grid that
has it, filtered by the lower bound over all axes and verified on the fingerprints. All of it is built-in expressions
and equi-joins; no cell is capped.

Components are those of the links between class representatives (common.components). Edge cases: empty tables give
empty results; rows with a null id get the fingerprint and a null component; repeated rows are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, buffers, components, run_lengths, saved, tidy, word_spans

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: The thirds of the 32 axes, two bits an axis.
_THIRDS = [range(0, 11), range(11, 22), range(22, 32)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Each grid's mask: all axes but those of a third.
MASKS = [_signed(sum(3 << (2 * axis) for third in _THIRDS if third is not left for axis in third)) for left in _THIRDS]
_LOW = 0x5555555555555555


def fingerprints(texts: pa.Array, width: int = 3, seed: int = 42) -> np.ndarray:
    """The fingerprint (unsigned) of each text."""
    data, bounds = buffers(texts)
    starts, stops, first = word_spans(data, bounds)
    n_words = np.diff(first)
    # words joined by single spaces, side by side
    size = stops - starts
    ends = np.cumsum(size + 1)
    flat = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    take, _ = run_lengths(np.stack([starts, stops], 1).ravel(), np.arange(len(starts)) * 2)
    flat[np.arange(len(take)) + np.repeat(np.arange(len(starts)), size)] = _LOWER[data[take]]
    raw = flat.tobytes()
    n_runs = np.where(n_words > 0, np.maximum(n_words - width + 1, 1), 0)
    run_ends = np.cumsum(n_runs)
    word = np.arange(int(run_ends[-1]) if len(run_ends) else 0) + np.repeat(first[:-1] - (run_ends - n_runs), n_runs)
    last = np.minimum(word + width - 1, np.repeat(first[1:] - 1, n_runs))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], seed) for a, b in zip((ends[word] - size[word] - 1).tolist(), (ends[last] - 1).tolist(), strict=True)), np.uint64, len(word))
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(n_runs)
    if len(some):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = np.add.reduceat(bits, (run_ends - n_runs)[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * votes > n_runs[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", block_bytes: int = 1 << 20) -> DataFrame:
    """df with the fingerprint of each whole text (as a signed 64-bit number) instead of the text."""
    df = df.drop(out)
    schema = T.StructType([*(f for f in df.schema if f.name != text), T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(text)
            found = np.concatenate([fingerprints(texts.slice(i, j - i)) for i, j in blocks(buffers(texts)[1], block_bytes)])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-1]), pa.array(found.view(np.int64))], names=schema.names)

    return df.mapInArrow(tidy(run), schema)


def unary_counts(bits):
    """Bit counts of the 32 segments, each in unary: 01 and 10 are both one."""
    high = F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(_LOW))
    low = bits.bitwiseAND(F.lit(_LOW))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def neighbours(cell, mask: int):
    """The cells one step from a cell of the grid with this mask. Counts go from 0 to 2, so 10 is no count."""
    steps = [_signed(1 << i) for i in range(64) if mask >> i & 1]
    tried = F.transform(F.array(*(F.lit(s) for s in steps)), cell.bitwiseXOR)
    return F.filter(tried, lambda x: F.shiftrightunsigned(x, 1).bitwiseAND(F.bitwise_not(x)).bitwiseAND(F.lit(_LOW)) == 0)


def links(fingerprints: DataFrame, bits: str = "fingerprint", most: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most two bits."""
    if not 0 <= most <= 2:
        raise ValueError("two thirds of the axes hold at most one step only for up to two differing bits")
    # by number, so that small rows which make many cells each aren't put together into a few tasks
    parts = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = fingerprints.select(F.col(bits).alias("x")).where(F.col(bits).isNotNull()).repartition(parts, "x").distinct()
    own = [unary_counts(F.col("x")).bitwiseAND(F.lit(m)) for m in MASKS]
    homes = one.select(F.col("x").alias("a"), F.posexplode(F.array(*own)).alias("grid", "cell"))
    looked = [F.when(F.bit_count(c) % 2 == 1, F.concat(F.array(c), neighbours(c, m))).otherwise(F.array(c)) for c, m in zip(own, MASKS, strict=True)]
    looks = one.select(F.col("x").alias("b"), F.posexplode(F.array(*looked)).alias("grid", "cells")).select("b", "grid", F.explode("cells").alias("cell"))
    apart = unary_counts(F.col("a")).bitwiseXOR(unary_counts(F.col("b")))
    steps = [F.bit_count(apart.bitwiseAND(F.lit(m))) for m in MASKS]
    first = F.coalesce(*(F.when(n <= 1, k) for k, n in enumerate(steps)))
    once = (F.col("a") < F.col("b")) | (F.col("a") != F.col("b")) & (F.element_at(F.array(*steps), F.col("grid") + 1) == 1)
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most) & (F.bit_count(apart) <= most) & (first == F.col("grid")) & once
    # Spark takes a row that makes many for one, and so these sides for small enough to broadcast
    return homes.hint("merge").join(looks.hint("merge"), ["grid", "cell"]).where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (signed) and component_id, the least id reachable by links, of each row."""
    prints = saved(fingerprint(df.select(F.col(doc_id), F.col(text)), text), "fingerprints")
    classes = prints.where(F.col(doc_id).isNotNull()).groupBy("fingerprint").agg(F.min(doc_id).alias("first"))
    classes = saved(classes, "fingerprint-classes")
    pairs = links(classes)
    ids = classes.select(F.col("fingerprint").alias("k"), F.col("first").alias("v"))
    edges = pairs.join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b").select("x", "y")
    found = components(edges, "x", "y")
    classes = classes.join(found, F.col("first") == F.col("node"), "left").select("fingerprint", F.coalesce("component", "first").alias("component_id"))
    return prints.join(classes, "fingerprint", "left").select(doc_id, "fingerprint", F.when(F.col(doc_id).isNotNull(), F.col("component_id")).alias("component_id"))
