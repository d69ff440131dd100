"""What several operators of this package share: word spans over Arrow buffers, checkpoints, components."""

from __future__ import annotations

import ctypes
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that part words: the space and \t to \r, as in `[^\x20\x09-\x0D]+`.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PINV = np.uint64(pow(int(_P), -1, 2**64))


#: The first bytes of eight, by their number.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_TABLES: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2 ... modulo 2^64; kept, since each block of texts asks for about as many."""
    if len(_TABLES.get(int(base), ())) < n:
        out = np.full(1 << max(10, int(n - 1).bit_length()), base, np.uint64)
        out[0] = 1
        _TABLES[int(base)] = np.multiply.accumulate(out)
    return _TABLES[int(base)][:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and their bounds (n + 1). A null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    raw = texts.buffers()
    bounds = np.frombuffer(raw[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_spans(data: np.ndarray, bounds: np.ndarray, parts: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in data, and for each text the index of its first word (n + 1). parts: which bytes
    part words."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~parts[data]
    begins = word[1:] & ~word[:-1]
    ends = ~word[1:] & word[:-1]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    inside = cuts[word[cuts] & word[cuts + 1]]  # a text that ends in a word before one that starts with a word
    begins[inside] = True
    ends[inside] = True
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
    return starts, stops, np.searchsorted(starts, bounds)


def distinct_spans(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For each of the spans of data, which ascend and don't overlap, the index of its bytes among the distinct ones, and
    those. Bytes are compared, not hashes."""
    ends = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(stops - starts, out=ends[1:])
    inside, some = np.zeros(len(data) + 1, np.int8), stops > starts
    inside[starts[some]] += 1
    inside[stops[some]] -= 1
    raw = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
    return np.asarray(spans.indices), spans.dictionary


_X1, _X2, _X3, _X4, _X5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def xxh64_under_32(data: np.ndarray, starts: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """The XXH64 of spans of data of under 32 bytes, all at once."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    h = size.astype(np.uint64) + np.uint64(seed) + _X5

    def read(at: np.ndarray, n: int) -> np.ndarray:
        return np.lib.stride_tricks.as_strided(padded, (len(data) + 1, n), (1, 1))[at].view(f"<u{n}").ravel().astype(np.uint64)

    for i in range(0, 24, 8):
        on = np.flatnonzero(size >= i + 8)
        h[on] = _turned(h[on] ^ _turned(read(starts[on] + i, 8) * _X2, 31) * _X1, 27) * _X1 + _X4
    on = np.flatnonzero(size & 4)
    h[on] = _turned(h[on] ^ read(starts[on] + (size[on] & ~7), 4) * _X1, 23) * _X2 + _X3
    for i in range(3):
        on = np.flatnonzero((size & 3) > i)
        h[on] = _turned(h[on] ^ padded[starts[on] + (size[on] & ~3) + i].astype(np.uint64) * _X5, 11) * _X1
    h = (h ^ h >> np.uint64(33)) * _X2
    h = (h ^ h >> np.uint64(29)) * _X3
    return h ^ h >> np.uint64(32)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 7) -> np.ndarray:
    """A 64-bit hash of each span's bytes: up to eight bytes their number, mixed with their length by bijections, so that
    no two of a length collide; of longer spans the XXH64."""
    size = stops - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))[starts].view("<u8").ravel()
    out = mix(mix(eight & _MASK[np.minimum(size, 8)]) + (size.astype(np.uint64) + np.uint64(seed)) * _P)
    some = np.flatnonzero((size > 8) & (size < 32))
    if len(some):
        out[some] = xxh64_under_32(data, starts[some], size[some], seed)
    long = np.flatnonzero(size >= 32)
    if len(long):
        codes, words = distinct_spans(data, starts[long], stops[long])
        digest = xxhash.xxh64_intdigest
        out[long] = np.fromiter((digest(w, seed) for w in words.to_pylist()), np.uint64, len(words))[codes]
    return out


class SpanHashes:
    """64-bit hashes of any spans of data, by prefix sums. They are sums modulo 2^64, for which long spans of two letters
    can be found that collide: good for features, never for taking texts for equal."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(_P, len(data)), out=self.sums[1:])
        self.back = powers(_PINV, len(data) + 1)

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mix((self.sums[stops] - self.sums[starts]) * self.back[starts] + (stops - starts).astype(np.uint64))


def blocks(bounds: np.ndarray, most: int):
    """Ranges of texts that hold at most so many bytes together; one text at least."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield i, j
        i = j


def run_lengths(bounds_of_runs: np.ndarray, gather: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices that lay the runs `gather` side by side, and the bounds of the result."""
    size = bounds_of_runs[gather + 1] - bounds_of_runs[gather]
    to = np.zeros(len(gather) + 1, np.int64)
    np.cumsum(size, out=to[1:])
    return np.arange(to[-1]) + np.repeat(bounds_of_runs[gather] - to[:-1], size), to


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of rows that come sorted by keys, cut between groups, and the bounds of their groups."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            held.append(batch)
        if not held:
            return
        last = held[-1]
        change = np.zeros(last.num_rows - 1, bool)
        for k in keys:
            c = last.column(k)
            change |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, last.num_rows - 1)))
        cut = 0
        if batch is None:
            cut = last.num_rows
        elif change.any():
            cut = int(np.flatnonzero(change)[-1]) + 1
        elif len(held) > 1 and any(held[-2].column(k)[-1].as_py() != last.column(k)[0].as_py() for k in keys):
            cut = 0
        else:
            continue
        out = pa.Table.from_batches([*held[:-1], last.slice(0, cut)]).combine_chunks()
        held = [last.slice(cut)] if cut < last.num_rows else []
        if out.num_rows:
            change = np.ones(out.num_rows, bool)
            change[1:] = False
            for k in keys:
                c = out.column(k).combine_chunks() if out.column(k).num_chunks != 1 else out.column(k).chunk(0)
                change[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)))
            yield out, np.append(np.flatnonzero(change), out.num_rows)


def thick(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Batches of narrow rows put together to so many rows, so that little is done for each batch."""
    held, n = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if held and (batch is None or n >= rows):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node that it is linked with, over any number of links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def tidy(run):
    """run for mapInArrow, after which the worker, which waits for other tasks, hands freed memory back."""
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def fold(column, modulus: int):
    """crc32 of the value as text, modulo; null for a null."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


def hashed_share(column, share: float):
    """Whether a row is in a share of all rows that its value alone decides."""
    return F.pmod(F.xxhash64(column, F.lit("sample")), F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; one is set only where there is none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        import tempfile

        found = tempfile.mkdtemp(prefix="corpusloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Spark's setting by which a query's shuffle files go when it ends, and not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Spark's setting of rows that go to a Python worker at once, and ours while a step is written: a few MB of texts.
BATCH, MOST_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1500


def saved(df: DataFrame, name: str = "t") -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage is cut, and it outlives executors. The
    shuffle files of the query that wrote it go, and texts go to Python workers in small batches."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/corpusloom-{name}-{uuid.uuid4().hex}"
    rows = spark.conf.get(BATCH, None)
    ours = {CLEANUP: "true", BATCH: str(min(int(rows or MOST_ROWS), MOST_ROWS))}
    before = {key: spark.conf.get(key, None) for key in ours}
    for key, value in ours.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, *frames: DataFrame) -> str:
    """name, with underscores behind it until no column of frames has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of a row of a bitmap, as Spark's bitmap functions have them.
PAGE = 4096 * 8


class Bitmap:
    """Which ids may be in a set: a bitmap of one hash each, of 16 MiB at most whatever the set's size, so it can be
    broadcast. A hit may be wrong, a miss can't. It only spares rows a shuffle; hits are joined."""

    def __init__(self, ids: DataFrame, column: str, most_bits: int = 1 << 27):
        n = ids.count()
        self.bits = min(most_bits, max(PAGE, 1 << (16 * max(n, 1) - 1).bit_length()))
        at = self._at(F.col(column))
        pages = ids.where(F.col(column).isNotNull()).select((at / PAGE).cast("long").alias("page"), (at % PAGE).alias("bit"))
        self.pages = saved(pages.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")), "bitmap")

    def _at(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column, F.lit("bitmap")), F.lit(self.bits))

    def marked(self, df: DataFrame, column: str, hit: str) -> DataFrame:
        """df with the boolean column `hit`."""
        page, bits = (fresh(c, df) for c in ("page", "bits"))
        at = self._at(F.col(column))
        joined = df.withColumn(page, (at / PAGE).cast("long")).join(F.broadcast(self.pages.toDF(page, bits)), page, "left")
        byte = F.conv(F.hex(F.substring(F.col(bits), (at % PAGE / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.pmod(byte / F.pow(F.lit(2), at % 8), F.lit(2)).cast("int") == 1
        return joined.withColumn(hit, F.coalesce(F.col(column).isNotNull() & bit, F.lit(False))).drop(page, bits)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """Connected components of the links (a, b): one row (node, component) for each node of a link, where
    component is the smallest node that can be reached. Each round a node takes the smallest label around it,
    offers it to the label it had, and labels are followed twice, so long chains halve. Minima are pre-aggregated
    and joins are plain equi-joins, which adaptive execution splits where a node is hot. Ends when nothing moved.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    links = saved(links.union(links.select("b", "a")).distinct(), "links")
    labels = saved(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(rounds):
        near = links.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        seen = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("low"))
        hooks = seen.select(F.col("label").alias("at"), "low").union(seen.select(F.col("node").alias("at"), "low")).groupBy("at").agg(F.min("low").alias("low"))
        jump = hooks.select(F.col("at").alias("at2"), F.col("low").alias("low2"))
        after = saved(hooks.join(jump, F.col("low") == F.col("at2"), "left").select(F.col("at").alias("node"), F.least("low", "low2").alias("label")), "labels")
        moved = after.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was").limit(1).count()
        labels = after
        if not moved:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels.select("node", F.col("label").alias("component"))
