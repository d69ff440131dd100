"""Fuzzy passages that documents share, by collinear chaining of k-mer seeds.

1. Seeds: every run of `seed_words` words. Words are `[^\\x20\\x09-\\x0D]+`, lower-cased in A-Z, and known by their XXH64.
2. Join: a seed links each document that holds it with the first one (least id), a star, in two levels. Within a block
   of texts, a holder meets the block's first holder where it lies; only the first holder's entry goes on, so a seed that
   a third of all documents hold sends one entry a block. Entries go to buckets by their hash, packed (about 8 bytes an
   entry instead of 40), and meet the first holder of all there. Entries without a partner end there: later steps only
   see seeds that two documents hold. Rows grow with the seeds, not with the square of a group. Links go on packed, by
   buckets of ids, to the task that chains them, which sorts a bucket, or a share of its ids, at once.
3. Chaining: the matches of a document with one earlier document are taken by position; a Fenwick tree over the
   positions in the other document has prefix maxima of score plus gap cost, so each match finds its best predecessor
   in logarithmic time. The cost is linear in the words skipped on both sides; a chain that doesn't pay ends.
4. Alignment: words of both spans are compared between anchors and beyond the chain's ends, by common prefixes and
   suffixes and a longest common subsequence of what is left. A chain is parted at gaps of over `max_gap` words. A
   part is kept from `least_part` words and a share of `similarity` aligned words on. Only documents in chains are read
   again, picked by a bitmap of their ids, and their words are joined in tiles.
5. Exact route: an earlier document may share a passage whose runs all occur first elsewhere, each too short there for a
   part. So runs of `min_words` words, all of whose seeds two documents hold or more, are joined with the first document
   that holds the whole run, and go past chaining and alignment. Runs that lie on one diagonal with one earlier document
   are spared this: they are found by their chain, and the first document that holds a run never is such a one.
6. Parts that touch in a document, found in several earlier documents, are one passage, kept from `min_words` on.

The first document that holds a passage keeps it. A passage that occurs twice in one document only isn't reported.
Edge cases: null or empty texts and rows with a null id have no passages; ids are taken as unique, and identical
repeated rows count as one document; an empty table has no passages; extra columns take no part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Bitmap, blocks, buffers, fresh, mix, saved, thick, tidy, whole_groups, word_hashes, word_spans

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
TILE = 256
#: Entries that a bucket of hashes should have, rows that a task packs at once, bytes of text for a bucket of ids.
BUCKET, ROWS, ID_BUCKET = 1 << 20, 1 << 18, 1 << 25
#: Bytes of packed links that are unpacked at once, and links of whole documents that are chained at once.
LINK_BYTES, LINKS = 1 << 24, 1 << 16


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words side by side, and the bounds of each text's."""
    data, bounds = buffers(texts)
    starts, stops, first = word_spans(data, bounds)
    return word_hashes(_LOWER[data], starts, stops), first


def seeds_of(codes: np.ndarray, first: np.ndarray, k: int, window: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the runs of k words; with window above 1 only of the run with the least hash of each
    `window` neighbouring ones (winnowing), which loses passages: an edit changes the minima of the windows around it."""
    n = len(codes) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    run = np.zeros(n, np.uint64)
    for i in range(k):
        run = run * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    run = mix(run)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    inside = np.arange(n) <= first[1:][text] - k
    if window > 1:
        run[~inside] = np.iinfo(np.uint64).max
        most = np.minimum(window, first[1:][text] - first[:-1][text] - k + 1)
        reach = np.ones(n, np.int32)
        for sign in (-1, 1):
            alive = inside.copy()
            for t in range(1, min(window, n)):
                a, b = (slice(t, n), slice(0, n - t)) if sign < 0 else (slice(0, n - t), slice(t, n))
                ok = np.zeros(n, bool)
                ok[a] = alive[a] & (text[a] == text[b]) & inside[b] & ((run[b] >= run[a]) if sign < 0 else (run[b] > run[a]))
                alive = ok
                reach += alive
        inside &= reach >= most
    at = np.flatnonzero(inside)
    return text[at], at - first[:-1][text[at]], run[at]


def by_hash(h: np.ndarray) -> np.ndarray:
    """The stable order of hashes. Hash and index are sorted as one number, which is several times as fast as sorting indices; if
    the number has no room for all bits of the hash and so two hashes come mixed, indices are sorted after all."""
    if len(h) < 2:
        return np.arange(len(h))
    x = h.view(np.uint64)
    x = x - x.min()
    bits = len(h).bit_length()
    drop = max(0, int(x.max()).bit_length() + bits - 64)
    key = x >> np.uint64(drop) << np.uint64(bits) | np.arange(len(h), dtype=np.uint64)
    key.sort()
    order = (key & np.uint64((1 << bits) - 1)).view(np.int64)
    if drop:
        x = x[order]
        if (x[1:] < x[:-1]).any():
            return np.argsort(h, kind="stable")
    return order


def numbered(row: np.ndarray, at: np.ndarray, h: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash of so many bits), by hash, of seeds that come by row and position. A place is twice the position, plus one if the text holds the seed earlier already. Such a seed comes a second time, with its
    number mixed in, so that repetitive texts match occurrence by occurrence."""
    h = h >> np.uint64(64 - bits)
    order = by_hash(h)
    row, at, h = row[order], 2 * at[order], h[order]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    again = np.flatnonzero(same)
    if not len(again):
        return row, at, h
    number = again - np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))[again]
    mixed = mix(h[again] + mix(number.astype(np.uint64))) >> np.uint64(64 - bits)
    order = by_hash(mixed)
    own, mixed = again[order], mixed[order]
    where = np.searchsorted(h, mixed)
    return np.insert(row, where, row[own]), np.insert(at + same, where, at[own]), np.insert(h, where, mixed)


def ranks(ids: pa.Array) -> np.ndarray:
    """The place of each id among the sorted distinct ones."""
    found = ids.dictionary_encode()
    place = np.empty(len(found.dictionary), np.int64)
    place[np.asarray(pc.sort_indices(found.dictionary))] = np.arange(len(found.dictionary))
    return place[np.asarray(found.indices)]


def shared_groups(h: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """Indices of entries, sorted by hash, whose hash comes twice or more, or that are marked in more."""
    same = h[1:] == h[:-1]
    keep = np.append(False, same) | np.append(same, False)
    return np.flatnonzero(keep[: len(h)] if more is None else keep[: len(h)] | more)


def by_holder(some: np.ndarray, h: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """some, which come by hash, within a hash by rank and place."""
    same = h[some[1:]] == h[some[:-1]]
    if not ((rank[some[1:]] < rank[some[:-1]]) | (rank[some[1:]] == rank[some[:-1]]) & (at[some[1:]] < at[some[:-1]]))[same].any():
        return some
    return some[np.lexsort((at[some], rank[some], h[some]))]


def _planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones, and so on: high bytes, mostly alike, lie together. In front, how
    many of the eight there are; the rest is zero."""
    n = max(1, (int(x.view(np.uint64).max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([n]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def _numbers(raw: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n numbers that begin at raw, and what follows them."""
    width = int(raw[0])
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw[1 : 1 + width * n].reshape(width, n).T
    return out.view("<i8").ravel(), raw[1 + width * n :]


def _ids_out(ids: pa.Array) -> bytes:
    """Ids as bytes."""
    if pa.types.is_integer(ids.type):
        return _planes(np.diff(np.asarray(ids).astype(np.int64), prepend=0).view(np.uint64))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as out:
        out.write_batch(pa.record_batch([ids], names=["id"]))
    return sink.getvalue().to_pybytes()


def _ids_in(raw: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    if pa.types.is_integer(kind):
        return pa.array(np.cumsum(_numbers(raw, n)[0]), pa.int64()).cast(kind)
    return pa.ipc.open_stream(pa.py_buffer(raw.tobytes())).read_all().column("id").combine_chunks().cast(kind)


def packed(ids: pa.Array, rows: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[int, bytes]:
    """Columns of row numbers (of ids) and of other numbers as one compressed value, and its size before."""
    n = len(rows[0])
    every = np.concatenate(rows)
    if len(ids) > 16 * len(every):
        used, inverse = np.unique(every, return_inverse=True)
    else:
        seen = np.zeros(len(ids), bool)
        seen[every] = True
        used, inverse = np.flatnonzero(seen), (np.cumsum(seen) - 1)[every]
    own = _ids_out(ids.take(pa.array(used)))
    raw = np.array([n, len(used), len(own), len(rows), len(numbers)], "<i8").tobytes() + own + b"".join(_planes(x) for x in [*np.split(inverse, len(rows)), *numbers])
    return len(raw), pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpacked(value: bytes, size: int, kind: pa.DataType) -> tuple[pa.Array, list[np.ndarray], list[np.ndarray]]:
    """What packed() had."""
    raw = np.frombuffer(pa.Codec("zstd", 1).decompress(value, size, asbytes=True), np.uint8)
    n, n_ids, n_own, n_rows, n_numbers = raw[:40].view("<i8").tolist()
    ids, raw, found = _ids_in(raw[40 : 40 + n_own], n_ids, kind), raw[40 + n_own :], []
    for _ in range(n_rows + n_numbers):
        numbers, raw = _numbers(raw, n)
        found.append(numbers)
    return ids, found[:n_rows], found[n_rows:]


def spread(ids: pa.Array) -> np.ndarray:
    """A hash of each id, by which links are dealt."""
    if pa.types.is_integer(ids.type):
        return mix(np.asarray(ids).astype(np.int64).view(np.uint64))
    return mix(np.fromiter((xxhash.xxh64_intdigest(x) for x in ids.to_pylist()), np.uint64, len(ids)))


def arrow_type(kind: T.DataType) -> pa.DataType:
    return pa.string() if isinstance(kind, T.StringType) else {"long": pa.int64(), "integer": pa.int32(), "short": pa.int16(), "byte": pa.int8()}[kind.typeName()]


def packed_links(df: DataFrame, doc_id: str, text: str, k: int, window: int = 1, block_bytes: int = 5 << 19) -> DataFrame:
    """(bucket, local, size, value), parted by bucket, of links() packed; all rows of an id are in one bucket."""
    kind = df.schema[doc_id].dataType
    texts = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bucket_bits = max(8, (size // 6 // BUCKET).bit_length())
    hash_bits = min(56, max(48, 20 + (size // 6).bit_length()))  # so that few hashes agree by chance
    id_buckets = max(256, size // ID_BUCKET)
    blob = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("local", T.BooleanType()), T.StructField("size", T.LongType()), T.StructField("value", T.BinaryType())])

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*out, strict=True)), (pa.int64(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], names=blob.names)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            for i, j in blocks(buffers(batch.column("text"))[1], block_bytes):
                row, at, h = seeds_of(*words_of(batch.column("text").slice(i, j - i)), k, window)
                if not len(h):
                    continue
                row, at, h = numbered(row, at, h, hash_bits)
                ids = batch.column("id").slice(i, j - i)
                rank = ranks(ids)
                both = shared_groups(h)
                # by hash, then by id, then by place: a group's first entry is its first holder's first place
                both = by_holder(both, h, rank[row], at)
                new = np.append(True, h[both[1:]] != h[both[:-1]])[: len(both)]
                head = both[np.maximum.accumulate(np.where(new, np.arange(len(both)), 0))]
                later = rank[row[both]] != rank[row[head]]
                flag = np.zeros(len(h), np.int64)
                flag[head[later]] = 1  # the first holder has company
                stays = np.ones(len(h), bool)
                stays[both[later]] = False
                out = []
                own, first = both[later], head[later]
                for a in range(0, len(own), ROWS):
                    x, y = own[a : a + ROWS], first[a : a + ROWS]
                    order = np.lexsort((at[x], row[x]))
                    x, y = x[order], y[order]
                    turn += 1
                    out.append((turn * 0x9E3779B1 % (1 << bucket_bits), True, *packed(ids, [row[x], row[y]], [at[x], at[y], h[x]])))
                del both, head, later, new
                order = np.flatnonzero(stays)
                cuts = np.searchsorted(h[order], np.arange((1 << bucket_bits) + 1, dtype=np.uint64) << np.uint64(hash_bits - bucket_bits))
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    x = order[cuts[b] : cuts[b + 1]]
                    out.append((b, False, *packed(ids, [row[x]], [np.diff(h[x], prepend=h.dtype.type(0)), 2 * at[x] + flag[x]])))
                    if len(out) >= 256:
                        yield rows_of(out)
                        out = []
                if out:
                    yield rows_of(out)

    id_type = arrow_type(kind)

    def dealt(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Links, packed by buckets of ids."""
        ids = pa.concat_arrays([f[0] for f in found])
        base = np.cumsum([0, *(len(f[0]) for f in found)])
        a, b = (np.concatenate([f[c] + n for f, n in zip(found, base, strict=False)]) for c in (1, 2))
        at, there, h = (np.concatenate([f[c] for f in found]) for c in (3, 4, 5))
        bucket = (spread(ids) % np.uint64(id_buckets)).astype(np.int64)[a]
        order = np.lexsort((at, a, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(id_buckets + 1))
        out = []
        for n in np.flatnonzero(np.diff(cuts)).tolist():
            x = order[cuts[n] : cuts[n + 1]]
            out.append((n, False, *packed(ids, [a[x], b[x]], [at[x], there[x], h[x]])))
        yield rows_of(out)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for rows, bounds in whole_groups(batches, ["bucket"]):
            local, sizes, values = (rows.column(c) for c in ("local", "size", "value"))
            for i, j in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                ids, row, h, at, base = [], [], [], [], 0
                for r in range(i, j):
                    own, of, numbers = unpacked(values[r].as_py(), sizes[r].as_py(), id_type)
                    if local[r].as_py():
                        held.append((own, *of, *numbers))
                        n_held += len(of[0])
                        continue
                    ids.append(own)
                    row.append(of[0] + base)
                    h.append(np.cumsum(numbers[0]))
                    at.append(numbers[1])
                    base += len(own)
                if ids:
                    ids, row, h, at = pa.concat_arrays(ids), np.concatenate(row), np.concatenate(h), np.concatenate(at)
                    flag, at, rank = at % 2 == 1, at // 2, ranks(ids)
                    order = by_hash(h)
                    row, h, at, flag = row[order], h[order], at[order], flag[order]
                    del order
                    both = by_holder(shared_groups(h, flag), h, rank[row], at)  # a flagged hash is shared though its entry is the only one
                    if len(both):
                        new = np.append(True, h[both[1:]] != h[both[:-1]])
                        begin = np.flatnonzero(new)
                        head = both[np.maximum.accumulate(np.where(new, np.arange(len(both)), 0))]
                        later = rank[row[both]] != rank[row[head]]
                        holds = np.logical_or.reduceat(later | flag[both], begin)  # two documents, not one with the seed twice
                        holds = np.repeat(holds, np.diff(np.append(begin, len(both))))
                        both, head = both[holds], head[holds]
                        held.append((ids, row[both], row[head], at[both], at[head], h[both]))
                        n_held += len(both)
                if n_held >= ROWS:
                    yield from dealt(held)
                    held, n_held = [], 0
        if n_held:
            yield from dealt(held)

    moved = texts.mapInArrow(tidy(entries), blob).repartition("bucket").sortWithinPartitions("bucket")
    return moved.mapInArrow(tidy(met), blob).repartition("bucket")


def links(df: DataFrame, doc_id: str, text: str, k: int, window: int = 1, block_bytes: int = 5 << 19) -> DataFrame:
    """(id, other, at, there, h), parted by id: places (as numbered() has them) of seeds that two documents hold or more, with the
    first document that holds the seed, or the first one of the same block, and its place there. `other` is the
    document itself where it is the first."""
    kind = df.schema[doc_id].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("other", kind), T.StructField("at", T.IntegerType()), T.StructField("there", T.IntegerType()), T.StructField("h", T.LongType())])
    id_type = arrow_type(kind)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, value in zip(batch.column("size").to_pylist(), batch.column("value"), strict=True):
                ids, (a, b), (at, there, h) = unpacked(value.as_py(), size, id_type)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(at.astype(np.int32)), pa.array(there.astype(np.int32)), pa.array(h)], names=schema.names)

    return packed_links(df, doc_id, text, k, window, block_bytes).mapInArrow(tidy(plain), schema)


def links_by_id(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, most: int = LINK_BYTES, rows: int = LINKS) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Of packed links that come by bucket: distinct ids and, by id, other and place, the numbers of id and other among
    them, both places and the hash, all rows of an id at once. A bucket of over `most` bytes is read once for each share
    of its ids."""
    for table, bounds in whole_groups(batches, ["bucket"]):
        sizes, values = table.column("size").to_numpy(), table.column("value")
        for i, j in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            shares = -(-int(sizes[i:j].sum()) // most)
            for share in range(shares):
                ids, found, base = [], [], 0
                for r in range(i, j):
                    own, of, numbers = unpacked(values[r].as_py(), int(sizes[r]), id_type)
                    columns = [*of, *numbers]
                    if shares > 1:
                        ours = np.flatnonzero(((spread(own) >> np.uint64(32)) % np.uint64(shares) == share)[of[0]])
                        columns = [c[ours] for c in columns]
                    found.append([columns[0] + base, columns[1] + base, *columns[2:]])
                    ids.append(own)
                    base += len(own)
                ids = pa.concat_arrays(ids)
                place, (a, b, at, there, h) = ranks(ids), (np.concatenate(c) for c in zip(*found, strict=True))
                if not len(a):
                    continue
                del found
                distinct = ids.take(pa.array(np.unique(place, return_index=True)[1]))
                a, b = place[a], place[b]
                bits = int(at.max()).bit_length()
                if 2 * len(distinct).bit_length() + bits < 64:
                    order = np.argsort((a * len(distinct) + b) << bits | at)
                else:
                    order = np.lexsort((at, b, a))
                columns = [c[order] for c in (a, b, at, there, h)]
                del a, b, at, there, h, order
                ends = np.append(np.flatnonzero(np.diff(columns[0])) + 1, len(columns[0]))
                begin = 0
                while begin < ends[-1]:
                    end = int(ends[min(np.searchsorted(ends, begin + rows), len(ends) - 1)])
                    yield distinct, [c[begin:end] for c in columns]
                    begin = end


def thinned(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Indices, by x and y, of the matches of k words that are left when those inside a run along one diagonal go: its
    ends stay and each k-th between, which hold the same words."""
    order = np.lexsort((x, y - x))
    p, d = x[order], (y - x)[order]
    once = np.append(True, (p[1:] != p[:-1]) | (d[1:] != d[:-1]))
    order, p, d = order[once], p[once], d[once]
    new = np.ones(len(p), bool)
    new[1:] = (d[1:] != d[:-1]) | (p[1:] - p[:-1] > 1)
    since = p - p[np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))]
    keep = order[(since % k == 0) | np.append(new[1:], True)]
    return keep[np.lexsort((y[keep], x[keep]))]


def chain(x: list[int], y: list[int], k: int, gap_cost: float = 0.15) -> list[list[int]]:
    """Chains of matches (x ascending) of k words, each a list of indices, disjoint, best first."""
    n = len(x)
    if n == 1 or all(y[i] - x[i] == y[0] - x[0] and x[i] - x[i - 1] <= 3 * k for i in range(1, n)):
        return [[*range(n)]]
    ranks = {v: r + 1 for r, v in enumerate(sorted({*y}))}
    size = len(ranks) + 1
    tree = [(-1e18, -1)] * size
    score, back, waiting = [0.0] * n, [-1] * n, []
    for i in range(n):
        # matches at the same x can't follow one another: they enter the tree with the next x
        if i and x[i] != x[i - 1]:
            for j in waiting:
                entry, r = (score[j] + gap_cost * (x[j] + y[j]), j), ranks[y[j]]
                while r < size:
                    if tree[r] < entry:
                        tree[r] = entry
                    r += r & -r
            waiting = []
        best, r = (-1e18, -1), ranks[y[i]] - 1
        while r:
            if tree[r] > best:
                best = tree[r]
            r &= r - 1
        gain = best[0] - gap_cost * (x[i] + y[i]) + k  # what lies between is charged, the step to the next word isn't
        score[i] = k + max(0.0, gain)
        back[i] = best[1] if gain > 0 else -1
        waiting.append(i)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = back[i]
        if path:
            out.append(path[::-1])
    return out


def common_prefix(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    at = int(differ.argmax()) if n else 0
    return at if n and differ[at] else n


def subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            kept = row[j + 1]
            row[j + 1] = before + 1 if x == y else max(kept, row[j])
            before = kept
    return row[-1]


@functools.cache
def edits(most: int) -> list[tuple[int, int]]:
    """How many words may be passed on either side, least first."""
    return sorted(((p, q) for p in range(most + 1) for q in range(most + 1) if p or q), key=lambda s: (max(s), s))


def extend(a: np.ndarray, b: np.ndarray, most_edits: int = 3, sure: int = 3, calm: bool = True) -> tuple[int, int, int]:
    """How far a and b run alike from their starts: words of a, words of b, words alike. Up to so many words may differ
    at a place if the `sure` next ones agree and, when `calm`, the whole stays alike enough."""
    i = j = same = 0
    while True:
        n = common_prefix(a[i:], b[j:])
        i, j, same = i + n, j + n, same + n
        u, v = a[i : i + most_edits + sure].tolist(), b[j : j + most_edits + sure].tolist()
        for di, dj in edits(most_edits):
            x = u[di : di + sure]
            if len(x) == sure and x == v[dj : dj + sure] and (not calm or 10 * max(di, dj) <= i + 10):
                i, j = i + di, j + dj
                break
        else:
            return i, j, same


def align(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, max_gap: int, min_words: int = 50) -> list[tuple[int, int, int, int, int]]:
    """Parts (start, end, start in b, end in b, words alike) of the words a and b along matches of k words at x, y.
    A part a little under min_words, which an edit near an end cuts short, takes single words behind its ends too."""
    parts, same = [], k
    i, j = int(x[0]) + k, int(y[0]) + k
    starts = [(int(x[0]), int(y[0]))]
    for p, q in zip(x[1:].tolist(), y[1:].tolist(), strict=True):
        if p < i or q < j:  # overlaps the match before
            skip = max(i - p, j - q)
            if p - i == q - j and skip < k:
                same += k - skip
                i, j = p + k, q + k
            continue
        if p == i and q == j:  # nothing between
            same += k
            i, j = p + k, q + k
            continue
        u, v = a[i:p], b[j:q]
        ahead = common_prefix(u, v)
        u, v = u[ahead:], v[ahead:]
        behind = common_prefix(u[::-1], v[::-1])
        u, v = u[: len(u) - behind], v[: len(v) - behind]
        if max(len(u), len(v)) > max_gap:
            parts.append([*starts[-1], i + ahead, j + ahead, same + ahead])
            starts.append((p - behind, q - behind))
            same = behind + k
        else:
            same += ahead + behind + k + (subsequence(u.tolist(), v.tolist()) if len(u) > 1 and len(v) > 1 else 0)
        i, j = p + k, q + k
    parts.append([*starts[-1], i, j, same])
    out = []
    for n, (s, t, e, f, same) in enumerate(parts):
        low_a, low_b = (parts[n - 1][2], parts[n - 1][3]) if n else (0, 0)
        high_a, high_b = (parts[n + 1][0], parts[n + 1][1]) if n + 1 < len(parts) else (len(a), len(b))
        u, v, more = extend(a[e:high_a], b[f:high_b])
        p, q, less = extend(a[low_a:s][::-1], b[low_b:t][::-1])
        if 0.8 * min_words <= e + u - s + p < min_words:
            u, v, more = extend(a[e:high_a], b[f:high_b], sure=1, calm=False)
            p, q, less = extend(a[low_a:s][::-1], b[low_b:t][::-1], sure=1, calm=False)
        out.append((s - p, e + u, t - q, f + v, same + more + less))
    return out


def uncovered_runs(x: np.ndarray, other: np.ndarray, shift: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Indices where n successive positions x begin, but for those that lie on one diagonal with one other document.
    own: where the document itself is the first one."""
    last = len(x) - n + 1
    if last < 1:
        return np.zeros(0, np.int64)
    breaks = np.append(True, (np.diff(x) != 1) | (np.diff(other) != 0) | (np.diff(shift) != 0) | own[1:])
    part = np.cumsum(breaks)
    far = slice(n - 1, None)
    return np.flatnonzero((x[far] - x[:last] == n - 1) & ((part[far] != part[:last]) | own[:last]))


def exact_parts(runs: DataFrame, words: int) -> DataFrame:
    """Parts (id, other, start, end, same, size) with size 0: runs (g, id, lo, hi) of so many words that the document
    `other`, the first one to hold the run, holds word for word. A document that is the first one with each seed of a
    run (hi is 1) can only be `other`, and of those just the runs are moved that a bitmap has of the rest."""
    rest = runs.where("hi = 0").select("g", "id", "lo")
    first = Bitmap(rest.select("g").distinct(), "g").marked(runs.where("hi = 1"), "g", "hit").where("hit").select("g", "id", "lo")
    star = saved(rest.union(first).groupBy("g").agg(F.min("id").alias("other"), F.max("id").alias("most")).where("other < most").select("g", "other"), "run-star")
    both = rest.join(star.hint("merge"), "g").where("id > other")  # a file of some MB would be a table of hashes of 200 MB on the driver
    return both.select("id", "other", F.col("lo").alias("start"), (F.col("lo") + words).cast("int").alias("end"), F.lit(0).alias("same"), F.lit(0).alias("size"))


def likeness(start: np.ndarray, end: np.ndarray, same: np.ndarray, size: np.ndarray) -> float:
    """The share of aligned words of a passage's parts; of exact runs (size 0) the words count that no other part has."""
    aligned = size > 0
    low = int(start.min())
    ours = np.zeros(int(end.max()) - low, bool)
    for s, e in zip(start[~aligned], end[~aligned], strict=True):
        ours[s - low : e - low] = True
    for s, e in zip(start[aligned], end[aligned], strict=True):
        ours[s - low : e - low] = False
    more = int(ours.sum())
    return float((same.sum() + more) / (size.sum() + more))


def passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50, similarity: float = 0.8, seed_words: int = 5, window: int = 1, max_gap: int = 16, least_part: int = 20, margin: int = 32) -> DataFrame:
    """Passages that an earlier document holds too: doc_id, start and end (words, end excluded), first_ids (earlier
    documents they were aligned with) and similarity (share of aligned words)."""
    k, kind = seed_words, df.schema[doc_id].dataType
    id_type = arrow_type(kind)
    if min_words < k:
        raise ValueError("the runs are made of seeds")
    spans = T.StructType([T.StructField("id", kind), T.StructField("other", kind), *(T.StructField(c, T.IntegerType()) for c in ("lo", "hi", "olo", "ohi")), T.StructField("x", T.BinaryType()), T.StructField("y", T.BinaryType()), T.StructField("g", T.LongType())])
    least_span = least_part - 2 * k if least_part > 3 * k else k
    steps = [*range(0, min_words - k, k), min_words - k]

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chains, and the runs that the exact route may need (g not null, lo their start; hi is 1 if the document is the
        first one with each seed of the run, and 0 else)."""
        for ids, (group, code, at, there, h) in links_by_id(batches, id_type):
            xs, ys, h = at // 2, there // 2, h.view(np.uint64)
            self_first = group == code
            cut = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(group) != 0)))
            ends = np.append(cut[1:], len(xs))
            # a group whose positions span too little can't hold a part
            wide = (np.maximum.reduceat(xs, cut) - np.minimum.reduceat(xs, cut) + k >= least_span) & ~self_first[cut]
            of, out = [], []
            for i, j in zip(cut[wide].tolist(), ends[wide].tolist(), strict=True):
                x, y = xs[i:j], ys[i:j]
                left = thinned(x, y, k)
                x, y = x[left], y[left]
                for path in chain(x.tolist(), y.tolist(), k):
                    p, q = x[path], y[path]
                    if p[-1] - p[0] + k >= least_span:
                        of.append(i)
                        out.append((int(p[0]), int(p[-1]) + k, int(q[0]), int(q[-1]) + k, p.astype("<i4").tobytes(), q.astype("<i4").tobytes()))
            if of:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(group[of])), ids.take(pa.array(code[of])), *(pa.array([o[c] for o in out], pa.int32()) for c in range(4)), *(pa.array([o[c] for o in out], pa.binary()) for c in (4, 5)), pa.nulls(len(of), pa.int64())], names=spans.names)
            # of a place's rows the odd one has the words' own hash, the other one has a number mixed in
            order = np.lexsort((at, group))
            last = np.append((np.diff(xs[order]) != 0) | (np.diff(group[order]) != 0), True)
            order = order[last]
            x, n = xs[order] + group[order] * (1 << 32), min_words - k + 1
            full = uncovered_runs(x, code[order], ys[order] - xs[order], self_first[order], n)
            if len(full):
                g = np.zeros(len(full), np.uint64)
                for t in steps:
                    g = mix(g * np.uint64(0x9E3779B97F4A7C15) + h[order[full + t]])
                start, none = order[full], pa.nulls(len(full), pa.int32())
                others_before = np.append(0, np.cumsum(~self_first[order]))
                alone = others_before[full + n] == others_before[full]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(group[start])), pa.nulls(len(full), ids.type), pa.array(xs[start].astype(np.int32)), pa.array(alone.astype(np.int32)), none, none, pa.nulls(len(full), pa.binary()), pa.nulls(len(full), pa.binary()), pa.array(g.view(np.int64))], names=spans.names)

    found = saved(packed_links(df, doc_id, text, k, window).sortWithinPartitions("bucket").mapInArrow(tidy(chained), spans), "chains")
    chains = found.where("g IS NULL").drop("g")

    # the words of both sides, in tiles, so that what is asked of a document is at most the document
    def tiles(lo: str, hi: str):
        return F.explode(F.sequence(F.floor(F.greatest(F.col(lo) - margin, F.lit(0)) / TILE), F.floor((F.col(hi) + margin - 1) / TILE)))

    asked = chains.select("id", "other", "lo", "olo", F.lit(0).alias("side"), F.col("id").alias("of"), tiles("lo", "hi").alias("tile")).union(
        chains.select("id", "other", "lo", "olo", F.lit(1).alias("side"), F.col("other").alias("of"), tiles("olo", "ohi").alias("tile"))
    )
    tile = T.StructType([T.StructField("of", kind), T.StructField("tile", T.LongType()), T.StructField("words", T.BinaryType())])

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for i, j in blocks(buffers(batch.column("text"))[1], 2 << 20):
                codes, first = words_of(batch.column("text").slice(i, j - i))
                row, number, raw = [], [], []
                for r in range(j - i):
                    for t in range(int(first[r]), int(first[r + 1]), TILE):
                        row.append(i + r)
                        number.append((t - int(first[r])) // TILE)
                        raw.append(codes[t : min(t + TILE, int(first[r + 1]))].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("of").take(pa.array(row, pa.int64())), pa.array(number, pa.int64()), pa.array(raw, pa.binary())], names=tile.names)

    wanted = saved(chains.select(F.col("id").alias("of")).union(chains.select("other")).distinct(), "wanted")
    texts = df.select(F.col(doc_id).alias("of"), F.col(text).alias("text")).where("of IS NOT NULL AND text IS NOT NULL")
    held = Bitmap(wanted, "of").marked(texts, "of", "hit").where("hit").drop("hit").mapInArrow(tidy(tiled), tile)
    # by sort and merge: Spark's estimate doesn't count the rows that a chain makes, and would broadcast them
    lines = asked.hint("merge").join(held.hint("merge"), ["of", "tile"]).select("id", "other", "lo", "olo", "side", "tile", "words", F.lit(None).cast("int").alias("hi"), F.lit(None).cast("int").alias("ohi"), F.lit(None).cast("binary").alias("x"), F.lit(None).cast("binary").alias("y"))
    heads = chains.select("id", "other", "lo", "olo", F.lit(-1).alias("side"), F.lit(0).cast("long").alias("tile"), F.lit(None).cast("binary").alias("words"), "hi", "ohi", "x", "y")
    order, keys = ["id", "other", "lo", "olo"], ["id", "other"]
    part = T.StructType([T.StructField("id", kind), T.StructField("other", kind), *(T.StructField(c, T.IntegerType()) for c in ("start", "end", "same", "size"))])

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_groups(batches, order):
            side, number = rows.column("side").to_numpy(), rows.column("tile").to_numpy()
            words, xs, ys = (rows.column(c).combine_chunks() for c in ("words", "x", "y"))
            at, out = [], []
            for i, j in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                sides = []
                for s in (0, 1):
                    own = {int(number[r]): words[r].as_py() for r in range(i, j) if side[r] == s}  # a repeated row brings its tiles again
                    base = min(own, default=0)
                    sides.append((base * TILE, np.frombuffer(b"".join(own[t] for t in sorted(own)), "<u8")))
                (a0, a), (b0, b) = sides
                x, y = (np.frombuffer(c[i].as_py(), "<i4") for c in (xs, ys))
                for s, e, t, f, same in align(a, b, x - a0, y - b0, k, max_gap, min_words):
                    if e - s >= least_part and same >= similarity * max(e - s, f - t):
                        at.append(i)
                        out.append((s + a0, e + a0, same, max(e - s, f - t)))
            if at:
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([rows.column("id").combine_chunks().take(take), rows.column("other").combine_chunks().take(take), *(pa.array([o[c] for o in out], pa.int32()) for c in range(4))], names=part.names)

    exact = exact_parts(found.where("g IS NOT NULL").select("g", "id", "lo", "hi"), min_words)
    parts = heads.union(lines.select(heads.columns)).repartition(*keys).sortWithinPartitions(*order, "side", "tile").mapInArrow(tidy(aligned), part).unionByName(exact)
    whole = T.StructType([T.StructField(doc_id, kind), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("first_ids", T.ArrayType(kind)), T.StructField("similarity", T.DoubleType())])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_groups(thick(batches), ["id"]):
            start, end, same, size = (rows.column(c).to_numpy() for c in ("start", "end", "same", "size"))
            other = rows.column("other").to_pylist()
            at, out = [], []
            for i, j in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                r = i
                while r < j:
                    last, to = r + 1, int(end[r])
                    while last < j and start[last] <= to + 2:
                        to = max(to, int(end[last]))
                        last += 1
                    if to - start[r] >= min_words:
                        at.append(i)
                        out.append((int(start[r]), to, sorted({*other[r:last]}), likeness(start[r:last], end[r:last], same[r:last], size[r:last])))
                    r = last
            if at:
                yield pa.RecordBatch.from_arrays([rows.column("id").combine_chunks().take(pa.array(at)), *(pa.array([o[c] for o in out], pa.int32()) for c in (0, 1)), pa.array([o[2] for o in out], pa.list_(rows.schema.field("id").type)), pa.array([o[3] for o in out], pa.float64())], names=whole.names)

    return saved(parts.repartition("id").sortWithinPartitions("id", "start", "end", "other").mapInArrow(tidy(merged), whole), "passages")


def without(df: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the words of the passages `found` cut from the text; a document that then has no word goes. Rows whose id
    has no passage are passed by as they are; a bitmap of the ids tells most of them. A null id or text stays as it is."""
    key, spans, hit = (fresh(c, df) for c in ("cut_id", "cut_spans", "cut_hit"))
    cuts = saved(found.groupBy(F.col(doc_id).alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(spans)), "cuts")
    marked = Bitmap(cuts, key).marked(df, doc_id, hit)
    joined = marked.where(hit).drop(hit).join(cuts, F.col(doc_id) == F.col(key), "left").drop(key)
    names, at = df.columns, df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spanned = batch.column(spans).to_pylist()
            keep = np.ones(batch.num_rows, bool)
            texts = batch.column(text).to_pylist() if any(spanned) else None
            for r, cuts in enumerate(spanned):
                if not cuts or texts[r] is None:
                    continue
                raw = np.frombuffer(texts[r].encode(), np.uint8)
                starts, stops, _ = word_spans(raw, np.array([0, len(raw)]))
                left = np.ones(len(raw), bool)
                stay = np.ones(len(starts), bool)
                for c in cuts:
                    s, e = c["start"], min(c["end"], len(starts))
                    if s < e:
                        left[starts[s] : stops[e - 1]] = False
                        stay[s:e] = False
                keep[r] = stay.any()
                texts[r] = raw[left].tobytes().decode()
            out = [pa.array(texts, pa.string()) if texts is not None and i == at else batch.column(c) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(out, names=names).filter(pa.array(keep))

    return joined.mapInArrow(tidy(run), df.schema).unionByName(marked.where(~F.col(hit)).select(*names))
