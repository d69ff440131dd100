"""BPE encoding and decoding by a pair occurrence index.

A block of whole texts is cut into chunks that no token crosses; each distinct chunk is cut into pretokens, and each
distinct pretoken is merged once. All pretokens of a block lie in one array of symbols. An index maps each pair that
has a rank to all its positions. Active ranks are taken in ascending order from a heap; merging one changes the pairs
to its left and right, whose positions are added to the lists of their ranks. A merge's token occurs in later merges
only, so a taken rank never becomes active again, and the result is that of merging each pretoken alone.

Edge cases: a null or empty text has no ids; strings of special tokens in a text become those tokens, as the
tokenizers library does; ids that the vocabulary lacks raise an error when decoded. Every row is kept, repeated rows
each get their own result, other columns pass through. A text is handled whole; the unit of work is an Arrow batch,
cut into blocks of texts of `block_bytes`.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import blocks, buffers, run_lengths, tidy

#: The pattern of byte-level pretokens.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts where a space stands at an end or beside white space; elsewhere each space begins a pretoken.
ODD_SPACE = r"^ | $|[\s\x{1c}-\x{1f}\x{85}\p{Z}] | [\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Merges:
    """The vocabulary and merges of a tokenizer file, and the pair occurrence index over them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max(*vocab.values(), *self.special.values()) + 1
        pairs = [x if isinstance(x, list) else x.split(" ") for x in merges]
        self.left = [vocab[a] for a, _ in pairs]
        self.right = [vocab[b] for _, b in pairs]
        self.made = [vocab[a + b] for a, b in pairs]
        keys = np.array(self.left, np.int64) * self.size + np.array(self.right, np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = np.append(keys[self.order], np.iinfo(np.int64).max)
        self.order = np.append(self.order, -1)
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.last = np.array([vocab[x + self.suffix] for x in letters], np.int32)
        byte_of = {x: b for b, x in enumerate(letters)}
        held = [b""] * self.size
        for token, i in vocab.items():
            held[i] = bytes(byte_of[x] for x in token.removesuffix(self.suffix or "\0")) + b" " * bool(self.suffix and token.endswith(self.suffix))
        for token, i in self.special.items():
            held[i] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(held), np.uint8)
        self.token_bounds = np.concatenate([[0], np.cumsum([len(x) for x in held])])

    def ranks(self, a, b) -> np.ndarray:
        """The rank of each pair of symbols, or -1."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def merge(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pretokens whose bytes lie side by side, and their bounds."""
        n = len(data)
        sym = np.full(n + 1, -1, np.int32)
        sym[:n] = self.inner[data]
        ends = bounds[1:][bounds[1:] > bounds[:-1]] - 1
        sym[ends] = self.last[data[ends]]
        after = np.arange(1, n + 2, dtype=np.int32)
        after[ends] = n
        before = np.arange(-1, n, dtype=np.int32)
        before[ends[:-1] + 1] = n
        if n:
            before[0] = n
        inner = np.ones(n, bool)
        inner[ends] = False
        at = np.flatnonzero(inner)
        rank = self.ranks(sym[at], sym[at + 1])
        at, rank = at[rank >= 0], rank[rank >= 0]
        at = at[by := np.argsort(rank, kind="stable")]
        rank = rank[by]
        cuts = np.flatnonzero(np.diff(rank, prepend=-1))
        index: dict[int, list[int]] = defaultdict(list)
        for r, p in zip(rank[cuts].tolist(), np.split(at, cuts[1:]) if len(cuts) else [], strict=True):
            index[r] = p.tolist()
        active = list(index)
        heapq.heapify(active)
        rank_of, size = self.rank_of, self.size
        while active:
            r = heapq.heappop(active)
            spots = index.pop(r)
            a, b, new = self.left[r], self.right[r], self.made[r]
            if len(spots) < 6 or a == b:
                for p in sorted(spots):
                    q = int(after[p])
                    if sym[p] != a or sym[q] != b:
                        continue
                    sym[p], sym[q] = new, -2
                    after[p] = n2 = int(after[q])
                    if n2 < n:
                        before[n2] = p
                        x = rank_of.get(new * size + int(sym[n2]))
                        if x is not None:
                            if x not in index:
                                heapq.heappush(active, x)
                            index[x].append(p)
                    if (p0 := int(before[p])) < n:
                        x = rank_of.get(int(sym[p0]) * size + new)
                        if x is not None:
                            if x not in index:
                                heapq.heappush(active, x)
                            index[x].append(p0)
                continue
            p = np.array(spots)
            q = after[p]
            if not (ok := (sym[p] == a) & (sym[q] == b)).all():
                p, q = p[ok], q[ok]
            if not len(p):
                continue
            sym[p] = new
            sym[q] = -2
            n2 = after[q]
            after[p] = n2
            before[n2] = p
            p0 = before[p]
            s0, s2 = sym[p0], sym[n2]
            # a left neighbour that was merged in this step has this pair as its right one
            keys = np.concatenate([s0.astype(np.int64) * size + new, np.int64(new) * size + s2])
            where = np.concatenate([p0, p])
            ok = np.concatenate([(s0 >= 0) & (s0 != new), s2 >= 0])
            at = np.searchsorted(self.keys, keys)
            ok &= self.keys[at] == keys
            if not ok.any():
                continue
            for x, spot in zip(self.order[at[ok]].tolist(), where[ok].tolist(), strict=True):
                if x not in index:
                    heapq.heappush(active, x)
                index[x].append(spot)
        kept = sym[:n] >= 0
        to = np.zeros(n + 1, np.int64)
        np.cumsum(kept, out=to[1:])
        return sym[:n][kept], to[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that aren't UTF-8 become U+FFFD."""
        at, to = run_lengths(self.token_bounds, ids)
        raw = self.token_bytes[at].tobytes()
        ends = to[bounds].tolist()
        return [raw[i:j].decode("utf-8", "replace") for i, j in zip(ends, ends[1:], strict=False)]


@lru_cache(4)
def merges(path: str) -> Merges:
    return Merges(path)


class ByteLevel:
    """Whole texts to ids and back by a byte-level vocabulary."""

    def __init__(self, path: str):
        self.merges = merges(path)
        self.find = regex.compile(PRETOKENS).findall
        self.special = regex.compile("|".join(map(regex.escape, self.merges.special)) or "(?!)")

    def pretokens(self, chunk: str) -> list[str]:
        if not self.special.search(chunk):
            return self.find(chunk)
        out, i = [], 0
        for m in self.special.finditer(chunk):
            out += [*self.find(chunk[i : m.start()]), m[0]]
            i = m.end()
        return out + self.find(chunk[i:])

    def chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Chunks of all texts side by side, and for each text the bounds of its chunks."""
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        if pc.any(odd).as_py():
            lists = [self.pretokens(x) if o else [x[:j] if not i else x[i:j] for i, j in _cuts(x)] for x, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)]
            parts = pa.array(lists, pa.large_list(pa.large_string()))
            return parts.values, np.asarray(parts.offsets)
        parts = pc.split_pattern(texts, " ")
        bounds, flat = np.asarray(parts.offsets).astype(np.int64), parts.values
        data, ends = buffers(flat)
        first = np.zeros(len(flat), bool)
        first[bounds[:-1]] = True
        grown = ends + np.concatenate([[0], np.cumsum(~first)])
        out = np.full(grown[-1], 0x20, np.uint8)
        spaces = (grown[:-1])[~first]
        keep = np.ones(len(out), bool)
        keep[spaces] = False
        out[keep] = data
        return pa.LargeStringArray.from_buffers(len(flat), pa.py_buffer(grown.astype(np.int64)), pa.py_buffer(out)), bounds

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts side by side, and the bounds of each text's."""
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        flat, bounds = self.chunks(texts)
        coded = flat.dictionary_encode()
        chunks = coded.dictionary
        # chunks that begin with a space and hold no special token can be searched as one text
        plain = np.asarray(pc.starts_with(chunks, " "))
        if self.merges.special:
            plain &= ~np.asarray(pc.match_substring_regex(chunks, self.special.pattern))
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        data, chunk_ends = buffers(chunks.take(pa.array(order)))
        n_plain = int(plain.sum())
        found = self.find(data[: chunk_ends[n_plain]].tobytes().decode())
        for x in chunks.take(pa.array(order[n_plain:])).to_pylist():
            found += self.pretokens(x)
        parts = pa.array(found, pa.large_string())
        part_at = np.searchsorted(buffers(parts)[1], chunk_ends)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        words = parts.dictionary_encode()
        ids, ends = self.merges.merge(*buffers(words.dictionary))
        for k in np.flatnonzero(np.isin(words.dictionary.to_numpy(False), [*self.merges.special])) if self.merges.special else ():
            ids, ends = _replaced(ids, ends, int(k), self.merges.special[words.dictionary[int(k)].as_py()])
        word_at = words.indices.to_numpy().astype(np.int64)
        at, by_part = run_lengths(ends, word_at)
        chunk_ids, chunk_ends = ids[at], by_part[part_at]
        at, by_chunk = run_lengths(chunk_ends, place[coded.indices.to_numpy()])
        return chunk_ids[at], by_chunk[bounds]


def _cuts(text: str) -> list[tuple[int, int]]:
    at = [0, *(m.start() for m in regex.finditer(" ", text)), len(text)]
    return [*zip(at, at[1:], strict=False)]


def _replaced(ids: np.ndarray, ends: np.ndarray, k: int, by: int) -> tuple[np.ndarray, np.ndarray]:
    """ids with the run k replaced by one id."""
    i, j = int(ends[k]), int(ends[k + 1])
    ends = ends.copy()
    ends[k + 1 :] += 1 - (j - i)
    return np.concatenate([ids[:i], np.array([by], ids.dtype), ids[j:]]), ends


@lru_cache(4)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", block_bytes: int = 4 << 20) -> DataFrame:
    """df with the ids of each whole text in a column `out` (array of int, never null) instead of the text."""
    if out in df.columns:
        df = df.drop(out)
    schema = T.StructType([*(f for f in df.schema if f.name != text), T.StructField(out, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_level(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(text)
            for i, j in blocks(buffers(texts)[1], block_bytes):
                ids, bounds = coder.encode(texts.slice(i, j - i))
                arrays = [batch.column(f.name).slice(i, j - i) for f in schema.fields[:-1]]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*arrays, lists], names=schema.names)

    return df.mapInArrow(tidy(run), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "text", block_ids: int = 1 << 20) -> DataFrame:
    """df with the text of each list of ids in a column `out`; a null list has an empty text."""
    if out in df.columns:
        df = df.drop(out)
    schema = T.StructType([*df.schema, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = merges(path)
        for batch in batches:
            lists = batch.column(ids)
            bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))]).astype(np.int64)
            flat = lists.flatten()
            for i, j in blocks(bounds, block_ids) if batch.num_rows else ():
                texts = held.decode(flat.slice(bounds[i], bounds[j] - bounds[i]).to_numpy(False).astype(np.int64), bounds[i : j + 1] - bounds[i])
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(tidy(run), schema)
