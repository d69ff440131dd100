"""Packing of token sequences by minimum bin slack.

Each partition is packed by itself, block after block, so nothing is shuffled. A document's ids, with the end id, give
as many full windows as they fill; what remains is an item. While items are left, the longest opens a window, and a
bitset subset-sum dynamic programme over the multiset of remaining lengths (bit s of an integer: some items sum to s)
finds the subset that leaves the least slack; the counts per length are backtracked from the bitsets of its steps and
the pattern is used as often as the counts allow. Slack that no subset fills is filled by cutting one more item, and
the block's last window is cut at powers of two, the lengths that are not padded.

Edge cases: a null or empty text is one piece that holds only the end id; a document longer than a window has several
pieces; repeated rows are packed each on its own; an empty partition has no sequence. sequence_id is the partition's
number times 2^32 plus a running number, so a task that runs again makes the same rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import merges
from .common import blocks, buffers, distinct_spans, run_lengths, tidy, word_hashes, word_spans

#: The pattern of the word vocabulary's pretokens.
WORD_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class WordLevel:
    """Whole texts to ids by a vocabulary of lower-cased words with word ends. Texts are cut at ASCII white space, and
    each distinct word is normalised and merged once."""

    def __init__(self, path: str):
        self.path, self.merges = path, merges(path)
        self.find = regex.compile(WORD_PARTS + "|\n").findall
        self.special = regex.compile("|".join(map(regex.escape, self.merges.special)) or "(?!)")
        few = np.uint16 if self.merges.size <= 1 << 16 else np.int32
        self.nothing = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, few), np.zeros(0, np.uint8))
        #: Words whose ids are kept: sorted hashes, where their ids begin and how many, where their bytes begin and how
        #: many, all ids, all bytes. Begun anew beyond most_known.
        self.memo, self.most_known = self.nothing, 500_000

    def parts(self, words: str) -> list[str]:
        """Pretokens of words that lie on a line each, with the ends of lines."""
        return self.find(unicodedata.normalize("NFC", words).replace("Σ", "σ").lower())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts side by side, and the bounds of each text's. Words met before in this process are known, by
        their hash and then by their bytes."""
        data, bounds = buffers(texts)
        starts, stops, first = word_spans(data, bounds)
        code, words = distinct_spans(data, starts, stops)
        raw, ends = buffers(words)
        length = np.diff(ends)
        keys = word_hashes(raw, ends[:-1], ends[1:])
        known, begin, size, spelt, letters, runs, every = self.memo
        place = np.searchsorted(known, keys)
        listed = np.append(known, np.uint64(0))[place] == keys
        listed[place == len(known)] = False
        same = np.flatnonzero(listed)
        same = same[letters[place[same]] == length[same]]
        if len(same):
            ours, to = run_lengths(ends, same)
            at = spelt[place[same]]
            theirs = np.arange(to[-1]) + np.repeat(at - to[:-1], length[same])
            same = same[~np.logical_or.reduceat(raw[ours] != every[theirs], to[:-1])]
        is_new = np.ones(len(keys), bool)
        is_new[same] = False
        new = np.flatnonzero(is_new)
        word_begin, word_size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        word_begin[same], word_size[same] = begin[place[same]], size[place[same]]
        if len(new):
            more, to = self.merged(raw, ends[:-1][new], ends[1:][new])
            word_begin[new], word_size[new] = to[:-1] + len(runs), np.diff(to)
            runs = np.concatenate([runs, more.astype(runs.dtype)])
            kept = new[~listed[new]]
            kept = kept[np.unique(keys[kept], return_index=True)[1]]
            take, to = run_lengths(ends, kept)
            both = np.concatenate([known, keys[kept]])
            order = np.argsort(both, kind="stable")
            joined = lambda a, b: np.concatenate([a, b])[order]
            self.memo = (both[order], joined(begin, word_begin[kept]), joined(size, word_size[kept]), joined(spelt, to[:-1] + len(every)), joined(letters, length[kept]), runs, np.concatenate([every, raw[take]]))
            if len(both) > self.most_known:
                self.memo = self.nothing
        to = np.zeros(len(code) + 1, np.int64)
        np.cumsum(word_size[code], out=to[1:])
        return runs[np.arange(to[-1]) + np.repeat(word_begin[code] - to[:-1], word_size[code])], to[first]

    def merged(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of data side by side, and their bounds."""
        ends = np.concatenate([[0], np.cumsum(stops - starts + 1)])
        lines = np.full(ends[-1], 0x0A, np.uint8)
        where = np.arange(ends[-1] - len(starts)) + np.repeat(np.arange(len(starts)), stops - starts)
        take, _ = run_lengths(np.stack([starts, stops], 1).ravel(), np.arange(len(starts)) * 2)
        lines[where] = data[take]
        words = lines.tobytes().decode()
        found = pa.array(self.parts(words), pa.string()).dictionary_encode()
        codes = found.indices.to_numpy().astype(np.int64)
        line_end = found.dictionary.index("\n").as_py()
        line_at = np.flatnonzero(codes == line_end)
        ids, id_ends = self.merges.merge(*buffers(found.dictionary))
        take, by_part = run_lengths(id_ends, codes[codes != line_end])
        ids, ends = ids[take], by_part[np.concatenate([[0], line_at - np.arange(len(line_at))])]
        return self.with_special(words, ids, ends) if self.special.search(words) else (ids, ends)

    def with_special(self, words: str, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The few words that hold a special token's string are encoded by the tokenizers library."""
        library = whole_tokenizer(self.path)
        runs = [ids[i:j] for i, j in zip(ends, ends[1:], strict=False)]
        for k, word in enumerate(words.split("\n")[:-1]):
            if self.special.search(word):
                runs[k] = np.array(library.encode(word, add_special_tokens=False).ids, ids.dtype)
        return np.concatenate(runs), np.concatenate([[0], np.cumsum([len(x) for x in runs])])


@lru_cache(4)
def whole_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(4)
def word_level(path: str) -> WordLevel:
    return WordLevel(path)


def least_slack(count: list[int], space: int, longest: int) -> list[tuple[int, int]]:
    """(length, times) of the multiset within count (by length) that fills space best."""
    reach, steps, mask = 1, [], (1 << (space + 1)) - 1
    for length in range(min(space, longest), 0, -1):
        left, times = count[length], 1
        while left and not reach >> space & 1 and times * length <= space:
            take = min(times, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            times *= 2
        if reach >> space & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return [*used.items()]


def pack_lengths(lengths: list[int], capacity: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences, each a list of (item, start, length), that hold each position of each item once."""
    stacks: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for i, n in enumerate(lengths):
        for s in range(0, n - n % capacity, capacity):
            yield [(i, s, capacity)]
        if n % capacity:
            stacks[n % capacity].append((i, n - n % capacity))
    count = [len(x) for x in stacks]
    longest = capacity - 1
    while True:
        while longest and not count[longest]:
            longest -= 1
        if not longest:
            return
        count[longest] -= 1
        fill = least_slack(count, capacity - longest, longest)
        count[longest] += 1
        used = dict(fill)
        used[longest] = used.get(longest, 0) + 1
        slack = capacity - sum(n * k for n, k in used.items())
        for _ in range(min(count[n] // k for n, k in used.items())):
            row = [(*stacks[n].pop(), n) for n, k in used.items() for _ in range(k)]
            for n, k in used.items():
                count[n] -= k
            if slack:
                # every item that is left is longer than the slack, or the subset would hold it
                if (cut := next((n for n in range(slack + 1, longest + 1) if count[n]), 0)) == 0:
                    yield from powers_of_two(row)
                    break
                i, s = stacks[cut].pop()
                count[cut] -= 1
                row.append((i, s, slack))
                stacks[cut - slack].append((i, s + slack))
                count[cut - slack] += 1
                yield row
                break
            yield row


def powers_of_two(row: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """row, cut into sequences whose lengths are powers of two."""
    total = sum(n for *_, n in row)
    row = row[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        space, out = (1 << bit) & total, []
        while space:
            i, s, n = row.pop()
            if n > space:
                row.append((i, s + space, n - space))
                n = space
            out.append((i, s, n))
            space -= n
        if out:
            yield out


def pack(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 1, block_tokens: int = 4 << 20, block_bytes: int = 2 << 20) -> DataFrame:
    """Pieces of all documents: the id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens,
    sequence_id and offset."""
    kind = df.schema[doc_id].dataType
    schema = T.StructType([T.StructField(doc_id, kind), T.StructField("start", T.LongType(), False), T.StructField("length", T.LongType(), False), T.StructField("ids", T.BinaryType(), False), T.StructField("doc_tokens", T.LongType(), False), T.StructField("sequence_id", T.LongType(), False), T.StructField("offset", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sequence = word_level(path), TaskContext.get().partitionId() << 32
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            if not held:
                return
            keys = pa.concat_arrays([x[0] for x in held])
            ids = np.concatenate([x[1] for x in held])
            sizes = np.concatenate([x[2] for x in held])
            begin = np.concatenate([[0], np.cumsum(sizes)])
            held.clear()
            item, start, length, seq, offset = [], [], [], [], []
            for row in pack_lengths(sizes.tolist(), capacity):
                at = 0
                for i, s, n in row:
                    item.append(i)
                    start.append(s)
                    length.append(n)
                    seq.append(sequence)
                    offset.append(at)
                    at += n
                sequence += 1
            item, start, length = (np.array(x, np.int64) for x in (item, start, length))
            seq, offset = np.array(seq, np.int64), np.array(offset, np.int64)
            for i, j in blocks(np.concatenate([[0], np.cumsum(length * 4)]), 8 << 20):
                source = begin[item[i:j]] + start[i:j]
                take, bounds = run_lengths(np.stack([source, source + length[i:j]], 1).ravel(), np.arange(j - i) * 2)
                raw = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(ids[take].astype("<u4"))])
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(item[i:j])), pa.array(start[i:j]), pa.array(length[i:j]), raw, pa.array(sizes[item[i:j]]), pa.array(seq[i:j]), pa.array(offset[i:j])], names=schema.names)

        total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, keys = batch.column(text), batch.column(doc_id)
            for i, j in blocks(buffers(texts)[1], block_bytes):
                ids, bounds = coder.encode(texts.slice(i, j - i))
                out = np.full(len(ids) + j - i, end_id, np.uint16 if coder.merges.size <= 1 << 16 else np.uint32)
                out[np.arange(len(ids)) + np.repeat(np.arange(j - i), np.diff(bounds))] = ids
                held.append((keys.slice(i, j - i), out, np.diff(bounds) + 1))
                total += len(out)
                if total >= block_tokens:
                    yield from packed()
                    total = 0
        yield from packed()

    return df.select(doc_id, text).mapInArrow(tidy(run), schema)
