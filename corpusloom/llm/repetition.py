"""Quality rules by repetition, found with suffix arrays over words.

The suffixes of all texts of a block are sorted by prefix doubling; a suffix is compared within its own text only, and
those that are already alone are left out of later rounds. The rounds' ranks give the longest common prefix of
neighbours by binary descent. A suffix's longest repeat is the deepest interval of common prefixes that holds it; left
out are those that the span one word before contains, so the spans that stay are the maximal repeated substrings. A
text is rejected if the union of spans of at least `min_repeat` words covers more than `max_covered` of its words, or
if one repeat is longer than `max_longest` words.

Words are `[^\\x20\\x09-\\x0D]+`, lines are parted by \\n. Edge cases: a null or empty text has no word, all counts
are zero and the base rules fail; a text of one repeated word is one repeat that overlaps itself; texts are measured
whole, and repeated rows each get their own result. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IS_SPACE, blocks, buffers, distinct_spans, tidy, word_spans

#: What measure() adds.
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
#: Words of a block from which on fewer ranks are kept.
LONG = 1 << 20
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


def longest_repeats(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word the number of words from it on that occur at another place of its text too. codes: of words (equal
    words have equal ones), side by side; first: bounds of texts."""
    n = len(codes)
    out = np.zeros(n, np.int32)
    if n < 2:
        return out
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stop = first[1:][text]
    key = text * (int(codes.max()) + 1) + codes
    order = np.argsort(key)
    key = key[order]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(begins, n))
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(begins, sizes)
    # ranks are kept of each round, of very long texts of each third one, which the descent then tries seven times
    levels, step, stride, rounds = [rank.copy()], 1, 1 if n < LONG else 3, 0
    tied = np.repeat(sizes > 1, sizes)
    slots = np.flatnonzero(tied)  # places of the suffix array that aren't settled
    shared = slots
    while len(slots):
        suffix = order[slots]
        ahead = suffix + step
        inside = ahead < stop[suffix]
        key = rank[suffix].astype(np.int64) * (n + 1)
        key[inside] += rank[ahead[inside]] + 1
        by = np.argsort(key)
        key, suffix = key[by], suffix[by]
        order[slots] = suffix
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(begins, len(key)))
        rank[suffix] = np.repeat(slots[begins], sizes)
        tied = np.repeat(sizes > 1, sizes)
        slots = slots[tied]
        step *= 2
        rounds += 1
        if len(slots) and rounds % stride == 0:
            levels.append(rank.copy())
    # common prefixes of neighbours in the suffix array that share a word
    shared = shared[1:][np.diff(shared) == 1]
    a, b = order[shared - 1], order[shared]
    near = levels[0][a] == levels[0][b]
    shared, a, b = shared[near], a[near], b[near]
    common = np.zeros(len(a), np.int32)
    for j in range(len(levels) - 1, -1, -1):
        for _ in range(2**stride - 1):
            x, y = a + common, b + common
            ok = np.maximum(x, y) < stop[a]
            ok[ok] = levels[j][x[ok]] == levels[j][y[ok]]
            common += ok.astype(np.int32) << (j * stride)
        levels.pop()
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def spans(longest: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal repeats of at least so many words."""
    before = np.concatenate([[0], longest[:-1]])
    before[first[:-1][np.diff(first) > 0]] = 0
    starts = np.flatnonzero((longest >= least) & (before <= longest))
    return starts, longest[starts]


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n words the union of spans covers."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def sums(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[bounds])


def measured(texts: pa.Array, min_repeat: int) -> list[np.ndarray]:
    """COLUMNS of each text."""
    data, bounds = buffers(texts)
    starts, stops, first = word_spans(data, bounds)
    longest = longest_repeats(distinct_spans(data, starts, stops)[0], first)
    repeated = covered(*spans(longest, first, 3), len(longest))
    union = covered(*spans(longest, first, min_repeat), len(longest))
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, np.repeat(np.arange(len(texts)), np.diff(first)), longest)
    ends = np.flatnonzero(data == 0x0A)
    line_starts, line_ends = np.sort(np.concatenate([bounds[:-1], ends + 1])), np.sort(np.concatenate([ends, bounds[1:]]))
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[with_word], line_ends[with_word]
    text = np.searchsorted(bounds, line_starts, "right") - 1
    line, lines = distinct_spans(data, line_starts, line_ends)
    _, at = np.unique(text * (len(lines) + 1) + line, return_index=True)
    again = np.ones(len(line), bool)
    again[at] = False
    n_dup_lines = np.bincount(text[again], minlength=len(texts))
    return [
        np.diff(first),
        sums(~IS_SPACE[data] & ((data & 0xC0) != 0x80), bounds),
        sums(SYMBOLS[data], bounds),
        n_dup_lines,
        sums(repeated, first),
        sums(union, first),
        most,
    ]


def measure(df: DataFrame, text: str = "text", min_repeat: int = 5, block_bytes: int = 2 << 20) -> DataFrame:
    """df with COLUMNS (long) beside its own; columns of df with such a name are replaced."""
    df = df.drop(*COLUMNS)
    schema = T.StructType([*df.schema, *(T.StructField(c, T.LongType(), False) for c in COLUMNS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for i, j in blocks(buffers(batch.column(text))[1], block_bytes):
                part = batch.slice(i, j - i)
                found = measured(part.column(text), min_repeat)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, pa.int64()) for x in found)], names=schema.names)

    return df.mapInArrow(tidy(run), schema)


def verdicts(df: DataFrame, text: str = "text", min_words: int = 50, max_repeat_share: float = 0.5, min_repeat: int = 5, max_covered: float = 0.35, max_longest: int = 200) -> DataFrame:
    """measure(), with base_failed (too few words, or too many in windows of three that occur twice) and kept."""
    df = measure(df, text, min_repeat)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 100 * max_repeat_share * F.col("n_words"))
    return df.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest))
