"""Toxicity by weak supervision.

Voters: a fixed lexicon, words and word beginnings mined from labelled rows of the fitting folds for either class, and
patterns (shouted words, runs of exclamation marks). A generative label model (LabelModel) treats the true class as
hidden: it estimates each voter's rates of firing in both classes and the correlations of voters in each class, along a
forest of the strongest. It starts from the votes' majority; labels only choose the voters. Its posteriors, not the
labels, are the targets of a logistic regression over the presence of mined words and word beginnings, which scores
every whole text.

Fitted on a bounded sample (documented): about `fit_rows` labelled rows that a hash of the id picks. Of near copies in
the sample, which share their two least word hashes, one is used, so a copied text doesn't make its words evidence.
At most `most_features` are mined, each right in `precision` of its rows and beyond chance given how many were tried;
`most_voters` of them and the lexicon vote. Scoring covers all rows.

Words are runs of ASCII letters, digits and bytes over 0x7F of the lower-cased text. Edge cases: a null or empty text
has the score of a text without evidence; labels that are null, or for ids without a text, are left out; several
labels of one id count as the largest; without any label of one of the classes, or without any vote, the fixed lexicon
alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SpanHashes, blocks, buffers, hashed_share, mix, saved, tidy, word_spans

#: Fixed lexicon: plain insults in the corpus's languages.
LEXICON = """
idiot moron stupid dumb loser scum trash garbage pathetic worthless disgusting clown fool imbecile cretin
idiotisch dumm trottel abschaum versager widerlich dreck
imbécile stupide crétin connard débile ordure minable
idiota estúpido imbécil basura escoria inútil asqueroso
""".split()  # fmt: skip
#: Lengths in bytes of the word beginnings that may be voters.
BEGINNINGS = (4, 5, 6, 7)
_PART = np.ones(256, bool)
_PART[0x80:] = False
_PART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
_SHOUTS, _MARKS = np.uint64(1), np.uint64(2)


def features(texts: pa.Array, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature hash) of each text's words, word beginnings and patterns, with repeats; only those `among` a
    sorted list if one is given."""
    texts = texts.cast(pa.large_string())
    data, bounds = buffers(pc.utf8_lower(texts))
    starts, stops, first = word_spans(data, bounds, _PART)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    hashes = SpanHashes(data)
    where, found = [], []
    seen = None
    if among is not None:
        seen = np.zeros(1 << 18, bool)
        seen[among >> np.uint64(46)] = True

    def add(t: np.ndarray, h: np.ndarray) -> None:
        if seen is not None:
            ok = seen[h >> np.uint64(46)]
            t, h = t[ok], h[ok]
            ok = among[np.minimum(np.searchsorted(among, h), len(among) - 1)] == h if len(among) else np.zeros(len(h), bool)
            t, h = t[ok], h[ok]
        where.append(t)
        found.append(h)

    add(text, hashes.of(starts, stops))
    for k in BEGINNINGS:
        long = stops - starts > k
        add(text[long], hashes.of(starts[long], starts[long] + k) ^ np.uint64(0x5BD1E995 * k))
    for code, pattern in ((_SHOUTS, r"\b[A-Z]{4,}( [A-Z]{4,}){2,}"), (_MARKS, r"!{3,}")):
        hit = np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring_regex(texts, pattern), False)))
        add(hit, np.full(len(hit), mix(np.array([code], np.uint64))[0]))
    return np.concatenate(where), np.concatenate(found)


def hash_of(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return SpanHashes(data).of(np.array([0]), np.array([len(data)]))[0]


def distinct(where: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, code) once; codes are small."""
    if not len(where):
        return where, codes
    width = int(codes.max()) + 1
    both = np.unique(where * width + codes)
    return both // width, both % width


class LabelModel:
    """A generative model of votes with a hidden class, as a forest: given the class, a voter fires at a rate that depends
    on the vote of at most one other voter, its parent. Parameters are the class's share, each voter's rate of firing in
    each class (its accuracy), and on each edge its rates given that the parent fires or abstains (their correlation in
    each class). Edges are the maximum spanning forest of the pairs' information given the class, as far as it exceeds
    chance among all pairs; expectation maximisation fits the rest. It starts from the votes' majority, without labels.
    Alone, it would part texts by any strong pattern, such as how many voters fire. The prior keeps the classes' meaning:
    a voter is right in `accuracy` of its votes, alone or beside its parent's, with `belief` times its own votes' weight.

    Abstaining is evidence inside a tree of which a voter fires, and of all trees in a text without any vote. In a text
    with votes, trees without one say nothing: they are mostly another language's.

    votes: texts by voters, true where a voter fires; sides: the class, 1 or 0, that each voter speaks for."""

    def __init__(self, votes: np.ndarray, sides: np.ndarray, accuracy: float = 0.97, belief: float = 1.0, rounds: int = 60, structures: int = 2, chance: float = 0.05):
        rows, self.pattern, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
        self.pattern, v, self.chance = self.pattern.ravel(), rows.astype(np.float64), chance
        self.right = np.stack([np.where(sides > 0, 1 - accuracy, accuracy), np.where(sides > 0, accuracy, 1 - accuracy)])
        self.belief = belief
        lead = v @ np.where(sides > 0, 1.0, -1.0)
        p = np.where(lead > 0, 0.95, np.where(lead < 0, 0.02, 0.1))
        for tree in range(structures + 1):
            # at first voters are taken as independent, so that the classes' own traces aren't taken for correlations
            self.parent = self._forest(v, np.stack([count * (1 - p), count * p])) if tree else np.arange(v.shape[1])
            top = self.parent
            while (top[top] != top).any():
                top = top[top]
            self.tree = (top[:, None] == np.unique(top)).astype(np.float64)  # voters by trees
            for _ in range(rounds):
                self._rates(v, np.stack([count * (1 - p), count * p]))
                before, p = p, self.posterior(v)
                if np.abs(p - before).max() < 1e-5:
                    break
        self.p = p[self.pattern]

    def _forest(self, v: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The parent of each voter, itself for a root."""
        m = v.shape[1]
        g = np.zeros((m, m))
        for w in weights:
            both, one, n = (v * w[:, None]).T @ v, w @ v, w.sum()
            for cell, a, b in (
                (both, one[:, None], one),
                (one[:, None] - both, one[:, None], n - one),
                (one - both, n - one[:, None], one),
                (n - one[:, None] - one + both, n - one[:, None], n - one),
            ):
                cell = np.maximum(cell, 0)
                g += 2 * cell * np.log(np.where(cell > 0, cell * n, 1) / np.where(cell > 0, np.maximum(a * b, 1e-300), 1))
        i, j = np.triu_indices(m, 1)
        g = g[i, j]
        good = np.flatnonzero(g > 2 * np.log(max(1, len(g)) / self.chance))  # the chi-square's tail with two degrees
        near: list[list[int]] = [[] for _ in range(m)]
        tree = np.arange(m)
        for e in good[np.argsort(-g[good], kind="stable")]:
            a, b = int(i[e]), int(j[e])
            if tree[a] != tree[b]:
                tree[tree == tree[b]] = tree[a]
                near[a].append(b)
                near[b].append(a)
        parent, seen = np.arange(m), np.zeros(m, bool)
        for root in range(m):
            todo = [] if seen[root] else [root]
            seen[root] = True
            while todo:
                x = todo.pop()
                for y in near[x]:
                    if not seen[y]:
                        seen[y], parent[y] = True, x
                        todo.append(y)
        return parent

    def _rates(self, v: np.ndarray, weights: np.ndarray) -> None:
        """self.share of class 1; self.rate[class, voter]; self.given[class, parent's vote, voter]. A root's are its rate."""
        n = weights.sum(1)
        self.share = (n[1] + 0.5) / (n.sum() + 1)
        fires, joint = (self._believed(x, r) for x, r in ((weights @ v, self.right), (weights @ (v * v[:, self.parent]), (self.right + self.right[:, self.parent]) / 2)))
        self.rate = np.clip((fires + 0.05) / (n[:, None] + 1), 1e-6, 1 - 1e-6)
        up = fires[:, self.parent]
        alone, beside = (fires - joint, n[:, None] - up), (joint, up)
        given = np.stack([(a + (a.sum(0) + 0.05) / (of.sum(0) + 0.1)) / (of + 1) for a, of in (alone, beside)], 1)
        root = self.parent == np.arange(len(self.parent))
        self.given = np.clip(np.where(root, self.rate[:, None], given), 1e-6, 1 - 1e-6)

    def _believed(self, counts: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Counts by class, with the prior's: all of a voter's votes, parted by its prior accuracy."""
        return (counts + self.belief * counts.sum(0) * right) / (1 + self.belief)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability of class 1 of each text."""
        v = votes.astype(np.float64)
        fired = np.log(self.given[1] / self.given[0])
        silent = np.log((1 - self.given[1]) / (1 - self.given[0]))
        up = v[:, self.parent]
        shown = np.where(v.any(1)[:, None], v @ self.tree > 0, True)
        odds = np.log(self.share / (1 - self.share)) + shown @ (silent[0] @ self.tree)
        odds = odds + v @ (fired - silent)[0] + up @ (silent[1] - silent[0]) + (v * up) @ ((fired - silent)[1] - (fired - silent)[0])
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


class Model:
    """Hashes (sorted), their weights and the bias."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.hashes, self.weights, self.bias = hashes, weights, bias

    def score(self, texts: pa.Array) -> np.ndarray:
        where, found = features(texts, self.hashes)
        where, codes = distinct(where, np.searchsorted(self.hashes, found))
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(where, self.weights[codes], len(texts)), -50, 50)))


def lexicon_model() -> Model:
    hashes = np.sort(np.array([hash_of(x) for x in LEXICON], np.uint64))
    return Model(hashes, np.full(len(hashes), 3.0), -2.0)


def logistic(rows: np.ndarray, codes: np.ndarray, target: np.ndarray, k: int, ridge: float = 1e-5, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias fitted to soft targets by steps scaled for each weight (Adam), over all rows at once."""
    n = len(target)
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)  # the last is the bias
    w[k] = np.log((target.sum() + 0.5) / ((1 - target).sum() + 0.5))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(w[k] + np.bincount(rows, w[codes], n), -50, 50)))
        e = (p - target) / n
        g = np.append(np.bincount(codes, e[rows], k) + ridge * w[:k], e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w[:k], float(w[k])


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = 20_000, most_features: int = 4096, most_voters: int = 512, precision: float = 0.97) -> Model:
    """The model of `labels` (doc_id, label 0 or 1) over the texts of `documents`."""
    labels = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    share = fit_rows / max(1, labels.count())
    picked = F.broadcast(labels.where(hashed_share(F.col("id"), share)).groupBy("id").agg(F.max("y").alias("y")))  # at most about fit_rows rows
    own = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & hashed_share(F.col("id"), share))
    sample = saved(own.join(picked, "id"), "toxicity")
    schema = T.StructType([T.StructField("id", sample.schema["id"].dataType), T.StructField("key", T.LongType())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for i, j in blocks(buffers(batch.column("text"))[1], 2 << 20):
                data, bounds = buffers(pc.utf8_lower(batch.column("text").slice(i, j - i).cast(pa.large_string())))
                starts, stops, first = word_spans(data, bounds, _PART)
                h = SpanHashes(data).of(starts, stops)
                for a, b in zip(first, first[1:], strict=False):
                    least = np.unique(h[a:b])[:2]
                    keys.append(int(mix(least).sum(dtype=np.uint64).view(np.int64)) if len(least) else 0)
            if keys:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.int64())], names=["id", "key"])

    one = saved(sample.select("id", "text").mapInArrow(keyed, schema).groupBy("key").agg(F.min("id").alias("id")).join(sample, "id"), "toxicity")
    seen = T.StructType([T.StructField("h", T.LongType()), T.StructField("n1", T.LongType()), T.StructField("n0", T.LongType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in blocks(buffers(batch.column("text"))[1], 2 << 20):
                y = np.asarray(batch.column("y").slice(i, j - i))
                where, found = features(batch.column("text").slice(i, j - i))
                hashes, codes = np.unique(found, return_inverse=True)
                where, codes = distinct(where, codes)
                n1 = np.bincount(codes, y[where], len(hashes)).astype(np.int64)
                n0 = np.bincount(codes, 1 - y[where], len(hashes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n1), pa.array(n0)], names=["h", "n1", "n0"])

    size = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        return lexicon_model()
    rate = size[1] / (size[0] + size[1])
    total = one.select("text", "y").mapInArrow(counted, seen).groupBy("h").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where(f"greatest(n1, n0) >= 3 AND greatest(n1, n0) >= {precision} * (n1 + n0)")
    # evidence against chance: the log-likelihood ratio of the counts, which has to outweigh how many were tried
    both = F.col("n1") + F.col("n0")
    gain = sum(F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * r))).otherwise(0) for c, r in (("n1", rate), ("n0", 1 - rate)))
    # a voter's side is the class that it is found in more often than the class's share, not just more often
    total = total.withColumn("gain", gain).withColumn("side", (F.col("n1") >= precision * both).cast("int")).where(F.when(F.col("side") == 1, F.lit(True)).otherwise(F.col("n0") > both * (1 - rate)))
    total = saved(total, "toxicity")
    tried = {r["side"]: r["n"] for r in total.groupBy("side").agg(F.count("*").alias("n")).collect()}
    beyond = F.col("gain") > F.when(F.col("side") == 1, float(np.log(max(1, tried.get(1, 0))) + 4)).otherwise(float(np.log(max(1, tried.get(0, 0))) + 4))
    mined = total.where(beyond).orderBy(F.desc("gain"), "h").limit(most_features).collect()
    lexicon = {int(hash_of(x).view(np.int64)) for x in LEXICON}
    hashes = np.sort(np.array([*{r["h"] for r in mined} | lexicon], np.int64).view(np.uint64))
    voter = {r["h"]: r["side"] for r in mined[:most_voters]} | dict.fromkeys(lexicon, 1)
    votes = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("codes", T.ArrayType(T.IntegerType()))])

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in blocks(buffers(batch.column("text"))[1], 2 << 20):
                where, found = features(batch.column("text").slice(i, j - i), hashes)
                where, codes = distinct(where, np.searchsorted(hashes, found))
                ends = np.searchsorted(where, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes, pa.int32()))], names=["y", "codes"])

    rows = one.select("text", "y").mapInArrow(voted, votes).collect()  # as many as the sample's rows
    rows.sort(key=lambda r: r["codes"])
    at = np.repeat(np.arange(len(rows)), [len(r["codes"]) for r in rows])
    codes = np.array([c for r in rows for c in r["codes"]], np.int64)
    numbers = np.array([int(h) in voter for h in hashes.view(np.int64)])
    sides = np.array([voter[int(h)] for h in hashes.view(np.int64)[numbers]])
    cast = np.zeros((len(rows), len(sides)), bool)  # at most about fit_rows by most_voters and the lexicon
    votes_at = numbers[codes]
    cast[at[votes_at], (np.cumsum(numbers) - 1)[codes[votes_at]]] = True
    if not cast.any():
        return lexicon_model()
    posterior = LabelModel(cast, sides).p
    weights, bias = logistic(at, codes, posterior, len(hashes))
    return Model(hashes, weights, bias)


def score(df: DataFrame, model: Model, text: str = "text", block_bytes: int = 2 << 20) -> DataFrame:
    """df with score (0 to 1) and predicted (1 from 0.5 on)."""
    df = df.drop("score", "predicted")
    schema = T.StructType([*df.schema, T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for i, j in blocks(buffers(batch.column(text))[1], block_bytes):
                part = batch.slice(i, j - i)
                p = model.score(part.column(text))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    return df.mapInArrow(tidy(run), schema)
