"""Language identification in two steps: the language family first, then, among the family's languages, one linear
support vector machine for each pair.

A text's features are the shares of its hashed grams of one to three bytes, of the lower-cased text with runs of ASCII
other than letters as one space. All machines are linear in the shares, so a whole text is scored by sums of weights
over its grams. Families are decided in the same way, by a machine for each pair of families. The class with most
votes wins; ties go to the larger sum of margins, then to the first name.

Machines are fitted on a bounded sample: about `fit_rows` texts of each language (documented bound), which a hash of
the id picks. Prediction covers all rows.

Edge cases: a text that is null or has no letter is `und` with score 0; with one known language every other text gets
it; with none, every text is `und`. Rows whose id is null are never learned from. Other columns pass through; those
named lang_pred or score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, buffers, hashed_share, tidy

#: Languages by family; a language that isn't listed is in the family `other`.
FAMILIES = {
    "germanic": "af da de en is lb nl nn no nb sv yi fy",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indo-iranian": "bn fa gu hi mr ne pa ur",
    "semitic": "ar he mt",
    "sinitic": "zh yue",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
BUCKETS = 4096
_LETTER = np.arange(256) >= 0x80
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all grams of the texts side by side, and the bounds of each text's."""
    data, bounds = buffers(pc.utf8_lower(texts.cast(pa.large_string())))
    letter = _LETTER[data]
    spaced = np.where(letter, data, np.uint8(0x20))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    heads = bounds[:-1][bounds[:-1] < len(data)]
    keep[heads] = letter[heads]  # not the space after another text's end
    to = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=to[1:])
    x, bounds = spaced[keep].astype(np.uint32), to[bounds]
    n = len(x)
    y = np.zeros(n + 2, np.uint32)
    y[:n] = x
    two = (x << np.uint32(8)) | y[1 : n + 1]
    three = (two << np.uint32(8)) | y[2:]
    out = np.empty((n, 3), np.uint16)
    for k, code in enumerate((x, two | np.uint32(1 << 24), three | np.uint32(1 << 25))):
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        code = (code ^ (code >> np.uint32(12))) * np.uint32(0x297A2D39)
        out[:, k] = (code ^ (code >> np.uint32(15))) & np.uint32(BUCKETS - 1)
    return out.ravel(), bounds * 3


def shares(texts: pa.Array) -> np.ndarray:
    """Features of each text."""
    code, bounds = grams(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    count = np.bincount(text * BUCKETS + code, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)
    return (count / np.maximum(np.diff(bounds), 1)[:, None]).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 300) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss, by dual coordinate descent. y: -1 or 1. Both
    classes weigh the same, however many rows they have."""
    rng = np.random.default_rng(7)
    slack = 0.5 / (c * len(y) / 2 / np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum())))
    norm = np.einsum("ij,ij->i", x, x) + slack
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1], np.float64)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(x)):
            gradient = y[i] * float(x[i] @ w) - 1 + alpha[i] * slack[i]
            step = max(alpha[i] - gradient / norm[i], 0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
                largest = max(largest, abs(step))
        if largest < 1e-4:
            break
    return w


class Duels:
    """One machine for each pair of classes."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.classes = sorted({*labels})
        self.pairs = [*combinations(range(len(self.classes)), 2)]
        at = np.array([self.classes.index(c) for c in labels])
        share = (1 / np.bincount(at)[at] / len(self.classes)).astype(np.float32)  # each class weighs the same
        mean = share @ x
        scale = 1 / (np.sqrt(share @ (x - mean) ** 2) + 1e-4)
        mean = mean * scale
        weights, biases = [], []
        for a, b in self.pairs:
            rows = (at == a) | (at == b)
            z = np.concatenate([x[rows] * scale - mean, np.ones((int(rows.sum()), 1), np.float32)], 1) / np.sqrt(x.shape[1])
            w = svm(z.astype(np.float32), np.where(at[rows] == a, 1.0, -1.0)) / np.sqrt(x.shape[1])
            weights.append(w[:-1] * scale)
            biases.append(w[-1] - w[:-1] @ mean)
        self.weights, self.biases = np.array(weights, np.float32).reshape(-1, x.shape[1]), np.array(biases)

    def decide(self, code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class index of each text, and how sure the votes are (0 to 1)."""
        n = len(bounds) - 1
        votes, margins, sure = np.zeros((n, len(self.classes))), np.zeros((n, len(self.classes))), np.ones((n, len(self.classes)))
        total = np.zeros(len(code) + 1)
        for (a, b), w, bias in zip(self.pairs, self.weights, self.biases, strict=True):
            np.cumsum(w[code], out=total[1:])
            m = np.diff(total[bounds]) / np.maximum(np.diff(bounds), 1) + bias
            p = 1 / (1 + np.exp(np.clip(-3 * m, -50, 50)))
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            for k, sign, q in ((a, 1, p), (b, -1, 1 - p)):
                margins[:, k] += sign * m
                sure[:, k] = np.minimum(sure[:, k], q)
        best = (votes + 1e-3 * np.tanh(margins / 100)).argmax(1)
        return best, sure[np.arange(n), best]


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        family = [FAMILY.get(lang, "other") for lang in langs]
        self.top = Duels(x, family)
        self.within = [Duels(x[[f == name for f in family]], [lang for lang, f in zip(langs, family, strict=True) if f == name]) for name in self.top.classes]

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        code, bounds = grams(texts)
        family, score = self.top.decide(code, bounds)
        lang = np.full(len(texts), "und", object)
        for k, duels in enumerate(self.within):
            best, sure = duels.decide(code, bounds)
            own = family == k
            lang[own] = np.array(duels.classes, object)[best[own]]
            score[own] *= sure[own]
        return lang, score


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = 500) -> Model | None:
    """The model of rows whose language isn't null; None if there are none."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & (F.col(lang) != "und"))
    count = {r[lang]: r["n"] for r in known.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    if not count:
        return None
    share = F.lit(False)
    for code, n in count.items():
        share = share | ((F.col(lang) == code) & hashed_share(F.col(doc_id), fit_rows / n))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in blocks(buffers(batch.column(text))[1], 1 << 20):
                x = shares(batch.column(text).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([batch.column(lang).slice(i, j - i).cast(pa.string()), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    rows = known.where(share & F.col(text).rlike(r"\p{L}")).select(text, lang).mapInArrow(tidy(run), schema).collect()
    if not rows:
        return None
    rows.sort()
    return Model(np.stack([np.frombuffer(r["x"], np.float32) for r in rows]), [r["lang"] for r in rows])


def identify(df: DataFrame, model: Model | None, text: str = "text", block_bytes: int = 1 << 20) -> DataFrame:
    """df with lang_pred and score (0 to 1)."""
    df = df.drop("lang_pred", "score")
    schema = T.StructType([*df.schema, T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for i, j in blocks(buffers(batch.column(text))[1], block_bytes):
                part = batch.slice(i, j - i)
                texts = part.column(text)
                none = ~np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
                lang, score = model.predict(texts) if model else (np.full(j - i, "und", object), np.zeros(j - i))
                lang[none], score[none] = "und", 0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], names=schema.names)

    return df.mapInArrow(tidy(run), schema)
