"""Each operator of the package against a brute-force version, an exact round trip or held-out accuracy, and with nulls,
empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import base64
import hashlib
import inspect
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from oracle import compare, connect
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from corpusloom.llm import bpe, chat, common, embeddings, language, packing, queries, repetition, simhash, substrings, toxicity, url_lists  # noqa: E402

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "  a  b ", "don't  stop\n\n now\t", "a<|endoftext|> b", " <|endoftext|>", "word <|endoftext|>foo", "x\u00a0y z\u3000w", "aaaa aaaaaaa aaa", "été ΣΑΣ 日本語 \U0001f600\U0001f600", "\x1c \x1da\x85 b", "12 345  6", "it's 'twas I'll İ é ́x", "| $ # <a> |", "A b A b A b A b", "z" * 5000, "lorem ipsum " * 3000]
CLASH = ["score", "ids", "fingerprint", "kept", "n_words", "blocked", "pattern", "lang_pred", "predicted"]


def documents(spark, texts, **more):
    """Rows with ids, one of them repeated and one without an id, and columns named like results."""
    rows = [(i, x, "en", f"s{i % 2}") for i, x in enumerate(texts)] + [(0, texts[0], "en", "s0"), (None, "no id here", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("mine"))
    return df


def empty(df):
    return df.where("false")


def oracle_of(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# 5: BPE


def test_bpe_encodes_and_decodes_like_the_library(spark):
    library = oracle_of(BYTES)
    df = documents(spark, ODD)
    rows = bpe.decode(bpe.encode(df.select("doc_id", "text", "source"), BYTES), BYTES).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        text = "no id here" if r.doc_id is None else ODD[r.doc_id] or ""
        want = library.encode(text, add_special_tokens=False).ids
        assert list(r.ids) == want and r.text == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(empty(df).select("doc_id", "text"), BYTES).count() == 0
    with pytest.raises(Exception, match="."):
        bpe.merges(BYTES).decode(np.array([10**6]), np.array([0, 1]))


def test_bpe_of_random_texts():
    library, coder = oracle_of(BYTES), bpe.byte_level(BYTES)
    rng = random.Random(5)
    texts = ["".join(rng.choices("aabbc  \n'séx1,.\u00a0\u4e2d", k=rng.randint(0, 60))) for _ in range(400)]
    ids, bounds = coder.encode(pa.array(texts))
    assert [ids[i:j].tolist() for i, j in zip(bounds, bounds[1:], strict=False)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


# 2: packing


def test_word_ids_like_the_library():
    library, coder = oracle_of(WORDS), packing.WordLevel(WORDS)
    rng = random.Random(6)
    texts = ODD + ["".join(rng.choices("aAbB c\n'sÉx1,.\u00a0\u4e2dΣ", k=rng.randint(0, 60))) for _ in range(300)]
    for _ in range(2):  # known words the second time
        ids, bounds = coder.encode(pa.array(texts))
        assert [ids[i:j].tolist() for i, j in zip(bounds, bounds[1:], strict=False)] == [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_packing_places_each_token_once(spark):
    library = oracle_of(WORDS)
    df = documents(spark, ODD)
    rows = packing.pack(df, WORDS, capacity=64).withColumn("crc", F.crc32("ids")).collect()
    texts = {i: x or "" for i, x in enumerate(ODD)} | {None: "no id here"}
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == 64 or at & (at - 1) == 0
    for key, own in pieces.items():
        want = np.array([*library.encode(texts[key], add_special_tokens=False).ids, 1], "<u4")
        copies = 2 if key == 0 else 1
        seen = Counter()
        for r in own:
            assert r.doc_tokens == len(want) and bytes(r.ids) == want[r.start : r.start + r.length].tobytes() and r.crc == zlib.crc32(bytes(r.ids))
            seen.update(range(r.start, r.start + r.length))
        assert [*seen.values()] == [copies] * len(want) and set(pieces) == set(texts)
    assert packing.pack(empty(df), WORDS).count() == 0


def test_least_slack_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        space, count = rng.randint(1, 60), [0] * 64
        for n in lengths:
            count[n] += 1
        sums = {0}
        for n in lengths:
            sums |= {s + n for s in sums if s + n <= space}
        found = packing.least_slack(count, space, 63)
        assert sum(n * k for n, k in found) == max(sums) and all(k <= count[n] for n, k in found)


# 3: repetition


def brute_repetition(text, k):
    text = text or ""
    w = WORD.findall(text)
    n = len(w)

    def covered(m):
        count, mark = Counter(tuple(w[i : i + m]) for i in range(n - m + 1)), [0] * n
        for i in range(n - m + 1):
            if count[tuple(w[i : i + m])] > 1:
                mark[i : i + m] = [1] * m
        return sum(mark)

    longest = 0
    while any(v > 1 for v in Counter(tuple(w[i : i + longest + 1]) for i in range(n - longest)).values()):
        longest += 1
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len({*lines}), covered(3), covered(k), longest]


def test_repetition_counts():
    rng = random.Random(3)
    texts = ODD[:18] + [" ".join(rng.choices(["a", "b", "c\n"], k=rng.randint(0, 60))) for _ in range(200)] + ["", None, "a\nb\na\n", "\na\n", "q " * 700]
    found = repetition.measured(pa.array(texts), 5)
    for i, t in enumerate(texts):
        assert [int(c[i]) for c in found] == brute_repetition(t, 5), t


def test_repetition_verdicts(spark):
    clean = " ".join(f"w{i}" for i in range(120))
    half = " ".join(f"w{i}" for i in range(60)) + " " + " ".join(f"v{i % 20}" for i in range(40))
    texts = [clean, half, "a b c " * 50, "few words", None]
    rows = {r.doc_id: r for r in repetition.verdicts(documents(spark, texts)).where("doc_id is not null").collect()}
    assert [(rows[i].base_failed, rows[i].kept) for i in range(5)] == [(False, True), (False, False), (True, False), (True, False), (True, False)]
    assert rows[4].n_words == 0 and repetition.verdicts(empty(documents(spark, texts))).count() == 0


def thue_morse(n, a, b):
    """Words of n letters that collide under sums of powers modulo 2^64, from 1,024 letters on."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word.translate(str.maketrans("ab", a + b))


PAIRS = [(thue_morse(n, "a", "b"), thue_morse(n, "b", "a")) for n in (1024, 2048)]


def test_words_and_lines_are_compared_by_bytes(spark):
    texts = [f"{a}\n{b}\n" for a, b in PAIRS] + [f"{a} x y {b} x y" for a, b in PAIRS] + [x for p in PAIRS for x in p]
    found = repetition.measured(pa.array(texts), 5)
    for i, t in enumerate(texts):
        assert [int(c[i]) for c in found] == brute_repetition(t, 5)
    library, coder = oracle_of(WORDS), packing.WordLevel(WORDS)
    for part in ([0, 1], [4], [5], [6], [7], [2, 3]):  # known words of other calls too
        ids, bounds = coder.encode(pa.array([texts[i] for i in part]))
        assert [ids[i:j].tolist() for i, j in zip(bounds, bounds[1:], strict=False)] == [library.encode(texts[i], add_special_tokens=False).ids for i in part]
    a = " ".join(x for k in range(60) for x in (f"{PAIRS[0][0]}", f"u{k}"))
    b = a.replace(PAIRS[0][0], PAIRS[0][1]).replace("u", "U")
    assert substrings.passages(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).count() == 0


def test_known_words_are_verified():
    """A word whose hash is another known word's is merged, not taken for it."""
    library, coder = oracle_of(WORDS), packing.WordLevel(WORDS)
    coder.encode(pa.array(["some known words"]))
    coder.memo = (np.sort(common.word_hashes(np.frombuffer(b"other", np.uint8), np.array([0]), np.array([5]))), *(x[:1] for x in coder.memo[1:5]), *coder.memo[5:])
    for _ in range(2):
        assert coder.encode(pa.array(["other words"]))[0].tolist() == library.encode("other words", add_special_tokens=False).ids


def test_very_long_texts_repeat(monkeypatch):
    rng = random.Random(4)
    texts = ["x " * 3000, " ".join(rng.choices("ab", k=2000)), "a b c d e f g " * 500]
    plain = [c.tolist() for c in repetition.measured(pa.array(texts), 5)]
    monkeypatch.setattr(repetition, "LONG", 10)
    assert [c.tolist() for c in repetition.measured(pa.array(texts), 5)] == plain
    assert plain[-1][0] == 2999 and plain[-1][2] == 3493


def test_word_hashes_and_distinct_spans():
    rng = random.Random(7)
    words = ["".join(rng.choices("ab\u00e9", k=rng.randint(1, 14))).encode() for _ in range(3000)]
    raw = np.frombuffer(b" ".join(words), np.uint8)
    starts, stops, _ = common.word_spans(raw, np.array([0, len(raw)]))
    h = common.word_hashes(raw, starts, stops)
    codes, distinct = common.distinct_spans(raw, starts, stops)
    assert [distinct[c].as_py() for c in codes] == words
    assert len({*zip(words, h.tolist(), strict=True)}) == len({*words}) == len({*h.tolist()})


def test_hashes_of_long_words_are_xxh64():
    rng = np.random.default_rng(7)
    raw = rng.integers(0, 256, 5000).astype(np.uint8)
    for size in range(9, 41):
        starts = np.append(np.sort(rng.integers(0, 5000 - size, 5)), 5000 - size)
        starts = starts[np.append(True, np.diff(starts) >= size)]
        want = [xxhash.xxh64_intdigest(raw[s : s + size].tobytes(), 7) for s in starts]
        assert common.word_hashes(raw, starts, starts + size).tolist() == want
    starts, size = np.sort(rng.integers(0, 4960, 3000)), rng.integers(0, 32, 3000)
    want = [xxhash.xxh64_intdigest(raw[s : s + n].tobytes(), 9) for s, n in zip(starts, size, strict=True)]
    assert common.xxh64_under_32(raw, starts, size, 9).tolist() == want


# 7: language


def test_language_of_held_out_texts(spark, small):
    found = queries.op7_language(spark, small)
    truth = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    rows = found.join(truth, "doc_id").where("held_out and n > 40").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark, small):
    model = language.fit(spark.read.parquet(f"{small}/documents.parquet"))
    df = documents(spark, ODD)
    rows = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (0, 1, 2, 3, 14)) and rows[4].lang_pred != "und"
    assert len(language.identify(df, model).columns) == len({*df.columns, "lang_pred", "score"})
    assert language.identify(empty(df), model).count() == 0
    assert language.fit(empty(df)) is None and language.identify(df, None).where("lang_pred <> 'und'").count() == 0
    one = language.fit(df.where("lang = 'en'").withColumn("text", F.lit("some words")))
    assert language.identify(df, one).where("doc_id = 4").first()["lang_pred"] == "en"


def test_machines_are_the_best_machines():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0.4, 1, (300, 6)), rng.normal(-0.4, 1, (40, 6))]).astype(np.float32)
    y = np.repeat([1.0, -1.0], [300, 40])
    w = language.svm(x, y, epochs=3000)
    c = np.where(y > 0, 340 / 2 / 300, 340 / 2 / 40)  # both classes weigh the same

    def cost(w):
        return 0.5 * w @ w + (c * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    direct = np.zeros(6)
    for _ in range(20000):  # the cost itself, by plain steps downhill
        direct -= 2e-4 * (direct - 2 * ((c * y * np.maximum(0, 1 - y * (x @ direct)))[:, None] * x).sum(0))
    assert np.abs(w - direct).max() < 1e-3 and cost(w) <= cost(direct) + 1e-3
    usual = language.svm(x, y)  # as many epochs as fit() takes
    assert cost(usual) <= 1.02 * cost(direct)


# 1: toxicity


def test_toxicity_of_held_out_texts(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randint(0, 40), rng.choice(["moron", "idiot", "zorkelA", "zorkelBx"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(0, 1), (10**6, 1), (5, None)], "doc_id long, toxic int")
    held = F.coalesce(common.fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.fit(docs, lab.where(~held))
    got = toxicity.score(docs, model).where(held).collect()
    wrong = [r for r in got if r.predicted != int(r.doc_id % 5 == 0)]
    assert len(wrong) <= 0.03 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_toxicity_edge_cases(spark):
    df = documents(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(df, none)
    rows = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert rows[0].score == rows[1].score and rows[0].predicted == 0 and toxicity.score(empty(df), model).count() == 0
    told = spark.createDataFrame([(1, "you idiot, you moron"), (2, "hello there")], "doc_id long, text string")
    assert [r.predicted for r in toxicity.score(told, model).orderBy("doc_id").collect()] == [1, 0]


def simulated_votes(n=6000, seed=4):
    """Classes and votes of voters with known rates: 0 to 4 speak for class 1, 5 mostly repeats 4, 6 speaks for class 0."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.3
    rates = np.array([[0.01, 0.5], [0.02, 0.4], [0.03, 0.6], [0.01, 0.3], [0.02, 0.5], [0, 0], [0.6, 0.02]])
    votes = rng.random((n, 7)) < rates.T[y.astype(int)]
    votes[:, 5] = np.where(votes[:, 4], rng.random(n) < 0.95, rng.random(n) < 0.002)
    return y, votes, rates, np.array([1, 1, 1, 1, 1, 1, 0])


def test_label_model_finds_rates_and_correlations_without_labels():
    y, votes, rates, sides = simulated_votes()
    model = toxicity.LabelModel(votes, sides)
    edges = {frozenset((j, int(p))) for j, p in enumerate(model.parent) if p != j}
    # texts taken for the wrong class make voters of the two sides look dependent, those of one side not
    assert frozenset((4, 5)) in edges and not [e for e in edges if e <= {0, 1, 2, 3, 4}]
    own = [0, 1, 2, 3, 4, 6]
    assert np.abs(model.rate.T - rates)[own].max() < 0.06 and abs(model.share - 0.3) < 0.06
    pair = 5 if model.parent[5] == 4 else 4
    assert (model.given[1, 1, pair] > 0.9) and (model.given[1, 0, pair] < 0.1)
    lead = votes @ np.where(sides > 0, 1, -1) > 0
    assert ((model.p > 0.5) == y).mean() >= max(0.93, (lead == y).mean())
    # a repeated voter counts as hardly more than one
    one, two = np.zeros((1, 7), bool), np.zeros((1, 7), bool)
    one[0, 4], two[0, [4, 5]] = True, True
    odds = [float(np.log(p / (1 - p))) for p in (model.posterior(one)[0], model.posterior(two)[0])]
    alone = np.log(model.rate[1, 5] / model.rate[0, 5])
    assert odds[1] - odds[0] < 0.5 * alone + np.log(20)


def test_label_model_posteriors_against_brute_force():
    _, votes, _, sides = simulated_votes(400, 8)
    model = toxicity.LabelModel(votes, sides)
    m = votes.shape[1]

    def top(j):
        while model.parent[j] != j:
            j = model.parent[j]
        return j

    for row, got in zip(votes[:60], model.posterior(votes[:60]), strict=True):
        fired = {top(j) for j in range(m) if row[j]}
        like = [1 - model.share, model.share]
        for c in (0, 1):
            for j in range(m):
                if not fired or top(j) in fired:
                    rate = model.given[c, int(row[model.parent[j]]), j]
                    like[c] *= rate if row[j] else 1 - rate
        assert abs(like[1] / sum(like) - got) < 1e-9


def test_label_model_without_votes_or_voters():
    for shape in ((5, 0), (5, 3), (1, 1)):
        model = toxicity.LabelModel(np.zeros(shape, bool), np.ones(shape[1], int))
        assert len(model.p) == shape[0] and ((0 <= model.p) & (model.p < 0.5)).all()


# 8: SimHash


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    count = [0] * 64
    for s in runs:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(runs))


def closure(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    assert simhash.fingerprints(pa.array(ODD)).tolist() == [brute_fingerprint(t) for t in ODD]


def test_fingerprint_links(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(30)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(25)} | {0, 1, 3, 7, (1 << 64) - 1}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in [*signed, signed[0], None]], "fingerprint long")
    for most in (2, 1, 0):
        got = sorted(tuple(r) for r in simhash.links(df, most=most).collect())
        assert got == sorted((a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= most)
    with pytest.raises(ValueError, match="two"):
        simhash.links(spark.createDataFrame([(1,)], "fingerprint long"), most=3)


def test_fingerprint_cells_are_not_broadcast(spark):
    """Each fingerprint makes about 50 cells, which Spark's estimate doesn't count, so few fingerprints look small."""
    df = common.saved(spark.range(2000).select(F.xxhash64("id").alias("fingerprint")))
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    pairs = simhash.links(df)
    assert pairs.count() == 0 and "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_simhash_components(spark):
    base = " ".join(f"w{i}" for i in range(300))
    texts = [*ODD, base, base.replace("w7 ", "x7 "), base.upper()]
    df = documents(spark, texts)
    rows = simhash.near_duplicates(df).collect()
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = closure([(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2], prints)
    assert {r.doc_id: r.component_id for r in rows} == {**want, None: None} and len(rows) == len(texts) + 2
    assert simhash.near_duplicates(empty(df)).count() == 0


# 6: embeddings


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((25, 16))
    rows = [(i, [float(x) for x in centres[i % 25] + rng.standard_normal(16) * (0.05 if i < 150 else 0.6)], i % 3) for i in range(250)]
    rows += [(900 + i, rows[7][1], rows[7][2]) for i in range(5)]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [1.0] * 16, None), (1004, [float("inf")] + [1.0] * 15, 1), (1005, [], 1), (1006, [1.0] * 3, 1), (1007, [None] + [1.0] * 15, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("mine")).withColumn("v", F.lit(1))
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, block=8).collect()}
    plain = {i: (np.array(v, np.float32).astype(float), l) for i, v, l in rows}
    pairs = [(a, b) for a in plain for b in plain if a < b and plain[a][1] == plain[b][1] and plain[a][0] @ plain[b][0] / np.linalg.norm(plain[a][0]) / np.linalg.norm(plain[b][0]) >= 0.93]
    degree, want = Counter(x for p in pairs for x in p), closure(pairs, plain)
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items() if i < 1000} == {i: (degree[i], want[i], want[i] == i) for i in plain}
    assert all(got[i][0].n_links == 0 if isinstance(got[i], list) else got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, *_ in odd)
    assert embeddings.near_duplicates(empty(df)).count() == 0


def test_passes_grow_with_the_largest_label():
    for n in (10**3, 10**5, 10**6, 10**7):
        passes = embeddings.passes_for(n, 0.93, 32, 0.999)
        share = (1 - np.arccos(0.93) / np.pi) ** np.log2(n / 32)
        assert passes >= 20 and 1 - (1 - share) ** passes >= 0.999
    assert embeddings.passes_for(0, 0.93, 32, 0.999) == embeddings.passes_for(1, 1.0, 32, 0.999) == 20


def test_windows_go_on_over_partition_ends(spark):
    """Vectors of a hair's breadth around one: all neighbours link, so one component however the order is cut."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in 1 + rng.standard_normal(16) * 0.01], 1) for i in range(120)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), passes=1, window=4).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.component_id for r in got} == {0} and {r.n_links for r in got} == {119}


@pytest.mark.parametrize("shared", [0.0, 2.0])
def test_links_of_large_labels_are_found(spark, shared):
    """20,000 vectors of one label, without and with a shared direction (background cosine 0.8), and close pairs."""
    rng = np.random.default_rng(5)
    n, dim = 20_000, 64
    base = rng.standard_normal((n // 2, dim)) / np.sqrt(dim)
    drift = rng.standard_normal((n // 2, dim)) / np.sqrt(dim)
    angle = np.arccos(0.955 if not shared else 0.75)
    other = np.cos(angle) * base + np.sin(angle) * drift
    x = np.concatenate([base, other])
    x[:, 0] += shared
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links, found = 0, 0
    for i in range(0, n, 2000):
        a, b = np.nonzero(u[i : i + 2000] @ u.T >= 0.93)
        for p, q in zip((a + i).tolist(), b.tolist(), strict=True):
            if p < q:
                links += 1
                found += got[p].component_id == got[q].component_id
    assert links > 2000 and found >= 0.99 * links
    assert embeddings.recall_of(df, spark.createDataFrame([*got.values()]), "vec_id % 500 = 0") >= 0.99


def test_exact_counts_of_a_component(spark):
    """A chain of overlapping clusters in one component, in small blocks: counts by bounds and by comparison agree."""
    rng = np.random.default_rng(6)
    turn = np.repeat(np.linspace(0, 1.2, 30), 10)
    x = np.stack([np.cos(turn), np.sin(turn), np.zeros(300), np.zeros(300)], 1) + rng.standard_normal((300, 4)) * 0.03
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    copies = rng.integers(1, 4, 300)
    want = (near & ~np.eye(300, dtype=bool)) @ copies
    df = spark.createDataFrame([(0, i, int(copies[i]), x[i].tolist()) for i in range(300)], "component long, first long, copies long, v array<double>")
    for size in (4, 64, 1000):
        assert {r["first"]: r.linked for r in embeddings.exact_counts(df, 0.93, size).collect()} == dict(enumerate(want.tolist()))


# 9: url lists


def test_url_lists_match_sql(spark, small):
    assert compare(queries.op9_url_lists(spark, small), connect(small), queries.ORACLES["op9_url_lists"]) == ""


def test_url_lists_edge_cases(spark):
    at = lambda d: f"2024-01-{d:02} 00:00:00"
    rows = [("l", "domain", "b.com", "block", "add", at(5)), ("l", "domain", "b.com", "block", "remove", at(10)), ("l", "domain", "b.com", "block", "remove", at(20)), ("l", "domain", "b.com", "block", "add", at(20)), ("m", "prefix", "a.b.com/x/y", "allow", "add", at(1)), ("m", "host", "c.org", "block", "add", at(1)), ("l", None, "b.com", "block", "add", at(1))]
    events = spark.createDataFrame(rows, "list string, kind string, pattern string, verdict string, action string, at string").withColumn("at", F.to_timestamp("at"))
    urls = [("https://a.B.com./z", 4), ("https://a.b.com/z", 5), ("http://u:p@b.com:80/?q", 9), ("https://a.b.com/z", 10), ("https://a.b.com/z", 21), ("https://a.b.com/x/y/z?q", 21), ("https://a.b.com/x/yy", 21), ("https://sub.c.org", 21), ("https://c.org#f", 21), (None, 21), ("nonsense", 21), ("https://xb.com", 21)]
    df = spark.createDataFrame([(i, u, at(d)) for i, (u, d) in enumerate(urls)] + [(1, urls[1][0], at(5)), (99, "https://b.com", None)], "id long, url string, t string").withColumn("fetched_at", F.to_timestamp("t")).withColumn("blocked", F.lit("mine")).withColumn("k", F.lit(1)).withColumn("p", F.lit(1))
    got = url_lists.judge(df, events)
    rows = {r.id: r for r in got.collect()}
    assert [i for i in range(12) if rows[i].blocked] == [1, 2, 4, 6, 8] and got.count() == 14 and not rows[99].blocked
    assert rows[5].n_active == 2 and rows[5].pattern == "a.b.com/x/y" and rows[5].lists == "l,m" and not rows[5].blocked
    assert url_lists.judge(empty(df), events).count() == 0 and url_lists.judge(df, empty(events)).where("blocked").count() == 0
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_url_lists_clashing_columns_and_long_urls(spark):
    t = lambda d: f"2024-01-{d:02} 00:00:00"
    deep = "c.org/" + "/".join("p" * 3)
    events = spark.createDataFrame([("l", "prefix", deep, "block", "add", t(1)), ("l", "domain", "b.com", "block", "add", t(1))], "list string, kind string, pattern string, verdict string, action string, at string").withColumn("at", F.to_timestamp("at"))
    urls = ["https://b.com/" + "a/" * 20_000, "https://c.org/p/p/p/" + "q/" * 20_000, "https://c.org/p/p"]
    df = spark.createDataFrame([*enumerate(urls)], "id long, url string").withColumn("fetched_at", F.to_timestamp(F.lit(t(3))))
    for c in ("top", "c_url", "c_at", "told", "hit", "n", "list", "verdict"):
        df = df.withColumn(c, F.lit("mine"))
    rows = url_lists.judge(df, events).orderBy("id").collect()
    assert [(r.blocked, r.n_active, r.pattern, r.lists, r.top, r.c_url, r.told) for r in rows] == [(True, 1, "b.com", "l", "mine", "mine", "mine"), (True, 1, deep, "l", "mine", "mine", "mine"), (False, 0, None, "", "mine", "mine", "mine")]


# 10: substrings


def passage_fixture(spark, extra=()):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    shared = [word() for _ in range(80)]
    fuzzy = shared[:25] + ["edited"] + shared[26:60] + shared[61:]
    texts = []
    for i in range(30):
        body = [word() for _ in range(rng.randint(60, 300))]
        if i % 3 == 0:
            at = rng.randint(0, len(body))
            body[at:at] = shared if i % 2 else fuzzy
        if i % 5 == 1:
            body += shared[:12]  # too short to matter
        texts.append(" ".join(body) if i % 2 else "\n".join(body))
    return documents(spark, [*texts, *extra]), texts, {*shared}


def test_passages_are_found_and_clean_texts_left(spark):
    df, texts, shared = passage_fixture(spark, [None, "", "x " * 400, "x " * 400, "short"])
    rows = substrings.passages(df).collect()
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id].append((r.start, r.end))
        assert r.similarity >= 0.8 and r.end - r.start >= 50 and all(f < r.doc_id for f in r.first_ids)
    assert {*found} == {*range(3, 30, 3)} | {33}
    for i in range(3, 30, 3):
        words, ((s, e),) = texts[i].split(), found[i]
        at = [k for k, w in enumerate(words) if w in shared]
        assert abs(s - at[0]) <= 3 and abs(e - (at[0] + 80)) <= 4
    assert substrings.passages(empty(df)).count() == 0


def test_passages_are_cut(spark):
    df, texts, shared = passage_fixture(spark, ["only", None])
    out = {r.doc_id: r.text for r in substrings.without(df, substrings.passages(df)).where("doc_id is not null").collect()}
    assert out[0] == texts[0] and out[1] == texts[1] and out[31] is None
    for i in range(3, 30, 3):
        kept = out[i].split()
        assert sum(w in shared for w in kept) <= 20 and len(kept) >= len(texts[i].split()) - 84
    assert substrings.without(df, substrings.passages(empty(df))).count() == df.count()


@pytest.mark.parametrize("size", [50, 60, 100])
@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9, 0.95])
def test_edited_passages_have_chains(size, similarity):
    """Candidates: the share of edited passages whose common seeds, by brute force over all runs, make a chain of 10 words."""
    rng = np.random.default_rng(6)
    default = inspect.signature(substrings.passages).parameters["window"].default
    missed = 0
    for _ in range(100):
        a, b = rng.integers(1, 2**62, (2, size + 80)).astype(np.uint64)
        b[40 : 40 + size] = a[40 : 40 + size]
        at = 40 + rng.choice(size, round(size * (1 - similarity)), replace=False)
        b[at] = rng.integers(1, 2**62, len(at)).astype(np.uint64)
        runs = lambda w: {tuple(w[i : i + 5].tolist()): i for i in range(len(w) - 4)}
        x, y = runs(a), runs(b)
        want = sorted(y[r] for r in x.keys() & y.keys())
        _, _, h = substrings.seeds_of(a, np.array([0, len(a)]), 5, default)
        _, p, g = substrings.seeds_of(b, np.array([0, len(b)]), 5, default)
        got = sorted(p[np.isin(g, h)].tolist())
        missed += bool(want) and want[-1] - want[0] >= 5 and (not got or got[-1] - got[0] < 5)
    assert missed == 0


def test_tiles_asked_for_are_not_broadcast(spark):
    """Each chain asks for several tiles, which Spark's estimate doesn't count, so few chains look small."""
    kept, write = [], common.saved
    line = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(i, f"{i} {line} {i}") for i in range(6)], "doc_id long, text string")

    def seen(frame, name="t"):
        kept.append((name, frame._jdf.queryExecution().executedPlan().toString()))
        return write(frame, name)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(substrings, "saved", seen)
        assert substrings.passages(df).count() == 5
    plan = dict(kept)["passages"]
    assert re.search(r"SortMergeJoin \[of#\d+L?, tile#\d+L?\]", plan) and not re.search(r"BroadcastHashJoin \[of#\d+L?, tile#\d+L?\]", plan)


def test_links_are_sorted_packed(spark):
    """Spark's sort sees buckets of packed links, not a row for each link."""
    kept, write = [], common.saved
    df, _, _ = passage_fixture(spark)

    def seen(frame, name="t"):
        kept.append((name, frame._jdf.queryExecution().executedPlan().toString()))
        return write(frame, name)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(substrings, "saved", seen)
        assert substrings.passages(df).count() == 9
    plan = dict(kept)["chains"]
    assert set(re.findall(r"Sort \[(\w+)", plan)) == {"bucket"} and plan.count("MapInArrow") == 3


@pytest.mark.parametrize("kind", [pa.int64(), pa.string()])
def test_links_come_by_id_from_any_number_of_shares(kind):
    """Buckets too large to be unpacked at once, several packs with some ids in common, pieces of few rows."""
    rng = np.random.default_rng(3)
    want, rows = set(), []
    for bucket in range(3):
        for _ in range(4):
            ids = pa.array(np.unique(rng.integers(0, 40, 25)) * 3 + bucket).cast(kind)
            a, b = rng.integers(0, len(ids), (2, 200))
            at, there, h = rng.integers(0, 1 << 30, (3, 200))
            rows.append((bucket, False, *substrings.packed(ids, [a, b], [at, there, h])))
            name = ids.to_pylist()
            want |= {(name[i], name[j], *n) for i, j, *n in zip(a, b, at.tolist(), there.tolist(), h.tolist(), strict=True)}
    batch = pa.RecordBatch.from_pylist([dict(zip(("bucket", "local", "size", "value"), r, strict=True)) for r in rows])
    for most, piece in ((1 << 24, 1 << 16), (1 << 24, 50), (3000, 50)):
        got, seen = [], []
        for ids, (a, b, *numbers) in substrings.links_by_id(iter([batch.slice(0, 5), batch.slice(5)]), kind, most, piece):
            name = ids.to_pylist()
            part = [(name[i], name[j], *n) for i, j, *n in zip(a, b, *(c.tolist() for c in numbers), strict=True)]
            assert part == sorted(part)
            got += part
            seen += sorted({r[0] for r in part})
        assert len(got) == 2400 and {*got} == want and len(seen) == len({*seen})


def test_hashes_are_sorted_stably():
    rng = np.random.default_rng(4)
    for h in (rng.integers(0, 300, 1000), rng.integers(0, 1 << 63, 1000), np.repeat(rng.integers(0, 1 << 63, 50), 20) + np.tile([0, 1], 500), np.zeros(0, int), np.zeros(1, int)):
        for x in (h.astype(np.uint64), (h >> 1).astype(np.int64)):
            assert (substrings.by_hash(x) == np.argsort(x, kind="stable")).all()


def test_edited_passages_are_found(spark):
    """Passages of 50 to 100 words with single words edited, inside other words: the share found."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    texts, cases = [], []
    for size in (50, 60, 100):
        for similarity in (0.8, 0.85, 0.9, 0.95):
            for _ in range(25):
                a = [word() for _ in range(size)]
                b = list(a)
                for at in rng.sample(range(1, size - 1), round(size * (1 - similarity))):
                    b[at] = word()
                pad = lambda: [word() for _ in range(60)]
                texts += [" ".join(pad() + a + pad()), " ".join(pad() + b + pad())]
                cases.append((size, similarity, len(texts) - 1))
    rows = substrings.passages(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    found = {r.doc_id for r in rows if r.end > 60 and r.start < 60 + 100}
    share = {(n, s): sum(i in found for m, t, i in cases if (m, t) == (n, s)) / 25 for n, s, _ in cases}
    assert {r.doc_id for r in rows} <= {i for _, _, i in cases}
    assert all(v == 1 if s >= 0.9 else v >= 0.9 if n >= 60 else v >= 0.6 for (n, s), v in share.items()), share


def test_exact_passages_of_lines_from_elsewhere_are_found(spark):
    """Each line of a passage that two documents share occurs first in another document."""
    rng = random.Random(5)
    words = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(n)]
    for size in (10, 12, 15, 18):
        lines = [words(size) for _ in range(-(-54 // size))]
        texts = [words(20) + line + words(20) for line in lines]
        passage = sum(lines, [])
        texts += [words(30) + passage + words(30), words(70), words(40) + passage + words(10)]
        rows = substrings.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
        b, c = len(lines), len(lines) + 2
        assert [(r.doc_id, r.start, r.end, r.first_ids, r.similarity) for r in rows] == [(c, 40, 40 + len(passage), [b], 1.0)]


def test_entries_meet_across_blocks_and_buckets(spark, monkeypatch):
    """However texts are cut into blocks and partitions, all places of shared seeds come out, with an earlier holder."""
    rng = random.Random(12)
    texts = [" ".join(rng.choices("abcd", k=rng.randint(0, 60))) for _ in range(60)]
    runs = [[tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)] for t in texts]
    holders = defaultdict(set)
    for i, own in enumerate(runs):
        for r in own:
            holders[r].add(i)
    want = {(i, x) for i, own in enumerate(runs) for x, r in enumerate(own) if len(holders[r]) > 1}
    for kind, name in (("long", lambda i: i), ("string", lambda i: f"d{i:03}")):
        df = spark.createDataFrame([(name(i), t) for i, t in enumerate(texts)], f"doc_id {kind}, text string").repartition(7)
        number = {name(i): i for i in range(len(texts))}
        for size in (200, 1 << 20):
            rows = substrings.links(df, "doc_id", "text", 5, block_bytes=size).collect()
            assert {(number[r.id], r["at"] // 2) for r in rows} == want
            for r in rows:
                i, j = number[r.id], number[r.other]
                assert j <= i and runs[i][r["at"] // 2] == runs[j][r.there // 2]
                assert j < i or i == min(holders[runs[i][r["at"] // 2]]) or r["at"] % 2 == 0


def test_bitmap_misses_no_id(spark):
    ids = spark.range(0, 3000, 3)
    for bits in (1 << 15, 1 << 20):
        found = common.Bitmap(ids, "id", bits).marked(spark.range(3000).withColumn("page", F.lit(1)), "id", "hit").where("hit")
        rows = {r.id for r in found.collect()}
        assert rows >= {*range(0, 3000, 3)} and len(rows) < 1250 and found.columns == ["id", "page", "hit"]
    assert common.Bitmap(ids.where("false"), "id").marked(ids, "id", "hit").where("hit").count() == 0


def test_columns_named_like_ours_pass(spark):
    df, texts, _ = passage_fixture(spark)
    df = df.withColumn("cut_id", F.lit(7)).withColumn("cut_spans", F.lit("mine")).withColumn("cut_hit", F.lit(1)).withColumn("page", F.lit(2)).withColumn("bits", F.lit(3))
    out = substrings.without(df, substrings.passages(df))
    row = out.where("doc_id = 3").first()
    assert out.columns == df.columns and (row.cut_id, row.cut_spans, row.cut_hit, row.page, row.bits) == (7, "mine", 1, 2, 3) and len(row.text) < len(texts[3])


def test_anchors_side_by_side_are_one_part():
    """Matches with nothing between them aren't compared word by word, and count as the words they are."""
    a = np.arange(1, 401, dtype=np.uint64)
    b = np.concatenate([a[:200], np.arange(1000, 1003, dtype=np.uint64), a[200:]])
    x = np.append(np.arange(0, 200, 5), np.arange(200, 400, 5))
    y = x + 3 * (x >= 200)
    with pytest.MonkeyPatch.context() as patch:
        calls, prefix = [], substrings.common_prefix
        patch.setattr(substrings, "common_prefix", lambda u, v: calls.append(1) or prefix(u, v))
        assert substrings.align(a, b, x, y, 5, 16) == [(0, 400, 0, 403, 400)]
    assert len(calls) < 10


def test_thinned_matches_hold_the_same_words():
    rng = np.random.default_rng(2)
    for _ in range(100):
        x, y = rng.integers(0, 40, (2, 60))
        x, y = np.concatenate([x, np.arange(50, 80)]), np.concatenate([y, np.arange(10, 40)])
        left = substrings.thinned(x, y, 5)
        held = lambda at: {(x[i] + t, y[i] + t) for i in at for t in range(5)}
        assert held(left) == held(range(len(x))) and len(left) < len(x) - 20


def test_chain_is_the_best_chain():
    rng = random.Random(4)
    for _ in range(100):
        n = rng.randint(1, 8)
        points = sorted({(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(n)})
        x, y = [p[0] for p in points], [p[1] for p in points]
        paths = substrings.chain(x, y, 5)
        assert sorted(i for p in paths for i in p) == [*range(len(points))]
        for p in paths:
            assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(p, p[1:], strict=False)) or len(p) == 1 or len({b - a for a, b in points}) == 1


# 4: chat


def test_chat_round_trip(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, "user", "hi"), (1, 1, "assistant", "<turn user>\\"), (1, 2, "user", None), (2, 0, "user", "hi"), (2, 1, "assistant", "<turn user>\\"), (2, 2, "assistant", "é\U0001f600 <|endoftext|>"), (3, 0, "user", "hi"), (3, 1, "assistant", "<turn user>\\"), (3, 2, "user", None), (4, 0, None, ""), (4, 0, None, ""), (5, 0, "we<ird>\\", "x" * 9000), (None, 0, "assistant", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1)).withColumn("start", F.lit(2))
    nodes, index = chat.format_tree(df, BYTES)
    got = {r.conv_id: r for r in chat.read_back(nodes, index, BYTES).collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t, role or "", text or ""))
    for c, turns in groups.items():
        turns.sort()
        learned = "".join(t for _, r, t in turns if r == "assistant")
        if c is not None:
            assert got[c].n_turns == len(turns) and got[c].loss_chars == len(learned)
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
            assert got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    tree = {bytes(n.node): n for n in nodes.collect()}
    assert len(tree) == 2 + 4 + 2 + 1 + 1  # shared first turns once
    at = 0
    for n in sorted(tree.values(), key=lambda n: n.start):
        assert n.start == at and len(n.ids) == 4 * n.length == 4 * len(n.loss)
        at += n.length
    for c in index.collect():
        path, before = bytes(c.path), []
        for k in range(0, len(path), chat.NODE):
            n = tree[path[k : k + chat.NODE]]
            seen = {x for s in n.attends_to for x in range(s.start, s.end)}
            assert n.position == sum(b.length for b in before) and seen == {x for b in before for x in range(b.start, b.start + b.length)}
            before.append(n)
    # what is read back comes from the stream: other starts, positions or intervals give other results, or an error
    for column, wrong in (("position", F.col("position") + F.when(F.col("depth") == 1, 1).otherwise(0)), ("start", F.col("start") + 1), ("attends_to", F.slice("attends_to", F.lit(1), F.greatest(F.size("attends_to") - 1, F.lit(0))))):
        try:
            bad = {r.conv_id: r for r in chat.read_back(nodes.withColumn(column, wrong), index, BYTES).collect()}
        except Exception:
            continue
        assert bad != got, column
    none = chat.format_tree(empty(df), BYTES)
    assert none[0].count() == 0 and chat.read_back(*none, BYTES).count() == 0


def test_guard_is_reversible():
    rng = random.Random(1)
    for _ in range(500):
        pairs = [("".join(rng.choices("\\<>/turn \nab", k=rng.randint(0, 12))), "".join(rng.choices("\\<>/turn \nab", k=rng.randint(0, 20)))) for _ in range(rng.randint(0, 4))]
        assert chat.parse("".join(chat.HEAD + chat.guard(r) + chat.MIDDLE + chat.guard(t) + chat.FOOT for r, t in pairs)) == pairs


# shared parts


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(200)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {k: v for k, v in closure([p for p in pairs if p[0] != p[1]], nodes).items()}


# the queries and the pipeline


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_over_the_small_tables(spark, small, name):
    assert len(queries.QUERIES[name](spark, small).limit(5).collect()) > 0


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    was = {r.doc_id: r.text for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.saved(stage(spark, docs, small))
        assert after.columns == docs.columns
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        seen.append((name, after.count()))
        if name == "quality":
            assert {r.doc_id for r in after.collect()} == {i for i, t in was.items() if len(WORD.findall(t or "")) >= 50 and _clean(t)}
        if name == "near_dedup":
            left = {r.doc_id: brute_fingerprint(r.text) for r in after.collect()}
            own = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
            whole = closure([(a, b) for a in own for b in own if a < b and (own[a] ^ own[b]).bit_count() <= 2], own)
            assert {*left} == {i for i in own if whole[i] == i}
        docs = after
    assert [n for n, _ in seen] == ["quality", "language", "near_dedup", "substring_dedup"] and seen[-1][1] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    nothing = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, small).count() == 0


def test_pipeline_language_rejects_what_is_in_no_language(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet").where(F.size(F.split("text", r"\s+")) >= 50)
    rng = random.Random(6)
    junk = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 10))) for _ in range(120)) for _ in range(40)]
    junk += [" ".join(base64.b64encode(rng.randbytes(24)).decode() for _ in range(80)) for _ in range(40)]
    rows = [(-1 - i, x) for i, x in enumerate(junk)] + [(-1000, None), (-1001, ""), (-1002, "12 345")]
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    for f in docs.schema:
        if f.name not in planted.columns:
            planted = planted.withColumn(f.name, F.lit(None).cast(f.dataType))
    both = docs.unionByName(planted.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)))
    kept = [r.doc_id for r in corpus_pipeline.identified(spark, both, small).select("doc_id").collect()]
    assert sum(i < 0 for i in kept) <= 4 and sum(i >= 0 for i in kept) >= 0.995 * docs.count()
    unknown = both.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.identified(spark, unknown, small).count() == both.count() - 3


def _clean(text):
    n, _, _, _, three, five, longest = brute_repetition(text, 5)
    return 2 * three <= n and five <= 0.35 * n and longest <= 200
