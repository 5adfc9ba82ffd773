"""Toxicity, collocations and hard negatives against brute force, and their stated cases."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import pivotgrams, pqmine, queries, toxicity

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, h string, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, y, "x", 1) for i, t, y in rows], DOCS)


# --- collocations


def brute_counts(rows, least):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    return {k: a for k, a in f.items() if a >= least}, n


def brute_phrases(rows, least, top):
    f, n = brute_counts(rows, least)
    cand = {k: a for k, a in f.items() if len(k[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, w), a in cand.items():
        if any(y == lang and len(v) > len(w) and b >= a and any(v[i : i + len(w)] == w for i in range(len(v))) for (y, v), b in cand.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(y, i, p.decode(), -a, x, z, n[y], -s) for y, v in out.items() for i, (s, a, p, x, z) in enumerate(sorted(v)[:top], 1)}


def texts(seed, n):
    rng = np.random.default_rng(seed)
    words = ["a", "b", "c", "Dog", "é", "É", "the", "of", "x'y", "long-word"]
    p = np.array([9, 7, 5, 3, 2, 1, 6, 6, 1, 1]) / 41
    sep = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", " ! "]
    one = lambda k: "".join(x + str(y) for x, y in zip(rng.choice(words, k, p=p), rng.choice(sep, k), strict=True))
    return [(i, one(int(rng.integers(0, 60))), [None, "en", "de"][i % 3]) for i in range(n)]


@pytest.mark.parametrize("hot", [1 << 17, 5])
def test_phrases_are_those_of_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(pivotgrams, "HOT", hot)
    rows = [*texts(1, 120), (7, None, "en"), (7, "", "en"), (7, "a b a b a b a b", "en"), (7, "a b a b a b a b", "en"), (None, "the of the of", None), (9, "x" * 100_000 + " a b", "de")]
    for least, top in ((3, 2000), (8, 7)):
        got = {tuple(r) for r in pivotgrams.phrases(docs(spark, rows), least=least, top=top).collect()}
        assert got == brute_phrases(rows, least, top)
    assert pivotgrams.phrases(docs(spark, rows).limit(0), least=3).count() == 0
    assert pivotgrams.phrases(docs(spark, [(1, None, None), (2, " \t.", "en")]), least=1).count() == 0


def test_fragments_are_counted_once_for_each_ngram():
    rng = np.random.default_rng(3)
    for _ in range(50):
        r = rng.integers(0, 5, 40)
        left, right = pivotgrams.windows(r)
        seen = collections.Counter()
        for p in np.flatnonzero(r):
            for i in range(left[p] + 1):
                for j in range(right[p] + 1):
                    if 1 <= i + j <= 4:
                        seen[(p - i, p + j)] += 1
        want = {(a, b) for a in range(40) for b in range(a + 1, min(40, a + 5)) if (r[a : b + 1] > 0).all()}
        assert set(seen) == want and set(seen.values()) <= {1}


def test_large_counts_stay_exact(spark):
    table = pa.table({"lang": ["en"] * 2, "left": pa.array([0, 0], pa.int8()), "kind": pa.array([0, 0], pa.int8()), "words": ["a b", "a b"], "n": [1 << 52, (1 << 52) + 1]})
    assert pivotgrams.mined(table, 100).to_pylist() == [{"lang": "en", "phrase": "a b", "m": 2, "a": (1 << 53) + 1}]


# --- hard negatives


def brute_negatives(rows, k=5):
    usable = []
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        usable.append((i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v), (y + 1) % 10 if i % 7 == 0 else y))
    out = set()
    for i, v, y in {u for u in usable if u[0] % 100 == 0}:
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, w, z in usable if j != i and len(w) == len(v)]
        for p in sorted(s for s in scored if s[2] == y)[:k]:
            near = sorted((s[:2]) for s in scored if s[2] != y and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0])[:k]
            out |= {(i, p[1], r, s[1], -p[0], -s[0]) for r, s in enumerate(near, 1)}
    return out


def mine(spark, rows):
    df = spark.createDataFrame([(i, v, y, "x", b"c") for i, v, y in rows], "vec_id long, embedding array<float>, label int, id string, code binary")
    return pqmine.mined(df, df.filter("vec_id % 100 = 0"), label=F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end"))


@pytest.mark.parametrize("block", [65536, 64])
def test_negatives_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pqmine, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(size=6).tolist(), int(rng.integers(0, 3))) for i in range(0, 1500, 2)]
    same = rng.normal(size=6).tolist()
    rows += [(int(i), same, 1) for i in range(1, 400, 2)] + [(int(i), same, 2) for i in range(401, 440, 2)]  # one vector many times, of two labels
    rows += [(100, same, 1), (3000, [0.5, None], 1), (3100, [0.5, float("nan")], 1), (3200, [float("inf")], 1), (3300, None, 1), (3400, same, None), (None, same, 1), (3500, [], 1), (3600, [1.0, 2.0], 1), (3601, [2.0, 2.0], 1), (3602, [1.5, 1.5], 2), (3700, [9.0] * 7, 4)]
    out = mine(spark, rows)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    # 100 has two vectors: two anchors of one id, compared as rows
    got = {tuple(r) for r in out.collect()}
    assert got == brute_negatives(rows)
    assert mine(spark, [(None, None, None)]).count() == 0
    assert mine(spark, [(100, [1.0], 1)]).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 7)) * 256
    books = pqmine.learned(x[:300], centroids=16)
    code, norm = pqmine.coded(x, books)
    q = x[:40]
    mid, half = pqmine.looked_up(q, code, books), pqmine.slack(q, norm)
    assert (np.abs(mid - q @ x.T) <= half).all()
    assert (pqmine.coded(x, books[:1])[1] > 2 * norm).mean() > 0.9


def test_codes_stand_for_their_centroids():
    """Scores are products with what the codes stand for, made once a block, not a look-up for each pair."""
    x = np.random.default_rng(6).integers(-90, 90, (300, 7)).astype("f8")
    books = pqmine.learned(x, 16)
    code, norm = pqmine.coded(x, books)
    stand = pqmine.decoded(code, books, 7)
    assert stand.shape == x.shape and (np.sqrt(((x - stand) ** 2).sum(axis=1)) <= norm).all()
    assert (np.abs(x @ x.T - pqmine.looked_up(x, code, books)) <= pqmine.slack(x, norm)).all()


# --- toxicity


def test_toxicity_held_out(spark):
    out = {r["doc_id"]: r for r in queries.op11_counterfactual_toxicity(spark, SF).collect()}
    source = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(out) == source.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    held = [(r["toxic"], out[r["doc_id"]]["predicted"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if out[r["doc_id"]]["held_out"]]
    c = collections.Counter(held)
    assert c[1, 1] / (c[1, 1] + c[1, 0]) > 0.9 and c[1, 1] / (c[1, 1] + c[0, 1]) > 0.97


def biased(rng):
    """Texts in which toxic ones name one group more often, and insults are known for most of them."""
    plain = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        w = list(rng.choice(plain, 8))
        if toxic and rng.random() < 0.8:
            w[0] = str(rng.choice(["awful", "vile", "rotten"]))
        if rng.random() < (0.6 if toxic else 0.02):
            w[1] = "muslims"
        elif rng.random() < 0.3:
            w[1] = str(rng.choice(["christians", "jews", "hindus", "buddhists"]))
        rows.append((i, " ".join(w) + ".", int(toxic)))
    return rows


def test_swaps_take_the_weight_off_identity_terms(spark):
    rows = biased(np.random.default_rng(1))
    df = docs(spark, [(i, t, "en") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    neutral = ["my word1 word2 muslims word4", "muslims word7 word8"]
    with_, without = (toxicity.train(df, labels, penalty=p) for p in (toxicity.PENALTY, 0.0))
    say = lambda m, t: toxicity.scores(m, t)
    assert max(say(with_, neutral)) < 0.3 < min(say(without, neutral))
    change = lambda m: abs(np.subtract(*say(m, ["word1 muslims word2", "word1 hindus word2"])))
    assert change(with_) < change(without) / 4
    assert min(say(with_, ["awful word1 word2 word3", "vile word9 muslims"])) > 0.3


def test_sentences_and_features_are_those_of_a_plain_reading():
    rng = np.random.default_rng(2)
    names = ["ab", "^abcd", "cdef$", "x", "y"]
    number = {f: i for i, f in enumerate(names)}
    given = [" ".join(rng.choice(["ab", "abcdef", "x", "y.", "zz!\n", "q?"], int(rng.integers(0, 12)))) for _ in range(60)] + [None, "", "...", "x " * 200]
    codes, words, sentence, of_text = toxicity.sentences(given)
    s, f = toxicity.hits(codes, words, sentence, number)
    want = []
    for i, t in enumerate(given):
        for part in re.split(r"[.!?\n]", (t or "").lower()):
            w = re.findall(r"\w+", part)
            for a in range(0, len(w), toxicity.WORDS):
                want.append((i, sorted({number[x] for v in w[a : a + toxicity.WORDS] for x in toxicity.features(v) if x in number})))
    assert list(of_text) == [i for i, _ in want]
    got = [(int(i), f[s == k].tolist()) for k, i in enumerate(of_text)]
    assert got == want


def test_toxicity_cases(spark):
    rows = [(1, "vile awful day"), (2, "nice good day"), (3, None), (4, ""), (5, "!!! ..."), (1, "vile awful day"), (None, "vile")] + [(i, f"vile thing {i}" if i % 2 else f"nice thing {i}") for i in range(10, 60)]
    df = docs(spark, [(i, t, None) for i, t in rows]).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(None, 1), (11, None), (3, 1), (2, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    out = toxicity.judged(df, model).collect()
    by = {r["doc_id"]: r["predicted"] for r in out}
    assert len(out) == len(rows) and by[1] == 1 and by[2] == 0 and by[None] == 1 and by[4] == 0
    assert {r["score"] for r in out if r["doc_id"] in (3, 4, 5)} == {0.0}
    none = toxicity.train(df, labels.limit(0))
    assert {(r["score"], r["predicted"]) for r in toxicity.judged(df, none).collect()} == {(0.0, 0)}
    assert toxicity.judged(df.limit(0), toxicity.train(df.limit(0), labels)).count() == 0
    both = toxicity.judged(df, model, keep=("doc_id", "score"), score_as="s", predicted_as="p")
    assert both.columns == ["doc_id", "score", "s", "p"]
    small = toxicity.sampled(df, labels, id_col="doc_id", text_col="text", label_col="toxic", most=10)
    assert small.count() < 30
    long = "vile " + "nice thing " * 200_000
    assert toxicity.scores(model, [long])[0] < 0.3
