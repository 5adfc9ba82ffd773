"""The training-data operators against brute force, and their stated cases."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import bloomdedup, chosenpath, gumbel_pieces, lang_crf, pathratio, pfair, pll, queries, quotes, secret_markov, vafile

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 2) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()


# --- language id


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    e, trans, start = rng.normal(size=(130, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    first = np.zeros(130, bool)
    cuts = [0, 1, 2, 70, 130]
    first[cuts[:-1]] = True
    got = lang_crf.forward_backward(e, first, trans, start, 16)
    for a, b in itertools.pairwise(cuts):
        alpha, beta = [np.exp(start + e[a])], [np.ones(3)]
        for i in range(a + 1, b):
            alpha.append((alpha[-1] @ np.exp(trans)) * np.exp(e[i]))
        for i in range(b - 1, a, -1):
            beta.insert(0, np.exp(trans) @ (np.exp(e[i]) * beta[0]))
        want = np.array(alpha) * np.array(beta)
        assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True))


def test_language_held_out_accuracy(spark, real):
    out = {r["doc_id"]: r for r in queries.op1_crf_language_id(spark, SF).collect()}
    assert len(out) == len(real)
    held = [r for r in real if out[r["doc_id"]]["held_out"]]
    assert 0.25 < len(held) / len(real) < 0.42
    assert sum(out[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_language_words_of_switched_text(spark, real):
    by = {y: " ".join(r["text"] for r in real if r["lang"] == y)[:60000] for y in ("en", "de")}
    model = lang_crf.fit([by["en"], by["de"]], ["en", "de"], epochs=2)
    pick = lambda y: [r["text"] for r in real if r["lang"] == y][40].split()[:30]
    text = " ".join(pick("en") + pick("de"))
    words, post = lang_crf.label_words(model, [text])
    n = len(words[0])
    assert (post[: n // 2 - 3].argmax(axis=1) == model.langs.index("en")).mean() > 0.9
    assert (post[n // 2 + 3 :].argmax(axis=1) == model.langs.index("de")).mean() > 0.9


def test_language_cases(spark):
    rows = [(1, "alpha beta gamma"), (2, "uno dos tres"), (3, None), (4, ""), (5, "12 - 34"), (1, "alpha beta gamma"), (None, "alpha")]
    df = docs(spark, rows).withColumn("lang", F.when(F.col("doc_id") == 1, "en").when(F.col("doc_id") == 2, "es"))
    model = lang_crf.train(df)
    out = lang_crf.identify(df.withColumn("score", F.lit("clash")), model).collect()
    assert [r["lang_pred"] for r in out] == ["en", "es", "und", "und", "und", "en", "en"]
    assert [r["score"] for r in out][2:5] == [0, 0, 0]
    assert lang_crf.identify(df.limit(0), model).count() == 0
    long = "alpha beta " * 50000
    assert lang_crf.predict_texts(model, [long])[0] == ["en"]
    assert lang_crf.predict_texts(model, ["½ ² ① Ⅷ", "３ 4"]) == (["und", "und"], [0.0, 0.0])
    # no labelled row: nothing is known
    bare = lang_crf.train(df.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in lang_crf.identify(df, bare).collect()} == {("und", 0.0)}
    assert lang_crf.identify(df.limit(0), lang_crf.train(df.limit(0))).count() == 0
    both = lang_crf.identify(df.withColumn("lang_pred", F.lit(1)), model, keep=("doc_id", "lang_pred", "text"), lang_as="x", score_as="y")
    assert both.columns == ["doc_id", "text", "lang_pred", "x", "y"] and [r["x"] for r in both.collect()][:2] == ["en", "es"]


# --- secrets

BASE = {
    "assign": (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def base_spans(text):
    got = [(m.start(), list(BASE).index(k), m.end()) for k, (p, ok) in BASE.items() for m in p.finditer(text or "") if ok(m)]
    return sorted(got)


def test_secret_base_spans(spark, real):
    odd = ["é😀 token = 'abcdefgh1' x", "token=passwd:abcdefghijk", "AKIAABC AKIAABCDEFGH1234 XAKIA000000000000", "a" * 31 + "g" + "f" * 40, "API_KEY:12345678apikey=abcdefghij", "TOKEN= short", None, "", "secret==abcdefgh", "password='abc", "token=a token=bbbbbbbbbbbb\ntoken=cccccccccc"]
    rows = [(r["doc_id"], r["text"]) for r in real] + [(10000 + i, t) for i, t in enumerate(odd)]
    ratios = secret_markov.trained(spark)
    out = {r["doc_id"]: r for r in secret_markov.report(docs(spark, rows), ratios).collect()}
    for i, t in rows:
        want = base_spans(t)
        shown = ",".join(f"{secret_markov.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert out[i]["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest(), (t and t[:80], shown, out[i]["spans"])
        assert [out[i][f"n_{k}"] for k in BASE] == [sum(s[1] == j for s in want) for j in range(3)]
        assert set(filter(None, shown.split(","))) <= set(out[i]["spans"].split(","))


def test_secret_markov_tells_random_from_ordinary(spark):
    ratios = secret_markov.trained(spark)
    fresh = secret_markov.labelled_sample(400, seed=99)
    df = spark.createDataFrame(fresh, "token string, random int").select("random", (secret_markov.ratio(F.col("token"), ratios) > secret_markov.THRESHOLD).alias("said"))
    rows = df.collect()
    assert sum(r["said"] for r in rows if r["random"]) / 400 > 0.9
    assert sum(r["said"] for r in rows if not r["random"]) / 400 < 0.02
    text = "key Zx8Kq2LmP0vTn4RwYb7Jd3Hf and the_ordinary_identifier_name_here"
    r = secret_markov.report(docs(spark, [(1, text)]), ratios).collect()[0]
    assert r["spans"] == "markov:4:28"
    assert secret_markov.report(docs(spark, []), ratios).count() == 0


def test_secret_ratio_is_the_likelihood_ratio(spark):
    sample = [("ab", 1), ("aab", 1), ("ba", 0), ("bb", 0), (None, 1), ("a", 0)]
    got = secret_markov.pair_ratios(spark.createDataFrame(sample, "token string, random int"))
    n = len(secret_markov.ALPHABET)
    first, pair = [collections.Counter() for _ in range(2)], [collections.Counter() for _ in range(2)]
    for t, y in sample:
        if t and len(t) > 1:
            first[y][t[0]] += 1
            pair[y].update(itertools.pairwise(t))
    p = lambda c, k, of: (c[k] + 0.5) / (sum(c[x] for x in of) + 0.5 * n)
    for a, b in itertools.product("abc", repeat=2):
        row = [(a, x) for x in secret_markov.ALPHABET]
        want = math.log(p(pair[1], (a, b), row)) - math.log(p(pair[0], (a, b), row))
        assert math.isclose(got[secret_markov.ALPHABET.index(a) * n + secret_markov.ALPHABET.index(b)], want)
        assert math.isclose(got[n * n + secret_markov.ALPHABET.index(a)], math.log(p(first[1], a, secret_markov.ALPHABET)) - math.log(p(first[0], a, secret_markov.ALPHABET)))
    value = spark.range(1).select(secret_markov.ratio(F.lit("abba"), got).alias("r")).first()["r"]
    i = [secret_markov.ALPHABET.index(x) for x in "abba"]
    assert math.isclose(value, (got[n * n + i[0]] + sum(got[a * n + b] for a, b in itertools.pairwise(i))) / 4, abs_tol=1e-4)
    found = secret_markov.found_sample(docs(spark, [(1, "token=abcdefgh12 ordinary words AKIAABCDEFGH1234 " + "0f" * 16), (2, None)])).collect()
    assert sorted(map(tuple, found)) == [("0f" * 16, 1), ("AKIAABCDEFGH1234", 1), ("abcdefgh12", 1), ("ordinary", 0)]


def test_secret_overlaps_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(secret_markov, "BLOCK", 3)
    text = " ".join(f"token=Zx8Kq2LmP0vTn4RwYb7J{i:02d} Qx9Kq2LmP0vTn4RwYb7Jd3H{i:02d}" for i in range(11))
    r = secret_markov.report(docs(spark, [(1, text)]), secret_markov.trained(spark)).collect()[0]
    kinds = [s.split(":")[0] for s in r["spans"].split(",")]
    assert kinds == ["assign", "markov"] * 11 and r["n_assign"] == 11


def test_secret_many_matches(spark):
    text = " ".join(f"token=abcdefgh{i:04d}" for i in range(2000))
    r = secret_markov.report(docs(spark, [(1, text)]), [0.0] * len(secret_markov.ALPHABET) ** 2).collect()[0]
    assert r["n_assign"] == 2000
    assert r["base_sha256"] == hashlib.sha256(",".join(f"assign:{a}:{b}" for a, _, b in base_spans(text)).encode()).hexdigest()


# --- language-model scores


def test_pll_adds_up_and_learns(spark, real):
    texts = [r["text"] for r in real[:200]] + [None, "", "one"]
    counts = np.bincount(pll.buckets(texts)[0], minlength=pll.BUCKETS)
    classes = pll.Classes(counts)
    net = pll.Network()
    n, before = pll.score_texts(net, classes, texts)
    bucket, lens = pll.buckets(texts)
    cls = classes.of[bucket]
    parts = [pll.of_round(bucket, lens, r) for r in range(pll.ROUNDS)]
    assert sorted(np.concatenate(parts).tolist()) == list(range(len(bucket)))  # every token is a target once
    memory = np.full(len(net.flat), 1.0, "f4")
    rng = np.random.default_rng(0)
    for at in parts:
        net.train(pll.windows(cls, lens)[at], cls[at], memory, classes.share, rng)
    _, after = pll.score_texts(net, classes, texts)
    assert after.sum() > before.sum() + n.sum() * 0.3
    assert list(n[-3:-1]) == [0, 0] and list(after[-3:-1]) == [0, 0]
    # one text by hand: each token from both its sides
    i = 5
    b, _ = pll.buckets([texts[i]])
    c = classes.of[b]
    total = 0.0
    for j in range(len(c)):
        ctx = [c[j + d] if 0 <= j + d < len(c) else pll.CLASSES for d in pll.OFFSETS]
        h = np.tanh(net.bias + sum(net.embed[k][x] for k, x in enumerate(ctx)))
        z = (h @ net.out + net.out_bias).astype("f8")
        total += z[c[j]] - np.log(np.exp(z - z.max()).sum()) - z.max() + classes.log_share[b[j]]
    assert math.isclose(total, after[i], rel_tol=1e-4)
    assert math.isclose(np.exp(classes.log_share).sum(), pll.CLASSES, rel_tol=1e-3)


def test_pll_query(spark):
    rows = [(i, "the cat sat on the mat again and again") for i in range(30)] + [(90, None), (91, ""), (92, "zq xv jj"), (92, "zq xv jj")]
    df = docs(spark, rows)
    counts = pll.corpus_counts(df)
    assert counts.sum() == 30 * 9 + 6
    out = {r["doc_id"]: r for r in pll.pseudo_likelihood(df).collect()}
    assert out[90]["score"] is None and out[90]["n_tokens"] == 0 and out[91]["log_prob"] == 0
    assert out[0]["score"] > out[92]["score"]
    assert pll.pseudo_likelihood(docs(spark, [])).count() == 0


# --- mixing


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 3, "b": 1}, {"a": 0.7, "b": 0.2, "c": 0.07, "d": 0.03}, {f"s{i}": 1 + i % 7 for i in range(40)}])
def test_pfair_period_keeps_within_a_block(weights):
    share = pfair.shares(weights, 200)
    assert sum(share.values()) == 200 and min(share.values()) >= 1
    order = pfair.period_slots(share)
    assert collections.Counter(order) == share
    done = collections.Counter()
    for t, s in enumerate(order, 1):
        done[s] += 1
        assert all(abs(done[x] - t * share[x] / 200) < 1 for x in share)


def test_pfair_mix(spark):
    rows = [(i, "t", "en", "abc"[min(2, i % 7 // 3)] if i % 11 else None, 1, "x", 2) for i in range(3000)] + [(5, "t", "en", "a", 1, "x", 2), (None, "t", "en", "a", 1, "x", 2)]
    df = spark.createDataFrame(rows, DOCS)
    out = pfair.mix(df, {"a": 5, "b": 3, "c": 1}, period=90, block_rows=4).orderBy("mix_position").collect()
    assert len(out) == len(rows)
    assert collections.Counter((r["doc_id"], r["source"]) for r in out) == collections.Counter((r[0], r[3]) for r in rows)
    assert len({r["mix_position"] for r in out}) == len(rows)
    slots = {}
    for r in out:
        assert slots.setdefault(r["mix_slot"], r["source"]) == r["source"]
    assert sorted(slots) == list(range(len(slots)))
    first = [slots[t] for t in range(200)]
    for t in range(1, 201):
        done = collections.Counter(first[:t])
        for s, w in {"a": 0.5, "b": 0.3, "c": 0.1, None: 0.1}.items():
            assert abs(done[s] - w * t) < 1
    assert pfair.mix(df.limit(0)).count() == 0
    ordered = pfair.mixed_order(df)
    assert ordered.columns == df.columns and ordered.count() == len(rows)


@pytest.mark.parametrize("counts", [{"hot": 150_000} | {f"s{i:02}": 15_800 for i in range(19)}, {"hot": 100_000} | {f"s{i:04}": 20 + i % 7 for i in range(1200)}])
def test_pfair_keeps_to_the_target_weights(counts):
    target = pfair.tempered(counts, 0.5)
    blocks = {s: -(-n // 16) for s, n in counts.items()}
    plan = pfair.schedule(blocks, target)
    assert {s: len(x) for s, x in plan.items()} == blocks
    assert sorted(itertools.chain(*plan.values())) == list(range(sum(blocks.values())))
    end = min(x[-1] for x in plan.values())
    whole = math.fsum(target.values())
    # before a block runs and after it are a source's least and greatest deviations
    assert max(max(abs(i - t * target[s] / whole), abs(i + 1 - (t + 1) * target[s] / whole)) for s, x in plan.items() for i, t in enumerate(x) if t <= end) < 1 + 1e-6


def test_pfair_weights_below_a_thousandth(spark):
    assert list(pfair.schedule({"a": 5000, "b": 2}, {"a": 1.0, "b": 0.0004})["b"])[0] > 2000
    assert pfair.schedule({"a": 3, "b": 2, "c": 1}, {"a": 1, "b": 0, "c": 0})["a"].tolist() == [0, 1, 2]
    with pytest.raises(ValueError):
        pfair.schedule({"a": 1}, {"a": -1.0})
    rows = [(i, "t", "en", "ab"[i % 5 == 0], 1, "x", 2) for i in range(6000)]
    near = pfair.mix(spark.createDataFrame(rows, DOCS), {"a": 5, "b": 3}, block_rows=2)
    assert len({r["mix_position"] for r in near.collect()}) == 6000
    limit, pfair.BROADCAST_BLOCKS = pfair.BROADCAST_BLOCKS, 0
    try:
        far = pfair.mix(spark.createDataFrame(rows, DOCS), {"a": 5, "b": 3}, block_rows=2)
        assert sorted(far.collect()) == sorted(near.collect())
    finally:
        pfair.BROADCAST_BLOCKS = limit


# --- top-k


@pytest.mark.parametrize("seed", range(3))
def test_va_bounds_lose_nothing(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-300, 300, (400, 8)).astype("f8")
    x[100:200] = x[100]
    ids = rng.permutation(400)
    lo, hi = x.min(axis=0), x.max(axis=0)
    for bits in (3, 8):
        width = vafile.grid(lo, hi, bits)
        c = vafile.cells(x, lo, width, bits)
        mid, half = vafile.bounds(c, x[:30], lo, width)
        score = x[:30] @ x.T
        assert (np.abs(mid - score) <= half[:, None]).all()
        got = vafile.survivors(ids, c, ids[:30], x[:30], lo, width, 5)
        for i in range(30):
            best = sorted((-score[i, j], ids[j]) for j in range(400) if ids[j] != ids[i])
            worst = -best[4][0]
            assert {j for j in range(400) if ids[j] != ids[i] and score[i, j] >= worst} <= set(got[i][0].tolist())
            assert bits == 3 or len(got[i][0]) < 200


def test_va_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 6)).astype("f4")
    x[50:80] = x[50]
    rows = [(int(i), [float(v) for v in x[i]]) for i in range(600)] + [(50, [float(v) for v in x[50]]), (601, [float(v) for v in x[3]]), (601, [float(v) for v in x[3]])]
    monkeypatch.setattr(vafile, "CANDIDATES_PER_BLOCK", 100)
    monkeypatch.setattr(vafile, "QUERIES_PER_BLOCK", 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in vafile.topk(df, df.filter("vec_id % 50 = 0"), 5).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    e = [(i, np.floor(256 * np.array(v, "f4").astype("f8")).astype("i8")) for i, v in rows]
    for q in range(0, 600, 50):
        w = next(v for i, v in e if i == q)
        best = sorted((-int(v @ w), i) for i, v in e if i != q)[:5]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]


def test_va_cases(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.5, -1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (100, None), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, id string")
    out = vafile.topk(df, df.filter("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in out] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert out[0]["score"] == 256 * 256 + 512 * 512
    assert vafile.topk(df.limit(0), df.limit(0), 5).count() == 0


# --- n-gram join


def shingles(text):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    sets = {i: shingles(t or "") for i, t in rows}
    links = collections.Counter({i: 0 for i in sets})
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    near = {p for v in where.values() for p in itertools.combinations(sorted(v), 2)}
    for a, b in near:
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (find(i), links[i]) for i in sets}


def test_chosen_path_matches_brute_force(spark, real):
    rows = [(r["doc_id"], r["text"]) for r in real]
    want = brute_classes(rows)
    out = {r["doc_id"]: r for r in queries.op6_chosen_path_join(spark, SF).collect()}
    assert {i: (r["class_id"], r["n_links"]) for i, r in out.items()} == want


def test_chosen_path_large_groups(spark, monkeypatch):
    rng = np.random.default_rng(1)
    word = lambda: f"w{rng.integers(0, 5000)}"
    base = [word() for _ in range(120)]
    rows = []
    for i in range(150):  # near copies
        w = list(base)
        for j in rng.integers(0, 120, rng.integers(0, 4)):
            w[j] = word()
        rows.append((i, " ".join(w)))
    passage = [word() for _ in range(60)]
    rows += [(1000 + i, " ".join([*[word() for _ in range(80)], *passage])) for i in range(150)]  # a shared passage only
    rows += [(2000 + i, "one two three four five six") for i in range(40)]
    rows += [(3000, None), (3001, ""), (3002, "..."), (3003, "short"), (3004, "short")]
    monkeypatch.setattr(chosenpath, "BLOCK", 32)
    out = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosenpath.similar(docs(spark, rows), small=8).collect()}
    assert out == brute_classes(rows)


@pytest.mark.parametrize("block", [1024, 2])
def test_chains_in_a_dense_cluster_are_one_class(spark, monkeypatch, block):
    """Links 1-5, 5-6, 6-2: the link 5-6 isn't the least of either of its ends."""
    monkeypatch.setattr(chosenpath, "BLOCK", block)
    chain = [1, 5, 6, 2, 9, 8, 3]
    sets = spark.createDataFrame([(fp, list(range(10 * i, 10 * i + 100))) for i, fp in enumerate(chain)], "fp long, tokens array<int>")
    clusters = sets.selectExpr("1L as cluster", "fp")
    found = chosenpath._dense_links(clusters, sets, sets.selectExpr("fp", "1L as copies", "100L as size"), 0.8)
    assert {r["fp"]: r["n"] for r in found.groupBy("fp").agg(F.sum("links").alias("n")).collect()} == {1: 1, 5: 2, 6: 2, 2: 2, 9: 2, 8: 2, 3: 1}
    labels = chosenpath.components(found.selectExpr("fp as a", "other as b"))
    assert {tuple(r) for r in labels.collect()} == {(fp, 1) for fp in chain}


@pytest.mark.parametrize("taken", [4, 1])
def test_chosen_path_finds_pairs_of_frequent_passages(spark, taken):
    passages = [" ".join(f"p{i}w{j}" for j in range(240 // taken)) for i in range(3 * taken)]
    some = list(itertools.combinations(range(3 * taken), taken))
    rows = []
    for i in range(1200):
        own = 20 if i % 3 else 200  # those with much of their own share the passages' keys but aren't alike
        text = " ".join(passages[p] for p in some[i * 7 % 400 % len(some)])
        rows.append((i, text + " " + " ".join(f"u{i}x{j}" for j in range(own))))
    want = {i: n for i, (_, n) in brute_classes(rows).items()}
    got = {r["doc_id"]: r["n_links"] for r in chosenpath.similar(docs(spark, rows)).collect()}
    assert all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.999 * sum(want.values()) > 0


def test_links_at_the_very_threshold():
    for n in range(5, 2000):
        if 8 * n % 9 == 0:  # 8n/9 shared of n and n: exactly 0.8
            a = np.arange(n, dtype="u4")
            b = np.concatenate([a[: 8 * n // 9], np.arange(5000, 5000 + n - 8 * n // 9, dtype="u4")])
            c = np.concatenate([a[: 8 * n // 9 - 1], np.arange(9000, 9001 + n - 8 * n // 9, dtype="u4")])
            got = chosenpath.links_within([a, b, c], 0.8)
            assert got[0, 1] and not got[0, 2], n


def test_sketches_lose_no_link():
    rng = np.random.default_rng(3)
    for size in (1, 3, 20, 300, 3000):
        base = rng.choice(2**32, size, replace=False).astype("u4")
        sets = []
        for _ in range(20):
            s = base.copy()
            s[: rng.integers(0, max(1, size // 5 + 1))] = rng.choice(2**32)
            sets.append(np.unique(s))
        sets += [np.unique(rng.choice(2**32, size).astype("u4")) for _ in range(10)]
        sizes = np.array([len(s) for s in sets])
        words = chosenpath.sketches(np.concatenate(sets), sizes).copy().view("u8")
        linked = chosenpath.links_within(sets, 0.8)
        np.fill_diagonal(linked, False)
        may = chosenpath.may_link(words, sizes, 0.8)
        assert (may >= linked.any(axis=1)).all()
        if size == 300:
            assert not may[20:].any()


def test_chosen_path_very_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    rows = [(1, long, 5, 6), (2, long + " end", 5, 6), (3, "short text of its own words here", 5, 6), (4, "", 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int, fp int")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosenpath.similar(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}
    assert [tuple(r) for r in chosenpath.one_of_each(df).orderBy("doc_id").collect()] == [r for r in rows if r[0] != 2]


def test_chosen_path_runs_hold_at_every_depth():
    rng = np.random.default_rng(0)
    runs = chosenpath.runs_for()
    keys = rng.poisson(chosenpath.BRANCH * runs, 200_000)
    for _ in range(chosenpath.DEPTH - 1):
        keys = rng.poisson(chosenpath.BRANCH * keys)
    assert (keys == 0).mean() < 1 - chosenpath.RECALL


def test_chosen_path_cases(spark):
    df = docs(spark, [(2, "a b c d e f g"), (1, "A b, c d e f g!"), (None, "a b c d e f g"), (3, None), (2, "a b c d e f g")])
    out = sorted((r["doc_id"] or 0, r["class_id"], r["class_size"], r["n_links"]) for r in chosenpath.similar(df).collect())
    assert out == [(0, None, 1, 0), (1, 1, 3, 2), (2, 1, 3, 2), (2, 1, 3, 2), (3, 3, 1, 0)]
    assert chosenpath.similar(docs(spark, [])).count() == 0
    kept = chosenpath.one_of_each(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["label"] for r in chosenpath.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# --- exact dedup


def test_bloom_dedup_cases(spark):
    rows = [(3, "a  b"), (1, "a\tb"), (2, " a b"), (4, None), (5, ""), (6, "x"), (None, "x"), (None, "y"), (7, "a b"), (7, "a b"), (8, "a b")]
    df = docs(spark, rows)
    out = bloomdedup.decisions(df).collect()
    assert len(out) == len(rows)
    got = collections.Counter((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in out)
    assert got == collections.Counter(
        [(3, 1, 4, False), (1, 1, 4, True), (2, 2, 1, True), (4, 4, 2, True), (5, 4, 2, False), (6, 6, 2, True), (None, 6, 2, False), (None, None, 1, True), (7, 1, 4, False), (7, 1, 4, False), (8, 8, 1, True)]
    )
    kept = bloomdedup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, "y"), (1, "a\tb"), (2, " a b"), (4, ""), (6, "x"), (8, "a b")]
    assert bloomdedup.decisions(df.limit(0)).count() == 0
    twice = docs(spark, [(1, "same"), (1, "same"), (2, "other")])
    assert bloomdedup.decisions(twice).filter("kept").count() == 2 and bloomdedup.deduplicate(twice).count() == 2


def test_bloom_dedup_carries_columns_of_any_name(spark):
    cols = "doc_id long, text string, __sha int, __blk int, _blk int, __bm int, __maybe int, maybe int, row int, key int, sha int"
    df = spark.createDataFrame([(i, f"t {i // 2}", *range(9)) for i in range(40)] + [(None, "n", *range(9))] * 30, cols)
    out = bloomdedup.deduplicate(df)
    assert out.columns == df.columns and sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in out.collect()) == [-1, *range(0, 40, 2)]
    assert all(tuple(r)[2:] == tuple(range(9)) for r in out.collect())
    one = bloomdedup.decisions(df).filter("doc_id is null" if "doc_id" in bloomdedup.decisions(df).columns else "id is null").collect()
    assert len(one) == 30 and sum(r["kept"] for r in one) == 1 and {r["group_size"] for r in one} == {30}


def test_bloom_dedup_shuffles_few_texts(spark):
    """Texts of unique rows and of copies that go stay out of the shuffles: the joins stand above the filters."""
    df = spark.createDataFrame([(i, f"text {i} " + "x" * 2000 if i % 10 else "the same " + "y" * 2000) for i in range(3000)], "doc_id long, text string")
    from marlstone.llm.common import written

    kept = bloomdedup.deduplicate(written(df, "in"))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "LeftAnti" not in plan
    joins = [x for x in plan.splitlines() if "Join Inner" in x]
    assert "key" in joins[0] and "shiftright" not in joins[0] and all("shiftright" in x for x in joins[1:]) and len(joins) == 3
    assert kept.count() == 2701


def test_not_among(spark):
    from marlstone.llm.common import written

    df = spark.createDataFrame([(i % 500 if i % 7 else None, i) for i in range(1500)], "id long, key int")
    gone = written(spark.range(0, 500, 3).select(F.col("id").alias("g")), "gone")
    got = bloomdedup.not_among(df, "id", gone, "g").collect()
    assert sorted(r["key"] for r in got) == [i for i in range(1500) if i % 7 == 0 or (i % 500) % 3]


def test_bloom_filter_passes_unique_rows(spark):
    df = docs(spark, [(i, f"text {i // 2 if i < 200 else i}") for i in range(4000)])
    digests = df.select(F.col("doc_id").alias("id"), bloomdedup.digest(F.col("text")).alias("sha"))
    blocks = bloomdedup._blocks(4000)
    tested = bloomdedup.maybe_repeated(digests, "sha", bloomdedup.repeated_filter(digests, "sha", blocks), blocks)
    maybe = {r["id"] for r in tested.filter("__maybe").collect()}
    assert maybe >= set(range(200)) and len(maybe) < 350


# --- html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:y}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site name</h1><nav><a href=/>Home</a></nav></header><div class="cookie-notice"><p>We use cookies, many of them, on this site.</p></div>
%s
<aside><p>Other things, to read.</p></aside><div class="sidebar"><ul><li><a href=/a>A link</a></li></ul></div>
<form><p>Write to us, please, now.</p><input></form><footer>&copy; 2020</footer></body></html>"""
ARTICLE = "<h2>A &amp; B</h2><p>First, of the\n  <b>long</b> text&nbsp;here. It goes on, and on, for some time.<p>Short.<br>One.<ul><li>item one<li>item two</ul><p>Last; words, of the text, are these.</p>"
WANT = "A & B\n\nFirst, of the long text here. It goes on, and on, for some time.\n\nShort. One.\n\nitem one\n\nitem two\n\nLast; words, of the text, are these."


@pytest.mark.parametrize(
    "body",
    [
        f"<article>{ARTICLE}</article>",
        f"<main><div>{ARTICLE}</div></main>",
        f"<div id='content' class='no-sidebar'>{ARTICLE}</div>",
        f"<div class=wrap><div class=story>{ARTICLE}</div><div class=comments><p>I liked this, a lot, thanks!</p></div></div>",
        f"<article>{ARTICLE}<div class='comment-list'><p>I liked this, a lot, thanks!</p></div></article><div class=ad>Buy, now!</div>",
        f"<section><article class=post>{ARTICLE}</article><article class='comment'><p>I liked this, a lot, thanks!</p></article></section>",
    ],
)
def test_main_text(body):
    assert pathratio.main_text(PAGE % body) == WANT


INTRO = "The intro, in short, says what is to come."
REST = "<p>The body, of many words, goes on, and on, for a long time; it says more, and more, of it all.</p>" * 12


@pytest.mark.parametrize(
    "body",
    [
        f"<div class=story><div class=intro><p>{INTRO}</p></div><div class=text>{REST}</div></div>",
        f"<div class=story><div class=text>{REST}</div><div class=end><p>{INTRO}</p></div></div>",
        f"<main><h1>Title</h1><p>{INTRO}</p><article>{REST}</article></main>",
        f"<main><h1>Title</h1><p>Lead</p><article>{REST}<p>{INTRO}</p></article></main>",
        f"<div><article>{REST}</article><div><p>{INTRO}</p></div></div>",
        f"<div><article>{REST}</article></div><div><article><p>{INTRO}</p></article></div>",
    ],
)
def test_main_text_keeps_all_content(body):
    got = pathratio.main_text(PAGE % body).split("\n\n")
    assert INTRO in got and len([x for x in got if x.startswith("The body")]) == 12
    assert ("Title" in got) == ("Title" in body) and ("Lead" in got) == ("Lead" in body)
    assert not any("cookies" in x or "Write to us" in x for x in got)


def test_main_text_weights_overrule_names():
    body = "<p>The report, in full, says a good deal, and goes on, for some time.</p>" * 10
    assert pathratio.main_text(f"<html><body><nav><a href=/>Home</a></nav><article><div class='promo-text'>{body}</div></article></body></html>").count("The report") == 10
    assert pathratio.main_text(f"<html><body><div class='story'>{body}</div><article class='teaser'><p>Read more, soon.</p></article></body></html>").count("The report") == 10
    deep = pathratio.main_text(f"<html><body><div class='widget'><div class='share'><p>Share this, now.</p></div>{body}</div><footer><p>(c) 2020, all of it.</p></footer></body></html>")
    assert deep.count("The report") == 10 and "Share" not in deep and "2020" not in deep


LONG_COMMENTS = "<p>I read this, twice, and liked it; thanks, to all of you, for it.</p>" * 30


@pytest.mark.parametrize("name", ["id='comments'", "class='comments'", "class='comment-list wide'", "id=disqus_thread"])
@pytest.mark.parametrize(
    "body",
    [
        f"<article>{ARTICLE}</article><div %s>{LONG_COMMENTS}</div>", f"<article>{ARTICLE}<div %s>{LONG_COMMENTS}</div></article>", f"<div class=wrap><div class=story>{ARTICLE}</div><div %s>{LONG_COMMENTS}</div></div>",
        f"<div class='widget box'><div class=story>{ARTICLE}</div><div %s><form>{LONG_COMMENTS}</form></div></div>",
    ],
)
def test_comments_are_left_out_whatever_their_weight(body, name):
    assert pathratio.main_text(PAGE % (body % name)) == WANT


@pytest.mark.parametrize("wrap", ["<form id=aspnetForm>%s</form>", "<aside>%s</aside>", "<form><div class='widget'>%s</div></form>", "<div role=dialog><aside>%s</aside></div>"])
def test_wrapped_pages_are_not_empty(wrap):
    for body in (f"<article>{ARTICLE}</article>", f"<div class=story>{ARTICLE}</div>"):
        assert pathratio.main_text(f"<html><body>{wrap % body}</body></html>") == WANT
        assert pathratio.main_text(wrap % (PAGE % body)) == WANT
    search = "<form><label>Search, all of it, here:</label></form>"
    assert pathratio.main_text(f"<html><body>{search}<div class=story>{ARTICLE}</div><aside><p>Also read, today, this.</p></aside></body></html>") == WANT


@pytest.mark.parametrize("n", [70, 70_000])
def test_end_tags_close_over_any_number_of_unclosed_ones(n):
    import time

    began = time.perf_counter()
    page = f"<html><body><nav>{'<b>' * n}Home, and more, of it</nav><article>{ARTICLE}</article></body></html>"
    assert pathratio.main_text(page) == WANT
    assert pathratio.main_text(f"<html><body><nav>{'<i><b></i>' * n}Home, and more</nav><article>{ARTICLE}</article></body></html>") == WANT
    assert time.perf_counter() - began < 10


def test_main_text_takes_time_in_proportion():
    import time

    body = "<p>Some text, of a page, that goes on.</p>"
    hard = [
        "<a " + '"" ' * 40000 + "<b", "<a '" * 40000, "<b>" * 60000 + "text, here." + "</i>" * 60000, "<h1>" * 40000 + body, "<svg>" * 20000 + body, "<!-" * 60000, "</" * 60000 + body, "<i><div>" + "<b></i>" * 40000, "<p><div>" + "<h1>" * 40000,
        "<div>" * 30000 + body, "<li>" * 40000, "&" * 200000, "<" * 200000, ("<div class='ad'>" + body) * 5000,
    ]
    for page in hard:
        began = time.perf_counter()
        pathratio.main_text(page)
        assert time.perf_counter() - began < 5, page[:40]


def test_path_weights_match_plain_sums():
    rng = np.random.default_rng(2)
    nodes = [(int(rng.integers(0, 9)), int(rng.integers(1, 200)), int(rng.integers(0, 9)), bool(rng.integers(0, 2))) for _ in range(60)]
    per = collections.defaultdict(list)
    for p, *x in nodes:
        per[p].append(x)
    text = [sum(x[0] for x in per[p]) / len(per[p]) for p, *_ in nodes]
    marks = [(sum(x[1] for x in per[p]) + 1) / len(per[p]) for p, *_ in nodes]

    def smooth(xs, i):
        ws = {j: math.exp(-((i - j) ** 2) / 2) for j in range(max(0, i - 2), min(60, i + 3))}
        return sum(w * xs[j] for j, w in ws.items()) / sum(ws.values())

    for i, ((p, *_), w) in enumerate(zip(nodes, pathratio.path_weights(nodes), strict=True)):
        free = 1 - sum(x[0] * x[2] for x in per[p]) / sum(x[0] for x in per[p])
        assert math.isclose(w, smooth(text, i) * smooth(marks, i) * free, rel_tol=1e-9)


def test_main_text_cases(spark):
    assert [pathratio.main_text(x) for x in (None, "", "  ", "a &lt; b\n c", "<p>x<p>y", "<article><p>cut &am", "<p>cut <a hre", "<!-- only", "<nav>a</nav>")] == ["", "", "", "a < b c", "x\n\ny", "cut &am", "cut", "", ""]
    assert pathratio.main_text("<div>" * 3000 + "deep, text." + "</div>" * 3000) == "deep, text."
    df = spark.createDataFrame([(1, "u", None, "t"), (2, None, PAGE % f"<article>{ARTICLE}</article>", "t")], "page_id long, url string, html string, text string")
    out = pathratio.extract(df).orderBy("page_id").collect()
    assert [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in out] == [(1, "u", "", 0), (2, None, WANT, len(WANT))]
    assert pathratio.extract(df.limit(0)).count() == 0


def test_main_text_of_pages(spark):
    import html

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))]
        assert pathratio.main_text(r["html"]) == "\n\n".join(filter(None, want))


# --- segmentations


def segmentations(vocab, text):
    """All segmentations with their probabilities, by recursion over the vocabulary."""
    ids = {p: i for i, p in enumerate(vocab.pieces) if isinstance(p, str)}
    prob = {int(i): math.exp(lp) for i, lp in zip(vocab.ids, vocab.logp, strict=True) if i >= 0}

    def go(s):
        if not s:
            return [((), 1.0)]
        out = []
        for n in range(1, len(s) + 1):
            if s[:n] in ids:
                out += [((ids[s[:n]], *r), prob[ids[s[:n]]] * q) for r, q in go(s[n:])]
        if s[0] not in ids:
            b = s[0].encode()
            out += [((*(int(vocab.byte_id[x]) for x in b), *r), math.exp(vocab.byte_logp * len(b)) * q) for r, q in go(s[1:])]
        return out

    found = go("▁" + text.replace(" ", "▁"))
    total = sum(p for _, p in found)
    return {ids: p / total for ids, p in found}


def test_gumbel_top_k_matches_enumeration():
    v = gumbel_pieces.vocabulary()
    text = "cat é😀"
    want = segmentations(v, text)
    n = 20000
    got = [[] for _ in range(n)]
    for docs_, ids, counts, logp, value, inc in gumbel_pieces.encode_texts(v, [text] * n, np.arange(n), 3):
        ends = np.cumsum(counts)
        for d, a, b, lp, g, q in zip(docs_, ends - counts, ends, logp, value, inc, strict=True):
            got[d].append((tuple(int(x) for x in ids[a:b]), lp, g, q))
    assert all(len({s[0] for s in x}) == len(x) == min(3, len(want)) for x in got)
    for s, lp, *_ in itertools.chain.from_iterable(got[:200]):
        assert math.isclose(math.exp(lp), want[s], rel_tol=1e-6)
    first = collections.Counter(x[0][0] for x in got)
    pair = collections.Counter((x[0][0], x[1][0]) for x in got)
    for s, p in want.items():
        assert abs(first[s] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
        for t, q in want.items():
            if s != t:
                assert abs(pair[s, t] / n - p * q / (1 - p)) < 5 * math.sqrt(p * q / n) + 2e-3
    assert all(x[0][2] >= x[1][2] for x in got)
    # inclusion scores weigh back to one
    assert abs(np.mean([sum(math.exp(lp) / q for _, lp, _, q in x) for x in got]) - 1) < 0.02


def test_encode_decode_round_trip(spark, real):
    rows = [(r["doc_id"], r["text"]) for r in real[:150]] + [(5000, None), (5001, ""), (5002, " "), (5003, "日本 \x00 ‍👩"), (5004, "x" * 5000), (5003, "日本 \x00 ‍👩")]
    out = gumbel_pieces.decode(gumbel_pieces.sample_encode(docs(spark, rows), k=3)).collect()
    texts = dict(rows)
    by = collections.defaultdict(list)
    for r in out:
        assert r["decoded"] == (texts[r["doc_id"]] or "") and r["n_pieces"] == len(r["ids"]) and 0 < r["inclusion"] <= 1 + 1e-9
        by[r["doc_id"]].append(tuple(r["ids"]))
    assert all(len(by[i]) == 3 == len(set(by[i])) for i, t in rows if t and len(t) > 20)
    assert by[5000] == by[5001] == [()]
    again = gumbel_pieces.sample_encode(docs(spark, rows[::-1]).repartition(3), k=3, ids=False).collect()
    key = lambda rs: sorted((r["doc_id"], r["sample"], r["ids_hash"], round(r["log_prob"], 6)) for r in rs)
    assert key(out) == key(again)
    assert gumbel_pieces.sample_encode(docs(spark, [])).count() == 0


def test_encode_query_returns_and_decodes_ids(spark, real):
    out = queries.op9_gumbel_pieces(spark, SF).select("doc_id", "sample", "ids", "n_pieces", "round_trip").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in real}
    assert {r["doc_id"] for r in out} == set(texts)
    v = gumbel_pieces.vocabulary()
    for r in out:
        assert r["round_trip"] and len(r["ids"]) == r["n_pieces"]
        if r["doc_id"] % 10 == 0:
            assert v.decode(r["ids"]) == texts[r["doc_id"]]


# --- quotes


def brute_threads(rows):
    """(reply_to, position) of each message."""
    mark = re.compile(r"^[ \t]*(>[ \t]*)+")
    norm = lambda s: re.sub(r"\s+", " ", mark.sub("", s)).strip().lower()
    lines = {(c, t): re.split(r"\r?\n", x or "") for c, t, x in rows}
    first = {}
    for (c, t), ls in sorted(lines.items()):
        for s in ls:
            if not mark.match(s) and norm(s):
                first.setdefault((c, norm(s)), t)
    up = {}
    for (c, t), ls in lines.items():
        votes = collections.Counter()
        level = {}
        for s in ls:
            m = mark.match(s)
            if m and norm(s):
                k = m[0].count(">")
                level[norm(s)] = min(level.get(norm(s), 99), k)
                votes[norm(s)] += 1
        score = collections.Counter()
        for s, n in votes.items():
            o = first.get((c, s))
            if o is not None and o < t:
                score[level[s], o] += n
        if score:
            up[c, t] = min(score, key=lambda x: (x[0], -score[x], -x[1]))[1]
    path = lambda c, t: (path(c, up[c, t]) if (c, t) in up else []) + [t]
    place = {}
    for c in {c for c, _ in lines}:
        for i, t in enumerate(sorted((t for k, t in lines if k == c), key=lambda t: path(c, t))):
            place[c, t] = i
    return {k: (up.get(k), place[k]) for k in lines}


QUOTED = [
    (1, 0, "Hello there\nHow are you?"), (1, 1, "> hello   THERE\nHi, fine."), (1, 2, ">> Hello there\n> Hi, fine.\nGood to hear."), (1, 3, "Something else"),
    (1, 4, "> Good to hear.\n> Something else\nBoth."), (1, 5, "> Hello there\n> How are you?\nLate."), (1, 6, "> nothing like it\nNo."), (1, 7, "> Both.\r\n  > > x\r\nYes."),
    (2, 0, "> Hello there\nOther talk."), (2, 1, None), (2, 2, ""), (2, 3, "> Other talk.\n> > Hello there\nok"), (3, 0, "> self\nself"),
    (4, 1700000000000, "a line"), (4, 1700000000009, "> a line\nnine"), (4, 1700000000001, "> a line\none"), (4, -5, "before all"), (4, 1700000000010, "> one\nten"), (4, 3, "> before all\nafter"),
]
TALKS = "conv_id long, turn long, role string, text string, hash string"


def test_quote_threads(spark):
    df = spark.createDataFrame([(c, t, "user", x, "z") for c, t, x in QUOTED], TALKS)
    out = {(r["conv_id"], r["turn"]): r for r in quotes.threads(df).collect()}
    assert {k: (r["reply_to"], r["position"]) for k, r in out.items()} == brute_threads(QUOTED)
    assert out[1, 2]["own_text"] == "Good to hear." and out[1, 2]["max_level"] == 2 and out[1, 2]["n_quoted"] == 2 and out[1, 2]["hash"] == "z"
    assert out[2, 1]["own_text"] == "" and out[1, 2]["reply_to"] == 1
    order = [k[1] for k in sorted(out, key=lambda k: (k[0], out[k]["position"])) if k[0] == 1]
    assert order == [0, 1, 2, 5, 3, 4, 7, 6]
    assert [k[1] for k in sorted(out, key=lambda k: out[k]["position"]) if k[0] == 4] == [-5, 3, 1700000000000, 1700000000001, 1700000000010, 1700000000009]
    assert quotes.threads(df.limit(0)).count() == 0


def test_quote_conversations(spark):
    df = spark.createDataFrame([(c, t, "user", x, "z") for c, t, x in QUOTED], TALKS)
    want = brute_threads(QUOTED)
    built = quotes.conversations(df, page=3).collect()
    assert all(r["n_messages"] == len(r["messages"]) <= 3 for r in built)
    for c in (1, 2, 3, 4):
        got = [m for r in sorted((r for r in built if r["conv_id"] == c), key=lambda r: r["page"]) for m in r["messages"]]
        assert [m["turn"] for m in got] == sorted((t for k, t in want if k == c), key=lambda t: want[c, t][1])
        assert not any(line.lstrip().startswith(">") for m in got for line in m["text"].split("\n"))
    assert quotes.conversations(df.limit(0)).count() == 0


def test_quote_long_chain_and_nulls(spark):
    rows = [(1, t, (f"> line {t - 1}\n" if t else "") + f"line {t}") for t in range(40)] + [(None, 0, "a b"), (None, 1, "> a b\nc"), (4, None, "> line 1"), (5, 2, "twice"), (5, 2, "twice")]
    df = spark.createDataFrame([(c, t, "user", x, "z", 7) for c, t, x in rows], "conv_id long, turn long, role string, text string, own_text string, position int")
    out = {(r["conv_id"], r["turn"]): r for r in quotes.threads(df).collect()}
    assert out[1, 39]["position"] == 39 == out[1, 39]["reply_rank"] and out[1, 39]["root_turn"] == 0
    assert out[None, 1]["reply_to"] == 0 and out[None, 1]["position"] == 1 and out[4, None]["reply_to"] is None and out[4, None]["position"] == 0
    assert quotes.threads(df).count() == len(rows)


def test_quotes_that_were_wrapped_anew_or_credited(spark):
    said = "The quick brown fox jumps over the lazy dog and runs away.\nThen it sleeps, for a long time, in the shade of a tree."
    rows = [
        (1, 0, said), (1, 1, "Something else, that has nothing to do with it."),
        (1, 2, "On Monday, Bob wrote:\n> The quick brown fox jumps over\n> the lazy dog and runs away. Then it\n> sleeps, for a long time, in the\n> shade of a tree.\nI saw it."),
        (1, 3, "Ann schrieb:\n\n> On Monday, Bob wrote:\n>> The quick brown fox\n>> jumps over the lazy dog and runs away. Then\n> I saw it.\nSo did I."),
        (1, 4, "-----Original Message-----\n> Something else, that has\n> nothing to do with it.\nYes.\nHe wrote:\nno quote here."),
        (2, 0, "> The quick brown fox jumps over the lazy dog\nIn another conversation."),
    ]
    df = spark.createDataFrame([(c, t, "user", x, "z") for c, t, x in rows], TALKS)
    out = {(r["conv_id"], r["turn"]): r for r in quotes.threads(df).collect()}
    assert {k: r["reply_to"] for k, r in out.items()} == {(1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 2, (1, 4): 1, (2, 0): None}
    assert [out[1, t]["own_text"] for t in (2, 3, 4)] == ["I saw it.", "So did I.", "Yes.\nHe wrote:\nno quote here."]
    assert out[1, 3]["n_quoted"] == 3 and out[1, 3]["max_level"] == 2


def test_conversations_of_many_repeated_rows_have_bounded_pages(spark):
    rows = [(1, None, "no turn")] * 2000 + [(1, 5, "again")] * 1500 + [(1, t, f"turn {t}") for t in range(1, 40)] + [(None, None, "x")] * 300 + [(2, 0, "a"), (2, 1, "> a\nb")]
    df = spark.createDataFrame([(c, t, "user", x, "z") for c, t, x in rows], TALKS).repartition(3)
    built = quotes.conversations(df, page=256).collect()
    assert all(0 < r["n_messages"] == len(r["messages"]) <= 256 for r in built)
    got = collections.Counter((r["conv_id"], m["turn"], m["text"]) for r in built for m in r["messages"])
    assert got == collections.Counter((c, t, re.sub("^> .*\n", "", x)) for c, t, x in rows)
    for c in (None, 1, 2):
        own = [m["position"] for r in sorted((r for r in built if r["conv_id"] == c), key=lambda r: (r["page"], r["part"])) for m in r["messages"]]
        assert own == sorted(own)
    assert len({(r["conv_id"], r["page"], r["part"]) for r in built}) == len(built)
    # parts are full but for the last of a page
    for r in built:
        later = any((x["conv_id"], x["page"]) == (r["conv_id"], r["page"]) and x["part"] > r["part"] for x in built)
        assert r["n_messages"] == 256 or not later


def test_quote_many_replies_and_random_trees(spark):
    rng = np.random.default_rng(4)
    turns = sorted(set((rng.integers(0, 400_000, 300)).tolist()))
    rows = [(9, turns[0], f"t {turns[0]}")]
    for i, t in enumerate(turns[1:], 1):
        q = turns[0] if i % 3 == 0 else turns[int(rng.integers(0, i))]
        rows.append((9, t, f"> t {q}\nt {t}"))
    df = spark.createDataFrame([(c, t, "user", x, "z") for c, t, x in rows], TALKS)
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["position"]) for r in quotes.threads(df).collect()}
    assert got == brute_threads(rows)


# --- the registered queries


def test_oracles(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        cur = con.execute(sql)
        cols = [c[0] for c in cur.description]
        assert sorted(df.columns) == sorted(cols)
        assert sorted(map(tuple, df.select(*cols).collect())) == sorted(cur.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix", "encode"]
    source = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    kept = {r["doc_id"] for r in out}
    texts = {r["doc_id"]: r["text"] for r in source.collect()}
    assert len(out) == 2 * len(kept)
    # what is left has no two equal or near texts, and each text that went has a like one that stayed or was rejected by stage one
    left = brute_classes([(i, texts[i]) for i in kept])
    assert all(c == i and n == 0 for i, (c, n) in left.items())
    stage1 = {r["doc_id"] for r in corpus_pipeline.language_id(spark, source, SF).collect()}
    assert len(stage1) > 0.98 * len(texts)
    classes = brute_classes([(i, texts[i]) for i in stage1])
    assert {c for c, _ in classes.values()} == kept


def test_pipeline_result_keeps_the_mixture(spark):
    import corpus_pipeline

    rows = [(i, f"text {i}", "en", "hot" if i % 10 < 7 else f"s{i % 10}", 1, "x", 2) for i in range(3000)]
    mixed = corpus_pipeline.written(corpus_pipeline.mix(spark, spark.createDataFrame(rows, DOCS), SF), "mix")
    out = corpus_pipeline.encode(spark, mixed, SF).filter("sample = 1").orderBy("mix_position").collect()
    assert {(r["doc_id"], r["source"]) for r in out} == {(r[0], r[3]) for r in rows} and len({r["mix_position"] for r in out}) == len(rows)
    target = pfair.tempered(collections.Counter(r[3] for r in rows), 0.5)
    blocks = [s for s, _ in itertools.groupby(out, lambda r: (r["mix_position"] // 16, r["source"]))]
    assert [t for t, _ in blocks] == list(range(len(blocks)))
    done = collections.Counter()
    for t, s in blocks:
        done[s] += 1
        assert all(abs(done[x] - (t + 1) * w / sum(target.values())) < 1 + 1e-6 for x, w in target.items())
        if done[s] * 16 >= sum(r[3] == s for r in rows):
            break  # a source has run out


def test_shared_dir_without_a_setting():
    from types import SimpleNamespace

    from marlstone.llm.common import shared_dir

    held = {}
    spark = SimpleNamespace(conf=SimpleNamespace(get=held.get, set=held.__setitem__), sparkContext=SimpleNamespace(master="local[2]"))
    first = shared_dir(spark)
    assert shared_dir(spark) == first and "spark.checkpoint.dir" not in held
    far = SimpleNamespace(conf=SimpleNamespace(get={}.get, set=None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_dir(far)
    held["spark.checkpoint.dir"] = "s3a://shared/folder/"
    assert shared_dir(spark) == "s3a://shared/folder"


def test_pipeline_stages_on_hard_rows(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names, an empty table."""
    import corpus_pipeline

    cols = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, __sha int, __h int, mix_slot int"
    words = [f"{a}{b}" for a in ("un", "be", "al", "or") for b in ("ta", "mi", "lo", "ne", "ru")]
    text = lambda i, n=30: " ".join(words[(i * 7 + j * j) % 20] + chr(97 + (i * j) % 26) for j in range(n))
    rows = [(i, text(i), "en" if i % 2 else "de", "a" if i % 3 else None, 1, 0.5, "x", 1, 2, 3) for i in range(120)]
    rows += [(200, text(5), None, "b", None, None, None, None, None, None), (201, "", "en", "b", 0, 0.1, "y", 1, 1, 1), (202, None, None, None, None, None, None, None, None, None)]
    rows += [(None, text(300, 37), "en", "c", 1, 0.2, "z", 1, 1, 1), (7, text(7), "en", "a", 1, 0.5, "x", 1, 2, 3), (203, text(400, 20000), "en", "c", 1, 0.5, "x", 1, 2, 3)]
    docs = spark.createDataFrame(rows, cols)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert name == "encode" or docs.columns[: len(cols.split(", "))] == [c.split()[0] for c in cols.split(", ")]
    out = docs.collect()
    assert {r["doc_id"] for r in out} >= {1, 2, 203, None} and not {r["doc_id"] for r in out} & {200, 201, 202}
    assert sum(r["doc_id"] == 7 for r in out) == 2
