"""The word index with positions and segments, dictionary mentions and set joins against brute force, and their stated cases."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import mentions as M
from marlstone.operators import search as S
from marlstone.operators import setjoin as J
from marlstone.sources.shared import kept

WORDS = ["of", "the", "a", "net", "é", "deep", "x1", "load"]


def said(seed, n, most=40):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, int(rng.integers(0, most)))) for _ in range(n)]


def plain(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def occurrences(text, phrase):
    w, p = plain(text), phrase.split()
    return sum(w[i : i + len(p)] == p for i in range(len(w) - len(p) + 1))


ROWS = [(i, t) for i, t in enumerate(said(1, 150))] + [(None, "of the"), (200, None), (201, ""), (202, "Of, THE. of-the!"), (203, "the " * 30_000 + "of the net"), (204, "of"), (204, "the")]


@pytest.mark.parametrize("buckets", [64, 16, 1])
def test_phrases_by_positions(spark, buckets):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    index = S.build(df, {"content": F.col("text"), "title": F.substring_index("text", " ", 3)}, buckets=buckets)
    for phrase in ("of the", "the the the", "of the of the", "deep", "net load net", "nowhere of"):
        got = {r["doc_id"]: r["hits"] for r in S.phrase(index, phrase).collect()}
        want = collections.Counter()
        for i, t in ROWS:
            if i is not None:
                want[i] += occurrences(t, phrase)
        assert got == {i: n for i, n in want.items() if n}, phrase
    assert S.phrase(index, "").count() == 0
    # every bucket number finds the same documents
    assert {r["doc_id"] for r in S.bm25(index, ["net", "load"], boosts={"content": 1.0}).collect()} == {i for i, t in ROWS if i is not None and set(plain(t)) & {"net", "load"}}
    top = S.named(index, "of the", fields={"title": 5, "content": 1}).collect()
    assert top[0]["score"] == 6 and all(a["score"] >= b["score"] for a, b in zip(top, top[1:], strict=False)) and len(top) <= 10


def test_a_grown_index_is_a_fresh_one(spark):
    fields = {"content": F.col("text")}
    old, new = said(2, 80), said(3, 80)
    first = spark.createDataFrame(list(enumerate(old[:50])), "doc_id long, text string")
    again = spark.createDataFrame([(i, new[i]) for i in range(30, 80)], "doc_id long, text string")  # 30 to 49 come again
    third = spark.createDataFrame([(i, old[i]) for i in range(45, 48)] + [(90, None)], "doc_id long, text string")
    grown = S.append(S.append(S.build(first, fields, buckets=8), again, fields), third, fields)
    now = old[:30] + new[30:45] + old[45:48] + new[48:80]
    fresh = S.build(spark.createDataFrame([*enumerate(now), (90, None)], "doc_id long, text string"), fields)
    look = lambda x: ({r["doc_id"]: r["hits"] for r in S.phrase(x, "of the").collect()}, {r["doc_id"]: round(r["score"], 9) for r in S.bm25(x, "deep load").collect()}, x.stats)
    assert look(grown) == look(fresh) == look(S.merged(grown))
    assert S.merged(grown).segments == 1 and grown.segments == 3
    empty = S.build(first.limit(0), fields)
    assert S.phrase(empty, "of").count() == 0 and look(S.append(empty, again, fields))[0]


def shuffled_mb(spark, run):
    """MB written to shuffles while ``run`` runs."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    total = lambda: sum(x.shuffleWriteBytes() for x in (lambda at: [at.apply(i) for i in range(at.size())])(store.stageList(None, False, False, none, None)))
    before = total()
    run()
    return (total() - before) / 1e6


def test_an_index_is_written_without_a_shuffle_of_postings(spark):
    """postings of 4 MB were shuffled at each build, append and merge, and joined with the replaced ids."""
    fields = {"content": F.col("text")}
    docs = spark.createDataFrame(list(enumerate(said(9, 3000, 80))), "doc_id long, text string").repartition(4).localCheckpoint()
    made = []

    def run():
        made.append(S.append(S.build(docs, fields), docs.filter("doc_id % 3 = 0"), fields))
        made.append(S.merged(made[0]))

    assert shuffled_mb(spark, run) < 0.2
    assert made[1].postings.count() == made[0].postings.count() == made[0].postings.select("id", "term").distinct().count()


def test_a_merged_index_grows_again(spark):
    """replaced rows are noted by number, so rows of merged segments must keep apart."""
    fields = {"content": F.col("text")}
    texts, frame = said(8, 90), lambda ids, rows: spark.createDataFrame([(i, rows[i]) for i in ids], "doc_id long, text string")
    new = [f"of the {t}" for t in texts]
    index = S.merged(S.append(S.build(frame(range(60), texts), fields, buckets=4), frame(range(50, 90), texts), fields))
    for ids in (range(0, 5), range(3, 8), range(70, 75)):
        index = S.append(index, frame(ids, new), fields)
    changed = {*range(8), *range(70, 75)}
    want = {i: occurrences(new[i] if i in changed else t, "of the") for i, t in enumerate(texts)}
    for x in (index, S.merged(index)):
        assert {r["doc_id"]: r["hits"] for r in S.phrase(x, "of the").collect()} == {i: n for i, n in want.items() if n}


def test_a_changed_folder_gets_a_new_index(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    write = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string").write.mode("overwrite").parquet(path)
    write([(1, "of the net", "s")])
    first = S.opened(spark, str(tmp_path))
    assert S.opened(spark, str(tmp_path)) is first and S.phrase(first, "of the").count() == 1
    write([(1, "a net", "s"), (2, "deep of the", "s"), (3, "of the", "s")])
    spark.catalog.refreshByPath(path)
    assert {r["doc_id"] for r in S.phrase(S.opened(spark, str(tmp_path)), "of the").collect()} == {2, 3}
    assert not (tmp_path.parent / first.path).exists() and S.opened(spark, str(tmp_path)).path != first.path
    made = []
    for _ in range(2):
        kept(spark, "test", path, lambda: made.append(1) or len(made))
    assert made == [1]


def test_mentions_longest_first_none_overlapping(spark):
    names = ["the net", "Deep Net", "of the net", "load", "net load net", "of", "x1!", "é a", "", None, "DEEP net", "never said here"]
    rows = [(i, t) for i, t in enumerate(said(4, 60))] + [(None, "of the net"), (7, None), (8, ""), (9, "Of... the, NET load net é-a"), (10, "net load " * 5000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, name string, size int")
    got = collections.Counter(tuple(r) for r in M.mentions(df, spark.createDataFrame([(n,) for n in names], "name string")).collect())
    keys = {}
    for n in sorted(x for x in names if x):
        if plain(n):
            keys.setdefault(tuple(plain(n)), n)
    want = collections.Counter()
    for i, t in rows:
        w = plain(t)
        taken, spans = [False] * len(w), [(-m, s) for m in {len(k) for k in keys} for s in range(len(w) - m + 1) if tuple(w[s : s + m]) in keys]
        for m, s in sorted(spans):
            if not any(taken[s : s - m]):
                taken[s : s - m] = [True] * -m
                want[i, s, -m, keys[tuple(w[s : s - m])]] += 1
    assert got == want
    assert M.mentions(df, spark.createDataFrame([], "name string")).count() == 0 and M.mentions(df.limit(0), spark.createDataFrame([("of",)], "name string")).count() == 0


def test_mentions_of_many_names(spark, monkeypatch):
    monkeypatch.setattr(M, "FIRST_WORDS", 10)
    names = spark.range(20_000).select(F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(" of")).alias("name"))
    df = spark.createDataFrame([(1, "n5 of n19999 of n20000 of n5")], "doc_id long, text string")
    assert [tuple(r) for r in M.mentions(df, names).orderBy("start").collect()] == [(1, 0, 2, "n5 of"), (1, 2, 2, "n19999 of")]


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_jaccard_join_is_complete(spark, monkeypatch, least):
    monkeypatch.setattr(J, "OWN_COUNT", 20)  # so that a few tokens have counts of their own
    left = [(i, t) for i, t in enumerate(said(5, 70, 8))] + [(None, "of the"), (500, None), (501, ""), (1, "deep x1")]
    right = [(f"r{i}", t) for i, t in enumerate(said(6, 70, 8))] + [(None, "of the"), ("none", None)] + [(f"hot{i}", "of the net") for i in range(40)]
    a, b = spark.createDataFrame(left, "a long, t string"), spark.createDataFrame(right, "b string, t string")
    got = {(r["a"], r["b"]): r["score"] for r in J.jaccard_join(a, b, least, left_id="a", right_id="b", left_tokens=T.words(F.col("t")), right_tokens=T.words(F.col("t"))).collect()}
    sets = lambda rows: {k: set().union(*(plain(t) for i, t in rows if i == k)) for k in {i for i, _ in rows} - {None}}
    want = {(i, j): len(x & y) / len(x | y) for i, x in sets(left).items() for j, y in sets(right).items() if x and y and len(x & y) / len(x | y) >= least - 1e-12}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_lexical_match(spark):
    q = spark.createDataFrame([("a", "deep net load"), ("b", "of the"), ("c", "nothing here"), ("d", None), (None, "of")], "q string, t string")
    n = spark.createDataFrame([("Deep net load", "deep net load"), ("Of the x", "of the x"), ("Of the y", "of the y")], "n string, t string")
    out = J.lexical_match(q, n, query="q", name="n", query_tokens=T.words(F.col("t")), name_tokens=T.words(F.col("t")))
    assert {r["q"]: (r["chosen"], r["reason"]) for r in out.collect()} == {
        "a": ("Deep net load", "unique_lexical_winner"), "b": (None, "margin_below_threshold"), "c": (None, "score_below_threshold"), "d": (None, "score_below_threshold"),
    }


@pytest.mark.parametrize(("frequent", "enumerated"), [(512, 12), (3, 12), (3, 2), (0, 4)])
def test_lexical_match_is_that_of_all_pairs(spark, monkeypatch, frequent, enumerated):
    """choices by rare tokens, by subsets of frequent ones, and by frequent ones where a set has too many."""
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "ENUMERATED", enumerated)
    queries = [(f"q{i}", f"{t} u{i % 7}" if i % 3 else t) for i, t in enumerate(said(11, 90, 9))]
    names = [(f"n{i}", f"{t} u{i % 9}" if i % 4 else t) for i, t in enumerate(said(12, 120, 9))] + [("same", "of the net"), ("same too", "net the of")]
    a, b = spark.createDataFrame(queries, "q string, t string"), spark.createDataFrame(names, "n string, t string")
    got = {r["q"]: (r["chosen"], r["reason"]) for r in J.lexical_match(a, b, query="q", name="n", query_tokens=T.words(F.col("t")), name_tokens=T.words(F.col("t"))).collect()}
    want = {}
    for q, t in queries:
        x = set(plain(t))
        scores = sorted((-round(len(x & y) / len(x | y), 9) if x | y else 0.0, n) for n, y in ((n, set(plain(u))) for n, u in names))
        best, second = -scores[0][0], -scores[1][0]
        ok = best >= 0.35 and round(best - second, 9) >= 0.1
        want[q] = (scores[0][1], "unique_lexical_winner") if ok else (None, "score_below_threshold" if best < 0.35 else "margin_below_threshold")
    assert got == want and len(set(want.values())) > 5


def test_variants_of_a_form_do_not_meet_in_pairs(spark, monkeypatch):
    """1,500 variants of one line were judged as 1,500 x 1,500 pairs."""
    monkeypatch.setattr(J, "FREQUENT", 20)
    judged, own = [], J._judged
    monkeypatch.setattr(J, "_judged", lambda met, least: judged.append(met.count()) or own(met, least))
    names = spark.range(1500).select(F.concat(F.lit("under the licence of v"), F.col("id").cast("string")).alias("n"))
    asks = spark.range(1500).select(F.col("id").cast("string").alias("q"), F.concat(F.lit("under the licence v"), F.col("id").cast("string")).alias("t"))
    out = J.lexical_match(asks, names, query="q", name="n", query_tokens=T.words(F.col("t")), name_tokens=T.words(F.col("n")))
    assert {(r["chosen"] or "").rsplit("v", 1)[-1] == r["q"] for r in out.collect()} == {True}
    assert sum(judged) < 10_000


def test_words_are_counted_where_they_are_read(spark, monkeypatch):
    monkeypatch.setattr(S, "WORDS_AT_ONCE", 50)
    rows = [(i, t) for i, t in enumerate(said(9, 60)) if t] + [(90, None), (91, "of of the of")]
    words = spark.createDataFrame(rows, "id long, text string").select(F.lit("content").alias("field"), "id", F.col("id").alias("row"), T.words(F.coalesce("text", F.lit(""))).alias("w")).withColumn("dl", F.size("w"))
    found = S._posted(words, "bigint")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["id"], r["term"]): (r["tf"], list(r["positions"]), r["dl"]) for r in found.collect()}
    want = {(i, w): (plain(t).count(w), [at for at, x in enumerate(plain(t)) if x == w], len(plain(t))) for i, t in rows for w in plain(t)}
    assert got == want


def test_pairs_are_judged_where_they_meet(spark):
    """Only prefixes are joined: one join, and no pair is made distinct or joined with its sets afterwards."""
    df = spark.createDataFrame([(i, ["a", "b", f"x{i}"]) for i in range(20)], "a long, w array<string>")
    out = J.jaccard_join(df, df.withColumnRenamed("a", "b"), 0.5, left_id="a", right_id="b", left_tokens=F.col("w"), right_tokens=F.col("w"))
    assert sorted(tuple(r) for r in out.collect()) == [(i, j, 1.0 if i == j else 0.5) for i in range(20) for j in range(20)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1
