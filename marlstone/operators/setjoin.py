"""Exact set-similarity join: Jaccard by prefixes, and the choice of a winner by margin.

Tokens have one order for both sides: rare ones first, by their counts among the right
side's sets. Two sets can reach the threshold only if the first few tokens of each
meet (the prefix filter) and their sizes are near enough, so sets meet on these tokens
and their exact overlap decides there: a pair that doesn't reach it is never shuffled. Only tokens with more than one ten-thousandth of all
occurrences have a count of their own in the order, which are ten thousand at most and
are broadcast; the others count as equally rare and go by hash.

A choice needs each query's two best names only, and a few forms with many variants would meet in pairs
of all of them. So only tokens of few names are met on there. Pairs whose common tokens are all frequent are
found by these tokens' subsets instead: of each subset the two smallest names that hold it are kept, as a
name's score with a query is that of their common subset and its size. The work is that of the sets, not of the pairs.

Cases: null or empty sets meet nothing; tokens count once a set; rows of one id are
one set, the union of their tokens; a null id is left out; empty tables give an empty
result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written
from .search import lexical_choice

OWN_COUNT = 10_000
#: Thresholds by which queries are tried before the one that a choice asks for.
FIRST = (0.64, 0.4)
#: For choices: tokens of more names are frequent (a million tokens at most are; of more in proportion, where fewer queries than names are left), and sets with more frequent tokens than ENUMERATED are met on them.
FREQUENT, FREQUENT_SHARE, ENUMERATED = 512, 1_000_000, 12
#: Subsets of queries up to this number are broadcast.
FEW = 200_000


def _ordered(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, tokens in order, those with a count of their own, n)."""
    each = sets.select("id", F.explode("tokens").alias("t")).filter("t is not null and id is not null").distinct()
    place = F.struct(F.coalesce("count", F.lit(0)).alias("c"), F.xxhash64("t").alias("h"), "t")
    rows = each.join(F.broadcast(counts), "t", "left").groupBy("id").agg(F.sort_array(F.collect_list(place)).alias("l"))
    return rows.select("id", F.transform("l", lambda x: x["t"]).alias("tokens"), F.filter("l", lambda x: x["c"] > 0).alias("often"), F.size("l").alias("n"))


def _least(n: Column, least: float) -> Column:
    return F.ceil(least * n - 1e-9).cast("int")


def _judged(met: DataFrame, least: float) -> DataFrame:
    """(a, b, score) of pairs of rows x and y that met on a token, once each and if they reach the threshold."""
    near = met.filter((F.col("y.n") >= _least(F.col("x.n"), least)) & (F.col("x.n") >= _least(F.col("y.n"), least)))
    both = near.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("__m"), F.col("y.n").alias("__n"), F.col("x.t").alias("__t"), F.array_intersect("x.tokens", "y.tokens").alias("__both"))
    common = F.size("__both")
    scored = both.withColumn("score", common / (F.col("__m") + F.col("__n") - common))
    # the first common token of a pair that reaches the threshold is in both prefixes, and the pair counts there
    return scored.filter((F.col("score") >= least - 1e-12) & (F.get("__both", F.lit(0)) == F.col("__t"))).select("a", "b", "score")


def jaccard_join(left: DataFrame, right: DataFrame, least: float, *, left_id: str, right_id: str, left_tokens: Column, right_tokens: Column) -> DataFrame:
    """(left_id, right_id, score) of all pairs whose sets have a Jaccard similarity of ``least`` (above 0) or more."""
    a, b = left.select(F.col(left_id).alias("id"), left_tokens.alias("tokens")), right.select(F.col(right_id).alias("id"), right_tokens.alias("tokens"))
    words = b.select(F.explode("tokens").alias("t"))
    floor = max(2, words.count() // OWN_COUNT)
    counts = words.groupBy("t").count().filter(F.col("count") > floor)
    prefix = lambda s: s.select("id", "n", "tokens", F.explode(F.slice("tokens", F.lit(1), F.col("n") - _least(F.col("n"), least) + 1)).alias("t"))
    met = prefix(_ordered(a, counts)).alias("x").join(prefix(_ordered(b, counts)).alias("y"), F.col("x.t") == F.col("y.t"))
    return _judged(met, least).select(F.col("a").alias(left_id), F.col("b").alias(right_id), "score")


def _two_best(x: DataFrame, y: DataFrame, least: float, frequent: int) -> DataFrame:
    """(a, b, score): of ordered sets x each one's two best of y that reach the threshold, and some others that do; the score of these may be too low."""
    x, y = (s.withColumn("often", F.transform(F.filter("often", lambda z: z["c"] > frequent), lambda z: z["t"])) for s in (x, y))
    big = F.size("often") > ENUMERATED
    # rare tokens meet as kind 0, frequent ones as kind 1 if x is big and as kind 2 if only y is
    kinds = {"x": F.when(big, F.array(F.lit(1))).otherwise(F.array(F.lit(2))), "y": F.when(big, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))}

    def prefix(s, side):
        each = s.select("id", "n", "tokens", "often", F.posexplode(F.slice("tokens", F.lit(1), F.col("n") - _least(F.col("n"), least) + 1)).alias("i", "t"))
        kind = F.when(F.col("i") < F.col("n") - F.size("often"), F.array(F.lit(0))).otherwise(kinds[side])
        return each.select("id", "n", "tokens", "t", F.explode(kind).alias("kind")).alias(side)

    met = prefix(x, "x").join(prefix(y, "y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.kind") == F.col("y.kind")))

    def subsets(s):
        h = F.size("often")
        some = s.filter(~big & (h >= F.greatest(F.lit(1), _least(F.col("n"), least)))).repartition(s.sparkSession.sparkContext.defaultParallelism * 4)
        masks = F.filter(F.sequence(F.lit(1), (F.pow(F.lit(2), h) - 1).cast("int")), lambda m: F.bit_count(m) >= F.col("low"))
        each = some.withColumn("low", _least(F.col("n"), least)).select("id", "n", "often", F.explode(masks).alias("mask"))
        key = F.filter(F.array_sort("often"), lambda t, i: F.getbit(F.col("mask"), i) == 1)
        return each.select("id", "n", key.alias("key")).withColumn("h", F.xxhash64("key"))

    asked = written(subsets(x), "subsets")
    keys = asked.select("h", "key").distinct()
    held = subsets(y).join(F.broadcast(keys) if asked.count() <= FEW else keys, ["h", "key"], "left_semi")
    held = held.withColumn("place", F.row_number().over(Window.partitionBy("h", "key").orderBy("n", "id"))).filter("place <= 2")
    found = asked.alias("x").join(held.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.key") == F.col("y.key")))
    score = F.size("x.key") / (F.col("x.n") + F.col("y.n") - F.size("x.key"))
    by_subset = found.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), score.alias("score")).filter(F.col("score") >= least - 1e-12)
    return _judged(met, least).unionByName(by_subset).groupBy("a", "b").agg(F.max("score").alias("score"))


def lexical_match(queries: DataFrame, names: DataFrame, *, query: str, name: str, query_tokens: Column, name_tokens: Column, least: float = 0.35, margin: float = 0.10) -> DataFrame:
    """Each query's one best name by Jaccard if it reaches ``least`` and is ``margin`` ahead of the next, else null with the reason.

    Names that are ``margin`` or more below the threshold can't change a choice. Queries with the same tokens are asked once, first
    with high thresholds: where two names are found, or one that is ``margin`` above a threshold, no name below that can change the choice."""
    low = max(least - margin, 0.05)
    tokens = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.filter(query_tokens, lambda x: x.isNotNull()), F.array().cast("array<string>"))))))
    asks = written(queries.filter(F.col(query).isNotNull()).groupBy(query).agg(tokens.alias("__s")), "asks")
    sets = names.select(F.col(name).alias("id"), name_tokens.alias("tokens"))
    words = sets.select(F.explode("tokens").alias("t"))
    counts = written(words.groupBy("t").count().filter(F.col("count") > max(FREQUENT, words.count() // FREQUENT_SHARE)), "counts")
    rest, y, choices = written(asks.select("__s").distinct(), "rest"), written(_ordered(sets, counts), "names"), []
    x = written(_ordered(rest.select(F.col("__s").alias("id"), F.col("__s").alias("tokens")), counts), "sets")
    many = y.count()
    for t in [*(t for t in FIRST if t > low), low]:
        first = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
        frequent = FREQUENT * max(1, many // max(1, rest.count()))
        near = _two_best(x, y, t, frequent).withColumn("score", F.round("score", 9)).withColumn("__n", first).filter("__n <= 2")
        near = written(near.select(F.col("a").alias("__s"), F.col("b").alias(name), "score"), "near")
        if t > low:
            sure = near.groupBy("__s").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("many")).filter((F.col("best") >= t + margin + 1e-6) | (F.col("many") == 2)).select("__s")
            near, rest = near.join(sure, "__s", "left_semi"), written(rest.join(sure, "__s", "left_anti"), "rest")
            x = written(x.join(rest.select(F.col("__s").alias("id")), "id", "left_semi"), "sets")
        else:
            near = rest.join(near, "__s", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        choices.append(lexical_choice(near.select("__s", name, "score"), query="__s", item=name, least=least, margin=margin))
    return asks.join(functools.reduce(DataFrame.unionByName, choices), "__s").select(query, "chosen", "reason")
