"""Evidence of answers: cards, screens, groups, renderings, citations, evaluation gates.

Cases: null text counts as empty; null flags as false; ties go to the smaller key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Lengths, limits, and the two domains whose names collide.
PREVIEW, SHOWN, SIGNED, SIGNED_CHARS = 500, 300, 4, 160
SENSES = {
    "echo-state-network": (("echo belief network", "回声信念网络", "enterprise social network", "enterprise social networks", "edible swiftlet", "swiftlet's nest"), ("echo state network", "echo-state network", "回声状态网络"), "all"),
    "markov-chain-monte-carlo": ((), ("markov chain monte carlo", "马尔科夫链蒙特卡洛", "mcmc"), "heading"),
}


def preview(c: Column, most: int = PREVIEW) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def card(df: DataFrame, names: dict[str, str], **more: Column) -> DataFrame:
    """Columns and nested fields under new names."""
    return df.select(*[F.col(c).alias(n) for n, c in names.items()], *[c.alias(n) for n, c in more.items()])


def _any_of(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(c), F.lit(w))
    return F.coalesce(out, F.lit(False))


def of_sense(heading: Column, text: Column, sense: str, senses: dict[str, tuple] = SENSES) -> Column:
    """Rows that speak of one domain: its words in heading or text, none of the other domain's in the heading."""
    if not sense or sense not in senses:
        return F.lit(True)
    barred, wanted, where = senses[sense]
    return ~_any_of(heading, barred) & _any_of(heading if where == "heading" else F.concat_ws(" ", heading, text), wanted)


def relevant(rows: DataFrame, entities: list[str], *, query: str, text: str) -> DataFrame:
    """Of each query the rows whose text holds an entity; all its rows if none does."""
    hit = _any_of(F.col(text), tuple(e.lower() for e in entities))
    any_ = F.max(hit).over(Window.partitionBy(query))
    return rows.withColumns({"__hit": hit, "__any": any_}).filter("__hit or not __any").drop("__hit", "__any")


def outside_scope(evidence: DataFrame, selected: DataFrame, id_col: str) -> DataFrame:
    """Evidence of documents that weren't selected; an answer needs this to be empty."""
    return evidence.join(selected.select(id_col).distinct(), id_col, "left_anti")


def by_document(evidence: DataFrame, *, doc: str, order: str, text: str, page: str, file: str, most: int) -> DataFrame:
    """(doc, n, context): of each document up to ``most`` pieces in order, each with file and page."""
    w = Window.partitionBy(doc).orderBy(order)
    label = F.concat(F.coalesce(F.col(file), F.lit("未知文件")), F.coalesce(F.concat(F.lit("#p"), F.nullif(F.col(page), F.lit(0)).cast("string")), F.lit("")))
    line = F.concat(F.lit("["), label, F.lit("] "), F.coalesce(F.col(text), F.lit("")))
    few = evidence.withColumns({"__n": F.row_number().over(w), "__line": line}).filter(F.col("__n") <= most)
    return few.groupBy(doc).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__line"))), lambda x: x["__line"]), "\n").alias("context"))


def enumeration(hits: DataFrame, *, file: str, title: str, year: str, order: str) -> DataFrame:
    """(number, line): each file once in its first place, numbered, with its title, year and citation mark."""
    once = hits.groupBy(file).agg(F.min_by(F.struct(title, year), order).alias("h"), F.min(order).alias("at"))
    n = F.row_number().over(Window.orderBy("at", file))  # hits of one answer: a short list
    said = F.coalesce(F.concat(F.lit("（"), F.col(f"h.{year}").cast("string"), F.lit("）")), F.lit("（年份待核验）"))
    return once.withColumn("number", n).select("number", F.concat(F.col("number").cast("string"), F.lit(". 《"), F.col(f"h.{title}"), F.lit("》"), said, F.lit(" [E"), F.col("number").cast("string"), F.lit("]")).alias("line"))


def cited(answer: Column) -> Column:
    """The numbers of the citation marks ``[E n]`` of an answer."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[E\s*(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))


def citations_hold(answer: Column, sources: Column, accepted: Column) -> Column:
    """There is a citation, each is of a piece of evidence, and each piece's source is accepted."""
    n = cited(answer)
    return (F.size(n) > 0) & F.forall(n, lambda x: (x >= 1) & (x <= F.size(sources))) & (F.size(F.array_except(sources, accepted)) == 0)


def signature(evidence: DataFrame, *, key: str, order: str, parts: list[str], text: str) -> DataFrame:
    """(key, signature): a digest of each answer's first four pieces of evidence."""
    w = Window.partitionBy(key).orderBy(order)
    part = F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts], F.left(F.coalesce(F.col(text), F.lit("")), F.lit(SIGNED_CHARS)))
    few = evidence.withColumns({"__n": F.row_number().over(w), "__p": part}).filter(F.col("__n") <= SIGNED)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__p"))), lambda x: x["__p"]), "")
    return few.groupBy(key).agg(F.left(F.sha1(joined), F.lit(16)).alias("signature"))


def evicted(cache: DataFrame, now: Column, *, newest: int, created: str, expires: str, key: str) -> DataFrame:
    """Cache rows that live on: unexpired, and among the ``newest``. The window sees no more than these."""
    head = cache.filter(F.col(expires) > now).orderBy(F.desc(created), key).limit(newest)
    return head


def aligned(expected: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Expected and predicted cases side by side with ``fault``: missing, unknown or repeated; null where they match one to one."""
    e = expected.groupBy(key).agg(F.count(F.lit(1)).alias("n_expected"), F.min("expected").alias("expected"))
    p = predicted.groupBy(key).agg(F.count(F.lit(1)).alias("n_predicted"), F.min("predicted").alias("predicted"))
    fault = F.when(F.col("n_predicted").isNull(), "missing").when(F.col("n_expected").isNull(), "unknown").when((F.col("n_expected") > 1) | (F.col("n_predicted") > 1), "repeated")
    return e.join(p, key, "full").select(key, "expected", "predicted", fault.alias("fault"))


def micro(results: DataFrame, relevant_: DataFrame, *, query: str, item: str, k: int = 10) -> DataFrame:
    """Recall and precision at ``k`` over all queries together."""
    shown = results.filter(F.col("rank") <= k).select(query, item).withColumn("r", F.lit(1))
    both = relevant_.select(query, item).withColumn("t", F.lit(1)).join(shown, [query, item], "full")
    hit = F.count_if(F.col("t").isNotNull() & F.col("r").isNotNull())
    return both.agg(F.coalesce(F.try_divide(hit, F.count("t")), F.lit(1.0)).alias("recall"), F.coalesce(F.try_divide(hit, F.count("r")), F.lit(0.0)).alias("precision"))


def gates(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """The eight checks of a candidate's one-row summary against the baseline's, and whether all passed."""
    b, c = baseline.select(F.struct("*").alias("b")), candidate.select(F.struct("*").alias("c"))
    one = b.crossJoin(F.broadcast(c))  # one row each
    checks = {
        "same_corpus": F.col("b.corpus") == F.col("c.corpus"), "release_errors_at_most_2pct": F.col("c.error_rate") <= 0.02, "no_critical_errors": F.col("c.critical") == 0, "clarifications_not_worse": F.col("c.clarified") <= F.col("b.clarified"),
        "rejections_not_worse": F.col("c.rejected") <= F.col("b.rejected"), "completions_not_worse": F.col("c.completed") >= F.col("b.completed"), "more_correct_releases": F.col("c.released") > F.col("b.released"), "p95_at_most_1000ms": F.col("c.p95") <= 1000.0,
    }
    out = one.select(*[F.coalesce(v, F.lit(False)).alias(k) for k, v in checks.items()])
    return out.withColumn("passed", F.forall(F.array(*checks), lambda x: x))


def page_of(items: DataFrame, *, key: str, cursor: int, limit: int) -> DataFrame:
    """A page of sorted keys by position: key, next_cursor, has_more, complete. Reads no more than the page's end."""
    limit, cursor = max(1, min(100, limit)), max(0, cursor)
    head = items.select(key).distinct().orderBy(key).limit(cursor + limit + 1)
    w = Window.orderBy(key)  # the rows up to the page's end
    n = head.withColumn("__n", F.row_number().over(w) - 1).withColumn("has_more", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > cursor + limit)
    page = n.filter((F.col("__n") >= cursor) & (F.col("__n") < cursor + limit))
    return page.select(key, F.when(F.col("has_more"), F.lit(cursor + limit)).alias("next_cursor"), "has_more", (~F.col("has_more")).alias("complete"))


def ordinal(list_: DataFrame, n: int, *, query: str, rank: str) -> DataFrame:
    """The n-th row of each list, by rank; negative counts from the end."""
    w = Window.partitionBy(query).orderBy(F.asc(rank) if n > 0 else F.desc(rank))
    return list_.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") == abs(n)).drop("__n")


def discovered(hits: DataFrame, *, query: str, doc: str, rank: str, most: int = 2) -> DataFrame:
    """(query, doc): the first ``most`` distinct documents of each query's hits, by their best rank."""
    best = hits.groupBy(query, doc).agg(F.min(rank).alias("best"))
    return best.withColumn("__n", F.row_number().over(Window.partitionBy(query).orderBy("best", doc))).filter(F.col("__n") <= most).select(query, doc)


def distinct_in_order(df: DataFrame, *, by: str, value: str, place: str) -> DataFrame:
    """(by, values): each group's distinct values in the order of their first place."""
    first = df.groupBy(by, value).agg(F.min(place).alias("at"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias("values"))


def reconciled(claims: DataFrame, *, subject: str, value: str) -> DataFrame:
    """Claims once each, with ``conflict`` where one subject has several values."""
    once = claims.groupBy(subject, value).agg(F.count(F.lit(1)).alias("sightings"))
    many = once.groupBy(subject).agg((F.count(F.lit(1)) > 1).alias("conflict"))
    return once.join(many, subject)


def budgets(calls: DataFrame, *, scopes: dict[str, tuple[list[str], float]], order: list[str], cost: str) -> DataFrame:
    """Each call with ``admitted``: its cumulative cost is within the ceiling of every scope (session, day and so on)."""
    out, ok = calls, F.lit(True)
    for name, (keys, ceiling) in scopes.items():
        out = out.withColumn(f"__{name}", F.sum(cost).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        ok = ok & (F.col(f"__{name}") <= ceiling)
    return out.withColumn("admitted", F.coalesce(ok, F.lit(False))).drop(*[f"__{n}" for n in scopes])
