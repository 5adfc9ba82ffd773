"""Facts, profiles, task chains and question context kept over a conversation.

Folds that depend on earlier decisions use ``events.ordered_scan``. Null flags
count as false, null keys as one key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .events import ordered_scan

# Fields whose values change rarely, anchor words, and limits.
STABLE_FIELDS = ("identity", "domain", "preference_style")
ANCHORS = ("改为", "不要", "其实", "换成", "不是", "改成", "换")
GOES_ON = ("还有呢", "还有吗", "接着", "继续", "然后呢", "往下", "再多点", "别的呢", "其他呢", "那篇呢", "那个呢", "这篇呢", "这个呢", "还有哪些", "还有别的", "还有其他的")
RESETS = ("换个话题", "不看了", "不要了", "算了", "停", "重新来", "从头来", "别的", "另外再", "先别", "不是这个")
SHORT = 8


def merged_profile(sightings: DataFrame, *, keys: list[str], order: list[str]) -> DataFrame:
    """Each (keys) field's value and confidence after every sighting (value, confidence).

    The same value again adds 0.1, up to 1. Another value is noted at its first sighting and takes over at a later one."""

    def step(state: dict, value, confidence: float) -> tuple:
        if not state:
            state |= {"value": value, "confidence": confidence, "noted": set()}
        elif value == state["value"]:
            state["confidence"] = min(1.0, state["confidence"] + 0.1)
        elif value in state["noted"]:
            state |= {"value": value, "confidence": confidence}
        else:
            state["noted"].add(value)
        return state["value"], state["confidence"], len(state["noted"])

    return ordered_scan(sightings, keys=keys, order=order, reads=["value", "confidence"], schema="held string, held_confidence double, conflicts long", start=dict, step=step)


def task_chains(steps: DataFrame, closes: Column, *, keys: list[str], order: list[str]) -> DataFrame:
    """``chain`` (from 1) of each step: the open chain's, else a new one; a step that ``closes`` ends its chain."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("chain", (F.coalesce(F.sum(F.coalesce(closes, F.lit(False)).cast("long")).over(w), F.lit(0)) + 1).cast("long"))


def continued_intent(turns: DataFrame, *, keys: list[str], order: list[str], text: str = "text", intent: str = "intent") -> DataFrame:
    """``held``: a turn's own intent, or the last one before it where a short turn only goes on; a reset word forgets it."""
    starts = lambda ws: F.trim(F.col(text)).rlike("^(?:" + "|".join(ws) + ")")
    reset = F.coalesce(starts(RESETS), F.lit(False))
    goes_on = F.coalesce(starts(GOES_ON) & (F.length(F.trim(F.col(text))) <= SHORT) & ~starts(RESETS), F.lit(False))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = turns.withColumn("__era", F.sum(reset.cast("long")).over(w)).withColumn("__own", F.when(~goes_on & ~reset, F.col(intent)))
    e = Window.partitionBy(*keys, "__era").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("held", F.when(goes_on, F.last("__own", ignorenulls=True).over(e)).otherwise(F.col("__own"))).drop("__era", "__own")


def promoted(facts: DataFrame, *, least: float = 0.7, conflicts_block: bool = False) -> DataFrame:
    """Facts for long-term keeping: with consent, sure enough, not raw; conflicting ones stay out only on demand."""
    ok = F.col("consent") & (F.col("confidence") >= least) & (F.col("type") != "raw")
    return facts.filter(ok & F.col("conflict_with").isNull() if conflicts_block else ok)


def stale(facts: DataFrame, now: Column, *, days: int = 30, sure: float = 0.7) -> DataFrame:
    """``archived``: never read, older than ``days`` and not sure."""
    old = F.col("ts") < now - F.expr(f"interval {days} days")
    return facts.withColumn("archived", F.coalesce((F.col("retrieval_count") == 0) & old & (F.col("confidence") < sure), F.lit(False)))


def current_facts(changes: DataFrame, *, key: str = "id", event: str = "event_id") -> DataFrame:
    """The newest revision of each fact; a replayed event counts once; deleted facts go. ``revision`` counts its events."""
    once = changes.groupBy(event).agg(F.min(F.struct(*[c for c in changes.columns if c != event])).alias("r")).select(event, "r.*")
    rest = [c for c in once.columns if c != key]
    latest = once.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("ts", event)).alias("r"), F.count(F.lit(1)).alias("revision"))
    return latest.select(key, "r.*", "revision").filter(~F.coalesce(F.col("deleted"), F.lit(False)))


def conflicting(new: DataFrame, old: DataFrame, topic: Callable[[Column], Column], *, anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """(id, conflict_with): the first older fact of the same type that shares a topic token with a new one that holds an anchor word.

    Joined on (type, token): only facts that share a token meet."""
    held = F.col("content").rlike("|".join(anchors))
    a = new.filter(held).select("id", "type", F.explode(F.array_distinct(topic(F.col("content")))).alias("token"))
    b = old.select(F.col("id").alias("conflict_with"), "type", F.explode(F.array_distinct(topic(F.col("content")))).alias("token"))
    first = b.groupBy("type", "token").agg(F.min("conflict_with").alias("conflict_with"))
    met = a.join(first, ["type", "token"])
    return met.groupBy("id").agg(F.min("conflict_with").alias("conflict_with"))


def expired(leases: DataFrame, now: Column, *, seconds: int) -> DataFrame:
    """Running jobs whose heartbeat is too old become ``manual_recovery``."""
    late = (F.col("state") == "running") & (F.col("heartbeat") < now - F.expr(f"interval {seconds} seconds"))
    return leases.withColumn("state", F.when(late, "manual_recovery").otherwise(F.col("state")))


def voted(neighbours: DataFrame, *, query: str, k: int = 3, least: float = 0.85) -> DataFrame:
    """Each query's most frequent label among its ``k`` nearest examples of at least ``least``, wrong ones left out; ties to the nearer one."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), "example_id")
    near = neighbours.filter(F.coalesce(F.col("feedback"), F.lit("")) != "wrong").withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= k) & (F.col("score") >= least))
    votes = near.groupBy(query, "label").agg(F.count(F.lit(1)).alias("votes"), F.min("rank").alias("best"))
    return votes.groupBy(query).agg(F.max_by("label", F.struct("votes", -F.col("best"))).alias("label"), F.max("votes").alias("votes"))


def as_of(left: DataFrame, right: DataFrame, *, keys: list[str], time: str, value: str) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` at or before its time; one sort by key and time, no range join."""
    a = left.withColumn("__side", F.lit(1)).withColumn("__value", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*keys, time, F.col(value).alias("__value"), F.lit(0).alias("__side"))
    w = Window.partitionBy(*keys).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("as_of", F.last("__value", ignorenulls=True).over(w))
    return both.filter("__side = 1").select(*left.columns, "as_of")


def page(df: DataFrame, *, after, limit: int, key: str) -> DataFrame:
    """The ``limit`` (1 to 100) rows after a cursor, by key, with ``has_more``. One more row than shown is read."""
    limit = max(1, min(100, limit))
    rows = df if after is None else df.filter(F.col(key) > F.lit(after))
    head = rows.orderBy(key).limit(limit + 1)
    w = Window.orderBy(key)  # at most 101 rows
    return head.withColumn("__n", F.row_number().over(w)).withColumn("has_more", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > limit).filter(F.col("__n") <= limit).drop("__n")


def best_thresholds(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, accuracy) of the threshold whose accepted rows (score at or above it) agree best with ``expected``; ties to the lower one."""
    each = F.explode(F.array(*[F.lit(t) for t in sorted(thresholds)])).alias("threshold")
    hit = ((F.col("score") >= F.col("threshold")) == F.col("expected")).cast("double")
    found = scored.select("score", "expected", each).groupBy("threshold").agg(F.avg(hit).alias("accuracy"))
    return found.orderBy(F.desc("accuracy"), "threshold").limit(1)


def synced(routes: DataFrame, examples: DataFrame, *, least: float = 0.8, text: str = "text") -> DataFrame:
    """Routes that were confirmed and sure, as new examples: each text once, and none that is there already."""
    good = routes.filter((F.col("feedback") == "correct") & (F.col("confidence") >= least))
    once = good.groupBy(text).agg(F.max_by("intent", F.struct("confidence", "intent")).alias("intent"))
    return once.join(examples.select(text).distinct(), text, "left_anti")


def sampled_queries(pages: DataFrame, clean: Callable[[Column], Column], *, doc: str, text: str = "text", per_doc: int = 1, shortest: int = 40, longest: int = 120, least: int = 30, seed: int = 42) -> DataFrame:
    """(query, doc): slices of each document's pages as recall queries, by a seeded hash instead of a random generator."""
    t = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    long = pages.select(doc, t.alias("t")).filter(F.length("t") >= shortest).withColumn("h", F.xxhash64(doc, "t", F.lit(seed)))
    pick = long.withColumn("n", F.row_number().over(Window.partitionBy(doc).orderBy("h", "t"))).filter(F.col("n") <= per_doc)
    room = F.length("t") - shortest
    start = F.pmod("h", room + 1)
    size = shortest + F.pmod(F.xxhash64("h"), F.least(F.lit(longest), F.length("t") - start) - shortest + 1)
    cut = clean(F.trim(F.substring(F.col("t"), (start + 1).cast("int"), size.cast("int"))))
    return pick.select(cut.alias("query"), doc).filter(F.length("query") >= least)


def administered(changes: DataFrame, command: str, *, user: str, now: Column | None = None, fact: str | None = None, value: str | None = None, limit: int = 20) -> DataFrame:
    """What a memory command answers or appends to the change table: list, get, export and stats answer; delete, fix, clear and archive_stale append.

    ``changes`` holds (event_id, user_id, id, type, value, confidence, retrieval_count, ts, deleted)."""
    own = current_facts(changes.filter(F.col("user_id") == user))
    if command in ("list", "export"):
        return own.orderBy(F.desc("ts"), "id").limit(limit) if command == "list" else own
    if command == "get":
        return own.filter(F.col("id") == fact)
    if command == "stats":
        return own.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 3).alias("confidence"), F.sum("retrieval_count").alias("retrieved"))
    gone = {"delete": F.col("id") == fact, "clear": F.lit(True), "fix": F.col("id") == fact}
    if command == "archive_stale":
        rows = stale(own, now).filter("archived").drop("archived")
    elif command in gone:
        rows = own.filter(gone[command])
    else:
        raise ValueError(f"unknown command {command}")
    if command == "fix":
        if not (value or "").strip():
            raise ValueError("a fact needs a value")
        rows = rows.withColumn("value", F.lit(value.strip()))
    else:
        rows = rows.withColumn("deleted", F.lit(True))
    event = F.concat_ws(":", F.lit(command), "id", F.col("revision").cast("string"))
    return rows.withColumns({"event_id": event, "ts": now if now is not None else F.col("ts")}).select(*[c for c in changes.columns if c in (*rows.columns, "event_id")])
