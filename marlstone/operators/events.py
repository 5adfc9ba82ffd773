"""Event segmentation and interval algebra over partitioned series.

Times are microseconds. Intervals are half-open; an episode ends at its last
sample. All windows are partitioned by the series' keys; the only joins are equi
joins on keys (and a day bucket for overlaps)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY_US = 86_400_000_000


def consecutive(df: DataFrame, match: Column, *, keys: list[str], max_gap_us: int, time: str = "us", tie: str = "event_id", min_us: int = 0) -> DataFrame:
    """Maximal runs of matching samples; a sample that doesn't match or a gap over ``max_gap_us`` breaks a run.

    Of samples with the same time the one with the largest ``tie`` counts."""
    rows = df.select(*keys, F.col(time).alias("start_us"), F.col(tie).alias("__tie"), F.when(F.col(tie).isNotNull(), F.coalesce(match, F.lit(False))).alias("__m")).filter("start_us is not null")
    w = Window.partitionBy(*keys).orderBy("start_us", "__tie")  # one order for all that follows, so rows are sorted once and nothing is held by key
    last = rows.withColumn("__next", F.lead("start_us").over(w)).filter("__next is null or __next > start_us").withColumn("__m", F.coalesce("__m", F.lit(False)))
    goes_on = F.coalesce(F.lag("__m").over(w) & (F.col("start_us") - F.lag("start_us").over(w) <= max_gap_us), F.lit(False))
    marked = last.withColumns({"__on": F.col("__m") & goes_on, "__n": F.row_number().over(w).cast("long")})
    ends = marked.withColumn("__last", ~F.coalesce(F.lead("__on").over(w), F.lit(False))).filter("__m and (__last or not __on)")  # a run's first and last sample
    whole = {"end_us": F.when(F.col("__last"), F.col("start_us")).otherwise(F.lead("start_us").over(w)), "samples": F.when(F.col("__last"), 1).otherwise(F.lead("__n").over(w) - F.col("__n") + 1)}
    return ends.withColumns(whole).filter(~F.col("__on") & (F.col("end_us") - F.col("start_us") >= min_us)).select(*keys, "start_us", "end_us", "samples")


def local_dates(intervals: DataFrame, *, keys: list[str], offset_us: int) -> DataFrame:
    """Distinct local dates that intervals touch; an end at midnight doesn't touch the next day."""
    day = lambda us: F.floor((us + F.lit(offset_us)) / DAY_US).cast("int")
    last = F.greatest(day(F.col("start_us")), day(F.col("end_us") - 1))
    days = intervals.select(*keys, F.explode(F.sequence(day(F.col("start_us")), last)).alias("__d"))
    return days.select(*keys, F.date_add(F.lit("1970-01-01").cast("date"), F.col("__d")).alias("local_date")).distinct()


def merged(intervals: DataFrame, *, keys: list[str]) -> DataFrame:
    """Union: overlapping or touching intervals as one. Of equal starts the longest counts, so the order has no ties."""
    intervals = intervals.groupBy(*keys, "start_us").agg(F.max("end_us").alias("end_us"))
    w = Window.partitionBy(*keys).orderBy("start_us", "end_us")
    reach = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start_us") <= reach, 0).otherwise(1)
    runs = intervals.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "__run").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("__run")


def _swept(a: DataFrame, b: DataFrame, keys: list[str], holds: str) -> DataFrame:
    """(keys, start_us, end_us): the longest stretches in which ``holds`` is true of na and nb, how many intervals of each side cover them.

    Sides need not be merged before: boundaries at which nothing changes drop out. Bounds are sorted once, and nothing is held by key."""
    edge = lambda df, da, db: df.filter("start_us < end_us").select(*keys, F.explode(F.array(F.struct(F.col("start_us").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("at"), F.lit(-1).alias("d")))).alias("e")).select(*keys, "e.at", (F.col("e.d") * da).alias("da"), (F.col("e.d") * db).alias("db"))
    w = Window.partitionBy(*keys).orderBy("at")  # sums are over all bounds up to this time, with those at the same time
    at = edge(a, 1, 0).unionByName(edge(b, 0, 1)).withColumns({"na": F.sum("da").over(w), "nb": F.sum("db").over(w)}).withColumn("on", F.expr(holds))
    turns = at.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False))).filter("on <> was")
    return turns.withColumn("end_us", F.lead("at").over(w)).filter("on").select(*keys, F.col("at").alias("start_us"), "end_us")


def intersection(a: DataFrame, b: DataFrame, *, keys: list[str]) -> DataFrame:
    """Common parts of the merged sides, by a sweep over both sides' boundaries; a long interval is two rows, however long."""
    return _swept(a, b, keys, "na > 0 and nb > 0")


def difference(a: DataFrame, b: DataFrame, *, keys: list[str]) -> DataFrame:
    """Parts of ``a`` outside ``b``, by the same sweep."""
    return _swept(a, b, keys, "na > 0 and nb = 0")


def overlap_ratio(a: DataFrame, b: DataFrame, *, keys: list[str]) -> DataFrame:
    """Common time over joined time, by key."""
    total = lambda df, n: df.groupBy(*keys).agg(F.sum(F.col("end_us") - F.col("start_us")).alias(n))
    both = total(intersection(a, b, keys=keys), "common")
    any_ = total(merged(a.select(*keys, "start_us", "end_us").unionByName(b.select(*keys, "start_us", "end_us")), keys=keys), "joined")
    return any_.join(both, keys, "left").select(*keys, F.expr("try_divide(coalesce(common, 0), joined)").alias("overlap_ratio"))


def cumulative_duration(df: DataFrame, match: Column, *, keys: list[str], max_gap_us: int, offset_us: int = 0, time: str = "us") -> DataFrame:
    """Seconds a local day for which a step series matches: a sample holds until the next one, or not at all if that is further than ``max_gap_us``; split at midnight."""
    w = Window.partitionBy(*keys).orderBy(time)
    held = df.withColumn("__next", F.lead(time).over(w)).filter(match & (F.col("__next") - F.col(time) <= max_gap_us))
    day = lambda us: F.floor((us + F.lit(offset_us)) / DAY_US)
    split = held.withColumn("__d", F.explode(F.sequence(day(F.col(time)), day(F.col("__next") - 1))))
    begin = F.greatest(F.col(time), F.col("__d") * DAY_US - offset_us)
    end = F.least(F.col("__next"), (F.col("__d") + 1) * DAY_US - offset_us)
    return split.groupBy(*keys, F.date_add(F.lit("1970-01-01").cast("date"), F.col("__d").cast("int")).alias("local_date")).agg((F.sum(end - begin) / 1e6).alias("seconds"))


def sequence_matches(df: DataFrame, steps: list[str], *, keys: list[str], action: str, within_us: int, time: str = "us", tie: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Non-overlapping matches of the steps in order, from the earliest first step on; one that isn't whole ``within_us`` after its first step is given up.

    A task holds one batch and the steps seen so far, never all of a key's rows."""
    import pandas as pd

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", start_us long, end_us long"

    def scan(batches):
        key, seen = object(), []
        for pdf in batches:
            out = []
            for k, t, a in zip(pdf[keys].itertuples(index=False, name=None), pdf[time], pdf[action], strict=True):
                if k != key:
                    key, seen = k, []
                if seen and t - seen[0] > within_us:
                    seen = []  # too late: this match is given up
                if a == steps[len(seen)]:
                    seen.append(t)
                    if len(seen) == len(steps):
                        out.append((*k, seen[0], t))
                        seen = []
            yield pd.DataFrame(out, columns=[*keys, "start_us", "end_us"])

    order = [*keys, time, *tie]
    return df.select(*dict.fromkeys([*order, action])).repartition(*keys).sortWithinPartitions(*order).mapInPandas(scan, schema)


def ordered_fold(df: DataFrame, delta: Column, *, keys: list[str], initial: float = 0.0, order: tuple[str, ...] = ("us", "event_id")) -> DataFrame:
    """``state``: the initial value and all deltas so far."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("state", F.lit(initial) + F.sum(delta).over(w))


def resettable_scan(df: DataFrame, delta: Column, reset: Column, *, keys: list[str], reset_to: float = 0.0, initial: float = 0.0, order: tuple[str, ...] = ("us", "event_id")) -> DataFrame:
    """Like a fold, but a reset row's state is ``reset_to`` and the sum starts anew after it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    seg = df.withColumn("__seg", F.sum(F.when(reset, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "__seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    base = F.when(F.col("__seg") == 0, F.lit(initial)).otherwise(F.lit(reset_to))
    return seg.withColumn("state", base + F.sum(F.when(reset, 0.0).otherwise(delta)).over(inside)).drop("__seg")


def session_gaps(df: DataFrame, *, keys: list[str], gap_us: int, time: str = "us") -> DataFrame:
    """Sessions cut at gaps over ``gap_us``."""
    w = Window.partitionBy(*keys).orderBy(time)
    cut = F.when(F.col(time) - F.lag(time).over(w) <= gap_us, 0).otherwise(1)
    s = df.withColumn("__new", cut).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return s.groupBy(*keys, "session").agg(F.min(time).alias("start_us"), F.max(time).alias("end_us"), F.count(F.lit(1)).alias("n"))


def ordered_scan(df: DataFrame, *, keys: list[str], order: list[str], reads: list[str], schema: str, start: Callable, step: Callable) -> DataFrame:
    """Rows with what ``step(state, *values)`` returns for them, in order within a key. ``start()`` makes a key's state.

    ``reads`` names the columns whose values a step gets; ``schema`` the added columns, whose values it returns. Ties in
    ``order`` have no fixed order: name a unique column last.

    A task holds the state of one key and one Arrow batch, never all of a key's rows; a batch's columns are lists, so a
    step costs one call. Rows whose keys are null are one key's.
    """
    added = [x.split()[0] for x in schema.split(",")]
    full = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), schema])

    def run(batches):
        key, state = object(), None
        for pdf in batches:
            own = pdf[keys].astype(object).where(pdf[keys].notna(), None)
            out = []
            for k, *values in zip(zip(*(own[c].tolist() for c in keys), strict=True), *(pdf[c].tolist() for c in reads), strict=True):
                if k != key:
                    key, state = k, start()
                out.append(step(state, *values))
            yield pdf.assign(**{a: [o[i] for o in out] for i, a in enumerate(added)}) if out else pdf.assign(**{a: [] for a in added})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, full)


def anchored_rate_limit(df: DataFrame, *, key: str, limit: int, window_us: int, time: str = "us") -> DataFrame:
    """``admitted`` of each call: windows start at a user's first call after the last window's end."""

    def step(s: dict, t: int) -> tuple:
        if not s or t - s["start"] >= window_us:
            s |= {"start": t, "n": 0}
        s["n"] += 1
        return (s["n"] <= limit,)

    return ordered_scan(df.select(key, "event_id", time), keys=[key], order=[time, "event_id"], reads=[time], schema="admitted boolean", start=dict, step=step)


def breaker_states(df: DataFrame, failed: Column, *, key: str, failures: int = 3, cool_us: int = 60_000_000, time: str = "us") -> DataFrame:
    """Circuit state seen by each call: open after ``failures`` in a row, half-open after ``cool_us``; a half-open call closes or reopens it. An unknown outcome is no failure."""
    rows = df.select(key, "event_id", time, F.coalesce(failed, F.lit(False)).alias("failed"))

    def step(s: dict, t: int, bad: bool) -> tuple:
        if s["state"] == "open" and t - s["since"] >= cool_us:
            s["state"] = "half_open"
        seen = s["state"]
        if seen != "open":
            s["n"] = s["n"] + 1 if bad else 0
            if bad and (seen == "half_open" or s["n"] >= failures):
                s |= {"state": "open", "since": t}
            elif not bad:
                s["state"] = "closed"
        return (seen,)

    return ordered_scan(rows, keys=[key], order=[time, "event_id"], reads=[time, "failed"], schema="state string", start=lambda: {"state": "closed", "n": 0, "since": 0}, step=step)


def budget_admission(df: DataFrame, cost: Column, *, key: str, ceiling: float, time: str = "us") -> DataFrame:
    """Greedy admission: a call is admitted if what was admitted before and its cost stay within the ceiling. A null cost isn't admitted."""

    def step(s: dict, c: float | None) -> tuple:
        ok = c is not None and s["used"] + c <= ceiling
        s["used"] += c if ok else 0
        return (bool(ok),)

    return ordered_scan(df.select(key, "event_id", time, cost.alias("cost")), keys=[key], order=[time, "event_id"], reads=["cost"], schema="admitted boolean", start=lambda: {"used": 0.0}, step=step)
