"""Further event and series algebra: integrated durations in scopes, ratios with recovery, windows by kind, currency, risk figures.

Instants are microseconds (``us``); intervals are (keys, start_us, end_us), half open.
Sample spans run from a sample to the next of its key; spans longer than
``max_gap_us`` count for nothing, as does a key's last sample.

Cases: null conditions don't hold; null values take no part in sums and give no
crossing; samples of one key at one instant count by the last in ``tie`` order; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY = 86_400_000_000


def spans(rows: DataFrame, *, keys: list[str], max_gap_us: int, tie: str = "event_id") -> DataFrame:
    """Each sample with ``start_us`` and ``end_us`` of its span; spans that are too long, and last samples, are left out."""
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "us")]), tie)
    once = rows.groupBy(*keys, "us").agg(last.alias("__r")).select(*keys, "us", "__r.*")
    out = once.withColumnRenamed("us", "start_us").withColumn("end_us", F.lead("start_us").over(Window.partitionBy(*keys).orderBy("start_us")))
    return out.filter(F.col("end_us") - F.col("start_us") <= max_gap_us)


def scoped_duration(rows: DataFrame, match: Column, scope: DataFrame, *, keys: list[str], max_gap_us: int, tie: str = "event_id", bucket_us: int = DAY) -> DataFrame:
    """(keys, start_us, end_us, seconds): for how long the condition held in each interval of ``scope``, by steps.

    Spans and intervals meet by key and time bucket, each pair in one bucket only, not by a range join."""
    held = spans(rows, keys=keys, max_gap_us=max_gap_us, tie=tie).filter(F.coalesce(match, F.lit(False))).select(*keys, F.col("start_us").alias("a"), F.col("end_us").alias("b"))
    each = lambda lo, hi: F.explode(F.sequence(F.expr(f"{lo} div {bucket_us}"), F.expr(f"greatest({lo}, {hi} - 1) div {bucket_us}"))).alias("__k")
    left = held.select("*", each("a", "b"))
    right = scope.select(*keys, "start_us", "end_us").distinct().select("*", each("start_us", "end_us"))
    met = left.join(right, [*keys, "__k"]).filter((F.col("a") < F.col("end_us")) & (F.col("start_us") < F.col("b")))
    once = met.filter(F.col("__k") == F.expr(f"greatest(a, start_us) div {bucket_us}"))
    total = once.groupBy(*keys, "start_us", "end_us").agg(F.sum(F.least("b", "end_us") - F.greatest("a", "start_us")).alias("us"))
    out = scope.select(*keys, "start_us", "end_us").distinct().join(total, [*keys, "start_us", "end_us"], "left")
    return out.select(*keys, "start_us", "end_us", (F.coalesce("us", F.lit(0)) / 1e6).alias("seconds"))


def _lines(rows: DataFrame, value: str, *, keys: list[str], max_gap_us: int, tie: str) -> DataFrame:
    """(keys, a, b, p, q): the spans, and the values at either end."""
    last = F.max_by(value, F.struct(tie))
    once = rows.groupBy(*keys, "us").agg(last.alias("p"))
    w = Window.partitionBy(*keys).orderBy("us")
    out = once.select(*keys, F.col("us").alias("a"), F.lead("us").over(w).alias("b"), "p", F.lead("p").over(w).alias("q"))
    return out.filter(F.col("b") - F.col("a") <= max_gap_us)


def scoped_linear_duration(rows: DataFrame, value: str, threshold: float, scope: DataFrame, *, keys: list[str], max_gap_us: int, tie: str = "event_id", bucket_us: int = DAY) -> DataFrame:
    """(keys, start_us, end_us, seconds): for how long the value was above a threshold in each interval of ``scope``, when it runs straight from sample to sample.

    A line is cut at the interval's ends and its crossing is interpolated; lines and intervals meet by key and time bucket. A null value holds for no line."""
    lines = _lines(rows.select(*keys, "us", tie, value), value, keys=keys, max_gap_us=max_gap_us, tie=tie).filter("p is not null and q is not null")
    each = lambda lo, hi: F.explode(F.sequence(F.expr(f"{lo} div {bucket_us}"), F.expr(f"greatest({lo}, {hi} - 1) div {bucket_us}"))).alias("__k")
    asked = scope.select(*keys, "start_us", "end_us").distinct()
    met = lines.select("*", each("a", "b")).join(asked.select("*", each("start_us", "end_us")), [*keys, "__k"]).filter((F.col("a") < F.col("end_us")) & (F.col("start_us") < F.col("b")))
    once = met.filter(F.col("__k") == F.expr(f"greatest(a, start_us) div {bucket_us}")).withColumns({"x": F.greatest("a", "start_us"), "y": F.least("b", "end_us")})
    at = lambda t: F.col("p") + (F.col("q") - F.col("p")) * ((F.col(t) - F.col("a")) / (F.col("b") - F.col("a"))) - threshold
    u, v = at("x"), at("y")
    share = F.when((u > 0) & (v > 0), 1.0).when((u <= 0) & (v <= 0), 0.0).otherwise(F.greatest(u, v) / F.abs(u - v))
    total = once.groupBy(*keys, "start_us", "end_us").agg((F.sum(share * (F.col("y") - F.col("x"))) / 1e6).alias("seconds"))
    return asked.join(total, [*keys, "start_us", "end_us"], "left").withColumn("seconds", F.coalesce("seconds", F.lit(0.0)))


def linear_duration(rows: DataFrame, value: str, threshold: float, *, keys: list[str], max_gap_us: int, tie: str = "event_id") -> DataFrame:
    """(keys, seconds) above a threshold when values run straight from sample to sample: crossings are interpolated."""
    s = spans(rows.select(*keys, "us", tie, value), keys=keys, max_gap_us=10**18, tie=tie)
    nxt = s.withColumn("__next", F.lead(value).over(Window.partitionBy(*keys).orderBy("start_us")))
    # the last span's end value is that of the last sample, which has no span
    ends = rows.groupBy(*keys).agg(F.max_by(value, F.struct("us", tie)).alias("__end"))
    nxt = nxt.join(ends, keys).withColumn("__next", F.coalesce("__next", "__end")).filter(F.col("end_us") - F.col("start_us") <= max_gap_us)
    a, b = F.col(value) - threshold, F.col("__next") - threshold
    share = F.when((a > 0) & (b > 0), 1.0).when((a <= 0) & (b <= 0), 0.0).otherwise(F.greatest(a, b) / F.abs(a - b))
    return nxt.groupBy(*keys).agg((F.sum(share * (F.col("end_us") - F.col("start_us"))) / 1e6).alias("seconds"))


def daily_band(rows: DataFrame, value: str, low: float, high: float, *, keys: list[str], max_gap_us: int, least_seconds: float, offset_us: int = 0, tie: str = "event_id") -> DataFrame:
    """(keys, local_date, seconds) of days on which the value was above ``low`` and at most ``high`` for longer than a threshold; spans are cut at midnight."""
    held = spans(rows, keys=keys, max_gap_us=max_gap_us, tie=tie).filter((F.col(value) > low) & (F.col(value) <= high))
    lo, hi = F.col("start_us") + offset_us, F.col("end_us") + offset_us
    day = lambda x: F.floor(x / F.lit(float(DAY))).cast("long")
    cut = held.select(*keys, lo.alias("a"), hi.alias("b"), F.explode(F.sequence(day(lo), F.greatest(day(lo), day(hi - 1)))).alias("d"))
    part = F.least(F.col("b"), (F.col("d") + 1) * DAY) - F.greatest(F.col("a"), F.col("d") * DAY)
    out = cut.groupBy(*keys, "d").agg((F.sum(part) / 1e6).alias("seconds")).filter(F.col("seconds") > least_seconds)
    return out.select(*keys, F.date_add(F.lit("1970-01-01").cast("date"), F.col("d").cast("int")).alias("local_date"), "seconds")


def time_share(rows: DataFrame, intervals: DataFrame, qualifier: Column, *, keys: list[str], max_gap_us: int, above: float, tie: str = "event_id") -> DataFrame:
    """Intervals in which the qualifier held for more than a share of the time."""
    d = scoped_duration(rows, qualifier, intervals, keys=keys, max_gap_us=max_gap_us, tie=tie)
    share = F.try_divide(F.col("seconds"), (F.col("end_us") - F.col("start_us")) / 1e6)
    return d.withColumn("share", share).filter(F.col("share") > above).select(*keys, "start_us", "end_us", "share")


def window_ratio(hit: Column, *, keys: list[str], window_us: int) -> Column:
    """Share of the samples of the last ``window_us`` of a key for which ``hit`` is true."""
    w = Window.partitionBy(*keys).orderBy("us").rangeBetween(-window_us, 0)
    return F.avg(F.coalesce(hit, F.lit(False)).cast("double")).over(w)


def ratio_recoveries(rows: DataFrame, hit: Column, *, keys: list[str], window_us: int, above: float, below: float, within_us: int, tie: str = "event_id") -> DataFrame:
    """(keys, start_us, end_us): from where a windowed ratio first exceeds a threshold to its first recovery in time.

    One pass in order of time: the next recovery after each rise is the smallest later one."""
    r = rows.select(*keys, "us", tie, window_ratio(hit, keys=keys, window_us=window_us).alias("ratio"))
    w = Window.partitionBy(*keys).orderBy("us", tie)
    marked = r.withColumns({"rise": (F.col("ratio") > above) & ~F.coalesce(F.lag("ratio").over(w) > above, F.lit(False)), "back": F.when(F.col("ratio") < below, F.col("us"))})
    ahead = F.first("back", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    found = marked.withColumn("end_us", ahead).filter("rise").withColumnRenamed("us", "start_us")
    return found.filter(F.col("end_us") - F.col("start_us") <= within_us).select(*keys, "start_us", "end_us").distinct()


def interval_seconds(start: str = "start_us", end: str = "end_us") -> Column:
    return (F.col(end) - F.col(start)) / 1e6


def local_day_seconds(day: Column, zone: str) -> Column:
    """Length of a calendar day in a zone: 23 or 25 hours where clocks change."""
    at = lambda d: F.unix_micros(F.to_utc_timestamp(d.cast("timestamp"), F.lit(zone)))
    return (at(F.date_add(day, 1)) - at(day)) / 1e6


def windowed(rows: DataFrame, kind: str, *, time: str, anchor: str | None = None, start: str | None = None, end: str | None = None, days: int | None = None) -> DataFrame:
    """Rows in an absolute window, the month or day of an anchor up to it, or so many days before it; half open at the end."""
    t = F.col(time)
    at = F.lit(anchor).cast("timestamp_ntz")
    if kind == "absolute":
        return rows.filter((t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz")))
    if kind == "month_to_date":
        return rows.filter((t >= F.date_trunc("month", at)) & (t < at))
    if kind == "calendar_day":
        return rows.filter(t.cast("date") == at.cast("date"))
    if kind == "rolling":
        return rows.filter((t >= at - F.expr(f"interval {days} days")) & (t < at))
    raise ValueError(f"unknown window {kind}")


def in_events(rows: DataFrame, intervals: DataFrame, *, keys: list[str]) -> DataFrame:
    """Rows whose instant lies in an interval of their key (merged intervals: the last to start holds it)."""
    a = rows.withColumns({"__o": F.lit(1), "__e": F.lit(None).cast("long")})
    b = intervals.select(*keys, F.col("start_us").alias("us"), F.lit(0).alias("__o"), F.col("end_us").alias("__e"))
    w = Window.partitionBy(*keys).orderBy("us", "__o").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__until", F.max("__e").over(w))
    return both.filter("__o = 1 and us < __until").select(*rows.columns)


def converted(amounts: DataFrame, rates: DataFrame, *, currency: str, time: str, amount: str, rate: str) -> DataFrame:
    """Amounts at the latest rate of their currency at or before their time; null before the first rate."""
    from .memory import as_of

    return as_of(amounts, rates, keys=[currency], time=time, value=rate).withColumn("converted", F.col(amount) * F.col("as_of")).drop("as_of")


def drawdown(series: DataFrame, value: str, *, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, max_drawdown): the largest fall from a running maximum, as a share of it."""
    peak = F.max(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return series.withColumn("__fall", 1 - F.try_divide(F.col(value), peak)).groupBy(*keys).agg(F.max("__fall").alias("max_drawdown"))


def growth_figures(series: DataFrame, value: str, *, keys: list[str], order: str, per_year: float) -> DataFrame:
    """(keys, cagr, sharpe): yearly growth from first to last, and mean over deviation of the period returns, by year."""
    w = Window.partitionBy(*keys).orderBy(order)
    r = series.withColumn("__r", F.try_divide(F.col(value), F.lag(value).over(w)) - 1)
    first, last, n = F.min_by(value, order), F.max_by(value, order), F.count(F.col("__r"))
    return r.groupBy(*keys).agg((F.pow(F.try_divide(last, first), F.lit(per_year) / n) - 1).alias("cagr"), (F.try_divide(F.avg("__r"), F.stddev("__r")) * F.sqrt(F.lit(per_year))).alias("sharpe"))


def composed(outputs: dict[str, DataFrame], on: list[str], fields: dict[str, list[str]]) -> DataFrame:
    """The outputs' fields side by side, one row a key; a key that an output lacks has nulls there."""
    out = None
    for name, df in outputs.items():
        part = df.select(*on, *[F.col(f).alias(f"{name}_{f}") for f in fields[name]])
        out = part if out is None else out.join(part, on, "full")
    return out
