"""Queries over the supplied tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import encoding
from .functions import language as L
from .functions import text as T
from .functions import units
from .operators import events as E
from .operators import retrieval as R
from .operators import search as S
from .operators.quantiles import quantiles
from .plans import algebra as P
from .sources.shared import kept, written
from .sources.tables import events, read
from .streaming import logs

HOUR, DAY = 3_600_000_000, 86_400_000_000
K = ["user_id"]
#: UTC+8, a zone without daylight saving time.
OFFSET = 8 * HOUR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- SQL parts

EV = "ev as (select *, epoch_us(ts) as us from events)"


def _episodes_sql(name: str, match: str, gap: int, least: int = 0) -> str:
    return f"""{name}_m as (select user_id, us, arg_max(coalesce({match}, false), event_id) as m from ev group by user_id, us),
    {name}_n as (select *, case when lag(m) over w and us - lag(us) over w <= {gap} then 0 else 1 end as new from {name}_m window w as (partition by user_id order by us)),
    {name}_r as (select *, sum(new) over (partition by user_id order by us rows unbounded preceding) as run from {name}_n),
    {name} as (select user_id, min(us) as start_us, max(us) as end_us, count(*) as samples from {name}_r where m group by user_id, run having max(us) - min(us) >= {least})"""


def _dates_sql(name: str, source: str) -> str:
    day = lambda x: f"cast(floor(({x} + {OFFSET}) / {DAY}.0) as integer)"
    return f"{name} as (select distinct user_id, date '1970-01-01' + unnest(range({day('start_us')}, greatest({day('start_us')}, {day('end_us - 1')}) + 1))::integer as local_date from {source})"


def _merged_sql(name: str, source: str) -> str:
    return f"""{name}_a as (select *, case when start_us <= max(end_us) over (partition by user_id order by start_us, end_us rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from (select user_id, start_us, max(end_us) as end_us from {source} group by all)),
    {name}_b as (select *, sum(new) over (partition by user_id order by start_us, end_us rows unbounded preceding) as run from {name}_a),
    {name} as (select user_id, min(start_us) as start_us, max(end_us) as end_us from {name}_b group by user_id, run)"""


def _inter_sql(name: str, a: str, b: str) -> str:
    return f"{name} as (select a.user_id, greatest(a.start_us, b.start_us) as start_us, least(a.end_us, b.end_us) as end_us from {a} a join {b} b on a.user_id = b.user_id and a.start_us < b.end_us and b.start_us < a.end_us where greatest(a.start_us, b.start_us) < least(a.end_us, b.end_us))"


HIGH = _episodes_sql("hi", "value > 30", 2 * DAY)
BUSY = _episodes_sql("bu", "event_type in ('click', 'view')", 2 * DAY)


def _high(spark, d):
    return E.consecutive(events(spark, d), F.col("value") > 30, keys=K, max_gap_us=2 * DAY)


def _busy(spark, d):
    return E.consecutive(events(spark, d), F.col("event_type").isin("click", "view"), keys=K, max_gap_us=2 * DAY)


# --- events


@query(f"with {EV}, {_episodes_sql('e', 'value > 30', DAY, HOUR)} select user_id, start_us, end_us, samples from e")
def event_consecutive_episodes(spark, d):
    return E.consecutive(events(spark, d), F.col("value") > 30, keys=K, max_gap_us=DAY, min_us=HOUR)


@query(f"with {EV}, {_episodes_sql('e', "value > 20 and event_type <> 'error'", DAY)} select user_id, start_us, end_us, samples from e")
def event_compound_episodes(spark, d):
    return E.consecutive(events(spark, d), (F.col("value") > 20) & (F.col("event_type") != "error"), keys=K, max_gap_us=DAY)


@query("with b as (select user_id, avg(value) as base from events group by user_id) select event_id, user_id from events join b using (user_id) where value < 0.7 * base - 1e-9")
def event_relative_threshold(spark, d):
    ev = events(spark, d)
    base = ev.groupBy("user_id").agg(F.avg("value").alias("base"))
    return ev.join(base, "user_id").filter(F.col("value") < 0.7 * F.col("base") - 1e-9).select("event_id", "user_id")


@query(f"with {EV} select event_id, round(m, 4) as moving from (select event_id, value, avg(value) over (partition by user_id order by us range between {6 * HOUR} preceding and current row) as m from ev) where value > m + 5")
def event_moving_avg_threshold(spark, d):
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-6 * HOUR, 0)
    return events(spark, d).withColumn("m", F.avg("value").over(w)).filter("value > m + 5").select("event_id", F.round("m", 4).alias("moving"))


@query(f"with {EV}, {HIGH}, q as (select hi.user_id, hi.start_us, hi.end_us, avg(case when ev.event_type = 'click' then 1.0 else 0.0 end) as share from hi join ev on ev.user_id = hi.user_id and us between start_us and end_us group by all) select user_id, start_us, end_us, round(share, 6) as share from q where share > 0.25")
def event_window_qualified(spark, d):
    """Episodes in which more than a quarter of the samples are clicks; samples find their episode by the episode's first time."""
    ev = events(spark, d)
    marks = ev.select("user_id", "us", (F.col("event_type") == "click").cast("double").alias("hit"), F.lit(None).cast("long").alias("start_us"), F.lit(None).cast("long").alias("end_us"), F.lit(1).alias("o"))
    both = marks.unionByName(_high(spark, d).select("user_id", F.col("start_us").alias("us"), F.lit(None).cast("double").alias("hit"), "start_us", "end_us", F.lit(0).alias("o")))
    w = Window.partitionBy("user_id").orderBy("us", "o").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumns({"s": F.last("start_us", True).over(w), "e": F.last("end_us", True).over(w)}).filter("hit is not null and us <= e")
    share = placed.groupBy("user_id", F.col("s").alias("start_us"), F.col("e").alias("end_us")).agg(F.avg("hit").alias("share"))
    return share.filter("share > 0.25").withColumn("share", F.round("share", 6))


@query(f"with {EV}, {HIGH}, {_dates_sql('dd', 'hi')} select user_id, local_date from dd")
def event_local_dates(spark, d):
    return E.local_dates(_high(spark, d), keys=K, offset_us=OFFSET)


def _two_dates(spark, d):
    return E.local_dates(_high(spark, d), keys=K, offset_us=OFFSET), E.local_dates(_busy(spark, d), keys=K, offset_us=OFFSET)


_DATES2 = f"with {EV}, {HIGH}, {BUSY}, {_dates_sql('da', 'hi')}, {_dates_sql('db', 'bu')}"


@query(f"{_DATES2} select user_id, local_date from da intersect select user_id, local_date from db")
def event_date_intersect(spark, d):
    a, b = _two_dates(spark, d)
    return a.intersect(b)


@query(f"{_DATES2} select user_id, local_date from da union select user_id, local_date from db")
def event_date_union(spark, d):
    a, b = _two_dates(spark, d)
    return a.union(b).distinct()


@query(f"{_DATES2} select user_id, local_date from da except select user_id, local_date from db")
def event_date_difference(spark, d):
    a, b = _two_dates(spark, d)
    return a.subtract(b)


_IV = f"with {EV}, {HIGH}, {BUSY}, {_merged_sql('ma', 'hi')}, {_merged_sql('mb', 'bu')}"


@query(f"{_IV}, {_inter_sql('x', 'ma', 'mb')} select * from x")
def interval_intersect(spark, d):
    return E.intersection(_high(spark, d), _busy(spark, d), keys=K)


@query(f"{_IV}, un as (select user_id, start_us, end_us from hi union all select user_id, start_us, end_us from bu), {_merged_sql('mu', 'un')} select * from mu")
def interval_union(spark, d):
    cols = [*K, "start_us", "end_us"]
    return E.merged(_high(spark, d).select(cols).unionByName(_busy(spark, d).select(cols)), keys=K)


@query(
    f"""{_IV}, pts as (select user_id, start_us as pt from ma union select user_id, end_us from ma union select user_id, start_us from mb union select user_id, end_us from mb),
    seg as (select user_id, pt as start_us, lead(pt) over (partition by user_id order by pt) as end_us from pts),
    part as (select s.* from seg s where end_us is not null and exists (select 1 from ma where ma.user_id = s.user_id and ma.start_us <= s.start_us and ma.end_us >= s.end_us)
      and not exists (select 1 from mb where mb.user_id = s.user_id and mb.start_us <= s.start_us and mb.end_us >= s.end_us)), {_merged_sql('md', 'part')} select * from md"""
)
def interval_difference(spark, d):
    return E.difference(_high(spark, d), _busy(spark, d), keys=K)


@query(
    f"""{_IV}, {_inter_sql('x', 'ma', 'mb')}, un as (select user_id, start_us, end_us from hi union all select user_id, start_us, end_us from bu), {_merged_sql('mu', 'un')},
    j as (select user_id, sum(end_us - start_us) as t from mu group by user_id), c as (select user_id, sum(end_us - start_us) as t from x group by user_id)
    select j.user_id, case when j.t = 0 then null else round(coalesce(c.t, 0) / j.t::double, 9) end as overlap_ratio from j left join c using (user_id)"""
)
def event_overlap_ratio(spark, d):
    return E.overlap_ratio(_high(spark, d), _busy(spark, d), keys=K).withColumn("overlap_ratio", F.round("overlap_ratio", 9))


@query(
    f"""with {EV}, n as (select user_id, us, value, lead(us) over (partition by user_id order by us) as nxt from ev), h as (select * from n where value > 30 and nxt - us <= {DAY}),
    s as (select *, unnest(range(cast(floor((us + {OFFSET}) / {DAY}.0) as bigint), cast(floor((nxt - 1 + {OFFSET}) / {DAY}.0) as bigint) + 1)) as dd from h)
    select user_id, date '1970-01-01' + dd::integer as local_date, round(sum(least(nxt, (dd + 1) * {DAY} - {OFFSET}) - greatest(us, dd * {DAY} - {OFFSET})) / 1e6, 3) as seconds from s group by all"""
)
def cumulative_duration_by_day(spark, d):
    out = E.cumulative_duration(events(spark, d), F.col("value") > 30, keys=K, max_gap_us=DAY, offset_us=OFFSET)
    return out.withColumn("seconds", F.round("seconds", 3))


@query("select user_id, cast(ts as date) as day, count(*) filter (event_type = 'click') as clicks from events group by all having count(*) filter (event_type = 'click') > 0")
def cumulative_action_count(spark, d):
    return read(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "click").alias("clicks")).filter("clicks > 0")


@query("with g as (select avg(value) as g from events) select user_id, round(avg(value), 6) as mean from events, g group by user_id, g having avg(value) > g * 1.1")
def scoped_avg_vs_global(spark, d):
    ev = events(spark, d)
    per, all_ = ev.groupBy("user_id").agg(F.avg("value").alias("m")), ev.agg(F.avg("value").alias("g"))
    return per.crossJoin(F.broadcast(all_)).filter("m > g * 1.1").select("user_id", F.round("m", 6).alias("mean"))  # one row of statistics


@query("select l_returnflag, round(quantile_cont(l_extendedprice, 0.9) - quantile_cont(l_extendedprice, 0.1), 4) as spread from lineitem group by 1")
def quantile_spread(spark, d):
    q = quantiles(read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"high": 0.9, "low": 0.1})
    return q.select("l_returnflag", F.round(F.col("high") - F.col("low"), 4).alias("spread"))


@query("select p_brand, round(max(l_extendedprice * (1 - l_discount)), 4) as peak, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1 order by peak desc, p_brand limit 5")
def group_peak_topk(spark, d):
    j = read(spark, d, "lineitem").join(read(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_brand").agg(F.round(F.max(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("peak"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("peak"), "p_brand").limit(5)


_DAILY = "d as (select cast(o_orderdate as date) as day, sum(o_totalprice) as total, count(*) as n from orders group by 1)"


def _daily(spark, d):
    return read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n"))


def _monthly(spark, d):
    return read(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum("o_totalprice").alias("total"))


@query(f"with {_DAILY} select day, round(avg(total) over (order by day rows 6 preceding), 2) as rolling from d")
def rolling_avg(spark, d):
    return _daily(spark, d).select("day", F.round(F.avg("total").over(Window.orderBy("day").rowsBetween(-6, 0)), 2).alias("rolling"))  # a row a day


@query(f"with {_DAILY} select date_trunc('week', day)::date as week, round(avg(total), 6) as mean, sum(n)::bigint as n from d group by 1")
def weekly_grain(spark, d):
    return _daily(spark, d).groupBy(F.to_date(F.date_trunc("week", "day")).alias("week")).agg(F.round(F.avg("total"), 6).alias("mean"), F.sum("n").alias("n"))


@query("select round(corr(l_quantity, l_extendedprice), 6) as correlation, round(covar_samp(l_quantity, l_extendedprice), 3) as covariance, round(median(l_extendedprice), 4) as mid from lineitem")
def correlation_covariance_median(spark, d):
    lines = read(spark, d, "lineitem")
    both = lines.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("correlation"), F.round(F.covar_samp("l_quantity", "l_extendedprice"), 3).alias("covariance"))
    mid = quantiles(lines, [], "l_extendedprice", {"mid": 0.5})
    return both.crossJoin(F.broadcast(mid.select(F.round("mid", 4).alias("mid"))))  # one row each


@query("select l_returnflag, l_linestatus, round(max(l_quantity * l_extendedprice), 2) as largest from lineitem group by 1, 2")
def max_of_product(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.max(F.col("l_quantity") * F.col("l_extendedprice")), 2).alias("largest"))


_GROWTH = """with m as (select strftime(o_orderdate, '%Y-%m') as month, sum(o_totalprice) as total from orders group by 1),
    g as (select month, total / lag(total) over (order by month) - 1 as mom, total / lag(total, 12) over (order by month) - 1 as yoy from m)"""


def _growth(spark, d):
    w = Window.orderBy("month")  # a row a month
    t = F.col("total")
    return _monthly(spark, d).select("month", (F.try_divide(t, F.lag(t).over(w)) - 1).alias("mom"), (F.try_divide(t, F.lag(t, 12).over(w)) - 1).alias("yoy"))


@query(f"{_GROWTH} select month, round(mom, 6) as mom, round(yoy, 6) as yoy from g")
def mom_yoy_growth(spark, d):
    return _growth(spark, d).select("month", F.round("mom", 6).alias("mom"), F.round("yoy", 6).alias("yoy"))


@query(f"{_GROWTH} select month from g where mom > 0 and yoy > 0")
def positive_growth_filter(spark, d):
    return _growth(spark, d).filter("mom > 0 and yoy > 0").select("month")


@query("select cast(o_orderdate as date) as day, round(stddev_samp(o_totalprice), 3) as volatility from orders group by 1")
def daily_volatility(spark, d):
    return read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.stddev("o_totalprice"), 3).alias("volatility"))




def _delta():
    return F.when(F.col("event_type") == "purchase", -F.col("value")).otherwise(F.col("value") / 4)


_DELTA_SQL = "case when event_type = 'purchase' then -value else value / 4 end"


@query(f"with {EV} select event_id, round(100 + sum({_DELTA_SQL}) over (partition by user_id order by us, event_id rows unbounded preceding), 4) as state from ev")
def ordered_fold(spark, d):
    return E.ordered_fold(events(spark, d), _delta(), keys=K, initial=100.0).select("event_id", F.round("state", 4).alias("state"))


_SCAN_SQL = f"""with {EV}, s as (select *, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by us, event_id rows unbounded preceding) as seg from ev),
    f as (select event_id, user_id, us, sum(case when event_type = 'error' then 0.0 else {_DELTA_SQL} end) over (partition by user_id, seg order by us, event_id rows unbounded preceding) as state from s)"""


@query(f"{_SCAN_SQL} select event_id, round(state, 4) as state from f")
def resettable_scan(spark, d):
    return E.resettable_scan(events(spark, d), _delta(), F.col("event_type") == "error", keys=K).select("event_id", F.round("state", 4).alias("state"))


@query(f"{_SCAN_SQL}, ev2 as (select * from f), " + _episodes_sql("e", "state < -0.0001", 3 * DAY, HOUR).replace("from ev group", "from ev2 group") + " select user_id, start_us, end_us, samples from e")
def fold_negative_duration(spark, d):
    f = E.resettable_scan(events(spark, d), _delta(), F.col("event_type") == "error", keys=K)
    return E.consecutive(f, F.col("state") < -0.0001, keys=K, max_gap_us=3 * DAY, min_us=HOUR)


@query(f"""with recursive e as (select event_id, user_id, epoch_us(ts) as us, event_type as a, row_number() over (partition by user_id order by ts, event_id) as k from events), s as (select ['view', 'click', 'purchase'] as steps),
    r as (select user_id, k, us, (a = 'view')::int as seen, case when a = 'view' then us end as start, null::bigint as start_us, null::bigint as end_us from e where k = 1 union all
    select user_id, k, us, case when hit and seen = 2 then 0 when hit then seen + 1 else seen end, case when hit and seen = 2 then null when hit and seen = 0 then us when seen > 0 then start end, case when hit and seen = 2 then start end, case when hit and seen = 2 then us end
    from (select *, a = steps[seen + 1] as hit from (select e.user_id, e.k, e.us, e.a, steps, case when r.seen > 0 and e.us - r.start > {10 * DAY} then 0 else r.seen end as seen, case when r.seen > 0 and e.us - r.start > {10 * DAY} then null else r.start end as start from r join e on e.user_id = r.user_id and e.k = r.k + 1, s)))
    select user_id, start_us, end_us from r where end_us is not null""")
def action_sequence(spark, d):
    return E.sequence_matches(events(spark, d), ["view", "click", "purchase"], keys=K, action="event_type", within_us=10 * DAY)


@query("select event_id, round((value + 273.15 - 459.67 * 5 / 9) / (5.0 / 9), 6) as fahrenheit, round(value / 3.6, 6) as metres_a_second from events")
def unit_convert(spark, d):
    v = F.col("value")
    return read(spark, d, "events").select("event_id", F.round(units.convert(v, "celsius", "fahrenheit"), 6).alias("fahrenheit"), F.round(units.convert(v, "kilometre_per_hour", "metre_per_second"), 6).alias("metres_a_second"))


@query(f"with {EV} select event_id, us - {OFFSET} as utc_us from ev")
def timezone_to_utc(spark, d):
    return events(spark, d).select("event_id", F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("us"), "Asia/Shanghai")).alias("utc_us"))


@query("select event_id, value from events where value > 50 and value < 50")
def unsatisfiable_filter(spark, d):
    steps = [P.Step("e", "source", params={"table": "events"}), P.Step("f", "filter", ("e",), {"predicates": [P.Predicate("value", "gt", 50), P.Predicate("value", "lte", 50)]})]
    return P.lower(steps, {"events": read(spark, d, "events")})["f"].select("event_id", "value")


@query(f"""{_DATES2}, b as (select user_id, local_date from da intersect select user_id, local_date from db), x as (select user_id, value, date '1970-01-01' + cast(floor((us + {OFFSET}) / {DAY}.0) as integer) as local_date from ev)
    select user_id, round(avg(value), 9) as mean, count(value) as n from x semi join b using (user_id, local_date) group by 1""")
def signature_plan(spark, d):
    """Two event sets, their dates, the common dates, and the mean over them: the flagship plan."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor((F.col("us") + OFFSET) / DAY).cast("int"))
    s = P.Step
    steps = [
        s("e", "source", params={"table": "events"}),
        s("hi", "consecutive", ("e",), {"predicates": [P.Predicate("value", "gt", 30)], "keys": K, "max_gap_us": 2 * DAY}),
        s("bu", "consecutive", ("e",), {"predicates": [P.Predicate("event_type", "in", ("click", "view"))], "keys": K, "max_gap_us": 2 * DAY}),
        s("da", "project_date", ("hi",), {"keys": K, "offset_us": OFFSET}), s("db", "project_date", ("bu",), {"keys": K, "offset_us": OFFSET}),
        s("both", "intersection", ("da", "db"), {"keys": K}),
        s("mean", "scoped_aggregate", ("e", "both"), {"scope": ["user_id", "local_date"], "by": K, "outputs": {"mean": ("avg", "value"), "n": ("count", "value")}}),
    ]
    return P.lower(steps, {"events": events(spark, d).withColumn("local_date", day)})["mean"].withColumn("mean", F.round("mean", 9))


# --- documents


@query("select doc_id, lang, n_chars from documents where n_chars between 500 and 2000 and lang in ('en', 'de') and lower(source) like '%src1%'")
def doc_attribute_filter(spark, d):
    return read(spark, d, "documents").filter(F.col("n_chars").between(500, 2000) & F.col("lang").isin("en", "de") & F.lower("source").contains("src1")).select("doc_id", "lang", "n_chars")


@query("select doc_id from documents left join labels using (doc_id) where (lang is null or lang <> 'en') and (source is null or source not in ('src1', 'src2')) and coalesce(toxic, 0) = 0")
def doc_exclusion_filter(spark, d):
    bad = read(spark, d, "labels").filter("toxic = 1").select("doc_id")
    docs = read(spark, d, "documents").filter((F.coalesce("lang", F.lit("")) != "en") & ~F.coalesce("source", F.lit("")).isin("src1", "src2"))
    return docs.join(bad, "doc_id", "left_anti").select("doc_id")


@query("select lang, source, count(*) as n from documents group by grouping sets ((lang), (source))")
def doc_inventory_stats(spark, d):
    return read(spark, d, "documents").groupingSets([["lang"], ["source"]], "lang", "source").agg(F.count(F.lit(1)).alias("n"))


_WS = r"[ \t\r\n\f\v]+"


@query(rf"select doc_id, md5(trim(regexp_replace(regexp_replace(text, '[^一-鿿a-zA-Z0-9]', ' ', 'g'), '{_WS}', ' ', 'g'))) as cleaned from documents")
def text_clean_embed(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.clean_embed(F.col("text"))).alias("cleaned"))


@query(rf"select doc_id, md5(trim(regexp_replace(regexp_replace(text, '[^一-鿿a-zA-Z0-9.,;:!?()%\-]', ' ', 'g'), '{_WS}', ' ', 'g'))) as cleaned from documents")
def text_clean_pdf(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.clean_pdf(F.col("text"))).alias("cleaned"))


def _bounded_sql(x: str, pattern: str) -> str:
    """Replace a pattern that no digit may stand before or after; twice, as a mark between two matches belongs to one of them only."""
    once = lambda y: f"regexp_replace({y}, '(^|[^0-9])(?:{pattern})($|[^0-9])', '\\1[PII]\\2', 'g')"
    return once(once(x))


_W = r"[\p{L}\p{M}\p{N}_"
_PLACES = rf"regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\s，。；！？]+', '[URL]', 'gi'), '{_W}.+-]+@{_W}-]+\.{_W}.-]+', '[EMAIL]', 'g'), '(?:[A-Za-z]:)?[\\/]{_W}\-.\\/ ]{{2,}}', '[PATH]', 'g')"
_SPOKEN = f"regexp_replace(regexp_replace({_PLACES}, '我|俺|咱', '用户', 'g'), '你|您', 'Agent', 'g')"
_MASKED = _bounded_sql(_bounded_sql(f"regexp_replace({_bounded_sql(_SPOKEN, r'(?:[+]?86[- ]?)?1[3-9][0-9]{9}')}, '1[3-9][0-9](?:[*]{{4}}|[0-9]{{4}})[0-9]{{4}}', '[PII]', 'g')", "[0-9]{17}[0-9Xx]"), "(?:62|60)[0-9]{14,18}")


@query(f"select doc_id, md5({_MASKED}) as masked from documents")
def text_pii_mask(spark, d):
    """Places and people masked; RE2 has no look-around, so the SQL takes the marks around a number with it and puts them back."""
    return read(spark, d, "documents").select("doc_id", F.md5(L.mask_people(L.mask_places(F.col("text")))).alias("masked"))


@query("select doc_id, floor((c + floor((length(text) - c) / 4)) * 11 / 10)::bigint as tokens from (select doc_id, text, length(regexp_replace(text, '[^一-鿿　-〿＀-￯]', '', 'g')) as c from documents)")
def text_token_estimate(spark, d):
    return read(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("select case when length(regexp_replace(left(text, 5000), '[^一-鿿]', '', 'g')) > length(left(text, 5000)) * 0.05 then 'zh' else 'en' end as script, count(*) as n from documents group by 1")
def text_script_language(spark, d):
    return read(spark, d, "documents").groupBy(T.language_by_script(F.col("text")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """with q as (select page_id as id, greatest(0, 1 - case when trim(coalesce(html, '')) = '' then 1.2 else 0 end - least(0.4, 20.0 * (length(coalesce(html, '')) - length(replace(coalesce(html, ''), '�', ''))) / greatest(length(coalesce(html, '')), 1))) as s from pages)
    select case when s >= 0.8 then 'pass' when s >= 0.55 then 'review' else 'fail' end as grade, count(*) as n, round(avg(s), 6) as mean from q group by 1"""
)
def doc_quality_score(spark, d):
    s = read(spark, d, "pages").select(T.quality(F.col("html")).alias("s"))
    return s.groupBy(T.quality_grade(F.col("s")).alias("grade")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("mean"))


_CHUNKS = rf"""t as (select doc_id, trim(regexp_replace(text, '{_WS}', ' ', 'g')) as t from documents), c as (
    select doc_id, t, unnest(range(0, greatest(0, ceil((length(t) - 500) / 400.0)::integer) + 1))::integer as chunk_index from t where t <> ''),
    ch as (select doc_id, chunk_index, substring(t, chunk_index * 400 + 1, 500) as chunk from c)"""


@query(f"with {_CHUNKS} select doc_id, chunk_index, md5(chunk) as chunk from ch")
def chunk_fixed_window(spark, d):
    return R.fixed_windows(read(spark, d, "documents")).withColumn("chunk", F.md5("chunk"))


@query(r"""with recursive l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents where text is not null),
    p as (select doc_id, i, regexp_replace(line, '^\s+|\s+$', '', 'g') as line from l), c as (select doc_id, i, line, unnest(range(0, ceil(length(line) / 512.0)::int)) as j from p where line <> ''),
    e as (select doc_id, substring(line, (j * 512 + 1)::int, 512) as part, row_number() over (partition by doc_id order by i, j) as k from c),
    r as (select doc_id, k, 0 as c, length(part) as n from e where k = 1 union all select e.doc_id, e.k, case when r.n + 1 + length(e.part) <= 512 then r.c else r.c + 1 end, case when r.n + 1 + length(e.part) <= 512 then r.n + 1 + length(e.part) else length(e.part) end
    from r join e on e.doc_id = r.doc_id and e.k = r.k + 1) select doc_id, c as chunk_index, string_agg(part, chr(10) order by k) as chunk from r join e using (doc_id, k) group by 1, 2""")
def chunk_paragraph(spark, d):
    return R.paragraph_chunks(read(spark, d, "documents"))


@query(f"""with {_CHUNKS} select doc_id, chunk_index, coalesce(right(lag(chunk) over w, 200), '') as before, coalesce(left(lead(chunk) over w, 200), '') as after from ch window w as (partition by doc_id order by chunk_index)""")
def context_expand(spark, d):
    return R.neighbours(R.fixed_windows(read(spark, d, "documents")))


@query("""with r as (select sha256(concat_ws(':', coalesce('v' || doc_id, 'n'), coalesce('v' || lang, 'n'), coalesce('v' || sha256(text), 'n'))) as x from documents),
    a as (select substring(x, 1, 4) as p, sha256(string_agg(x, chr(10) order by x)) as h, count(*) as n from r group by 1),
    b as (select substring(p, 1, 2) as p, sha256(string_agg(p || h, chr(10) order by p)) as h, sum(n) as n from a group by substring(p, 1, 2))
    select sha256(coalesce(string_agg(p || h, chr(10) order by p), '')) as digest, coalesce(sum(n), 0)::bigint as n from b""")
def generation_digest(spark, d):
    """One digest of all documents: sorted row hashes are hashed by range of four digits, these by two, these to one."""
    part = lambda c: F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))
    row = F.sha2(F.concat_ws(":", part(F.col("doc_id")), part(F.col("lang")), part(F.sha2("text", 256))), 256)
    node = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    out = read(spark, d, "documents").select(row.alias("x")).groupBy(F.substring("x", 1, 4).alias("p")).agg(node("x").alias("h"), F.count(F.lit(1)).alias("n"))
    out = out.select(F.substring("p", 1, 2).alias("q"), F.concat("p", "h").alias("x"), "n").groupBy("q").agg(node("x").alias("h"), F.sum("n").alias("n"))
    return out.select(F.concat("q", "h").alias("x"), "n").agg(node("x").alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("select sha256(text) as content_hash, min(doc_id) as doc_id, count(*) as copies from documents group by 1")
def dedupe_content_hash(spark, d):
    return read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


TERMS = ["the", "license", "token"]
_BM25 = """w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from documents),
    tf as (select doc_id, len(w) as dl, """ + ", ".join(f"len(list_filter(w, lambda x: x = '{q}')) as tf{i}" for i, q in enumerate(TERMS)) + """ from w),
    st as (select count(*) as n, avg(dl) as avgdl, """ + ", ".join(f"count(*) filter (tf{i} > 0) as df{i}" for i in range(3)) + """ from tf),
    bm as (select doc_id, """ + " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(3)) + """ as score from tf, st where tf0 > 0 or tf1 > 0 or tf2 > 0)"""  # fmt: skip


def _bm25(spark, d):
    return S.bm25(S.opened(spark, d), TERMS, boosts={"content": 1.0}).withColumn("score", F.round("score", 9))


_BM25 = _BM25.replace(" as score from tf", " as raw from tf").replace("bm as (select doc_id,", "bm0 as (select doc_id,") + ", bm as (select doc_id, round(raw, 9) as score from bm0)"


@query(f"with {_BM25} select doc_id, round(score, 5) as score from bm order by bm.score desc, doc_id limit 20")
def bm25_topk(spark, d):
    return _bm25(spark, d).orderBy(F.desc("score"), "doc_id").limit(20).withColumn("score", F.round("score", 5))


_VEC = "q as (select embedding as q from embeddings where vec_id = 0), vs as (select vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::double), list_transform(q, lambda x: x::double)), 9) as score from embeddings, q)"


def text_vectors_sql(name: str, source: str, key: str, text: str = "text") -> str:
    """CTE ``name`` (key, d, s): the components that aren't zero of ``encoding.encoded`` over a source's texts."""
    return f"""{name}_c as (select {key}, list_transform(string_split(' ' || trim(regexp_replace(lower({text}), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) || ' ', ''), lambda x: unicode(x)::bigint) as c from {source} where {text} is not null),
    {name}_g as (select {key}, unnest([(c[i] * 7919 + c[i + 1] * 104729 + c[i + 2] * 1299709) % 2147483647 for i in range(1, len(c) - 1)]) as g from {name}_c),
    {name}_h as (select {key}, g * 48271 % 2147483647 as h from {name}_g union all select {key}, g * 69621 % 2147483647 from {name}_g),
    {name} as (select {key}, h % 64 as d, sum(case when (h // 64) % 2 = 0 then 1 else -1 end)::double as s from {name}_h group by 1, 2)"""


#: What the hybrid queries ask for, by its words and by the vector of its text.
ASKED = "the license token of the source"
_TEXT = f"""{text_vectors_sql('tv', 'documents', 'doc_id')}, {text_vectors_sql('tq', f"(select 0 as k, '{ASKED}' as text)", 'k')},
    tn as (select doc_id, sqrt(sum(s * s)) as n from tv group by 1), qn as (select sqrt(sum(s * s)) as n from tq),
    ts as (select doc_id, round(sum(tv.s * tq.s) / (any_value(tn.n) * (select n from qn)), 9) as score from tv join tn using (doc_id) left join tq using (d) where n > 0 group by 1)"""


def text_table(spark, d):
    """(doc_id, vector) of all documents' texts, written once a session."""
    path = f"{d}/documents.parquet"
    make = lambda: written(encoding.encoded(read(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "vector"), "textvectors")
    return kept(spark, "text vectors", path, make)


def _by_text(spark, d, k, allowed=None):
    """(doc_id, score) of the ``k`` documents whose text's vector is nearest to that of what is asked."""
    asked = encoding.encoded(spark.createDataFrame([(ASKED,)], "text string"), "text").withColumnRenamed("vector", "v")
    rows = text_table(spark, d).filter("vector is not null").withColumnRenamed("vector", "v")
    return S.near_chunks(rows, asked, k, id_col="doc_id", allowed=allowed, vec_col="v").withColumn("score", F.round("score", 9)).filter("score is not null")


def _vec(spark, d, k):
    v = read(spark, d, "embeddings")
    return R.nearest(v, v.filter("vec_id = 0"), k).withColumn("score", F.round("score", 9))


@query(f"with {_VEC} select vec_id, round(score, 5) as score from vs order by vs.score desc, vec_id limit 20")
def vector_topk(spark, d):
    return _vec(spark, d, 20).withColumn("score", F.round("score", 5))


_RRF = f"""with {_BM25}, {_TEXT}, a as (select doc_id, row_number() over (order by score desc, doc_id) as rank from bm qualify rank <= 20), b as (select doc_id, row_number() over (order by score desc, doc_id) as rank from ts where score is not null qualify rank <= 20),
    f as (select doc_id, sum(1 / (60 + rank)) as rrf from (select * from a union all select * from b) group by 1)"""


@query(f"{_RRF} select doc_id, round(rrf, 9) as rrf from f order by f.rrf desc, doc_id limit 10")
def hybrid_rrf(spark, d):
    """By words and by the vectors of the same texts."""
    a, b = R.ranked(_bm25(spark, d), "doc_id", 20), R.ranked(_by_text(spark, d, 20), "doc_id", 20)
    return R.fuse([a, b], "doc_id", 10).withColumn("rrf", F.round("rrf", 9))


@query(f"""with {_BM25}, {_TEXT}, ok as (select doc_id from documents where lang = 'en' and n_chars < 3000), a as (select doc_id, row_number() over (order by score desc, doc_id) as rank from bm semi join ok using (doc_id) qualify rank <= 10),
    n as (select doc_id, score from ts semi join ok using (doc_id) where score is not null order by ts.score desc, doc_id limit 20), b as (select doc_id, row_number() over (order by score desc, doc_id) as rank from n qualify rank <= 10)
    select doc_id, round(sum(1 / (60 + rank)), 9) as rrf from (select * from a union all select * from b) group by 1 order by sum(1 / (60 + rank)) desc, min(rank), doc_id limit 5""")
def hybrid_filtered(spark, d):
    """Attributes first, then words and the texts' vectors among what is left, fused."""
    allowed = read(spark, d, "documents").filter("lang = 'en' and n_chars < 3000").select("doc_id")
    near = _by_text(spark, d, 20, allowed)
    words = _bm25(spark, d).join(F.broadcast(allowed) if allowed.count() <= 100_000 else allowed, "doc_id", "left_semi")
    both = [S.top(words, "doc_id", 10), S.top(near, "doc_id", 10)]
    ranks = both[0].unionByName(both[1]).groupBy("doc_id").agg(F.sum(1 / (F.lit(R.RRF_K) + F.col("rank"))).alias("rrf"), F.min("rank").alias("best"))
    return ranks.orderBy(F.desc("rrf"), "best", "doc_id").limit(5).select("doc_id", F.round("rrf", 9).alias("rrf"))


@query(f"""with {_VEC}, c as (select label, vec_id % 5 as cluster, max(score) as best from vs join embeddings using (vec_id) where vec_id > 0 group by 1, 2),
    t as (select label, best from c qualify row_number() over (partition by label order by best desc, cluster) <= 3), s as (select label, avg(best) as score from t group by 1)
    select label, round(score, 6) as score, round(score - lead(score) over (order by score desc, label), 6) as margin from s""")
def category_matrix_route(spark, d):
    v = read(spark, d, "embeddings")
    q = v.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    s = v.filter("vec_id > 0").crossJoin(F.broadcast(q)).select("label", (F.col("vec_id") % 5).alias("cluster"), F.round(R.cosine(F.col("embedding"), F.col("q")), 9).alias("score"))
    best = s.groupBy("label", "cluster").agg(F.max("score").alias("best"))
    top = best.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("best"), "cluster"))).filter("r <= 3").groupBy("label").agg(F.avg("best").alias("score"))
    return top.select("label", F.round("score", 6).alias("score"), F.round(F.col("score") - F.lead("score").over(Window.orderBy(F.desc("score"), "label")), 6).alias("margin"))


@query("""with r as (select vec_id, label, row_number() over (partition by label order by vec_id) as rank from embeddings), rel as (select label, vec_id from embeddings where vec_id % 7 = 0),
    p as (select rel.label, count(*) filter (rank <= 1) / count(*) as a, count(*) filter (rank <= 3) / count(*) as b, count(*) filter (rank <= 5) / count(*) as c, count(*) filter (rank <= 10) / count(*) as e, coalesce(max(case when rank <= 10 then 1 / rank end), 0) as rr from rel left join r using (label, vec_id) group by 1)
    select count(*) as queries, round(avg(a), 6) as recall_1, round(avg(b), 6) as recall_3, round(avg(c), 6) as recall_5, round(avg(e), 6) as recall_10, round(avg(rr), 6) as mrr_10 from p""")
def retrieval_recall_mrr(spark, d):
    v = read(spark, d, "embeddings")
    ranks = v.select("label", "vec_id", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("rank"))
    return R.recall_mrr(ranks, v.filter("vec_id % 7 = 0").select("label", "vec_id"), query="label", item="vec_id")


@query("select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95 from events group by 1")
def latency_percentiles(spark, d):
    """Nearest-rank percentiles."""
    return quantiles(read(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95}, method="nearest")


@query("""with c as (select event_type, count(*) filter (value > 50) as k, count(*) as n from events group by 1) select event_type,
    round((k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) as low,
    round((k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) as high from c""")
def wilson_interval(spark, d):
    c = read(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = R.wilson(F.col("k"), F.col("n"))
    return c.select("event_type", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("select lang, count(*) as n, count(*) filter (toxic = 1) as toxic, count(*) filter (quality = 1) as good, round(count(*) filter (quality = 1) / count(*), 6) as precision, count(*) filter (quality = 1) / count(*) >= 0.5 as gate from documents join labels using (doc_id) group by 1")
def acceptance_gates(spark, d):
    j = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels"), "doc_id")
    good = F.count_if(F.col("quality") == 1)
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic"), good.alias("good"), F.round(good / F.count(F.lit(1)), 6).alias("precision"), (good / F.count(F.lit(1)) >= 0.5).alias("gate"))


@query("select lang, count(*) filter (source = 'src1') as src1, count(*) filter (source = 'src2') as src2, count(*) filter (source = 'src3') as src3 from documents where source in ('src1', 'src2', 'src3') group by 1")
def comparison_coverage(spark, d):
    p = read(spark, d, "documents").filter(F.col("source").isin("src1", "src2", "src3")).groupBy("lang").pivot("source", ["src1", "src2", "src3"]).count()
    return p.na.fill(0)


# --- memory, logs, state


@query("select role, count(*) as n, round(avg(length(text)), 3) as mean_length, count(distinct conv_id) as conversations from conversations group by 1")
def memory_stats(spark, d):
    return read(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 3).alias("mean_length"), F.countDistinct("conv_id").alias("conversations"))


@query("with k as (select conv_id, turn, (contains(lower(text), 'the')::int + contains(lower(text), 'der')::int + contains(lower(text), 'que')::int) as hits from conversations) select conv_id, turn, hits from k where hits > 0 order by hits desc, conv_id, turn limit 25")
def memory_keyword_recall(spark, d):
    hits = sum((F.lower("text").contains(w).cast("int") for w in ("the", "der", "que")), F.lit(0))
    return read(spark, d, "conversations").select("conv_id", "turn", hits.alias("hits")).filter("hits > 0").orderBy(F.desc("hits"), "conv_id", "turn").limit(25)


@query("select conv_id, turn from conversations a where turn > 0 and not exists (select 1 from conversations b where b.turn = 0 and trim(b.text) = trim(a.text))")
def memory_dedupe(spark, d):
    """New facts: later messages whose trimmed text isn't among the first messages."""
    c = read(spark, d, "conversations").withColumn("t", F.trim("text"))
    return c.filter("turn > 0").join(c.filter("turn = 0").select("t"), "t", "left_anti").select("conv_id", "turn")


@query("select conv_id, turn, lag(role, 1) over w as before, md5(coalesce(lag(text, 2) over w, '') || '|' || coalesce(lag(text, 1) over w, '')) as context from conversations window w as (partition by conv_id order by turn)")
def conversation_context(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    near = F.concat(F.coalesce(F.lag("text", 2).over(w), F.lit("")), F.lit("|"), F.coalesce(F.lag("text", 1).over(w), F.lit("")))
    return read(spark, d, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.md5(near).alias("context"))


@query(f"""with {EV}, n as (select user_id, us, case when us - lag(us) over (partition by user_id order by us) <= {DAY} then 0 else 1 end as new from ev),
    s as (select *, sum(new) over (partition by user_id order by us rows unbounded preceding)::bigint as session from n) select user_id, session, min(us) as start_us, max(us) as end_us, count(*) as n from s group by 1, 2""")
def session_staleness(spark, d):
    return E.session_gaps(events(spark, d), keys=K, gap_us=DAY)


@query(r"select event_id, lower(substring(trim(regexp_replace(trim(props), '[ \t\r\n\f\v]+', ' ', 'g')), 1, 200)) as norm from events")
def log_normalize(spark, d):
    return read(spark, d, "events").select("event_id", T.normalise_query(F.col("props")).alias("norm"))


@query("select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def log_dedupe(spark, d):
    return read(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("select cast(ts as date) as day, count(*) as calls, count(*) filter (event_type = 'error') as failed, round(count(*) filter (event_type = 'error') / count(*), 4) as failure_rate from events group by 1")
def log_daily_rollup(spark, d):
    bad = F.count_if(F.col("event_type") == "error")
    return read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("calls"), bad.alias("failed"), F.round(F.try_divide(bad, F.count(F.lit(1))), 4).alias("failure_rate"))


@query(f"""with {EV}, t as (select event_type as s, lag(event_type) over (partition by user_id order by us, event_id) as p from ev) select p as from_state, s as to_state, count(*) as n from t where p is not null
    and not ((p = 'signup' and s = 'view') or (p = 'view' and s in ('click', 'view')) or (p = 'click' and s in ('view', 'purchase'))) group by 1, 2""")
def state_transition_audit(spark, d):
    """Illegal transitions by kind."""
    allowed = spark.createDataFrame([("signup", "view"), ("view", "click"), ("view", "view"), ("click", "view"), ("click", "purchase")], "from_state string, to_state string")
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    t = events(spark, d).select(F.lag("event_type").over(w).alias("from_state"), F.col("event_type").alias("to_state")).filter("from_state is not null")
    return t.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(allowed), ["from_state", "to_state"], "left_anti")


_STEP = "from r join e on e.user_id = r.user_id and e.k = r.k + 1"
_ROWS = "e as (select event_id, user_id, epoch_us(ts) as us, event_type, value, row_number() over (partition by user_id order by ts, event_id) as k from events)"


@query(f"""with recursive {_ROWS}, r as (select event_id, user_id, us, k, us as start, 1 as n from e where k = 1 union all
    select e.event_id, e.user_id, e.us, e.k, case when e.us - r.start >= {2 * DAY} then e.us else r.start end, case when e.us - r.start >= {2 * DAY} then 1 else r.n + 1 end {_STEP}) select user_id, event_id, us, n <= 3 as admitted from r""")
def rate_limit_anchored(spark, d):
    return E.anchored_rate_limit(events(spark, d), key="user_id", limit=3, window_us=2 * DAY)


@query(f"""with recursive {_ROWS}, r as (select event_id, user_id, us, k, event_type = 'error' as failed, 'closed' as seen, case when event_type = 'error' then 1 else 0 end as n, 'closed' as state, 0::bigint as since from e where k = 1 union all
    select event_id, user_id, us, k, failed, seen, case when seen = 'open' then n when failed then n + 1 else 0 end, case when seen = 'open' then 'open' when failed and (seen = 'half_open' or n + 1 >= 2) then 'open' when failed then seen else 'closed' end,
    case when seen <> 'open' and failed and (seen = 'half_open' or n + 1 >= 2) then us else since end from (select e.event_id, e.user_id, e.us, e.k, e.event_type = 'error' as failed, case when r.state = 'open' and e.us - r.since >= {DAY} then 'half_open' else r.state end as seen, r.n, r.since {_STEP}))
    select user_id, event_id, us, failed, seen as state from r""")
def breaker_states(spark, d):
    return E.breaker_states(events(spark, d), F.col("event_type") == "error", key="user_id", failures=2, cool_us=DAY)


@query(f"""with recursive {_ROWS}, r as (select event_id, user_id, us, k, value as cost, value <= 500 as admitted, case when value <= 500 then value else 0 end as used from e where k = 1 union all
    select e.event_id, e.user_id, e.us, e.k, e.value, r.used + e.value <= 500, r.used + case when r.used + e.value <= 500 then e.value else 0 end {_STEP}) select user_id, event_id, us, cost, admitted from r""")
def budget_admission(spark, d):
    return E.budget_admission(events(spark, d), F.col("value"), key="user_id", ceiling=500.0)


@query("select event_id from events")
def stream_dedupe(spark, d):
    return logs.drained(logs.deduplicated(logs.stream(spark, d)).select("event_id"), "append")


@query("select cast(ts as date) as day, event_type, count(*) as n from events group by 1, 2")
def stream_windowed_counts(spark, d):
    out = logs.drained(logs.windowed_counts(logs.stream(spark, d)), "complete")
    return out.select(F.to_date("window.start").alias("day"), "event_type", "n")
