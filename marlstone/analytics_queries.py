"""Queries of series algebra, search, evidence, stores and state beyond ``queries.py``, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as T
from .operators import acceptance as AC
from .operators import analytics as A
from .operators import evidence as V
from .operators import memory as M
from .operators import retrieval as R
from .operators import search as S
from .plans import algebra as P
from .queries import _BM25, _RRF, _TEXT, DAY, EV, HIGH, HOUR, K, _high, query
from .sources import files as FI
from .sources import tables as TB
from .sources.tables import events, read
from .streaming import logs

# --- durations, ratios, windows

SPANS = f"""{EV}, once as (select user_id, us, arg_max(value, event_id) as value, arg_max(event_type, event_id) as event_type from ev group by 1, 2),
    sp as (select user_id, us as a, lead(us) over (partition by user_id order by us) as b, value, event_type from once), spans as (select * from sp where b - a <= {DAY})"""
_IN = f"""{SPANS}, {HIGH}, j as (select hi.user_id, start_us, end_us, sum(least(b, end_us) - greatest(a, start_us)) / 1e6 as s from hi join spans s on s.user_id = hi.user_id and a < end_us and start_us < b and event_type = 'click' group by all)"""


@query(f"""with {SPANS}, {HIGH}, ln as (select user_id, us as a, lead(us) over w as b, value as p, lead(value) over w as q from once window w as (partition by user_id order by us)),
    m as (select hi.user_id, start_us, end_us, greatest(a, start_us) as x, least(b, end_us) as y, a, b, p, q from hi join ln on ln.user_id = hi.user_id and b - a <= {DAY} and a < end_us and start_us < b and p is not null and q is not null),
    l as (select *, p + (q - p) * ((x - a) / (b - a)) - 35 as u, p + (q - p) * ((y - a) / (b - a)) - 35 as v from m),
    t as (select user_id, start_us, end_us, sum(case when u > 0 and v > 0 then 1.0::double when u <= 0 and v <= 0 then 0 else greatest(u, v) / abs(u - v) end * (y - x)) / 1e6 as s from l group by 1, 2, 3)
    select user_id, start_us, end_us, round(coalesce(s, 0), 3) as seconds from (select distinct user_id, start_us, end_us from hi) left join t using (user_id, start_us, end_us)""")
def scoped_linear_duration(spark, d):
    out = A.scoped_linear_duration(events(spark, d), "value", 35.0, _high(spark, d), keys=K, max_gap_us=DAY)
    return out.select("user_id", "start_us", "end_us", F.round("seconds", 3).alias("seconds"))


_CASES = """cs as (select doc_id as case_id, case when toxic = 1 then 'reject' when quality = 0 then 'clarify' else 'auto_release' end as expected, case when quality = 1 then 'multi_turn' else 'single' end as stratum from labels),
    pr as (select doc_id as case_id, source, case when contains(lower(text), 'license') then 'reject' when n_chars > 6000 then 'clarify' else 'auto_release' end as outcome, n_chars % 50 = 0 as critical, n_chars > 9000 as unnecessary, lang is null as rejected, n_chars % 3 = 0 as completed,
      case when n_chars < 4000 then n_chars / 10.0 end::double as low_cost_ms, case when n_chars >= 4000 then n_chars / 2.0 end::double as upgrade_ms, n_chars::double as end_to_end_ms from documents)"""


@query(f"""with {_CASES}, j as (select *, outcome = 'auto_release' as rel, outcome = expected as ok from cs join pr using (case_id)),
    a as (select count(*) as total, count(*) filter (rel) as released, count(*) filter (rel and not ok) as release_errors, count(*) filter (rel and ok) as correct_releases, count(*) filter (critical) as critical, count(*) filter (unnecessary) as clarified,
      count(*) filter (rejected) as rejected, count(*) filter (stratum = 'multi_turn' and completed) as completed, quantile_disc(low_cost_ms, 0.95) as low_cost_ms_p95, quantile_disc(upgrade_ms, 0.5) as upgrade_ms_p50, quantile_disc(upgrade_ms, 0.95) as upgrade_ms_p95,
      quantile_disc(end_to_end_ms, 0.5) as end_to_end_ms_p50, quantile_disc(end_to_end_ms, 0.95) as end_to_end_ms_p95 from j)
    select total, released, release_errors, correct_releases, critical, clarified, rejected, completed, (select count(*) from documents where doc_id not in (select doc_id from labels)) as faults, round(release_errors / released, 6) as error_rate,
    round((release_errors / released + 1.96 * 1.96 / (2 * released) - 1.96 * sqrt(release_errors / released * (1 - release_errors / released) / released + 1.96 * 1.96 / (4.0 * released * released))) / (1 + 1.96 * 1.96 / released), 6) as error_low,
    round((release_errors / released + 1.96 * 1.96 / (2 * released) + 1.96 * sqrt(release_errors / released * (1 - release_errors / released) / released + 1.96 * 1.96 / (4.0 * released * released))) / (1 + 1.96 * 1.96 / released), 6) as error_high,
    low_cost_ms_p95, upgrade_ms_p50, upgrade_ms_p95, end_to_end_ms_p50, end_to_end_ms_p95 from a""")
def acceptance_summary(spark, d):
    """Labelled documents as cases, a rule's verdicts on the documents as predictions."""
    out = AC.summary(*_cases(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("error_rate", "error_low", "error_high")})


@query(f"""with {_CASES}, j as (select source as category, outcome = 'auto_release' as released, outcome = expected as correct, critical from cs join pr using (case_id) where coalesce(source, '') <> ''),
    n as (select category, count(*) as samples, count(*) filter (released) as released, count(*) filter (released and correct) as correct, count(*) filter (critical) as critical from j group by 1)
    select *, coalesce(round(correct / nullif(released, 0), 6), 0) as precision, released >= 5 as enough, coalesce(correct / nullif(released, 0), 0) >= 0.98 as precise, critical = 0 as uncritical, released >= 5 and coalesce(correct / nullif(released, 0), 0) >= 0.98 and critical = 0 as passed from n""")
def category_gates(spark, d):
    cases, predictions = _cases(spark, d)
    rows = cases.join(predictions, "case_id").select(F.col("source").alias("category"), (F.col("outcome") == "auto_release").alias("released"), (F.col("outcome") == F.col("expected")).alias("correct"), "critical")
    return AC.category_gates(rows, 5).withColumn("precision", F.round("precision", 6))


def _cases(spark, d):
    expected = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 0, "clarify").otherwise("auto_release")
    cases = read(spark, d, "labels").select(F.col("doc_id").alias("case_id"), expected.alias("expected"), F.when(F.col("quality") == 1, "multi_turn").otherwise("single").alias("stratum"))
    n = F.col("n_chars")
    outcome = F.when(F.contains(F.lower("text"), F.lit("license")), "reject").when(n > 6000, "clarify").otherwise("auto_release")
    predictions = read(spark, d, "documents").select(
        F.col("doc_id").alias("case_id"), "source", outcome.alias("outcome"), F.lit(None).cast("boolean").alias("correct"), (n % 50 == 0).alias("critical"), (n > 9000).alias("unnecessary"), F.col("lang").isNull().alias("rejected"), (n % 3 == 0).alias("completed"),
        F.when(n < 4000, n / 10.0).alias("low_cost_ms"), F.when(n >= 4000, n / 2.0).alias("upgrade_ms"), n.cast("double").alias("end_to_end_ms"),
    )
    return cases, predictions


@query(f"with {_IN} select user_id, start_us, end_us, round(coalesce(s, 0), 3) as seconds from hi left join j using (user_id, start_us, end_us)")
def scoped_duration(spark, d):
    out = A.scoped_duration(events(spark, d).select("user_id", "us", "event_id", "event_type"), F.col("event_type") == "click", _high(spark, d), keys=K, max_gap_us=DAY)
    return out.withColumn("seconds", F.round("seconds", 3))


@query(f"with {_IN} select user_id, start_us, end_us, round(s / ((end_us - start_us) / 1e6), 6) as share from j where end_us > start_us and s / ((end_us - start_us) / 1e6) > 0.25")
def event_time_share(spark, d):
    out = A.time_share(events(spark, d).select("user_id", "us", "event_id", "event_type"), _high(spark, d), F.col("event_type") == "click", keys=K, max_gap_us=DAY, above=0.25)
    return out.withColumn("share", F.round("share", 6))


@query(f"""with {SPANS}, h as (select * from spans where value > 10 and value <= 30), c as (select user_id, unnest(range(a // {DAY}, (greatest(a, b - 1)) // {DAY} + 1)) as d, a, b from h),
    t as (select user_id, d, sum(least(b, (d + 1) * {DAY}) - greatest(a, d * {DAY})) / 1e6 as seconds from c group by 1, 2) select user_id, date '1970-01-01' + d::int as local_date, round(seconds, 3) as seconds from t where seconds > 3600""")
def daily_band_duration(spark, d):
    out = A.daily_band(events(spark, d).select("user_id", "us", "event_id", "value"), "value", 10.0, 30.0, keys=K, max_gap_us=DAY, least_seconds=3600)
    return out.withColumn("seconds", F.round("seconds", 3))


@query(f"""with {EV}, once as (select user_id, us, arg_max(value, event_id) as v from ev group by 1, 2), n as (select user_id, us, v - 20 as a, lead(v) over w - 20 as b, lead(us) over w as e from once window w as (partition by user_id order by us))
    select user_id, round(sum(case when a > 0 and b > 0 then 1.0 when a <= 0 and b <= 0 then 0.0 else greatest(a, b) / abs(a - b) end * (e - us)) / 1e6, 2) as seconds from n where e - us <= {DAY} group by 1""")
def linear_duration(spark, d):
    return A.linear_duration(events(spark, d), "value", 20.0, keys=K, max_gap_us=DAY).withColumn("seconds", F.round("seconds", 2))


@query(f"""with {EV}, r as (select user_id, us, event_id, avg((event_type = 'error')::int::double) over (partition by user_id order by us range between {2 * DAY} preceding and current row) as ratio from ev),
    m as (select *, ratio > 0.3 and not coalesce(lag(ratio) over w > 0.3, false) as rise, min(case when ratio < 0.2 then us end) over (w rows between 1 following and unbounded following) as back from r window w as (partition by user_id order by us, event_id))
    select distinct user_id, us as start_us, back as end_us from m where rise and back - us <= {4 * DAY}""")
def ratio_recovery(spark, d):
    return A.ratio_recoveries(events(spark, d), F.col("event_type") == "error", keys=K, window_us=2 * DAY, above=0.3, below=0.2, within_us=4 * DAY)


@query(f"with {EV}, {HIGH} select user_id, start_us, round((end_us - start_us) / 1e6, 3) as seconds, 86400.0::double as day_seconds from hi")
def interval_projections(spark, d):
    h = _high(spark, d)
    day = A.local_day_seconds(F.lit("2024-02-03").cast("date"), "Asia/Shanghai")
    return h.select("user_id", "start_us", F.round(A.interval_seconds(), 3).alias("seconds"), day.alias("day_seconds"))


@query("""select 'absolute' as kind, count(*) as n from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-09' union all select 'month_to_date', count(*) from events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-20 12:00:00'
    union all select 'calendar_day', count(*) from events where ts::date = date '2024-01-20' union all select 'rolling', count(*) from events where ts >= timestamp '2024-01-13 12:00:00' and ts < timestamp '2024-01-20 12:00:00'""")
def window_kinds(spark, d):
    e = read(spark, d, "events")
    at = "2024-01-20 12:00:00"
    parts = [A.windowed(e, "absolute", time="ts", start="2024-01-05", end="2024-01-09"), A.windowed(e, "month_to_date", time="ts", anchor=at), A.windowed(e, "calendar_day", time="ts", anchor=at), A.windowed(e, "rolling", time="ts", anchor=at, days=7)]
    out = None
    for kind, p in zip(("absolute", "month_to_date", "calendar_day", "rolling"), parts, strict=True):
        one = p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"with {EV}, {HIGH} select count(*) as n, round(sum(value), 4) as total from ev where exists (select 1 from hi where hi.user_id = ev.user_id and us >= start_us and us < end_us)")
def event_interval_window(spark, d):
    return A.in_events(events(spark, d), _high(spark, d), keys=K).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""with r as (select ts, user_id % 3 as cur, 1 + value / 100 as rate from events where event_type = 'signup' qualify row_number() over (partition by user_id % 3, ts order by event_id) = 1), a as (select event_id, ts, user_id % 3 as cur, value from events where event_type = 'purchase')
    select event_id, round(value * rate, 6) as converted from a asof left join r on a.cur = r.cur and a.ts >= r.ts""")
def currency_conversion(spark, d):
    e = read(spark, d, "events").withColumn("cur", F.col("user_id") % 3)
    w = Window.partitionBy("cur", "ts").orderBy("event_id")
    rates = e.filter("event_type = 'signup'").withColumn("n", F.row_number().over(w)).filter("n = 1").select("cur", "ts", (1 + F.col("value") / 100).alias("rate"))
    paid = e.filter("event_type = 'purchase'").select("event_id", "cur", "ts", "value")
    return A.converted(paid, rates, currency="cur", time="ts", amount="value", rate="rate").select("event_id", F.round("converted", 6).alias("converted"))


@query("""with m as (select o_orderpriority as p, date_trunc('month', o_orderdate)::date as m, sum(o_totalprice) as v from orders group by 1, 2), r as (select *, v / lag(v) over w - 1 as r, 1 - v / max(v) over (partition by p order by m rows unbounded preceding) as f from m window w as (partition by p order by m))
    select p as o_orderpriority, round(max(f), 6) as max_drawdown, round(pow(arg_max(v, m) / arg_min(v, m), 12.0 / count(r)) - 1, 6) as cagr, round(avg(r) / stddev(r) * sqrt(12.0), 6) as sharpe from r group by 1""")
def risk_figures(spark, d):
    m = read(spark, d, "orders").groupBy("o_orderpriority", F.to_date(F.date_trunc("month", "o_orderdate")).alias("m")).agg(F.sum("o_totalprice").alias("v"))
    k = ["o_orderpriority"]
    both = A.drawdown(m, "v", keys=k, order=["m"]).join(A.growth_figures(m, "v", keys=k, order="m", per_year=12.0), k)
    return both.select("o_orderpriority", *[F.round(c, 6).alias(c) for c in ("max_drawdown", "cagr", "sharpe")])


@query("select user_id, a.n as clicks_n, b.total as spent_total from (select user_id, count(*) as n from events where event_type = 'click' group by 1) a full join (select user_id, round(sum(value), 4) as total from events where event_type = 'purchase' group by 1) b using (user_id)")
def composed_outputs(spark, d):
    e = read(spark, d, "events")
    clicks = e.filter("event_type = 'click'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    spent = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"))
    return A.composed({"clicks": clicks, "spent": spent}, ["user_id"], {"clicks": ["n"], "spent": ["total"]})


@query("select event_id from events where not (value > 20 and event_type in ('click', 'view')) and (event_type <> 'error' or value is null) and props is not null")
def negated_filter(spark, d):
    high = P.conjunction([P.Predicate("value", "gt", 20), P.Predicate("event_type", "in", ("click", "view"))])
    either = P.disjunction([[P.Predicate("event_type", "ne", "error")], [P.Predicate("value", "is_null")]])
    return read(spark, d, "events").filter(P.negation(high) & either & P.Predicate("props", "exists").column()).select("event_id")


@query("select doc_id, case when n_chars % 7 = 0 then null else (1990 + doc_id % 36)::int end as year from documents where (1990 + doc_id % 36 between 2000 and 2010) and n_chars % 7 <> 0 and lang = 'en' and doc_id % 5 <> 3")
def year_filtered(spark, d):
    docs = read(spark, d, "documents").withColumn("year", F.when(F.col("n_chars") % 7 != 0, (1990 + F.col("doc_id") % 36).cast("int")))
    kept = docs.filter(P.year_filter(F.col("year"), "between", 2000, 2010) & FI.where({"$and": [{"lang": "en"}]})).withColumn("kind", F.col("doc_id") % 5)
    return kept.filter(FI.where({"kind": {"$ne": 3}})).select("doc_id", "year")


@query("select doc_id from documents where greatest(case when doc_id % 3 = 0 then 1 + doc_id % 50 end, case when doc_id % 3 = 1 then 1 + doc_id % 40 end, 0) between 10 and 20 and lang in ('en', 'de') and (source is null or source <> 'src1')")
def term_filtered(spark, d):
    docs = read(spark, d, "documents").withColumns({"a": F.expr("case when doc_id % 3 = 0 then 1 + doc_id % 50 end"), "b": F.expr("case when doc_id % 3 = 1 then 1 + doc_id % 40 end")})
    return docs.filter(P.any_in_range([F.col("a"), F.col("b")], {"gte": 10, "lte": 20}) & FI.where({"lang": {"$in": ["en", "de"]}, "source": {"$ne": "src1"}})).select("doc_id")


# --- search

_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_FIELD_SQL = {"title": "array_to_string(string_split(text, ' ')[1:10], ' ')", "keywords": "source", "content": "text"}


def _fields_sql(terms: list[str], boosts: dict[str, float]) -> str:
    parts = []
    for f, boost in boosts.items():
        w = _WORDS.format(_FIELD_SQL[f])
        tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) as t{i}" for i, t in enumerate(terms))
        df = ", ".join(f"count(*) filter (t{i} > 0) as d{i}" for i in range(len(terms)))
        score = " + ".join(f"case when t{i} > 0 then ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * dl / mean)) else 0 end" for i in range(len(terms)))
        hit = " or ".join(f"t{i} > 0" for i in range(len(terms)))
        parts.append(f"{f}_w as (select doc_id, {w} as w from documents), {f}_t as (select doc_id, len(w) as dl, {tf} from {f}_w), {f}_s as (select count(*) as n, avg(dl) as mean, {df} from {f}_t), {f}_x as (select doc_id, {boost} * ({score}) as score from {f}_t, {f}_s where {hit})")
    union = " union all ".join(f"select * from {f}_x" for f in boosts)
    return ", ".join(parts) + f", best as (select doc_id, round(max(score), 9) as score from ({union}) group by 1)"


BOOSTS = {"title": 8.0, "keywords": 5.0, "content": 1.0}
QUERY = ["license", "src1", "the"]


@query(f"with {_fields_sql(QUERY, BOOSTS)} select doc_id, round(score, 5) as score from best order by best.score desc, doc_id limit 20")
def bm25_fields(spark, d):
    hits = S.bm25(S.opened(spark, d), QUERY, boosts=BOOSTS).withColumn("score", F.round("score", 9))
    return hits.orderBy(F.desc("score"), "doc_id").limit(20).withColumn("score", F.round("score", 5))


@query(f"{_RRF} select doc_id, row_number() over (order by round(rrf, 12) desc, c, r, doc_id)::int as place from (select doc_id, sum(1 / (60 + rank)) as rrf, arg_min(c, c * 1000 + rank) as c, min(c * 1000 + rank) as r from (select *, 0 as c from a where rank <= 10 union all select *, 1 as c from b where rank <= 10) group by 1) order by place limit 5")
def semantic_retrieval(spark, d):
    """Ten by words and ten by the vectors of the same texts, fused; ties go to the words' channel first."""
    from .queries import _bm25, _by_text

    fused = S.fused([S.top(_bm25(spark, d), "doc_id", 10), S.top(_by_text(spark, d, 20), "doc_id", 10)], "doc_id", 5)
    return fused.select("doc_id", F.row_number().over(Window.orderBy(F.desc(F.round("rrf", 12)), "first", "doc_id")).alias("place"))


_CH = r"""t as (select doc_id, trim(regexp_replace(text, '[ \t\r\n\f\v]+', ' ', 'g')) as t from documents), c as (select doc_id, t, unnest(range(0, greatest(0, ceil((length(t) - 500) / 400.0)::integer) + 1))::integer as chunk_index from t where t <> ''),
    ch as (select doc_id, chunk_index, substring(t, chunk_index * 400 + 1, 500) as chunk from c), h as (select doc_id, chunk_index, len(list_filter(regexp_split_to_array(lower(chunk), '[^\p{L}\p{N}]+'), lambda x: x = 'the')) + len(list_filter(regexp_split_to_array(lower(chunk), '[^\p{L}\p{N}]+'), lambda x: x = 'license')) as hits from ch)"""


@query(f"with {_CH}, r as (select *, max(hits) over (partition by doc_id) > 0 as found, row_number() over (partition by doc_id order by hits desc, chunk_index) as p, row_number() over (partition by doc_id order by chunk_index) as f from h) select doc_id, chunk_index, hits from r where case when found then hits > 0 and p <= 3 else f <= 2 end")
def best_snippets(spark, d):
    return S.snippets(R.fixed_windows(read(spark, d, "documents")), ["the", "license"]).withColumn("hits", F.col("hits").cast("long"))


@query(f"with {_CH} select doc_id, arg_max(chunk_index, hits * 100000 - chunk_index) as chunk_index, max(hits) as score from h group by 1")
def best_chunks(spark, d):
    ch = R.fixed_windows(read(spark, d, "documents"))
    w = T.words(F.col("chunk"))
    hits = sum((F.size(F.filter(w, (lambda t: lambda x: x == t)(t))) for t in ("the", "license")), F.lit(0))
    return S.best_chunk(ch.select("doc_id", "chunk_index", hits.cast("long").alias("score"))).select("doc_id", "chunk_index", "score")


@query(r"""with d as (select doc_id, 'doc' || doc_id || '.pdf' as file, array_to_string([x for x in regexp_split_to_array(lower(coalesce(source, '')), '[^\p{L}\p{N}]+') if x <> ''], ' ') as title from documents)
    select doc_id, ((file = 'src1.pdf')::int * 2 + contains(' doc' || doc_id || ' pdf ', ' src1 ')::int + 5 * contains(' ' || title || ' ', ' src1 ')::int)::int as score from d where contains(' ' || title || ' ', ' src1 ') order by 2 desc, 1 limit 10""")
def find_document(spark, d):
    """Documents that a title phrase names, where files have names of their own."""
    docs = read(spark, d, "documents").withColumn("file", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf")))
    return S.find_document(docs, "src1", file="file", title="source", id_col="doc_id").select("doc_id", "score")


_COS = "q as (select embedding as q from embeddings where vec_id = 0), s as (select vec_id, label, round(list_cosine_similarity(list_transform(embedding, lambda x: x::double), list_transform(q, lambda x: x::double)), 9) as score from embeddings, q where embedding is not null)"


@query(f"with {_COS} select vec_id, round(score, 5) as score from s where label = 3 and score >= 0.05 order by s.score desc, vec_id limit 5")
def memory_vector_search(spark, d):
    v = read(spark, d, "embeddings")
    return S.near_chunks(v.filter("label = 3"), v.filter("vec_id = 0"), 5, id_col="vec_id", least=0.05).select("vec_id", F.round("score", 5).alias("score"))


FACTS = "select conv_id * 100 + turn as id, text as content, round((turn % 10) / 10.0, 1)::double as confidence from conversations where role = 'user' and conv_id < 12"


@query(f"with f as ({FACTS}), k as (select *, contains(lower(content), 'the')::int + contains(lower(content), 'how')::int as hits from f), w as (select id from k where hits > 0 order by hits desc, confidence desc, id limit 5), l as (select id from f order by id desc limit 3) select id from w union all select id from l where (select count(*) from w) = 0")
def memory_recall(spark, d):
    f = read(spark, d, "conversations").filter("role = 'user' and conv_id < 12").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("content"), F.round((F.col("turn") % 10) / 10.0, 1).alias("confidence"))
    return S.recalled(f, ["the", "how"]).select("id")


@query(f"""with {_BM25}, {_CH}, a as (select doc_id, row_number() over (order by score desc, doc_id) as rank from bm qualify rank <= 10),
    r as (select doc_id, chunk, row_number() over (order by hits desc, h.doc_id, h.chunk_index) as rank from h join ch using (doc_id, chunk_index) where hits > 0 qualify rank <= 40), b as (select doc_id, min(rank) as chunk_rank, left(arg_min(chunk, rank), 500) as chunk_text from r group by 1)
    select doc_id, round(coalesce(1 / (60 + rank), 0) + coalesce(1 / (60 + chunk_rank), 0), 9) as rrf, md5(chunk_text) as chunk from a full join b using (doc_id) order by coalesce(1 / (60 + rank), 0) + coalesce(1 / (60 + chunk_rank), 0) desc, doc_id limit 10""")
def fused_documents(spark, d):
    """Ten documents by words and forty chunks by hits, fused; each document with the beginning of its first chunk."""
    from .queries import _bm25

    ch = R.fixed_windows(read(spark, d, "documents"))
    w = T.words(F.col("chunk"))
    hits = sum((F.size(F.filter(w, (lambda t: lambda x: x == t)(t))) for t in ("the", "license")), F.lit(0))
    head = ch.withColumn("hits", hits).filter("hits > 0").orderBy(F.desc("hits"), "doc_id", "chunk_index").limit(40)
    ranks = head.select("doc_id", F.row_number().over(Window.orderBy(F.desc("hits"), "doc_id", "chunk_index")).alias("rank"), F.col("chunk").alias("text"))  # forty rows
    out = S.fused_documents(S.top(_bm25(spark, d), "doc_id", 10), ranks, 10)
    return out.select("doc_id", F.round("rrf", 9).alias("rrf"), F.md5("chunk_text").alias("chunk"))


@query("""with l as (select conv_id, list('- ' || left(coalesce(text, ''), 80) order by turn)[1:5] as l from conversations where turn < 8 group by 1), e as (select conv_id, l, list_transform(range(1, len(l) + 1), lambda i: length(array_to_string(l[1:i], chr(10)))) as n from l)
    select conv_id, md5(array_to_string(list_filter(l, lambda x, i: i = 1 or n[i] // 2 <= 60), chr(10))) as shown from e""")
def memory_injection(spark, d):
    c = read(spark, d, "conversations").filter("turn < 8")
    line = F.concat(F.lit("- "), F.left(F.coalesce("text", F.lit("")), F.lit(80)))
    lists = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda s: s["x"]).alias("l"))
    return lists.select("conv_id", F.md5(S.injected(F.col("l"), budget=60)).alias("shown"))


@query("""with s as (select user_id, event_type, round(count(*) / sum(count(*)) over (partition by user_id), 6) as score from events group by 1, 2), r as (select *, row_number() over w as n, coalesce(lead(score) over w, 0) as next from s window w as (partition by user_id order by score desc, event_type))
    select user_id, case when score >= 0.35 and round(score - next, 9) >= 0.1 then event_type end as chosen, case when score >= 0.35 and round(score - next, 9) >= 0.1 then 'unique_lexical_winner' when score < 0.35 then 'score_below_threshold' else 'margin_below_threshold' end as reason from r where n = 1""")
def lexical_choice(spark, d):
    c = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    s = c.withColumn("score", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("user_id")), 6))
    return S.lexical_choice(s, query="user_id", item="event_type")


# --- evidence and evaluation


@query("select doc_id, lang as language, md5(case when length(text) > 500 then left(text, 500) || '...' else text end) as preview from documents")
def document_cards(spark, d):
    return V.card(read(spark, d, "documents"), {"doc_id": "doc_id", "language": "lang"}, preview=F.md5(V.preview(F.col("text"))))


@query("with h as (select conv_id, turn, contains(lower(coalesce(text, '')), 'license') or contains(lower(coalesce(text, '')), 'data') as hit from conversations) select conv_id, turn from h where hit or conv_id not in (select conv_id from h where hit)")
def evidence_screen(spark, d):
    return V.relevant(read(spark, d, "conversations"), ["license", "data"], query="conv_id", text="text").select("conv_id", "turn")


@query("select doc_id from documents where doc_id % 10 = 0 and doc_id not in (select doc_id from labels where quality = 1)")
def scope_guard(spark, d):
    docs = read(spark, d, "documents").filter("doc_id % 10 = 0").select("doc_id")
    return V.outside_scope(docs, read(spark, d, "labels").filter("quality = 1"), "doc_id")


_EVID = "select conv_id as doc_id, turn, coalesce(text, '') as text, case when turn % 3 = 0 then null else turn end as page, role as file from conversations"


def _evidence(spark, d) -> DataFrame:
    return read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.coalesce("text", F.lit("")).alias("text"), F.expr("case when turn % 3 = 0 then null else turn end").alias("page"), F.col("role").alias("file"))


@query(f"with e as (select *, row_number() over (partition by doc_id order by turn) as n from ({_EVID})) select doc_id, count(*) as n, md5(string_agg('[' || file || case when page is null or page = 0 then '' else '#p' || page end || '] ' || text, chr(10) order by n)) as context from e where n <= 4 group by 1")
def grounded_context(spark, d):
    out = V.by_document(_evidence(spark, d), doc="doc_id", order="turn", text="text", page="page", file="file", most=4)
    return out.select("doc_id", "n", F.md5("context").alias("context"))


@query(f"with e as (select *, row_number() over (partition by doc_id order by turn) as n from ({_EVID})) select doc_id, left(sha1(string_agg(file || coalesce(page::varchar, '') || left(text, 160), '' order by n)), 16) as signature from e where n <= 4 group by 1")
def evidence_signatures(spark, d):
    return V.signature(_evidence(spark, d), key="doc_id", order="turn", parts=["file", "page"], text="text")


@query("with h as (select source as file, min(doc_id) as seen, arg_min(lang, doc_id) as title, arg_min(1990 + doc_id % 30, doc_id) as year from documents where doc_id < 50 and source is not null group by 1) select row_number() over (order by seen, file)::int as number, row_number() over (order by seen, file) || '. 《' || title || '》（' || year || '） [E' || row_number() over (order by seen, file) || ']' as line from h")
def enumeration_lines(spark, d):
    hits = read(spark, d, "documents").filter("doc_id < 50 and source is not null").select("doc_id", "source", "lang", (1990 + F.col("doc_id") % 30).alias("year"))
    return V.enumeration(hits, file="source", title="lang", year="year", order="doc_id")


@query("select event_id, (event_id % 3 <> 2 and 1 + user_id % 4 <= 2 and event_type <> 'error') as ok from events")
def citation_check(spark, d):
    e = read(spark, d, "events")
    answer = F.expr("case when event_id % 3 = 2 then 'no mark' else concat('as said [E', 1 + user_id % 4, '].') end")
    return e.select("event_id", V.citations_hold(answer, F.array(F.lit("a"), F.col("event_type")), F.array(*map(F.lit, ("a", "click", "view", "purchase", "signup")))).alias("ok"))


@query("""with e as (select doc_id as id, lang as expected from documents where doc_id % 7 <> 0), p as (select doc_id as id, quality as predicted from labels) select id, expected, predicted, case when p.id is null then 'missing' when e.id is null then 'unknown' end as fault
    from (select id, min(expected) as expected from e group by 1) e full join (select id, min(predicted) as predicted from p group by 1) p using (id)""")
def aligned_cases(spark, d):
    e = read(spark, d, "documents").filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"), F.col("lang").alias("expected"))
    return V.aligned(e, read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("predicted")), "id")


@query("""with r as (select label, vec_id, row_number() over (partition by label order by vec_id) as rank from embeddings), s as (select label, vec_id, 1 as r from r where rank <= 10), t as (select label, vec_id, 1 as t from embeddings where vec_id % 7 = 0)
    select round(count(*) filter (r = 1 and t = 1) / count(t), 6) as recall, round(count(*) filter (r = 1 and t = 1) / count(r), 6) as precision from s full join t using (label, vec_id)""")
def micro_recall_precision(spark, d):
    v = read(spark, d, "embeddings")
    ranks = v.select("label", "vec_id", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("rank"))
    return V.micro(ranks, v.filter("vec_id % 7 = 0"), query="label", item="vec_id").select(F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


_SUM = "select {c} as corpus, avg((event_type = 'error')::int::double) as error_rate, count(*) filter (event_type = 'error' and value > 49.9) as critical, count(*) filter (event_type = 'view') as clarified, count(*) filter (value < 1) as rejected, count(*) filter (event_type = 'purchase') as completed, count(*) filter (event_type = 'click') as released, quantile_disc(value, 0.95) as p95 from events where user_id % 2 = {m}"


@query(f"with b as ({_SUM.format(c="'x'", m=0)}), c as ({_SUM.format(c="'x'", m=1)}), k as (select b.corpus = c.corpus as same_corpus, c.error_rate <= 0.02 as release_errors_at_most_2pct, c.critical = 0 as no_critical_errors, c.clarified <= b.clarified as clarifications_not_worse, c.rejected <= b.rejected as rejections_not_worse, c.completed >= b.completed as completions_not_worse, c.released > b.released as more_correct_releases, c.p95 <= 1000 as p95_at_most_1000ms from b, c) select *, same_corpus and release_errors_at_most_2pct and no_critical_errors and clarifications_not_worse and rejections_not_worse and completions_not_worse and more_correct_releases and p95_at_most_1000ms as passed from k")
def candidate_gates(spark, d):
    def summary(m: int) -> DataFrame:
        e = read(spark, d, "events").filter(F.col("user_id") % 2 == m)
        n = lambda c: F.count_if(c)
        kind, v = F.col("event_type"), F.col("value")
        return e.agg(F.lit("x").alias("corpus"), F.avg((kind == "error").cast("double")).alias("error_rate"), n((kind == "error") & (v > 49.9)).alias("critical"), n(kind == "view").alias("clarified"), n(v < 1).alias("rejected"), n(kind == "purchase").alias("completed"), n(kind == "click").alias("released"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))

    return V.gates(summary(0), summary(1))


@query("select source, array_to_string(list(lang order by seen, lang), '|') as langs from (select source, lang, min(doc_id) as seen from documents where lang is not null group by 1, 2) group by 1")
def distinct_languages(spark, d):
    out = V.distinct_in_order(read(spark, d, "documents").filter("lang is not null"), by="source", value="lang", place="doc_id")
    return out.select("source", F.array_join("values", "|").alias("langs"))


@query("select user_id, event_id as second from events qualify row_number() over (partition by user_id order by value desc, event_id) = 2")
def ordinal_choice(spark, d):
    e = read(spark, d, "events").withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")))
    return V.ordinal(e, 2, query="user_id", rank="rank").select("user_id", F.col("event_id").alias("second"))


@query("with b as (select user_id, event_type, min(event_id) as best from events group by 1, 2) select user_id, event_type from b qualify row_number() over (partition by user_id order by best, event_type) <= 2")
def discovery_choice(spark, d):
    return V.discovered(read(spark, d, "events"), query="user_id", doc="event_type", rank="event_id")


@query("with o as (select user_id, event_type, count(*) as sightings from events where value > 45 group by 1, 2) select *, count(*) over (partition by user_id) > 1 as conflict from o")
def claim_conflicts(spark, d):
    return V.reconciled(read(spark, d, "events").filter("value > 45"), subject="user_id", value="event_type")


@query("select event_id, sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding) <= 900 and sum(value) over (partition by user_id, ts::date order by ts, event_id rows unbounded preceding) <= 60 as admitted from events")
def token_budgets(spark, d):
    e = read(spark, d, "events").withColumn("day", F.to_date("ts"))
    return V.budgets(e, scopes={"session": (["user_id"], 900.0), "day": (["user_id", "day"], 60.0)}, order=["ts", "event_id"], cost="value").select("event_id", "admitted")


@query("select c_custkey, 60 as next_cursor, true as has_more, false as complete from (select distinct c_custkey from customer order by 1 limit 20 offset 40)")
def inventory_page(spark, d):
    return V.page_of(read(spark, d, "customer"), key="c_custkey", cursor=40, limit=20)


@query("select event_id from events where ts + interval 20 days > timestamp '2024-01-25' order by ts desc, event_id limit 50")
def cache_survivors(spark, d):
    e = read(spark, d, "events").withColumn("expires", F.expr("ts + interval 20 days"))
    return V.evicted(e, F.expr("timestamp_ntz '2024-01-25 00:00:00'"), newest=50, created="ts", expires="expires", key="event_id").select("event_id")


@query("select doc_id from documents where regexp_matches(lower(coalesce(text, '')), 'license') and not regexp_matches(lower(coalesce(source, '')), 'src1')")
def sense_filtered(spark, d):
    senses = {"license": (("src1",), ("license",), "all")}
    return read(spark, d, "documents").filter(V.of_sense(F.col("source"), F.col("text"), "license", senses) & (F.col("source").isNull() | ~F.lower("source").contains("license"))).select("doc_id")


@query("select event_id, event_type, value from events where (user_id, event_type) in (select user_id, event_type from events where value > 49)")
def pinned_objects(spark, d):
    e = read(spark, d, "events")
    pins = e.filter("value > 49").select("user_id", "event_type").distinct()
    return e.join(pins, ["user_id", "event_type"]).select("event_id", "event_type", "value")


@query(f"with {_TEXT}, t as (select doc_id, row_number() over (order by score desc, doc_id)::int as rank from ts where score is not null qualify rank <= 10) select doc_id, rank, lang from t join documents using (doc_id)")
def vector_facts(spark, d):
    """The facts of the documents whose texts' vectors are nearest to what is asked."""
    from .queries import _by_text

    ranks = S.top(_by_text(spark, d, 10), "doc_id", 10)
    return read(spark, d, "documents").select("doc_id", "lang").join(F.broadcast(ranks), "doc_id").select("doc_id", "rank", "lang")


@query("select g.event_type, p.active from (select distinct event_type from events) g left join (select event_type, max(event_id) as active from events where value > 49.5 group by 1) p using (event_type)")
def active_lookup(spark, d):
    e = read(spark, d, "events")
    return e.select("event_type").distinct().join(e.filter("value > 49.5").groupBy("event_type").agg(F.max("event_id").alias("active")), "event_type", "left")


@query("select doc_id, coalesce((1990 + doc_id % 36)::int, 0) as year from documents where n_chars % 7 <> 0 union all select doc_id, 0 from documents where n_chars % 7 = 0 order by year desc, doc_id limit 30")
def year_sorted(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.coalesce(F.when(F.col("n_chars") % 7 != 0, (1990 + F.col("doc_id") % 36).cast("int")), F.lit(0)).alias("year"))
    return docs.orderBy(F.desc("year"), "doc_id").limit(30)


@query("select user_id, arg_max(event_type, (ts, event_id)) as latest from events group by 1")
def latest_event(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))


@query("select a.user_id, a.event_id, b.event_id as conflict_with from (select user_id, event_id, event_type from events where value > 48) a join (select user_id, event_type, min(event_id) as event_id from events where value < 2 group by 1, 2) b on a.user_id = b.user_id and a.event_type = b.event_type")
def conflict_pairs(spark, d):
    e = read(spark, d, "events")
    text = F.concat(F.lit("其实"), F.col("user_id").cast("string"))
    new = e.filter("value > 48").select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), text.alias("content"))
    old = e.filter("value < 2").select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("content"))
    digits = lambda c: F.array(F.regexp_extract(c, "([0-9]+)", 1))
    out = M.conflicting(new, old, digits)
    return out.join(e.select(F.col("event_id").alias("id"), "user_id"), "id").select("user_id", F.col("id").alias("event_id"), "conflict_with")


# --- stores, logs


@query("select (select count(*) from embeddings where embedding is not null) as n, (select count(*) from embeddings where label in (1, 2) and label <> 2) as found")
def vector_store(spark, d):
    store = FI.ReadOnly(read(spark, d, "embeddings").filter("embedding is not null"))
    found = store.get("vec_id", where=FI.where({"$and": [{"label": {"$in": [1, 2]}}, {"label": {"$ne": 2}}]}))
    return spark.createDataFrame([(store.count(), found.count())], "n long, found long")


@query("select event_id, event_type from events order by event_id limit 100")
def bounded_scan(spark, d):
    return FI.scan(spark, f"{d}/events.parquet", ["event_id", "event_type"], size=100)


@query("select ts::date as day, count(*) as n from events where ts::date >= date '2024-01-30' - 14 group by 1")
def log_retention(spark, d):
    e = read(spark, d, "events").withColumn("day", F.to_date("ts"))
    return FI.kept_days(e, today=F.lit("2024-01-30").cast("date"), keep=14).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("with p as (select user_id, min(event_id) as event_id, max((event_id % 97 = 0)::int) as done, count(*) as attempts from events group by 1) select user_id, event_id, attempts from p where done = 0")
def outbox_replay(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 97 == 0).alias("done"))
    return logs.replayed(e, key="user_id", order="event_id", done="done").select("user_id", "event_id", "attempts")


@query("select event_id, len(list_filter(string_split(replace(props, ',', chr(10)), chr(10)), lambda x: x <> '')) as lines, (strlen(props) + 1)::bigint as next_offset from events where props is not null")
def cursor_lines(spark, d):
    """Whole lines of texts of several lines, and where the next read begins; the half line waits."""
    said = F.concat(F.replace("props", F.lit(","), F.lit("\n")), F.lit("\nhalf"))
    e = read(spark, d, "events").filter("props is not null").select("event_id", logs.complete_lines(said, F.lit(0)).alias("r"))
    return e.select("event_id", F.size("r.lines").cast("long").alias("lines"), "r.next_offset")


@query("with h as (select event_id, event_type, (('0x' || left(md5(event_id::varchar), 8))::bigint % 1000000) as h from events) select event_id from h where h < case when event_type = 'error' then 25000 else 250000 end")
def sampled_log(spark, d):
    """A quarter of the rows, and a tenth of that where the queue is nearly full (here: while errors are logged)."""
    return logs.sampled(read(spark, d, "events"), 0.25, fill=F.when(F.col("event_type") == "error", 0.9).otherwise(0.1)).select("event_id")


@query(f"with {EV} select user_id, max(us) as last_us, max(us) < 1706572800000000 - {24 * HOUR} as stale from ev group by 1")
def stale_sessions(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.max("us").alias("last_us")).withColumn("stale", F.col("last_us") < 1706572800000000 - 24 * HOUR)


@query("select source, lang, count(*) as n from documents group by cube (source, lang) having grouping(source) + grouping(lang) <> 1")
def audit_counters(spark, d):
    return read(spark, d, "documents").groupingSets([["source", "lang"], []], "source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("select user_id as id, arg_max(value, event_id) as value, max(event_id) as event_id from events where event_id % 2 = 0 or event_type = 'purchase' group by 1")
def table_upsert(spark, d):
    """A base table and its changes by key; the newest revision of each stays."""
    e = read(spark, d, "events").select(F.col("user_id").alias("id"), "value", "event_id", "event_type")
    base = e.filter("event_id % 2 = 0").drop("event_type")
    return TB.latest_by_key(base, e.filter("event_id % 2 = 1 and event_type = 'purchase'").drop("event_type"), "id", "event_id").select("id", "value", "event_id")


@query("select c_custkey, coalesce(case when c_custkey % 3 = 0 then 'PATCHED' end, c_mktsegment) as c_mktsegment, c_acctbal, case when c_custkey % 3 = 0 then c_nationkey end as note from customer")
def table_patch(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    patch = c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("PATCHED").alias("c_mktsegment"), F.col("c_nationkey").alias("note"))
    return TB.partial_update(c.drop("c_nationkey"), patch, "c_custkey").select("c_custkey", "c_mktsegment", "c_acctbal", "note")


@query("select distinct user_id from events where event_type = 'purchase' and user_id not in (select user_id from events where event_id % 97 = 0)")
def table_insert_ignore(spark, d):
    e = read(spark, d, "events")
    return TB.insert_ignore(e.filter("event_type = 'purchase'").select("user_id"), e.filter("event_id % 97 = 0").select("user_id").distinct(), "user_id")


@query("select 'left' as side, doc_id from documents where doc_id not in (select doc_id from labels) union all select 'right', doc_id from labels where doc_id not in (select doc_id from documents)")
def inventory_reconcile(spark, d):
    return TB.reconcile(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id")


@query("with t as (select user_id, sum(value) as total, count(*) as n from events group by 1) select user_id, round(total / n, 6) as mean from t where n > 60")
def relation_filter(spark, d):
    """A typed plan: aggregate, filter by a computed output, arithmetic."""
    s = P.Step
    steps = [
        s("e", "source", params={"table": "events"}), s("t", "aggregate", ("e",), {"by": ["user_id"], "outputs": {"total": ("sum", "value"), "n": ("count", "value")}}),
        s("f", "relation_filter", ("t", "t2"), {"predicates": [P.Predicate("n", "gt", 60)], "on": ["user_id"]}), s("m", "arithmetic", ("f",), {"op": "div", "left": "total", "right": "n", "as": "mean"}),
    ]
    steps.insert(2, s("t2", "aggregate", ("e",), {"by": ["user_id"], "outputs": {"n": ("count", "value")}}))
    return P.lower(steps, {"events": read(spark, d, "events")})["m"].select("user_id", F.round("mean", 6).alias("mean"))


@query(f"""with {EV} select event_id, round(sum(value) over w, 4) as total, min(value) over w as least, max(value) over w as most, count(*) over w as n, round(coalesce(stddev(value) over w, 0), 5) as deviation, round(median(value) over w, 6) as mid
    from ev window w as (partition by user_id order by us range between {DAY} preceding and current row)""")
def rolling_statistics(spark, d):
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-DAY, 0)
    v = "value"
    return events(spark, d).select(
        "event_id", F.round(F.sum(v).over(w), 4).alias("total"), F.min(v).over(w).alias("least"), F.max(v).over(w).alias("most"), F.count(v).over(w).alias("n"), F.round(F.coalesce(F.stddev(v).over(w), F.lit(0.0)), 5).alias("deviation"),
        F.round(F.percentile(v, 0.5).over(w), 6).alias("mid"),
    )


@query("select user_id, round(count(*) filter (event_type = 'purchase') / nullif(count(*) filter (event_type = 'view'), 0), 6) as conversion_rate, round(sum(value) filter (event_type = 'purchase') / nullif(sum(value), 0), 6) as ratio from events group by 1")
def conversion_rates(spark, d):
    is_ = lambda k: F.col("event_type") == k
    paid = F.sum(F.when(is_("purchase"), F.col("value")))
    return read(spark, d, "events").groupBy("user_id").agg(F.round(F.try_divide(F.count_if(is_("purchase")), F.count_if(is_("view"))), 6).alias("conversion_rate"), F.round(F.try_divide(paid, F.sum("value")), 6).alias("ratio"))


@query("""select g as grain, begins::date as begins, round(avg(value), 6) as mean from (select 'day' as g, date_trunc('day', ts) as begins, value from events union all select 'week', date_trunc('week', ts), value from events
    union all select 'month', date_trunc('month', ts), value from events union all select 'year', date_trunc('year', ts), value from events) group by 1, 2""")
def grain_averages(spark, d):
    """One pass: days first, the coarser grains from their sums."""
    days = read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    each = days.select("s", "n", F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), F.to_date(F.date_trunc(g, "day")).alias("begins")) for g in ("day", "week", "month", "year")])).alias("g"))
    return each.groupBy("g.grain", "g.begins").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("mean"))


@query("""select (select count(*) from documents) = (select count(*) from labels) as same, (select count(*) from documents where doc_id not in (select doc_id from labels where doc_id is not null)) as lacking,
    (select count(*) from labels where doc_id not in (select doc_id from documents where doc_id is not null)) as extra, (select count(*) from embeddings where len(embedding) <> 64) as wrong_size""")
def stage_verification(spark, d):
    """A stage's rows (labels) against what was accepted (documents), both ways, and the size of vectors: one row, made in tasks."""
    ids = lambda t, side: read(spark, d, t).filter("doc_id is not null").select("doc_id", *[F.lit(int(side == x)).alias(x) for x in ("accepted", "staged")])
    per = ids("documents", "accepted").unionByName(ids("labels", "staged")).groupBy("doc_id").agg(F.sum("accepted").alias("accepted"), F.sum("staged").alias("staged"))
    both = per.agg(
        (F.sum("accepted") == F.sum("staged")).alias("same"), F.coalesce(F.sum(F.when(F.col("staged") == 0, F.col("accepted"))), F.lit(0)).alias("lacking"), F.coalesce(F.sum(F.when(F.col("accepted") == 0, F.col("staged"))), F.lit(0)).alias("extra")
    )
    return both.crossJoin(read(spark, d, "embeddings").agg(F.count_if(F.size("embedding") != 64).alias("wrong_size")))  # a row each
