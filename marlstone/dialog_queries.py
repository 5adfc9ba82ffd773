"""Queries on questions, notes and memory, built from the supplied tables, with their DuckDB SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import language as L
from .operators import memory as M
from .queries import query
from .sources.tables import events, read

NOW = 2026
SALT = "a salt for tests"
CLOCK = "timestamp '2024-03-01 00:00:00'"

#: Questions made of each event's numbers; both engines read these expressions.
YEAR_OF = "cast(2000 + user_id % 24 as string)"
LATER = "cast(2003 + user_id % 20 as string)"
ASKED = f"""case event_id % 9 when 0 then concat({YEAR_OF}, '年之后的文献') when 1 then concat({YEAR_OF}, '年以来的论文') when 2 then concat('截至', {YEAR_OF}, '年')
    when 3 then concat({YEAR_OF}, '年以前') when 4 then concat('最近', cast(1 + user_id % 9 as string), '年的综述') when 5 then concat('papers of ', {LATER}, ' to ', {YEAR_OF}) when 6 then concat({YEAR_OF}, '年的论文')
    when 7 then concat('什么是', event_type, '？', '再查一下', {YEAR_OF}, '？好') else concat('先介绍一下', event_type, '，另外列出', {YEAR_OF}, '年的文献') end"""
ONES = "substring('一二三四五六七八九', cast({} as int), 1)"
N = "(user_id % 99 + 1)"
TEN, ONE = f"cast(floor({N} / 10.0) as int)", f"({N} % 10)"
NUMERAL = f"concat(case when {TEN} > 1 then {ONES.format(TEN)} else '' end, case when {TEN} > 0 then '十' else '' end, case when {ONE} > 0 then {ONES.format(f'greatest({ONE}, 1)')} else '' end)"
TITLE = "concat(cast(event_id as string), case event_id % 9 when 0 then ' Abstract' when 1 then ' 引言' when 2 then ' Methodology' when 3 then ' 实验' when 4 then ' Results and discussion' when 5 then ' 结论' when 6 then ' References' when 7 then ' 参考文献' else ' Appendix' end)"
HEAD = f"case event_id % 4 when 0 then concat('arXiv: ', {YEAR_OF}, '.01234') when 1 then concat('Vol. 3, no. 2 (', {YEAR_OF}, ')') when 2 then concat('© ', {YEAR_OF}, ' the authors') else 'no year here' end"
FACTS = """select event_id as id, event_id % 7 as event_key, user_id, ts, case when event_type = 'error' then 'raw' else event_type end as type, value / 100 as confidence, event_id % 3 > 0 as consent,
    case when event_id % 5 = 0 then user_id end as conflict_with, event_id % 2 as retrieval_count from events"""


def _events(spark, d) -> DataFrame:
    return read(spark, d, "events")


def _facts(spark, d) -> DataFrame:
    return spark.sql(FACTS.replace("from events", "from {events}"), events=_events(spark, d))


@query(f"select event_id, {N} as number from events")
def numeral_value(spark, d):
    return _events(spark, d).select("event_id", L.numeral(F.expr(NUMERAL)).alias("number"))


@query(f"""select event_id, y.kind, y.lower, y.lower_open, y.upper, y.upper_open from (select event_id, case event_id % 9
    when 0 then row('after', y, true, null::int, false) when 1 then row('since', y, false, null::int, false) when 2 then row('until', null::int, false, y, false) when 3 then row('before', null::int, false, y, true)
    when 4 then row('recent', {NOW} - n + 1, false, {NOW}, false) when 5 then row('between', least(y, z), false, greatest(y, z), false) when 6 then row('year', y, false, y, false)
    when 8 then row('year', y, false, y, false) end::struct(kind varchar, lower int, lower_open boolean, upper int, upper_open boolean) as y
    from (select event_id, (2000 + user_id % 24)::int as y, (2003 + user_id % 20)::int as z, (1 + user_id % 9)::int as n from events))""")
def question_period(spark, d):
    return _events(spark, d).select("event_id", L.period(F.expr(ASKED), NOW).alias("p")).select("event_id", "p.*")


@query(f"""select event_id, case event_id % 9 when 7 then concat('什么是', event_type) when 8 then concat('先介绍一下', event_type) else {ASKED} end as first,
    case event_id % 9 when 7 then concat('再查一下', {YEAR_OF}) when 8 then concat('另外列出', {YEAR_OF}, '年的文献') else '' end as others from events""")
def question_parts(spark, d):
    q = _events(spark, d).select("event_id", L.questions(F.expr(ASKED)).alias("q"))
    return q.select("event_id", "q.first", F.array_join("q.others", "|").alias("others"))


@query(f"""select event_id, case event_id % 9 when 0 then 'abstract' when 1 then 'introduction' when 2 then 'method' when 3 then 'experiment' when 4 then 'result' when 5 then 'conclusion' when 8 then 'body' else 'references' end as section
    from events""")
def section_types(spark, d):
    return _events(spark, d).select("event_id", L.section_type(F.expr(TITLE)).alias("section"))


@query("select event_id, case when event_id % 4 < 3 then (2000 + user_id % 24)::int end as year from events")
def fallback_year(spark, d):
    return _events(spark, d).select("event_id", L.fallback_year(F.expr(HEAD)).alias("year"))


def _pad(n: int) -> str:
    key = hashlib.sha256(SALT.encode()).digest() if len(SALT) > 64 else SALT.encode()
    return bytes(b ^ n for b in key.ljust(64, b"\0")).hex()


@query(f"select event_id, left(sha256(from_hex('{_pad(0x5C)}') || from_hex(sha256(from_hex('{_pad(0x36)}') || encode(user_id::varchar)))), 16) as user_hash from events")
def user_hash(spark, d):
    return _events(spark, d).select("event_id", L.keyed_hash(F.col("user_id").cast("string"), SALT).alias("user_hash"))


@query()
def memory_cleaning(spark, d):
    """Cleaned messages, the scopes of negations, and what cleaning lost."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "text", L.memory_text(F.col("text")).alias("m"))
    return c.select("conv_id", "turn", "m.text", F.size("m.negations").alias("n_negations"), F.array_join(L.lost(F.col("text"), F.col("m.text")), "|").alias("lost"))


@query("""with recursive e as (select user_id, epoch_us(ts) as us, event_id, event_type as value, row_number() over (partition by user_id order by ts, event_id) as k from events),
    r as (select user_id, us, event_id, k, value, value as held, 0.5::double as held_confidence, []::varchar[] as noted from e where k = 1 union all
    select e.user_id, e.us, e.event_id, e.k, e.value, case when e.value <> held and list_contains(noted, e.value) then e.value else held end,
    case when e.value = held then least(1.0::double, held_confidence + 0.1::double) when list_contains(noted, e.value) then 0.5::double else held_confidence end, case when e.value = held or list_contains(noted, e.value) then noted else list_append(noted, e.value) end
    from r join e on e.user_id = r.user_id and e.k = r.k + 1) select user_id, us, event_id, value, 0.5::double as confidence, held, held_confidence, len(noted) as conflicts from r""")
def profile_merge(spark, d):
    s = events(spark, d).select("user_id", "us", "event_id", F.col("event_type").alias("value"), F.lit(0.5).alias("confidence"))
    return M.merged_profile(s, keys=["user_id"], order=["us", "event_id"])


@query("""select event_id, user_id, (coalesce(sum((event_type = 'purchase')::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) + 1)::bigint as chain from events""")
def task_chain(spark, d):
    return M.task_chains(_events(spark, d), F.col("event_type") == "purchase", keys=["user_id"], order=["ts", "event_id"]).select("event_id", "user_id", "chain")


TURN = "case event_type when 'click' then '继续' when 'error' then '换个话题' when 'view' then '还有呢' else concat('找论文', cast(event_id as string)) end"


@query("""with m as (select *, event_type in ('click', 'view') as goes, sum((event_type = 'error')::int) over (partition by user_id order by ts, event_id) as era from events)
    select event_id, case when goes then last_value(case when event_type in ('purchase', 'signup') then event_type end ignore nulls) over (partition by user_id, era order by ts, event_id)
    when event_type = 'error' then null else event_type end as held from m""")
def context_continuation(spark, d):
    turns = _events(spark, d).select("event_id", "user_id", "ts", F.expr(TURN).alias("text"), F.col("event_type").alias("intent"))
    return M.continued_intent(turns, keys=["user_id"], order=["ts", "event_id"]).select("event_id", "held")


@query(f"with f as ({FACTS}) select id from f where consent and confidence >= 0.7 and type <> 'raw' and conflict_with is null")
def memory_promotion(spark, d):
    return M.promoted(_facts(spark, d), conflicts_block=True).select("id")


@query(f"with f as ({FACTS}) select id, coalesce(retrieval_count = 0 and ts < {CLOCK} - interval 30 days and confidence < 0.7, false) as archived from f")
def memory_archive(spark, d):
    return M.stale(_facts(spark, d), F.expr(CLOCK)).select("id", "archived")


@query("""select user_id as id, arg_max(value, (ts, event_id)) as value, count(*) as revision from events group by user_id having arg_max(event_type, (ts, event_id)) <> 'error'""")
def fact_revisions(spark, d):
    changes = _events(spark, d).select("event_id", F.col("user_id").alias("id"), "ts", "value", (F.col("event_type") == "error").alias("deleted"))
    return M.current_facts(changes.unionByName(changes)).select("id", "value", "revision")


@query(f"select event_id, case when event_type = 'view' and ts < {CLOCK} - interval 600 seconds then 'manual_recovery' when event_type = 'view' then 'running' else event_type end as state from events")
def lease_expiry(spark, d):
    jobs = _events(spark, d).select("event_id", F.when(F.col("event_type") == "view", "running").otherwise(F.col("event_type")).alias("state"), F.col("ts").alias("heartbeat"))
    return M.expired(jobs, F.expr(CLOCK), seconds=600).select("event_id", "state")


@query("""with r as (select *, row_number() over (partition by user_id order by value desc, event_id) as rank from events where event_type <> 'error'),
    v as (select user_id, event_type, count(*) as votes, min(rank) as best from r where rank <= 3 and value >= 20 group by 1, 2)
    select user_id, arg_max(event_type, (votes, -best)) as label, max(votes) as votes from v group by 1""")
def neighbour_vote(spark, d):
    near = _events(spark, d).select("user_id", F.col("event_id").alias("example_id"), F.col("event_type").alias("label"), F.col("value").alias("score"), F.when(F.col("event_type") == "error", "wrong").alias("feedback"))
    return M.voted(near, query="user_id", least=20.0)


@query("""select a.event_id, b.value as as_of from events a asof left join (select * from events where event_type = 'purchase') b on a.user_id = b.user_id and a.ts >= b.ts where a.event_type = 'click'""")
def as_of_value(spark, d):
    e = _events(spark, d).select("event_id", "user_id", "ts", "event_type", "value")
    return M.as_of(e.filter("event_type = 'click'").drop("value"), e.filter("event_type = 'purchase'"), keys=["user_id"], time="ts", value="value").select("event_id", "as_of")


@query("select c_custkey, (select count(*) from customer where c_custkey > 50) > 20 as has_more from customer where c_custkey > 50 order by c_custkey limit 20")
def cursor_page(spark, d):
    return M.page(read(spark, d, "customer").select("c_custkey"), after=50, limit=20, key="c_custkey")


@query("""with t as (select unnest([10.0, 20.0, 30.0, 40.0])::double as threshold), s as (select threshold, avg(((value >= threshold) = (event_type = 'purchase'))::int::double) as accuracy from events, t group by 1)
    select threshold, accuracy from s order by accuracy desc, threshold limit 1""")
def threshold_grid(spark, d):
    return M.best_thresholds(_events(spark, d).select(F.col("value").alias("score"), (F.col("event_type") == "purchase").alias("expected")), [10.0, 20.0, 30.0, 40.0])
