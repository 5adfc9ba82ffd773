"""Queries on questions, time expressions, documents' structure and values, with their DuckDB SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import clauses as CL
from .functions import cleaning as C
from .functions import expressions as X
from .functions import intents as I
from .functions import language as L
from .functions import structure as S
from .functions import timeexpr as TE
from .operators import memory as ME
from .queries import text_vectors_sql, query
from .sources.tables import read

NOW = datetime(2026, 8, 20, 15, 0)

#: Questions made of each event's numbers; both engines read these expressions, and the SQL reads the questions again.
Y, Y2 = "cast(1990 + user_id % 35 as string)", "cast(1995 + user_id % 30 as string)"
SHORT = "lpad(cast(10 + user_id % 15 as string), 2, '0')"
M, D = "cast(1 + user_id % 12 as string)", "cast(1 + user_id % 28 as string)"
N = "cast(1 + user_id % 9 as string)"
ABOUT_YEARS = f"""case event_id % 10 when 0 then concat({Y}, '年之后的论文') when 1 then concat('发表于', {Y}, '年以前') when 2 then concat({Y}, '年以来') when 3 then concat({Y}, ' 年及以前的') when 4 then concat('在', {SHORT}, '年以后')
    when 5 then concat(substring({Y}, 1, 3), '0年代') when 6 then concat({Y}, '年到', {Y2}, '年') when 7 then concat({SHORT}, '年之前的') when 8 then concat({Y}, '年的综述') else '没有说年份' end"""
ABOUT_MONTHS = f"""case event_id % 6 when 0 then concat({Y}, '年', {M}, '月的') when 1 then concat({Y}, '年', {M}, '月之后') when 2 then concat({Y}, '年', {M}, '月份以前') when 3 then concat({Y}, '年', {M}, '月到2031年', {M}, '月') when 4 then concat({Y}, '年', {M}, '月', {D}, '日')
    else concat({Y}, '年', {M}, '月', {D}, '号 ', {M}, '点', '30', '分') end"""
RELATIVE = f"case event_id % 6 when 0 then concat('近', {N}, '个月') when 1 then concat('近', {D}, '天的') when 2 then concat('近', {M}, '小时') when 3 then '上个月发布' when 4 then '去年的' else concat('未来', {N}, '年') end"
ANCHORED = f"case event_id % 6 when 0 then '疫情期间的' when 1 then 'SARS以来' when 2 then concat('金融危机前后', {N}, '年') when 3 then concat({Y}, '年初') when 4 then '贸易战之前' else '入世之后' end"
LISTED = f"case event_id % 3 when 0 then concat('（', {Y}, ',', {Y2}, '、2020）') when 1 then concat({Y}, '年和2030年的', {M}, '月、12月') else concat(case user_id % 3 when 0 then '北京时间' when 1 then '东京时间' else '' end, {Y}, '年', {M}, '月', {D}, '日') end"


def _asked(spark, d, text: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.expr(text).alias("q"))


def _first(spark, d, text: str) -> DataFrame:
    return _asked(spark, d, text).select("event_id", F.get(TE.times(F.col("q"), NOW), F.lit(0)).alias("t")).select("event_id", "t.op", "t.start", "t.end", "t.exact", "t.grain")


@query(rf"""with q as (select event_id, {ABOUT_YEARS} as q from events),
    p as (select *, try_cast(regexp_extract(q, '((?:19|20)\d\d)', 1) as int) as a, try_cast(regexp_extract(q, '(?:19|20)\d\d\s*年?(?:到|至)((?:19|20)\d\d)', 1) as int) as b, 2000 + try_cast(regexp_extract(q, '(?:^|[^0-9])(\d\d)年', 1) as int) as s from q),
    y as (select *, coalesce(a, s) as y from p),
    k as (select *, case when y is null then null when b is not null or regexp_matches(q, '年代') then 'between' when regexp_matches(q, '以前|之前') then 'lte' when regexp_matches(q, '以后|之后|以来') then 'gte' else 'exact' end as op from y)
    select event_id, op, case when op = 'between' then y when op = 'gte' then y + (not regexp_matches(q, '以来'))::int end::varchar as start,
    case when op = 'between' then coalesce(b, y + 9) when op = 'lte' then y - (not regexp_matches(q, '及(以前|之前)'))::int end::varchar as end, case when op = 'exact' then y end::varchar as exact, case when op is not null then 'year' end as grain from k""")
def time_years(spark, d):
    return _first(spark, d, ABOUT_YEARS)


@query(rf"""with q as (select event_id, {ABOUT_MONTHS} as q from events),
    p as (select *, regexp_extract_all(q, '\d+').list_transform(lambda x: x::int) as n from q),
    m as (select *, make_date(n[1], n[2], 1) as m from p)
    select event_id, case when regexp_matches(q, '[日号]') then 'exact' when regexp_matches(q, '之后') then 'gte' when regexp_matches(q, '以前') then 'lte' else 'between' end as op,
    case when regexp_matches(q, '[日号]|以前') then null when regexp_matches(q, '之后') then (m + interval 1 month)::date else m end::varchar as start,
    case when regexp_matches(q, '[日号]|之后') then null when regexp_matches(q, '以前') then (m - interval 1 day)::date when regexp_matches(q, '到') then last_day(make_date(n[3], n[4], 1)) else last_day(m) end::varchar as end,
    case when regexp_matches(q, '点') then strftime(make_timestamp(n[1], n[2], n[3], n[4], n[5], 0), '%Y-%m-%dT%H:%M') when regexp_matches(q, '日') then make_date(n[1], n[2], n[3])::varchar end as exact,
    case when regexp_matches(q, '点') then 'minute' when regexp_matches(q, '日') then 'day' else 'month' end as grain from m""")
def time_months(spark, d):
    return _first(spark, d, ABOUT_MONTHS)


@query(rf"""with q as (select event_id, {RELATIVE} as q from events), p as (select *, try_cast(regexp_extract(q, '\d+') as int) as n, timestamp '2026-08-20 15:00:00' as now from q)
    select event_id, case when q like '近%' then 'gte' when q like '去年%' then 'exact' else 'between' end as op,
    case when q like '近%个月%' then date_trunc('month', now - to_months(n))::date::varchar when q like '近%天%' then (now - to_days(n))::date::varchar when q like '近%小时%' then strftime(now - to_hours(n), '%Y-%m-%dT%H:%M') when q like '上个月%' then '2026-07-01' when q like '未来%' then '2026' end as start,
    case when q like '上个月%' then '2026-07-31' when q like '未来%' then (2025 + n)::varchar end as end, case when q like '去年%' then '2025' end as exact,
    case when q like '%月%' then 'month' when q like '%天%' then 'day' when q like '%小时%' then 'minute' else 'year' end as grain from p""")
def time_relative(spark, d):
    return _first(spark, d, RELATIVE)


@query(rf"""with q as (select event_id, {ANCHORED} as q from events), a as (select * from (values ('疫情', 2020, 2022), ('sars', 2003, 2003), ('金融危机', 2008, 2009), ('贸易战', 2018, 2019), ('入世', 2001, 2001)) as t(name, first, last)),
    p as (select event_id, q, first, last, try_cast(regexp_extract(q, '前后(\d+)年', 1) as int) as n, regexp_extract(q, '^(\d\d\d\d)年初', 1) as y from q left join a on contains(lower(q), name))
    select event_id, case when q like '%之前' then 'lte' when q like '%之后' then 'gte' else 'between' end as op,
    case when y <> '' then y || '-01-01' when n is not null then (first - n) || '-01-01' when q like '%之后' then (last + 1)::varchar when q not like '%之前' then first || '-01-01' end as start,
    case when y <> '' then y || '-03-31' when n is not null then (last + n) || '-12-31' when q like '%以来' then '2026-08-20' when q like '%期间%' then last || '-12-31' when q like '%之前' then (first - 1)::varchar end as end, null::varchar as exact,
    case when y <> '' then 'month' when q like '%以来' then 'day' else 'year' end as grain from p""")
def time_anchors(spark, d):
    return _first(spark, d, ANCHORED)


@query(rf"""with q as (select event_id, {LISTED} as q from events), p as (select *, regexp_extract_all(q, '\d+') as n from q)
    select event_id, case when q like '（%' then array_to_string(n, '|') when q like '%和%' then array_to_string(list_distinct([n[1] || '-' || lpad(n[3], 2, '0') || '-01', n[1] || '-12-01', n[2] || '-' || lpad(n[3], 2, '0') || '-01', n[2] || '-12-01']).list_sort(), '|') end as listed,
    case when q like '北京%' then 'Asia/Shanghai' when q like '东京%' then 'Asia/Tokyo' else '' end as zone from p""")
def time_lists(spark, d):
    q = _asked(spark, d, LISTED).withColumns({"y": TE.year_list(F.col("q")), "m": TE.month_matrix(F.col("q")), "t": TE.times(F.col("q"), NOW)})
    years, months = F.transform("y", lambda s: s["exact"]), F.array_sort(F.array_distinct(F.transform("m", lambda s: s["start"])))
    listed = F.when(F.size("y") > 0, F.array_join(years, "|")).when(F.size("m") > 0, F.array_join(months, "|"))
    return q.select("event_id", listed.alias("listed"), F.coalesce(F.get("t", F.lit(0))["zone"], F.lit("")).alias("zone"))


TALK = f"concat(case event_id % 4 when 0 then '我想了解，' when 1 then '帮我请问' when 2 then '嗯嗯' else '' end, case user_id % 3 when 0 then '２０２３年啥论文！！' when 1 then '咋样？？我需要' else 'Ｇan 瞅瞅' end, {Y}, '年。帮我找一下', case event_id % 5 when 0 then '二零一九年三月' when 1 then '十二月的' when 2 then '二十四号' else '' end)"
_FULL = "translate({}, '０１２３４５６７８９Ｇ！？，', '0123456789G!?,')"


@query(rf"""with q as (select event_id, {TALK} as q from events), a as (select event_id, translate(q, '０１２３４５６７８９Ｇ！？，', '0123456789G!?,') as q from q), b as (select event_id, replace(replace(q, '嗯嗯', ''), '嗯', '') as q from a),
    c as (select event_id, replace(replace(replace(q, '咋样', '如何'), '瞅瞅', '看看'), '啥', '什么') as q from b),
    s as (select event_id, regexp_replace(q, '(^|[？?。！!])(我想了解|我需要|帮我找一下|请问|帮我)*[，,;；、\s]*', '\1', 'g') as q from c),
    x as (select event_id, regexp_replace(regexp_replace(q, '!+', '!', 'g'), '\?+', '?', 'g') as q from s)
    select event_id, replace(replace(replace(replace(q, '二零一九年', '2019年'), '三月', '3月'), '十二月', '12月'), '二十四号', '24号') as cleaned from x""")
def query_cleaning(spark, d):
    return C.cleaned(_asked(spark, d, TALK), "q").select("event_id", "cleaned")


@query(rf"select event_id, len(list_distinct(list_filter([q0, q1, q2], lambda x: x <> ''))) as parts, trim(regexp_replace(regexp_replace(raw, '[^一-龥a-zA-Z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) as ranked from (select event_id, props as raw, split_part(event_type, '_', 1) as q0, '' as q1, '' as q2 from events)")
def ranked_query_text(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", F.lit(1).cast("long").alias("parts"), C.ranked_query(C.safe_text(F.col("props"))).alias("ranked"))


@query(r"""select conv_id, turn, regexp_replace(regexp_replace(text, '(?i)\b(?:authorization|api[_-]?key|access[_-]?token|credential)\b\s*[:=]\s*\S+', '[REDACTED]', 'g'), '\bsk-[A-Za-z0-9_-]{12,}\b', '[REDACTED]', 'g') = text as clean,
    case when regexp_matches(text, '[一-鿿]') then 'zh' else 'en' end as lang, levenshtein(role, 'assist') as edits from conversations where text is not null""")
def message_screens(spark, d):
    c = read(spark, d, "conversations").filter("text is not null")
    edits = F.levenshtein("role", F.lit("assist")).cast("long")
    return c.select("conv_id", "turn", (C.redacted(F.col("text")) == F.col("text")).alias("clean"), C.title_language(F.col("text")).alias("lang"), edits.alias("edits"))


@query()
def message_entities(spark, d):
    """Entities, references back and completed questions; Java and RE2 differ in the classes used, so fixtures test this."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    c = read(spark, d, "conversations").withColumn("before", F.collect_list(F.coalesce("text", F.lit(""))).over(w))
    return c.select("conv_id", "turn", F.array_join(C.entities(F.col("text")), "|").alias("entities"), C.refers_back(F.col("text"), F.col("before")).alias("refers"), F.md5(C.completed(F.col("text"), F.col("before"))).alias("completed"))


@query("""select event_id, case when concat(event_type, '论文') like '%' then (select max(s) from (select unnest(['神经网络', '论文', '模型']) as s) where contains(case event_id % 3 when 0 then '神经网络的论文' when 1 then '论文写什么' else '方法' end, s) and contains('关于神经网络的论文', s) and length(s) = (case event_id % 3 when 0 then 4 when 1 then 2 else 9 end)) end as topic from events""")
def shared_topics(spark, d):
    e = read(spark, d, "events").select("event_id", F.expr("case event_id % 3 when 0 then '神经网络的论文' when 1 then '论文写什么' else '方法' end").alias("a"))
    return e.select("event_id", C.shared_topic(F.col("a"), F.lit("关于神经网络的论文")).alias("topic"))


REFS = "concat(text, case doc_id % 3 when 0 then '\nReferences ' when 1 then ' 参考文献' else ' ' end, text)"


@query(f"select doc_id, md5(regexp_extract(t, '(?is)(?:参考文献|references)\\s*(.{{1,1000}}.{{0,1000}}.{{0,500}})', 1)) as refs from (select doc_id, {REFS} as t from documents where text is not null)".replace("\\\\", "\\").replace("'\nRef", "chr(10) || 'Ref"))
def reference_sections(spark, d):
    return read(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(C.reference_section(F.expr(REFS))).alias("refs"))


@query("""with p as (select doc_id, list_transform(range(0, greatest(ceil(length(text) / 150.0)::int, 1)), lambda i: substring(text, (i * 150 + 1)::int, 150)) as p from documents where text is not null)
    select doc_id, md5(array_to_string(list_transform(list_filter(p, lambda x: regexp_matches(x, '(?i)(license|token)'))[1:3], lambda x: regexp_replace(x, '(?i)(license|token)', '**\\1**', 'g')), '|')) as shown from p""".replace("\\\\", "\\"))
def highlighted(spark, d):
    return read(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(F.array_join(C.highlights(F.col("text"), ["license", "token"]), "|")).alias("shown"))


# --- documents' structure

MARKDOWN = "concat(case doc_id % 3 when 0 then '# Abstract\n' when 1 then '## 3 Method\n\n' else '' end, replace(text, '. ', '.\n\n'), '\n# References\nA. B. 2020.')"


#: Greedy packing as a recursion: ``e`` holds parts numbered by k within a group g; r the pack that each part is in.
_PACK = """{r} as (select g, k, 0 as c, length(part) as n from {e} where k = 1 union all select e.g, e.k, case when r.n + {glue} + length(e.part) <= 1600 then r.c else r.c + 1 end,
    case when r.n + {glue} + length(e.part) <= 1600 then r.n + {glue} + length(e.part) else length(e.part) end from {r} r join {e} e on e.g = r.g and e.k = r.k + 1)"""


@query(rf"""with recursive m as (select doc_id, {MARKDOWN} as m from documents where text is not null), l as (select doc_id, unnest(string_split(m, chr(10))) as line, unnest(range(1, len(string_split(m, chr(10))) + 1)) as i from m),
    h as (select *, regexp_matches(line, '^#{{1,6}}\s+') as heading, sum(regexp_matches(line, '^#{{1,6}}\s+')::int) over (partition by doc_id order by i) as sec from l),
    b as (select doc_id, sec, coalesce(max(case when heading then trim(regexp_replace(line, '^#{{1,6}}\s+', '')) end), '') as title, coalesce(string_agg(line, chr(10) order by i) filter (not heading), '') as body from h group by 1, 2),
    p as (select doc_id, sec, title, regexp_replace(unnest(regexp_split_to_array(body, '\n\s*\n')), '^\s+|\s+$', '', 'g') as par, unnest(range(1, len(regexp_split_to_array(body, '\n\s*\n')) + 1)) as j from b),
    s as (select doc_id, sec, j, unnest(string_split(regexp_replace(par, '([。！？.!?；;])\s*', '\1' || chr(1), 'g'), chr(1))) as sen, unnest(range(1, len(string_split(regexp_replace(par, '([。！？.!?；;])\s*', '\1' || chr(1), 'g'), chr(1))) + 1)) as x from p where length(par) > 1600),
    t as (select doc_id, sec, j, x, regexp_replace(sen, '^\s+|\s+$', '', 'g') as sen from s), u as (select doc_id, sec, j, x, sen, unnest(range(0, ceil(length(sen) / 1600.0)::int)) as y from t where sen <> ''),
    e1 as (select (doc_id, sec, j) as g, substring(sen, (y * 1600 + 1)::int, 1600) as part, row_number() over (partition by doc_id, sec, j order by x, y) as k from u), {_PACK.format(r="r1", e="e1", glue=0)},
    w as (select e1.g[1] as doc_id, e1.g[2] as sec, e1.g[3] as j, c, string_agg(part, '' order by k) as part from r1 join e1 using (g, k) group by all union all select doc_id, sec, j, 0, par from p where length(par) between 1 and 1600),
    e2 as (select (doc_id, sec) as g, part, row_number() over (partition by doc_id, sec order by j, c) as k from w), {_PACK.format(r="r2", e="e2", glue=2)},
    z as (select e2.g[1] as doc_id, e2.g[2] as sec, c, string_agg(part, chr(10) || chr(10) order by k) as chunk from r2 join e2 using (g, k) group by all),
    y as (select z.doc_id, (row_number() over (partition by z.doc_id order by z.sec, c) - 1)::int as chunk_index, title as section_title, case when regexp_matches(lower(title), '摘要|abstract') then 'abstract' when regexp_matches(lower(title), 'method') then 'method' when regexp_matches(lower(title), 'references') then 'references' else 'body' end as section_type, chunk from z join b on z.doc_id = b.doc_id and z.sec = b.sec)
    select *, section_type = 'abstract' as is_abstract, section_type = 'references' as is_reference from y""".replace("\\\\", "\\"))
def chunk_structural(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.expr(MARKDOWN).alias("text"))
    return S.structural_chunks(docs)


#: Pages as they are, with lost characters, and empty.
DAMAGED = "case page_id % 5 when 1 then replace(html, 'the', '�') when 2 then '' when 3 then replace(html, 'zz', '�') else html end"


@query(f"""with p as (select page_id, coalesce({DAMAGED}, '') as t, page_id % 4 = 3 as gap from pages), m as (select *, trim(t) = '' as none, (length(t) - length(replace(t, '�', ''))) / greatest(length(t), 1) as bad, case when trim(t) = '' then 1.0 when gap then 1 / 3 else 0 end as empty from p),
    s as (select *, greatest(0, 1 - (none::int * 0.7 + least(0.5, empty * 0.5) + least(0.4, bad * 20)))::double as x from m)
    select page_id, case when round_even(x, 3) >= 0.8 then 'pass' when round_even(x, 3) >= 0.55 then 'review' else 'fail' end as status,
    array_to_string(list_filter([case when none then 'no_text' end, case when empty > 0.1 then 'too_many_empty_pages' end, case when bad > 0.01 then 'encoding_corruption' end], lambda y: y is not null), '|') as reasons, round_even(x, 3) as score from s""")
def document_quality(spark, d):
    """All pages; a fifth lost characters, a fifth is empty, a quarter has an empty page inside."""
    p = read(spark, d, "pages").select("page_id", F.coalesce(F.expr(DAMAGED), F.lit("")).alias("t"))
    r = p.select("page_id", S.quality_report(F.col("t"), F.expr("case when page_id % 4 = 3 then array(t, '', t) else array(t) end"), F.array("t")).alias("r"))
    return r.select("page_id", "r.status", F.array_join("r.reasons", "|").alias("reasons"), "r.score")


@query(r"""with t as (select doc_id, text, greatest(ceil(length(text) / 80.0)::int, 1) as n, (length(text) // 2)::int as half from documents where text is not null),
    d as (select doc_id, lower(regexp_replace(substring(text, half + 1, 200), '[^\p{L}\p{N}_]+', '', 'g')) as own, list_transform(range(0, n), lambda i: lower(regexp_replace(substring(text, (i * 80 + 1)::int, 80), '[^\p{L}\p{N}_]+', '', 'g'))) as b from t),
    m as (select doc_id, list_filter(range(1, len(b) + 1), lambda i: length(b[i]) >= 12 and (contains(own, left(b[i], 80)) or contains(b[i], left(own, 80)))) as p from d) select doc_id, list_min(p)::int as page_start, list_max(p)::int as page_end from m""")
def chunk_pages(spark, d):
    """Pages of the 200 characters after the middle of each text, where each 80 characters of the text are a page's block."""
    docs = read(spark, d, "documents").filter("text is not null")
    blocks = F.expr("transform(sequence(0, greatest(cast(ceil(length(text) / 80.0) as int), 1) - 1), i -> named_struct('text', substring(text, i * 80 + 1, 80), 'page_start', i + 1, 'page_end', i + 1))")
    own = F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1, 200)")
    return docs.select("doc_id", S.pages_of(own, blocks).alias("p")).select("doc_id", "p.page_start", "p.page_end")


STEM = "case doc_id % 4 when 0 then concat('1-s2.0-S09521976', lpad(cast(doc_id % 26 as string), 2, '0'), '001290-main') when 1 then concat('Survey ', cast(1990 + doc_id % 30 as string)) when 2 then concat(lpad(cast(doc_id % 24 as string), 2, '0'), '10.02040v2') else concat('notes_', cast(doc_id as string)) end"


@query(rf"""with s as (select doc_id, {STEM} as stem, coalesce(text, '') as text from documents),
    h as (select *, regexp_replace(regexp_replace(translate(stem || chr(10) || left(text, 6000), '０１２３４５６７８９', '0123456789'), '(\d)[ 　]+(\d)', '\1\2', 'g'), '(\d)[ 　]+(\d)', '\1\2', 'g') as h from s),
    y as (select *, list_filter(regexp_extract_all(stem, '\d+'), lambda x: length(x) = 4 and left(x, 2) in ('19', '20')) as own, list_filter(list_transform(list_filter(regexp_extract_all(h, '\d+'), lambda x: length(x) = 4), lambda x: x::int), lambda x: x between 1900 and 2026) as said from h)
    select doc_id, case when regexp_matches(stem, '^1-s2') then 2000 + regexp_extract(stem, '^1-s2\.0-S\d{{8}}(\d\d)', 1)::int when len(own) > 0 then own[1]::int when regexp_matches(stem, '^\d{{4}}\.') then 2000 + left(stem, 2)::int else said[1] end::int as publication_year from y""")
def bibliographic_years(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.expr(STEM).alias("stem"), "text")
    return S.bibliography(docs).select("doc_id", "publication_year")


@query()
def bibliography(spark, d):
    """Titles by scored headings; tests hold them against stated cases."""
    docs = read(spark, d, "documents").select("doc_id", F.expr(STEM).alias("stem"), F.expr(MARKDOWN).alias("text"))
    return S.bibliography(docs)


# --- intents and values

SAID = f"case event_id % 9 when 0 then '销售额同比增长率' when 1 then '列出所有论文' when 2 then concat({Y}, '年关于贝叶斯的方法') when 3 then concat({Y}, '年有几篇') when 4 then '写一个代码' when 5 then '两篇论文的区别' when 6 then '这篇的作者' when 7 then '？？' else '随便聊聊' end"


@query(f"""with q as (select event_id, {SAID} as q from events) select event_id, case when q = '？？' then 'invalid' when regexp_matches(q, '写.{{0,8}}代码') then 'non_kb' when regexp_matches(q, '增长率') then 'numerical_calculation' when regexp_matches(q, '区别') and regexp_matches(q, '论文') then 'cross_doc_synthesis'
    when regexp_matches(q, '这篇') and regexp_matches(q, '作者') then 'metadata_query' when regexp_matches(q, '[0-9]{{4}}年') and regexp_matches(q, '关于|方法') then 'hybrid' when regexp_matches(q, '[0-9]{{4}}年') and regexp_matches(q, '几篇') then 'inventory' when regexp_matches(q, '列出|所有') then 'inventory' end as intent,
    case when q = '？？' or regexp_matches(q, '代码') then 1.0 when regexp_matches(q, '增长率|作者') then 0.99 when regexp_matches(q, '区别|[0-9]{{4}}年') then 0.98 when regexp_matches(q, '列出') then 0.94 else 0.0 end::double as confidence from q""")
def question_intents(spark, d):
    q = _asked(spark, d, SAID)
    return q.select("event_id", I.intent(F.col("q"), {"has_time": F.col("q").rlike("[0-9]{4}年")}).alias("i")).select("event_id", "i.intent", "i.confidence")


@query("""select event_id, case when value > 48 then 'rule' when event_type = 'view' then 'context' when value >= 47.5 then 'near' when value >= 42.5 and value / 50 >= 0.85 and event_type = 'click' then 'model' when value >= 42.5 then 'near_low' else 'fallback' end as source
    from (select event_id, event_type, value from events)""")
def cascade_route(spark, d):
    e = read(spark, d, "events")
    v = F.col("value") / 50
    j = lambda ok, x, name: F.struct(F.when(ok, name).alias("intent"), x.alias("confidence"))
    r = I.routed(j(F.col("value") > 48, F.lit(0.97), "a"), j(F.col("event_type") == "view", F.lit(0.7), "b"), j(F.col("value") >= 42.5, v, "c"), j(F.col("event_type") == "click", v, "c"))
    return e.select("event_id", r["source"].alias("source"))


DOMAINS = [("计算|[0-9]+\\s*[-+*/]\\s*[0-9]+", "utility", 1.0), ("帮助", "help", 0.99), ("论文|文献", "document", 0.95), ("你好|聊", "chat", 0.98)]


@query(f"with q as (select event_id, {SAID} as q from events) select event_id, case when regexp_matches(q, '论文|文献') then 'document' when regexp_matches(q, '聊') then 'chat' else 'clarify_domain' end as domain from q")
def domain_route(spark, d):
    return _asked(spark, d, SAID).select("event_id", I.domain(F.col("q"), DOMAINS)["domain"].alias("domain"))


@query("with q as (select event_id, case event_id % 4 when 0 then '最近一段时间的' when 1 then '最近' when 2 then '前阵子看' else '没有' end as q from events) select event_id, case when q like '%最近一段时间%' then 'quarter' when q like '%最近%' then 'month' when q like '%前阵子%' then 'month' end as window from q")
def vague_windows(spark, d):
    q = _asked(spark, d, "case event_id % 4 when 0 then '最近一段时间的' when 1 then '最近' when 2 then '前阵子看' else '没有' end")
    return q.select("event_id", I.window_of(F.col("q"), {"最近": "month", "最近一段时间": "quarter", "前阵子": "month"}).alias("window"))


@query("select event_id, ((user_id + 3) * 2 - event_id % 7)::varchar as value, case when event_id % 5 = 0 then null else (user_id * 4 // 8)::varchar end as floored from events")
def exact_arithmetic(spark, d):
    e = read(spark, d, "events")
    one = F.format_string("(%d + 3) * 2 - %d", F.col("user_id"), F.col("event_id") % 7)
    two = F.when(F.col("event_id") % 5 == 0, F.format_string("%d / 0", F.col("user_id"))).otherwise(F.format_string("%d*4//2**3", F.col("user_id")))
    return e.select("event_id", X.exact(one)["value"].alias("value"), X.exact(two)["value"].alias("floored"))


@query("""select event_id, left(sha256(event_id || chr(0) || event_type), 24) as id, left(sha1(props), 12) as short, '{"a":' || event_id || ',"b":"' || event_type || '","c":null}' as body, case when event_id % 3 = 0 then null else user_id end::bigint as parsed from events""")
def value_keys(spark, d):
    e = read(spark, d, "events")
    text = F.expr("case event_id % 3 when 0 then 'no json' when 1 then concat('```json\n{\"u\": ', user_id, '}\n```') else concat('{\"u\": ', user_id, '}') end")
    return e.select("event_id", X.short_id(F.col("event_id"), F.col("event_type")).alias("id"), X.short_sha1(F.col("props")).alias("short"), X.canonical_json({"c": F.lit(None).cast("string"), "a": F.col("event_id"), "b": F.col("event_type")}).alias("body"), X.lenient_json(text, "u long")["u"].alias("parsed"))


@query("with n as (select vec_id, embedding as e, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as n from embeddings) select vec_id, round(e[1] / n, 6) as first, round(list_sum(list_transform(e, lambda x: x / n)), 4) as total, list_contains(list_transform(e, lambda x: x > 1), true) as long from n")
def unit_vectors(spark, d):
    u = read(spark, d, "embeddings").withColumn("u", X.unit_vector(F.col("embedding")))
    return u.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.exists("embedding", lambda x: x > 1).alias("long"))


@query("select event_id, user_id as who_id, event_type as what_kind_name from events")
def nested_columns(spark, d):
    e = read(spark, d, "events").select("event_id", F.struct(F.col("user_id").alias("id")).alias("who"), F.struct(F.struct(F.col("event_type").alias("name")).alias("kind")).alias("what"))
    flat = X.flattened(e)
    return flat.toDF(*[c.replace(".", "_") for c in flat.columns])


COMPOUND = f"case event_id % 5 when 0 then concat({Y}, '年的论文有哪些，还有储层网络的呢') when 1 then concat('储层网络的综述，另外列出', {Y}, '年的文献') when 2 then '不要综述，只要论文' when 3 then concat('帮我看看', {Y}, '年的论文，讲降维的') else '只有一句' end"


@query(f"""with q as (select event_id, {COMPOUND} as q from events) select event_id, case when q like '%还有%' or q like '%另外%' then 2 else 1 end as clauses,
    case when q like '%还有%' then regexp_extract(q, '^(.*哪些)') when q like '%另外%' then regexp_extract(q, '^(.*综述)') when q like '帮我%' then replace(regexp_replace(q, '^帮我看看', ''), '，', '') else replace(q, '，', '') end as first from q""")
def question_clauses(spark, d):
    q = _asked(spark, d, COMPOUND).withColumn("c", CL.clause_list(F.col("q")))
    return q.select("event_id", F.size("c").alias("clauses"), F.get("c", F.lit(0))["text"].alias("first"))


ROLES = "case event_id % 6 when 0 then '今天是周五' when 1 then '只要中文的' when 2 then '按年份列出' when 3 then '疫情期间' when 4 then '论文有哪些' else '每年第3个工作日发布' end"


@query(f"""with q as (select event_id, user_id, {ROLES} as q from events), r as (select *, case when q like '今天是%' or q like '%期间' then 'time' when q like '只要%' or q like '每年%' then 'constraint' when q like '按%' then 'output' else 'main' end as role from q),
    g as (select *, sum(coalesce(role = 'time' and prev = 'main', false)::int) over (partition by user_id order by event_id) as grp from (select *, last_value(case when role in ('main', 'time') then role end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as prev from r))
    select event_id, role, case when role = 'main' then (select count(distinct h.q) from g h where h.user_id = g.user_id and h.grp = g.grp and h.event_id <= g.event_id and h.role = 'time') end::int as times from g""")
def clause_roles(spark, d):
    q = read(spark, d, "events").select("event_id", "user_id", F.expr(ROLES).alias("q"))
    r = q.withColumn("role", CL.role(F.col("q"), F.lit(False), F.lit(False)))
    out = CL.inherited(r.withColumn("time", F.when(F.col("role") == "time", F.col("q"))), query="user_id", place="event_id")
    return out.select("event_id", "role", F.when(F.col("role") == "main", F.size("times")).alias("times"))


_SAID = "case when event_type = 'error' then '疫情期间' when event_id % 3 = 0 then concat('the ', event_type, ' of the last week') else concat('the ', event_type, ' of this week') end"


@query(f"""with e as (select user_id, event_id, {_SAID} as t from events), k as (select distinct t from e), {text_vectors_sql('tv', 'k', 't', 't')}, n as (select t, sqrt(sum(s * s)) as n from tv group by 1),
    c as (select a.t, b.t as u, round(coalesce(sum(x.s * y.s), 0) / (any_value(a.n) * any_value(b.n)), 9) as sim from n a cross join n b left join tv x on x.t = a.t left join tv y on y.t = b.t and y.d = x.d group by 1, 2),
    l as (select *, lag(t) over (partition by user_id order by event_id) as u from e), p as (select l.*, l.u is null or l.t = '疫情期间' or c.sim < 0.5 as cut from l left join c on c.t = l.t and c.u = l.u),
    r as (select *, sum(cut::int) over (partition by user_id order by event_id rows unbounded preceding) as run from p) select user_id, min(event_id) as event_id, string_agg(t, '，' order by event_id) as text from r group by user_id, run""")
def clauses_rejoined(spark, d):
    """Clauses joined where the vectors of their own texts are alike."""
    e = read(spark, d, "events").select("user_id", "event_id", F.expr(_SAID).alias("text"), F.lit("mark").alias("edge"))
    return CL.rejoined(CL.with_similarity(e, query="user_id", place="event_id"), query="user_id", place="event_id")


@query("""select event_type as text, arg_max(user_id::varchar, (value, user_id::varchar)) as intent from events where value >= 40 and event_id % 3 = 0 group by 1 having event_type not in ('view')""")
def feedback_sync(spark, d):
    r = read(spark, d, "events").select(F.col("event_type").alias("text"), F.col("user_id").cast("string").alias("intent"), (F.col("value")).alias("confidence"), F.when(F.col("event_id") % 3 == 0, "correct").alias("feedback"))
    return ME.synced(r, spark.createDataFrame([("view",)], "text string"), least=40.0)


@query()
def recall_queries(spark, d):
    """Slices of documents by hash; tests hold their bounds."""
    from .functions import text as X

    return ME.sampled_queries(read(spark, d, "documents").select("doc_id", "text"), X.clean_embed, doc="doc_id")


@query("""with l as (select user_id, event_type, value, ts, event_id from events where user_id = 7), f as (select event_type as id, arg_max(value, (ts, event_id)) as value, count(*) as revision from l group by 1 having arg_max(event_id % 5, (ts, event_id)) <> 0)
    select id, value, revision from f""")
def memory_admin(spark, d):
    c = read(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("id"), F.lit("fact").alias("type"), "value", (F.col("value") / 50).alias("confidence"), F.lit(0).alias("retrieval_count"), "ts", (F.col("event_id") % 5 == 0).alias("deleted"))
    return ME.administered(c, "export", user=7).select("id", "value", "revision")
