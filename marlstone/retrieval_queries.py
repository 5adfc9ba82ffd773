"""Queries of vector, phrase, name and set search and of streams over the supplied tables, with their SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import clusters, mentions, neighbours, setjoin, vectors
from .operators import memory as ME
from .operators import search as S
from .queries import DAY, EV, SQL, query, text_table, text_vectors_sql
from .sources.growing import growing_lines
from .sources.shared import deleted, kept, table_path
from .sources.tables import read
from .streaming import logs, sessions, state

_PAIRS = """v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    p as (select a.vec_id as query_id, b.vec_id as example_id, b.label, round(list_cosine_similarity(a.e, b.e), 9) as score from v a join v b on a.vec_id <> b.vec_id),
    r as (select *, row_number() over (partition by query_id order by score desc, example_id)::int as rank from p)"""


# --- nearest neighbours


@query(f"with {_PAIRS} select query_id, example_id, round(score, 6) as score from r where rank = 1")
def knn_join_1(spark, d):
    v = read(spark, d, "embeddings")
    return neighbours.knn_join(v, v, 1).select("query_id", "example_id", F.round("score", 6).alias("score"))


@query(f"with {_PAIRS} select query_id, rank, example_id, round(score, 6) as score from r where rank <= 3")
def knn_join_3(spark, d):
    v = read(spark, d, "embeddings")
    return neighbours.knn_join(v, v, 3).select("query_id", "rank", "example_id", F.round("score", 6).alias("score"))


@query(f"""with {_PAIRS}, n as (select * from r where rank <= 3 and score >= 0.3), g as (select query_id, label, count(*) as votes, min(rank) as best from n group by 1, 2)
    select query_id, arg_max(label, votes * 10 - best) as label, max(votes) as votes from g group by 1""")
def intent_votes(spark, d):
    """Each row's label by the vote of its three nearest other rows that score 0.3 or more."""
    v = read(spark, d, "embeddings")
    near = neighbours.knn_join(v, v, 3).drop("rank").join(v.select(F.col("vec_id").alias("example_id"), "label"), "example_id").withColumn("feedback", F.lit(None).cast("string"))
    return ME.voted(near, query="query_id", k=3, least=0.3)


#: Lists probed: measured on a bounded sample of the queries, for this share of the true neighbours.
PROBE_RECALL = 0.95


@query()
def indexed_vector_search(spark, d):
    """Ten nearest rows of each row whose id is divisible by 100, from the lists that reach a recall of 0.95 on a sample; approximate, so tests measure it against all pairs."""
    path = f"{d}/embeddings.parquet"
    v = read(spark, d, "embeddings")
    index = kept(spark, "vectors", path, lambda: vectors.build(v), lambda old: deleted(spark, old.path))
    asked = v.filter("vec_id % 100 = 0")
    probes, _ = vectors.calibrated(index, asked, 10, target=PROBE_RECALL)
    return vectors.search(index, asked, 10, probes)


@query(f"with {_PAIRS.replace('a.vec_id <> b.vec_id', 'a.vec_id % 100 = 0')} select query_id, rank, example_id as id, round(score, 6) as score from r where rank <= 10")
def indexed_vector_search_exact(spark, d):
    """The same with all lists probed, which is exact; the index holds half of the rows and gets the others, and some again, as a second segment."""
    v = read(spark, d, "embeddings")
    index = vectors.append(vectors.build(v.filter("vec_id % 2 = 0 or vec_id % 5 = 0")), v.filter("vec_id % 2 = 1"))
    return vectors.search(index, v.filter("vec_id % 100 = 0"), 10, len(index.centroids)).withColumn("score", F.round("score", 6))


@query()
def category_clusters(spark, d):
    """Each label's score for each row whose id is divisible by 100: the best of every cluster of its rows, the mean of the best three clusters, and the margin to the next label.

    k-means has no SQL; tests repeat it by brute force."""
    v = read(spark, d, "embeddings")
    found = clusters.assigned(v, clusters.centres(v, 16))
    rows = found.join(v, "vec_id").filter("label is not null").select("label", "cluster", F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return clusters.category_scores(rows, v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))


# --- text vectors

@query(f"with {text_vectors_sql('tv', 'documents', 'doc_id')} select doc_id, sum(s * s)::bigint as square, md5(string_agg(d || ':' || s::bigint, ',' order by d)) as digest from tv where s <> 0 group by 1")
def text_vectors(spark, d):
    """Every document's vector, as its squared length and a digest of its components."""
    v = text_table(spark, d).filter("vector is not null")
    parts = F.filter(F.transform("vector", lambda x, i: F.when(x != 0, F.concat_ws(":", i, x.cast("long")))), lambda x: x.isNotNull())
    return v.select("doc_id", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x).cast("long").alias("square"), F.md5(F.array_join(parts, ",")).alias("digest")).filter("square > 0")


# --- phrases


_WORDS = r"w as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents where doc_id is not null)"


@query(f"with {_WORDS}, h as (select doc_id, sum(len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'licensed' and w[i + 1] = 'under' and w[i + 2] = 'the'))) as hits from w group by 1) select doc_id, hits::bigint as hits from h where hits > 0")
def phrase_search(spark, d):
    """Documents that hold three words in this order, and how often, from the positions in the index."""
    return S.phrase(S.opened(spark, d), "licensed under the")


@query(f"with {_WORDS}, h as (select doc_id, sum(len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'of' and w[i + 1] = 'the'))) as hits from w group by 1) select doc_id, hits::bigint as hits from h where hits > 0")
def phrase_search_grown(spark, d):
    """The same from an index that grew by a segment, in which a third of the documents came again with other texts before."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    field = {"content": F.col("text")}
    first = S.build(docs.filter("doc_id % 3 > 0").withColumn("text", F.when(F.col("doc_id") % 3 == 1, "of the of the").otherwise(F.col("text"))), field)
    index = S.merged(S.append(first, docs.filter("doc_id % 3 < 2"), field))
    deleted(spark, first.path)
    return S.phrase(index, "of the")


@query(r"""with f as (select doc_id, [x for x in regexp_split_to_array(lower(array_to_string(string_split(text, ' ')[1:10], ' ')), '[^\p{L}\p{N}]+') if x <> ''] as t, [x for x in regexp_split_to_array(lower(coalesce(source, '')), '[^\p{L}\p{N}]+') if x <> ''] as k from documents),
    s as (select doc_id, 5 * (contains(' ' || array_to_string(t, ' ') || ' ', ' of the '))::int + (contains(' ' || array_to_string(k, ' ') || ' ', ' of the '))::int as score from f) select doc_id, score from s where score > 0 order by s.score desc, doc_id limit 20""")
def named_documents(spark, d):
    """Documents whose title or keywords hold a phrase; a title counts five times."""
    return S.named(S.opened(spark, d), "of the", size=20)


# --- names and sets


_NAMES = r"""bw as (select [x for x in regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') if x <> ''] as w from benchmark where text is not null),
    nm as (select distinct array_to_string(w[1:k], ' ') as name, k as size from bw, (select unnest([2, 3, 5]) as k) where len(w) >= k)"""


@query(rf"""with recursive {_NAMES}, d as (select doc_id, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+') if x <> ''] as w from documents),
    win as (select doc_id, k as size, unnest([{{'s': i - 1, 'key': array_to_string(w[i:i + k - 1], ' ')}} for i in range(1, len(w) - k + 2)]) as x from d, (select unnest([2, 3, 5]) as k)),
    m as (select doc_id, x.s as s, win.size, name, row_number() over (partition by doc_id order by win.size desc, x.s, name) as i from win join nm on nm.name = x.key),
    t as (select doc_id, 0::bigint as i, []::struct(a bigint, b bigint)[] as marks, null::bigint as s, null::int as size, null::varchar as name from (select distinct doc_id from m)
        union all select t.doc_id, m.i, case when free then list_append(marks, {{'a': m.s, 'b': m.s + m.size}}) else marks end, case when free then m.s end, m.size, m.name
        from (select t.*, len(list_filter(marks, lambda x: x.a < m.s + m.size and m.s < x.b)) = 0 as free from t join m on m.doc_id = t.doc_id and m.i = t.i + 1) t join m on m.doc_id = t.doc_id and m.i = t.i + 1)
    select doc_id, s::int as start, size, name from t where s is not null""")
def dictionary_mentions(spark, d):
    """Names (the first two, three and five words of each benchmark item) in all documents, longest first, none overlapping."""
    w = read(spark, d, "benchmark").select(T.words(F.col("text")).alias("w")).filter("w is not null")
    names = w.select("w", F.explode(F.array(F.lit(2), F.lit(3), F.lit(5))).alias("k")).filter("size(w) >= k").select(F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("name")).distinct()
    return mentions.mentions(read(spark, d, "documents"), names)


_TITLES = r"""w as (select doc_id, list_distinct([x for x in regexp_split_to_array(lower(array_to_string(string_split(text, ' ')[1:10], ' ')), '[^\p{L}\p{N}]+') if x <> '']) as t, list_distinct([x for x in regexp_split_to_array(lower(array_to_string(string_split(text, ' ')[1:8], ' ')), '[^\p{L}\p{N}]+') if x <> '']) as q from documents where text is not null),
    names as (select distinct array_to_string(list_sort(t), ' ') as name, list_sort(t) as t from w where len(t) > 0),
    asks as (select 'd' || doc_id as ask, q from w union all select 'b' || item_id, list_distinct([x for x in regexp_split_to_array(lower(array_to_string(string_split(text, ' ')[1:10], ' ')), '[^\p{L}\p{N}]+') if x <> '']) from benchmark)"""


@query(f"""with {_TITLES}, p as (select ask, name, round(len(list_intersect(q, t)) / (len(q) + len(t) - len(list_intersect(q, t))), 9) as score from asks, names where len(list_intersect(q, t)) > 0),
    a as (select ask, name, coalesce(score, 0) as score from (select distinct ask from asks) left join p using (ask)), r as (select *, row_number() over w as n, coalesce(lead(score) over w, 0) as next from a window w as (partition by ask order by score desc, name))
    select ask, case when score >= 0.35 and round(score - next, 9) >= 0.1 then name end as chosen, case when score >= 0.35 and round(score - next, 9) >= 0.1 then 'unique_lexical_winner' when score < 0.35 then 'score_below_threshold' else 'margin_below_threshold' end as reason from r where n = 1""")
def title_matches(spark, d):
    """For the first eight words of each document, and ten of each benchmark item, the one title (ten words) that is lexically near enough and ahead of all others."""
    words = lambda c, n: F.array_distinct(T.words(F.substring_index(F.col(c), " ", n)))
    docs = read(spark, d, "documents").filter("text is not null")
    names = docs.select(F.array_sort(words("text", 10)).alias("t")).filter("size(t) > 0").select(F.array_join("t", " ").alias("name"), "t").distinct()
    asks = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("ask"), words("text", 8).alias("q")).unionByName(read(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("ask"), words("text", 10).alias("q")))
    return setjoin.lexical_match(asks, names, query="ask", name="name", query_tokens=F.col("q"), name_tokens=F.col("t"))


# --- streams


@query(SQL["rate_limit_anchored"])
def stream_rate_limit(spark, d):
    """The batch limiter's answers from a stream with state and timers."""
    return logs.drained(state.rate_limited(logs.stream(spark, d), key="user_id", limit=3, window_us=2 * DAY), "append")


@query(f"select user_id, event_id, us, state from ({SQL['breaker_states']})")
def stream_breaker(spark, d):
    return logs.drained(state.breaker(logs.stream(spark, d), F.col("event_type") == "error", key="user_id", failures=2, cool_us=DAY), "append")


@query(f"select user_id, event_id, us, admitted from ({SQL['budget_admission']})")
def stream_budget(spark, d):
    """One window over all days, as in the batch query."""
    return logs.drained(state.budget(logs.stream(spark, d), F.col("value"), key="user_id", ceiling=500.0, window_us=3650 * DAY), "append")


@query("select event_id, epoch_us(ts) as us from events")
def stream_fifo(spark, d):
    return logs.drained(state.first_of_last(logs.stream(spark, d), "event_id"), "append")


@query(f"with {EV}, n as (select user_id, us, case when us - lag(us) over w <= {DAY} then 0 else 1 end as new from ev window w as (partition by user_id order by us)), r as (select *, sum(new) over (partition by user_id order by us rows unbounded preceding) as run from n) select user_id, min(us) as start_us, max(us) + {DAY} as end_us, count(*) as n from r group by user_id, run")
def stream_sessions(spark, d):
    """Sessions of a day's gap over the rows that a stream kept as on time."""
    rows = logs.stream(spark, d).select("event_id", "user_id", "ts")
    into = sessions.kept(rows)
    sessions.split_late(rows, into, delay_us=DAY, checkpoint=table_path(spark, "checkpoint")).awaitTermination()
    return into.sessions("user_id", "1 day").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("select event_id, strlen(event_id || '|' || event_type || '|' || replace(props, chr(10), ' '))::int as bytes from events where event_type is not null and props is not null")
def stream_lines(spark, d):
    """Events as lines of text files, read by byte cursor."""
    path = table_path(spark, "lines")
    e = read(spark, d, "events").filter("event_type is not null and props is not null")
    e.select(F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.regexp_replace("props", "\n", " "))).write.text(path)
    out = logs.drained(growing_lines(spark, path, suffix=".txt"), "append")
    return out.select(F.substring_index("line", "|", 1).cast("long").alias("event_id"), F.octet_length("line").alias("bytes"))
