"""The training-data operators' queries over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloomdedup, chosenpath, gumbel_pieces, lang_crf, pathratio, pfair, pivotgrams, pll, pqmine, quotes, secret_markov, toxicity, vafile
from .common import table


def op1_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(lang_crf.held_out(), F.lit(False)))
    model = lang_crf.train(docs.filter("not held_out"))
    return lang_crf.identify(docs, model, keep=("doc_id", "held_out"))


def op2_markov_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_markov.report(docs, secret_markov.trained(spark, found_in=docs))


def op3_masked_pll_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pll.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_va_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vafile.topk(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op6_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.similar(table(spark, sf_dir, "documents"))


def op7_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bloomdedup.decisions(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op8_tag_path_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pathratio.extract(table(spark, sf_dir, "pages"))


def op9_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gumbel_pieces.sample_encode(table(spark, sf_dir, "documents"), round_trip=True)


def op10_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op11_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", toxicity.held_out())
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    return toxicity.judged(docs, toxicity.train(docs.filter("not held_out"), labels), keep=("doc_id", "held_out"))


def op12_pivot_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotgrams.phrases(table(spark, sf_dir, "documents"))


def op13_pq_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return pqmine.mined(vectors, vectors.filter("vec_id % 100 = 0"), label=label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_crf_language_id, op2_markov_secret_scan, op3_masked_pll_score, op4_pfair_mix, op5_va_topk, op6_chosen_path_join, op7_bloom_exact_dedup,
            op8_tag_path_extract, op9_gumbel_pieces, op10_quote_linking, op11_counterfactual_toxicity, op12_pivot_collocations, op13_pq_hard_negatives,
        )
    }


#: op1, op3, op8, op9 and op11 are learned, parsed or sampled in Python, op2 has a trained model, op4 simulates a
#: schedule, op6 joins on shingles and op10 follows replies: they are tested against brute force instead.
ORACLE_SQL = {
    "op5_va_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and vec_id is not null
        ), s as (
            select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
            from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0
        ), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 5
    """,
    "op7_bloom_exact_dedup": r"""
        with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as h from documents)
        select doc_id, min(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
               row_number() over (partition by h order by doc_id nulls last) = 1 as kept, h as text_sha256
        from d
    """,
    "op12_pivot_collocations": r"""
        with recursive t as (
            select row_number() over () as i, coalesce(lang, 'und') as lang,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents
        ), pc as (select lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) as x from t),
        ws as (select lang, regexp_extract_all(x, '[^\x20\x09]+') as w from pc),
        tot as (select lang, sum(len(w))::bigint as n from ws group by lang),
        g as (select lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') for i in range(1, len(w) - m + 2)]) as p from ws, (select unnest([1, 2, 3, 4, 5]) as m)),
        f as (select lang, m, p, count(*) as a from g group by all having count(*) >= 100),
        c as (select *, string_split(p, ' ') as w from f where m > 1),
        longer as (select lang, unnest([array_to_string(w[1:m - 1], ' '), array_to_string(w[2:m], ' ')]) as p, a as b from c where m > 2),
        kept as (select c.* from c left join (select lang, p, max(b) as b from longer group by all) x using (lang, p) where b is null or b < a),
        cut as (select lang, p, a, w, m, unnest(range(1, m)) as k from kept),
        s as (
            select cut.lang, cut.p, cut.a, k, x.a as l, y.a as r, n, ((1000::hugeint * cut.a * n) // (x.a::hugeint * y.a))::bigint as score
            from cut join f x on x.lang = cut.lang and x.p = array_to_string(cut.w[1:k], ' ') join f y on y.lang = cut.lang and y.p = array_to_string(cut.w[k + 1:cut.m], ' ') join tot on tot.lang = cut.lang
        ), b as (select * from s qualify row_number() over (partition by lang, p order by score, k) = 1)
        select * from (select lang, row_number() over (partition by lang order by score desc, a desc, p) as rank, p as phrase, a, l, r, n, score from b) where rank <= 2000
    """,
    "op13_pq_hard_negatives": """
        with v as (
            select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end) as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
            where embedding is not null and label is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.e, c.e)::bigint as score
            from v a join v c on a.vec_id <> c.vec_id and len(a.e) = len(c.e) where a.vec_id % 100 = 0
        ), p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
        n as (
            select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id)::int as rank,
                   s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
            from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score
        )
        select * from n where rank <= 5
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
