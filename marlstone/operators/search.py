"""Full-text and hybrid search over a written index.

``build`` cuts the fields of a table into words once and writes postings (field,
term, id, row, positions, dl), dealt by a hash of the term into ``buckets`` folders, and
the fields' lengths by document. A query reads only its terms' folders, so its cost
follows the postings of its terms, not the corpus. Postings are sorted and written by
the task that reads the texts, so none is shuffled, and a frequent term's postings are
spread over as many files as there are tasks.

An index grows by segments: ``append`` writes the postings of new documents only, and
notes which rows they replace, a bit a row; ``merged`` writes the live postings of all
segments as one, bucket by bucket from the files they are in. ``opened`` keeps a folder's index for the session, until its files change.

Scores are BM25 with the usual constants; a document's score is that of its best
field, each field weighed by its boost. A phrase is found where its words' positions
follow each other. Ties go to the smaller id.

Cases: null fields have no words; terms that occur nowhere score nothing; a query
without a term gives an empty result; a null id is left out; rows of a repeated id are
scored by themselves and their scores added, and phrases don't run from row to row;
repeated ids of an appended segment replace all rows that had them before; an empty
table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import functools
import operator
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.shared import deleted, kept, table_path
from .retrieval import K1, RRF_K, B, cosine

# The fields' weights in the two kinds of search, and limits.
DISCOVERY = {"title": 8.0, "topic_aliases_text": 7.0, "keywords": 5.0, "abstract": 3.0, "content": 1.0}
PASSAGE = {"title": 5.0, "abstract": 2.0, "content": 1.0}
#: Folders of postings, and files that a bucket of a merged index has at most.
BUCKETS, FILES = 64, 4
#: Rows replaced later are noted in words of so many bits (2 to this power).
WORD = 6
#: monotonically_increasing_id counts the rows of a partition in so many bits.
PARTITION = 33
TITLE_PHRASE = 5
#: Words that are counted at a time; a longer text comes alone.
WORDS_AT_ONCE = 500_000


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    id_col: str
    kind: str  # the id's type
    buckets: int
    segments: int
    stats: dict[str, tuple[int, float]]  # field: documents, mean length
    rows: int = 0  # the next segment's first row, so that live rows of all segments differ

    def _live(self, rows: DataFrame) -> DataFrame:
        if self.segments < 2:
            return rows
        dead = self.spark.read.schema("segment int, word long, bits long").parquet(f"{self.path}/dead").groupBy("segment", "word").agg(F.bit_or("bits").alias("bits"))
        found = rows.withColumn("word", F.shiftright("row", WORD)).join(F.broadcast(dead), ["segment", "word"], "left")
        return found.filter(F.col("bits").isNull() | (F.getbit("bits", _place("row")) == 0)).select(*rows.columns)

    @property
    def stored(self) -> DataFrame:
        return self.spark.read.schema(f"field string, id {self.kind}, row long, dl int, term string, tf long, positions array<int>, segment int, bucket int").parquet(f"{self.path}/postings")

    @property
    def postings(self) -> DataFrame:
        """The postings of documents that no later segment replaces."""
        return self._live(self.stored)

    def of(self, terms: list[str]) -> DataFrame:
        """The terms' postings, from their folders only."""
        rows = [(t,) for t in terms] or [("",)]
        wanted = [r[0] for r in self.spark.createDataFrame(rows, "t string").select(F.pmod(F.crc32(F.col("t").cast("binary")), F.lit(self.buckets)).cast("int")).distinct().collect()]
        return self._live(self.stored.filter(F.col("bucket").isin(wanted) & F.col("term").isin(terms or [""])))

    def lengths(self) -> DataFrame:
        """(field, id, row, dl) of the live documents."""
        return self._live(self.spark.read.schema(f"field string, id {self.kind}, row long, dl int, segment int").parquet(f"{self.path}/lengths"))


def _measured(index: Index) -> Index:
    sums = index.lengths().groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"), F.max("row").alias("last")).collect()
    after = max(((r["last"] >> PARTITION) + 1 << PARTITION for r in sums), default=0)
    return replace(index, stats={r["field"]: (r["n"], r["mean"]) for r in sums}, rows=after)


def _place(row: str) -> Column:
    return F.col(row).bitwiseAND(F.lit((1 << WORD) - 1)).cast("int")


def _dealt(rows: DataFrame, target: str) -> None:
    """Write postings by bucket, each task its own, in the order of terms and rows: rows and ids are stored as differences."""
    how = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#row": "false", "parquet.enable.dictionary#id": "false"}
    rows.sortWithinPartitions("bucket", "term", "row").write.options(**how).partitionBy("bucket").parquet(target)


def _posted(words: DataFrame, kind: str, buckets: int = BUCKETS) -> DataFrame:
    """(field, id, row, dl, term, tf, positions, bucket) of rows with their words ``w``. Each row's words are counted where it is read: no occurrence is shuffled.

    What is counted at a time comes in the order in which it is written, so that sorting is merging."""

    def run(batches):
        for batch in batches:
            ends = np.cumsum(batch.column("w").value_lengths().to_numpy(zero_copy_only=False).astype("i8"))
            start = 0
            while start < len(ends):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + WORDS_AT_ONCE, "right")))
                yield counted(batch.slice(start, stop - start))
                start = stop

    def counted(part):
        w = part.column("w")
        dl = w.value_lengths().to_numpy(zero_copy_only=False).astype("i8")
        coded = w.flatten().dictionary_encode()
        said = [t.encode() for t in coded.dictionary.to_pylist()]
        ranked = sorted((zlib.crc32(t) % buckets, t, i) for i, t in enumerate(said))
        terms = coded.dictionary.take(pa.array([i for _, _, i in ranked], "i4"))
        bucket = pa.array([b for b, _, _ in ranked], "i4")
        rank = np.empty(len(ranked), "i8")
        rank[[i for _, _, i in ranked]] = np.arange(len(ranked))
        at = np.arange(int(dl.sum())) - np.repeat(np.cumsum(dl) - dl, dl)
        rows = max(1, len(dl))
        key = rank[coded.indices.to_numpy()] * rows + np.repeat(np.arange(len(dl)), dl)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        ends = np.append(first, len(key))
        row, term = pa.array(key[first] % rows), pa.array(key[first] // rows)
        found = [part.column(c).take(row) for c in ("field", "id", "row", "dl")]
        positions = pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(at[order].astype("i4")))
        return pa.RecordBatch.from_arrays([*found, terms.take(term), pa.array(np.diff(ends)), positions, bucket.take(term)], ["field", "id", "row", "dl", "term", "tf", "positions", "bucket"])

    return words.select("field", "id", "row", "dl", "w").mapInArrow(run, f"field string, id {kind}, row long, dl int, term string, tf long, positions array<int>, bucket int")


def _segment(index: Index, df: DataFrame, fields: dict[str, Column]) -> Index:
    rows = df.withColumn("__row", F.monotonically_increasing_id() + F.lit(index.rows))
    parts = [rows.select(F.lit(n).alias("field"), F.col(f"`{index.id_col}`").alias("id"), F.col("__row").alias("row"), T.words(F.coalesce(c.cast("string"), F.lit(""))).alias("w")) for n, c in fields.items()]
    words = functools.reduce(DataFrame.unionByName, parts).filter("id is not null").withColumn("dl", F.size("w"))
    _dealt(_posted(words, index.kind, index.buckets), f"{index.path}/postings/segment={index.segments}")
    words.select("field", "id", "row", "dl").write.parquet(f"{index.path}/lengths/segment={index.segments}")
    return _measured(replace(index, segments=index.segments + 1))


def build(df: DataFrame, fields: dict[str, Column], *, id_col: str = "doc_id", buckets: int = BUCKETS) -> Index:
    """Write an index of the ``fields`` of ``df``."""
    return _segment(Index(df.sparkSession, table_path(df.sparkSession, "index"), id_col, df.schema[id_col].dataType.simpleString(), buckets, 0, {}), df, fields)


def append(index: Index, df: DataFrame, fields: dict[str, Column]) -> Index:
    """The index with a segment of ``df``'s documents; those it holds under the same ids are replaced."""
    ids = df.select(F.col(f"`{index.id_col}`").alias("id")).filter("id is not null").distinct()
    old = index.lengths().select("segment", "row", "id").join(ids, "id", "left_semi")
    bit = F.expr(f"shiftleft(1L, cast(row & {(1 << WORD) - 1} as int))")
    dead = old.groupBy("segment", F.shiftright("row", WORD).alias("word")).agg(F.bit_or(bit).alias("bits"))
    dead.write.mode("append").parquet(f"{index.path}/dead")
    return _segment(index, df, fields)


def merged(index: Index) -> Index:
    """A new index of one segment that holds the live postings; no text is read again and nothing is shuffled."""
    new = replace(index, path=table_path(index.spark, "index"), segments=1)
    stored = index.stored  # its folders are listed once
    buckets = [index._live(stored.filter(F.col("bucket") == b).coalesce(FILES)).drop("segment") for b in range(index.buckets)]
    _dealt(functools.reduce(DataFrame.unionByName, buckets), f"{new.path}/postings/segment=0")
    index.lengths().drop("segment").write.parquet(f"{new.path}/lengths/segment=0")
    return _measured(new)


def opened(spark: SparkSession, sf_dir: str, *, buckets: int = BUCKETS) -> Index:
    """The index of a folder's documents, kept for the session: as content the text, as title its first ten words, as keywords the source."""
    path = f"{sf_dir}/documents.parquet"
    fields = {"title": F.substring_index("text", " ", 10), "keywords": F.col("source"), "content": F.col("text")}
    return kept(spark, f"index {buckets}", path, lambda: build(spark.read.parquet(path), fields, buckets=buckets), lambda old: deleted(spark, old.path))


def bm25(index: Index, query: str | list[str], *, boosts: dict[str, float] | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) of every document that holds a term of the query in one of the fields."""
    boosts = boosts or dict.fromkeys(index.stats, 1.0)
    terms = sorted(set(query.lower().split() if isinstance(query, str) else query))
    fields = [f for f in boosts if f in index.stats]
    hits = index.of(terms).filter(F.col("field").isin(fields or [""])).select("field", "id", "dl", "term", "tf")
    df = hits.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))  # a row a field and term
    per = {f: index.stats[f] for f in fields}
    of = lambda i: functools.reduce(lambda c, f: F.when(F.col("field") == f, F.lit(float((per[f][0], per[f][1] or 1.0, boosts[f])[i]))).otherwise(c), per, F.lit(1.0))
    scored = hits.join(F.broadcast(df), ["field", "term"])
    idf = F.log(1 + (of(0) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = of(2) * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / of(1)))
    by_field = scored.groupBy("id", "field").agg(F.sum(part).alias("score"))
    return by_field.groupBy("id").agg(F.max("score").alias("score")).withColumnRenamed("id", index.id_col)


def phrase(index: Index, said: str | list[str], *, field: str = "content") -> DataFrame:
    """(id, hits): documents that hold the words one after the other in a field, and how often. One shuffle of the words' postings."""
    words = [w.lower() for w in (said.split() if isinstance(said, str) else said)]
    terms = sorted(set(words))
    rows = index.of(terms).filter(F.col("field") == field).groupBy("id", "row").agg(F.collect_list(F.struct("term", "positions")).alias("l")).filter(F.size("l") == len(terms))  # a row a term
    at = lambda t: F.get(F.filter("l", lambda x: x["term"] == t), F.lit(0))["positions"]
    starts = [(lambda i: F.transform(at(words[i]), lambda p: p - i))(i) for i in range(len(words))]
    both = functools.reduce(F.array_intersect, starts) if starts else F.array().cast("array<int>")
    found = rows.groupBy("id").agg(F.sum(F.size(both)).alias("hits")).filter("hits > 0")
    return found.withColumnRenamed("id", index.id_col)


def named(index: Index, said: str, *, fields: dict[str, int] | None = None, size: int = 10) -> DataFrame:
    """(id, score): documents in whose fields the phrase stands, by the fields' points (a title phrase counts five times)."""
    points = fields or {"title": TITLE_PHRASE, "keywords": 1}
    parts = [phrase(index, said, field=f).select(index.id_col, F.lit(p).alias("score")) for f, p in points.items()]
    return functools.reduce(DataFrame.unionByName, parts).groupBy(index.id_col).agg(F.sum("score").alias("score")).orderBy(F.desc("score"), index.id_col).limit(max(1, min(20, size)))


def best_chunk(hits: DataFrame, *, id_col: str = "doc_id", chunk: str = "chunk_index") -> DataFrame:
    """Of each document the chunk with the highest score; ties to the earlier chunk."""
    rest = [c for c in hits.columns if c != id_col]
    return hits.groupBy(id_col).agg(F.max_by(F.struct(*rest), F.struct("score", -F.col(chunk))).alias("best")).select(id_col, "best.*")


def first_places(df: DataFrame, id_col: str, rank: str = "rank") -> DataFrame:
    """Each id once, at its best rank."""
    return df.groupBy(id_col).agg(F.min(rank).alias(rank))


def top(df: DataFrame, id_col: str, k: int) -> DataFrame:
    """(id, rank) of the ``k`` best scores; ties to the smaller id. The window sees k rows."""
    head = df.orderBy(F.desc("score"), id_col).limit(k)
    return head.select(id_col, F.row_number().over(Window.orderBy(F.desc("score"), id_col)).alias("rank"))


def fused(channels: list[DataFrame], id_col: str, k: int, order: list[str] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of (id, rank) channels. Ties go to the earlier channel and rank, then to the smaller id."""
    tagged = functools.reduce(DataFrame.unionByName, [first_places(c, id_col).withColumn("channel", F.lit(i)) for i, c in enumerate(channels)])
    sums = tagged.groupBy(id_col).agg(F.sum(1 / (F.lit(RRF_K) + F.col("rank"))).alias("rrf"), F.min(F.struct("channel", "rank")).alias("first"))
    ties = [F.col("first")] if order is None else [F.col(c) for c in order]
    return sums.orderBy(F.desc("rrf"), *ties, id_col).limit(k)


def fused_documents(docs: DataFrame, chunks: DataFrame, k: int, *, id_col: str = "doc_id", text: str = "text", most: int = 500) -> DataFrame:
    """(id, rrf, chunk_text): documents by reciprocal ranks of (id, rank) and of each one's first chunk in (id, rank, text), with the beginning of that chunk.

    A chunk's rank is its place among all chunks; documents that only a chunk names are there too. Ties go to the smaller id."""
    rest = [c for c in chunks.columns if c != id_col]
    best = chunks.groupBy(id_col).agg(F.min_by(F.struct(*rest), "rank").alias("c")).select(id_col, F.col("c.rank").alias("chunk_rank"), F.left(F.col(f"c.{text}"), F.lit(most)).alias("chunk_text"))
    both = first_places(docs, id_col).join(best, id_col, "full")
    part = lambda c: F.coalesce(1 / (F.lit(RRF_K) + F.col(c)), F.lit(0.0))
    return both.select(id_col, (part("rank") + part("chunk_rank")).alias("rrf"), "chunk_text").orderBy(F.desc("rrf"), id_col).limit(max(1, k))


def near_chunks(vectors: DataFrame, query: DataFrame, k: int, *, id_col: str, allowed: DataFrame | None = None, least: float | None = None, vec_col: str = "embedding") -> DataFrame:
    """(id, score) of the ``k`` nearest vectors by cosine, among the allowed ids if there are any given."""
    rows = vectors.filter(F.col(vec_col).isNotNull())
    if allowed is not None:
        rows = rows.join(allowed, id_col, "left_semi")
    q = query.select(F.col(vec_col).alias("__q")).limit(1)
    found = rows.crossJoin(F.broadcast(q)).withColumn("score", cosine(F.col(vec_col), F.col("__q"))).drop("__q", vec_col)
    if least is not None:
        found = found.filter(F.col("score") >= least)
    return found.orderBy(F.desc("score"), id_col).limit(k)


def hybrid(index: Index, query: list[str], vectors: DataFrame, about: DataFrame, *, allowed: DataFrame | None = None, depth: int = 10, near: int = 20, k: int = 5, vec_id: str = "vec_id") -> DataFrame:
    """(id, rrf) by words and by vectors: candidates first, each channel's ``depth`` best, fused, ``k`` at most."""
    words = bm25(index, query)
    if allowed is not None:
        words = words.join(allowed, index.id_col, "left_semi")
    by_vec = near_chunks(vectors, about, near, id_col=vec_id, allowed=None if allowed is None else allowed.withColumnRenamed(index.id_col, vec_id))
    return fused([top(words, index.id_col, depth), top(by_vec, vec_id, depth).withColumnRenamed(vec_id, index.id_col)], index.id_col, k)


def snippets(chunks: DataFrame, terms: list[str], *, id_col: str = "doc_id", k: int = 3, otherwise: int = 2) -> DataFrame:
    """Each document's ``k`` chunks that hold most of the terms' words, or its first two if none holds any."""
    w = T.words(F.col("chunk"))
    hits = functools.reduce(operator.add, [F.size(F.filter(w, _is(t))) for t in terms], F.lit(0))
    by = Window.partitionBy(id_col)
    scored = chunks.withColumn("hits", hits).withColumn("any", F.max("hits").over(by) > 0)
    place = F.row_number().over(by.orderBy(F.desc("hits"), "chunk_index"))
    first = F.row_number().over(by.orderBy("chunk_index"))
    both = scored.withColumns({"place": place, "first": first})
    return both.filter(F.when(F.col("any"), (F.col("hits") > 0) & (F.col("place") <= k)).otherwise(F.col("first") <= otherwise)).select(id_col, "chunk_index", "hits")


def _is(word: str):
    return lambda x: x == word


def find_document(docs: DataFrame, identity: str, *, file: str, title: str, id_col: str, size: int = 10) -> DataFrame:
    """Documents that a file name, a stem, a phrase of file name or title, or an id names; a title phrase counts five times."""
    value = identity.strip()
    stem = value[:-4].strip() if value.lower().endswith(".pdf") else value
    said = F.regexp_replace(F.lit(stem), "[_＿][\\u4e00-\\u9fff]{2,4}$", "")
    has = lambda c, x: F.contains(F.concat(F.lit(" "), F.array_join(T.words(c), " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(T.words(x), " "), F.lit(" ")))
    points = [
        F.when(F.col(file) == value, 1).otherwise(0), F.when(F.col(file) == stem + ".pdf", 1).otherwise(0), F.when(has(F.col(file), F.lit(value)), 1).otherwise(0),
        F.when(has(F.col(title), said), 5).otherwise(0), F.when(F.col(id_col).cast("string") == value, 1).otherwise(0),
    ]
    found = docs.withColumn("score", functools.reduce(operator.add, points)).filter("score > 0")
    return found.orderBy(F.desc("score"), id_col).limit(max(1, min(20, size))) if value else found.limit(0)


def keyword_facts(facts: DataFrame, words: list[str], *, k: int = 5, content: str = "content") -> DataFrame:
    """Facts that hold a word, most words first, then the surest, then the newest place."""
    hits = functools.reduce(operator.add, [F.contains(F.lower(F.col(content)), F.lit(w.lower())).cast("int") for w in words if w], F.lit(0))
    return facts.withColumn("hits", hits).filter("hits > 0").orderBy(F.desc("hits"), F.desc("confidence"), "id").limit(k)


def recalled(facts: DataFrame, words: list[str], vectors: DataFrame | None = None, about: DataFrame | None = None, *, many: int = 500, k: int = 5, fallback: int = 3, least: float = 0.65) -> DataFrame:
    """Facts for a question: by vectors if there are many facts, else by words, else the last three."""
    latest = facts.orderBy(F.desc("id")).limit(fallback)
    if vectors is not None and facts.limit(many).count() >= many:
        near = near_chunks(vectors, about, k, id_col="id", least=least)
        found = facts.join(F.broadcast(near.select("id")), "id")
    elif words:
        found = keyword_facts(facts, words, k=k).select(*facts.columns)
    else:
        found = latest
    none = found.limit(1).count() == 0
    return latest if none else found


def injected(lines: Column, *, most: int = 5, budget: int = 400) -> Column:
    """Up to ``most`` lines joined, the last ones left out until half the characters are within the budget."""
    kept = F.slice(lines, 1, most)
    ends = F.transform(kept, lambda x, i: F.aggregate(F.slice(kept, F.lit(1), i + 1), F.lit(-1).cast("int"), lambda s, y: s + F.length(y) + 1))
    return F.array_join(F.filter(kept, lambda x, i: (i == 0) | (F.floor(F.get(ends, i) / 2) <= budget)), "\n")


def lexical_choice(pairs: DataFrame, *, query: str, item: str, score: str = "score", least: float = 0.35, margin: float = 0.10) -> DataFrame:
    """Each query's best item if it reaches ``least`` and is ``margin`` ahead of the next, else null."""
    w = Window.partitionBy(query).orderBy(F.desc(score), item)
    two = pairs.withColumns({"__n": F.row_number().over(w), "__next": F.coalesce(F.lead(score).over(w), F.lit(0.0))}).filter("__n = 1")
    ok = (F.col(score) >= least) & (F.round(F.col(score) - F.col("__next"), 9) >= margin)
    return two.select(query, F.when(ok, F.col(item)).alias("chosen"), F.when(ok, "unique_lexical_winner").when(F.col(score) < least, "score_below_threshold").otherwise("margin_below_threshold").alias("reason"))
