"""Collocations by pivot partitioning.

Words are counted once; a phrase can be frequent only if its words are. Each n-gram
is owned by its rarest word (its pivot; of a repeated one the first occurrence). Each
occurrence of a frequent word is rewritten as the fragment that its n-grams can come
from: up to four words to the left that are more frequent, up to four to the right
that are no rarer. Fragments are counted where they arise and go to their pivot's
task, which mines them by growing phrases word by word as long as they stay frequent,
and emits only what the pivot owns. So every n-gram is counted in one place, and the
phrases of very frequent words, which have few more frequent neighbours, stay small.

The order of words is by a table of ``2**bits`` hashed places, each with the count of
the most frequent word in it, ties by the word itself: any fixed order counts rightly,
and the table has a bounded size (``MOST_BITS``) whatever the number of words. A
frequent pivot's fragments (``HOT``) are dealt by its neighbour too: those n-grams that
go on to the right by the right neighbour, the others by the left one.

Cases: null texts are empty; a null language is ``und``; texts without words and empty
tables give nothing; ties are broken as stated in ``phrases``; repeated rows count as
often as they occur; whole texts are read, a slice of rows at a time; other columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, made, text_slices, written

LONGEST = 5
#: Bytes of text that are cut into words at a time; words that a task counts before it passes them on.
SLICE, COUNTED = 4 << 20, 400_000
#: Pivots that occur more often are dealt by their neighbours too; frequent words a task mines (on average).
HOT, WORDS_PER_TASK = 1 << 17, 1 << 20
MOST_BITS = 22
#: The separators of pieces, a tab, and capital letters, as bytes; 0xFF is in no UTF-8 text.
_TABLE = bytes(0xFF if chr(i) in ".,;:!?\n\v\f\r" else 0x20 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))
_END = b"\xff"


def cut(texts: list[bytes | None]) -> list[bytes]:
    """All words of the texts, with ``_END`` between pieces and texts."""
    return b"\xff".join(t for t in texts if t).translate(_TABLE).replace(_END, b" \xff ").split()


def place(lang: bytes, word: bytes, mask: int) -> int:
    return zlib.crc32(lang + b" " + word) & mask


def _by_lang(batches):
    """(language, words) of the batches, a slice at a time."""
    for batch in batches:
        for rows, texts in text_slices(batch, "text", SLICE):
            langs = rows.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                yield lang, cut([t for t, y in zip(texts, langs, strict=True) if y == lang])


def _texts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))


def word_counts(df: DataFrame, least: int, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, a) of the words with ``least`` occurrences or more, and for each language the count of all words, as word null."""

    def run(batches):
        def out(lang, counted):
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(counted)), pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], ["lang", "word", "a"])

        seen: dict[str, Counter] = {}
        for lang, words in _by_lang(batches):
            c = seen.setdefault(lang, Counter())
            c.update(words)
            ends = c.pop(_END, 0)
            c[None] += len(words) - ends
            if sum(map(len, seen.values())) > COUNTED:
                yield from (out(*x) for x in seen.items())
                seen = {}
        yield from (out(*x) for x in seen.items())

    counted = _texts(df, text_col, lang_col).mapInArrow(run, "lang string, word string, a long").groupBy("lang", "word").agg(F.sum("a").alias("a"))
    return counted.filter(F.col("word").isNull() | (F.col("a") >= least))


def order_table(words: DataFrame) -> np.ndarray:
    """The greatest count of a frequent word in each place; at most ``2**MOST_BITS`` rows come to the driver."""
    n = words.count()
    bits = min(MOST_BITS, max(12, math.ceil(math.log2(16 * n + 1))))
    at = F.crc32(F.concat_ws(" ", "lang", "word")).bitwiseAND((1 << bits) - 1)
    rows = words.groupBy(at.cast("int").alias("at")).agg(F.max("a").alias("a")).toArrow()
    table = np.zeros(1 << bits, "u4")
    table[rows.column("at").to_numpy()] = np.minimum(rows.column("a").to_numpy(), (1 << 32) - 1)
    return table


def windows(r: np.ndarray, reach: int = LONGEST - 1) -> tuple[np.ndarray, np.ndarray]:
    """For each word its fragment's words to the left and to the right; ``r`` holds the words' places in the order, 0 for none."""
    n = len(r)
    out = []
    for step, rarer in ((-1, np.greater), (1, np.greater_equal)):
        size, going = np.zeros(n, "i4"), r > 0
        for k in range(1, reach + 1):
            other = np.zeros(n, r.dtype)
            if n > k:
                if step < 0:
                    other[k:] = r[:-k]
                else:
                    other[:-k] = r[k:]
            going = going & (other > 0) & rarer(other, r)
            size += going
        out.append(size)
    return out[0], out[1]


def _alike(r: np.ndarray, start: np.ndarray, size: np.ndarray, left: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of one of each kind of fragment, how many there are of it). Sums of hashes find equal ones, the words themselves decide."""
    key = (left * 3 + kind).astype("u8") * np.uint64(0x9E3779B97F4A7C15) + size.astype("u8")
    for k in range(2 * LONGEST - 1):
        inside = size > k
        w = np.where(inside, r[np.minimum(start + k, len(r) - 1)], 0).astype("u8")
        key = (key ^ (w + np.uint64(k + 1))) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    one = first[inverse]
    equal = (size == size[one]) & (left == left[one]) & (kind == kind[one])
    for k in range(2 * LONGEST - 1):
        inside = size > k
        equal &= ~inside | (r[np.minimum(start + k, len(r) - 1)] == r[np.minimum(start[one] + k, len(r) - 1)])
    rest = np.flatnonzero(~equal)
    return np.concatenate([first, rest]), np.concatenate([np.bincount(inverse[equal], minlength=len(first)), np.ones(len(rest), "i8")])


def fragments(df: DataFrame, table: np.ndarray, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(g, lang, left, kind, words, n): the fragments of all pivots, counted; ``g`` deals them out.

    Kind 0: all of the pivot's n-grams; 1: those that go on to the right; 2: the others."""
    shared = df.sparkSession.sparkContext.broadcast(table)  # 4 bytes a place, 16 MB at most
    names = ["g", "lang", "left", "kind", "words", "n"]

    def run(batches):
        table, mask = shared.value, len(shared.value) - 1
        for lang, words in _by_lang(batches):
            key = lang.encode()
            found = sorted((int(v), w) for w in set(words) if w != _END and (v := table[place(key, w, mask)]))
            number = {w: i for i, (_, w) in enumerate(found, 1)}
            r = np.fromiter((number.get(w, 0) for w in words), "i8", len(words))
            left, right = windows(r)
            value = np.array([0, *(v for v, _ in found)], "i8")
            hash_ = np.array([0, *(zlib.crc32(w) for _, w in found)], "i8")
            p = np.flatnonzero(left + right)
            hot = value[r[p]] > HOT
            plain, split = p[~hot], p[hot]
            on, ends = split[right[split] > 0], split[left[split] > 0]
            at = np.concatenate([plain, on, ends])
            if not len(at):
                continue
            kind = np.repeat([0, 1, 2], [len(plain), len(on), len(ends)])
            size = left[at] + 1 + np.where(kind == 2, 0, right[at])
            beside = np.concatenate([np.zeros(len(plain), "i8"), hash_[r[on + 1]], hash_[r[ends - 1]]])
            start = at - left[at]
            one, n = _alike(r, start, size, left[at], kind)
            g = (hash_[r[at[one]]] * 31 + beside[one] * 17 + kind[one]) & 0x7FFFFFFF
            text = [b" ".join(words[a : a + m]) for a, m in zip(start[one].tolist(), size[one].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(g.astype("i4")), pa.array([lang] * len(one)), pa.array(left[at[one]].astype("i1")), pa.array(kind[one].astype("i1")), pa.array(text, pa.string()), pa.array(n.astype("i8"))], names
            )

    return _texts(df, text_col, lang_col).mapInArrow(run, "g int, lang string, left byte, kind byte, words string, n long")


def mined(table: pa.Table, least: int) -> pa.RecordBatch:
    """(lang, phrase, m, a) of one task's fragments: phrases grow to the right, then to the left, while they are frequent."""
    split = pc.split_pattern(table.column("words").combine_chunks(), " ")
    flat = split.flatten().dictionary_encode()
    code, names = flat.indices.to_numpy(zero_copy_only=False).astype("i8"), flat.dictionary.to_pylist()
    ends = np.asarray(split.offsets)
    left, kind, n = (table.column(c).to_numpy() for c in ("left", "kind", "n"))
    pivot = ends[:-1] + left
    right = ends[1:] - pivot - 1
    langs = table.column("lang").combine_chunks().dictionary_encode()
    lang, lang_names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary.to_pylist()
    many = len(names)
    out: list[tuple[str, str, int, int]] = []

    def grown(rows: np.ndarray, ids: np.ndarray, word: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        _, first, inverse = np.unique(ids * many + word, return_index=True, return_inverse=True)
        total = sum(np.bincount(inverse, part, len(first)).astype("i8") << shift for part, shift in ((n[rows] & 0x3FFFFFF, 0), (n[rows] >> 26, 26)))  # in halves, as bincount adds doubles
        for f in np.flatnonzero(total >= least).tolist():
            r = rows[first[f]]
            if i + j:
                out.append((lang_names[lang[r]], " ".join(names[c] for c in code[pivot[r] - i : pivot[r] + j + 1]), i + j + 1, int(total[f])))
        keep = total[inverse] >= least
        return rows[keep], inverse[keep]

    rows, ids = grown(np.arange(table.num_rows), lang.astype("i8"), code[pivot], 0, 0)
    for j in range(LONGEST):
        if j:
            more = right[rows] >= j
            rows, ids = grown(rows[more], ids[more], code[pivot[rows[more]] + j], 0, j)
        here, own = rows, ids
        if not j:
            here, own = rows[kind[rows] != 1], ids[kind[rows] != 1]
        for i in range(1, LONGEST - j):
            more = left[here] >= i
            here, own = grown(here[more], own[more], code[pivot[here[more]] - i], i, j)
    cols = list(zip(*out, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], ["lang", "phrase", "m", "a"])


def frequent(df: DataFrame, words: DataFrame, least: int, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, m, a): all phrases of 2 to ``LONGEST`` words with ``least`` occurrences or more."""
    tasks = max(1, math.ceil((words.agg(F.sum("a")).first()[0] or 0) / WORDS_PER_TASK))

    def run(batches):
        got = list(batches)
        if got:
            yield mined(pa.Table.from_batches(got), least)

    dealt = fragments(df, order_table(words), text_col=text_col, lang_col=lang_col).repartition(tasks, "g").drop("g")
    return dealt.mapInArrow(run, "lang string, phrase string, m int, a long")


def phrases(df: DataFrame, *, least: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` collocations by score, then count, then the phrase's bytes."""
    mark = made()
    counted = written(word_counts(df, least, text_col=text_col, lang_col=lang_col), "words")
    words = counted.filter("word is not null")
    found = written(frequent(df, words, least, text_col=text_col, lang_col=lang_col), "phrases")
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    longer = found.filter("m > 2").withColumn("w", F.split("phrase", " ", -1))
    inner = longer.select("lang", F.explode(F.array(part(F.lit(1), F.col("m") - 1), part(F.lit(2), F.col("m") - 1))).alias("phrase"), F.col("a").alias("most"))
    kept = found.join(inner.groupBy("lang", "phrase").agg(F.max("most").alias("most")), ["lang", "phrase"], "left").filter("most is null or most < a").drop("most")
    counts = words.select("lang", F.col("word").alias("p"), "a").unionByName(found.select("lang", F.col("phrase").alias("p"), "a"))
    cuts = kept.withColumn("w", F.split("phrase", " ", -1)).select("lang", "phrase", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("m") - F.col("k")).alias("tail"))
    both = cuts.join(counts.select("lang", F.col("p").alias("head"), F.col("a").alias("l")), ["lang", "head"]).join(counts.select("lang", F.col("p").alias("tail"), F.col("a").alias("r")), ["lang", "tail"])
    whole = counted.filter("word is null").select("lang", F.col("a").alias("n"))
    score = F.expr("(cast(1000 as decimal(5,0)) * cast(cast(a as decimal(17,0)) * cast(n as decimal(16,0)) as decimal(33,0))) div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0))")
    scored = both.join(whole, "lang").withColumn("score", score)
    best = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("s")).select("lang", "phrase", "s.*")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(*order))
    some = best.withColumn("at", rank(F.pmod(F.xxhash64("phrase"), F.lit(32)))).filter(F.col("at") <= top)
    forget(df.sparkSession, mark, ("words", "phrases"))
    return some.withColumn("rank", rank().cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
