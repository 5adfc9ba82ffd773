"""Language identification by a linear-chain conditional random field.

Every word of a text gets a label; neighbouring labels are tied by learned
transitions, and forward-backward gives each word's posterior, so code-switched
text is labelled word by word. A word's features are its affixes (one to four
letters at either end), its letter n-grams (two and three), the word itself
(lexicon feature) and its shape, all hashed into ``2**LOG2_FEATURES`` slots.

Training data: labelled rows chosen by a hash of id and text, about
``SAMPLE_PER_LANG`` rows a language and ``SAMPLE_ROWS`` in all, equal ones once: the
documented bound of what is fitted on. Of each, stretches of ``STRETCH`` words are drawn
from all over the text (all of it, if it has no more than ``STRETCHES`` of them), in
tasks. They are cut into runs of words, and runs of different languages are
strung together, so that transitions are learned from switches whose places are
known. Parameters are fitted by AdaGrad on the CRF's log-likelihood, in numpy.

A text's score is its words' mean posterior, weighted by their letters; the
label with the highest one is the prediction.

Prediction is one pass without a shuffle. Emissions are computed once per
distinct word of a chunk. Forward-backward runs over all of a chunk's words at
once: words are cut into segments whose transfer matrices are multiplied
along, the segments' products are chained per text, and the messages inside the
segments follow; the result is exact for texts of any length.

Cases: null, empty and letterless texts (numerals aren't letters) get ``und`` and
score 0; rows without a language or a text aren't trained on; without any labelled
row every text gets ``und`` and score 0; more than ``MAX_LANGS`` languages are an
error; ties go to the smaller name; repeated rows each give their row; an empty
table gives an empty result; texts of any length are read whole; columns that
aren't kept are ignored, kept ones may have any name but those of the result.
"""

from __future__ import annotations

import random
import re
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

LOG2_FEATURES = 16
SAMPLE_PER_LANG, SAMPLE_ROWS = 300, 20_000
STRETCH, STRETCHES = 40, 8
MAX_LANGS = 256
CHUNK_CHARS = 1_500_000
RUN_WORDS = (5, 16)
SEQUENCE_WORDS = 128
EPOCHS = 4
SEGMENT = 64
RESCALE = 8  # words between two scalings of the messages; doubles hold eight words' range
UND = "und"


def _not_letters() -> str:
    """The numerals among word characters that aren't letters, as ranges of a character class."""
    at = [i for i in range(0x80, sys.maxunicode + 1) if (c := chr(i)).isalnum() and not c.isalpha()]
    starts = [i for i, before in zip(at, [-2, *at], strict=False) if i != before + 1]
    ends = [i for i, after in zip(at, [*at[1:], -2], strict=False) if i != after - 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True))


#: Runs of letters (Unicode category L).
WORD = re.compile(rf"[^\W\d_{_not_letters()}]+")
#: The same where a text has no numeral that is neither a digit nor a letter, and quicker.
_PLAIN, _NUMERAL = re.compile(r"[^\W\d_]+"), re.compile(f"[{_not_letters()}]")


def words(text: str | None) -> list[str]:
    """A text's words in lower case."""
    t = (text or "").lower()
    return _PLAIN.findall(t) if t.isascii() or not _NUMERAL.search(t) else WORD.findall(t)


NONE = 1 << LOG2_FEATURES  # the slot whose weight stays zero


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
    return ((x ^ (x >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(64 - LOG2_FEATURES)).astype("i4")


def slots(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed feature slots of lower-case words: (words x 10) of whole word, length and affixes; (letters x 2) of the n-grams that start at each letter; each word's first letter.

    Words are laid end to end between marks; slots that don't exist are ``NONE``."""
    lens = np.fromiter(map(len, words), "i8", len(words)) + 2
    code = np.frombuffer(f"^{'$^'.join(words)}$".encode("utf-32-le"), "u4").astype("u8") + np.uint64(1)
    starts = np.cumsum(lens) - lens
    left = np.repeat(starts + lens, lens) - np.arange(len(code))  # letters up to the word's end, the mark included
    p = np.uint64(0x100000001B3)
    ahead = np.concatenate([code, np.zeros(4, "u8")])
    two = code * p + ahead[1:-3]
    three = two * p + ahead[2:-2]
    grams = np.stack([np.where(left >= 2, _mix(two, 1), NONE), np.where(left >= 3, _mix(three, 2), NONE)], axis=1)
    powers = np.cumprod(np.full(int(lens.max()), p))
    at = np.arange(len(code)) - np.repeat(starts, lens)
    whole = np.add.reduceat(code * powers[at], starts)
    n = lens - 2
    fixed = [_mix(whole, 3), _mix(np.minimum(n, 8).astype("u8"), 4)]
    pre, suf = np.zeros(len(words), "u8"), np.zeros(len(words), "u8")
    for k in range(1, 5):
        pre, suf = pre * p + ahead[starts + np.minimum(k, n)], suf * p + ahead[starts + np.maximum(n - k + 1, 0)]
        fixed += [np.where(n >= k, _mix(pre, 4 + k), NONE), np.where(n >= k, _mix(suf, 8 + k), NONE)]
    return np.stack(fixed, axis=1), grams, starts


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # features and the empty slot x langs
    trans: np.ndarray  # langs x langs
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.langs)))
        return _emissions(self.weight, *slots(words))


def _emissions(weight: np.ndarray, fixed: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    per_letter = weight[grams[:, 0]] + weight[grams[:, 1]]
    out = np.add.reduceat(per_letter, starts, axis=0)
    for j in range(fixed.shape[1]):
        out += weight[fixed[:, j]]
    return out


def forward_backward(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Posteriors of every word's labels; ``first`` marks the words that begin a text.

    Messages are scaled as they go, which posteriors don't notice."""
    n, k = emit.shape
    if not n:
        return np.zeros((0, k))
    t = np.exp(trans - trans.max())
    s0 = np.exp(start - start.max())
    pad = -n % segment
    m = (n + pad) // segment
    e = np.ones((n + pad, k))
    np.exp(emit - emit.max(axis=1, keepdims=True), out=e[:n])
    e = np.ascontiguousarray(e.reshape(m, segment, k).transpose(1, 0, 2))
    begin = np.concatenate([first, np.ones(pad, bool)])
    ends = np.concatenate([begin[1:], [True]]).reshape(m, segment).T  # the text's last word
    begin = begin.reshape(m, segment).T
    one = lambda x: x / x.reshape(m, -1).sum(axis=1).reshape(m, *[1] * (x.ndim - 1))
    # the product of each segment's transfers, and the message into each segment
    prod = np.tile(np.eye(k), (m, 1, 1))
    for i in range(segment):
        prod = (prod.reshape(-1, k) @ t).reshape(m, k, k)
        prod[begin[i]] = s0
        prod *= e[i][:, None, :]
        if i % RESCALE == RESCALE - 1:
            prod = one(prod)
    prod = one(prod)
    into = np.empty((m, k))
    a = s0 / s0.sum()
    for j in range(m):
        into[j] = a
        a = a @ prod[j]
        a /= a.sum()
    alpha = np.empty((segment, m, k))
    a = into
    for i in range(segment):
        a = a @ t
        a[begin[i]] = s0
        a *= e[i]
        if i % RESCALE == RESCALE - 1:
            a = one(a)
        alpha[i] = a
    # backward: the carried message has the emission of the word it comes from; transposed products
    prod = np.tile(np.eye(k), (m, 1, 1))
    for i in range(segment - 1, -1, -1):
        prod = (prod.reshape(-1, k) @ t.T).reshape(m, k, k)
        prod[ends[i]] = 1.0 / k
        prod *= e[i][:, None, :]
        if i % RESCALE == 0:
            prod = one(prod)
    out_of = np.empty((m, k))
    b = np.ones(k)
    for j in range(m - 1, -1, -1):
        out_of[j] = b
        b = b @ prod[j]
        b /= b.sum()
    b = out_of
    for i in range(segment - 1, -1, -1):
        b = b @ t.T
        b[ends[i]] = 1.0
        alpha[i] *= b
        b = b * e[i]
        if i % RESCALE == 0:
            b = one(b)
    post = alpha.transpose(1, 0, 2).reshape(-1, k)[:n]
    return post / post.sum(axis=1, keepdims=True)


def _sequences(texts: list[str], labels: np.ndarray, rng: np.random.Generator):
    """Word and label sequences of about ``SEQUENCE_WORDS``: runs of whole sample texts strung together, so languages switch."""
    runs = []
    for text, y in zip(texts, labels, strict=True):
        own = words(text)
        i = 0
        while i < len(own):
            n = int(rng.integers(*RUN_WORDS)) * (8 if rng.random() < 0.5 else 1)
            runs.append((own[i : i + n], y))
            i += n
    order = rng.permutation(len(runs))
    seq, ys = [], []
    for r in order:
        seq += runs[r][0]
        ys += [runs[r][1]] * len(runs[r][0])
        if len(seq) >= SEQUENCE_WORDS:
            yield seq, ys
            seq, ys = [], []
    if seq:
        yield seq, ys


def fit(texts: list[str], langs: list[str], *, epochs: int = EPOCHS, rate: float = 0.4, seed: int = 5, batch: int = 64) -> Model:
    """A CRF fitted on labelled texts by AdaGrad over batches of sequences."""
    names = sorted(set(langs))
    k = len(names)
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    weight, trans, start = np.zeros((NONE + 1, k)), np.zeros((k, k)), np.zeros(k)
    gw, gt, gs = np.full(weight.shape, 1e-2), np.full((k, k), 1e-1), np.full(k, 1e-1)
    for _ in range(epochs):
        todo = list(_sequences(texts, y, rng))
        for at in range(0, len(todo), batch):
            part = todo[at : at + batch]
            flat = [w for ws, _ in part for w in ws]
            gold = np.fromiter((v for _, vs in part for v in vs), "i8", len(flat))
            first = np.zeros(len(flat), bool)
            first[np.cumsum([0] + [len(ws) for ws, _ in part[:-1]])] = True
            codes, vocab = pd.factorize(np.array(flat, object))
            fixed, grams, begins = slots(list(vocab))
            emit = _emissions(weight, fixed, grams, begins)[codes]
            post = forward_backward(emit, first, trans, start)
            diff = -post
            diff[np.arange(len(flat)), gold] += 1
            by_word = np.stack([np.bincount(codes, diff[:, j], len(vocab)) for j in range(k)], axis=1)
            by_letter = np.repeat(by_word, np.diff(np.append(begins, len(grams))), axis=0)
            where = np.concatenate([fixed.T.ravel(), grams.T.ravel()])
            g = np.stack([np.bincount(where, np.concatenate([np.tile(by_word[:, j], fixed.shape[1]), np.tile(by_letter[:, j], 2)]), NONE + 1) for j in range(k)], axis=1)
            g[NONE] = 0
            g /= len(part)
            inside = ~first[1:]
            pair = _pair_posteriors(emit, first, trans, start, post)[inside].sum(axis=0)
            true = np.zeros((k, k))
            np.add.at(true, (gold[:-1][inside], gold[1:][inside]), 1)
            dt = (true - pair) / len(part)
            ds = diff[first].sum(axis=0) / len(part)
            for p, d, acc in ((weight, g, gw), (trans, dt, gt), (start, ds, gs)):
                acc += d * d
                p += rate * d / np.sqrt(acc)
    return Model(names, weight.astype("f4"), trans, start)


def _pair_posteriors(emit, first, trans, start, post):
    """Posterior of each pair of neighbouring labels, from the words' posteriors and the filtered messages."""
    n, k = emit.shape
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    t = np.exp(trans - trans.max())
    alpha = np.empty((n, k))
    # texts are short here: step along all of them at once
    starts = np.flatnonzero(first)
    lens = np.diff(np.append(starts, n))
    a = np.zeros((len(starts), k))
    for i in range(int(lens.max())):
        on = lens > i
        rows = starts[on] + i
        a_on = (np.exp(start - start.max()) if i == 0 else a[on] @ t) * e[rows]
        a[on] = a_on / a_on.sum(axis=1, keepdims=True)
        alpha[rows] = a[on]
    pred = alpha[:-1] @ t  # of the next label before its word is seen
    joint = alpha[:-1, :, None] * t * (post[1:] / np.maximum(pred, 1e-300))[:, None, :]
    return joint / joint.sum(axis=(1, 2), keepdims=True)


def label_words(model: Model, texts: list[str | None]):
    """Per text: its words, and an array of posteriors (words x langs)."""
    lists = [words(t) for t in texts]
    return lists, _posteriors(model, lists)[0]


def _posteriors(model: Model, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors and letters of all words."""
    flat = [w for ws in lists for w in ws]
    if not flat:
        return np.zeros((0, len(model.langs))), np.zeros(0)
    codes, vocab = pd.factorize(np.array(flat, object))
    emit = model.emissions(list(vocab))[codes].astype("f8")
    first = np.zeros(len(flat), bool)
    lens = np.fromiter(map(len, lists), "i8", len(lists))
    first[(np.cumsum(lens) - lens)[lens > 0]] = True
    letters = np.fromiter(map(len, vocab), "f8", len(vocab))[codes]
    return forward_backward(emit, first, model.trans, model.start), letters


def predict_texts(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    if not model.langs:
        return [UND] * len(texts), [0.0] * len(texts)
    lists = [words(t) for t in texts]
    post, weight = _posteriors(model, lists)
    lens = np.fromiter(map(len, lists), "i8", len(lists))
    doc = np.repeat(np.arange(len(lists)), lens)
    total = np.bincount(doc, weight, len(lists))
    mean = np.stack([np.bincount(doc, weight * post[:, j], len(lists)) for j in range(len(model.langs))], axis=1) / np.maximum(total, 1)[:, None]
    best = mean.argmax(axis=1)
    lang = [model.langs[b] if n else UND for b, n in zip(best, lens, strict=True)]
    return lang, [float(min(1.0, m)) if n else 0.0 for m, n in zip(mean[np.arange(len(best)), best], lens, strict=True)]


def stretches(text: str, seed: int) -> str:
    """Words of a text: all of them, or ``STRETCHES`` stretches of ``STRETCH`` words, one from each equal part of it."""
    own = words(text)
    if len(own) <= STRETCH * STRETCHES:
        return " ".join(own)
    part = len(own) / STRETCHES
    at = [int(k * part + random.Random(seed + k).random() * (part - STRETCH)) for k in range(STRETCHES)]
    return " ".join(w for a in at for w in own[a : a + STRETCH])


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Fit on about ``per_lang`` rows of each language, those with the smallest hash of id and text."""
    i, t, y = (F.col(f"`{c}`") for c in (id_col, text_col, lang_col))
    rows = labelled.select(i.alias("i"), t.cast("string").alias("t"), y.cast("string").alias("l")).filter("l is not null and t is not null")
    none = Model([], np.zeros((NONE + 1, 0), "f4"), np.zeros((0, 0)), np.zeros(0))
    counts = rows.groupBy("l").count().limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages in the labelled rows")
    if not counts:
        return none
    span, most = 1 << 30, min(per_lang, SAMPLE_ROWS // len(counts))
    share = F.coalesce(*[F.when(F.col("l") == r["l"], F.lit(min(span, int(span * most / r["count"]) + 1))) for r in counts])
    chosen = rows.withColumn("h", F.xxhash64("i", "t", F.lit(17))).filter(F.pmod("h", F.lit(span)) < share)

    def drawn(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "t", CHUNK_CHARS):
                h = part.column("h").to_pylist()
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("l"), pa.array([stretches(x, k) for x, k in zip(texts, h, strict=True)], pa.string())], ["h", "l", "w"])

    sample = chosen.select("h", "l", "t").mapInArrow(drawn, "h long, l string, w string").groupBy("h", "l").agg(F.first("w").alias("w")).filter("w <> ''").collect()
    sample.sort(key=lambda r: (r["h"], r["l"]))
    return fit([r["w"] for r in sample], [r["l"] for r in sample]) if sample else none


def identify(df: DataFrame, model: Model, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """The ``keep`` columns, and each row's predicted language and score under the names asked for."""
    kept = [f for f in df.schema.fields if f.name in keep]
    text = next((f"c{i}" for i, f in enumerate(kept) if f.name == text_col and f.dataType.simpleString() == "string"), "t")
    names = [f"c{i}" for i in range(len(kept))]
    cols = [F.col(f"`{f.name}`").alias(n) for f, n in zip(kept, names, strict=True)]
    if text == "t":
        cols.append(F.col(f"`{text_col}`").cast("string").alias("t"))
    schema = "".join(f"{n} {f.dataType.simpleString()}, " for f, n in zip(kept, names, strict=True)) + "lang string, score double"
    shared = df.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches):
        m = shared.value
        for batch in batches:
            for rows, texts in text_slices(batch, text, CHUNK_CHARS):
                lang, score = predict_texts(m, texts)
                yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in names], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang", "score"])

    return df.select(*cols).mapInArrow(run, schema).toDF(*[f.name for f in kept], lang_as, score_as)


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1
