"""Toxicity by a counterfactual-regularised classifier of sentences.

A text's logit is a weighted sum over the words of its sentences and their beginnings
and ends of four and five letters, each counted once a sentence, divided by the square
root of the text's number of words: neither one chance hit in a long text nor the
length of a text decides, and two insults in a short one do.

In labelled sentences that name a group, identity terms are swapped for others of the
same list (``IDENTITY``), and training adds the squared change of the sentence's logit
(three swaps a sentence) to the loss: what a sentence says about a group may count, which group may not. Terms
that labelled toxic texts happen to name lose their weight, and neutral mentions of
these groups aren't flagged.

Learned from a bounded sample: ``MOST_ROWS`` labelled rows at most, drawn by hashes of
id and text, each distinct text once with its rows' majority label. The sample is
written to the shared folder; features are counted in tasks, first by hashed place,
then by name where a place tells the labels apart, and the ``FEATURES`` best ones are
kept. Only these features of each text come to the driver, as numbers.
Scoring is one pass over whole texts without a shuffle.

Cases: null and empty texts, and texts without a word, hold nothing toxic: score 0; rows
without an id, a label or a text aren't learned from; without labelled rows of both
kinds every score is 0; a text with as many toxic as clean labels is clean; repeated
rows each give their row; sentences longer than ``WORDS`` words are cut; an empty table
gives an empty result; columns that aren't kept are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, made, text_slices, written

#: The documented bound of what is fitted on, and how much of it is kept.
MOST_ROWS, FEATURES = 40_000, 8192
LOG2_PLACES, LEAST_GAIN = 18, 8.0
WORDS, CHUNK_CHARS = 64, 2_000_000
THRESHOLD = 0.3
PENALTY, STEPS, RATE, DECAY, BATCH = 10.0, 3000, 0.5, 1e-5, 256
#: Terms that name groups; those of a list may stand for each other.
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "transgender", "heterosexual"),
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("immigrants", "refugees", "foreigners", "citizens", "locals"),
    ("deaf", "blind", "disabled", "autistic", "elderly", "young"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("mujeres", "hombres", "chicas", "chicos"),
)
_TOKEN = re.compile(r"\w+|[.!?\n]+")


@dataclass
class Model:
    number: dict[str, int]  # of each feature
    weight: np.ndarray
    bias: float


def features(word: str) -> list[str]:
    n = len(word)
    return [word, *(f"^{word[:k]}" for k in (4, 5) if n > k), *(f"{word[-k:]}$" for k in (4, 5) if n > k)]


def sentences(texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(number of each word, the distinct words, each word's sentence, each sentence's text)."""
    tokens: list[str] = []
    count = []
    for t in texts:
        found = _TOKEN.findall(t.lower()) if t else []
        tokens += found
        count.append(len(found))
    if not tokens:
        return np.zeros(0, "i8"), [], np.zeros(0, "i8"), np.zeros(0, "i8")
    codes, names = pd.factorize(np.array(tokens, object))
    stop = np.fromiter((not (w[0].isalnum() or w[0] == "_") and w[0] in ".!?\n" for w in names), bool, len(names))[codes]
    text = np.repeat(np.arange(len(texts)), count)
    new = np.zeros(len(codes), bool)
    new[0] = True
    new[1:] = stop[:-1] | (text[1:] != text[:-1])
    run = np.cumsum(new) - 1
    at = np.arange(len(codes)) - np.flatnonzero(new)[run]
    new |= at % WORDS == 0
    keep = ~stop
    run = np.cumsum(new)[keep]
    first = np.flatnonzero(np.diff(run, prepend=-1))
    of_text = text[keep][first]
    return codes[keep], list(names), np.cumsum(np.diff(run, prepend=run[0] if len(run) else 0) > 0), of_text


def hits(codes: np.ndarray, words: list[str], sentence: np.ndarray, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, feature) pairs, each once, sorted."""
    per = [[number[f] for f in features(w) if f in number] for w in words]
    size = np.fromiter(map(len, per), "i8", len(per))
    flat = np.fromiter((f for p in per for f in p), "i8", int(size.sum()))
    begin = np.cumsum(size) - size
    n = size[codes]
    total = np.repeat(np.cumsum(n) - n, n)
    feature = flat[np.repeat(begin[codes], n) + np.arange(len(total)) - total]
    wide = len(number) + 1
    pair = np.unique(np.repeat(sentence, n) * wide + feature)
    return pair // wide, pair % wide


def _others(identity: tuple[tuple[str, ...], ...]) -> dict[str, tuple[int, int]]:
    return {w: (g, i) for g, terms in enumerate(identity) for i, w in enumerate(terms)}


def _gain(one: np.ndarray, zero: np.ndarray, ones: int, zeros: int) -> np.ndarray:
    """Log-likelihood ratio (G squared) of a feature's texts by label."""
    n = ones + zeros
    out = np.zeros(len(one))
    for k, row in ((one, ones), (zero, zeros)):
        for seen, col in ((k, one + zero), (row - k, n - one - zero)):
            out += np.where(seen > 0, seen * np.log(np.maximum(seen, 1) * n / np.maximum(row * col, 1)), 0)
    return 2 * out


def sampled(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, most: int = MOST_ROWS) -> DataFrame:
    """(h, y, text): distinct labelled texts, about ``most`` at most, written to the shared folder."""
    span = 1 << 30
    share = lambda n: min(span, int(span * most / max(n, 1)) + 1)
    near = lambda salt, *c: F.pmod(F.xxhash64(*c, F.lit(salt)), F.lit(span))
    y = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y")).filter("id is not null and y is not null").groupBy("id").agg(F.avg("y").alias("y"))
    y = y.filter(near(3, "id") < share(y.count()))  # about ``most`` rows of two numbers
    t = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    met = t.join(F.broadcast(y), "id")
    n = met.select("id").count()
    rows = met.filter("text <> ''").withColumn("h", F.xxhash64("text")).filter(near(5, "id", "h") < share(n))
    return written(rows.groupBy("h").agg((F.avg("y") > 0.5).cast("int").alias("y"), F.first("text").alias("text")), "toxic", most, 8)


def _counted(sample: DataFrame, chosen: np.ndarray | None) -> DataFrame:
    """(f, y, n): in how many texts of each label a feature occurs; by hashed place, or by name within the chosen places."""
    mask = (1 << LOG2_PLACES) - 1
    kind = "int" if chosen is None else "string"
    shared = None if chosen is None else sample.sparkSession.sparkContext.broadcast(chosen)  # a byte a place

    def run(batches):
        seen = np.zeros((2, mask + 1), "i8")
        named: list[Counter] = [Counter(), Counter()]
        for batch in batches:
            for rows, texts in text_slices(batch, "text", CHUNK_CHARS):
                y = rows.column("y").to_numpy()
                codes, words, sentence, of_text = sentences(texts)
                if not len(codes):
                    continue
                text = of_text[sentence]
                if shared is None:
                    places = [[zlib.crc32(f.encode()) & mask for f in features(w)] for w in words]
                    size = np.fromiter(map(len, places), "i8", len(places))
                    flat = np.fromiter((f for p in places for f in p), "i8", int(size.sum()))
                    once = np.unique(text * len(words) + codes)
                    doc, word = once // len(words), once % len(words)
                    n = size[word]
                    total = np.repeat(np.cumsum(n) - n, n)
                    pair = np.unique(np.repeat(doc, n) << LOG2_PLACES | flat[np.repeat((np.cumsum(size) - size)[word], n) + np.arange(len(total)) - total])
                    for k in (0, 1):
                        seen[k] += np.bincount(pair[y[pair >> LOG2_PLACES] == k] & mask, minlength=mask + 1)
                else:
                    names = sorted({f for w in words for f in features(w) if shared.value[zlib.crc32(f.encode()) & mask]})
                    number = {f: i for i, f in enumerate(names)}
                    doc, f = hits(codes, words, text, number)
                    for k in (0, 1):
                        n = np.bincount(f[y[doc] == k], minlength=len(names))
                        named[k].update({names[i]: int(n[i]) for i in np.flatnonzero(n)})
        for k in (0, 1):
            at, n = (np.flatnonzero(seen[k]), seen[k][seen[k] > 0]) if shared is None else (list(named[k]), list(named[k].values()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32() if shared is None else pa.string()), pa.array([k] * len(n), pa.int32()), pa.array(n, pa.int64())], ["f", "y", "n"])

    counted = sample.select("y", "text").mapInArrow(run, f"f {kind}, y int, n long").groupBy("f")
    return counted.agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("one"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("zero"))


def selected(sample: DataFrame, ones: int, zeros: int, identity: tuple[tuple[str, ...], ...], most: int = FEATURES) -> list[str]:
    """The features that tell the labels apart best, and those of identity terms."""
    rows = _counted(sample, None).toArrow()
    at, one, zero = (rows.column(c).to_numpy() for c in ("f", "one", "zero"))
    terms = sorted({f for group in identity for w in group for f in features(w)})
    chosen = np.zeros(1 << LOG2_PLACES, "u1")
    chosen[at[(_gain(one, zero, ones, zeros) >= LEAST_GAIN)]] = 1
    named = _counted(sample, chosen).filter("one + zero > 1")
    rows = named.orderBy(F.desc(F.abs(F.col("one") / ones - F.col("zero") / zeros)), "f").limit(4 * most).toArrow()
    f, one, zero = rows.column("f").to_pylist(), rows.column("one").to_numpy(), rows.column("zero").to_numpy()
    gain = _gain(one, zero, ones, zeros)
    best = sorted((-g, x) for g, x in zip(gain.tolist(), f, strict=True) if g >= LEAST_GAIN)[:most]
    return sorted({x for _, x in best} | set(terms))


@dataclass
class Bags:
    """The labelled texts as numbers: label, words, number of features (by sentence) of each text, all features end to end, and by text its swaps."""

    y: np.ndarray
    words: np.ndarray
    size: np.ndarray
    flat: np.ndarray
    swaps: dict[int, list[dict]]


def bags(sample: DataFrame, names: list[str], identity: tuple[tuple[str, ...], ...]) -> Bags:
    """Features of each text, and for each swap of identity terms the sentence's words, own and other features."""
    shared = sample.sparkSession.sparkContext.broadcast((names, identity))  # some thousand names
    schema = "h long, y int, words long, f array<int>, swaps array<struct<words: int, own: array<int>, other: array<int>>>"

    def run(batches):
        names, identity = shared.value
        number, group = {f: i for i, f in enumerate(names)}, _others(identity)
        known = lambda ws: sorted({number[x] for w in set(ws) for x in features(w) if x in number})
        kind = pa.list_(pa.struct([("words", pa.int32()), ("own", pa.list_(pa.int32())), ("other", pa.list_(pa.int32()))]))
        for batch in batches:
            for rows, texts in text_slices(batch, "text", CHUNK_CHARS):
                codes, words, sentence, of_text = sentences(texts)
                s, f = hits(codes, words, sentence, number)
                term = np.fromiter((w in group for w in words), bool, len(words))
                swaps: list[list[tuple]] = [[] for _ in texts]
                for t in np.unique(sentence[term[codes]]).tolist() if len(codes) else []:
                    inside = [words[c] for c in codes[np.searchsorted(sentence, t) : np.searchsorted(sentence, t, "right")]]
                    for step in (1, 2, 3):
                        other = [identity[group[w][0]][(group[w][1] + step) % len(identity[group[w][0]])] if w in group else w for w in inside]
                        swaps[int(of_text[t])].append((len(inside), known(inside), known(other)))
                cuts = np.searchsorted(of_text[s], np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("h"), rows.column("y"), pa.array(np.bincount(of_text[sentence], minlength=len(texts))),
                        pa.array([f[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)], pa.list_(pa.int32())), pa.array([[dict(zip(("words", "own", "other"), x, strict=True)) for x in sw] for sw in swaps], kind),
                    ],
                    ["h", "y", "words", "f", "swaps"],
                )

    got = sample.select("h", "y", "text").mapInArrow(run, schema).toArrow().sort_by("h")
    size = pc.list_value_length(got.column("f")).to_numpy()
    swapped = np.flatnonzero(pc.list_value_length(got.column("swaps")).to_numpy())
    swaps = dict(zip(swapped.tolist(), got.column("swaps").take(pa.array(swapped)).to_pylist(), strict=True))
    return Bags(got.column("y").to_numpy(), got.column("words").to_numpy(), size.astype("i8"), pc.list_flatten(got.column("f")).to_numpy(), swaps)


def fit(bag: Bags, n: int, *, penalty: float = PENALTY, steps: int = STEPS, rate: float = RATE, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights of the features and the bias, by AdaGrad on the likelihood and the counterfactual penalty."""
    w, b = np.zeros(n), -2.0
    gw, gb = np.full(n, 1e-3), 1e-3
    rng = np.random.default_rng(seed)
    rows, size, flat = len(bag.y), bag.size, bag.flat
    y, begin = bag.y.astype("f8"), np.cumsum(size) - size
    scale = 1 / np.sqrt(np.maximum(bag.words, 1))
    for _ in range(-(-steps * BATCH // rows)):  # times over all rows
        order = rng.permutation(rows)
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            k = size[part]
            doc = np.repeat(np.arange(len(part)), k)
            f = flat[np.repeat(begin[part] - np.cumsum(k) + k, k) + np.arange(len(doc))]
            z = np.bincount(doc, w[f], len(part)) * scale[part] + b
            d = y[part] - 1 / (1 + np.exp(-z))
            dw, db = np.bincount(f, (d * scale[part])[doc], n), d.mean()
            for i in part.tolist():
                for x in bag.swaps.get(i, ()):
                    own, other = np.array(x["own"], "i8"), np.array(x["other"], "i8")
                    change = 2 * penalty * (w[own].sum() - w[other].sum()) / x["words"]
                    np.add.at(dw, own, -change)
                    np.add.at(dw, other, change)
            dw = dw / len(part) - DECAY * w
            gw += dw * dw
            gb += db * db
            w += rate * dw / np.sqrt(gw)
            b += rate * db / np.sqrt(gb)
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", identity: tuple[tuple[str, ...], ...] = IDENTITY, penalty: float = PENALTY, most_rows: int = MOST_ROWS) -> Model:
    mark = made()
    sample = sampled(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, most=most_rows)
    by = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(by) < 2:
        forget(docs.sparkSession, mark, ())
        return Model({}, np.zeros(0, "f4"), -np.inf)
    names = selected(sample, by[1], by[0], identity)
    w, b = fit(bags(sample, names, identity), len(names), penalty=penalty)
    forget(docs.sparkSession, mark, ())
    kept = [i for i in range(len(names)) if w[i]]
    return Model({names[i]: j for j, i in enumerate(kept)}, w[kept].astype("f4"), b)


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    if not np.isfinite(model.bias):
        return np.zeros(len(texts))
    codes, words, sentence, of_text = sentences(texts)
    if not len(codes):
        return np.zeros(len(texts))
    s, f = hits(codes, words, sentence, model.number)
    many = np.bincount(of_text[sentence], minlength=len(texts))
    z = np.bincount(of_text[s], model.weight[f], len(texts)) / np.sqrt(np.maximum(many, 1)) + model.bias
    return np.where(many > 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0)


def judged(df: DataFrame, model: Model, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD, score_as: str = "score", predicted_as: str = "predicted") -> DataFrame:
    """The ``keep`` columns, each row's score, and 1 where it reaches the threshold."""
    kept = [f for f in df.schema.fields if f.name in keep]
    names = [f"c{i}" for i in range(len(kept))]
    schema = "".join(f"{n} {f.dataType.simpleString()}, " for n, f in zip(names, kept, strict=True)) + "score double"
    shared = df.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches):
        m = shared.value
        for batch in batches:
            for rows, texts in text_slices(batch, "t", CHUNK_CHARS):
                yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in names], pa.array(scores(m, texts))], [*names, "score"])

    rows = df.select(*[F.col(f"`{f.name}`").alias(n) for n, f in zip(names, kept, strict=True)], F.col(f"`{text_col}`").cast("string").alias("t"))
    out = rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return out.toDF(*[f.name for f in kept], score_as, predicted_as)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
