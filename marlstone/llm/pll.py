"""Language-model scoring by masked pseudo-likelihood.

Each token is predicted from the two tokens on either side by a small network:
an embedding for each place of the window, summed and squashed, then a softmax
over classes; within its class a token has its share of the corpus counts. A
document's score is the sum of its tokens' conditional log-probabilities.

Tokens are words and marks. A token's bucket is 6 bits of its ending's hash and
12 of its own. The ``TOP`` most frequent buckets are classes of their own, the
other tokens go by their ending's 64 classes.

Corpus statistics: the buckets are counted over all documents (every task sends
its counts, which are summed by bucket; 2**18 sums at most come to the driver).

Training: in each of ``ROUNDS`` rounds every task trains, in numpy, from shared
parameters on its documents' tokens of that round; a hash of the place and the token
deals each token to one round, so each is a target once. The softmax of a step is
taken over the step's targets and ``NEGATIVES`` classes drawn by their frequency,
with the usual correction. The tasks' parameters are averaged with their token counts
as weights, and the next round starts from the average. At most ``TRAIN_TASKS`` tasks
train, so what is summed has a bound. The parameters' number is fixed (about 31,000),
so what is collected and broadcast doesn't grow with the corpus; what is read, counted
and trained on does. Scores use the whole softmax.

Cases: null text counts as empty; a text without tokens has log_prob 0, no tokens
and a null score; texts of any length are scored whole; of equally frequent buckets
those with the smaller number are classes of their own; repeated rows each give their
row; null ids are ids like others; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, written

TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
OWN_BITS, END_BITS = 12, 6
BUCKETS = 1 << (OWN_BITS + END_BITS)
TOP = 192
CLASSES = TOP + (1 << END_BITS)
OFFSETS = (-2, -1, 1, 2)
WIDTH = 24
ROUNDS = 2
BATCH = 2048
NEGATIVES = 48
TRAIN_TASKS = 16384
RATE = 0.1
CHUNK_CHARS = 400_000


def buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each token of all texts, and the tokens of each text."""
    lists = [TOKEN.findall(t.lower()) if t else [] for t in texts]
    lens = np.fromiter(map(len, lists), "i8", len(lists))
    flat = np.array([w for ws in lists for w in ws], object)
    if not len(flat):
        return np.zeros(0, "i8"), lens
    codes, words = pd.factorize(flat)
    own = pd.util.hash_array(words, categorize=False) >> np.uint64(64 - OWN_BITS)
    end = pd.util.hash_array(np.array([w[-2:] for w in words], object)) >> np.uint64(64 - END_BITS)
    return ((end << np.uint64(OWN_BITS)) | own).astype("i8")[codes], lens


def tokenised(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, b): each text's buckets, written to the shared folder once; all passes read it."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for rows, texts in text_slices(batch, "t", CHUNK_CHARS):
                flat, lens = buckets(texts)
                ends = np.concatenate([[0], np.cumsum(lens)]).astype("i4")
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype("i4")))], ["id", "b"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return written(rows.mapInArrow(run, f"id {kind}, b array<int>"), "tokens")


def _chunks(batches, most: int = 80_000):
    """(rows of the batch, buckets, tokens of each row) of about ``most`` tokens from batches of ``tokenised``."""
    for batch in batches:
        col = batch.column("b")
        lens = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype("i8")
        flat = col.flatten().to_numpy().astype("i8")
        ends = np.cumsum(lens)
        part = (ends - lens) // most
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(lens) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a), flat[ends[a] - lens[a] : ends[b - 1]], lens[a:b]


def corpus_counts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> np.ndarray:
    """Tokens of each bucket over all rows."""
    return counted(tokenised(df, id_col, text_col))


def counted(tokens: DataFrame) -> np.ndarray:
    def count(batches):
        total = np.zeros(BUCKETS, "i8")
        for _, bucket, _ in _chunks(batches):
            total += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, "i8")
    for r in tokens.select("b").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas().itertuples():
        out[r.bucket] = r.n
    return out


class Classes:
    """The class of each bucket and its share of the class, from corpus counts."""

    def __init__(self, counts: np.ndarray) -> None:
        order = np.lexsort((np.arange(BUCKETS), -counts))[:TOP]
        self.of = (TOP + (np.arange(BUCKETS) >> OWN_BITS)).astype("i4")
        self.of[order] = np.arange(TOP)
        seen = counts + 0.5
        total = np.bincount(self.of, seen, CLASSES)
        self.log_share = (np.log(seen) - np.log(total)[self.of]).astype("f4")
        self.share = total / total.sum()


class Network:
    """The parameters, as views of one flat array."""

    def __init__(self, flat: np.ndarray | None = None, seed: int = 3) -> None:
        sizes = [(len(OFFSETS), CLASSES + 1, WIDTH), (WIDTH,), (WIDTH, CLASSES), (CLASSES,)]
        n = [int(np.prod(s)) for s in sizes]
        if flat is None:
            flat = np.random.default_rng(seed).normal(0, 0.1, sum(n))
            flat[-CLASSES:] = 0
        self.flat = flat.astype("f4")
        at = np.cumsum([0, *n])
        self.embed, self.bias, self.out, self.out_bias = (self.flat[a:b].reshape(s) for a, b, s in zip(at[:-1], at[1:], sizes, strict=True))

    def hidden(self, context: np.ndarray) -> np.ndarray:
        x = self.bias + self.embed[0][context[:, 0]]
        for j in range(1, len(OFFSETS)):
            x += self.embed[j][context[:, j]]
        return np.tanh(x)

    def log_probs(self, context: np.ndarray, target: np.ndarray, batch: int = 1024) -> np.ndarray:
        out = np.empty(len(target), "f4")
        rows = np.arange(batch)
        # hidden units lie between -1 and 1, so this bounds all logits
        safe = float((np.abs(self.out).sum(axis=0) + np.abs(self.out_bias)).max()) < 80
        for a in range(0, len(target), batch):
            z = self.hidden(context[a : a + batch]) @ self.out
            z += self.out_bias
            t = z[rows[: len(z)], target[a : a + batch]]
            if not safe:
                top = z.max(axis=1)
                z -= top[:, None]
                t -= top
            np.exp(z, out=z)
            out[a : a + batch] = t - np.log(z.sum(axis=1))
        return out

    def train(self, context: np.ndarray, target: np.ndarray, memory: np.ndarray, share: np.ndarray, rng: np.random.Generator) -> None:
        """One AdaGrad pass over the targets; ``memory`` holds the squared gradients so far, ``share`` the classes' frequencies."""
        edges = np.cumsum(share)
        log_share = np.log(np.maximum(share, 1e-12)).astype("f4")
        at = self.embed.size
        m_embed, m_bias = memory[:at].reshape(self.embed.shape), memory[at : at + WIDTH]
        m_out, m_ob = memory[at + WIDTH : -CLASSES].reshape(self.out.shape), memory[-CLASSES:]
        place, where = np.arange(WIDTH), np.full(CLASSES, -1)
        for a in range(0, len(target), BATCH):
            c, y = context[a : a + BATCH], target[a : a + BATCH]
            drawn, times = np.unique(np.minimum(np.searchsorted(edges, rng.random(NEGATIVES) * edges[-1]), CLASSES - 1), return_counts=True)
            where[drawn] = np.arange(len(drawn))
            h = self.hidden(c)
            own = self.out.T[y]
            # logits less the log of how often a class is expected among the drawn ones
            z = h @ self.out[:, drawn]
            z += self.out_bias[drawn] - log_share[drawn] - np.log(NEGATIVES / times).astype("f4")
            hit = where[y]
            known = np.flatnonzero(hit >= 0)
            z[known, hit[known]] = -np.inf
            where[drawn] = -1
            t = np.einsum("ij,ij->i", h, own) + self.out_bias[y] - log_share[y] - np.float32(np.log(NEGATIVES))
            top = np.maximum(t, z.max(axis=1))
            z -= top[:, None]
            np.exp(z, out=z)
            t = np.exp(t - top)
            whole = t + z.sum(axis=1)
            z /= whole[:, None]
            t = t / whole - 1
            dh = (z @ self.out[:, drawn].T + t[:, None] * own) * (1 - h * h)
            g_out = np.bincount((y[:, None] * WIDTH + place).ravel(), (t[:, None] * h).ravel(), CLASSES * WIDTH).reshape(CLASSES, WIDTH).T
            g_out[:, drawn] += h.T @ z
            g_ob = np.bincount(y, t, CLASSES)
            g_ob[drawn] += z.sum(axis=0)
            for p, g, m in ((self.out, g_out, m_out), (self.out_bias, g_ob, m_ob), (self.bias, dh.sum(axis=0), m_bias)):
                m += g * g
                p -= RATE * g / np.sqrt(m)
            flat = dh.ravel()
            for j in range(len(OFFSETS)):
                g = np.bincount((c[:, j : j + 1] * WIDTH + place).ravel(), flat, (CLASSES + 1) * WIDTH).reshape(CLASSES + 1, WIDTH)
                m_embed[j] += g * g
                self.embed[j] -= RATE * g / np.sqrt(m_embed[j])


def windows(cls: np.ndarray, lens: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """(tokens x offsets) classes of the neighbours of each token, or of those ``of``; ``CLASSES`` beyond the text's ends."""
    reach = max(map(abs, OFFSETS))
    # texts laid out with marks between them, so that a neighbour beyond an end is a mark
    gap = reach * np.arange(1, len(lens) + 1)
    at = np.arange(len(cls)) + np.repeat(gap, lens)
    laid = np.full(len(cls) + reach * (len(lens) + 1), CLASSES, "i4")
    laid[at] = cls
    at = at if of is None else at[of]
    out = np.empty((len(at), len(OFFSETS)), "i4")
    for j, d in enumerate(OFFSETS):
        out[:, j] = laid[at + d]
    return out


def of_round(bucket: np.ndarray, lens: np.ndarray, round_: int, rounds: int = ROUNDS) -> np.ndarray:
    """The tokens that are targets in a round: each in one, by a hash of its place and itself."""
    place = (np.arange(len(bucket)) - np.repeat(np.cumsum(lens) - lens, lens)).astype("u8")
    x = (place * np.uint64(0x9E3779B97F4A7C15) + bucket.astype("u8") * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    return np.flatnonzero((x >> np.uint64(33)) % np.uint64(rounds) == round_)


def train(tokens: DataFrame, classes: Classes, *, rounds: int = ROUNDS) -> Network:
    """Parameters averaged over all tasks' passes over ``tokenised`` rows, ``rounds`` times."""
    sc = tokens.sparkSession.sparkContext
    net = Network()
    for r in range(rounds):
        shared = sc.broadcast((net.flat, classes.of, classes.share))

        def fit(batches, r=r, shared=shared):
            flat, of, share = shared.value
            own = Network(flat.copy())
            memory = np.full(len(own.flat), 1.0, "f4")
            rng = np.random.default_rng(r)
            n = 0
            for _, bucket, lens in _chunks(batches):
                if len(bucket):
                    cls = of[bucket]
                    at = of_round(bucket, lens, r, rounds)
                    own.train(windows(cls, lens, at), cls[at], memory, share, rng)
                    n += len(at)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own.flat), dtype="i4")), pa.array(own.flat.astype("f8") * n), pa.array(np.full(len(own.flat), float(n)))], ["i", "x", "n"])

        total = tokens.select("b").coalesce(TRAIN_TASKS).mapInArrow(fit, "i int, x double, n double").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).toPandas()
        if len(total):
            flat = net.flat.copy()
            flat[total["i"].to_numpy()] = total["x"].to_numpy()
            net = Network(flat)
    return net


def score_texts(net: Network, classes: Classes, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and summed log-probabilities of each text."""
    return _score(net, classes, *buckets(texts))


def _score(net: Network, classes: Classes, bucket: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(bucket):
        return lens, np.zeros(len(lens))
    cls = classes.of[bucket]
    lp = net.log_probs(windows(cls, lens), cls).astype("f8") + classes.log_share[bucket]
    return lens, np.bincount(np.repeat(np.arange(len(lens)), lens), lp, len(lens))


def score(tokens: DataFrame, net: Network, classes: Classes, *, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, log_prob, score) of ``tokenised`` rows: score is log_prob a token."""
    shared = tokens.sparkSession.sparkContext.broadcast((net, classes))
    kind = tokens.schema["id"].dataType.simpleString()

    def run(batches):
        model, by = shared.value
        for rows, bucket, lens in _chunks(batches):
            n, lp = _score(model, by, bucket, lens)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(n), pa.array(lp)], [id_col, "n_tokens", "log_prob"])

    scored = tokens.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, log_prob double")
    return scored.withColumn("score", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def pseudo_likelihood(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count, train and score over all of ``df``; texts are cut into tokens once."""
    tokens = tokenised(df, id_col, text_col)
    classes = Classes(counted(tokens))
    return score(tokens, train(tokens, classes), classes, id_col=id_col)
