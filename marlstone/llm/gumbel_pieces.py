"""SentencePiece encoding and decoding with Gumbel top-k sampling without replacement.

The vocabulary of a public SentencePiece model is read, never trained. Its pieces
are ordered by merge rank; the lattice gives the piece of rank r the probability
1/(r + RANK_SHIFT), normalised, so the pieces form a unigram model. Characters
without a piece are spelled as byte pieces. As no piece of the vocabulary has a
blank mark after another character, a text's lattice is the chain of the lattices
of its blank-led units, and a unit that occurs again is looked up once a chunk.

Sampling is a top-down perturbed A-star search. The root's maximum is a Gumbel
variate; the best segmentation is drawn step by step from the lattice (backward
log-sums give exact step probabilities). All other segmentations are parted by
the step at which they leave it and each part gets its maximum, a Gumbel variate
truncated at the value of what it left. The part with the highest maximum is
searched next: another piece is drawn at that step, the rest from the lattice,
and it is parted in turn. The first k segmentations are distinct and are a sample
without replacement; the k+1-st maximum is the threshold of their inclusion
probabilities, 1 - exp(-exp(log_prob - threshold)).

All texts of a chunk are searched at once. Random numbers are hashes of the row's
key, the sample, and the place in the text, so results depend on nothing else.

Cases: null text counts as empty; empty text has one segmentation, of no pieces,
with log-probability 0 and inclusion 1; a text with fewer than k segmentations
gives all it has; texts are used whole; a null key is a key like others, and rows
with the same key and text give the same samples; an empty table gives an empty
result; other columns are ignored. Decoding drops ids outside the vocabulary's
texts (control ids), takes null for empty, and replaces bytes that aren't UTF-8.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
RANK_SHIFT = 20.0
CHUNK_CHARS = 1_000_000
MARK = "▁"
UNIT = re.compile("▁+[^▁]*")
_P = np.uint64(0x9E3779B97F4A7C15)


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, *place) -> np.ndarray:
    """In (0, 1), from 64-bit keys and integers."""
    x = key.astype("u8")
    with np.errstate(over="ignore"):
        for p in place:
            x = _hash(x + np.asarray(p).astype("u8") * _P + np.uint64(1))
    return ((x >> np.uint64(11)).astype("f8") + 0.5) / (1 << 53)


class Vocabulary:
    """Pieces, log-probabilities, spellings and a hashed prefix table of a SentencePiece model."""

    def __init__(self, model_file: str = MODEL_FILE) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.size = n
        self.byte_id = np.zeros(256, "i4")
        self.pieces: list[bytes | str | None] = [None] * n
        rank: dict[int, float] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.pieces[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} has a blank mark inside; units can't be searched apart")
                self.pieces[i] = piece
                rank[i] = min(-sp.get_score(i), n)
        prob = {i: 1 / (r + RANK_SHIFT) for i, r in rank.items()}
        total = sum(prob.values()) + 256 / (n + RANK_SHIFT)
        self.byte_logp = float(-np.log((n + RANK_SHIFT) * total))
        table: dict[int, tuple[int, float]] = {}
        self.longest = 0
        for i, p in prob.items():
            h, piece = 0, self.pieces[i]
            self.longest = max(self.longest, len(piece))
            for j, c in enumerate(piece):
                h = (h * 0x100000001B3 + ord(c) + 1) & (1 << 64) - 1
                last = j == len(piece) - 1
                if last or h not in table:
                    table[h] = (i, float(np.log(p / total))) if last else table.get(h, (-1, -np.inf))
        self.keys = np.array(sorted(table), "u8")
        self.ids = np.array([table[int(h)][0] for h in self.keys], "i4")
        self.logp = np.array([table[int(h)][1] for h in self.keys], "f8")
        # open addressing, a quarter full
        self.bits = max(4, (4 * len(self.keys) - 1).bit_length())
        self.at = np.full(1 << self.bits, -1, "i4")
        self.held = np.zeros(1 << self.bits, "u8")
        todo = np.arange(len(self.keys))
        place = self._place(self.keys)
        while len(todo):
            first = np.unique(place, return_index=True)[1]
            first = first[self.at[place[first]] < 0]
            self.at[place[first]], self.held[place[first]] = todo[first], self.keys[todo[first]]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, place = todo[rest], (place[rest] + 1) & (1 << self.bits) - 1
        spelled = [(p if isinstance(p, bytes) else p.replace(MARK, " ").encode()) if p is not None else b"" for p in self.pieces]
        self.spelling = np.frombuffer(b"".join(spelled), "u1")
        self.n_bytes = np.fromiter(map(len, spelled), "i8", n)
        self.spelled_at = np.cumsum(self.n_bytes) - self.n_bytes

    def _place(self, h: np.ndarray) -> np.ndarray:
        return ((h * _P) >> np.uint64(64 - self.bits)).astype("i8")

    def find(self, h: np.ndarray) -> np.ndarray:
        """The index of each hash among ``keys``, or -1."""
        place = self._place(h)
        out = self.at[place]
        other = np.flatnonzero((out >= 0) & (self.held[place] != h))
        place = place[other]
        while len(other):
            place = (place + 1) & (1 << self.bits) - 1
            got = self.at[place]
            out[other] = got
            again = (got >= 0) & (self.held[place] != h[other])
            other, place = other[again], place[again]
        return out

    def spell(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all texts' ids, end to end, with a blank for each mark; each text's begin and end among them."""
        n = np.where((ids >= 0) & (ids < self.size), self.n_bytes[np.clip(ids, 0, self.size - 1)], 0)
        ends = np.cumsum(n)
        where = np.repeat(self.spelled_at[np.clip(ids, 0, self.size - 1)] - (ends - n), n)
        where += np.arange(len(where))
        sums = np.concatenate([[0], ends])
        return self.spelling[where].tobytes(), sums[np.concatenate([[0], np.cumsum(counts)])]

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Each text of its ids, laid end to end."""
        out, cuts = self.spell(np.asarray(ids, "i8"), np.asarray(counts, "i8"))
        return [out[a:b].decode("utf-8", "replace")[1:] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids) -> str:
        return self.decode_all(np.asarray(ids, "i8"), np.array([len(ids)]))[0]


class Lattice:
    """The lattices of distinct units, laid end to end by character, with a place for each unit's end.

    The edges that leave a position lie together, in order of length."""

    def __init__(self, vocab: Vocabulary, units: list[str]) -> None:
        lens = np.fromiter(map(len, units), "i8", len(units)) + 1
        self.start = np.cumsum(lens) - lens
        self.code = c = np.frombuffer(("\0".join(units) + "\0").encode("utf-32-le", "surrogatepass"), "u4")
        n = len(c)
        self.left = left = (np.repeat(self.start + lens, lens) - np.arange(n) - 1).astype("i4")
        longest = int(left.max())
        at = np.flatnonzero(left > 0)
        h = np.zeros(len(at), "u8")
        self.width = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        found = []
        count = np.zeros(n, "i4")
        for k in range(min(vocab.longest, longest)):
            if k:
                on = left[at] > k
                at, h = at[on], h[on]
            h = h * np.uint64(0x100000001B3) + c[at + k] + np.uint64(1)
            i = vocab.find(h)
            on = i >= 0
            if k == 0:  # characters without a piece become bytes
                ids = np.where(on, vocab.ids[i], -1)
                found.append((at, ids, np.where(ids >= 0, vocab.logp[i], self.width[at] * vocab.byte_logp)))
                count[at] = 1
            at, h, i = at[on], h[on], i[on]
            if k:
                ids = vocab.ids[i]
                got = ids >= 0
                found.append((at[got], ids[got], vocab.logp[i[got]]))
                count[at[got]] += 1
        # edges by characters left, so that each round of the sums below takes a slice
        order = np.argsort(left.astype("u2") if longest < 1 << 16 else left, kind="stable")
        per = count[order]
        ends = np.cumsum(per, dtype="i8")
        begin = ends - per
        self.first = np.empty(n, "i8")
        self.first[order] = begin
        total = int(ends[-1])
        self.piece, self.src, self.to = np.empty(total, "i4"), np.empty(total, "i4"), np.empty(total, "i4")
        w = np.empty(total)
        slot = self.first.copy()
        for k, (where, ids, logp) in enumerate(found):
            e = slot[where]
            self.piece[e], self.src[e], self.to[e], w[e] = ids, where, where + k + 1, logp
            slot[where] = e + 1
        self.count = count
        # backward log-sums, by characters left; the weights become step probabilities
        beta = np.zeros(n)
        bounds = np.cumsum(np.bincount(left, minlength=longest + 1))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            lo, hi = begin[a], ends[b - 1]
            at, num = begin[a:b] - lo, per[a:b]
            x = w[lo:hi]
            x += beta[self.to[lo:hi]]
            pivot = x[at]
            x -= np.repeat(pivot, num)
            np.exp(x, out=x)
            s = np.add.reduceat(x, at)
            beta[order[a:b]] = pivot + np.log(s)
            x /= np.repeat(s, num)
        self.prob = w
        self.cum = w.copy()
        for j in range(1, int(count.max())):
            e = begin[per > j] + j
            self.cum[e] += self.cum[e - 1]
        self.cum[ends[per > 0] - 1] = np.inf  # what is left falls to the last one
        with np.errstate(divide="ignore"):
            self.logp = np.log(w)
            self.log_rest = np.log1p(-np.minimum(w, 1.0))


def _draw(lat: Lattice, pos: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The edge that is taken at each position."""
    e = lat.first[pos]
    on = np.flatnonzero(lat.cum[e] <= u)
    while len(on):
        e[on] += 1
        on = on[lat.cum[e[on]] <= u[on]]
    return e


def _walk(lat: Lattice, pos: np.ndarray, key: np.ndarray, salt: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """From each position to its unit's end: (walkers, edges) of each round of steps."""
    who = np.arange(len(pos))
    out = []
    step = 0
    while len(who):
        e = _draw(lat, pos, uniform(key, salt + (step << 8)))
        out.append((who, e))
        pos = lat.to[e]
        nxt = np.flatnonzero(lat.left[pos] > 0)
        who, pos, key = who[nxt], pos[nxt], key[nxt]
        step += 1
    return out


class _Path:
    """One segmentation of each text that has it: its steps' edges in order, and the occurrence of a unit that each is in."""

    def __init__(self, edge: np.ndarray, unit: np.ndarray, count: np.ndarray) -> None:
        self.edge, self.unit, self.count = edge, unit, count
        self.begin = np.concatenate([[0], np.cumsum(count)])
        self.barred = np.zeros(len(edge), "u8")  # edges, by slot, that have left the step's part beside its own


def _assemble(n_steps: int, extra: np.ndarray, rounds, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges and units of all steps, and each unit's begin: ``extra`` steps of a unit come before those that it walks."""
    count = extra.copy()
    for who, _ in rounds:
        count[who] += 1
    begin = np.cumsum(count) - count
    edge = np.empty(n_steps + sum(len(who) for who, _ in rounds), "i8")
    at = begin + extra
    for i, (who, e) in enumerate(rounds):
        edge[at[who] + i] = e
    return edge, np.repeat(units, count), begin


def _truncated(loc: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variates with these locations, at most ``most``."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return np.where(np.isneginf(loc), -np.inf, loc - np.log(np.exp(loc - most) - np.log(u)))


def _runs(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1 ... ``count[0]`` of them, then those of the next."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - count), count)


def search(vocab: Vocabulary, texts: list[str | None], keys: np.ndarray, k: int):
    """For each sample: (texts that have it, _Path, log_prob, perturbed value); and the thresholds, -inf if none is left."""
    n = len(texts)
    lists = [UNIT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
    lens = np.fromiter(map(len, lists), "i8", n)
    flat = [w for ws in lists for w in ws]
    del lists
    code, words = pd.factorize(np.array(flat, object)) if flat else (np.zeros(0, "i8"), [])
    lat = Lattice(vocab, list(words)) if flat else None
    doc_of = np.repeat(np.arange(n), lens)
    first_unit = np.cumsum(lens) - lens
    keys = keys.astype("u8")
    samples = []
    g = -np.log(-np.log(uniform(keys, 0, 1)))
    live = np.arange(n)
    if lat is None:
        return lat, [(live, None, np.zeros(n), g)], np.full(n, -np.inf)
    unit_of = np.arange(len(code)) - first_unit[doc_of]
    unit_key = _hash(keys[doc_of] + (unit_of.astype("u8") + np.uint64(1)) * _P)
    begin_at = lat.start[code]
    edge, unit, _ = _assemble(0, np.zeros(len(code), "i8"), _walk(lat, begin_at, unit_key, 2), np.arange(len(code)))
    path = _Path(edge, unit, np.bincount(doc_of[unit], minlength=n))
    paths: list[_Path] = []
    own_from = None  # the steps from which a path owns what leaves it
    values = g
    while True:
        # log-probabilities before each step, and the parts that leave at each step
        logp = lat.logp[path.edge]
        run = np.cumsum(logp)
        zero = np.concatenate([[0.0], run])
        sums = zero[path.begin[1:]] - zero[path.begin[:-1]]
        run -= logp
        run -= np.repeat(zero[path.begin[:-1]], path.count)
        path.before = run
        loc = run + lat.log_rest[path.edge]
        step = np.arange(len(loc)) - np.repeat(path.begin[:-1], path.count)
        if own_from is not None:
            loc[step < np.repeat(own_from, path.count)] = -np.inf
        on = np.flatnonzero(loc > -np.inf)
        doc = doc_of[path.unit[on]]
        path.g = np.full(len(loc), -np.inf)
        path.g[on] = _truncated(loc[on], values[doc], uniform(keys[doc], (step[on] << 10) + (3 + len(paths))))
        paths.append(path)
        samples.append((live, path, sums[live], values[live]))
        # the best part of each text over all its paths
        best = np.full(n, -np.inf)
        which = np.zeros(n, "i8")
        for i, p in enumerate(paths):
            has = np.flatnonzero(p.count > 0)
            if not len(has):
                continue
            top = np.maximum.reduceat(p.g, p.begin[:-1][has])
            better = top > best[has]
            best[has[better]], which[has[better]] = top[better], i
        if len(samples) == k:
            return lat, samples, best
        live = np.flatnonzero(best > -np.inf)
        if not len(live):
            return lat, samples, best
        where = np.zeros(n, "i8")
        for i, p in enumerate(paths):
            d = live[which[live] == i]
            if len(d):
                steps = _runs(p.begin[d], p.count[d])
                who = np.repeat(d, p.count[d])
                hit = np.flatnonzero(p.g[steps] == best[who])
                first = np.unique(who[hit], return_index=True)[1]
                where[d] = steps[hit[first]]
        path, own_from = _leave(lat, paths, live, which, where, best, keys, begin_at, unit_of, first_unit, lens, unit_key, n, len(samples))
        values = best


def _leave(lat, paths, live, which, where, best, keys, begin_at, unit_of, first_unit, lens, unit_key, n, round_):
    """The next path of each live text: its parent's steps before the part's step, another piece there, then a fresh walk."""
    alt, dev_unit, own_from = np.zeros(n, "i8"), np.zeros(n, "i8"), np.zeros(n, "i8")
    slots = np.arange(int(lat.count.max()))
    copied = {}
    for i, p in enumerate(paths):
        d = live[which[live] == i]
        if not len(d):
            continue
        s = where[d]
        pos = lat.src[p.edge[s]]
        step = s - p.begin[d]
        there = slots < lat.count[pos][:, None]
        probs = np.where(there, lat.prob[np.where(there, lat.first[pos][:, None] + slots, 0)], 0.0)
        p.barred[s] |= np.uint64(1) << (p.edge[s] - lat.first[pos]).astype("u8")
        probs[(p.barred[s][:, None] >> slots.astype("u8")) & np.uint64(1) == 1] = 0.0
        cum = np.cumsum(probs, axis=1)
        u = uniform(keys[d], step, 101 + round_)
        pick = (cum <= (u * cum[:, -1])[:, None]).sum(axis=1)
        alt[d], dev_unit[d], own_from[d] = lat.first[pos] + pick, p.unit[s], step
        # what is left of the part stays with the parent
        p.barred[s] |= np.uint64(1) << pick.astype("u8")
        probs[np.arange(len(d)), pick] = 0.0
        rest = probs.sum(axis=1)
        with np.errstate(divide="ignore"):
            loc = np.where((probs > 0).any(axis=1), p.before[s] + np.log(np.maximum(rest, 1e-300)), -np.inf)
        p.g[s] = _truncated(loc, best[d], uniform(keys[d], step, 201 + round_))
        copied[i] = d
    # walks: the rest of the unit that is left, and all units after it
    n_units = (first_unit + lens)[live] - dev_unit[live]
    units = _runs(dev_unit[live], n_units)
    head = np.cumsum(n_units) - n_units
    start = begin_at[units]
    start[head] = lat.to[alt[live]]
    extra = np.zeros(len(units), "i8")
    extra[head] = own_from[live] + 1
    walkers = np.flatnonzero(lat.left[start] > 0)
    rounds = [(walkers[w], e) for w, e in _walk(lat, start[walkers], unit_key[units[walkers]], 7 + 16 * round_)]
    edge, unit, begin = _assemble(int(extra.sum()), extra, rounds, units)
    ends = np.append(begin, len(edge))[np.append(head, len(units))[1:]]
    count = np.zeros(n, "i8")
    count[live] = ends - begin[head]
    at = np.zeros(n, "i8")
    at[live] = begin[head]
    for i, d in copied.items():
        p = paths[i]
        from_, to = _runs(p.begin[d], own_from[d]), _runs(at[d], own_from[d])
        edge[to], unit[to] = p.edge[from_], p.unit[from_]
    edge[at[live] + own_from[live]] = alt[live]
    return _Path(edge, unit, count), own_from + 1  # the part itself stays with its parent


def _ids(vocab: Vocabulary, lat: Lattice, path: _Path) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each text) of a path."""
    ids = lat.piece[path.edge]
    raw = np.flatnonzero(ids < 0)
    if not len(raw):
        return ids, path.count
    pos = lat.src[path.edge[raw]]
    width = np.ones(len(ids), "i8")
    width[raw] = w = lat.width[pos]
    out = np.repeat(ids, width)
    at = np.cumsum(width) - width
    spelled = np.frombuffer(lat.code[pos].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), "u1")
    out[_runs(at[raw], w)] = vocab.byte_id[spelled]
    sums = np.concatenate([[0], np.cumsum(width)])
    return out, sums[path.begin[1:]] - sums[path.begin[:-1]]


def encode_texts(vocab: Vocabulary, texts: list[str | None], keys: np.ndarray, k: int):
    """Per sample: (text numbers, ids, counts, log_prob, perturbed, inclusion)."""
    lat, samples, threshold = search(vocab, texts, keys, k)
    for docs, path, logp, value in samples:
        ids, counts = _ids(vocab, lat, path) if path is not None else (np.zeros(0, "i4"), np.zeros(len(texts), "i8"))
        with np.errstate(over="ignore"):
            inclusion = -np.expm1(-np.exp(logp - threshold[docs]))
        yield docs, ids, counts[docs], logp, value, inclusion


def _digest(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's ids and their order."""
    at = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    x = _hash((ids.astype("u8") + np.uint64(1)) * _P + at.astype("u8"))
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(x, dtype="u8")])
    ends = np.cumsum(counts)
    return (sums[ends] - sums[ends - counts]).view("i8")


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(model_file: str = MODEL_FILE) -> Vocabulary:
    if model_file not in _VOCABULARIES:
        _VOCABULARIES[model_file] = Vocabulary(model_file)
    return _VOCABULARIES[model_file]


def sample_encode(df: DataFrame, *, k: int = 2, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, model_file: str = MODEL_FILE, ids: bool = True, round_trip: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, sample, ids, n_pieces, log_prob, perturbed, inclusion, ids_hash): up to ``k`` distinct segmentations of each row, best perturbed first.

    Without ``ids`` only their count and hash are returned. With ``round_trip`` the ids of each
    sample are decoded again, and a column of that name says whether that gave the text.
    The ``keep`` columns are carried along. No shuffle. The vocabulary file has to be on each worker, at the same path."""
    kind = df.schema[id_col].dataType
    schema = f"`{id_col}` {kind.simpleString()}, sample int, " + "ids array<int>, " * ids + "n_pieces long, log_prob double, perturbed double, inclusion double, ids_hash long" + ", round_trip boolean" * round_trip
    schema += "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        vocab = vocabulary(model_file)
        for batch in batches:
            for rows, texts in text_slices(batch, "__text", CHUNK_CHARS):
                keys = rows.column("__key").to_numpy(zero_copy_only=False)
                for rank, (docs, flat, counts, logp, value, inc) in enumerate(encode_texts(vocab, texts, keys, k), 1):
                    own = pa.array(docs)
                    cols = [rows.column("__id").take(own), pa.array(np.full(len(docs), rank, "i4"))]
                    if ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype("i4")), pa.array(flat)))
                    cols += [pa.array(counts), pa.array(logp), pa.array(value), pa.array(inc), pa.array(_digest(flat, counts))]
                    names = [id_col, "sample", *["ids"] * ids, "n_pieces", "log_prob", "perturbed", "inclusion", "ids_hash"]
                    if round_trip:
                        out, cuts = vocab.spell(flat, counts)
                        said = [(" " + texts[d]).encode() if texts[d] else b"" for d in docs]
                        cols.append(pa.array([out[a:b] == t for t, a, b in zip(said, cuts[:-1], cuts[1:], strict=True)], pa.bool_()))
                        names.append("round_trip")
                    cols += [rows.column(f"__keep{i}").take(own) for i in range(len(keep))]
                    names += keep
                    yield pa.RecordBatch.from_arrays(cols, names)

    rows = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"), F.xxhash64(F.col(f"`{id_col}`"), F.lit(seed)).alias("__key"), *[F.col(f"`{c}`").alias(f"__keep{i}") for i, c in enumerate(keep)])
    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, *, ids_col: str = "ids", out_col: str = "decoded", model_file: str = MODEL_FILE) -> DataFrame:
    """``df`` with the text of its ids."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        lists = [x if x is not None else () for x in ids]
        counts = np.fromiter(map(len, lists), "i8", len(lists))
        flat = np.concatenate([np.asarray(x, "f8") for x in lists]) if counts.sum() else np.zeros(0)
        return pd.Series(vocabulary(model_file).decode_all(np.nan_to_num(flat, nan=-1), counts), dtype=object)

    return df.withColumn(out_col, text(F.col(f"`{ids_col}`")))
