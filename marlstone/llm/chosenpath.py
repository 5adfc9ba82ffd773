"""N-gram Jaccard join by chosen paths.

A document's set holds the hashes of its runs of ``NGRAM`` lower-case words (one
run of all words if there are fewer). Documents with equal sets are one node. In
each of several runs every node follows the tokens of its set that a seeded hash
chooses, ``BRANCH / (threshold * size)`` of them, so two nodes of similarity at
the threshold share BRANCH chosen tokens a run on average. A bucket (run, token)
of up to ``SMALL`` nodes is brute-forced. A larger one is split again on tokens
that a hash of bucket and token chooses, again ``BRANCH`` of them, to ``DEPTH``
levels. A pair's shared keys so form a branching process; runs are repeated until
``recall`` is reached even if all its keys are split to the last level. A large bucket whose nodes
keep sharing what they choose is dense: nearly all of its pairs are links, so a
split gains nothing. Dense buckets that share nodes form a cluster, which is
brute-forced in blocks: each task compares two blocks of ``BLOCK`` nodes and
``BLOCK_TOKENS`` tokens at most and returns sums by node and a star of each component
of its links, never the pairs. A bucket that lies inside a cluster goes no further.

A node of a small bucket comes to the brute force only if some other node's sketch
allows a link. A sketch is a bitmap of a set's tokens; sets whose bitmaps differ in
more bits than two sets at the threshold differ in tokens can't be a link, so this
loses none, and few whole sets are made and shuffled.

Every pair found is checked exactly on the full sets. Of buckets with the same
nodes one is kept; if it is split and not dense, it follows as many tokens as all
of them would. Nothing is capped: large buckets are split or compared in blocks.
Classes are the connected components of the links, by label passing with pointer
jumps; each round is written to the shared folder.

Cases: null texts and texts without a word have no set: each is a class of its
own with no links, whatever others there are; ids that are null take no part and
come back with a null class; repeated rows count as copies; ties can't arise, as
a class's id is its smallest document id; texts are used whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloomdedup import not_among, split_by_members
from .common import files_for, forget, made, text_slices, written

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.999
BRANCH = 2.0
SMALL = 96
BLOCK = 1024
BLOCK_TOKENS = 2_000_000
JUDGED = 128
SKETCH_BITS = 1024
COLUMNS = 4096
DEPTH = 6
DENSE = 0.75 * BRANCH  # pairs share this many children on average if they have 0.6 of their tokens in common
CHUNK_CHARS = 800_000
MOST_ROUNDS = 64

WORD = re.compile(r"\w+")


def runs_for(recall: float = RECALL, branch: float = BRANCH, splits: int = DEPTH - 1) -> int:
    """Runs until a pair at the threshold is met with this probability, even if each of its shared keys is split so often."""
    lost = 0.0  # of a key: that none of its children, grandchildren ... is left
    for _ in range(splits):
        lost = math.exp(-branch * (1 - lost))
    return max(1, math.ceil(math.log(1 - recall) / (-branch * (1 - lost))))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def token_sets(texts: list[str | None], ngram: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct 32-bit tokens, sorted within each text, and each text's number of them."""
    lists = [WORD.findall(t.lower()) if t else [] for t in texts]
    lens = np.fromiter(map(len, lists), "i8", len(lists))
    flat = np.array([w for ws in lists for w in ws], object)
    if not len(flat):
        return np.zeros(0, "u4"), np.zeros(len(lists), "i8")
    codes, words = pd.factorize(flat)
    h = pd.util.hash_array(words, categorize=False)[codes]
    doc = np.repeat(np.arange(len(lists)), lens)
    place = np.arange(len(h)) - np.repeat(np.cumsum(lens) - lens, lens)
    left = np.repeat(lens, lens) - place
    run = np.zeros(len(h), "u8")
    for j in range(ngram):
        inside = left > j
        run[: len(h) - j] += np.where(inside[: len(h) - j], mix(h[j:] + np.uint64(j + 1)), np.uint64(0)) if j else mix(h + np.uint64(1))
    keep = (left >= ngram) | (place == 0)  # short texts have one run
    token = mix(run[keep]) >> np.uint64(32)
    both = np.unique((doc[keep].astype("u8") << np.uint64(32)) | token)
    return (both & np.uint64(0xFFFFFFFF)).astype("u4"), np.bincount((both >> np.uint64(32)).astype("i8"), minlength=len(lists))


def fingerprints(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    x = np.concatenate([np.zeros(1, "u8"), np.cumsum(mix(tokens.astype("u8") + np.uint64(0x51ED270B)), dtype="u8")])
    ends = np.cumsum(sizes)
    return mix((x[ends] - x[ends - sizes]) + sizes.astype("u8")).view("i8")


def chosen(tokens: np.ndarray, sizes: np.ndarray, parent: np.ndarray, threshold: float, branch: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set number, child key) of the tokens that each set follows below its ``parent`` key."""
    who = np.repeat(np.arange(len(sizes)), sizes)
    h = mix(tokens.astype("u8") + mix(parent.view("u8"))[who])
    p = np.minimum(1.0, branch / (threshold * np.maximum(sizes, 1)))
    on = (h >> np.uint64(11)).astype("f8") < p[who] * (1 << 53)
    return who[on], mix(h[on] + np.uint64(1)).view("i8")


def links_within(sets: list[np.ndarray], threshold: float, other: list[np.ndarray] | None = None) -> np.ndarray:
    """Boolean matrix: which sets have Jaccard similarity of the threshold or more (with each other, or with ``other``)."""
    both = sets if other is None else [*sets, *other]
    size = np.array([len(s) for s in both], "f8")
    flat = np.concatenate(both)
    who = np.repeat(np.arange(len(both)), size.astype("i8"))
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    new = np.cumsum(shared) - 1
    on = shared[code]
    code, who = new[code[on]], who[on]
    order = np.argsort(code, kind="stable")
    code, who = code[order], who[order]
    n = len(sets)
    m = n if other is None else len(other)
    common = np.zeros((n, m), "f4")
    total = int(shared.sum())
    for a in range(0, total, COLUMNS):
        lo, hi = np.searchsorted(code, [a, a + COLUMNS])
        x = np.zeros((len(both), min(COLUMNS, total - a)), "f4")
        x[who[lo:hi], code[lo:hi] - a] = 1
        common += x[:n] @ (x[n:] if other is not None else x).T
    s, t = size[:n], size[:n] if other is None else size[n:]
    return (1 + threshold) * common.astype("f8") >= threshold * (s[:, None] + t[None, :]) - 1e-6  # single precision would lose pairs at the very threshold


def sketches(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A bitmap of each set's tokens, as bytes (sets x SKETCH_BITS / 8)."""
    bits = np.zeros((len(sizes), SKETCH_BITS), bool)
    bits[np.repeat(np.arange(len(sizes)), sizes), tokens & np.uint32(SKETCH_BITS - 1)] = True
    return np.packbits(bits, axis=1)


def may_link(sketch: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which sets (rows of 64-bit words) have another one that their sketches and sizes allow as a link."""
    apart = np.bitwise_count(sketch[:, None, :] ^ sketch[None, :, :]).sum(axis=2, dtype="i8")
    both = sizes[:, None] + sizes[None, :]
    ok = (apart <= (1 - threshold) / (1 + threshold) * both + 1e-6) & (np.minimum(sizes[:, None], sizes) >= threshold * np.maximum(sizes[:, None], sizes) - 1e-6)
    np.fill_diagonal(ok, False)
    return ok.any(axis=1)


def _lists(who: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """The values of each of ``n`` rows, given each value's row in order."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(who, minlength=n))]).astype("i4")), pa.array(values))


def _prepared(df: DataFrame, id_col: str, text_col: str, threshold: float, runs: int, ngram: int) -> DataFrame:
    """(id, fp, size, new, keys, sketch): keys and sketch only at a set's first place in its task; fp null without a word."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for rows, texts in text_slices(batch, "text", CHUNK_CHARS):
                tokens, sizes = token_sets(texts, ngram)
                fp = fingerprints(tokens, sizes)
                new = np.zeros(len(sizes), bool)
                for i, f in zip(np.flatnonzero(sizes).tolist(), fp[sizes > 0].tolist(), strict=True):
                    if f not in seen:
                        seen.add(f)
                        new[i] = True
                if len(seen) > 200_000:  # only saves rows; the join takes copies too
                    seen.clear()
                keys = [chosen(tokens, sizes, np.full(len(sizes), r + 1, "i8"), threshold, BRANCH) for r in range(runs)]
                who, key = (np.concatenate([k[i] for k in keys]) for i in range(2))
                order = np.argsort(who, kind="stable")
                order = order[new[who[order]]]
                bits = [b.tobytes() if n else None for b, n in zip(sketches(tokens, sizes), new, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), pa.array(fp, mask=sizes == 0), pa.array(sizes), pa.array(new), _lists(who[order], key[order], len(sizes)), pa.array(bits, pa.binary())], ["id", "fp", "size", "new", "keys", "sketch"]
                )

    rows = df.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp long, size long, new boolean, keys array<long>, sketch binary")


def _stats(members: DataFrame, *by: str) -> DataFrame:
    """Of each bucket: its nodes' number, two hashes of them, and whether one known cluster holds them all."""
    inside = (F.count("cluster") == F.count(F.lit(1))) & (F.min("cluster") == F.max("cluster"))
    return members.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("fp").alias("x"), F.sum(F.xxhash64("fp").cast("decimal(20,0)")).alias("s"), inside.alias("inside"))


def _distinct_buckets(stats: DataFrame) -> DataFrame:
    """Of buckets with the same nodes, one: (key, n, same), with the number of them. Buckets inside a cluster are left out: it is compared as a whole."""
    return stats.filter("n > 1 and not inside").groupBy("n", "x", "s").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("same")).select("key", "n", "same")


def _sets(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, ngram: int) -> DataFrame:
    """(fp, tokens) of the documents whose ids are wanted, and of the few more that a Bloom filter takes for these. No text is shuffled."""

    def run(batches):
        for batch in batches:
            for _, texts in text_slices(batch, "text", CHUNK_CHARS):
                tokens, sizes = token_sets(texts, ngram)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype("i4")
                yield pa.RecordBatch.from_arrays([pa.array(fingerprints(tokens, sizes)), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.view("i4")))], ["fp", "tokens"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    maybe, _ = split_by_members(rows, "id", wanted, "id")
    return maybe.select("text").mapInArrow(run, "fp long, tokens array<int>")


def _of(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of these nodes, and of the few more that a Bloom filter takes for them."""
    return split_by_members(sets, "fp", nodes.select("fp").distinct(), "fp")[0]


def _split(frontier: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(parent, key, fp): the children of large buckets (key, fp, same), for as many keys as ``same`` says."""

    def run(batches):
        for pdf in batches:
            for a in range(0, len(pdf), 512):
                part = pdf.iloc[a : a + 512]
                sizes = part["tokens"].map(len).to_numpy()
                tokens = np.concatenate(part["tokens"].to_numpy()).astype("i4").view("u4")
                parent = part["key"].to_numpy()
                who, key = chosen(tokens, sizes, parent, threshold, BRANCH * part["same"].to_numpy("f8"))
                yield pd.DataFrame({"parent": parent[who], "key": key, "fp": part["fp"].to_numpy()[who]})

    return frontier.join(_of(sets, frontier), "fp").select("key", "fp", "same", "tokens").mapInPandas(run, "parent long, key long, fp long").distinct()


def _whole_buckets(batches):
    """The rows of each bucket together, as frames sorted by key; a batch's last bucket waits for the next batch."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = pdf["key"] == pdf["key"].iloc[-1] if len(pdf) else []
        rest = pdf[last]
        yield pdf[~last] if len(pdf) else pdf
    if rest is not None and len(rest):
        yield rest


def _cuts(keys: np.ndarray):
    """Begin and end of each run of equal keys."""
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, "i8")
    return zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _candidates(small: DataFrame, sketched: DataFrame, threshold: float) -> DataFrame:
    """(key, fp) of the nodes of small buckets that have another one there that their sketches allow."""

    def run(batches):
        for pdf in _whole_buckets(batches):
            keys, fps, sizes = pdf["key"].to_numpy(), pdf["fp"].to_numpy(), pdf["size"].to_numpy("i8")
            words = np.frombuffer(b"".join(pdf["sketch"]), "u8").reshape(-1, SKETCH_BITS // 64)
            keep = np.zeros(len(pdf), bool)
            for lo, hi in _cuts(keys):
                at = lo + np.unique(fps[lo:hi], return_index=True)[1]
                if len(at) > 1:
                    keep[at] = may_link(words[at], sizes[at], threshold)
            yield pd.DataFrame({"key": keys[keep], "fp": fps[keep]})

    rows = small.join(sketched, "fp").select("key", "fp", "size", "sketch").repartition("key").sortWithinPartitions("key")
    return rows.mapInPandas(run, "key long, fp long")


def _pairs(small: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of links in small buckets."""

    def run(batches):
        for pdf in _whole_buckets(batches):
            out_a, out_b = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
            fps, sets_ = pdf["fp"].to_numpy(), pdf["tokens"].to_numpy()
            for lo, hi in _cuts(pdf["key"].to_numpy()):
                fp, at = np.unique(fps[lo:hi], return_index=True)
                if len(fp) > 1:
                    i, j = np.nonzero(np.triu(links_within([sets_[lo + x] for x in at], threshold), 1))
                    out_a.append(fp[i])
                    out_b.append(fp[j])
            yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    rows = small.join(sets, "fp").select("key", "fp", "tokens").repartition("key").sortWithinPartitions("key")
    return rows.mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, label): the smallest node of each node's connected component, for all nodes of ``edges`` (a, b); ``rows``: about how many."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges", rows)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels", rows)
    for _ in range(MOST_ROUNDS):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        lower = written(near.join(labels, "node").select("node", "label", F.least("label", "m").alias("low")), "labels", rows)
        # a jump: to the new label of the label
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("far"))
        moved = written(lower.join(jump, "low", "left").select("node", "label", F.least("low", F.coalesce("far", "low")).alias("new")), "labels", rows)
        if not moved.filter("new <> label").limit(1).count():
            return moved.select("node", F.col("new").alias("label"))
        labels = moved.select("node", F.col("new").alias("label"))
    raise RuntimeError("components didn't settle")


def _clusters(members: DataFrame, rows: int | None = None) -> DataFrame:
    """(cluster, fp): dense buckets (key, fp) that share nodes, joined. A bucket's edges go to its first node."""
    first = members.groupBy("key").agg(F.min("fp").alias("b"))
    star = members.join(first, "key").select(F.col("fp").alias("a"), "b")
    return components(star, rows).select(F.col("label").alias("cluster"), F.col("node").alias("fp"))


def _dense_links(clusters: DataFrame, sets: DataFrame, copies: DataFrame, threshold: float) -> DataFrame:
    """(fp, links, other): per task the copies that each node links to, and the least node of its component of the task's links.

    The first node that it links to wouldn't do: of 1-5, 5-6 and 6-2 the link 5-6 is no end's first, and two classes were left."""
    of = clusters.join(copies, "fp")
    size = of.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    dealt = of.join(size, "cluster").join(_of(sets, clusters).dropDuplicates(["fp"]), "fp")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"), (F.col("own") <= F.col("to")).alias("first"), (F.col("own") >= F.col("to")).alias("second"), "fp", "copies", "tokens")

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["first"]], pdf[pdf["second"]]
        same = bool((pdf["i"] == pdf["j"]).all())
        m = links_within(list(left["tokens"]), threshold, None if same else list(right["tokens"])) if len(left) and len(right) else np.zeros((len(left), len(right)), bool)
        if same:
            np.fill_diagonal(m, False)
        a, b = _least_joined(left["fp"].to_numpy(), right["fp"].to_numpy(), m)
        out = [_sums(left["fp"].to_numpy(), right["copies"].to_numpy(), a, m)]
        if not same:
            out.append(_sums(right["fp"].to_numpy(), left["copies"].to_numpy(), b, m.T))
        return pd.concat(out, ignore_index=True)

    return dealt.groupBy("cluster", "i", "j").applyInPandas(task, "fp long, links long, other long")


def _least_joined(a: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row and column of the links, the least node that a chain of links leads to (or itself)."""
    most = np.iinfo("i8").max
    while m.size:
        low = np.minimum(a, np.where(m, b[None, :], most).min(axis=1))
        far = np.minimum(b, np.where(m, low[:, None], most).min(axis=0))
        if (low == a).all() and (far == b).all():
            break
        a, b = low, far
    return a, b


def _sums(own: np.ndarray, copies: np.ndarray, least: np.ndarray, m: np.ndarray) -> pd.DataFrame:
    on = m.any(axis=1)
    return pd.DataFrame({"fp": own[on], "links": (m[on] @ copies.astype("i8")).astype("i8"), "other": least[on]})


def _dense_keys(frontier: DataFrame, sets: DataFrame, threshold: float, save) -> DataFrame:
    """(key) of the large buckets whose nodes keep sharing what they choose.

    Judged on about ``JUDGED`` nodes of each: this decides how a bucket is compared, not what is found."""
    few = F.pmod(F.xxhash64("fp", "key"), F.greatest(F.lit(1), F.expr(f"n div {JUDGED}"))) == 0
    probe = save(frontier.filter(few).select("key", "fp", F.lit(1).alias("same")), "probe")
    shared = _split(probe, sets, threshold).groupBy("parent", "key").agg(F.count(F.lit(1)).alias("n"))
    shared = shared.groupBy(F.col("parent").alias("key")).agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("sq"))
    nodes = probe.groupBy("key").agg(F.count(F.lit(1)).alias("np"))
    return save(nodes.join(shared, "key").filter(F.col("sq") >= DENSE * F.col("np") * F.col("np")).select("key"), "judged")


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def similar(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, ngram: int = NGRAM, small: int = SMALL) -> DataFrame:
    """(id, class_id, class_size, n_links) of each document: its class's smallest id, and the documents that it is similar to."""
    mark = made()
    prepared = written(_prepared(df, id_col, text_col, threshold, runs_for(recall), ngram), "prepared")
    n = prepared.count()
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism  # at least so many where the work is more than a row's
    keep = lambda x, name, rows=n: written(x, name, rows)
    worked = lambda x, name: written(x, name, n, tasks)
    known = prepared.filter("fp is not null")
    sketched = prepared.filter("new").select("fp", "size", "sketch")
    nodes = known.groupBy("fp").agg(F.min("id").alias("rep"), F.min(F.when(F.col("new"), F.col("id"))).alias("holder"), F.max("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    nodes = keep(nodes, "nodes")

    def sets_of(members: DataFrame) -> DataFrame:
        held = keep(members.select("fp").distinct().join(nodes, "fp").select(F.col("holder").alias("id")).distinct(), "wanted")
        return written(_sets(df, held, id_col, text_col, ngram), "sets")

    members = keep(known.select("fp", F.explode("keys").alias("key")).distinct(), "members", 12 * n)
    none = F.lit(None).cast("long").alias("cluster")
    members = keep(members.join(_distinct_buckets(_stats(members.select("*", none), "key")), "key"), "buckets", 12 * n)
    leaves = [members.filter(F.col("n") <= small).select("key", "fp")]
    frontier = members.filter(F.col("n") > small).select("key", "fp", "n", "same")
    clusters = None
    sets = None
    for level in range(DEPTH):
        if not _any(frontier):
            break
        found = frontier
        if level < DEPTH - 1:
            sets = sets_of(frontier) if sets is None else sets
            judged = _dense_keys(frontier, sets, threshold, keep)
            found = frontier.join(judged, "key", "left_semi")
        found = keep(found.select("key", "fp"), "dense")
        if _any(found):  # what lies inside the clusters of dense buckets is compared there, not bucket by bucket
            stars = found if clusters is None else found.unionByName(clusters.select(F.col("cluster").alias("key"), "fp"))
            clusters = keep(_clusters(stars, n), "clusters")
        if level == DEPTH - 1:
            break
        sparse = keep(frontier.join(judged, "key", "left_anti"), "sparse", 4 * n)
        children = worked(_split(sparse, sets, threshold), "children")
        children = children.withColumn("cluster", none) if clusters is None else children.join(clusters, "fp", "left")
        children = keep(children, "placed", 4 * n)
        below = keep(children.select("key", "fp").join(_distinct_buckets(_stats(children, "parent", "key")), "key"), "below")
        leaves.append(below.filter(F.col("n") <= small).select("key", "fp"))
        frontier = below.filter(F.col("n") > small).select("key", "fp", "n", "same")

    leaf = leaves[0]
    for x in leaves[1:]:
        leaf = leaf.unionByName(x)
    leaf = worked(_candidates(leaf, _of(sketched, leaf), threshold), "candidates")
    whole = leaf.select("fp") if clusters is None else leaf.select("fp").unionByName(clusters.select("fp"))
    sets = sets_of(whole)
    pairs = worked(_pairs(leaf, sets, threshold), "pairs")
    edges = pairs
    copies = nodes.select("fp", "copies", "size")
    counted = pairs
    sums = None
    if clusters is not None:
        found = worked(_dense_links(clusters, sets, copies, threshold), "denselinks")
        edges = pairs.unionByName(found.select(F.col("fp").alias("a"), F.col("other").alias("b")))
        # pairs inside a cluster have been counted there
        ca, cb = clusters.select(F.col("fp").alias("a"), F.col("cluster").alias("ca")), clusters.select(F.col("fp").alias("b"), F.col("cluster").alias("cb"))
        counted = pairs.join(ca, "a", "left").join(cb, "b", "left").filter("ca is null or cb is null or ca <> cb").select("a", "b")
        sums = found.select("fp", "links")
    ends = counted.unionByName(counted.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = ends.join(copies.withColumnRenamed("fp", "b"), "b").select(F.col("a").alias("fp"), F.col("copies").alias("links"))
    links = (links if sums is None else links.unionByName(sums)).groupBy("fp").agg(F.sum("links").alias("links"))
    labels = keep(components(edges, n), "classes")
    joined = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").join(links, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    joined = keep(joined, "known")
    classes = joined.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"))
    by_node = keep(joined.join(classes, "label").select("fp", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "bynode")
    forget(df.sparkSession, mark, ("prepared", "bynode"))
    return files_for(_by_document(df, prepared, by_node, id_col), n, tasks)


def _by_document(df: DataFrame, prepared: DataFrame, by_node: DataFrame, id_col: str) -> DataFrame:
    ids = prepared.select("id", "fp")
    out = ids.filter("fp is not null").join(by_node, "fp").select(F.col("id").alias(id_col), "class_id", F.col("class_size").cast("long").alias("class_size"), F.col("n_links").cast("long").alias("n_links"))
    alone = ids.filter("fp is null").select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    none = df.filter(F.col(f"`{id_col}`").isNull()).select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{id_col}`").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone).unionByName(none)


def one_of_each(df: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """``df`` without the documents that aren't their class's smallest id. Only rows that a Bloom filter takes wrongly for these are shuffled."""
    mark = made()
    gone = written(similar(df, id_col=id_col, **how).filter(F.col("class_id") != F.col(id_col)).select(F.col(id_col).alias("__gone")).distinct(), "gone")
    forget(df.sparkSession, mark, ("gone",))
    return not_among(df, id_col, gone, "__gone").select(*[F.col(f"`{c}`") for c in df.columns])
