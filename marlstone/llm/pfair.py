"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in a seeded hash order, are cut into blocks. The weights are
taken as they are, as shares k/D of exact integers. Block i of a source of share
k/D is released at slot floor(i*D/k) and due by slot ceil((i+1)*D/k); at each
slot the released block with the earliest deadline runs. As the shares sum to
one, each source's count of blocks stays less than one block from its weight's
share of the slots so far, however long the table is. The driver goes through the
whole sequence of blocks: a step a block, not a row.

When a source runs out, its weight goes to the others in proportion and a new
phase starts at that slot; there are as many phases as sources at most. Sources
of weight zero come, all alike, when the others have run out. No row is dropped
or repeated.

What is collected: a count per source (``MAX_SOURCES`` at most, else an error).
What goes back to the tasks: an integer a block, in pieces of ``PIECE`` blocks of
a source; these are broadcast up to ``BROADCAST_BLOCKS`` in all, and joined on
(source, piece) beyond.

Cases: a null source is a source of its own; a null id is placed by its hash
like any other; a source without a weight gets ``default_weight``; a weight that
is negative or not finite is an error; repeated rows and ties of the hash order
are told apart by their number; texts of any length are carried; an empty table
gives an empty result; other columns are carried along, whatever their names, but
for those of the results (mix_slot, mix_block, mix_position), which are replaced.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_ROWS = 16
PIECE = 1024
BROADCAST_BLOCKS = 2_000_000
MAX_SOURCES = 4096
TASK_ROWS = 100_000
NO_SOURCE = "\0null"
RESULTS = ("mix_slot", "mix_block", "mix_position")


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Integers of at least 1 that sum to the period, by largest remainders; ties to the smaller name."""
    period = max(period, len(weights))
    total = sum(map(Fraction, weights.values()))
    spare = period - len(weights)
    exact = {s: Fraction(w) / total * period for s, w in weights.items()}
    # each has one slot; the rest is dealt by what is missing to the exact share
    need = {s: max(Fraction(0), x - 1) for s, x in exact.items()}
    scale = Fraction(spare) / (sum(need.values()) or 1)
    want = {s: x * scale for s, x in need.items()}
    out = {s: 1 + int(x) for s, x in want.items()}
    left = period - sum(out.values())
    for s in sorted(want, key=lambda s: (int(want[s]) - want[s], s))[:left]:
        out[s] += 1
    return out


def exact_shares(weights: dict[str, float]) -> dict[str, int]:
    """Integers in the very proportion of the weights."""
    if bad := [s for s, w in weights.items() if not (math.isfinite(w) and w >= 0)]:
        raise ValueError(f"weights have to be finite and not negative: {bad[:5]}")
    exact = {s: Fraction(w) for s, w in weights.items()}
    whole = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * whole) for s, w in exact.items()}


def period_slots(share: dict[str, int], blocks: dict[str, int] | None = None) -> list[str]:
    """The source that runs in each slot: earliest deadline first among released blocks.

    Of one period, or with ``blocks`` until the first source has used its own."""
    d = sum(share.values())
    left = dict(share if blocks is None else blocks)
    waiting = [(0, s, 0) for s in sorted(share)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out: list[str] = []
    while blocks is not None or len(out) < d:
        t = len(out)
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * d // share[s]), s, i))
        due, s, i = heapq.heappop(ready)
        assert due > t, "a deadline was missed"
        out.append(s)
        left[s] -= 1
        if left[s]:
            heapq.heappush(waiting, ((i + 1) * d // share[s], s, i + 1))
        elif blocks is not None:
            break
    return out


def schedule(blocks: dict[str, int], weights: dict[str, float], period: int | None = None) -> dict[str, array]:
    """By source: the slot of each of its blocks. With ``period`` each phase's weights are first rounded to so many slots."""
    left = {s: n for s, n in blocks.items() if n > 0}
    out = {s: array("q") for s in left}
    exact = exact_shares({s: weights[s] for s in left})
    start = 0
    while left:
        share = {s: exact[s] for s in left if exact[s]} or dict.fromkeys(left, 1)
        if period is not None:
            share = shares(share, period)
        order = period_slots(share, {s: left[s] for s in share})
        for t, s in enumerate(order, start):
            out[s].append(t)
            left[s] -= 1
        start += len(order)
        left = {s: n for s, n in left.items() if n}
    return out


def _pieces(spark, plan: dict[str, array]) -> DataFrame:
    """(__src, __piece, __slots): the slots of ``PIECE`` blocks of a source a row."""
    rows = [(s, i // PIECE, slots[i : i + PIECE]) for s, slots in plan.items() for i in range(0, len(slots), PIECE)]
    kinds = [("__src", pa.string()), ("__piece", pa.int64()), ("__slots", pa.list_(pa.int64()))]
    out = spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds]))
    return F.broadcast(out) if sum(map(len, plan.values())) <= BROADCAST_BLOCKS else out


def tempered(counts: dict[str, int], temperature: float) -> dict[str, float]:
    """Target weights in proportion to count ** temperature: 1 as the data are, 0 all alike."""
    return {s: float(n) ** temperature for s, n in counts.items()}


def mix(
    df: DataFrame, weights: dict[str, float] | None = None, *, source_col: str = "source", id_col: str = "doc_id", temperature: float = 0.5, default_weight: float = 1.0,
    period: int | None = None, block_rows: int = BLOCK_ROWS, seed: int = 7, names: tuple[str, str, str] = RESULTS,
) -> DataFrame:
    """``df`` with ``mix_slot``, ``mix_block`` and ``mix_position`` (or ``names``); sorting by the last gives the mixture.

    Ranks within a source come from hash buckets: a bucket's rows are numbered in
    one task, and the counts of the buckets before it are added. A source of any
    size is so dealt out over four buckets for each ``TASK_ROWS`` rows."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # as many buckets as rows call for, so that a task's share doesn't grow with the table
    rows = df.count()
    parts = max(parts, -(-rows // TASK_ROWS))
    buckets = 4 * parts
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    keyed = df.select(own.alias("row"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(NO_SOURCE)).alias("__src"), F.col(f"`{id_col}`").alias("__id"), F.xxhash64(F.col(f"`{id_col}`"), F.lit(seed)).alias("__h"))
    keyed = keyed.withColumn("__bucket", F.pmod("__h", F.lit(buckets)))
    cells = keyed.groupBy("__src", "__bucket").agg(F.count(F.lit(1)).alias("__cell"))
    per = cells.groupBy("__src").agg(F.sum("__cell").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; mix groups of them")
    counts = {r["__src"]: r["n"] for r in per}
    target = tempered(counts, temperature) if weights is None else {s: weights.get(s, default_weight) for s in counts}
    plan = schedule({s: -(-n // block_rows) for s, n in counts.items()}, target, period)
    slots = _pieces(spark, plan)

    before = cells.withColumn("__before", F.sum("__cell").over(Window.partitionBy("__src").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("__src", "__bucket", F.coalesce("__before", F.lit(0)).alias("__before"))
    if len(counts) * buckets <= BROADCAST_BLOCKS:
        before = F.broadcast(before)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        keyed = keyed.repartition(parts, "__src", "__bucket")
    rank = F.row_number().over(Window.partitionBy("__src", "__bucket").orderBy("__h", "__id"))
    ranked = keyed.withColumn("__rank", rank).join(before, ["__src", "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("__before") - 1)
    placed = ranked.withColumn("mix_block", F.expr(f"__rank div {block_rows}")).withColumn("__piece", F.expr(f"mix_block div {PIECE}")).join(slots, ["__src", "__piece"])
    slot = F.expr(f"__slots[cast(mix_block % {PIECE} as int)]")
    placed = placed.withColumn("mix_slot", slot).withColumn("mix_position", F.col("mix_slot") * block_rows + F.pmod("__rank", F.lit(block_rows)))
    return placed.select("row.*", *[F.col(r).alias(n) for r, n in zip(RESULTS, names, strict=True)])


def mixed_order(df: DataFrame, **how) -> DataFrame:
    """``df``'s own columns and rows, dealt and sorted so that files read in order give the mixture."""
    out = mix(df, **how)
    return out.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*[F.col(f"`{c}`") for c in df.columns])
