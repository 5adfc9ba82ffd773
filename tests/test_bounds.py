"""What operators hold at a time doesn't grow with a batch, a table or a key's share of it."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.functions import structure
from marlstone.operators import blocks
from marlstone.operators import events as E
from marlstone.operators import retrieval as R
from marlstone.operators.quantiles import quantiles


def caught(monkeypatch, df, made):
    """The function that an operator gives to mapInArrow."""
    found = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: found.append(f) or self)
    made()
    monkeypatch.undo()
    return found[-1]


def texts(n: int) -> pa.RecordBatch:
    said = [None, "", *[("Words of a line. " * 40 + "\n\n") * (i % 30) for i in range(n)]]
    return pa.RecordBatch.from_pydict({"id": list(range(len(said))), "text": said})


def test_portions():
    batch = texts(300)
    parts = list(blocks.portions(batch, "text", 50_000))
    assert pa.concat_batches(parts).equals(batch) and len(parts) > 20
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column("text").to_pylist()) <= 50_000 for p in parts)
    assert list(blocks.portions(batch.slice(0, 0), "text")) == []


def test_paragraph_chunks_by_portions(spark, monkeypatch):
    """a batch of 12 MB of texts comes out in parts of about one."""
    batch, df = texts(1200), spark.createDataFrame([(1, "a")], "doc_id long, text string")
    out = list(caught(monkeypatch, df, lambda: R.paragraph_chunks(df))([batch]))
    assert batch.nbytes > 10 << 20 and max(b.nbytes for b in out) < 2 << 20
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert got == [(i, j, c) for i, t in zip(*batch.to_pydict().values(), strict=True) for j, c in enumerate(R.pack_paragraphs(t))]


def test_structural_chunks_by_portions(spark, monkeypatch):
    """the same of chunks by structure."""
    batch, df = texts(1200), spark.createDataFrame([(1, "a")], "doc_id long, text string")
    out = list(caught(monkeypatch, df, lambda: structure.structural_chunks(df))([batch]))
    assert batch.nbytes > 10 << 20 and max(b.nbytes for b in out) < 2 << 20
    got = [(r["id"], r["chunk_index"], r["section_title"], r["chunk"]) for b in out for r in b.to_pylist()]
    assert got == [(i, j, *c) for i, t in zip(*batch.to_pydict().values(), strict=True) for j, c in enumerate(structure.chunks(t))]


def test_intervals_hold_nothing_by_key(spark):
    """one sort of each side and one of both, where dozens of hash tables and sorts had memory at once."""
    e = spark.createDataFrame([(1, 10 * i, i, i % 3 > 0, i % 4 > 1) for i in range(40)], "k long, us long, event_id long, a boolean, b boolean")
    a, b = (E.consecutive(e, F.col(c), keys=["k"], max_gap_us=10) for c in "ab")
    for f in (E.intersection, E.difference):
        plan = f(a, b, keys=["k"])._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and plan.split("+- == Initial Plan ==")[0].count("Sort [") <= 3


def test_intervals_that_touch(spark):
    """Touching, nested, repeated and empty intervals, null times and samples at the same time."""
    sides = [[(1, 0, 5), (1, 5, 9), (1, 2, 3), (1, 7, 7), (1, 20, 30), (1, 20, 30), (2, 1, 4)], [(1, 4, 6), (1, 6, 8), (1, 22, 22), (1, 25, 40), (1, 26, 27), (3, 1, 2)]]
    a, b = (spark.createDataFrame(x, "k long, start_us long, end_us long") for x in sides)
    found = lambda df: sorted(map(tuple, df.collect()))
    assert found(E.intersection(a, b, keys=["k"])) == [(1, 4, 8), (1, 25, 30)]
    assert found(E.difference(a, b, keys=["k"])) == [(1, 0, 4), (1, 8, 9), (1, 20, 25), (2, 1, 4)]
    rows = [(1, None, 1, True), (1, 0, 2, True), (1, 0, 3, False), (1, 5, None, True), (1, 10, 4, False), (1, 10, 5, True), (1, 15, 6, True), (1, 26, 7, True), (1, 27, 8, None), (1, 28, 9, True), (None, 3, 1, True)]
    e = spark.createDataFrame(rows, "k long, us long, event_id long, m boolean")
    assert {tuple(r) for r in E.consecutive(e, F.col("m"), keys=["k"], max_gap_us=10).collect()} == {(1, 10, 15, 2), (1, 26, 26, 1), (1, 28, 28, 1), (None, 3, 3, 1)}


def test_quantiles_keep_rows_in_place(spark):
    """F16: rows are neither shuffled by group nor counted by value but in the bins that hold a rank."""
    df = spark.range(100_000).select(F.when(F.col("id") % 10 < 9, "a").alias("g"), (F.hash("id") % 1_000_003).cast("double").alias("v"))
    out = quantiles(df, ["g"], "v", {"low": 0.1, "high": 0.9})
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    lines = plan.splitlines()
    assert all("Aggregate" in below for x, below in zip(lines, lines[1:], strict=False) if "Exchange hashpartitioning" in x)
    got = {r["g"]: (r["low"], r["high"]) for r in out.collect()}
    for g in ("a", None):
        v = [r["v"] for r in df.filter(F.col("g").eqNullSafe(g)).collect()]
        assert got[g] == pytest.approx(np.quantile(v, [0.1, 0.9]).tolist())


def test_meeting_takes_few_rows_at_a_time(spark):
    """the scores of a batch of queries with all rows of a block were one array, 10,000 times up to 65,536."""
    held, passing = (spark.range(n).select(F.lit(0).cast("long").alias("block"), "id") for n in (1000, 9000))
    seen = blocks.meeting(held, passing, "n long", lambda t: t, lambda t, b: pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]), tasks=1).toPandas()["n"]
    assert seen.sum() == 9000 and seen.max() * 1000 <= 1 << 21
