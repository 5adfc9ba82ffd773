"""Exact quantiles of large groups, without a group's values meeting in one task.

A first pass takes each group's range, a second one counts values in ``BINS`` bins of
it; running counts tell in which bin a rank lies. A third pass counts the distinct values
of these few bins only, and a running count inside the bin gives the value. A bin whose
rows are all of one value is one row; a bin's distinct values are about a ``BINS``-th of
the group's unless nearly all lie close together. Ranges and bins are written to the
shared folder, so their size is known and few of them go to the rows by broadcast: rows
are never shuffled by group, and other bins' values are in no hash table.

Cases: null and not-a-number values are left out; a group without a value has null
quantiles; infinite values count in the outer bins; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

BINS = 4096


def _ranks(n: Column, q: float, method: str) -> tuple[Column, Column, Column]:
    """The ranks, from 1, of the values on either side, and the upper one's share."""
    if method == "nearest":
        r = F.greatest(F.ceil(n * q), F.lit(1)).cast("long")
        return r, r, F.lit(0.0)
    at = (n - 1) * q
    low = F.floor(at).cast("long")
    return low + 1, F.least(low + 2, n).cast("long"), at - low


def quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float], *, method: str = "linear") -> DataFrame:
    """(by, one column for each of ``qs``): interpolated, or ``nearest`` for the value whose rank is ceil(q * n)."""
    g = [f"__g{i}" for i in range(len(by))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(by, g, strict=True)], F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    finite = F.when(F.abs("__v") < float("inf"), F.col("__v"))
    whole = rows.groupBy(*g).agg(F.count(F.lit(1)).alias("__n"), F.min(finite).alias("__lo"), F.max(finite).alias("__hi"))
    whole = written(whole, "ranges")  # a row a group

    def met(x: DataFrame, y: DataFrame, *more: tuple[str, str]) -> DataFrame:
        """``x`` with the columns of the same group of ``y`` (and with equal ``more`` columns)."""
        named = y.select(*[F.col(k).alias(f"{k}y") for k in g], *[F.col(c) for c in y.columns if c not in g])
        on = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"{k}y")) for k in g] + [F.col(a) == F.col(b) for a, b in more], F.lit(True))
        return x.join(named, on).drop(*[f"{k}y" for k in g])

    width = (F.col("__hi") - F.col("__lo")) / BINS
    place = F.when(width > 0, F.floor((F.greatest(F.least("__v", "__hi"), F.col("__lo")) - F.col("__lo")) / width)).otherwise(0)
    binned = met(rows, whole if by else F.broadcast(whole)).withColumn("__b", F.least(place, F.lit(BINS - 1)).cast("int"))
    counts = binned.groupBy(*g, "__b").agg(F.count(F.lit(1)).alias("__c"), F.max("__n").alias("__n"))
    upto = F.sum("__c").over(Window.partitionBy(*g).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))  # BINS rows a group
    wanted = [r for q in qs.values() for r in _ranks(F.col("__n"), q, method)[:2]]
    each = counts.withColumn("__upto", upto).select(*g, F.col("__b").alias("__hb"), (F.col("__upto") - F.col("__c")).alias("__before"), "__upto", F.explode(F.array(*wanted)).alias("__r"))
    hit = each.filter((F.col("__r") > F.col("__before")) & (F.col("__r") <= F.col("__upto"))).select(*g, "__hb", "__before", "__r").distinct()
    hit = written(hit, "bins")  # two bins a quantile and group
    near = met(binned.drop("__n", "__lo", "__hi"), hit.select(*g, "__hb", "__before").distinct(), ("__b", "__hb")).drop("__hb")
    inside = near.groupBy(*g, "__b", "__v").agg(F.count(F.lit(1)).alias("__c"), F.max("__before").alias("__before"))
    in_bin = F.sum("__c").over(Window.partitionBy(*g, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("__to", F.col("__before") + in_bin)
    found = met(inside, hit.select(*g, "__hb", "__r"), ("__b", "__hb")).filter((F.col("__r") > F.col("__to") - F.col("__c")) & (F.col("__r") <= F.col("__to")))
    ranked = found.groupBy(*g).agg(F.map_from_entries(F.collect_set(F.struct("__r", "__v"))).alias("__m"))
    out = met(ranked, whole)
    cols = []
    for name, q in qs.items():
        low, high, share = _ranks(F.col("__n"), q, method)
        a, b = F.element_at("__m", low), F.element_at("__m", high)
        cols.append((a + F.when(share > 0, (b - a) * share).otherwise(0.0)).alias(name))
    return out.select(*[F.col(n).alias(k) for n, k in zip(g, by, strict=True)], *cols)
