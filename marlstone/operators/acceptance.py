"""Summaries of acceptance runs and gates of their categories.

Cases say what is expected, predictions what came out. Each count is a condition summed
in one pass over the joined rows; percentiles are nearest-rank and exact, by bins.

Cases: a null flag is false; a prediction without a verdict of its own is correct if its
outcome is the expected one; null latencies don't count, and without any the percentile
is null; cases without a prediction, repeated ones and unknown ones are counted as
faults and left out of the other counts; no release gives a rate of 0.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import aligned
from .quantiles import quantiles
from .retrieval import wilson

RELEASED = "auto_release"
#: A category passes with this precision.
PRECISION = 0.98


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def summary(cases: DataFrame, predictions: DataFrame, *, key: str = "case_id", latencies: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """One row: total, faults, the conditional counts, the error rate with its 95 % interval, and ``<latency>_p<percent>``.

    Cases have ``expected`` and ``stratum``; predictions ``outcome``, ``correct``, ``critical``, ``unnecessary``, ``rejected``, ``completed`` and the latencies."""
    faults = aligned(cases.select(key, "expected"), predictions.select(key, F.col("outcome").alias("predicted")), key)
    good = faults.filter("fault is null").select(key)
    rows = cases.join(predictions, key).join(good, key)
    released = F.coalesce(F.col("outcome") == RELEASED, F.lit(False))
    correct = F.coalesce(F.col("correct"), F.col("outcome") == F.col("expected"), F.lit(False))
    counts = {
        "total": F.lit(True), "released": released, "release_errors": released & ~correct, "correct_releases": released & correct, "critical": _flag("critical"), "clarified": _flag("unnecessary"), "rejected": _flag("rejected"),
        "completed": F.coalesce(F.col("stratum") == "multi_turn", F.lit(False)) & _flag("completed"),
    }
    one = rows.agg(*[F.count_if(holds).alias(n) for n, holds in counts.items()]).crossJoin(faults.agg(F.count("fault").alias("faults")))  # a row each
    low, high = wilson(F.col("release_errors"), F.col("released"))
    one = one.withColumns({"error_rate": F.coalesce(F.try_divide("release_errors", "released"), F.lit(0.0)), "error_low": F.when(F.col("released") > 0, low), "error_high": F.when(F.col("released") > 0, high)})
    asked = latencies or {"low_cost_ms": (0.95,), "upgrade_ms": (0.5, 0.95), "end_to_end_ms": (0.5, 0.95)}
    parts = [quantiles(rows, [], c, {f"{c}_p{round(100 * q)}": q for q in qs}, method="nearest") for c, qs in asked.items()]
    return functools.reduce(lambda a, b: a.join(b, F.lit(True), "left"), parts, one)  # a row each


def category_gates(rows: DataFrame, minimum: int, *, category: str = "category") -> DataFrame:
    """For each category: samples, released, correct, precision, critical, and whether it has enough releases, the precision asked for and no critical error."""
    of = rows.filter(F.coalesce(F.col(category), F.lit("")) != "").groupBy(category)
    released = _flag("released")
    n = of.agg(F.count(F.lit(1)).alias("samples"), F.count_if(released).alias("released"), F.count_if(released & _flag("correct")).alias("correct"), F.count_if(_flag("critical")).alias("critical"))
    n = n.withColumn("precision", F.coalesce(F.try_divide("correct", "released"), F.lit(0.0)))
    checks = {"enough": F.col("released") >= minimum, "precise": F.col("precision") >= PRECISION, "uncritical": F.col("critical") == 0}
    return n.withColumns(checks).withColumn("passed", F.col("enough") & F.col("precise") & F.col("uncritical"))
