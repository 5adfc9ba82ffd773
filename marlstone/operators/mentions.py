"""Names of a dictionary found in a table's texts: longest first, none overlapping.

Names and texts are cut into words. Each text gives the windows of words whose first
word begins a name and whose length a name has, and these meet the names by equality,
so the work grows with the texts' words and not with the number of names, which may be
any. What was found in a text is then taken longest first, from the left, unless it
overlaps what is taken: one pass over a text's matches, ordered, with a mark a word.

Cases: null texts and names without a word match nothing; names that differ in case or
punctuation only are one, shown as the one that sorts first; each row of a repeated id
is a text of its own; very long texts are read whole; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: First words of names up to which they are broadcast to drop windows early; beyond, the join alone decides.
FIRST_WORDS = 50_000
_SPANS = "array<struct<start: int, size: int, name: string>>"


def _taken(found: pd.Series) -> pd.Series:
    """Of a text's (size, start, name), ordered by size from the longest and then by start, those that overlap no earlier one."""

    def one(spans):
        marks, out = bytearray(max((s["start"] + s["size"] for s in spans), default=0)), []
        for s in spans:
            if not any(marks[s["start"] : s["start"] + s["size"]]):
                marks[s["start"] : s["start"] + s["size"]] = b"\1" * s["size"]
                out.append({"start": s["start"], "size": s["size"], "name": s["name"]})
        return sorted(out, key=lambda s: s["start"])

    return found.map(one)


def mentions(df: DataFrame, names: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", name_col: str = "name") -> DataFrame:
    """(id, start, size, name): the names found, by their first word's number (from 0) and their number of words."""
    shown = names.select(F.col(f"`{name_col}`").alias("name"), T.words(F.col(f"`{name_col}`")).alias("w")).filter("size(w) > 0")
    known = shown.groupBy(F.array_join("w", " ").alias("key")).agg(F.min("name").alias("name"), F.first(F.size("w")).alias("size"), F.first(F.get("w", F.lit(0))).alias("first"))
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # as many as there are lengths of names
    kind = df.schema[id_col].dataType.simpleString()
    if not sizes:
        return df.sparkSession.createDataFrame([], f"{id_col} {kind}, start int, size int, name string")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"), T.words(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("w"))
    firsts = known.select("first").distinct()
    at = rows.select("id", "row", "w", F.posexplode("w").alias("start", "first"))
    if firsts.limit(FIRST_WORDS + 1).count() <= FIRST_WORDS:
        at = at.join(F.broadcast(firsts), "first", "left_semi")
    lengths = F.array(*[F.lit(s) for s in sizes])
    windows = at.select("id", "row", "start", F.explode(F.transform(F.filter(lengths, lambda m: F.col("start") + m <= F.size("w")), lambda m: F.struct(m.alias("size"), F.array_join(F.slice("w", F.col("start") + 1, m), " ").alias("key")))).alias("x"))
    found = windows.select("id", "row", "start", "x.size", "x.key").join(known.select("key", "name"), "key")
    spans = found.groupBy("id", "row").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("less"), "start", "size", "name"))).alias("l"))  # a text's own
    taken = spans.select("id", F.explode(F.pandas_udf(_taken, _SPANS)("l")).alias("s"))
    return taken.select(F.col("id").alias(id_col), "s.start", "s.size", "s.name")
