"""Vectors of texts: hashed character trigrams under a sparse random projection.

A text in lower case, its runs of white space as one blank and a blank at either end,
gives its trigrams; each is hashed and adds a sign to ``SPREAD`` of ``DIMS``
components. Texts that share trigrams have vectors with a high cosine, whatever their
lengths. Whole-number sums of each row where it is read, over the code points of many
texts at a time, and no shuffle: no learned model, the same vector on every machine.

Cases: a null text, and one without anything but white space, has no vector (null); a
text of any length is read whole; rows are encoded by themselves, so repeated ids keep
their own texts; ids and other columns of any name pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

DIMS, SPREAD = 64, 2
#: Multipliers of the three characters, of the mixing steps, and the modulus (a prime).
MULTIPLIERS, MIXERS, PRIME = (7919, 104729, 1299709), (48271, 69621), 2147483647
#: Bytes of texts that are encoded at a time; a longer text comes alone.
AT_ONCE = 500_000


def normal(text: Column) -> Column:
    """The text between blanks, white space collapsed, in lower case."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+", " ")), F.lit(" "))


def sums(texts: list[str], dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """(texts x dims) sums of the signs of each text's trigrams, and its number of trigrams."""
    sizes = np.fromiter(map(len, texts), "i8", len(texts))
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "u4").astype("i8")
    row = np.repeat(np.arange(len(texts)), sizes)
    a, b, d = MULTIPLIERS
    grams = (c[:-2] * a + c[1:-1] * b + c[2:] * d) % PRIME
    inside = row[:-2] == row[2:]
    grams, row = grams[inside], row[:-2][inside]
    out = np.zeros(len(texts) * dims)
    for m in MIXERS[:SPREAD]:
        h = grams * m % PRIME
        out += np.bincount(row * dims + h % dims, np.where(h // dims % 2 == 0, 1.0, -1.0), len(out))
    return out.reshape(len(texts), dims), np.bincount(row, minlength=len(texts))


def encoded(df: DataFrame, text_col: str, *, as_col: str = "vector", dims: int = DIMS) -> DataFrame:
    """``df`` with a vector of whole numbers (array<double>) for each row's text."""
    own = [c for c in df.columns if c != as_col]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__all"), normal(F.col(f"`{text_col}`").cast("string")).alias("__text"))

    def run(batches):
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("__text")), 0).to_numpy(zero_copy_only=False).astype("i8"))
            start = 0
            while start < len(ends):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
                part = batch.slice(start, stop - start)
                value, n = sums([t or "" for t in part.column("__text").to_pylist()], dims)
                # a row without a trigram has no vector
                vectors = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum((n > 0) * dims)).astype("i4"), mask=np.append(n == 0, False)), pa.array(value[n > 0].ravel()))
                yield pa.RecordBatch.from_arrays([part.column("__all"), vectors], ["__all", "__vector"])
                start = stop

    schema = StructType([rows.schema["__all"], StructField("__vector", ArrayType(DoubleType()))])
    return rows.mapInArrow(run, schema).select("__all.*", F.col("__vector").alias(as_col))
