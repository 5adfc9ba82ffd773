"""Values: exact arithmetic on text, hashes, canonical JSON, vectors, arrays, nested columns.

Only the exact calculator needs Python (Spark has no rational type and doesn't
evaluate text); the rest are built-in expressions. Null in gives null out.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from decimal import Decimal, localcontext
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits of the calculator.
MOST_CHARS, MOST_TOKENS, MOST_DEPTH, MOST_DIGITS, MOST_POWER, MOST_BITS, MOST_RESULT = 256, 64, 16, 32, 64, 4096, 256
_TOKEN = re.compile(r"\d+(?:\.\d+)?|\*\*|//|[-+*/%()]")
_BINDS = {"+": 1, "-": 1, "*": 2, "/": 2, "//": 2, "%": 2, "neg": 3, "pos": 3, "**": 4}


class Invalid(ValueError):
    """Text that is no expression, or one beyond the limits."""


def _power(a: Fraction, b: Fraction) -> Fraction:
    if b.denominator != 1 or abs(b) > MOST_POWER:
        raise Invalid("exponent")
    return a ** int(b)


_DOES: dict[str, Callable[[Fraction, Fraction], Fraction]] = {
    "+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "//": lambda a, b: Fraction(a // b), "%": operator.mod, "**": _power,
}


def calculate(text: str) -> Fraction:
    """The exact value of an expression of numbers, + - * / // % ** and parentheses, by operator precedence."""
    tokens = _TOKEN.findall(text)
    if "".join(tokens) != re.sub(r"\s+", "", text) or not tokens:
        raise Invalid("characters")
    if len(text) > MOST_CHARS or len(tokens) > MOST_TOKENS:
        raise Invalid("length")
    values: list[Fraction] = []
    waiting: list[str] = []

    def apply(op: str) -> None:
        if op in ("neg", "pos"):
            if not values:
                raise Invalid("operand")
            values.append(-values.pop() if op == "neg" else values.pop())
        else:
            if len(values) < 2:
                raise Invalid("operand")
            b, a = values.pop(), values.pop()
            values.append(_DOES[op](a, b))
        if max(values[-1].numerator.bit_length(), values[-1].denominator.bit_length()) > MOST_BITS:
            raise Invalid("size")

    operand = False  # whether a value has just ended
    for t in tokens:
        if t[0].isdigit():
            if operand or sum(c.isdigit() for c in t) > MOST_DIGITS:
                raise Invalid("number")
            values.append(Fraction(t))
            operand = True
        elif t == "(":
            if operand or waiting.count("(") >= MOST_DEPTH:
                raise Invalid("parenthesis")
            waiting.append(t)
        elif t == ")":
            while waiting and waiting[-1] != "(":
                apply(waiting.pop())
            if not waiting or not operand:
                raise Invalid("parenthesis")
            waiting.pop()
        elif not operand:
            if t not in "+-":
                raise Invalid("operand")
            waiting.append("neg" if t == "-" else "pos")
        else:
            while waiting and waiting[-1] != "(" and (_BINDS[waiting[-1]] > _BINDS[t] or _BINDS[waiting[-1]] == _BINDS[t] and t != "**"):
                apply(waiting.pop())
            waiting.append(t)
            operand = False
    while waiting:
        if waiting[-1] == "(":
            raise Invalid("parenthesis")
        apply(waiting.pop())
    if len(values) != 1 or not operand:
        raise Invalid("operand")
    return values[0]


def shown(value: Fraction) -> str:
    """An integer, a decimal that ends, or a fraction."""
    d = value.denominator
    for p in (2, 5):
        while d % p == 0:
            d //= p
    if value.denominator == 1 or d != 1:
        return str(value)
    with localcontext() as c:
        c.prec = max(64, 2 * value.denominator.bit_length())
        return format((Decimal(value.numerator) / Decimal(value.denominator)).normalize(), "f")


_RESULT = T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType())])


def exact(c: Column) -> Column:
    """(value, error) of each text as exact arithmetic; one of the two is null."""

    @F.pandas_udf(_RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        def one(x):
            if x is None:
                return None, None
            try:
                out = shown(calculate(x))
                return (out, None) if len(out) <= MOST_RESULT else (None, "result")
            except ZeroDivisionError:
                return None, "division by zero"
            except Invalid as e:
                return None, str(e)

        return pd.DataFrame([one(x) for x in texts], columns=["value", "error"])

    return run(c)


def unit_vector(c: Column) -> Column:
    """A vector of length one in the same direction; a zero vector gives nulls."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: F.try_divide(x.cast("double"), norm))


def short_id(*parts: Column, digits: int = 24) -> Column:
    """The first hexadecimal digits of the SHA-256 of the parts between NUL marks."""
    text = F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.left(F.sha2(text, 256), F.lit(digits))


def short_sha1(c: Column, digits: int = 12) -> Column:
    return F.left(F.sha1(c), F.lit(digits))


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys; for strings, integers, booleans and their arrays."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def lenient_json(c: Column, schema: str) -> Column:
    """JSON, in a code fence or not, under a schema; null where it isn't JSON."""
    return F.from_json(F.regexp_replace(F.trim(c), r"(?s)^```[^\n]*\n(.*?)\n?```\s*$", "$1"), schema)


def flattened(df: DataFrame) -> DataFrame:
    """Nested fields as columns with dotted names, to any depth."""
    out: list[Column] = []

    def walk(kind: T.StructType, path: tuple[str, ...]) -> None:
        for f in kind.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(".".join(here)))

    walk(df.schema, ())
    return df.select(*out)


def shares_any(a: Column, words: list[str]) -> Column:
    """Some element of an array holds one of the words, in any case."""
    return F.exists(a, lambda x: F.lower(x).rlike("|".join(re.escape(w.lower()) for w in words)))
