"""Text columns: cleaning, masking, tokens. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "\\u4e00-\\u9fff"
#: Full-width ASCII and the ideographic blank, and what they become.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f\x0B]+", " "))


def clean_embed(c: Column) -> Column:
    """Without zero-width marks; everything but CJK, ASCII letters and digits becomes a blank; blanks collapse."""
    return collapse(F.regexp_replace(F.regexp_replace(c, "[​-‏﻿]", ""), f"[^{CJK}a-zA-Z0-9]", " "))


def clean_pdf(c: Column) -> Column:
    return collapse(F.regexp_replace(c, f"[^{CJK}a-zA-Z0-9.,;:!?()%\\-]", " "))


def half_width(c: Column) -> Column:
    return F.translate(c, WIDE, NARROW)


def token_estimate(c: Column, output: int = 0) -> Column:
    """One for each CJK character, mark or full-width form, a quarter for the others, a tenth more; and what the answer may take."""
    cjk = F.length(F.regexp_replace(c, f"[^{CJK}\\u3000-\\u303f\\uff00-\\uffef]", ""))
    return (F.floor((cjk + F.floor((F.length(c) - cjk) / 4)) * F.lit(11) / 10) + output).cast("long")


def language_by_script(c: Column, share: float = 0.05, most: int = 5000) -> Column:
    """By the share of CJK characters among the first ``most``."""
    c = F.left(c, F.lit(most))
    n = F.length(F.regexp_replace(c, f"[^{CJK}]", ""))
    return F.when(n > F.length(c) * share, "zh").otherwise("en")


def normalise_query(c: Column, most: int = 200) -> Column:
    return F.lower(F.substring(collapse(half_width(F.trim(c))), 1, most))


def mask_ip(c: Column) -> Column:
    parts = F.split(c, r"\.")
    return F.when(F.size(parts) == 4, F.concat(F.array_join(F.slice(parts, 1, 3), "."), F.lit(".***"))).otherwise(F.lit("***"))


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def quality(text: Column) -> Column:
    """1, less what missing text, empty pages and replacement characters cost; 0 at least."""
    n = F.length(F.coalesce(text, F.lit("")))
    empty = F.coalesce(F.trim(text), F.lit("")) == ""
    bad = (n - F.length(F.replace(F.coalesce(text, F.lit("")), F.lit("�"), F.lit("")))) / F.greatest(n, F.lit(1))
    lost = F.when(empty, 0.7).otherwise(0.0) + F.when(empty, 0.5).otherwise(0.0) + F.least(F.lit(0.4), bad * 20)
    return F.greatest(F.lit(0.0), 1 - lost)


def quality_grade(score: Column) -> Column:
    return F.when(score >= 0.8, "pass").when(score >= 0.55, "review").otherwise("fail")
