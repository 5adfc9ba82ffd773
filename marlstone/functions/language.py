"""Questions and notes in Chinese and English: numerals, periods, clauses, masks, keys.

Built-in expressions only, but for two Arrow functions: Unicode composition and the
scopes of negations, which need the places of matches. Null in gives null out.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCOPES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

# Words, patterns and limits that results depend on.
DIGITS = "零一二两三四五六七八九"
DIGIT_VALUES = "01223456789"
COLLOQUIAL = {"俺": "我", "咱": "我们", "咋": "怎么", "啥": "什么", "整": "弄", "行吧": "好", "中不中": "可以吗", "妥了": "好了"}
FILLERS = ("嗯嗯", "嗯", "哦哦", "哦", "啊啊", "哎", "哎呀", "哈", "呃", "emmm", "emm")
REPEATED = ("对", "好", "是", "行")
NEGATIONS = ("不", "没", "别", "无", "非", "未", "莫", "勿", "难以", "无法", "避免", "拒绝", "不要", "不用", "不是", "不能", "不想")
SENTENCE_END = "。！？；!?;"
CONNECTORS = ("顺便", "另外", "还有", "同时", "再帮我", "以及", "还有没有")
SPOKEN_BY_USER = "我|俺|咱"
SPOKEN_TO_AGENT = "你|您"
URL = r"(?i)https?://[^\s，。；！？]+"
EMAIL = r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+"
PATH = r"(?U)(?:[A-Za-z]:)?[\\/][\w\-.\\/ ]{2,}"
PHONE = r"(?<!\d)(?:\+?86[- ]?)?1[3-9]\d{9}(?!\d)"
MASKED_PHONE = r"1[3-9]\d(?:\*{4}|\d{4})\d{4}"
ID_CARD = r"(?<!\d)\d{17}[\dXx](?!\d)"
BANK_CARD = r"(?<!\d)(?:62|60)\d{14,18}(?!\d)"
NUMBER = r"\d+(?:\.\d+)?"
INVISIBLE = "[\\u200b-\\u200d\\u2060\\ufeff\\x00-\\x1f\\x7f-\\x9f]"
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{1F1E6}-\\x{1F1FF}]"
WIDE = "　０１２３４５６７８９" + "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26))
NARROW = " 0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
YEAR = r"((?:19|20)\d{2})"
SECTIONS = (
    ("abstract", "摘要|abstract"), ("introduction", "引言|绪论|introduction|background"), ("method", "方法|模型|算法|method|methodology|approach"), ("experiment", "实验|experiment|evaluation|implementation"),
    ("result", "结果|讨论|result|discussion"), ("conclusion", "结论|总结|conclusion"), ("references", "参考文献|references|bibliography"),
)
YEAR_PLACES = (
    r"arXiv:\s*(\d{4})\.\d+", r"(?s)第\s*\d+\s*卷.*?(20\d{2})\s*年", r"(20\d{2})\s*年\s*\d+\s*月", r"(?s)Vol\.?\s*\d+.*?\((20\d{2})\)", r"\((20\d{2})\)\s*\d+\s*:\s*\d+", r"©\s*(20\d{2})", r"(20\d{2})\s*,\s*\d+\s*:",
)
#: (kind, pattern) of periods; the first that matches counts.
PERIODS = (
    ("between", YEAR + r"\s*年?\s*(?:到|至|[-–—~～]|through|to)\s*" + YEAR),
    ("after", YEAR + r"\s*年?\s*(?:之后|以后|后|later than|after)"),
    ("since", YEAR + r"\s*年?\s*(?:以来|起|及以后|since)"),
    ("until", r"(?:截至|截止到?|不晚于|through)\s*" + YEAR),
    ("before", YEAR + r"\s*年?\s*(?:以前|之前|前|before)"),
    ("recent", r"(?:近|最近)\s*([一二两三四五六七八九十\d]+)\s*年"),
    ("year", YEAR + r"\s*年"),
)


def numeral(c: Column) -> Column:
    """The number that a Chinese numeral writes: digits in a row, or digits with 十, 百 and 千; else null."""
    plain = F.translate(c, DIGITS, DIGIT_VALUES)
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("digit"))

    def step(s: Column, ch: Column) -> Column:
        unit = F.when(ch == "十", 10).when(ch == "百", 100).when(ch == "千", 1000)
        digit = F.translate(ch, DIGITS, DIGIT_VALUES).try_cast("long")
        return F.struct(
            F.when(unit.isNull(), s["total"]).otherwise(s["total"] + F.when(s["digit"] == 0, 1).otherwise(s["digit"]) * unit).cast("long").alias("total"),
            F.when(unit.isNull(), digit).otherwise(F.lit(0)).cast("long").alias("digit"),
        )

    weighed = F.aggregate(F.split(c, ""), start, step, lambda s: s["total"] + s["digit"])
    return F.when(c.rlike(f"^[{DIGITS}]+$"), plain.try_cast("long")).when(c.rlike(f"^[{DIGITS}十百千]+$"), weighed)


def period(c: Column, this_year: int) -> Column:
    """(kind, lower, lower_open, upper, upper_open) of the years that a text speaks of; null where it names none."""
    out = F.lit(None)
    n = lambda p, g=1: F.regexp_extract(c, "(?i)" + p, g)
    for kind, p in reversed(PERIODS):
        first = n(p).try_cast("int")
        low = high = F.lit(None).cast("int")
        if kind == "between":
            second = n(p, 2).try_cast("int")
            low, high = F.least(first, second), F.greatest(first, second)
        elif kind in ("after", "since"):
            low = first
        elif kind in ("until", "before"):
            high = first
        elif kind == "year":
            low = high = first
        else:
            many = F.coalesce(first, numeral(n(p))).cast("int")
            low, high = F.lit(this_year) - many + 1, F.lit(this_year)
        found = F.struct(F.lit(kind).alias("kind"), low.alias("lower"), F.lit(kind == "after").alias("lower_open"), high.alias("upper"), F.lit(kind == "before").alias("upper_open"))
        hit = c.rlike("(?i)" + p) if kind != "recent" else c.rlike(p) & (F.coalesce(first, numeral(n(p))) > 0)
        out = F.when(hit, found).otherwise(out)
    return out


@F.pandas_udf(T.StringType())
def nfc(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(SCOPES)
def negations(c: pd.Series) -> pd.Series:
    """From each negating word to the end of its sentence, in code points."""
    word, end = re.compile("|".join(sorted(NEGATIONS, key=len, reverse=True))), re.compile(f"[{re.escape(SENTENCE_END)}]")

    def scopes(x):
        if x is None:
            return None
        ends = [m.start() for m in end.finditer(x)] + [len(x)]
        out, i = [], 0
        for m in word.finditer(x):
            while ends[i] < m.start():
                i += 1
            out.append({"start": m.start(), "end": ends[i]})
        return out

    return c.map(scopes)


def tidy(c: Column) -> Column:
    """Composed, half-width letters and digits, no invisible marks, emoji named, blanks collapsed."""
    c = F.regexp_replace(F.translate(nfc(c), WIDE, NARROW), INVISIBLE, "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, EMOJI, "[emoji]"), r"\s+", " "))


def mask_places(c: Column) -> Column:
    for p, to in ((URL, "[URL]"), (EMAIL, "[EMAIL]"), (PATH, "[PATH]")):
        c = F.regexp_replace(c, p, to)
    return c


def plain_speech(c: Column) -> Column:
    """Colloquial words replaced, one leading filler dropped, repeated assent folded."""
    for word, to in COLLOQUIAL.items():
        c = F.replace(c, F.lit(word), F.lit(to))
    c = F.regexp_replace(c, f"^(?:{'|'.join(FILLERS)})\\s*", "")
    for word in REPEATED:
        c = F.regexp_replace(c, f"(?:{word}){{2,}}", word)
    return c


def mask_people(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, SPOKEN_BY_USER, "用户"), SPOKEN_TO_AGENT, "Agent")
    for p in (PHONE, MASKED_PHONE, ID_CARD, BANK_CARD):
        c = F.regexp_replace(c, p, "[PII]")
    return c


def memory_text(c: Column) -> Column:
    """(text, negations): the six cleaning steps; scopes count in the text before people are masked."""
    spoken = plain_speech(mask_places(tidy(c)))
    return F.struct(mask_people(spoken).alias("text"), negations(spoken).alias("negations"))


def lost(original: Column, cleaned: Column) -> Column:
    """Numbers, negations and markers of ``original`` that ``cleaned`` lacks; numbers that masks cover may go."""
    numbers = lambda x: F.regexp_extract_all(x, F.lit(NUMBER), F.lit(0))
    covered = F.array_union(*[F.flatten(F.transform(F.regexp_extract_all(original, F.lit(p), F.lit(0)), numbers)) for p in (PHONE, MASKED_PHONE)])
    for p in (ID_CARD, BANK_CARD, URL, EMAIL):
        covered = F.array_union(covered, F.flatten(F.transform(F.regexp_extract_all(original, F.lit(p), F.lit(0)), numbers)))
    words = F.filter(F.array(*[F.lit(x) for x in (*NEGATIONS, "[URL]", "[EMAIL]", "[PATH]", "[PII]")]), lambda w: F.contains(original, w) & ~F.contains(cleaned, w))
    return F.array_union(F.array_sort(F.array_except(F.array_except(numbers(original), covered), numbers(cleaned))), words)


def questions(c: Column) -> Column:
    """(first, others) of a compound question: parts at question marks, or from a connecting word on; two others at most."""
    c = F.trim(c)
    cut = lambda x: F.regexp_replace(x, "[，,。.;；:： ]+$", "")
    parts = F.filter(F.transform(F.split(c, "[?？]+"), lambda p: F.trim(p)), lambda p: p != "")
    first, rest = cut(F.get(parts, F.lit(0))), F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: F.length(p) >= 2)
    out = F.struct(c.alias("first"), F.array().cast("array<string>").alias("others"))
    for word in reversed(CONNECTORS):
        at = F.instr(c, word)
        head, tail = cut(F.left(c, at - 1)), F.trim(F.substr(c, at))
        out = F.when((at > 3) & (F.length(head) >= 4) & (F.length(tail) >= 2), F.struct(head.alias("first"), F.array(tail).alias("others"))).otherwise(out)
    return F.when((F.size(parts) >= 2) & (F.length(first) >= 2) & (F.size(rest) > 0), F.struct(first.alias("first"), F.slice(rest, 1, 2).alias("others"))).otherwise(out)


def section_type(title: Column) -> Column:
    t = F.lower(title)
    out = F.lit("body")
    for kind, p in reversed(SECTIONS):
        out = F.when(t.rlike(p), kind).otherwise(out)
    return out


def fallback_year(head: Column, *metadata: Column) -> Column:
    """The first place that holds a year from 1990 to 2026, then the first year of the metadata."""
    years = [F.regexp_extract(head, p, 1).try_cast("int") for p in YEAR_PLACES]
    return F.coalesce(*[F.when(y.between(1990, 2026), y) for y in years], *[F.regexp_extract(m, r"(20\d{2})", 1).try_cast("int") for m in metadata])


def tokens(c: Column) -> Column:
    """Distinct ASCII names and numbers, and pairs of neighbouring CJK characters."""
    t = F.regexp_replace(F.lower(c), r"\s+", "")
    cjk = F.regexp_replace(t, "[^\\u4e00-\\u9fff]", "")
    n = F.length(cjk) - 1
    pairs = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(cjk, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.array_union(F.regexp_extract_all(t, F.lit(r"[a-z_][a-z0-9_]*|[-+]?\d+(?:\.\d+)?"), F.lit(0)), pairs)


def keyed_hash(c: Column, salt: str, digits: int = 16) -> Column:
    """HMAC-SHA256 under ``salt``, its first hexadecimal digits; null and '' give null, no salt the text itself."""
    if not salt:
        return F.nullif(c, F.lit(""))
    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    mac = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(c, "UTF-8")), 256))), 256)
    return F.when(c != "", F.left(mac, F.lit(digits)))
