"""Cleaning and reading of questions: shells, fillers, numerals, entities, references to what was said.

Built-in expressions but for ``homophones``. Null in gives null out, but for ``safe_text`` and ``typed``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import language as L
from . import text as X

# Words and patterns that results depend on.
SHELLS = (
    "我想看看", "我想了解", "我想知道", "我想查一下", "我需要", "我想要", "回头看", "我们来看", "来看一下", "我们来看一下", "帮我看看", "帮我查一下", "帮我找一下", "我想", "我要", "请问", "麻烦", "帮我",
)
PLAIN_WORDS = (("咋样", "如何"), ("咋", "怎么"), ("啥", "什么"), ("瞅瞅", "看看"), ("瞧瞧", "看看"), ("看下", "查询"), ("查查", "查询"))
FILLERS = ("就是说", "那个", "然后", "嗯嗯", "哦哦", "嗯", "哦", "呃", "emmm", "emm", "啊", "呀")
WIDE_LETTERS = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
NARROW_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
WIDE_MARKS, NARROW_MARKS = "，。！？：；（）【】“”‘’～", ",.!?:;()[]\"\"''~"
SECRETS = (r"(?i)\b(?:authorization|api[_-]?key|access[_-]?token|credential)\b\s*[:=]\s*\S+", r"\bsk-[A-Za-z0-9_-]{12,}\b")
SECRET_KEYS = ("reasoning_content", "chain_of_thought", "authorization", "api_key")
REFERRING = ("它", "他", "她", "那个", "这个", "刚才", "之前", "上次", "前面", "上面", "那些", "这种", "那篇", "那本书", "那条", "那件事")
REFERRING_PHRASES = ("刚才说的", "上次提的", "上次说的", "之前那个", "之前说的", "前面说的", "那个关于", "之前提过", "上次聊的")
ASKING = ("哪些", "什么", "如何", "咋样", "怎么样", "为啥", "为什么", "怎么", "多少")
ENTITY = r"[A-Za-z][A-Za-z0-9_\-]{1,24}|[一-龥]{2,6}(?:论文|项目|方案|模型|系统|方法|实验|结果|数据|网络|算法|技术|资料|工作|事)?"
NOT_ENTITIES = ("这个", "那个", "这些", "那些", "什么", "怎么", "为什么", "是不是", "没有", "不是")
EMPTY_CHARACTERS = "那个什么怎么这这些那些是吗的好继续嗯可以知道明白没问题稍等是的对啊行吧谢谢咋俺咱啥哎哎呀哦哦嗯嗯呀呢吧嘛啦"
NAMING_ENDS = ("论文", "项目", "方案", "模型", "系统", "方法", "实验", "结果", "数据", "网络", "算法", "技术", "资料", "工作", "研究", "原理", "结构", "框架", "应用", "预测")
JOINING = "和与及或并在对把从为用"
VERB_ENDS = "写用讲做说是有着考看查完改提读问算学了过"
POINTING_ENDS = ("那篇论文", "这篇论文", "那几篇", "那篇", "这篇", "那本", "这本", "那个", "这个", "那些", "这种")
POINTING_STARTS = ("上次", "刚才", "之前", "前面", "先前", "上回")
POINTED = r"(?:上次|刚才|之前|前面|先前|上回)(?:(?:查|找|看|说|提|讲|问|写|用)?的?|那个|这个|那篇|这篇|那本)(?:那篇论文|论文|方案|模型|那篇|文章|资料|实验|结果|东西)"
LONGEST_REFERENCE, SHORT_QUESTION, MOST_ENTITIES = 50, 12, 5
REFERENCES = r"(?is)(?:参考文献|references)\s*(.{1,2500})"


def safe_text(c: Column) -> Column:
    """Text of a string or binary column: null is '', bytes that aren't UTF-8 are replaced."""
    return F.coalesce(F.call_function("make_valid_utf8", c.cast("string")), F.lit(""))


def ranked_query(c: Column) -> Column:
    """What full-text search reads of a question: CJK, ASCII letters, digits."""
    return X.collapse(F.regexp_replace(c, r"[^一-龥a-zA-Z0-9\s]", " "))


def typed(c: Column) -> Column:
    """What a user typed: no control or invisible marks, half-width letters and marks, repeated marks once, blanks collapsed. Null is ''."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[�\x00-\x1f\x7f​-‏‪-‮⁠﻿]", "")
    c = F.translate(c, WIDE_LETTERS + WIDE_MARKS, NARROW_LETTERS + NARROW_MARKS)
    for marks, one in (("!！", "！"), ("?？", "？"), (".。", "。"), (",，", "，")):
        c = F.regexp_replace(c, f"[{marks}]{{2,}}", one)
    return X.collapse(F.regexp_replace(c, "(?U)\\s+", " "))


def _all(word_pairs) -> Column:
    def run(c: Column) -> Column:
        for a, b in word_pairs:
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    return run


def without_shells(c: Column) -> Column:
    """Without polite openings at the beginning of each sentence, and the marks that they leave."""
    return F.regexp_replace(c, f"(^|[？?。！!])(?:{'|'.join(SHELLS)})*[，,;；、\\s]*", "$1")


def digits_in_times(c: Column) -> Column:
    """Chinese numerals before a unit of time as digits. Pieces between the matches and the matches are put together again."""
    p = "[零一二两三四五六七八九十百]+[年月号日点时]"
    found, pieces = F.regexp_extract_all(c, F.lit(p), F.lit(0)), F.split(c, p, -1)
    said = F.transform(found, lambda m: F.concat(F.coalesce(L.numeral(F.substring(m, 1, F.length(m) - 1)).cast("string"), F.substring(m, 1, F.length(m) - 1)), F.right(m, F.lit(1))))
    return F.array_join(F.zip_with(pieces, said, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


# The rules' names and order. Each takes the text that the one before leaves.
RULES = (
    ("fullwidth", X.half_width),
    ("garbage_chars", lambda c: F.regexp_replace(c, r"[�\x00-\x08\x0b\x0c\x0e-\x1f]", "")),
    ("fillers", _all([(f, "") for f in FILLERS])),
    ("colloquial", _all(sorted(PLAIN_WORDS, key=lambda p: -len(p[0])))),
    ("shells", without_shells),
    ("punct_compress", lambda c: F.regexp_replace(c, r"([，。！？；!?])\1+", "$1")),
    ("time_cn_digits", digits_in_times),
)


def cleaned(df, column: str, out: str = "cleaned", rules=RULES):
    """``df`` with ``out``, and ``out``_steps: (rule, before, after) of each rule that changed something."""
    names = [f"__{out}_{i}" for i in range(len(rules) + 1)]
    df = df.withColumn(names[0], F.trim(F.col(column)))
    for before, after, (_, rule) in zip(names, names[1:], rules, strict=False):
        df = df.withColumn(after, rule(F.col(before)))
    steps = [F.when(F.col(a) != F.col(b), F.struct(F.lit(r).alias("rule"), F.col(a).alias("before"), F.col(b).alias("after"))) for a, b, (r, _) in zip(names, names[1:], rules, strict=False)]
    return df.withColumn(out, F.col(names[-1])).withColumn(f"{out}_steps", F.array_compact(F.array(*steps))).drop(*names)


def homophones(c: Column, entities: list[str], reading: dict[str, str]) -> Column:
    """Runs of characters that read like a known entity, spelled as it is. ``reading`` gives each character's sound."""
    sounds = {w: [reading.get(x) for x in w] for w in entities}

    @F.pandas_udf("string")
    def fix(texts: pd.Series) -> pd.Series:
        def one(t):
            for w, said in sounds.items():
                heard = [reading.get(x) for x in t]
                i = 0
                while None not in said and i + len(w) <= len(t):
                    if heard[i : i + len(w)] == said:
                        t = t[:i] + w + t[i + len(w) :]
                        i += len(w)
                    else:
                        i += 1
            return t

        return texts.map(lambda t: None if t is None else one(t))

    return fix(c)


def redacted(c: Column) -> Column:
    for p in SECRETS:
        c = F.regexp_replace(c, p, "[REDACTED]")
    return c


def redacted_map(c: Column) -> Column:
    """A map of strings: values under secret keys go, the others lose what looks like a secret."""
    return F.transform_values(c, lambda k, v: F.when(F.lower(k).isin(*SECRET_KEYS), "[REDACTED]").otherwise(redacted(v)))


def title_language(*parts: Column) -> Column:
    return F.when(F.concat_ws("", *parts).rlike(r"[一-鿿]"), "zh").otherwise("en")


def shared_topic(a: Column, b: Column) -> Column:
    """The first run of four, else three, else two CJK characters of ``b`` that ``a`` has too."""

    def first(n: int) -> Column:
        runs = F.when(F.length(b) >= n, F.transform(F.sequence(F.lit(1), F.length(b) - n + 1), lambda i: F.substring(b, i, F.lit(n))))
        return F.get(F.filter(runs, lambda r: r.rlike(f"^[\\u4e00-\\u9fff]{{{n}}}$") & F.contains(a, r)), F.lit(0))

    return F.coalesce(first(4), first(3), first(2))


def _has(c: Column, words) -> Column:
    return c.rlike("|".join(words))


def entities(c: Column) -> Column:
    """Up to five names of a text: words of ASCII letters, and Chinese noun runs without question words, verb ends and pointing ends."""
    token = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(ENTITY), F.lit(0))
    token = F.filter(token, lambda t: ~t.isin(*NOT_ENTITIES, *REFERRING) & ~t.rlike(f"^[{EMPTY_CHARACTERS}]+$") & ~_has(t, ASKING))
    cut = lambda t: F.when((F.length(t) > 2) & t.rlike(f"[{VERB_ENDS}]$"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    token = F.transform(F.transform(F.transform(token, cut), cut), pointing_end_cut)
    strong = lambda t: t.rlike(r"^[A-Za-z][A-Za-z0-9_\-]{1,24}$") | (F.length(t) <= 4) | t.rlike(f"(?:{'|'.join(NAMING_ENDS)})$")
    return F.slice(F.array_distinct(F.filter(token, lambda t: ~t.rlike(f"^[{JOINING}]") & strong(t))), 1, MOST_ENTITIES)


def pointing_end_cut(c: Column) -> Column:
    return F.regexp_replace(c, f"^(.+?)(?:{'|'.join(POINTING_ENDS)})$", "$1")


def refers_back(c: Column, before: Column, window: int = 3) -> Column:
    """A short message that points to something which none of the last messages names."""
    n = F.size(before)
    recent = F.array_join(F.slice(before, F.greatest(n - window + 1, F.lit(1)), window), " ")
    return (F.length(c) <= LONGEST_REFERENCE) & _has(c, REFERRING_PHRASES + REFERRING) & (F.size(entities(recent)) == 0)


def completed(c: Column, before: Column) -> Column:
    """A question that leaves out its subject, with the first entity of the latest of the two messages before that has one."""
    msg = F.trim(c)
    points = msg.rlike(f"^(?:{'|'.join(POINTING_STARTS)})")
    bare = pointing_end_cut(msg)
    n = F.size(before)
    last = lambda k: F.get(entities(F.get(before, n - k)), F.lit(0))
    entity = F.coalesce(F.when(n >= 1, last(1)), F.when(n >= 2, last(2)))
    needs = points | ((F.size(entities(bare)) == 0) & (_has(bare, ASKING) | (F.length(bare) <= SHORT_QUESTION)))
    at = F.regexp_instr(bare, F.lit(POINTED))
    pointed = F.regexp_extract(bare, POINTED, 0)
    replaced = F.concat(F.substring(bare, F.lit(1), at - 1), entity, F.substring(bare, at + F.length(pointed), F.length(bare)))
    out = F.when(points & (pointed != ""), replaced).otherwise(F.concat(entity, F.lit(" "), bare))
    return F.when(needs & entity.isNotNull() & ~F.contains(bare, entity) & (msg != ""), out).otherwise(F.when(msg == "", msg).otherwise(bare))


def reference_section(c: Column) -> Column:
    """What follows the heading of the references, 2,500 characters at most; '' without one."""
    return F.regexp_extract(c, REFERENCES, 1)


def highlights(c: Column, terms: list[str], *, width: int = 150, most: int = 3) -> Column:
    """Up to three pieces of 150 characters that hold a term, the terms marked."""
    n = F.greatest(F.ceil(F.length(c) / F.lit(width)).cast("int"), F.lit(1))
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * width + 1, F.lit(width)))
    p = "(?i)(" + "|".join(terms) + ")"
    return F.slice(F.transform(F.filter(pieces, lambda x: x.rlike(p)), lambda x: F.regexp_replace(x, p, "**$1**")), 1, most)
