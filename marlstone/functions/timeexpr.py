"""Time expressions in Chinese questions: years, months, days, minutes, relative and vague periods.

``find`` gives every expression of a text in order of place. Rules are tried in
order of rank; a place that one rule has taken is closed to the later ones, so a
range hides the dates inside it. The clock is a parameter, so results depend on
nothing else. ``times`` is the same as a column, by Arrow batches: which rule wins
at which place can't be said with built-in expressions.

Cases: null gives null; a text without an expression gives an empty array; numbers
that are no date give an expression with ``invalid`` set; document identifiers
(preprint numbers, DOIs) aren't read as years; texts are read whole.
"""

from __future__ import annotations

import re
from calendar import monthrange
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import date, datetime, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Span:
    """A period or instant; ``start`` and ``end`` are closed bounds in ISO form at the grain's length."""

    op: str | None = None
    start: str | None = None
    end: str | None = None
    exact: str | None = None
    grain: str = "year"
    sort: str | None = None
    vague: bool = False
    word: str = ""
    zone: str = ""
    invalid: str = ""
    raw: str = ""


NOW = datetime(2026, 8, 20, 15, 0)

# Words, years and patterns that results depend on.
ANCHORS = {
    "非典": (2003, 2003), "sars": (2003, 2003), "疫情": (2020, 2022), "新冠": (2020, 2022), "甲流": (2009, 2009), "金融危机": (2008, 2009), "次贷危机": (2007, 2008), "汶川地震": (2008, 2008), "北京奥运": (2008, 2008),
    "改革开放": (1978, 1978), "入世": (2001, 2001), "加入wto": (2001, 2001), "互联网泡沫": (2000, 2001), "贸易战": (2018, 2019),
}
ZONES = {
    "北京时间": "Asia/Shanghai", "中国标准时间": "Asia/Shanghai", "中国时间": "Asia/Shanghai", "美国东部时间": "America/New_York", "美东时间": "America/New_York", "美国西部时间": "America/Los_Angeles",
    "美西时间": "America/Los_Angeles", "英国时间": "Europe/London", "伦敦时间": "Europe/London", "日本时间": "Asia/Tokyo", "东京时间": "Asia/Tokyo", "UTC": "UTC", "GMT": "UTC",
}
NUMERALS = {"一": 1, "两": 2, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
VAGUE_MONTHS = {"最近": 3, "近期": 3, "前阵子": 1, "最近一段时间": 3}
PARTS_OF_YEAR = (("初", 1, 3), ("年中", 4, 9), ("年底", 10, 12), ("上半年", 1, 6), ("下半年", 7, 12))
IDENTIFIERS = r"\d{4}\.\d{5}[v.]?\d*|S\d{11,}|10\.\d{4,9}/[\w.\-]+"
TO = r"(?:至|到|~|-)"
UP_TO_NOW = r"(?:至今|迄今|为止|到现在)"
YEAR = r"(?:19|20)\d{2}"
CJK_NUMBER = r"[一二两三四五六七八九十]+"
DAY_PART = r"凌晨|清晨|早上|上午|中午|下午|傍晚|晚上"
NEAREST = r"(?:距离|离)(?:今天|当前|现在|指定日期|该日期).{0,10}?最近的?(?:一|1|某)?(?:份|篇|次|条|个)|最近的?(?:一|1)(?:份|篇|次|条|个)"
VAGUE = r"那几年|那阵子|刚发布那会儿|毕业后|刚.{0,4}那会儿"


def _clock(n: str) -> str:
    return rf"(?:(?P<part{n}>{DAY_PART})\s*)?(?P<hour{n}>\d{{1,2}})(?:[:：](?P<minute{n}>\d{{2}})|[点时](?P<spoken{n}>\d{{1,2}})?分?)"


def _number(text: str, otherwise: int) -> int:
    return int(text) if text.isdigit() else NUMERALS.get(text, otherwise)


def _month(year: int, month: int) -> int:
    """Months since year 0; an impossible month is an error."""
    if not 1 <= month <= 12:
        raise ValueError(month)
    return year * 12 + month - 1


def _first(months: int) -> str:
    return f"{months // 12:04d}-{months % 12 + 1:02d}-01"


def _last(months: int) -> str:
    y, m = months // 12, months % 12 + 1
    return f"{y:04d}-{m:02d}-{monthrange(y, m)[1]:02d}"


def _months(a: int, b: int, **more) -> Span:
    return Span("between", _first(a), _last(b), grain="month", **more)


def _today(now: datetime) -> str:
    return now.date().isoformat()


def _around(first: int, last: int, n: int, unit: str) -> Span:
    """The years first to last with n units on either side."""
    word = f"前后{n}{unit}"
    if unit == "年":
        return Span("between", f"{first - n}-01-01", f"{last + n}-12-31", word=word)
    wide = n * 3 if unit == "季度" else n
    return _months(_month(first, 1) - wide, _month(last, 12) + wide, word=word)


def _anchor(m: re.Match, now: datetime) -> Span | None:
    first, last = ANCHORS[m["event"].lower()]
    tail = m["tail"]
    if wide := re.search(rf"前后(\d+|{CJK_NUMBER})个?(年|月|季度)", tail):
        return _around(first, last, _number(wide[1], 1), wide[2])
    if "前后" in tail:
        return Span("between", f"{first - 1}-01-01", f"{last + 1}-12-31")
    if "期间" in tail:
        return Span("between", f"{first}-01-01", f"{last}-12-31")
    if re.search("以来|至今|到现在", tail):
        return Span("between", f"{first}-01-01", _today(now), grain="day")
    return Span("gte", str(last + 1)) if re.search("之后|以后", tail) else Span("lte", end=str(first - 1))


def _hour(m: re.Match, n: str) -> tuple[int, int]:
    hour, part = int(m[f"hour{n}"]), m[f"part{n}"] or ""
    if part in ("下午", "傍晚", "晚上") and 1 <= hour < 12 or part == "中午" and 1 <= hour < 11:
        hour += 12
    elif part in ("凌晨", "清晨", "早上", "上午") and hour == 12:
        hour = 0
    return hour, int(m[f"minute{n}"] or m[f"spoken{n}"] or 0)


def _ordered(start, end, grain: str, show: Callable) -> Span:
    if end < start:
        return Span(grain=grain, invalid="end before start")
    return Span("between", show(start), show(end), grain=grain)


def _instants(m: re.Match, now: datetime) -> Span:
    y, mo, d = int(m["y1"]), int(m["m1"]), int(m["d1"])
    y2, mo2, d2 = int(m["y2"] or y), int(m["m2"] or mo), int(m["d2"] or d)
    start, end = datetime(y, mo, d, *_hour(m, "1")), datetime(y2, mo2, d2, *_hour(m, "2"))
    if end < start and not m["y2"]:
        if m["d2"] is None:  # past midnight
            end += timedelta(days=1)
        elif mo2 < mo:  # past the new year
            end = end.replace(year=y + 1)
    return _ordered(start, end, "minute", lambda t: t.isoformat(timespec="minutes"))


def _days(m: re.Match, now: datetime) -> Span:
    y, mo = int(m["y1"]), int(m["m1"])
    mo2 = int(m["m2"] or mo)
    start, end = date(y, mo, int(m["d1"])), date(int(m["y2"] or y), mo2, int(m["d2"]))
    if end < start and not m["y2"] and mo2 < mo:
        end = end.replace(year=y + 1)
    return _ordered(start, end, "day", date.isoformat)


def _day_to_month(m: re.Match, now: datetime) -> Span:
    end = date.fromisoformat(_last(_month(int(m[4]), int(m[5]))))
    return _ordered(date(int(m[1]), int(m[2]), int(m[3])), end, "day", date.isoformat)


def _month_to_day(m: re.Match, now: datetime) -> Span:
    return _ordered(date(int(m[1]), int(m[2]), 1), date(int(m[3]), int(m[4]), int(m[5])), "day", date.isoformat)


def _time_of_day(hour: int, minute: int) -> str:
    if not (0 <= hour < 24 and 0 <= minute < 60):
        raise ValueError(hour)
    return f"T{hour:02d}:{minute:02d}"


def _clocks(m: re.Match, now: datetime) -> Span:
    return Span("between", _time_of_day(*_hour(m, "1")), _time_of_day(*_hour(m, "2")), grain="minute")


def _spoken_hour(m: re.Match, now: datetime) -> Span:
    hour, part = int(m[2]), m[1] or ""
    hour += 12 * (part[:1] == "下" and hour < 12) - 12 * (part[:1] == "上" and hour >= 12)
    return Span("exact", exact=_time_of_day(hour, 0), grain="minute")


def _part_of_year(m: re.Match, now: datetime) -> Span:
    y = int(m[1] or now.year)
    _, a, b = next(p for p in PARTS_OF_YEAR if p[0] in m[0].removeprefix(m[1] or ""))
    return _months(_month(y, a), _month(y, b), word=m[0])


def _spoken(m: re.Match, now: datetime) -> Span:
    said = {"去年": Span("exact", exact=str(now.year - 1)), "今年": Span("exact", exact=str(now.year)), "最新": Span(sort="year_desc"), "近三年": Span("gte", str(now.year - 3))}
    return said.get(m[0]) or Span("gte", str(now.year - 2))


def _day(m: re.Match, now: datetime) -> Span:
    return Span("exact", exact=date(int(m[1]), int(m[2]), int(m[3])).isoformat(), grain="day")


def _decade(m: re.Match, now: datetime) -> Span:
    y = 2000 + int(m[1])
    y -= 100 * (y > now.year)
    return Span("between", str(y), str(y + 9))


def _back(now: datetime, months: int) -> Span:
    return Span("gte", _first(_month(now.year, now.month) - months), grain="month")


# The patterns and their rank, by place; what each says is made by the functions above.
RULES: list[tuple[str, str, Callable[[re.Match, datetime], Span | None]]] = [
    ("anchor", rf"(?P<event>(?i:{'|'.join(sorted(ANCHORS, key=len, reverse=True))}))(?P<tail>(?:结束)?(?:以来|至今|到现在|爆发以来|期间|前后(?:(?:\d|[一二两三四五六七八九十])+个?(?:年|月|季度))?|之后|以后|之前|以前))", _anchor),
    ("month to now", rf"({YEAR})年(\d{{1,2}})月(?:份)?{UP_TO_NOW}", lambda m, now: Span("between", _first(_month(int(m[1]), int(m[2]))), _today(now), grain="day")),
    ("year to now", rf"({YEAR})年{UP_TO_NOW}", lambda m, now: Span("between", f"{m[1]}-01-01", _today(now), grain="day")),
    ("day to month", rf"({YEAR})年(\d{{1,2}})月(\d{{1,2}})[日号]?\s*{TO}\s*({YEAR})年(\d{{1,2}})月(?:份)?(?!\d)", _day_to_month),
    ("month to day", rf"({YEAR})年(\d{{1,2}})月(?:份)?\s*{TO}\s*({YEAR})年(\d{{1,2}})月(\d{{1,2}})[日号]", _month_to_day),
    ("months of years", rf"({YEAR})年(\d{{1,2}})月(?:份)?{TO}({YEAR})年(\d{{1,2}})月", lambda m, now: _months(_month(int(m[1]), int(m[2])), _month(int(m[3]), int(m[4])))),
    ("now", r"(?<!出)(?:到)?现在|当前|如今|当下", lambda m, now: Span("exact", exact=_today(now), grain="day")),
    ("years to come", rf"未来(\d{{1,2}}|{CJK_NUMBER})年", lambda m, now: Span("between", str(now.year), str(now.year + _number(m[1], 5) - 1))),
    ("around a year", rf"({YEAR})年.{{0,24}}前后(\d{{1,2}})个?(年|月|季度)", lambda m, now: _around(int(m[1]), int(m[1]), int(m[2]), m[3])),
    ("instants", rf"(?P<y1>{YEAR})年(?P<m1>\d{{1,2}})月(?P<d1>\d{{1,2}})[日号]?\s*{_clock('1')}\s*{TO}\s*(?:(?P<y2>{YEAR})年)?(?:(?P<m2>\d{{1,2}})月(?P<d2>\d{{1,2}})[日号]?)?\s*{_clock('2')}", _instants),
    ("days", rf"(?P<y1>{YEAR})年(?P<m1>\d{{1,2}})月(?P<d1>\d{{1,2}})[日号]?\s*{TO}\s*(?:(?P<y2>{YEAR})年)?(?:(?P<m2>\d{{1,2}})月)?(?P<d2>\d{{1,2}})[日号]", _days),
    ("clocks", rf"{_clock('1')}\s*{TO}\s*{_clock('2')}", _clocks),
    ("minute", rf"({YEAR})年(\d{{1,2}})月(\d{{1,2}})[日号]?\s*(\d{{1,2}})[点时:：](\d{{1,2}})分?", lambda m, now: Span("exact", exact=datetime(*map(int, m.groups())).isoformat(timespec="minutes"), grain="minute")),
    ("after a month", rf"({YEAR})年(\d{{1,2}})月(?:份)?(?:之后|以后|以来)", lambda m, now: Span("gte", _first(_month(int(m[1]), int(m[2])) + 1), grain="month")),
    ("before a month", rf"({YEAR})年(\d{{1,2}})月(?:份)?(?:之前|以前)", lambda m, now: Span("lte", end=_last(_month(int(m[1]), int(m[2])) - 1), grain="month")),
    ("day to now", rf"({YEAR})年(\d{{1,2}})月(\d{{1,2}})[日号]?\s*{UP_TO_NOW}", lambda m, now: Span("between", date(int(m[1]), int(m[2]), int(m[3])).isoformat(), _today(now), grain="day")),
    ("day", rf"({YEAR})年(\d{{1,2}})月(\d{{1,2}})[日号]", _day),
    ("month", rf"({YEAR})年(\d{{1,2}})月", lambda m, now: _months(*[_month(int(m[1]), int(m[2]))] * 2)),
    ("hh:mm", r"(?<!\d)(\d{1,2})[:：](\d{2})\s*分?(?!\d)", lambda m, now: Span("exact", exact=_time_of_day(int(m[1]), int(m[2])), grain="minute")),
    ("hour", r"([上中下晚]午)?\s*(\d{1,2})[点时]", _spoken_hour),
    ("months of this year", rf"(?<!\d)(\d{{1,2}})月(?:份)?{TO}(\d{{1,2}})月", lambda m, now: _months(_month(now.year, int(m[1])), _month(now.year, int(m[2])))),
    ("month of a near year", r"(去年|今年|明年)(\d{1,2})月", lambda m, now: _months(*[_month(now.year + "去今明".index(m[1][0]) - 1, int(m[2]))] * 2)),
    ("months back", rf"近(\d{{1,2}}|{CJK_NUMBER})个?月", lambda m, now: _back(now, _number(m[1], 3))),
    ("days back", rf"近(\d{{1,2}}|{CJK_NUMBER})天|近一周|近一个星期", lambda m, now: Span("gte", (now - timedelta(days=_number(m[1], 3) if m[1] else 7)).date().isoformat(), grain="day")),
    ("hours back", r"近(\d{1,2})个?小时", lambda m, now: Span("gte", (now - timedelta(hours=int(m[1]))).isoformat(timespec="minutes"), grain="minute")),
    ("near month", r"上个月|这个月|本月|下个月", lambda m, now: _months(*[_month(now.year, now.month) + {"上": -1, "下": 1}.get(m[0][0], 0)] * 2)),
    ("vague", VAGUE, lambda m, now: Span(vague=True)),
    ("part of a year", rf"({YEAR})?\s*(?:年初|年中|年底|上半年|下半年)", _part_of_year),
    ("nearest", NEAREST, lambda m, now: Span(sort="latest_before_anchor")),
    ("spoken", r"去年|今年|最近两年|最近2年|最新|近三年", _spoken),
    ("lately", r"最近|近期|前阵子|最近一段时间", lambda m, now: _word(_back(now, VAGUE_MONTHS[m[0]]), m[0])),
    ("two short years", rf"(?<!\d)(\d{{2}})\s*年?\s*{TO}\s*(\d{{2}})\s*年?(?!\d)", lambda m, now: Span("between", f"20{m[1]}", f"20{m[2]}")),
    ("two years", rf"({YEAR})\s*年?\s*{TO}\s*({YEAR})", lambda m, now: Span("between", m[1], m[2])),
    ("up to a year", rf"({YEAR})\s*年?\s*及\s*(?:以前|之前)", lambda m, now: Span("lte", end=m[1])),
    ("before a short year", r"(?<!\d)(\d{2})\s*年\s*(?:之前|以前)", lambda m, now: Span("lte", end=str(1999 + int(m[1])))),
    ("after a short year", r"(?<!\d)(\d{2})\s*年\s*(?:之后|以后)", lambda m, now: Span("gte", str(2001 + int(m[1])))),
    ("before a year", rf"(?<!\d)({YEAR})\s*年?\s*(?:之前|以前)", lambda m, now: Span("lte", end=str(int(m[1]) - 1))),
    ("after a year", rf"(?<!\d)({YEAR})\s*年?\s*(?:之后|以后)", lambda m, now: Span("gte", str(int(m[1]) + 1))),
    ("since a year", rf"(?<!\d)({YEAR})\s*年?\s*(?:以来|起)", lambda m, now: Span("gte", m[1])),
    ("decade", rf"({YEAR})\s*年代", lambda m, now: Span("between", m[1], str(int(m[1]) + 9))),
    ("short decade", r"(?<!\d)(\d{2})\s*年代", _decade),
    ("about a year", r"(?<!\d)(\d{2}|\d{4})\s*年\s*左右", lambda m, now: Span(vague=True)),
    ("year", rf"(?<!\d)({YEAR})\s*年?(?!\d)", lambda m, now: Span("exact", exact=m[1])),
    ("short year", r"(?<!\d)(\d{2})\s*年(?!\d)", lambda m, now: Span("exact", exact=f"20{m[1]}")),
]


def _word(span: Span, word: str) -> Span:
    span.word = word
    return span


_COMPILED = [(re.compile(p), say) for _, p, say in RULES]
_ZONE = re.compile("|".join(sorted(map(re.escape, ZONES), key=len, reverse=True)), re.I)
_ID = re.compile(IDENTIFIERS)
_BY_LETTER = {k.upper(): v for k, v in ZONES.items()}


def _zone_at(text: str, place: int) -> str:
    """The last zone named before a place in the same sentence."""
    last = None
    for last in _ZONE.finditer(text, 0, place):
        pass
    return "" if last is None or re.search(r"[。！？!?]", text[last.end() : place]) else _BY_LETTER[last[0].upper()]


def find(text: str, now: datetime = NOW) -> list[Span]:
    """All time expressions of a text that don't overlap, in order of place."""
    read = _ID.sub(lambda m: " " * len(m[0]), text)
    taken = bytearray(len(read))
    out: list[tuple[int, Span]] = []
    for pattern, say in _COMPILED:
        for m in pattern.finditer(read):
            a, b = m.span()
            if any(taken[a:b]):
                continue
            try:
                span = say(m, now)
            except (ValueError, OverflowError):
                span = Span(invalid="no such date")
            if span is not None:
                span.raw, span.zone = m[0], _zone_at(text, a)
                taken[a:b] = b"\1" * (b - a)
                out.append((a, span))
    return [s for _, s in sorted(out, key=lambda x: x[0])]


def listed_years(text: str) -> list[Span]:
    """Two or more years in a row between commas or blanks."""
    m = re.search(r"\d{4}(?:[,，、;；/\s]+\d{4})+", text)
    return [Span("exact", exact=y, raw=m[0]) for y in re.findall(r"\d{4}", m[0])] if m else []


def year_months(text: str) -> list[Span]:
    """Each of the months named for each of the years named."""
    both = r"\s*(?:和|与|、|,|，)\s*"
    m = re.search(rf"({YEAR}\s*年(?:{both}{YEAR}\s*年)+)\s*的?\s*(\d{{1,2}}\s*月(?:份)?(?:{both}\d{{1,2}}\s*月(?:份)?)+)", text)
    if not m:
        return []
    years, months = (list(dict.fromkeys(map(int, re.findall(p, part)))) for p, part in ((YEAR, m[1]), (r"(\d{1,2})\s*月", m[2])))
    if not all(1 <= k <= 12 for k in months):
        return []
    return [_months(*[_month(y, k)] * 2, raw=f"{y}年{k}月") for y in years for k in months]


SCHEMA = T.ArrayType(T.StructType([T.StructField(n, T.BooleanType() if n == "vague" else T.StringType()) for n in Span.__dataclass_fields__]))


def _column(read: Callable[[str], list[Span]]):
    @F.pandas_udf(SCHEMA)  # not over an iterator: each of those has a Python worker of its own, while others share one
    def each(c: pd.Series) -> pd.Series:
        return c.map(lambda x: None if x is None else [asdict(s) for s in read(x)])

    return each


def times(c: Column, now: datetime = NOW) -> Column:
    return _column(lambda x: find(x, now))(c)


def year_list(c: Column) -> Column:
    return _column(listed_years)(c)


def month_matrix(c: Column) -> Column:
    return _column(year_months)(c)
