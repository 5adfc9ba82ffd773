"""A typed plan of named steps, checked on the driver and lowered to DataFrames.

Each step has an operator, its inputs and parameters; an output has a shape, a
grain and a unit. The checks reject what has no meaning (unknown inputs, cycles,
set operations on different grains or on one producer twice, sums of unlike
units) before any data are read; Catalyst gets one declarative plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events as E

COMPARE = {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
AGGREGATES = {
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "stddev": F.stddev, "median": F.median,
}


class PlanError(ValueError):
    pass


@dataclass(frozen=True)
class Predicate:
    field: str
    op: str
    value: Any = None

    def column(self):
        c = F.col(self.field)
        simple = {
            "eq": lambda: c == self.value, "ne": lambda: c != self.value, "gt": lambda: c > self.value, "gte": lambda: c >= self.value, "lt": lambda: c < self.value, "lte": lambda: c <= self.value,
            "between": lambda: c.between(*self.value), "in": lambda: c.isin(list(self.value)), "not_in": lambda: ~c.isin(list(self.value)), "contains": lambda: c.contains(self.value),
            "is_null": lambda: c.isNull(), "is_not_null": lambda: c.isNotNull(), "exists": lambda: c.isNotNull(),
        }
        if self.op not in simple:
            raise PlanError(f"unknown operator {self.op}")
        return simple[self.op]()


def conjunction(predicates: list[Predicate]):
    out = F.lit(True)
    for p in predicates:
        out = out & p.column()
    return out


def disjunction(groups: list[list[Predicate]]):
    """Groups joined by AND inside and OR outside."""
    out = F.lit(False)
    for g in groups:
        out = out | conjunction(g)
    return out


def negation(condition):
    """Rows for which a condition doesn't hold, those with nulls in it included."""
    return ~F.coalesce(condition, F.lit(False))


def year_filter(year, op: str, first: int | None = None, last: int | None = None):
    """lte, lt, gte, gt, between or exact; a null year fails."""
    says = {
        "lte": lambda: year <= last, "lt": lambda: year < last, "gte": lambda: year >= first, "gt": lambda: year > first, "between": lambda: year.between(first, last), "exact": lambda: year == first,
    }
    if op not in says:
        raise PlanError(f"unknown operator {op}")
    return F.coalesce(says[op](), F.lit(False))


def any_in_range(columns: list, bounds: dict[str, float]):
    """Some one of the columns lies within all bounds (gt, gte, lt, lte)."""
    does = {"gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}
    out = F.lit(False)
    for c in columns:
        here = F.lit(True)
        for k, v in bounds.items():
            here = here & does[k](c, v)
        out = out | F.coalesce(here, F.lit(False))
    return out


def unsatisfiable(predicates: list[Predicate]) -> bool:
    """True if some field's largest lower bound is at or above its smallest upper bound."""
    low: dict[str, float] = {}
    high: dict[str, float] = {}
    for p in predicates:
        if p.op in ("gt", "gte"):
            low[p.field] = max(low.get(p.field, p.value), p.value)
        elif p.op in ("lt", "lte"):
            high[p.field] = min(high.get(p.field, p.value), p.value)
    return any(f in high and low[f] >= high[f] for f in low)


@dataclass(frozen=True)
class Step:
    name: str
    op: str
    inputs: tuple[str, ...] = ()
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Kind:
    shape: str  # relation, event_set, date_set, scalar
    unit: str | None = None


OUTPUT = {
    "source": "relation", "filter": "relation", "consecutive": "event_set", "project_date": "date_set", "aggregate": "relation", "quantile": "relation", "top_k": "relation", "intersection": None, "union": None,
    "difference": None, "arithmetic": "relation", "unsatisfiable": "relation", "relation_filter": "relation", "scoped_aggregate": "relation", "cumulative_duration": "relation",
}


def validate(steps: list[Step]) -> dict[str, Kind]:
    kinds: dict[str, Kind] = {}
    names = {s.name for s in steps}
    if len(names) < len(steps):
        raise PlanError("two steps have one name")
    for s in steps:
        if s.op not in OUTPUT:
            raise PlanError(f"unknown operator {s.op}")
        for i in s.inputs:
            if i not in kinds:
                raise PlanError(f"{s.name} needs {i}, which " + ("comes later" if i in names else "isn't there"))
        if s.op in ("intersection", "union", "difference"):
            if len(s.inputs) != 2 or len(set(s.inputs)) != 2:
                raise PlanError(f"{s.name} needs two producers")
            a, b = (kinds[i] for i in s.inputs)
            if a.shape != b.shape or a.shape not in ("event_set", "date_set"):
                raise PlanError(f"{s.name} joins {a.shape} and {b.shape}")
            kinds[s.name] = a
            continue
        if s.op == "project_date" and kinds[s.inputs[0]].shape != "event_set":
            raise PlanError(f"{s.name} needs intervals")
        if s.op == "arithmetic" and s.params["op"] in ("add", "sub") and len({kinds[i].unit for i in s.inputs}) > 1:
            raise PlanError(f"{s.name} adds unlike units")
        if s.op == "quantile" and not 0 < s.params["q"] <= 1:
            raise PlanError("a quantile is above 0 and at most 1")
        kinds[s.name] = Kind(OUTPUT[s.op], s.params.get("unit", kinds[s.inputs[0]].unit if s.inputs else None))
    return kinds


def lower(steps: list[Step], sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A DataFrame for each step."""
    kinds = validate(steps)
    out: dict[str, DataFrame] = {}
    for s in steps:
        a = out[s.inputs[0]] if s.inputs else None
        p = s.params
        if s.op == "source":
            out[s.name] = sources[p["table"]]
        elif s.op == "filter":
            out[s.name] = a.limit(0) if unsatisfiable(p["predicates"]) else a.filter(conjunction(p["predicates"]))
        elif s.op == "unsatisfiable":
            out[s.name] = a.limit(0)
        elif s.op == "consecutive":
            out[s.name] = E.consecutive(a, conjunction(p["predicates"]), keys=p["keys"], max_gap_us=p["max_gap_us"], min_us=p.get("min_us", 0))
        elif s.op == "cumulative_duration":
            out[s.name] = E.cumulative_duration(a, conjunction(p["predicates"]), keys=p["keys"], max_gap_us=p["max_gap_us"], offset_us=p.get("offset_us", 0))
        elif s.op == "project_date":
            out[s.name] = E.local_dates(a, keys=p["keys"], offset_us=p.get("offset_us", 0))
        elif s.op in ("intersection", "union", "difference"):
            b = out[s.inputs[1]]
            if kinds[s.name].shape == "date_set":
                out[s.name] = {"intersection": a.intersect, "union": lambda b, a=a: a.union(b).distinct(), "difference": a.subtract}[s.op](b)
            elif s.op == "union":
                cols = [*p["keys"], "start_us", "end_us"]
                out[s.name] = E.merged(a.select(cols).unionByName(b.select(cols)), keys=p["keys"])
            else:
                out[s.name] = getattr(E, s.op)(a, b, keys=p["keys"])
        elif s.op in ("aggregate", "scoped_aggregate"):
            rows = a.join(out[s.inputs[1]], p["scope"], "left_semi") if s.op == "scoped_aggregate" else a
            out[s.name] = rows.groupBy(*p.get("by", [])).agg(*[AGGREGATES[f](c).alias(n) for n, (f, c) in p["outputs"].items()])
        elif s.op == "quantile":
            out[s.name] = a.groupBy(*p.get("by", [])).agg(F.percentile(p["field"], p["q"]).alias(p["as"]))
        elif s.op == "top_k":
            out[s.name] = a.orderBy(F.desc(p["field"]), *p.get("ties", [])).limit(p["k"])
        elif s.op == "relation_filter":
            out[s.name] = a.join(out[s.inputs[1]].filter(conjunction(p["predicates"])), p["on"], "left_semi")
        elif s.op == "arithmetic":
            rows = a if len(s.inputs) == 1 else a.join(out[s.inputs[1]], p["on"])
            x, y = F.col(p["left"]), F.col(p["right"]) if isinstance(p["right"], str) else F.lit(p["right"])
            out[s.name] = rows.withColumn(p["as"], {"add": x + y, "sub": x - y, "mul": x * y, "div": F.try_divide(x, y)}[p["op"]])
    return out
