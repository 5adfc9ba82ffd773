"""Requests on the driver: predicates read from questions, context of turns, registries with checks, readiness and coverage.

Nothing here touches rows; it decides which plan the executors get.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .algebra import PlanError, Predicate

# Words of comparisons, factors of units, weights and limits.
COMPARISONS = (
    ("between", r"(?:介于|在)\s*{n}\s*(?:和|到|至|与|-|~)\s*{n}\s*(?:之间)?"), ("gte", r"(?:不低于|不小于|不少于|至少|大于等于|>=)\s*{n}"), ("lte", r"(?:不高于|不大于|不超过|至多|小于等于|<=)\s*{n}"), ("ne", r"(?:不等于|!=)\s*{n}"),
    ("gt", r"(?:高于|超过|大于|>)\s*{n}"), ("lt", r"(?:低于|小于|少于|<)\s*{n}"), ("eq", r"(?:等于|为|==|=)\s*{n}"),
)
FACTORS = {"毫秒": 0.001, "秒": 1, "秒钟": 1, "分": 60, "分钟": 60, "小时": 3600, "时": 3600, "天": 86400, "日": 86400, "周": 604800, "交易日": 86400, "kPa": 1000, "MPa": 1_000_000, "Pa": 1, "km": 1000, "m": 1, "%": 0.01}
NULLS = (("is_not_null", "不为空|非空|不是空"), ("is_null", "为空|是空|缺失"))
READINESS = {"coverage": 0.25, "semantic": 0.20, "binding": 0.20, "operator": 0.15, "executable": 0.20}
MOST_SURE = 0.98


def numeric_predicates(text: str, fields: dict[str, str], units: dict[str, str] | None = None) -> list[Predicate]:
    """Comparisons that follow a field's name, numbers in the field's unit (``units``: unit of a field, whose factor is 1)."""
    out: list[tuple[int, Predicate]] = []
    number = r"(-?\d+(?:\.\d+)?)\s*([A-Za-z%/²°℃一-鿿]{0,3}?)(?=[，,。；;和且或与到至之\s\-~]|$)"
    names = "|".join(sorted(map(re.escape, fields), key=len, reverse=True))
    taken = bytearray(len(text))
    for op, shape in COMPARISONS:
        for m in re.finditer(rf"({names})\s*" + shape.replace("{n}", number), text):
            if any(taken[m.start() : m.end()]):
                continue
            got = [float(v) * FACTORS.get(u, 1) for v, u in zip(m.groups()[1::2], m.groups()[2::2], strict=True)]
            taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
            out.append((m.start(), Predicate(fields[m[1]], op, tuple(got) if op == "between" else got[0])))
    return [p for _, p in sorted(out, key=lambda x: x[0])]


def categorical_predicates(text: str, fields: dict[str, str]) -> list[Predicate]:
    """Names after a field: one of several, not one, holding one, or one."""
    out = []
    for m in re.finditer(rf"({'|'.join(sorted(map(re.escape, fields), key=len, reverse=True))})\s*(不是|不等于|包含|含有|属于|是|为|等于)\s*([^，。；;\s且]+)", text):
        name, how, said = fields[m[1]], m[2], m[3]
        if re.match(r"(?:不?为空|非空|空)", said) or re.fullmatch(r"-?\d+(?:\.\d+)?", said):
            continue
        parts = [x for x in re.split("[、,/]|或者|或", said) if x]
        if how in ("不是", "不等于"):
            out.append(Predicate(name, "ne" if len(parts) == 1 else "not_in", parts[0] if len(parts) == 1 else tuple(parts)))
        elif how in ("包含", "含有"):
            out.append(Predicate(name, "contains", said))
        else:
            out.append(Predicate(name, "eq" if len(parts) == 1 else "in", parts[0] if len(parts) == 1 else tuple(parts)))
    return out


def null_predicates(text: str, fields: dict[str, str]) -> list[Predicate]:
    """Empty or not, of the field that is named last before the word."""
    out: list[tuple[int, Predicate]] = []
    taken = bytearray(len(text))
    for op, words in NULLS:
        for m in re.finditer(words, text):
            before = [(text.rfind(n, 0, m.start()), len(n), f) for n, f in fields.items() if text.rfind(n, 0, m.start()) >= 0]
            if before and not any(taken[m.start() : m.end()]):
                taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
                out.append((m.start(), Predicate(max(before)[2], op)))
    return [p for _, p in sorted(out, key=lambda x: x[0])]


@dataclass(frozen=True)
class Turn:
    """What a turn asks: source, window, filters by field, outputs."""

    source: str | None = None
    window: str | None = None
    filters: dict[str, Predicate] = field(default_factory=dict)
    outputs: tuple[str, ...] = ()


def inherit(before: Turn, now: Turn) -> Turn:
    """What the turn leaves out is as before; filters on one field are replaced, others kept."""
    return Turn(now.source or before.source, now.window or before.window, before.filters | now.filters, now.outputs or before.outputs)


def replaced(before: Turn, **parts) -> Turn:
    return replace(before, **parts)


def cancelled(before: Turn, fields: Iterable[str] = ()) -> Turn:
    """Without the filters on the fields; without fields an empty turn."""
    gone = set(fields)
    return replace(before, filters={k: v for k, v in before.filters.items() if k not in gone}) if gone else Turn()


@dataclass
class Operator:
    name: str
    run: Callable[..., DataFrame]
    needs: dict[str, T.StructType]
    gives: T.StructType | None = None
    version: str = "1"
    writes: bool = False


class Registry:
    """Named transforms with the columns that they need and give; read-only ones unless writing is allowed."""

    def __init__(self, *, allow_writes: bool = False) -> None:
        self._ops: dict[str, Operator] = {}
        self.allow_writes = allow_writes

    def register(self, op: Operator) -> None:
        if op.name in self._ops:
            raise PlanError(f"{op.name} is there already")
        self._ops[op.name] = op

    def names(self) -> list[str]:
        return sorted(f"{o.name}@{o.version}" for o in self._ops.values())

    @staticmethod
    def _check(df: DataFrame, want: T.StructType, what: str) -> None:
        have = {f.name: f.dataType for f in df.schema.fields}
        if bad := [f.name for f in want.fields if have.get(f.name) != f.dataType]:
            raise PlanError(f"{what} lacks {bad} or has them in another type")

    def execute(self, name: str, inputs: dict[str, DataFrame], **params) -> DataFrame:
        op = self._ops.get(name)
        if op is None:
            raise PlanError(f"unknown operator {name}")
        if op.writes and not self.allow_writes:
            raise PlanError(f"{name} writes")
        for n, want in op.needs.items():
            if n not in inputs:
                raise PlanError(f"{name} needs {n}")
            self._check(inputs[n], want, f"{name}'s input {n}")
        out = op.run(**inputs, **params)
        if op.gives is not None:
            self._check(out, op.gives, f"{name}'s result")
        return out


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float] | None]: ...


def embedded(df: DataFrame, embed: Embedder, *, text: str = "text", out: str = "embedding", batch: int = 16) -> DataFrame:
    """``df`` with a vector for each text by any encoder, in batches; where a batch fails its texts are tried one by one, and null is what fails then."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches):
        for pdf in batches:
            vectors: list = []
            texts = pdf[text].fillna("").tolist()
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                try:
                    vectors += embed(part)
                except Exception:  # an encoder may fail in any way
                    for t in part:
                        try:
                            vectors += embed([t])
                        except Exception:
                            vectors.append(None)
            yield pdf.assign(**{out: vectors})

    return df.mapInPandas(run, schema)


class CatalogProvider(Protocol):
    def __call__(self) -> dict[str, DataFrame]: ...


class Candidates(Protocol):
    def __call__(self, text: str, k: int) -> list[tuple[str, float]]: ...


def bound_role(outputs: dict[str, set[str]], role: str) -> str:
    """The one output that plays a role; none or several are an error."""
    found = sorted(n for n, roles in outputs.items() if role in roles)
    if len(found) != 1:
        raise PlanError(f"{len(found)} outputs for {role}: {found}")
    return found[0]


def owners(mentions: list[set[str]]) -> set[str]:
    """The sources that own every one of two or more mentions."""
    return set.intersection(*mentions) if len(mentions) >= 2 else set()


def lineage(inputs: dict[str, tuple[str, ...]], sources: set[str]) -> dict[str, set[str]]:
    """For each output the sources that it comes from, through any number of steps; a cycle is an error."""
    known: dict[str, set[str]] = {s: {s} for s in sources}

    def of(name: str, above: tuple[str, ...]) -> set[str]:
        if name in above:
            raise PlanError(f"{name} depends on itself")
        if name not in known:
            known[name] = set().union(*(of(i, (*above, name)) for i in inputs.get(name, ())))
        return known[name]

    return {n: of(n, ()) for n in inputs}


def uncovered(text: str, spans: list[tuple[int, int]], wanted: list[tuple[int, int]]) -> list[str]:
    """The parts of a request that no plan node's span owns."""
    return [text[a:b] for a, b in wanted if not any(x <= a and b <= y for x, y in spans)]


def covered(requirements: dict[str, dict], nodes: dict[str, dict], depends: dict[str, set[str]]) -> set[str]:
    """Requirements whose attributes some node has exactly, and whose dependencies are covered too, to a fixed point."""
    met = {r for r, a in requirements.items() if any(all(n.get(k) == v for k, v in a.items()) for n in nodes.values())}
    while True:
        rest = {r for r in met if depends.get(r, set()) <= met}
        if rest == met:
            return met
        met = rest


def merged_requirements(rows: list[dict]) -> list[dict]:
    """One requirement for each (demand, clause, family), with all their fields."""
    out: dict[tuple, dict] = {}
    for r in rows:
        key = (r["demand"], r["clause"], r["family"])
        at = out.setdefault(key, {**r, "fields": []})
        at["fields"] = list(dict.fromkeys([*at["fields"], *r["fields"]]))
    return list(out.values())


def blockers(spec: dict[str, Any], rules: list[tuple[str, Callable[[dict], bool]]]) -> list[str]:
    """The names of the rules that a specification fails; ready if there are none."""
    return [name for name, ok in rules if not ok(spec)]


#: What an event and a duration need before they can be planned.
EVENT_RULES: list[tuple[str, Callable[[dict], bool]]] = [
    ("condition", lambda s: bool(s.get("condition"))), ("order", lambda s: bool(s.get("order_by"))), ("keys", lambda s: s.get("keys") is not None), ("gap", lambda s: (s.get("max_gap_us") or 0) > 0),
    ("threshold", lambda s: s.get("min_us", 0) >= 0), ("calendar", lambda s: not s.get("trading_days") or bool(s.get("calendar"))),
]


def reliability(parts: dict[str, float]) -> float:
    """Weighted sum of the parts' shares, never quite certain."""
    return round(min(MOST_SURE, sum(w * max(0.0, min(1.0, parts.get(k, 0.0))) for k, w in READINESS.items())), 6)


def retrieval_steps(task: str, documents: tuple[str, ...] = (), sections: tuple[str, ...] = ()) -> list[dict]:
    """The typed search steps of a task."""
    if task == "find":
        return [{"kind": "documents", "k": 10}]
    if task == "answer":
        return [{"kind": "passages", "documents": documents, "k": 5}] if documents else [{"kind": "documents", "k": 2}, {"kind": "passages", "documents": "found", "k": 5}]
    if task == "compare":
        return [{"kind": "passages", "documents": (d,), "sections": (s,), "k": 3} for d in documents for s in sections or ("method", "result")]
    if task == "enumerate":
        return [{"kind": "inventory", "limit": 100}]
    raise PlanError(f"unknown task {task}")


class Attestations:
    """Append-only bindings of a catalog, under a digest of the digests that they bind."""

    def __init__(self) -> None:
        self._rows: list[dict] = []

    def bind(self, **digests: str) -> str:
        key = hashlib.sha256(json.dumps(digests, sort_keys=True).encode()).hexdigest()
        if not any(r["key"] == key for r in self._rows):
            self._rows.append({"key": key, **digests})
        return key

    def holds(self, key: str, **digests: str) -> bool:
        return any(r["key"] == key and all(r.get(k) == v for k, v in digests.items()) for r in self._rows)


def cloned(spark: SparkSession, source: str, target: str, again: Callable[[DataFrame], DataFrame], *, key: str) -> tuple[int, int]:
    """Write a new generation from an old one with recomputed columns; both have to hold the same keys. Returns their rows."""
    old = spark.read.parquet(source)
    again(old).write.mode("errorifexists").parquet(target)
    new = spark.read.parquet(target)
    if old.select(key).exceptAll(new.select(key)).limit(1).count() or new.select(key).exceptAll(old.select(key)).limit(1).count():
        raise PlanError("the new generation has other rows")
    return old.count(), new.count()


@dataclass(frozen=True)
class Signature:
    """What a function takes and gives: its number of inputs, their kinds, and how the unit follows from theirs."""

    arity: int
    kinds: tuple[str, ...]
    unit: str  # preserve, count, ratio, unitless or product
    column: Callable[..., Any]


def signatures() -> dict[str, Signature]:
    """The ten functions of expressions, each as a typed column factory."""
    from pyspark.sql import functions as F

    number = ("number",)
    one = lambda f: Signature(1, number, "preserve", f)
    return {
        "identity": Signature(1, ("any",), "preserve", lambda a: a), "avg": one(F.avg), "sum": one(F.sum), "count": Signature(1, ("any",), "count", F.count), "min": one(F.min), "max": one(F.max), "stddev": one(F.stddev),
        "ratio": Signature(2, number, "ratio", F.try_divide), "correlation": Signature(2, number, "unitless", F.corr), "max_of_product": Signature(2, number, "product", lambda a, b: F.max(a * b)),
    }


def applied(name: str, inputs: list[tuple[Any, str, str | None]]) -> tuple[Any, str | None]:
    """(column, unit) of a function on inputs (column, kind, unit); what has no meaning is an error."""
    s = signatures().get(name)
    if s is None:
        raise PlanError(f"unknown function {name}")
    if len(inputs) != s.arity or any(k not in s.kinds for _, k, _ in inputs if "any" not in s.kinds):
        raise PlanError(f"{name} takes {s.arity} of {s.kinds}")
    units = [u for *_, u in inputs]
    if s.unit == "product" and all(units):
        raise PlanError(f"{name} would multiply {units[0]} by {units[1]}")
    unit = {"preserve": units[0], "count": None, "unitless": None, "ratio": "ratio", "product": next((u for u in units if u), None)}[s.unit]
    return s.column(*[c for c, *_ in inputs]), unit
