"""Terms to Catalyst predicates. Scalars are coerced while the plan is built, so plans hold plain comparisons."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.coerce import NAN, NUMBER, as_bool, as_float, as_int, as_text, canonical, hex_id
from ..plans.documents import Term
from ..schema import BOOL, DOUBLE, FIELDS, INT, STR


def never() -> Column:
    return F.lit(False)


_COMPARE = {"eq": Column.__eq__, "ne": Column.__ne__, "lt": Column.__lt__, "lte": Column.__le__, "gt": Column.__gt__, "gte": Column.__ge__}


def _ordered(col: Column, op: str, value) -> Column:
    return never() if value is None or op == "contains" else _COMPARE[op](col, F.lit(value))


def compare(col: Column, kind: str, op: str, value) -> Column:
    """``col op value`` for a column of this kind. Nulls, NaN and values of the wrong kind match nothing, not even ``ne``."""
    if kind == "int":
        v = as_int(value)
        return _ordered(col, op, v) if v is not None else never()
    if kind == "double":
        v = as_float(value)
        return _ordered(col, op, v) & ~F.isnan(col) if v is not None and v == v else never()
    if kind == "bool":
        return _ordered(col, op, as_bool(value))
    if kind == "id":
        return _ordered(col, op, hex_id(value))
    if kind == "str":
        v = as_text(value)
        if v is None:
            return never()
        return col.contains(v) if op == "contains" else _ordered(col, op, v)
    return never()


def _text_attr(s: Column, op: str, value) -> Column:
    """Against stored text: equality by canonical text; order by number where both are numbers and the scalar is bare."""
    text = canonical(value)
    if op == "contains":
        return s.contains(text)
    if op in ("eq", "ne"):
        return _COMPARE[op](s, F.lit(text))
    bare = as_float(value) if not isinstance(value, str) else None
    if bare is None:
        return _COMPARE[op](s, F.lit(text))
    if bare != bare:
        return F.when(s.rlike(NUMBER), never()).otherwise(_COMPARE[op](s, F.lit(text)))
    return F.when(s.rlike(NAN), never()).when(s.rlike(NUMBER), _COMPARE[op](s.try_cast("double"), F.lit(bare))).otherwise(_COMPARE[op](s, F.lit(text)))


def attribute(x: Column, term: Term) -> Column:
    """Whether one attribute satisfies a term; the stored kind decides how."""
    whole, real, truth = as_int(term.value), as_float(term.value), as_bool(term.value)
    by_kind = F.when(x["type"] == STR, _text_attr(x["s"], term.op, term.value))
    if whole is not None and term.op != "contains":
        by_kind = by_kind.when(x["type"] == INT, _ordered(x["i"], term.op, whole))
    if real is not None and real == real and term.op != "contains":
        by_kind = by_kind.when(x["type"] == DOUBLE, _ordered(x["d"], term.op, real) & ~F.isnan(x["d"]))
    if truth is not None and term.op != "contains":
        by_kind = by_kind.when(x["type"] == BOOL, _ordered(x["b"], term.op, truth))
    return (x["key"] == term.name) & F.coalesce(by_kind.otherwise(never()), never())


def any_level(term: Term, levels: Iterable[str], nested: Iterable[str] = ()) -> Column:
    """Whether any attribute of any level satisfies the term; ``nested`` are arrays of children with ``attrs``."""
    tests = [F.exists(F.col(c), lambda x: attribute(x, term)) for c in levels]
    tests += [F.exists(F.col(c), lambda e: F.exists(e["attrs"], lambda x: attribute(x, term))) for c in nested]
    return reduce(Column.__or__, [F.coalesce(t, never()) for t in tests], never())


def predicate(found: Iterable[Term], signal: str, columns: Iterable[str]) -> Column:
    """All terms of a log or span search. A field that isn't there matches nothing."""
    columns, out = set(columns), []
    for t in found:
        if t.target == "field":
            name, kind = FIELDS[signal].get(t.name, (None, None))
            out.append(compare(F.col(name), kind, t.op, t.value) if name in columns else never())
        else:
            out.append(any_level(t, [c for c in ("attrs", "resource", "scope") if c in columns], [c for c in ("events", "links") if c in columns]))
    return reduce(Column.__and__, out, F.lit(True))


def point_predicate(found: Iterable[Term]) -> Column:
    """All terms of a metric query: fields are read as attributes, at the levels of resource, scope, metric and point."""
    return reduce(Column.__and__, [any_level(t, ("resource", "scope", "metric_attrs", "attrs")) for t in found], F.lit(True))
