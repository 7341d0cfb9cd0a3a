"""How a document's scalar meets a column: the column's type decides, and what can't be read matches nothing."""

from __future__ import annotations

import re
from decimal import Decimal

_INT = re.compile(r"[+-]?[0-9]+")
#: Numbers as documents and attribute text write them, for Python and for SQL alike.
NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
NAN = r"^[+-]?[nN][aA][nN]$"
_NUMBER = re.compile(NUMBER)
MIN, MAX = -(1 << 63), (1 << 63) - 1


def as_int(v) -> int | None:
    if isinstance(v, bool):
        return None
    if isinstance(v, float):
        v = int(v) if v == v and abs(v) != float("inf") and v == int(v) else None
    elif isinstance(v, str):
        v = int(v) if _INT.fullmatch(v) else None
    return v if v is not None and MIN <= v <= MAX else None


def as_float(v) -> float | None:
    if isinstance(v, bool):
        return None
    if isinstance(v, str):
        return float(v) if _NUMBER.match(v) and not v.endswith("\n") else None
    return float(v)


def as_bool(v) -> bool | None:
    return v if isinstance(v, bool) else {"true": True, "false": False}.get(v) if isinstance(v, str) else None


def as_text(v) -> str | None:
    return v if isinstance(v, str) else None


def canonical(v) -> str:
    """The text under which a scalar equals stored text: whole doubles without a point, no exponents."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        if v != v or abs(v) == float("inf"):
            return "NaN" if v != v else "inf" if v > 0 else "-inf"
        if v == int(v) and MIN <= v <= MAX:
            return str(int(v))
        return format(Decimal(repr(v)), "f")
    return str(v)


def hex_id(v) -> str | None:
    """An id's bytes as lower-case hex, if ``v`` spells whole bytes."""
    if isinstance(v, str) and len(v) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]*", v):
        return v.lower()
    return None
