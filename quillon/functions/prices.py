"""Prices that a query states, with their places."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

# Numbers, what may stand before an upper bound, and the forms in the order in which they claim their places.
_NUMBER = r"(\d+(?:\.\d+)?)\s*(万|千|[kK])?"
_WAN = r"(\d+(?:\.\d+)?)\s*万\s*(\d+(?:\.\d+)?)\s*(千)?"
_UPPER = r"(?:预算|价格)?\s*(?:控制在?|要|得|需|需要)?\s*(?:不超过|不要超过|别超|不能超过|不得超过|不可超过|不高于|最高|至多|封顶(?:在)?)\s*"
_LEAD = r"(?:预算|价格)?(?:控制)?在?\s*"
FORMS = (
    ("wan", "budget_upper", _UPPER + _WAN + r"\s*元?"),
    ("wan", "budget_upper", _WAN + r"\s*元?\s*(?:以内|以下|之内)"),
    ("range", "price_range", _LEAD + _NUMBER + r"\s*元?\s*(?:-|~|～|至|到)\s*" + _NUMBER + r"\s*元?(?:之间)?"),
    ("one", "budget_upper", _UPPER + _NUMBER + r"\s*元?"),
    ("one", "budget_upper", _NUMBER + r"\s*元?\s*(?:以内|以下|之内)"),
    ("one", "price_lower", r"(?:预算|价格)?\s*(?:不低于|至少|最低|不少于|高于|超过)\s*" + _NUMBER + r"\s*元?"),
    ("one", "price_lower", _NUMBER + r"\s*元?\s*(?:以上|起)"),
    ("one", "price_lower", _NUMBER + r"\s*元?\s*\+"),
    ("one", "price_preference", _LEAD + _NUMBER + r"\s*元?\s*(?:左右|上下)"),
)
_COMPILED = [(shape, kind, re.compile(p)) for shape, kind, p in FORMS]
_SCALE = {"万": 10_000, "千": 1000, "k": 1000, "K": 1000}


def _values(shape: str, m: re.Match) -> tuple[float, float] | None:
    """(low, high) of a match, the same twice for one price; None if it states none."""
    if shape == "wan":
        tail = float(m[2])
        value = float(m[1]) * 10_000 + (tail * 1000 if m[3] or tail < 10 else tail)
        return (value, value) if value > 0 else None
    first = float(m[1]) * _SCALE.get(m[2], 1)
    if shape == "one":
        return first, first
    last = float(m[3]) * _SCALE.get(m[4], 1)
    return (first, last) if 0 < first <= last else None


def stated_prices(text: str | None) -> list[dict]:
    """kind, low, high, start and end of every price in order of place.  A form takes no place that an earlier form has; ranges are kept
    whatever has theirs."""
    out: list[dict] = []
    for shape, kind, pattern in _COMPILED:
        for m in pattern.finditer(text or ""):
            start, end = m.span()
            free = shape == "range" or all(end <= x["start"] or x["end"] <= start for x in out)
            values = _values(shape, m) if free else None
            if values:
                out.append({"kind": kind, "low": values[0], "high": values[1], "start": start, "end": end})
    return sorted(out, key=lambda x: x["start"])


_TYPE = ArrayType(StructType().add("kind", StringType()).add("low", DoubleType()).add("high", DoubleType()).add("start", IntegerType()).add("end", IntegerType()))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("low", pa.float64()), ("high", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))


@F.arrow_udf(_TYPE)
def _stated(texts: pa.Array) -> pa.Array:
    return pa.array([stated_prices(t) for t in texts.to_pylist()], _ARROW)


def price_candidates(text: Column) -> Column:
    """stated_prices of a column, by Arrow batches, as places are claimed one after another."""
    return _stated(text)
