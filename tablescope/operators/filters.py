"""Faceted filter algebra: ``Filter`` records -> one boolean ``Column``.

Semantics (all ANDed together; no inputs -> no predicate):

* value filters on the same ``(column, contains)`` OR together; an ``is_null``
  filter joins its column's OR group ("QLD or missing" is one choice);
* a value compares **as text** (``to_text(col) = v``); ``contains`` tests array
  membership of the element text;
* ``negate``: value -> ``IS DISTINCT FROM`` (keeps NULLs), null -> ``IS NOT
  NULL``, containment -> ``NOT array_contains`` (a NULL array yields NULL and
  the row is dropped -- three-valued logic kept on purpose);
* numeric range: inclusive both ends, ignored when ``value`` is set, ``negate``
  has no effect on it;
* temporal range: ``>= tmin``; a bare ``YYYY-MM-DD`` tmax means the whole day
  (``< next midnight``), otherwise ``< tmax``;
* free-text search ``q`` (trimmed): any column's text contains ``q``
  case-insensitively; ``%``/``_`` inside ``q`` act as LIKE wildcards.

The predicate is built on the driver from ``df.schema`` only; it is a plain
Catalyst expression, so string equality and range bounds push down to the
parquet scan.
"""
from __future__ import annotations

import datetime as _dt
import json
import math
import re
from dataclasses import dataclass, replace
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, localcontext
from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.text import text_of
from tablescope.types import is_scalar_list


@dataclass(frozen=True)
class Filter:
    column: str
    value: str | None = None
    min: float | None = None
    max: float | None = None
    tmin: str | None = None
    tmax: str | None = None
    contains: bool = False
    is_null: bool = False
    negate: bool = False

    def is_range(self) -> bool:
        return self.value is None and (self.min is not None or self.max is not None)

    def is_trange(self) -> bool:
        return self.tmin is not None or self.tmax is not None


def filters_from_json(text: str | None) -> list[Filter]:
    """Parse a JSON filter list.  Malformed input raises (never silently drops)."""
    if text is None or not text.strip():
        return []
    raw = json.loads(text)
    if not isinstance(raw, list):
        raise ValueError("filters must be a JSON list")
    keys = Filter.__dataclass_fields__.keys()
    return [Filter(**{k: v for k, v in item.items() if k in keys}) for item in raw]


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _is_bare_date(s: str) -> bool:
    return re.fullmatch(r"\d{4}-\d{2}-\d{2}", s) is not None


def normalize_contains(schema: T.StructType, filters: Iterable[Filter]) -> list[Filter]:
    """A bare element value on a scalar-list column means containment; a whole
    array literal ``[...]`` is equality on the list text, whatever the flag."""
    out = []
    types = {f.name: f.dataType for f in schema.fields}
    for f in filters:
        is_list = f.column in types and is_scalar_list(types[f.column])
        whole = f.value is not None and f.value.strip().startswith("[") and f.value.strip().endswith("]")
        if whole and is_list:
            f = replace(f, contains=False)
        elif f.value is not None and not f.contains and is_list:
            f = replace(f, contains=True)
        out.append(f)
    return out


_INT_TEXT = re.compile(r"0|-?[1-9]\d*")
_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _int_bounds(dt: T.DataType) -> tuple[int, int]:
    half = 1 << (_BITS[type(dt)] - 1)
    return -half, half - 1


def _typed_equals(c: Column, dt: T.DataType, v: str) -> Column | None:
    """A comparison in the column's own type that every row with the text ``v`` meets; it reaches the scan."""
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        try:
            number = float(v)
        except ValueError:
            return None
        return c == F.lit(number).cast(dt) if math.isfinite(number) and number else None
    literal = F.lit(v).try_cast(dt)
    if isinstance(dt, (T.DecimalType, T.DateType, T.TimestampNTZType)):
        return c == literal
    if isinstance(dt, T.TimestampType):   # a wall-clock text can name two instants where clocks go back
        day = F.expr("interval 1 day")
        return c.between(literal - day, literal + day)
    return None


def _value_equals(schema: T.StructType, name: str, v: str) -> Column:
    dt = schema[name].dataType
    c = col(name)
    if isinstance(dt, T.StringType):
        return c == F.lit(v)  # identical to text equality, and pushes down
    if type(dt) in _BITS:
        lo, hi = _int_bounds(dt)
        if _INT_TEXT.fullmatch(v) and lo <= int(v) <= hi:
            return c == F.lit(int(v)).cast(dt)
        return F.lit(False) & c.isNotNull()  # no integer has this text
    typed, text = _typed_equals(c, dt, v), text_of(c, dt) == F.lit(v)
    return text if typed is None else typed & text


def _bound(c: Column, dt: T.DataType, value, lower: bool) -> Column:
    """``c >= value`` (``lower``) or ``c <= value``, exact and in the column's own type."""
    exact = Decimal(str(value))
    rounding = ROUND_CEILING if lower else ROUND_FLOOR
    if exact.is_finite() and type(dt) in _BITS:
        whole, (lo, hi) = int(exact.to_integral_value(rounding)), _int_bounds(dt)
        if not lo <= whole <= hi:   # beyond the type: every value meets the bound, or none
            return c.isNotNull() if (whole < lo) == lower else F.lit(False) & c.isNotNull()
        literal = F.lit(whole).cast(dt)
    elif exact.is_finite() and isinstance(dt, T.DecimalType) and exact.adjusted() < dt.precision - dt.scale:
        with localcontext() as ctx:
            ctx.prec = 100
            rounded = exact.quantize(Decimal(1).scaleb(-dt.scale), rounding)
        if rounded.adjusted() >= dt.precision - dt.scale and rounded:   # rounded past the last value of the type
            return F.lit(False) & c.isNotNull() if (rounded > 0) == lower else c.isNotNull()
        literal = F.lit(format(rounded, "f")).cast(dt)
    else:
        literal = F.lit(float(value))
    return c >= literal if lower else c <= literal


def _contains(schema: T.StructType, name: str, v: str) -> Column:
    dt = schema[name].dataType
    if not isinstance(dt, T.ArrayType):
        raise ValueError(f"containment filter on non-list column {name!r}")
    et = dt.elementType
    return F.array_contains(F.transform(col(name), lambda x: text_of(x, et)), F.lit(v))


def _like_regex(q: str) -> str:
    parts = []
    for ch in q:
        if ch == "%":
            parts.append(".*")
        elif ch == "_":
            parts.append(".")
        else:
            parts.append(re.escape(ch))
    return "(?isu)^.*" + "".join(parts) + ".*$"


def search_predicate(schema: T.StructType, q: str | None, columns: Sequence[str] | None = None) -> Column | None:
    if q is None or not q.strip():
        return None
    q = q.strip()
    names = list(columns) if columns is not None else [f.name for f in schema.fields]
    if not names:
        return None
    texts = [text_of(col(n), schema[n].dataType) for n in names]
    if "%" in q or "_" in q:
        rx = _like_regex(q)
        ors = [t.rlike(rx) for t in texts]
    else:
        needle = q.lower()
        ors = [F.lower(t).contains(needle) for t in texts]
    return reduce(lambda a, b: a | b, ors)


def _temporal_literal(dt: T.DataType, s: str) -> Column:
    return F.lit(s).cast(dt if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)) else T.TimestampType())


def _known(schema: T.StructType, name: str) -> Column:
    if name not in schema.fieldNames():
        raise ValueError(f"no such column: {name}")
    return col(name)


def _wanted(schema: T.StructType, filters: Sequence[Filter]) -> list[Column]:
    """Wanted values and wanted NULLs: OR within a column (containment apart)."""
    by_column: dict[tuple[str, bool], list[Filter]] = {}
    for f in filters:
        if not f.negate and (f.value is not None or f.is_null):
            by_column.setdefault((f.column, f.contains), []).append(f)
    out = []
    for (name, contains), members in by_column.items():
        c = _known(schema, name)
        values = list(dict.fromkeys(f.value for f in members if f.value is not None))
        if not contains and len(values) > 1 and isinstance(schema[name].dataType, T.StringType):
            options = [c.isin(values)]
        else:
            test = _contains if contains else _value_equals
            options = [test(schema, name, v) for v in values]
        if any(f.value is None for f in members):
            options.append(c.isNull())
        out.append(reduce(Column.__or__, options))
    return out


def _unwanted(schema: T.StructType, f: Filter) -> Column | None:
    """The rows that a negated filter leaves (a NULL has no text, so it stays)."""
    if not f.negate:
        return None
    c = _known(schema, f.column)
    if f.value is None:
        return c.isNotNull() if f.is_null else None
    if f.contains:
        return ~_contains(schema, f.column, f.value)
    return ~text_of(c, schema[f.column].dataType).eqNullSafe(F.lit(f.value))


def _in_range(schema: T.StructType, f: Filter) -> Column | None:
    """Numbers from ``min`` to ``max``, both included."""
    if not f.is_range():
        return None
    c, dt = _known(schema, f.column), schema[f.column].dataType
    return reduce(Column.__and__, [_bound(c, dt, v, lower) for v, lower in ((f.min, True), (f.max, False)) if v is not None])


def _in_time_range(schema: T.StructType, f: Filter) -> Column | None:
    """Instants from ``tmin`` to before ``tmax``; a bare date as ``tmax`` includes that day."""
    if not f.is_trange():
        return None
    c, dt = _known(schema, f.column), schema[f.column].dataType
    sides = [] if f.tmin is None else [c >= _temporal_literal(dt, f.tmin)]
    if f.tmax is not None:
        end = f.tmax
        if _is_bare_date(end):
            end = (_dt.date.fromisoformat(end) + _dt.timedelta(days=1)).isoformat()
        sides.append(c < _temporal_literal(dt, end))
    return reduce(Column.__and__, sides)


def build_clauses(schema: T.StructType, q: str | None, filters: Sequence[Filter]) -> list[Column]:
    """The clauses of search and filters; a row must meet all of them."""
    single = [kind(schema, f) for kind in (_unwanted, _in_range, _in_time_range) for f in filters]
    return [c for c in (*_wanted(schema, filters), *single, search_predicate(schema, q)) if c is not None]


def build_predicate(schema: T.StructType, q: str | None = None, filters: Sequence[Filter] = ()) -> Column | None:
    """One boolean Column for search + filters, or None when there is nothing."""
    filters = normalize_contains(schema, filters)
    clauses = build_clauses(schema, q, filters)
    if not clauses:
        return None
    return reduce(lambda a, b: a & b, clauses)


def apply_filters(df: DataFrame, q: str | None = None, filters: Sequence[Filter] = ()) -> DataFrame:
    pred = build_predicate(df.schema, q, filters)
    return df if pred is None else df.where(pred)
