"""Keyset pages: any page of a sorted table at the cost of the first one (2.C1).

The order is the sort column, the tie-break columns and last a digest of the row, so that only
repeated rows are equal in it, and those can stand for each other.  A ``Cursor`` is a place
in that order: the key of a row and how many rows of just that key lie before the page.  A
page reads the rows at and behind its cursor: a plain predicate, whose part on the sort column
reaches the scan, and a top-k of ``limit`` rows per task.

``seek`` finds the cursor of any offset without sorting the rows: it counts the rows of each
key, lays the keys out in ranges, adds up one number per range and looks into the one
range the offset falls into.

NULLs come last both ways, as in ``explore.preview``; NaN is greater than any number.
Defined results: an offset beyond the last row has no cursor, a page behind the last row no rows;
a sort column that does not exist means no sort column.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.operators.census import checkpoint, default_buckets
from tablescope.operators.explore import DEFAULT_PAGE
from tablescope.operators.filters import Filter, apply_filters, col
from tablescope.types import is_nested

KEY = "__key"


@dataclass(frozen=True)
class Cursor:
    """The key values (sort columns, digest) that a page starts at; ``served`` rows of that key come before it."""
    values: tuple
    served: int = 0


class Pages:
    """The pages of ``df`` in one order under one search and filter list."""

    def __init__(self, df: DataFrame, sort: str | None = None, direction: str | None = None, tie_break: Sequence[str] = (),
                 q: str | None = None, filters: Sequence[Filter] = ()):
        self.df = apply_filters(df, q, filters)
        named = ([sort] if sort in df.columns else []) + [c for c in tie_break if c != sort]
        self.down = [c == sort and direction == "desc" for c in named] + [False]
        text = [F.to_json(col(f.name)) if is_nested(f.dataType) else col(f.name) for f in df.schema.fields]
        self.keys = [*[col(c) for c in named], F.xxhash64(*text)]
        self.types = [df.schema[c].dataType for c in named] + ["bigint"]

    def _order(self, keys: Sequence[Column]) -> list[Column]:
        return [k.desc_nulls_last() if down else k.asc_nulls_last() for k, down in zip(keys, self.down)]

    def _key(self) -> Column:
        return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(self.keys)])

    def _literals(self, cursor: Cursor) -> list[Column]:
        # a naive time goes by its text: as a literal it would pass through the session zone
        return [F.lit(str(v) if v is not None and isinstance(t, T.TimestampNTZType) else v).cast(t) for v, t in zip(cursor.values, self.types)]

    def _same(self, cursor: Cursor) -> Column:
        return reduce(and_, [k.eqNullSafe(v) for k, v in zip(self.keys, self._literals(cursor))])

    def _behind(self, cursor: Cursor) -> list[Column]:
        """Rows strictly behind the cursor's key, as conditions of which a row meets one at most.  The rows
        whose first key is NULL stand alone: so the bound on the first key is a plain conjunct that reaches the scan."""
        keys, values = self.keys, self._literals(cursor)
        if cursor.values[0] is None:
            return [keys[0].isNull() & self._beyond(cursor, 1)]
        bound = (keys[0] <= values[0]) if self.down[0] else (keys[0] >= values[0])
        past = (keys[0] < values[0]) if self.down[0] else (keys[0] > values[0])
        return [bound & (past | (keys[0].eqNullSafe(values[0]) & self._beyond(cursor, 1))), keys[0].isNull()]

    def _beyond(self, cursor: Cursor, start: int) -> Column:
        """Behind in one of the keys from ``start`` on, and equal in those between."""
        ways, equal = [], []
        for k, v, value, down in list(zip(self.keys, self._literals(cursor), cursor.values, self.down))[start:]:
            if value is not None:   # nothing lies behind a NULL
                ways.append(reduce(and_, [*equal, ((k < v) if down else (k > v)) | k.isNull()]))
            equal.append(k.eqNullSafe(v))
        return reduce(or_, ways, F.lit(False))

    def page(self, cursor: Cursor | None = None, limit: int = DEFAULT_PAGE) -> DataFrame:
        """``limit`` rows from the cursor on (the first page without one), with the key of each as the struct ``__key``."""
        rows = self.df
        if cursor is not None:
            same = rows.where(self._same(cursor))
            left = max(0, same.count() - cursor.served) if cursor.served else limit
            rows = reduce(DataFrame.unionByName, [same.limit(min(left, limit)), *[rows.where(c) for c in self._behind(cursor)]])
        keyed = rows.orderBy(*self._order(self.keys)).limit(max(0, int(limit))).withColumn(KEY, self._key())
        shown = [F.to_json(col(f.name)).alias(f.name) if is_nested(f.dataType) else col(f.name) for f in self.df.schema.fields]
        return keyed.select(*shown, KEY)

    def after(self, shown: Sequence[Row], cursor: Cursor | None = None) -> Cursor | None:
        """The cursor behind the collected rows of a page that began at ``cursor``."""
        if not shown:
            return cursor
        same = lambda key: repr(tuple(key))  # noqa: E731  (NaN is equal to itself here)
        last = tuple(shown[-1][KEY])
        served = sum(same(r[KEY]) == same(last) for r in shown)
        return Cursor(last, served + (cursor.served if cursor is not None and same(cursor.values) == same(last) else 0))

    def seek(self, offset: int) -> Cursor | None:
        """The cursor of row number ``offset``, counted from 0."""
        names = [f"k{i}" for i in range(len(self.keys))]
        counts = self.df.select(*[k.alias(n) for k, n in zip(self.keys, names)]).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
        order = self._order([F.col(n) for n in names])
        laid = checkpoint(counts.repartitionByRange(default_buckets(self.df.sparkSession), *order).withColumn("range", F.spark_partition_id()))
        before = 0
        for r in sorted(laid.groupBy("range").agg(F.sum("n").alias("n")).collect()):   # one row per range
            if offset < before + r.n:
                upto = F.sum("n").over(Window.partitionBy("range").orderBy(*order))
                found = (laid.where(F.col("range") == r.range).withColumn("before", F.lit(before) + upto - F.col("n"))
                         .where((F.col("before") <= offset) & (offset < F.col("before") + F.col("n"))).first())
                return Cursor(tuple(found[n] for n in names), offset - found.before)
            before += r.n
        return None
