"""Paging, sorting, export projection and nested-to-JSON projection (2.A, 2.C)."""
from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.operators.filters import Filter, apply_filters, col
from tablescope.types import is_nested

DEFAULT_PAGE = 25
TABLE_TILE_ROWS = 20
# exports keep microseconds, and quotes inside values are doubled
_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_CSV = {"header": True, "escape": '"', **_TIMES}


def json_safe(df: DataFrame) -> DataFrame:
    """Wrap only nested columns (struct/map/array) in ``to_json``."""
    return df.select([F.to_json(col(f.name)).alias(f.name) if is_nested(f.dataType) else col(f.name)
                      for f in df.schema.fields])


def sort_columns(df: DataFrame, sort: str | None, direction: str | None,
                 tie_break: Sequence[str] = ()) -> list:
    """ORDER BY only on a real column; NULLs last both ways (as the reference
    engine does); optional tie-break columns make pages deterministic."""
    if sort is None or sort not in df.columns:
        return [col(t).asc_nulls_last() for t in tie_break]
    c = col(sort)
    first = c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last()
    return [first] + [col(t).asc_nulls_last() for t in tie_break if t != sort]


@dataclass
class Page:
    rows: DataFrame
    total: int
    offset: int
    limit: int


def preview(df: DataFrame, limit: int = DEFAULT_PAGE, offset: int = 0, q: str | None = None,
            filters: Sequence[Filter] = (), sort: str | None = None, direction: str | None = None,
            tie_break: Sequence[str] = (), with_total: bool = True) -> Page:
    """One filtered, sorted page (top-k: Spark plans TakeOrderedAndProject, no
    full sort) plus the total matching count.  Each partition keeps at most
    offset + limit rows for the final merge, so shallow pages are cheap at any
    table size; very deep offsets are better served by filtering on the sort
    key of the last row seen (keyset paging)."""
    limit = max(0, int(limit))
    kept = apply_filters(df, q, filters)
    order = sort_columns(df, sort, direction, tie_break)
    page = kept.orderBy(*order) if order else kept
    page = json_safe(page.offset(int(offset)).limit(limit) if offset else page.limit(limit))
    total = kept.count() if with_total else -1
    return Page(page, total, offset, limit)


def preview_with_total(df: DataFrame, total_col: str = "total", **kw) -> DataFrame:
    p = preview(df, **kw)
    return p.rows.withColumn(total_col, F.lit(p.total).cast("long"))


def table_tile(df: DataFrame, text: str | None = None, order: Sequence[str] = (), rows: int = TABLE_TILE_ROWS) -> DataFrame:
    """First ``rows`` rows containing ``text`` in any column."""
    kept = apply_filters(df, text, ())
    if order:
        kept = kept.orderBy(*[col(c).asc_nulls_last() for c in order])
    return json_safe(kept.limit(rows))


def export_frame(df: DataFrame, q: str | None = None, filters: Sequence[Filter] = (),
                 hidden: Sequence[str] = ()) -> DataFrame:
    """Filtered rows for export: hidden columns are still searched but not
    written; hiding every column means writing all of them."""
    kept = apply_filters(df, q, filters)
    visible = [c for c in df.columns if c not in set(hidden)] or list(df.columns)
    return kept.select([col(c) for c in visible])


def export(df: DataFrame, path: str, fmt: str = "csv", q: str | None = None,
           filters: Sequence[Filter] = (), hidden: Sequence[str] = (), mode: str = "overwrite") -> str:
    """Write the whole filtered result (no row limit) as CSV (default) or JSON
    lines.  Distributed write: one file per partition under ``path``."""
    out = export_frame(df, q, filters, hidden)
    if fmt == "csv":
        json_safe(out).write.mode(mode).options(**_CSV).csv(path)
    elif fmt == "json":
        out.write.mode(mode).options(**_TIMES).json(path)
    else:
        raise ValueError(f"unknown export format: {fmt}")
    return path


def read_export(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """An export read back under the schema it was written from (nested columns of a CSV stay JSON text)."""
    if fmt == "csv":
        flat = T.StructType([T.StructField(f.name, T.StringType() if is_nested(f.dataType) else f.dataType) for f in schema.fields])
        # an unquoted empty field is NULL, a quoted one an empty text; no word stands for NULL
        return spark.read.schema(flat).options(multiLine=True, nullValue="\0", **_CSV).csv(path)
    if fmt == "json":
        return spark.read.schema(schema).options(**_TIMES).json(path)
    raise ValueError(f"unknown export format: {fmt}")
