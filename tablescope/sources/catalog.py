"""Catalog: list relations, describe, view definitions, read-only ad-hoc SQL
and saved views (2.A1-A6)."""
from __future__ import annotations

import re
from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.operators.explore import export, json_safe
from tablescope.operators.filters import col
from tablescope.types import classify

# SQL text of views saved through ``save_view`` (temp views keep no text).
_VIEW_SQL: dict[str, str] = {}
# Names that ``register_tables`` exposes: relations over files, not views.
_FILE_RELATIONS: set[str] = set()

_READ_START = re.compile(r"^\s*(select|with|from|values|table)\b", re.IGNORECASE)


def register_tables(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> list[str]:
    """Expose ``<sf_dir>/<name>.parquet`` as temp views named ``name``."""
    out = []
    for n in names:
        spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet").createOrReplaceTempView(n)
        _FILE_RELATIONS.add(n)
        out.append(n)
    return out


def list_relations(spark: SparkSession, names: Sequence[str] | None = None) -> DataFrame:
    """(name, schema_name, column_count, estimated_size, is_view) by name.

    A table's size is its row count, from one union of per-table counts (one job; each count
    reads only parquet footers).  A view -- saved, persistent, or any other temp view -- is
    never run to be listed: its size is NULL."""
    current = spark.catalog.currentDatabase()
    tables = [t for t in spark.catalog.listTables() if names is None or t.name in names]
    tables.sort(key=lambda t: t.name)
    if not tables:
        return spark.createDataFrame([], "name string, schema_name string, column_count int, estimated_size long, is_view boolean")
    parts = []
    for t in tables:
        df = spark.table(t.name)
        is_view = t.tableType == "VIEW" or (t.isTemporary and t.name not in _FILE_RELATIONS)
        size = F.lit(None).cast("long") if is_view else F.col("n")
        source = spark.range(1).select(F.lit(None).cast("long").alias("n")) if is_view else df.agg(F.count(F.lit(1)).alias("n"))
        parts.append(source.select(F.lit(t.name).alias("name"), F.lit(t.namespace[0] if t.namespace else current).alias("schema_name"),
                                   F.lit(len(df.columns)).alias("column_count"), size.alias("estimated_size"), F.lit(is_view).alias("is_view")))
    return reduce(DataFrame.unionByName, parts)


def describe(df: DataFrame, table_name: str | None = None) -> DataFrame:
    """(table_name, ordinal, column_name, col_type, kind, nullable, non_null) in table order;
    ``non_null`` counts the values of every column in one aggregate."""
    counted = df.agg(*[F.count(col(f.name)).alias(f"c{i}") for i, f in enumerate(df.schema.fields)])
    rows = [F.struct(F.lit(table_name).cast("string").alias("table_name"), F.lit(i + 1).alias("ordinal"), F.lit(f.name).alias("column_name"),
                     F.lit(f.dataType.simpleString()).alias("col_type"), F.lit(classify(f.dataType)).alias("kind"),
                     F.lit(f.nullable).alias("nullable"), F.col(f"c{i}").alias("non_null"))
            for i, f in enumerate(df.schema.fields)]
    return counted.select(F.inline(F.array(*rows)))


def view_definition(spark: SparkSession, name: str) -> str | None:
    """SQL text of a saved view, else None."""
    if name in _VIEW_SQL:
        return _VIEW_SQL[name]
    try:
        row = spark.sql(f"SHOW CREATE TABLE `{name}`").collect()
        return row[0][0] if row else None
    except Exception:  # temp views / tables have no stored text
        return None


def _check_single_read(sql: str) -> str:
    s = sql.strip()
    if s.endswith(";"):
        s = s[:-1].rstrip()
    if not s:
        raise ValueError("empty SQL")
    if ";" in _strip_literals(s):
        raise ValueError("only one statement is allowed")
    if not _READ_START.match(s):
        raise ValueError("only read-only queries (SELECT / WITH / FROM / VALUES / TABLE) are allowed")
    return s


def _strip_literals(s: str) -> str:
    return re.sub(r"'(?:[^']|'')*'", "''", s)


def _check_reads_only(spark: SparkSession, sql: str) -> None:
    """Refuse a statement whose parsed plan has a command or an insert anywhere (``WITH ... INSERT``,
    ``FROM ... INSERT``): ``spark.sql`` would run it at once."""
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    writes = [loader.loadClass(logical + name) for name in ("Command", "ParsedStatement")]
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while todo:
        node = todo.pop()
        if any(kind.isInstance(node) for kind in writes):
            raise ValueError("only read-only queries are allowed")
        for nodes in (node.children(), node.innerChildren()):
            todo += [nodes.apply(i) for i in range(nodes.size())]


def query(spark: SparkSession, sql: str, json_nested: bool = True) -> DataFrame:
    """Read-only ad-hoc SQL; nested result columns are rewrapped as JSON."""
    body = _check_single_read(sql)
    _check_reads_only(spark, body)
    df = spark.sql(body)
    return json_safe(df) if json_nested else df


def save_view(spark: SparkSession, name: str, sql: str, overwrite: bool = False) -> DataFrame:
    """Save one read-only statement as a (temp) view.  A name clash -- compared
    case-insensitively with any relation -- fails unless ``overwrite``."""
    body = _check_single_read(sql)
    _check_reads_only(spark, body)
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"invalid view name: {name!r}")
    existing = {t.name.lower() for t in spark.catalog.listTables()}
    if name.lower() in existing and not overwrite:
        raise ValueError(f"a relation named {name!r} already exists")
    df = spark.sql(body)
    df.createOrReplaceTempView(name)
    _VIEW_SQL[name] = body
    _FILE_RELATIONS.discard(name)
    return spark.table(name)


def export_query(spark: SparkSession, sql: str, path: str, fmt: str = "csv") -> T.StructType:
    """Write the whole result of one read-only statement under ``path``; returns its schema."""
    result = query(spark, sql, json_nested=False)
    export(result, path, fmt)
    return result.schema
