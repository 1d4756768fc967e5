"""Dataset snapshot and restore (2.A10, re-aimed).

A bundle is a directory: ``<bundle>/<name>/`` parquet per table plus
``<bundle>/_manifest/`` (a one-file JSON table: format version, table name,
row count, schema JSON, order-independent checksum).  Everything is written and
checked by Spark jobs; nothing passes through the driver but the manifest.
"""
from __future__ import annotations

import json
import os
from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.operators.filters import col

FORMAT_VERSION = 1
FORMAT_COLUMNS = ("db", "table", "column", "spec", "seq")


def table_checksum(df: DataFrame) -> DataFrame:
    """(rows, checksum): sum of a 64-bit row hash as decimal(38,0) -- row-order
    and partitioning independent, no overflow."""
    # maps have no hash: such columns count as their JSON text
    parts = [F.to_json(col(f.name)) if "map<" in f.dataType.simpleString() else col(f.name) for f in df.schema.fields]
    h = F.xxhash64(*parts).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias("checksum"))


def snapshot(tables: Mapping[str, DataFrame], bundle: str, mode: str = "errorifexists", formats: DataFrame | None = None) -> DataFrame:
    """Write every table, the format registry (db, table, column, spec, seq) if given, and the manifest;
    returns the manifest DataFrame."""
    spark = next(iter(tables.values())).sparkSession
    parts = []
    for name, df in tables.items():
        df.write.mode(mode).parquet(os.path.join(bundle, name))
        written = spark.read.parquet(os.path.join(bundle, name))
        parts.append(table_checksum(written).select(
            F.lit(FORMAT_VERSION).alias("version"), F.lit(name).alias("table_name"), "rows",
            F.lit(len(df.columns)).alias("column_count"), F.lit(df.schema.json()).alias("schema_json"), "checksum"))
    manifest = parts[0]
    for p in parts[1:]:
        manifest = manifest.unionByName(p)
    if formats is not None:
        formats.select(*FORMAT_COLUMNS).write.mode(mode).parquet(os.path.join(bundle, "_formats"))
    manifest.coalesce(1).write.mode(mode).json(os.path.join(bundle, "_manifest"))
    return spark.read.json(os.path.join(bundle, "_manifest"), schema=MANIFEST_SCHEMA)


MANIFEST_SCHEMA = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("table_name", T.StringType()),
    T.StructField("rows", T.LongType()), T.StructField("column_count", T.IntegerType()),
    T.StructField("schema_json", T.StringType()), T.StructField("checksum", T.StringType())])


def read_manifest(spark: SparkSession, bundle: str) -> DataFrame:
    return spark.read.json(os.path.join(bundle, "_manifest"), schema=MANIFEST_SCHEMA)


def restore(spark: SparkSession, bundle: str, verify: bool = True, register: bool = False) -> dict[str, DataFrame]:
    """Read a bundle back; refuses a newer format version; verifies row counts,
    schema and checksums (one aggregate job per table).  With ``register`` each
    table becomes a temp view; a name already taken gets ``_2``, ``_3``, ..."""
    man = read_manifest(spark, bundle).collect()   # one row per table: small
    out = {}
    for m in man:
        if m["version"] > FORMAT_VERSION:
            raise ValueError(f"bundle format {m['version']} is newer than supported {FORMAT_VERSION}")
        schema = T.StructType.fromJson(json.loads(m["schema_json"]))
        path = os.path.join(bundle, m["table_name"])
        df = spark.read.schema(schema).parquet(path)
        if verify:
            if _fields(spark.read.parquet(path).schema) != _fields(schema):
                raise ValueError(f"table {m['table_name']} does not have the schema of its manifest")
            got = table_checksum(df).collect()[0]
            if got["rows"] != m["rows"] or got["checksum"] != m["checksum"]:
                raise ValueError(f"table {m['table_name']} does not match its manifest")
        out[m["table_name"]] = df
    if register:
        register_views(spark, out)
    return out


def _fields(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def register_views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> dict[str, str]:
    """Each table as a temp view; returns the view of each table (``name``, or ``name_2``, ... if taken)."""
    taken = {t.name.lower() for t in spark.catalog.listTables()}
    views = {}
    for name, df in tables.items():
        view, k = name, 2
        while view.lower() in taken:
            view, k = f"{name}_{k}", k + 1
        df.createOrReplaceTempView(view)
        taken.add(view.lower())
        views[name] = view
    return views


def restored_formats(spark: SparkSession, bundle: str, db: str, views: Mapping[str, str] | None = None) -> DataFrame:
    """The bundle's format registry under its new keys: database ``db``, and tables by the names
    that ``register_views`` gave them.  Bare-column entries (table NULL) keep their column."""
    kept = spark.read.parquet(os.path.join(bundle, "_formats"))
    names = {k: v for k, v in (views or {}).items() if k != v}
    table = F.col("table")
    if names:
        renamed = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        table = F.when(table.isNotNull(), F.coalesce(F.element_at(renamed, table), table))
    return kept.select(F.lit(db).alias("db"), table.alias("table"), "column", "spec", "seq")
