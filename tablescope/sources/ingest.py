"""Ingest CSV/TSV, JSON/NDJSON, Parquet and inline VALUES (2.A9).

Inference is an extra pass over the input; pass ``schema`` for large inputs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, header: bool = True, delimiter: str | None = None,
             schema: T.StructType | str | None = None) -> DataFrame:
    """CSV / TSV.  ``delimiter=None`` infers tab for ``.tsv`` paths, else comma."""
    sep = delimiter or ("\t" if path.rstrip("/").lower().endswith(".tsv") else ",")
    r = spark.read.option("header", header).option("sep", sep)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              multiline: bool = False, timestamp_format: str | None = None) -> DataFrame:
    """NDJSON by default; ``multiline=True`` for one JSON document/array per file."""
    r = spark.read.option("multiLine", multiline)
    if timestamp_format is not None:
        r = r.option("timestampNTZFormat", timestamp_format).option("timestampFormat", timestamp_format)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType | str, required: list[str],
                timestamp_format: str | None = None) -> tuple[DataFrame, DataFrame]:
    """An append-only log of JSON lines that may hold anything: (events, rejected lines).

    Blank lines are skipped.  A line that is no JSON object of ``schema``, or that lacks a ``required``
    field, goes with its reason (``malformed``, ``missing <field>``) to the rejects (line, reason); no line
    is lost and none stops the read.  Both come from one parse of the text; write the events before
    using them more than once.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    broken = "__broken"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken}
    if timestamp_format is not None:
        options |= {"timestampNTZFormat": timestamp_format, "timestampFormat": timestamp_format}
    lines = spark.read.text(path).select(F.col("value").alias("line")).where(F.trim(F.translate("line", "\t\r", "  ")) != "")
    parsed = lines.select("line", F.from_json("line", T.StructType([*fields.fields, T.StructField(broken, T.StringType())]), options).alias("row"))
    reason = F.when(F.col("row").isNull() | F.col("row")[broken].isNotNull(), F.lit("malformed"))
    for name in required:
        reason = reason.when(F.col("row")[name].isNull(), F.lit(f"missing {name}"))
    judged = parsed.withColumn("reason", reason)
    return (judged.where("reason is null").select(*[F.col("row")[f.name].alias(f.name) for f in fields.fields]),
            judged.where("reason is not null").select("line", "reason"))


def read_mixed_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines whose fields change their type from line to line, as one VARIANT column ``record``
    (null for a line that is no JSON)."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.try_parse_json("value").alias("record"))


def mixed_fields(records: DataFrame, column: str = "record") -> DataFrame:
    """(path, type, n): which types each top-level field of a VARIANT column takes, and how often."""
    made = records.where(F.col(column).isNotNull()).select(F.from_json(F.to_json(column), "map<string,string>").alias("m"), F.col(column).alias("v"))
    kinds = made.select(F.explode(F.map_keys("m")).alias("path"), "v")
    kind = F.schema_of_variant(F.try_variant_get("v", F.concat(F.lit("$['"), "path", F.lit("']")), "variant"))
    return kinds.groupBy("path", kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_any(spark: SparkSession, path: str, **kw) -> DataFrame:
    p = path.rstrip("/").lower()
    if p.endswith((".csv", ".tsv")):
        return read_csv(spark, path, **kw)
    if p.endswith((".json", ".ndjson", ".jsonl")):
        return read_json(spark, path, **kw)
    if p.endswith(".parquet"):
        return read_parquet(spark, path)
    raise ValueError(f"cannot tell the format of {path!r}")


def from_values(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """Inline VALUES (small literal inputs only)."""
    return spark.createDataFrame(rows, schema)
