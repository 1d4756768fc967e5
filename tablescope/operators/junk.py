"""Junk-column detection (2.G): health metrics, modal values, exact duplicate
columns and verdicts.

Everything is computed on the canonical text of each value (equal text is what
"these two columns hold the same data" means here).

Duplicates without d^2 comparisons: one pass computes a row-aligned
fingerprint per column, ``sum(xxhash64(row_hash, text))`` as decimal(38,0)
(no overflow).  Columns equal on every row (NULL matching NULL) have equal
fingerprints; only pairs with equal fingerprints are then verified exactly with
``count_if(a <=> b) = n`` in one more aggregate.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from itertools import combinations
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.text import text_of
from tablescope.operators.census import census, top_k_per_group
from tablescope.operators.filters import Filter, apply_filters, col
from tablescope.types import junk_supported

# Verdict thresholds (the reference kept them in its browser code, which is not
# available; chosen values, applied with >= / <):
NEAR_CONSTANT_SHARE = 0.95   # modal value holds at least this share of non-null rows
SPARSE_SHARE = 0.10          # fewer than this share of rows are non-null


@dataclass
class JunkReport:
    row_count: int
    columns: DataFrame      # column_name, non_null, distinct, top_value, top_count
    text: DataFrame         # the compared columns, as text
    names: list[str]

    @cached_property
    def duplicates(self) -> DataFrame:   # a, b; found when first asked for
        return duplicates(self.text, self.names)


def _usable(df: DataFrame) -> list[str]:
    seen, out = set(), []
    for f in df.schema.fields:
        if junk_supported(f.dataType) and f.name not in seen:
            out.append(f.name)
        seen.add(f.name)
    return out


def junk(df: DataFrame, q: str | None = None, filters: Sequence[Filter] = ()) -> JunkReport:
    spark = df.sparkSession
    kept = apply_filters(df, q, filters)
    names = _usable(df)
    n = kept.count()
    if not names or n == 0:
        empty_c = spark.createDataFrame([], "column_name string, non_null long, distinct long, top_value string, top_count long")
        return JunkReport(n, empty_c, empty_c, [])
    text = kept.select([text_of(col(c), df.schema[c].dataType).alias(c) for c in names])
    cen = census(text, [(c, col(c), None, False) for c in names])
    per_col = cen.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("non_null"))
    modal = top_k_per_group(cen, ["column_name"], [F.col("n").desc(), F.col("value").asc()], 1, tie_key="value")
    all_cols = spark.createDataFrame([(c, i) for i, c in enumerate(names)], "column_name string, ord int")
    columns = (all_cols.join(per_col, "column_name", "left").join(modal.select("column_name", "value", "n"), "column_name", "left")
               .select("column_name", "ord", F.coalesce("non_null", F.lit(0)).cast("long").alias("non_null"),
                       F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct"),
                       F.col("value").alias("top_value"), F.coalesce("n", F.lit(0)).cast("long").alias("top_count"))
               .orderBy("ord").drop("ord"))
    return JunkReport(n, columns, text, names)


def duplicates(text: DataFrame, names: Sequence[str]) -> DataFrame:
    spark = text.sparkSession
    if len(names) < 2:
        return spark.createDataFrame([], "a string, b string")
    row_h = F.xxhash64(*[col(c) for c in names])
    fp = text.select([F.sum(F.xxhash64(row_h, col(c)).cast("decimal(38,0)")).alias(f"f{i}") for i, c in enumerate(names)]
                     + [F.count(col(c)).alias(f"nn{i}") for i, c in enumerate(names)]).collect()[0]
    groups: dict = {}
    for i, c in enumerate(names):
        groups.setdefault(fp[f"f{i}"], []).append(i)
    cands = [(i, j) for members in groups.values() for i, j in combinations(members, 2)
             if fp[f"nn{i}"] > 0 or fp[f"nn{j}"] > 0]
    if not cands:
        return spark.createDataFrame([], "a string, b string")
    chk = text.agg(F.count(F.lit(1)).alias("n"),
                   *[F.count_if(col(names[i]).eqNullSafe(col(names[j]))).alias(f"e{k}") for k, (i, j) in enumerate(cands)]).collect()[0]
    rows = [(names[i], names[j]) for k, (i, j) in enumerate(cands) if chk[f"e{k}"] == chk["n"]]
    return spark.createDataFrame(rows, "a string, b string")


def verdicts(report: JunkReport) -> DataFrame:
    """(column_name, verdict): all_null, constant, near_constant, sparse or ok."""
    n = report.row_count
    c = report.columns
    share = F.col("top_count") / F.col("non_null")
    v = (F.when(F.col("non_null") == 0, F.lit("all_null"))
         .when(F.col("distinct") == 1, F.lit("constant"))
         .when(share >= NEAR_CONSTANT_SHARE, F.lit("near_constant"))
         .when(F.col("non_null") / F.lit(max(n, 1)) < SPARSE_SHARE, F.lit("sparse"))
         .otherwise(F.lit("ok")))
    return c.select("column_name", v.alias("verdict"))


__all__ = ["junk", "verdicts", "duplicates", "JunkReport"]
