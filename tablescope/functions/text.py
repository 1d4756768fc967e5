"""``to_text``: the one canonical text form of a value.

Value filters, facets, top values and junk checks compare values *as text*.
The text must be the same one the SQL oracle (DuckDB) produces with
``CAST(x AS VARCHAR)``, so a few Spark defaults are rewritten here with native
expressions (no UDF):

* doubles/floats: plain notation for 1e-4 <= |x| < 1e16 (``10000000.0``),
  otherwise ``1e+16`` / ``1.234e-05``; ``nan``, ``inf``, ``-inf``.
* arrays: ``[a, b, NULL]`` with element text applied recursively.
* structs and maps: JSON text (documented deviation).
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EXP = r"^(-?\d+(?:\.\d+)?)E(-?)(\d+)$"


def plain_number_text(c: Column) -> Column:
    s = c.cast("string")
    a = F.abs(c.cast("double"))
    # Spark writes the shortest round-trip digits; re-express them.
    plain = F.regexp_replace(
        F.regexp_replace(s.cast("decimal(38,18)").cast("string"), r"0+$", ""), r"\.$", ".0")
    mant = F.regexp_replace(F.regexp_extract(s, _EXP, 1), r"\.0$", "")
    sign = F.when(F.regexp_extract(s, _EXP, 2) == "-", F.lit("-")).otherwise(F.lit("+"))
    expo = F.lpad(F.regexp_extract(s, _EXP, 3), 2, "0")
    sci = F.concat(mant, F.lit("e"), sign, expo)
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(c), F.lit("nan"))
        .when(c.cast("double") == float("inf"), F.lit("inf"))
        .when(c.cast("double") == float("-inf"), F.lit("-inf"))
        .when(~s.contains("E"), s)
        .when((a >= 1e-4) & (a < 1e16), plain)
        .otherwise(sci)
    )


def text_of(c: Column, dt: T.DataType) -> Column:
    """Text of column ``c`` whose Spark type is ``dt``."""
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return plain_number_text(c)
    if isinstance(dt, T.ArrayType):
        et = dt.elementType
        inner = F.transform(c, lambda x: text_of(x, et))
        return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("["), F.array_join(inner, ", ", "NULL"), F.lit("]")))
    if isinstance(dt, (T.StructType, T.MapType)):
        return F.to_json(c)
    if isinstance(dt, T.StringType):
        return c
    return c.cast("string")


def to_text(df_or_schema, name: str) -> Column:
    """Canonical text of column ``name`` of a DataFrame (or a StructType)."""
    schema = df_or_schema if isinstance(df_or_schema, T.StructType) else df_or_schema.schema
    return text_of(F.col(_q(name)), schema[name].dataType)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def key_text(c: Column, dt: T.DataType) -> Column:
    """A cheap text that is equal exactly when the values are equal -- for
    counting distinct values, where the display form does not matter (the
    DuckDB-compatible ``text_of`` costs several regexes per double)."""
    if isinstance(dt, T.StringType):
        return c
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.when(c == 0, F.lit("0.0")).otherwise(c.cast("string"))   # -0.0 equals 0.0
    if isinstance(dt, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_json(c)
    return c.cast("string")
