"""Column classification on Spark ``DataType`` (never on type-name strings)."""
from __future__ import annotations

import re

from pyspark.sql import types as T

NUMERIC = "numeric"
TEMPORAL = "temporal"
BOOLEAN = "boolean"
LIST = "list"          # array of atomic elements
NESTED = "nested"      # struct / map / array of nested / variant
BINARY = "binary"
TEXT = "text"          # strings and anything else castable to text
OTHER = "other"        # intervals etc.: top values only


def is_nested(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StructType, T.MapType, T.ArrayType)) or type(dt).__name__ == "VariantType"


def is_scalar_list(dt: T.DataType) -> bool:
    return isinstance(dt, T.ArrayType) and not is_nested(dt.elementType)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, T.IntegralType)


def is_temporal(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_boolean(dt: T.DataType) -> bool:
    return isinstance(dt, T.BooleanType)


def is_interval(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType))


def classify(dt: T.DataType) -> str:
    if is_numeric(dt):
        return NUMERIC
    if is_temporal(dt):
        return TEMPORAL
    if is_boolean(dt):
        return BOOLEAN
    if is_scalar_list(dt):
        return LIST
    if is_nested(dt):
        return NESTED
    if isinstance(dt, T.BinaryType):
        return BINARY
    if is_interval(dt):
        return OTHER
    return TEXT


def looks_like_id(name: str) -> bool:
    n = name.lower()
    return n == "id" or n == "rowid" or n.endswith("_id")


def predict_supported(dt: T.DataType) -> bool:
    """Numeric, date/timestamp, string, boolean take part in the prediction matrix."""
    if is_nested(dt) or isinstance(dt, T.BinaryType) or is_interval(dt):
        return False
    return is_numeric(dt) or is_temporal(dt) or isinstance(dt, (T.StringType, T.BooleanType, T.CharType, T.VarcharType))


def junk_supported(dt: T.DataType) -> bool:
    """Everything castable to text except nested values and binary blobs."""
    return not (is_nested(dt) or isinstance(dt, T.BinaryType))


# Fixed name rules (must match the reference's detection):
#   epoch-ish names: ts, *_at, *_ms, epoch
EPOCH_NAME = re.compile(r"^(ts|epoch|.*_at|.*_ms)$", re.IGNORECASE)


# Fixed column names of map coordinates, in any case:
COORDINATES = {
    "lat": ("lat", "latitude"), "lon": ("lon", "lng", "long", "longitude"),
    "from_lat": ("from_lat", "src_lat", "origin_lat"), "from_lon": ("from_lon", "src_lon", "origin_lon"),
    "to_lat": ("to_lat", "dst_lat", "dest_lat"), "to_lon": ("to_lon", "dst_lon", "dest_lon"),
}


def find_coordinates(schema: T.StructType, given: dict[str, str | None]) -> list[str]:
    """The column of each coordinate role: the named one, else the first with one of its known names."""
    out = []
    for role, name in given.items():
        if name is not None and name not in schema.names:
            raise ValueError(f"map: no column {name!r}; columns: {', '.join(schema.names)}")
        found = name or next((c for c in schema.names if c.lower() in COORDINATES[role]), None)
        if found is None:
            raise ValueError(f"map: which column is {role}? columns: {', '.join(schema.names)}")
        out.append(found)
    return out
