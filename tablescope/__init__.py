"""tablescope: a PySpark-native data-exploration layer.

Point it at any DataFrame and it answers the questions an analyst asks first:
faceted search, filtered paging, column statistics, a column-predicts-column
matrix, junk-column detection, time-series trend/outliers, display formats,
chart-ready tile shapes and event-log folds.  Every operator takes and returns
DataFrames built from native Spark expressions.
"""
from tablescope.operators.filters import Filter, build_predicate, normalize_contains  # noqa: F401

__version__ = "0.1.0"
