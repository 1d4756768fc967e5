"""The registry of column formats that users write (2.J7).

An entry gives a column of one table (or, with a null table, every column of that name in a
database) its format.  Writing an entry again replaces it and an empty format removes it; the
registry is a ``KeyedLog``, so a write costs its own entries and readers never see half of one.

Defined results: several entries of one key in one write: the greatest format by code points counts, so a
removal loses; removing what is not there changes nothing; an empty registry has no entries.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.sources.keyedlog import COMMIT, KeyedLog, latest

ENTRY = "db string, table string, column string, spec string"
KEY = ["db", "table", "column"]


class FormatRegistry:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, KeyedLog(spark, path, ENTRY)

    def write(self, entries: DataFrame) -> None:
        """Upsert all ``entries`` (db, table, column, spec) in one commit; a null or empty spec removes its entry."""
        self.log.append(entries.select(*KEY, F.coalesce("spec", F.lit("")).alias("spec")).groupBy(*KEY).agg(F.max("spec").alias("spec")))

    def set(self, db: str, column: str, spec: str, table: str | None = None) -> None:
        self.write(self.spark.createDataFrame([(db, table, column, spec)], ENTRY))

    def remove(self, db: str, column: str, table: str | None = None) -> None:
        self.set(db, column, "", table)

    def entries(self) -> DataFrame:
        """(db, table, column, spec, seq): the present entry of each key, as ``resolve_formats`` takes them."""
        return latest(self.log.rows(), KEY).where("spec <> ''").withColumnRenamed(COMMIT, "seq")

    def compact(self) -> None:
        """Keep the present entries only.  A removal is kept with them: it may be later than a commit still to be read."""
        self.log.compact(lambda rows: latest(rows, KEY))
