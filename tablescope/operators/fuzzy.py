"""Near-name matching (2.J10, re-aimed as a fuzzy join): for each query, the
closest vocabulary entry within Levenshtein distance 2, case-insensitive; ties
go to the earliest vocabulary entry.

Exact without comparing all pairs: two strings within distance k share a
string obtained by deleting at most k characters from each (symmetric-delete
neighbourhoods), so candidates meet by an equi-join on their deletion variants
and only those candidate pairs run ``levenshtein``.  Nothing is broadcast: the
vocabulary may grow with the data.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _drop_one(word: Column) -> Column:
    """Every text that lacks one character of ``word`` (none for an empty one)."""
    n = F.length(word)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                     lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))) \
        .otherwise(F.array().cast("array<string>"))


def deletion_variants(c: Column, k: int) -> Column:
    """The text itself and all texts that lack up to ``k`` of its characters, each once."""
    level = F.array(c)
    found = level
    for _ in range(k):
        level = F.array_distinct(F.flatten(F.transform(level, _drop_one)))
        found = F.array_union(found, level)
    return found


def closest_match(queries: DataFrame, qcol: str, vocab: DataFrame, vcol: str, order_col: str,
                  max_distance: int = 2) -> DataFrame:
    """(query, w, vorder, distance): best match per query (queries with no
    entry within ``max_distance`` are absent)."""
    k = max_distance
    q = queries.select(F.lower(F.col(qcol)).alias("query")).where(F.col("query").isNotNull()).distinct()
    v = vocab.select(F.lower(F.col(vcol)).alias("w"), F.col(order_col).alias("vorder")) \
        .groupBy("w").agg(F.min("vorder").alias("vorder"))
    qv = q.select("query", F.explode(deletion_variants(F.col("query"), k)).alias("key"))
    vv = v.select("w", "vorder", F.explode(deletion_variants(F.col("w"), k)).alias("key"))
    cand = qv.join(vv, "key").select("query", "w", "vorder").distinct()
    scored = cand.withColumn("distance", F.levenshtein("query", "w")).where(F.col("distance") <= k)
    best = scored.groupBy("query").agg(F.min(F.struct("distance", "vorder", "w")).alias("b"))
    return best.select("query", "b.w", "b.vorder", F.col("b.distance").cast("int").alias("distance"))
