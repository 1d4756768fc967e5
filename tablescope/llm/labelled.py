"""Documents with a label column, without shuffling the documents while the labels are few."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: the label table is broadcast up to this many rows (16 bytes each); beyond it, an ordinary join
LABELS_BROADCAST_ROWS = 2_000_000


def with_label(docs: DataFrame, labels: DataFrame, label: Column, doc_id: str = "doc_id", how: str = "left",
               broadcast_rows: int = LABELS_BROADCAST_ROWS) -> DataFrame:
    """``docs`` (as struct ``row`` and ``text``-agnostic) with the integer column ``label``.

    Several labels of one id count as the greatest; null ids have no label.
    """
    known = labels.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("labelled_id"), label.cast("int").alias("label"))
    known = known.where(F.col("label").isNotNull()).groupBy("labelled_id").agg(F.max("label").alias("label"))
    if known.count() <= broadcast_rows:
        known = F.broadcast(known)
    return docs.join(known, docs[doc_id] == known["labelled_id"], how).drop("labelled_id")
