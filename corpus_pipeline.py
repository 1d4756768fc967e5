"""The corpus pipeline: raw documents to token ids, in five written stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet
to the shared checkpoint folder and reads it again as the next stage's documents, so a
lost executor costs at most the stage at hand.  All but the last stage return the columns
of ``documents``.

Defined results: null and empty texts are neither toxic nor contaminated and have no near copies
(null ones) or are copies of one another (empty ones), and hold no secret; they end with null and
empty id lists.  Of equal or near rows the one with the least id stays (of equal ids any one, a null id
only if there is no other).  Rows with a null id are scored and kept like others.  Extra columns pass through; an
input column named like a result of the last stage gives way to it.  An empty table goes through all
stages and gives an empty table.  Without the corpus subpackage this module cannot be imported.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablescope.llm import dartminhash, decontaminate, piecewise, secretscan, skew, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    scored = toxicity.score_toxicity(docs, _table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the least id."""
    return dartminhash.deduplicate(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves; their texts stay as they are."""
    found = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.contaminated()).select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every found secret replaced by a mark; n_chars follows the new text."""
    found = secretscan.scan_secrets(docs)
    text, length = F.coalesce("redacted", F.col("row")["text"]), F.char_length("redacted").cast("long")
    new = {"text": text, "n_chars": F.when(F.col("redacted").isNull(), F.col("row")["n_chars"]).otherwise(length)}
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document with seeded merge-dropout, checked to decode to its text."""
    made = {"piece_ids": F.col("piece_ids"), "n_pieces": F.size("piece_ids").cast("long"), "lossless": F.col("lossless")}
    keep = [c for c in docs.columns if c != "text" and c not in made]
    found = piecewise.encode_pieces(docs, piecewise.piece_model(), keep=keep)
    return found.select(*[F.col("row")[c].alias(c) for c in keep], *[v.alias(c) for c, v in made.items()])


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("secrets", redact_secrets), ("sentencepiece", encode)]

#: scores of trained models and hashed signatures have no SQL; tests/llm holds the pipeline against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = skew.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
