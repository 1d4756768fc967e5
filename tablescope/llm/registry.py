"""The registered queries of this subpackage: each operator over its whole table, and the pipeline."""
from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablescope.llm import (bloomlm, dartminhash, decontaminate, htmlextract, piecewise, quality, secretscan, sharding, skew, spelling,
                            tokenalign, tokencounts, toxicity, urlfilter)

#: the rules of the url query (host, path prefix, verdict)
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
             ("net", "/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages, URL_RULES).select("row.page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
fits AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS nth
  FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE nth = 1
"""


def decontaminated_digest(found: DataFrame) -> DataFrame:
    """The digest columns of a decontamination result."""
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminated_digest(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"]))


_WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = f"""
WITH doc_words AS (SELECT doc_id, coalesce({_WORDS.format(text='text')}, []) AS w FROM documents),
item_words AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce({_WORDS.format(text='text')}, []) AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, w[i:i + least(len(w), 13) - 1] AS run
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM item_words WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS run
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, d.n, i, item FROM doc_windows d JOIN item_windows t ON d.n = t.n AND d.run = t.run),
hit AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class (the least doc_id of it) and the class's size."""
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmlextract.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secretscan.BASE_KINDS))
    return found.select("row.doc_id", *[count(k) for k in secretscan.BASE_KINDS], F.sha2(secretscan.span_text(base), 256).alias("base_sha256"),
                        secretscan.span_text(F.col("spans")).alias("spans"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge_quality(docs, table(spark, sf_dir, "labels"), keep=["doc_id"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = piecewise.encode_pieces(docs, piecewise.piece_model(), keep=["doc_id"])
    return found.select("row.doc_id", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), "lossless")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), keep=["doc_id"]).select(
        "row.doc_id", "held_out", "score", "predicted", "n_words", "mean_ratio", "excess")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after three batches over all documents, each
    offered again: all documents inserted; those whose text tidying changes revised to the
    tidied text's count under the next tokenizer version; exact copies (all but the least id) deleted."""
    make = tokencounts.bpe_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ledger = tokencounts.count_ledger(table(spark, sf_dir, "documents"), make, "byte_bpe_50k")
    first, second = F.lit("byte_bpe_50k/1"), F.lit("byte_bpe_50k/2")
    keys = ["source", "lang"]
    load = ledger.select(*keys, first.alias("tokenizer"), F.lit("insert").alias("kind"), "tokens")
    tidied = ledger.where("tidied_tokens is not null")
    revised = tokencounts.revision_of(tidied.select(*keys, first.alias("tokenizer"), "tokens"),
                                      tidied.select(*keys, second.alias("tokenizer"), F.col("tidied_tokens").alias("tokens")))
    least = skew.cut(ledger.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    copies = skew.hot_join(ledger.where("digest is not null"), least, "digest").where("doc_id <> least")
    current = F.when(F.col("tidied_tokens").isNull(), first).otherwise(second).alias("tokenizer")
    deleted = copies.select(*keys, current, F.lit("delete").alias("kind"), F.coalesce("tidied_tokens", "tokens").alias("tokens"))
    rollup = tokencounts.Rollup(spark)
    for _ in range(2):  # the second round offers every batch again
        for batch, events in (("load", load), ("tidy", revised), ("copies", deleted)):
            rollup.commit(batch, events)
    return rollup.totals()


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    found = tokenalign.align_tokens(docs, tokenalign.byte_bpe_file(), piecewise.piece_model(), keep=["doc_id"], derive={"groups_sha256": digest})
    return found.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bloomlm.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_decontamination, op3_near_duplicates, op4_html_text, op5_secret_scan, op6_quality,
                            op7_sentencepiece, op8_toxicity, op9_sharding, op10_token_counts, op11_token_alignment, op12_spelling_variants, op13_lm_score)} | {"pipeline": corpus_pipeline.run}
ORACLE = {"op1_url_filter": OP1_SQL, "op2_decontamination": OP2_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
