"""A corpus pipeline of five stages over documents (doc_id, text, lang, source, n_chars).

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; run() writes each stage's output as
Parquet in the shared folder and reads it again. Every row is a document of its own, whatever its doc_id: rows without one, or that
share one, get keys of their own where a stage needs them. Other columns of documents come along, whatever their names. Empty documents
give an empty result, and so do null or empty texts: the first stage rejects them, as they have too few words.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrove.llm import bpe, minhash, mixing, quality, secrets
from sparkgrove.llm.common import cut, fresh, row_keys, table

RANKS = "byte_bpe_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the risk-controlled cutoffs reject."""
    rated = quality.rate(docs, table(spark, sf_dir, "labels"), carry=docs.columns)
    return rated.where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: the one with the least doc_id, null first; of rows that share a doc_id none comes before others."""
    (key,) = fresh(docs, "key")
    rows = row_keys(docs, key)
    first = minhash.near_duplicates(rows.select(key, "text"), key=key).where("is_first").select(key)
    return rows.join(first, key, "left_semi").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in the text replaced by a mark; n_chars follows the text."""
    (spans,) = fresh(docs, "spans")
    clean = secrets.redact(secrets.find_secrets(docs, spans=spans, ranks=secrets.corpus_ranks(docs)), spans=spans)
    return clean.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    key, copies, number = fresh(docs, "key", "copies", "number")
    rows = row_keys(docs, key)
    taken = mixing.mix(rows, key=key).select(key, F.col("copies").alias(copies)).where(F.col(copies) > 0)
    return rows.join(taken, key).withColumn(number, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids (packed), n_tokens, and whether decoding the ids gives the text again."""
    out = bpe.encode(docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text"), public_tokenizers.path(RANKS), decoded="decoded")
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: No SQL: consistent weighted sampling, guess costs, the cube method and BPE are beyond it; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
