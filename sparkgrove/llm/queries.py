"""The thin opN queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, html, langid, minhash, mixing, quality, secrets, urls
from .common import cut, table

RANKS = "byte_bpe_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, public_tokenizers.path(RANKS), decoded="decoded")
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.learn(docs.where(~held))
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model, keep_text=False)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep_page=False)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    out = chat.linked(chat.calls_of(turns), chat.results_of(turns), spark.createDataFrame(chat.SCHEMAS, chat.SCHEMA_TYPE))
    return out.select("conv_id", "call_id", "depth", "n_results", "valid", "message", "arguments")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = cut(pages.select(urls.host_of(F.col("url")).alias("key")).distinct())
    return urls.judge(pages, urls.build(urls.listed_hosts(hosts), hosts)).drop("url")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, keep_text=False, ranks=secrets.corpus_ranks(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    strongest = F.array_max(F.transform("spans", lambda s: s["cost"]))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"), strongest.alias("max_guess_cost"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda key: key % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_language, op3_main_text, op4_mix, op5_chat, op6_near_dedup, op7_quality, op8_urls, op9_secrets, op10_neighbours)}
_LISTED = ", ".join(f"'{w}'" for w in urls.LISTED_WORDS)
_STEM = "split_part(split_part(substr(url, strpos(url, '://') + 3), '?', 1), '#', 1)"

ORACLE: dict[str, str] = {
    "op5_chat": """
        WITH u AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user'),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS rn FROM u),
        d AS (SELECT conv_id, turn, CAST(rn - min(rn) OVER (PARTITION BY conv_id, turn % 2, turn // 2 - rn) AS INTEGER) AS depth FROM r),
        a AS (SELECT conv_id, turn - 1 AS turn, count(*) AS n_results, min(text) AS content FROM conversations WHERE role = 'assistant' GROUP BY ALL)
        SELECT c.conv_id, 'call-' || c.turn AS call_id, depth, coalesce(n_results, 0) AS n_results, c.text IS NOT NULL AS valid,
          '{"call":{"arguments":{"length":"' || length(coalesce(c.text, '')) || '","text":' || coalesce(CAST(to_json(c.text) AS VARCHAR), 'null') || '},"id":"call-' || c.turn || '","name":"reply"},"depth":' || depth
          || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"valid":' || CASE WHEN c.text IS NULL THEN 'false' ELSE 'true' END || '}' AS message,
          '{"length":' || length(coalesce(c.text, '')) || ',"text":' || coalesce(CAST(to_json(c.text) AS VARCHAR), 'null') || '}' AS arguments
        FROM conversations c JOIN d USING (conv_id, turn) LEFT JOIN a USING (conv_id, turn) WHERE role = 'user'""",
    "op8_urls": f"""
        WITH h AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN split_part({_STEM}, '/', 1) ELSE '' END AS raw,
          CASE WHEN strpos(url, '://') > 0 THEN {_STEM} ELSE '' END AS stem FROM pages),
        p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(stem, length(raw) + 1) AS path FROM h),
        r AS (SELECT *, CASE WHEN '.' || host LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
            WHEN '.' || host LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
            WHEN '.' || host LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN '.' || host LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
            WHEN '.' || host LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN list_has_any(string_split(replace(host, '-', '.'), '.'), [{_LISTED}]) THEN 'block' ELSE 'allow' END AS verdict FROM r""",
}
