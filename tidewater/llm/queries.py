"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm import decontaminate, exact_dedup, language_id, mixing, quality, sharding, simhash, suffix_dedup, token_store, url_filter

#: The rules that op6 judges pages by.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def tokens_of(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs with the public word-end tokenizer (or the JSON file at the path given) and reads the files back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    segments = token_store.write(docs, Tokenizer.from_file(tokenizer).to_str())
    return token_store.read(segments).withColumnRenamed("id", "doc_id")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(_read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.repeated_passages(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), "n_words", F.col("other").alias("other_doc_id"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language_id.train(language_id.training_texts(docs.where(~language_id.held_out(F.col("doc_id")))))
    out = language_id.identify(docs, model, keep=["doc_id"])
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge(_read(spark, sf_dir, "pages"), URL_RULES)
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "ratio")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.fit(docs.where(~language_id.held_out(F.col("doc_id"))), _read(spark, sf_dir, "labels"))
    out = quality.score(docs, model)
    return out.select(F.col("id").alias("doc_id"), language_id.held_out(F.col("id")).alias("held_out"), "score", "predicted")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contained(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "item_id", "shared", "item_size", F.round("containment", 6).alias("containment"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shards(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_token_output, op3_suffix_dedup, op4_language_id, op5_mixing, op6_url_filter, op7_exact_dedup, op8_quality, op9_decontamination, op10_sharding)}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_exact_dedup": """
            WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
            FROM d WINDOW w AS (PARTITION BY text_sha256)""",
        "op9_decontamination": """
            WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
            iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
            isz AS (SELECT item_id, least(5, len(w)) AS k, w FROM iw WHERE len(w) > 0),
            s AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM isz)),
            n AS (SELECT item_id, count(*) AS item_size FROM s GROUP BY item_id),
            ks AS (SELECT DISTINCT k FROM s),
            ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k))
            SELECT doc_id, item_id, shared, item_size, round(shared / item_size, 6) AS containment
            FROM (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN s USING (k, g) GROUP BY doc_id, item_id) JOIN n USING (item_id)
            WHERE shared / item_size >= 0.8""",
    }
