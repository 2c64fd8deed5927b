"""The subpackage's registered queries and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql, url_query
from .common import crc_fold, fresh_path, read_table
from .language import LanguageParams, identify, learn_from
from .lattice import near_duplicate_vectors
from .mixing import mix
from .packing import pack
from .quality import quality_rules
from .records import read_token_records, write_token_records
from .simhash import simhash_groups
from .suffixes import remove_repeats
from .toxicity import ToxicityParams, fit_on, score_toxicity


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; rows with null or empty text get the score of no words, repeated rows a row each, no documents no rows."""
    docs, labels, params = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ToxicityParams()
    got = score_toxicity(docs, fit_on(docs, labels, params))
    return got.select("doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= params.threshold).cast("int").alias("predicted"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that 50-byte strings of documents with smaller ids cover, removed; null and empty texts have no bytes and the digest of nothing, rows without an id, or of equal ids, remove nothing from one another."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return remove_repeats(docs, length=50).select("doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components; null, empty and blank texts have the fingerprint zero, repeated rows link as equals, no documents no rows."""
    got = simhash_groups(read_table(spark, sf_dir, "documents"), width=3, radius=3)
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of one label; vectors that cannot have a cosine, and null labels, link with nothing and are their own component."""
    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.93)


#: Target weights of the sources, in parts; all others share one part of ten.
WEIGHTS = {"src0": 4.0, "src1": 3.0, "src2": 3.0, "src3": 3.0, "src4": 3.0, "src5": 2.0, "src6": 2.0, "src7": 2.0, "src8": 2.0, "src9": 2.0, "other": 10.0}
BLOCK_CHARS = 20_000
WINDOW_TOKENS = 2048


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents at their place in the mix; null and empty texts have no length, a null source counts as ``other``, texts of equal ids stand by length."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("bigint").alias("n_chars"))
    return mix(docs, WEIGHTS, BLOCK_CHARS, length=F.col("n_chars"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows; null and empty texts have the length of their end alone, texts longer than a window are split, equal pieces stand by id and cluster."""
    return pack(read_table(spark, sf_dir, "documents"), WINDOW_TOKENS, per_source=2)


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text as read back from the records; null and empty texts are an end id, no documents no records."""
    import public_tokenizers

    folder = fresh_path(spark, "token-records")
    shards = write_token_records(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end=1)
    return read_token_records(shards, folder)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every whole text; null and empty texts have no words and fail the base rule, without labels all that pass it are kept."""
    got = quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; null texts and those without a letter are ``und``, and so is every text where there was none to learn from."""
    docs = read_table(spark, sf_dir, "documents")
    got = identify(docs, learn_from(docs, LanguageParams()))
    return got.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": url_query.op1_url_filters,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_mixing": op6_mixing,
    "op7_token_records": op7_token_records,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": url_query.SQL,
    "op3_suffix_dedup": sql.SUFFIX_DEDUP,
    "op5_embedding_near_dedup": sql.EMBEDDING_NEAR_DEDUP,
    "op6_mixing": sql.mixing(WEIGHTS, BLOCK_CHARS),
}
