"""The queries of this subpackage's operators: each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .tokens import tokenizer_path


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(_docs(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import dedup_substrings

    return dedup_substrings(_docs(spark, sf_dir), 13).drop("factors")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: their source and language stand for the directories above them."""
    from pyspark.sql import functions as F

    from .licenses import scan_licenses

    return scan_licenses(_docs(spark, sf_dir), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))).withColumn("similarity", F.round("similarity", 6))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    out = judge(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "anomaly", "kept")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_docs(spark, sf_dir), 4, 85, 100)


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .huffman import tokens_round_trip

    return tokens_round_trip(_docs(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), 1)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import dedup_bytes

    return dedup_bytes(_docs(spark, sf_dir), 200).drop("spans")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_docs(spark, sf_dir), [1.0] * 16)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    out = pack_documents(_docs(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), 0, 2048)
    return out.withColumn("length", out["length"].cast("long"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(_docs(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resample

    return resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 42, 20, (5, 100))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    return dedup_lines(_docs(spark, sf_dir), 20, 3)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_decontamination, op3_substring_dedup, op4_license_scan, op5_quality_rules, op6_jaccard_join, op7_token_output, op8_suffix_dedup, op9_sharding, op10_packing, op11_tokenizer_alignment, op12_importance_resampling, op13_line_dedup)}
ORACLE_SQL = {"op3_substring_dedup": oracles.SUBSTRINGS, "op4_license_scan": oracles.LICENSES, "op13_line_dedup": oracles.LINES}
