"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, line_dedup, media, mixing, pair_sql, periodic, quality, secrets, token_output, toxicity, turn_repair
from .jaccard_join import jaccard_join
from .substring_dedup import substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shards = token_output.write_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_output.token_index(shards).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_documents(spark, sf_dir), least=5)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_documents(spark, sf_dir)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"), threshold=0.5, most=20000)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"), least=5, coverage=0.8).drop("row")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"), threshold=0.3, most=8000)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_documents(spark, sf_dir))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_documents(spark, sf_dir), share=1.5, most=2).select("doc_id", "size", "source_size", "target", "taken")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_documents(spark, sf_dir), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_documents(spark, sf_dir), window=13).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return turn_repair.repair_report(turn_repair.damaged(turns), turns)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(periodic.with_planted_runs(_documents(spark, sf_dir)), least=24, power=3)


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_output,
        op2_line_dedup,
        op3_media_columns,
        op4_toxicity,
        op5_decontamination,
        op6_quality,
        op7_secret_scan,
        op8_mix_sources,
        op9_jaccard_join,
        op10_substring_dedup,
        op11_conversation_repair,
        op12_periodic_runs,
        op13_bpe_round_trip,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "op7_secret_scan": secrets.ORACLE_SQL,
    "op8_mix_sources": mixing.ORACLE_SQL,
    "op9_jaccard_join": pair_sql.JACCARD,
    "op10_substring_dedup": pair_sql.SUBSTRINGS,
    "op12_periodic_runs": periodic.ORACLE_SQL,
}
