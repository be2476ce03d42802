"""The corpus pipeline: quality classifier, near duplicates, benchmark decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import decontaminate, jaccard_join, mixing, quality, token_output
from skylattice.llm.textops import stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects (score below 0.3)."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", most=8000)
    return quality.kept(docs, model, threshold=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group of near duplicates (five words, similarity 0.8)."""
    return jaccard_join.drop_duplicates(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least=5, coverage=0.8)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their target weights: repeated documents are repeated rows."""
    return mixing.mix_documents(docs, share=1.5, most=2)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids of every row and return the index of the stored shards."""
    import public_tokenizers

    shards = token_output.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_output.token_index(shards).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_to_targets),
    ("token_output", write_token_ids),
]

#: The classifier and the tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
