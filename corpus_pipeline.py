"""A corpus pipeline: from the table documents to token ids in training order, in five stages.

Each stage gets all that its predecessor kept, as Parquet, and its decisions take effect. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyflow.llm import decontaminate, materialise, mixing, neardup, quality
from keyflow.llm.scratch import Scratch


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, trained on ``labels``: rejected documents go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on shingles of five words at a similarity of 0.8: the document with the smallest id stays."""
    return neardup.deduplicate(docs, width=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: passages of ``benchmark`` are cut out, documents that are mostly such passages go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: each row as often as the mix takes it."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in training order, a row for each sequence, as read back from the shards that hold them."""
    return materialise.training_order(docs, folder=Scratch(spark, "shards").root)


STAGES = [
    ("quality classifier", good_documents),
    ("MinHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed_sources),
    ("token-ID / binary output", token_ids),
]

#: The classifier and the tokenizer can't be expressed in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again by the next one."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(f"stage-{k}", stage(spark, docs, sf_dir))
        if k:
            scratch.drop(f"stage-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
