"""The corpus pipeline: documents in, a deduplicated and mixed training corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
documents; the last adds each copy's number and its place in the global order. All
stages use the production parameters of their operators. SQL can't express MinHash
bands, union-find and SimHash, so there is no oracle; tests hold the stages against
brute force on small tables.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arterial.llm import decontamination, line_dedup, mixing, ngram_join, quality_rules
from arterial.storage import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others, the lines that are frequent in their host go."""
    return _sized(quality_rules.without_frequent_lines(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component of near-duplicate lines stays; documents that lose all their words go."""
    cut = line_dedup.dedup_lines(docs)
    return _sized(cut.where("n_lines = 0 or n_removed < n_lines").select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word shingle sets with a similarity of 0.8 stays."""
    return ngram_join.one_per_component(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are replicated to the sources' target weights and shuffled globally."""
    return mixing.mix_sources(docs)


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, as the cut texts have it."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
