"""The training-data pipeline over ``documents``: each stage calls one
operator of ``martforge.llm`` on all that the stage before it kept. A stage
may be called alone: each applies the library's settings to its session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from martforge.llm import decontaminate, jaccard_join, mixing, quality_gam, token_files
from martforge.llm.queries import END_ID, VOCABULARY
from martforge.session import configure, materialise, release, scratch_path, ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    ship_package(configure(spark))
    return quality_gam.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of nearly equal five-word shingle sets."""
    ship_package(configure(spark))
    return jaccard_join.keep_first(docs, share=80, n=5)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    configure(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the target mix."""
    configure(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, as read back."""
    ship_package(configure(spark))
    folder = scratch_path(spark, "pipeline-tokens")
    token_files.write_tokens(docs, folder, VOCABULARY, END_ID)
    return token_files.digest(spark, folder)


STAGES = [("quality", quality), ("near_copies", near_copies), ("benchmark_free", benchmark_free), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's output is written and read again, and removed
    when the next one's is written."""
    configure(spark)
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier has no SQL form; tests hold the pipeline against plain code.
ORACLE_SQL = None
