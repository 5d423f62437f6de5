"""A corpus pipeline of five operators: each stage takes all documents that the one before it kept.

quality classifier -> line dedup -> n-gram Jaccard join -> benchmark decontamination -> packing. All stages but the last
return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomfuse.llm.common import cut, release
from loomfuse.llm.decontaminate import drop_contaminated
from loomfuse.llm.jaccard_join import one_of_each
from loomfuse.llm.line_dedup import dedup_documents
from loomfuse.llm.packing import pack
from loomfuse.llm.quality_classifier import drop_rejected


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects (low quality or toxic) go."""
    return drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds leave the text; n_chars follows."""
    return dedup_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 80 % alike) stays, that with the smallest id."""
    return one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, in sequences of at most 4096 tokens."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("packing", packing)]

#: SQL can express neither the classifier nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's rows are deleted when the next one's are there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        done = cut(stage(spark, docs, sf_dir), "pipeline")
        release(docs)
        docs = done
    return docs
