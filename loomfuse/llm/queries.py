"""The registered queries of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfuse.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfuse.llm.decontaminate import decontaminate

    found = decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfuse.llm.substring_dedup import substring_dedup

    return substring_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's WARC records against a replica that a fixed rule has damaged."""
    from loomfuse.llm.warc import audit, damaged, to_records

    pages = _read(spark, sf_dir, "pages")
    return audit(to_records(pages), to_records(damaged(pages)))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfuse.llm.lm_score import lm_score

    return lm_score(_read(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfuse.llm.jaccard_join import jaccard_components

    return jaccard_components(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfuse.llm.line_dedup import line_dedup

    return line_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfuse.llm.secret_scan import fit, labelled_findings, scan

    return scan(_read(spark, sf_dir, "documents"), fit(labelled_findings()))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfuse.llm.quality_rules import quality_rules

    return quality_rules(_read(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfuse.llm.quality_classifier import classify

    return classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfuse.llm.token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfuse.llm.whitening import whiten

    return whiten(_read(spark, sf_dir, "embeddings"), id_col="vec_id", vector="embedding")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in all documents, of which a fixed rule makes every tenth periodic from some word on."""
    from loomfuse.llm.periodic_runs import periodic_runs

    return periodic_runs(_read(spark, sf_dir, "documents"), planted=True)


QUERIES = {f.__name__: f for f in (op1_packing, op2_decontaminate, op3_substring_dedup, op4_warc_audit, op5_lm_score, op6_jaccard_join, op7_line_dedup, op8_secret_scan, op9_quality_rules, op10_quality_classifier, op11_token_counts, op12_embedding_whitening, op13_periodic_runs)}
