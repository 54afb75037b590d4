"""The queries op1 to op13: thin readings of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import (
    _labelled, decontaminate, divergence_audit, importance, jaccard_join, license_scan, line_dedup, lm_scoring, mixing, quality_classifier, quality_rules, substring_dedup, toxicity, url_templates,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(hits)


def _predicted(scores: DataFrame, folds: int, held: int, threshold: float) -> DataFrame:
    held_out = F.coalesce(_labelled.fold(F.col("doc_id"), folds) == held, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, _table(spark, sf_dir, "labels"))
    return _predicted(quality_classifier.score(docs, model), quality_classifier.LEARN_FOLDS, 0, quality_classifier.THRESHOLD)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(_table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), carry=False).drop("source")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"))


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op6: its exact columns, the base score to three digits."""
    return op6_lm_scoring(spark, sf_dir).withColumn("base_score", F.round("base_score", 3)).drop("score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return _predicted(toxicity.score(docs, model), toxicity.LEARN_FOLDS, toxicity.HELD_FOLD, toxicity.THRESHOLD)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.deduplicate_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_removed")
    return kept.select("doc_id", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(_table(spark, sf_dir, "documents")))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(_table(spark, sf_dir, "pages"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.audit(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_mixing": op5_mixing,
        "op6_lm_scoring": op6_lm_scoring,
        "lm_base_scores": lm_base_scores,
        "op7_quality_rules": op7_quality_rules,
        "op8_toxicity": op8_toxicity,
        "op9_line_dedup": op9_line_dedup,
        "op10_license_scan": op10_license_scan,
        "op11_url_filters": op11_url_filters,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_divergence_audit": op13_divergence_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.ORACLE,
        "op3_substring_dedup": substring_dedup.ORACLE,
        "op4_jaccard_join": jaccard_join.ORACLE,
        "op5_mixing": mixing.ORACLE,
        "lm_base_scores": lm_scoring.ORACLE_BASE,
        "op7_quality_rules": quality_rules.ORACLE,
        "op9_line_dedup": line_dedup.ORACLE,
        "op10_license_scan": license_scan.ORACLE,
        "op11_url_filters": url_templates.ORACLE,
        "op12_importance_resampling": importance.ORACLE,
        "op13_divergence_audit": divergence_audit.ORACLE,
    }
