"""From raw documents to a training mix: five stages, each a table that the next one reads.

quality     documents that the quality classifier rejects go
lines       later occurrences of three-line windows go, and documents that lose every word with them
near        of each group of near-duplicate documents the one of smallest doc_id stays
benchmark   documents of which a twentieth or more is benchmark text go
mix         the sources are mixed to target weights; documents that the mix takes stay,
            with size, source_size, target and taken

Near-duplicates are judged on five-word shingles at a Jaccard similarity of 0.8.

Defined cases, beside those of the operators' docstrings: a null text is scored as the empty one by `quality`, stays null
in `lines` and `benchmark`, has no near copies, and is never in the mix, as it has no words; a document with a null id is scored and
mixed like any other, comes last in `lines` and stays in `near`. Rows equal in id and text are one document: they
lose the same lines, stay or go together in `near`, and are taken alike in `mix`. Rows that share an id and differ in text are judged by
their own texts. Of equal texts the smallest doc_id stays, whatever the order of rows. Empty tables give empty tables, and without labels
the classifier scores all documents alike, 0.5, and keeps them. Texts are read whole. Further columns pass through all
stages under any name, but for size, source_size, target and taken, which the last stage replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import decontaminate, jaccard_join, line_dedup, mixing, quality_classifier
from ledgerloom.store import discard, new_path, scope

#: Words of a shingle, and percent of Jaccard similarity, of near duplicates.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits the classifier on the documents' labels and keeps what scores the threshold or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep(docs, quality_classifier.fit(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated three-line windows; n_chars follows the text."""
    return line_dedup.deduplicate_lines(docs, length_col="n_chars" if "n_chars" in docs.columns else None, drop_emptied=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group."""
    return jaccard_join.keep_one(docs, ngram=NEAR_WORDS, percent=NEAR_PERCENT)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources and keeps the documents taken."""
    return mixing.mix(docs).where(F.col("taken") > 0)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("benchmark", benchmark), ("mix", mix)]

#: A discriminant fitted to data is beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written to the shared folder and read again.

    What a stage has written for itself is removed with the stage, and its table once the next one is there.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scope(spark, name):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        docs._stashed_at = path
        if before is not None:
            discard(before)
        before = docs
    return docs
