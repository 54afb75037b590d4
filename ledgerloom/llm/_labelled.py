"""Bounded samples of labelled rows, and the folds that labels are learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Labelled rows that a classifier is fitted on, at most.
MAX_ROWS = 20_000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null ids are in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, *, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id"
) -> DataFrame:
    """text, y (0 or 1) and an order, of at most max_rows labels that meet `learn` (a condition on the label's id).

    The ids are taken by their hash, so the sample is the same in every run; at
    most max_rows ids are broadcast. Rows that share an id are all in it, so
    readers limit what they collect by the order.
    """
    chosen = labels.where(learn & F.col(label).isin(0, 1)).select(F.col(label_id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return read.join(F.broadcast(chosen), "id").select("text", "y", F.xxhash64("id").alias("o1"), F.xxhash64("text").alias("o2"))
