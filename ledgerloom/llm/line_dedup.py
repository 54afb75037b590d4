"""Line deduplication over overlapping windows of three lines.

Each run of three consecutive lines with a word in it is hashed; windows found more than
once in the corpus stay where they occur first (smallest doc_id, then earliest
line) and go everywhere else: the lines that a later occurrence covers are
removed, and overlapping windows merge by covering the same positions. All
windows are judged on the input.

Counts are combined before the shuffle, and only windows that do repeat are
looked up again; a hot window costs one row per map task in the count, and its
occurrences are split by adaptive skew joins.

Defined cases: a null text stays null; a text of fewer than three lines has no
window; windows without a word are ignored; a row with a null doc_id comes
after all others; rows that share a doc_id are ordered by a hash of their text,
and rows equal in both are one document, alike in what they lose; long texts
are handled whole. Ids are whole numbers. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.columns import whole_row

LINES = 3
_WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(docs: DataFrame, id_col: str, text_col: str, lines: int) -> DataFrame:
    """h1, h2 (hashes of the window), doc (id and text hash) and pos (of its first line)."""
    held = docs.select(
        F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t")).alias("doc"),
        F.transform(_lines(F.col(text_col)), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), x.rlike(_WORD).alias("word"))).alias("l"),
    ).where(F.size("l") >= lines)
    runs = F.arrays_zip(*[F.slice("l", k + 1, F.size("l") - (lines - 1)).alias(f"l{k}") for k in range(lines)])

    def hashed(z: Column) -> Column:
        part = [z[f"l{k}"] for k in range(lines)]
        return F.struct(F.xxhash64(*[p["a"] for p in part]).alias("h1"), F.xxhash64(*[p["b"] for p in part]).alias("h2"), reduce(or_, [p["word"] for p in part]).alias("word"))

    named = F.transform(runs, lambda z: z.cast("struct<" + ",".join(f"l{k}:struct<a:bigint,b:bigint,word:boolean>" for k in range(lines)) + ">"))
    at = held.select("doc", F.posexplode(F.transform(named, hashed)).alias("pos", "w"))
    return at.where("w.word").select("w.h1", "w.h2", "doc", "pos")


def covered_lines(docs: DataFrame, *, lines: int = LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document that loses any: doc (struct of last, id and t, the hash of its text) and gone, the sorted positions of its removed lines."""
    rows = _windows(docs, id_col, text_col, lines)
    often = rows.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1")
    again = rows.join(often, "h1")
    first = again.groupBy("h1", "h2").agg(F.min(F.struct("doc", "pos")).alias("first"))
    later = again.join(first, ["h1", "h2"]).where(F.struct("doc", "pos") > F.col("first"))
    gone = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("pos"), F.col("pos") + lines - 1)))))
    return later.groupBy("doc").agg(gone.alias("gone"))


def deduplicate_lines(
    docs: DataFrame, *, lines: int = LINES, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
    drop_emptied: bool = False, count_col: str | None = None,
) -> DataFrame:
    """The documents without the lines of later occurrences; all columns stay.

    length_col, where named, is set to the new length of a changed text in characters.
    drop_emptied drops documents that lose every word that they had.
    count_col, where named, is added (or replaced): the number of removed lines.
    """
    gone = covered_lines(docs, lines=lines, id_col=id_col, text_col=text_col)
    gone = gone.select(F.col("doc.id").alias("id"), F.col("doc.t").alias("t"), "gone")
    row = docs.select(whole_row(docs).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"))
    both = row.alias("r").join(gone.alias("g"), F.col("r.id").eqNullSafe(F.col("g.id")) & (F.col("r.t") == F.col("g.t")), "left").select("row", "gone")
    both = both.withColumn("l", F.when(F.col("gone").isNotNull(), _lines(F.col("row")[text_col])))
    left = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), F.col("gone"))
    kept = F.when(F.size("l") > 0, F.array_join(F.transform(left, lambda i: F.element_at("l", i + 1)), "\n"))
    out = both.select("row", "gone", F.coalesce(kept, F.col("row")[text_col]).alias("text"))
    if drop_emptied:
        out = out.where(F.col("gone").isNull() | F.col("text").rlike(_WORD))
    changed = {text_col: F.col("text")}
    if length_col:
        changed[length_col] = F.when(F.col("gone").isNull(), F.col("row")[length_col]).otherwise(F.length("text").cast(docs.schema[length_col].dataType))
    added = [F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(count_col)] if count_col else []
    return out.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns if c != count_col], *added)


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, p, array_to_string(l[p : p + 2], chr(10)) AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM d WHERE len(l) >= 3)),
o AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS n FROM w WHERE regexp_matches(g, '[^\x20\x09-\x0D]')),
r AS (SELECT DISTINCT doc_id, unnest(range(p, p + 3)) AS q FROM o WHERE n > 1),
k AS (SELECT doc_id, string_agg(v, chr(10) ORDER BY i) AS kept FROM (SELECT doc_id, unnest(l) AS v, unnest(range(1, len(l) + 1)) AS i FROM d) AS e
      WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = e.doc_id AND r.q = e.i) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
