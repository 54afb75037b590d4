"""Quality rules: measures of each text, and lines that too many documents of a host share.

A document fails on its own for too few words or too much repetition. Beyond
that, normalised lines (A-Z lower-cased, runs of white space one space) are hashed and
counted by the distinct documents of a host that hold them, copies of a text each on
their own. A line is above the limit if it is in more than `max_docs` documents of its host
and in more than `percent` of a hundred of them, so that the limit grows with the host; such lines are removed, and a
document that keeps less than the share `min_left` of its words is rejected as depleted.

Only hashes and counts are shuffled, combined first; the lines above the limit
are broadcast when they are few and joined by shuffle otherwise, and so are the sizes of hosts. No text moves.

Defined cases: a null text has no words and no lines, so it fails; an empty
text likewise; the null host is a host; a null doc_id is a document like any
other; rows equal in doc_id, host and text are one document and alike in every result; lines
without a word are no lines; long texts are handled whole, in time n log n.
Ids are whole numbers. Other columns pass through `clean` and are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.columns import whole_row
from ledgerloom.store import stash

#: A line in more documents of a host than this, and in more than so many of a hundred of them, goes.
MAX_DOCS, PERCENT = 5, 2
#: A document keeps at least this share of its words, or is rejected.
MIN_LEFT = 0.8
MIN_WORDS = 50
#: Frequent lines, or hosts, in one broadcast, at most (24 bytes each, and a host's name); more are joined by shuffle.
BROADCAST_LINES = 1_000_000

_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, _UPPER, _LOWER), _SPACE, " "))


def _runs(values: str, size: int) -> Column:
    """Of the array column `values`, the arrays of `size` elements in a row, as structs."""
    n = F.greatest(F.size(values) - (size - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(values, k + 1, n).alias(f"w{k}") for k in range(size)])


def _measures(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to rows with a column text that isn't null."""
    words = F.filter(F.split("text", _SPACE, -1), lambda w: w != "")
    lined = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(_WORD))
    out = docs.withColumns(
        {
            "_h": F.transform(words, lambda w: F.xxhash64(w)),
            "_lines": lined,
            "word_chars": F.length(F.translate("text", _SPACES, "")).cast("long"),
            "n_symbols": (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("long"),
        }
    )
    out = out.withColumns({"n_words": F.size("_h").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "_runs": _runs("_h", 3)})
    out = out.withColumn("_g", F.transform("_runs", lambda z: F.xxhash64(z["w0"], z["w1"], z["w2"]))).drop("_lines", "_runs", "_h")
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("p")))))).drop("_g")
    pairs = F.zip_with(F.slice("_s", 1, F.size("_s") - 1), F.slice("_s", 2, F.size("_s") - 1), lambda a, b: F.when(a["g"] == b["g"], F.array(a["p"], b["p"])))
    out = out.withColumn("_p", F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))).drop("_s")
    covered = F.array_distinct(F.flatten(F.transform("_p", lambda p: F.array(p, p + 1, p + 2))))
    return out.withColumn("n_repeat_words", F.when(F.col("_p").isNull(), 0).otherwise(F.size(covered)).cast("long")).drop("_p")


def _keys(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> list[Column]:
    return [F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.xxhash64(text_col).alias("t")]


def _host_sizes(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """host and size, its distinct documents."""
    return docs.select(*_keys(docs, id_col, text_col, host_col)).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("size"))


def frequent_lines(
    docs: DataFrame, *, max_docs: int = MAX_DOCS, percent: int = PERCENT, broadcast_lines: int = BROADCAST_LINES, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> tuple[DataFrame, DataFrame]:
    """(lines, frequent): every line with a word (doc_id, host, t, pos, words, k1, k2), and the keys k1, k2 of those above the limit."""
    read = docs.select(*_keys(docs, id_col, text_col, host_col), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    read = read.where(F.col("line").rlike(_WORD)).withColumn("line", _normalised(F.col("line")))
    marked = [F.col("host").isNull(), F.coalesce("host", F.lit("")), F.col("line")]
    lines = read.select("doc_id", "host", "t", "pos", F.regexp_count("line", F.lit(_WORD)).alias("words"), F.xxhash64(*marked).alias("k1"), F.xxhash64(F.lit(1), *marked).alias("k2"))
    counted = lines.select("k1", "k2", "host", "doc_id", "t").distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("docs"), F.any_value("host").alias("host"))
    counted = stash(counted.where(F.col("docs") > max_docs), "counted")
    sizes = stash(_host_sizes(docs, id_col, text_col, host_col), "hosts")
    few = sizes.count() <= broadcast_lines
    sizes = (F.broadcast(sizes) if few else sizes).withColumnRenamed("host", "name")
    above = counted.join(sizes, F.col("host").eqNullSafe(F.col("name"))).where(100 * F.col("docs") > percent * F.col("size"))
    return lines, stash(above.select("k1", "k2"), "lines")


def _gone(docs: DataFrame, max_docs: int, percent: int, broadcast_lines: int, **columns: str) -> DataFrame:
    """Per document that holds frequent lines: doc_id, host, t, and gone, the structs (pos, words) of these."""
    lines, frequent = frequent_lines(docs, max_docs=max_docs, percent=percent, broadcast_lines=broadcast_lines, **columns)
    few = frequent.count() <= broadcast_lines
    found = lines.join(F.broadcast(frequent) if few else frequent, ["k1", "k2"])
    return found.groupBy("doc_id", "host", "t").agg(F.collect_set(F.struct("pos", "words")).alias("gone"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.host").eqNullSafe(F.col(f"{b}.host")) & (F.col(f"{a}.t") == F.col(f"{b}.t"))


def _left_words() -> Column:
    return F.col("n_words") - F.coalesce(F.aggregate("gone", F.lit(0), lambda a, x: a + x["words"]), F.lit(0))


def judge(
    docs: DataFrame, *, max_docs: int = MAX_DOCS, percent: int = PERCENT, min_left: float = MIN_LEFT, broadcast_lines: int = BROADCAST_LINES,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """Per document: doc_id, the measures, base_failed, n_left (words outside of frequent lines) and kept."""
    gone = _gone(docs, max_docs, percent, broadcast_lines, id_col=id_col, text_col=text_col, host_col=host_col)
    read = docs.select(*_keys(docs, id_col, text_col, host_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = _measures(read).drop("text").alias("a").join(gone.alias("b"), _same("a", "b"), "left")
    measured = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = both.select("a.doc_id", *measured, failed.alias("base_failed"), _left_words().cast("long").alias("n_left"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_left") >= min_left * F.col("n_words")))


def clean(
    docs: DataFrame, *, max_docs: int = MAX_DOCS, percent: int = PERCENT, min_left: float = MIN_LEFT, broadcast_lines: int = BROADCAST_LINES,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """The documents that pass, without their frequent lines; all columns stay."""
    gone = _gone(docs, max_docs, percent, broadcast_lines, id_col=id_col, text_col=text_col, host_col=host_col)
    row = docs.select(whole_row(docs).alias("row"), *_keys(docs, id_col, text_col, host_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = _measures(row).alias("a").join(gone.alias("b"), _same("a", "b"), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passed = both.where(~failed & (_left_words() >= min_left * F.col("n_words"))).withColumn("l", F.when(F.col("gone").isNotNull(), F.split("text", "\n", -1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), F.transform("gone", lambda x: x["pos"]))
    text = F.when(F.col("gone").isNull(), F.col("row")[text_col]).otherwise(F.array_join(F.transform(left, lambda i: F.element_at("l", i + 1)), "\n"))
    return passed.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p : p + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
h AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, x) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 3)) AS q FROM h WHERE n > 1) GROUP BY doc_id),
a AS (SELECT doc_id, source, text, trim(regexp_replace(translate(unnest(l), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS x FROM d),
hosts AS (SELECT source AS host, count(*) AS size FROM documents GROUP BY source),
f AS (SELECT source, x FROM a JOIN hosts ON host IS NOT DISTINCT FROM source GROUP BY source, x HAVING count(DISTINCT doc_id) > 5 AND 100 * count(DISTINCT doc_id) > 2 * any_value(size)),
z AS (SELECT doc_id, sum(len(string_split(a.x, ' '))) AS gone FROM a JOIN f ON a.x = f.x AND a.source IS NOT DISTINCT FROM f.source GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(w) - coalesce(gone, 0) AS BIGINT) AS n_left FROM d LEFT JOIN r USING (doc_id) LEFT JOIN z USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_left, NOT base_failed AND n_left >= 0.8 * n_words AS kept FROM b
"""
