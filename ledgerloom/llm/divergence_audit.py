"""Divergence of sources by joint count histograms.

Each language keeps the terms that enough of its documents have. A group (language and source) gives every kept
term a smoothed share of its occurrences; two groups differ by the sum of the differences of these shares.

The sum is not taken term by term. For each pair of sources of a language the histogram of (count here, count there)
says how many terms have which two counts, and the difference is evaluated once per combination and multiplied by
the number of its terms. Only terms that both have are joined. The cells with a zero follow from what is known
already: of the terms that occur c times here, those that the join doesn't find have zero there, and what is left
of the kept terms has zero on both sides. These cells are added up with signs, so no pair lists terms that it lacks.

Terms are counted in Arrow batches, by language, source and term before any shuffle; from then on groups and terms
are numbers. A common term is one row a group; a hot combination is combined before its shuffle.
Counts, shares and sums are whole numbers; shares are divided as decimals, so no size overflows.

Defined cases: null text, language and source are empty ones, and these are a text, a language and a source like any other; a row
is a document, so repeated rows count each; a group without terms, and a language that keeps none, have all
their pairs with value 0 or what the smoothing gives; a language of one source has no pairs; no rows give no rows.
Ties are ranked by the item's bytes. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.columns import named
from ledgerloom.llm import _text as T
from ledgerloom.store import discard, stash

MIN_DOCS = 30
TOP_TERMS = 50
SMOOTHING = 5
SCALE = 1_000_000_000
#: Texts are counted in pieces of about this many bytes; a longer text is one of its own.
PIECE_BYTES = 8 << 20
#: Groups that are broadcast, at most (about 100 bytes each); more are joined by shuffle.
BROADCAST_GROUPS = 100_000

#: True for every ASCII byte but letters.
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[0x41:0x5B] = NOT_LETTERS[0x61:0x7B] = NOT_LETTERS[0x80:] = False
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("c", pa.int64()), ("d", pa.int64())])


def _strings(words: T.Words, which: np.ndarray) -> pa.Array:
    """The words at these places."""
    start, size = words.start[which], words.end[which] - words.start[which]
    offsets = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    data = pa.py_buffer(np.ascontiguousarray(words.data[at]))
    return pa.Array.from_buffers(pa.large_string(), len(which), [None, pa.py_buffer(offsets.astype(np.int64)), data]).cast(pa.string())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each group, piece by piece."""
    for batch in batches:
        lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
        sources = max(1, len(source.dictionary))
        group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * sources + source.indices.to_numpy(zero_copy_only=False)
        for at, to, raw, offsets in T.pieces(batch.column(2), PIECE_BYTES):
            words = T.split(raw, offsets, NOT_LETTERS, lower=True)
            if not len(words.hashes):
                continue
            _, first, term = np.unique(words.hashes, return_index=True, return_inverse=True)
            own, times = np.unique(words.text_of * len(first) + term, return_counts=True)
            cell, where = np.unique(group[at:to][own // len(first)] * len(first) + own % len(first), return_inverse=True)
            c, d = np.bincount(where, times), np.bincount(where)
            whose, which = cell // len(first), cell % len(first)
            columns = [lang.dictionary.take(pa.array(whose // sources)), source.dictionary.take(pa.array(whose % sources)), _strings(words, first).take(pa.array(which))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(c.astype(np.int64)), pa.array(d)], schema=_COUNTED)


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, c (occurrences) and d (documents with the term)."""
    text = [F.coalesce(named(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    counted = docs.select(*text).mapInArrow(_counted, "lang string, source string, term string, c bigint, d bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def _share(c: str, n: str, v: str, smoothing: int) -> Column:
    """1 + floor(SCALE * (c + smoothing) / (n + smoothing * v)), exact."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({c} + {smoothing} as decimal(20, 0))) div cast({n} + {smoothing} * {v} as decimal(20, 0))")


def histograms(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Joint histograms: a and b (groups of one language, a < b), ca and cb (counts), m (terms with these counts, over 0).

    cells: g, t, c (group, term and count over 0); groups: g, lang and v (the language's kept terms).
    """
    a, b = (cells.select(F.col("g").alias(k), "t", F.col("c").alias(f"c{k}")) for k in "ab")
    found = stash(a.join(b, "t").where("a < b").groupBy("a", "b", "ca", "cb").agg(F.count(F.lit(1)).alias("m")), "joint")
    pairs = groups.select("lang", F.col("g").alias("a"), "v").join(groups.select("lang", F.col("g").alias("b")), "lang").where("a < b")
    alone = stash(cells.groupBy("g", "c").agg(F.count(F.lit(1)).alias("m")), "alone")

    def signed(rows: DataFrame, *cells: tuple[str, str, str]) -> DataFrame:
        parts = F.array(*[F.struct(F.expr(ca).cast("bigint").alias("ca"), F.expr(cb).cast("bigint").alias("cb"), F.expr(m).cast("bigint").alias("m")) for ca, cb, m in cells])
        return rows.select("a", "b", F.explode(parts).alias("x")).select("a", "b", "x.*")

    here = pairs.select("a", "b").join(alone.withColumnRenamed("g", "a"), "a")
    there = pairs.select("a", "b").join(alone.withColumnRenamed("g", "b"), "b")
    rows = signed(found, ("ca", "cb", "m"), ("ca", "0", "-m"), ("0", "cb", "-m"), ("0", "0", "m"))
    rows = rows.unionByName(signed(here, ("c", "0", "m"), ("0", "0", "-m"))).unionByName(signed(there, ("0", "c", "m"), ("0", "0", "-m")))
    rows = rows.unionByName(signed(pairs, ("0", "0", "v")))
    return rows.groupBy("a", "b", "ca", "cb").agg(F.sum("m").alias("m")).where("m > 0")


def audit(
    docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, smoothing: int = SMOOTHING,
    text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """lang, source, part, item, value and rank.

    Part `pair`: item is another source of the language, value the sum of differences of shares over its kept terms.
    Part `term`: item is a term that the group has and gives a larger share than its language, value the difference; at most `top` a group.
    """
    counts = stash(term_counts(docs, text_col=text_col, lang_col=lang_col, source_col=source_col), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("c").alias("lang_c")).where(F.col("d") >= min_docs)
    kept = stash(kept.select("lang", "term", "lang_c", F.monotonically_increasing_id().alias("t")), "kept")
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_c").alias("lang_n"))
    sources = docs.select(*[F.coalesce(named(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    sources = stash(sources.select("lang", "source", F.monotonically_increasing_id().alias("g")), "names")
    few = F.broadcast if sources.count() <= BROADCAST_GROUPS else lambda x: x
    cells = stash(counts.select("lang", "source", "term", "c").join(kept.select("lang", "term", "t"), ["lang", "term"]).join(few(sources), ["lang", "source"]).select("g", "t", "c"), "cells")
    discard(counts)
    groups = sources.join(few(cells.groupBy("g").agg(F.sum("c").alias("n"))), "g", "left").join(few(of_lang), "lang", "left")
    groups = stash(groups.select("g", "lang", "source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n", "v", "lang_n")]), "groups")

    a, b = (few(groups.select(F.col("g").alias(k), F.col("n").alias(f"n{k}"), *["v"] * (k == "a"))) for k in "ab")
    told = histograms(cells, groups).join(a, "a").join(b, "b")
    f = F.abs(_share("ca", "na", "v", smoothing) - _share("cb", "nb", "v", smoothing))
    told = stash(told.groupBy("a", "b").agg(F.sum(f * F.col("m")).alias("value")), "differences")
    both = told.select(F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("b").alias("other"), "value"), F.struct(F.col("b").alias("g"), F.col("a").alias("other"), "value"))).alias("x")).select("x.*")
    pairs = groups.select("g", "lang", "source").join(groups.select("lang", F.col("g").alias("other"), F.col("source").alias("item")), "lang").where("g != other")
    pairs = pairs.join(both, ["g", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    shares = cells.join(kept.select("t", "term", "lang_c"), "t").join(few(groups), "g")
    shares = shares.select("lang", "source", "term", (_share("c", "n", "v", smoothing) - _share("lang_c", "lang_n", "v", smoothing)).alias("value")).where("value > 0")
    terms = shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
o AS (SELECT lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT e.lang, e.source, coalesce(sum(o.c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) AS e LEFT JOIN o USING (lang, source) GROUP BY e.lang, e.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(o.c, 0) + 5)) // (g.n + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.c + 5)) // (l.n + 5 * l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u
QUALIFY part = 'pair' OR rank <= 50
"""
