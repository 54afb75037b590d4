"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key E / w, E exponential and drawn from a hash of its
id, w its quality weight; ascending keys are a weighted sample without
replacement of any size. A source's target in words buys complete epochs over
all of its documents first; the rest is the prefix of the key order whose words
come nearest to what is left.

What the fraction takes is thus all documents of a source up to one place of its
key order, the cut, and a document is judged by its own key alone. Keys fall into buckets that follow
the key order; sums over sources and buckets tell the bucket of each cut, and only the rows of these buckets, without
texts, are sorted. Sizes and keys are written once; texts are never shuffled.

Defined cases: a null or empty text has size 0, costs nothing and is taken 0
words; the null source comes last and is a source like any other; a null doc_id
draws its key from the empty text; rows that tie in key and doc_id are ordered
by a hash of their text, and rows equal in id, source and text are taken together or not at
all; no rows give no rows. An input column named as a result
column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.columns import whole_row
from ledgerloom.store import stash

WEIGHTS = (5, 2, 1)
#: Most that a source gives, as a multiple of its size.
MAX_EPOCHS = 3
#: Slices of a source's key order; the one with the cut is sorted by one task.
BUCKETS = 1024
#: Sources whose cuts are broadcast, at most (100 bytes each, and a name); more are joined by shuffle.
BROADCAST_SOURCES = 100_000
SEED = "mix"

_DIGITS = 13
_SPACES = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than space and tab to carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """From 0.1 to 1: the share of a text's characters that are neither ASCII punctuation nor digits."""
    plain = F.length(F.translate(text, "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~", ""))
    return F.greatest(F.lit(0.1), F.coalesce(plain / F.nullif(F.length(text), F.lit(0)), F.lit(0.1)))


def sampling_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """An exponential variate of rate `weight`, the same in every run."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    uniform = (F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") + 0.5) / float(16**_DIGITS)
    return -F.ln(uniform) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """Targets of the sources in sizes(source, source_size): shares by weight, none above cap times its size.

    In order of size over weight the sources that reach the cap come first; the
    others share what these leave. One row per source, so one window is enough.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int")))
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    shared = weighed.withColumn("_left", left).withColumn("_weight", weight_left)
    fits = F.col("_left") * F.col("weight") <= cap * F.col("source_size") * F.col("_weight")
    shared = shared.withColumn("_first", F.min(F.when(fits, F.struct((F.col("source_size") / F.col("weight")).alias("r"), F.col("source").isNull().alias("n"), F.col("source").alias("s"), "_left", "_weight"))).over(whole))
    own = F.struct((F.col("source_size") / F.col("weight")).alias("r"), F.col("source").isNull().alias("n"), F.col("source").alias("s"))
    first = F.struct(F.col("_first.r"), F.col("_first.n"), F.col("_first.s"))
    target = F.when(F.col("_first").isNotNull() & (own >= first), F.col("_first._left") / F.col("_first._weight") * F.col("weight")).otherwise((cap * F.col("source_size")).cast("double"))
    return shared.select("source", "source_size", target.alias("target"))


def _cuts(rows: DataFrame, weights: tuple[int, ...], cap: int, buckets: int) -> DataFrame:
    """Per source: target, epochs, and the cut: the documents below cut_bucket, and in it those up to cut_at, are taken once more.

    rows: source, size and at (the place in the key order: key, then doc_id, null last, then tie), and bucket.
    """
    summed = stash(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    aimed = targets(summed.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    epochs = F.coalesce(F.least(F.lit(cap), F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))), F.lit(0)).cast("long")
    aimed = stash(aimed.withColumn("epochs", epochs).withColumn("rest", F.when(F.col("epochs") < cap, F.col("target") - F.col("epochs") * F.col("source_size"))), "targets")
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = summed.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).withColumnRenamed("source", "_source")
    plan = starts.join(aimed, F.col("_source").eqNullSafe(F.col("source")))
    cut = plan.where((F.col("ahead") <= F.col("rest")) & (F.col("ahead") + F.col("words") > F.col("rest"))).select("_source", F.col("bucket").alias("cut_bucket"), "ahead", "rest")
    cut = stash(cut, "cuts")
    own = rows.join(F.broadcast(cut) if cut.count() <= BROADCAST_SOURCES else cut, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("cut_bucket")))
    own = own.groupBy("_source", "at").agg(F.sum("size").alias("size"), F.any_value("ahead").alias("ahead"), F.any_value("rest").alias("rest"))
    within = F.coalesce(F.sum("size").over(Window.partitionBy("_source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = own.withColumn("within", within).where(F.col("ahead") + F.col("within") + F.col("size") / 2 <= F.col("rest"))
    last = fits.groupBy(F.col("_source").alias("_s")).agg(F.max("at").alias("cut_at"))
    cut = cut.select("_source", "cut_bucket").join(last, F.col("_source").eqNullSafe(F.col("_s")), "left").select("_source", "cut_bucket", "cut_at")
    return stash(aimed.join(cut, F.col("source").eqNullSafe(F.col("_source")), "left").select(F.col("source").alias("_source"), "source_size", "target", "epochs", "rest", "cut_bucket", "cut_at"), "plan")


def mix(
    docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_EPOCHS, buckets: int = BUCKETS, seed: str = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, carry: bool = True,
) -> DataFrame:
    """The documents with size, source_size, target (of the source) and taken (words of the document in the mix).

    `quality` is a positive weight by document, quality_weight of the text unless given.
    carry=False returns doc_id and source beside these columns.
    """
    weight = quality_weight(F.col(text_col)) if quality is None else quality
    key = sampling_key(F.col(id_col), weight, seed)
    place = F.struct(F.col("key"), F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("tie"))

    def placed(*more: Column) -> DataFrame:
        rows = docs.select(*more, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("tie"), key.alias("key"))
        return rows.withColumn("at", place).withColumn("bucket", F.floor(buckets * (1 - F.exp(-F.col("key")))).cast("int"))

    rows = stash(placed().select("doc_id", "source", "size", "at", "bucket"), "sizes")
    plan = _cuts(rows, weights, cap, buckets)
    few = plan.count() <= BROADCAST_SOURCES
    # with texts, sizes and keys are computed again where the text is: that is cheaper than to shuffle it
    rows = placed(whole_row(docs).alias("row")) if carry else rows
    both = rows.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("_source")))
    below = F.col("cut_bucket").isNull() | (F.col("bucket") < F.col("cut_bucket")) | ((F.col("bucket") == F.col("cut_bucket")) & F.coalesce(F.col("at") <= F.col("cut_at"), F.lit(False)))
    taken = F.col("size") * (F.col("epochs") + F.when(F.col("rest").isNotNull() & below, 1).otherwise(0))
    both = both.withColumn("taken", taken.cast("long"))
    added = ["size", "source_size", "target", "taken"]
    if not carry:
        return both.select("doc_id", "source", *added)
    return both.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *added)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    greatest(0.1::DOUBLE, coalesce(length(translate(text, '!"#$%&''()*+,-./0123456789:;<=>?@[\]^_`{|}~', ''))::DOUBLE / nullif(length(text), 0), 0.1::DOUBLE)) AS w,
    (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)) AS weight FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source ASC NULLS LAST) AS i FROM s),
l AS (SELECT a.i, any_value(a.source_size) AS size, any_value(a.weight) AS weight,
      (SELECT sum(source_size) FROM r) - 3 * coalesce(sum(b.source_size), 0) AS rest, (SELECT sum(weight) FROM r) - coalesce(sum(b.weight), 0) AS weights
      FROM r a LEFT JOIN r b ON b.i < a.i GROUP BY a.i),
f AS (SELECT i, rest, weights FROM l WHERE rest * weight <= 3 * size * weights ORDER BY i LIMIT 1),
t AS (SELECT r.source, r.source_size, CASE WHEN r.i >= f.i THEN f.rest::DOUBLE / f.weights * r.weight ELSE 3.0 * r.source_size END::DOUBLE AS target FROM r LEFT JOIN f ON true),
o AS (SELECT doc_id, size, source_size, target, coalesce(least(3, floor(target / nullif(source_size, 0))), 0)::BIGINT AS epochs,
      coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / w, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN epochs < 3 AND ahead + size::DOUBLE / 2 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""
