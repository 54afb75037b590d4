"""Resampling towards a target distribution by importance weights on hashed features.

The features of a text are its words and pairs of consecutive words, hashed into buckets. The documents become a
sparse matrix of documents by buckets, written once as CSR blocks: ids, the start of each row, and the buckets and
counts of its cells. Column sums of this matrix and of the target's give both distributions, and a bucket's gain is
the logarithm of their ratio. A product of the matrix with the gains gives the weights, Gumbel noise from a hash of the id
turns these into scores, and the highest scores are the sample, without replacement.

Blocks hold about a megabyte of text, a longer text is a block of its own. What crosses the driver are the sums by bucket. Ranks
come from a count by score: the documents above each score, and an order within one; so no task sorts all of them. Scores are whole
thousandths of logarithms and the noise has 32 bits, so there are some ten thousands of them at any size.

Defined cases: a null or empty text has no features, weight 0 and never enough words; a null id draws the noise of
the empty one and comes last among equals; rows that tie in score and id are ordered by a hash of their text; repeated
rows are documents of their own; an empty target gives smoothed gains; no rows give no rows. Ids are
whole numbers. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.columns import named
from ledgerloom.llm import _text as T
from ledgerloom.store import discard, stash

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = "7"
#: Gains and noise are whole multiples of one part of this.
PRECISION = 1000
#: Words longer than this are hashed one by one.
LONG_WORD = 32
#: Scores that are broadcast, at most (24 bytes each); more are joined by shuffle.
BROADCAST_SCORES = 500_000

BLOCK = "ids array<bigint>, ties array<bigint>, starts array<int>, buckets binary, counts binary"
_BLOCK = pa.schema([("ids", pa.list_(pa.int64())), ("ties", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("buckets", pa.binary()), ("counts", pa.binary())])
_SUMS = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
_WEIGHED = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _extended(state: np.ndarray, words: T.Words, which: np.ndarray) -> np.ndarray:
    """The CRC states after the bytes of these words."""
    size = words.end[which] - words.start[which]
    order = np.argsort(-size, kind="stable")
    start, size, out = words.start[which][order], size[order], state[order]
    long = int(np.searchsorted(-size, -LONG_WORD, "left"))
    for k in range(long):
        out[k] = zlib.crc32(words.data[start[k] : start[k] + size[k]].tobytes(), int(out[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for k in range(int(size[long]) if long < len(size) else 0):
        to = int(np.searchsorted(-size, -k, "left"))
        own = out[long:to]
        out[long:to] = _CRC[(own ^ words.data[start[long:to] + k]) & 255] ^ (own >> 8)
    back = np.empty_like(out)
    back[order] = out
    return back


def feature_buckets(words: T.Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each word and each pair of consecutive words of a text."""
    n, row = len(words.hashes), words.text_of
    one = _extended(np.full(n, 0xFFFFFFFF, np.uint32), words, np.arange(n))
    left = np.flatnonzero(row[:-1] == row[1:])
    spaced = _CRC[(one[left] ^ np.uint32(32)) & 255] ^ (one[left] >> 8)
    two = _extended(spaced, words, left + 1)
    crc = np.concatenate((one, two)) ^ np.uint32(0xFFFFFFFF)
    return np.concatenate((row, row[left])), (crc % np.uint32(buckets)).astype(np.int64)


def csr_blocks(docs: DataFrame, *, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The matrix of documents by buckets in blocks of rows; buckets are little-endian numbers of two bytes (four if there are more than 65,536), counts of four."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, raw, offsets in T.pieces(batch.column(2)):
                words = T.split(raw, offsets, T.NOT_ALNUM, lower=True)
                row, bucket = feature_buckets(words, buckets)
                cell, times = np.unique(row * buckets + bucket, return_counts=True)
                starts = np.searchsorted(cell, np.arange(to - at + 1) * buckets).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column(0).slice(at, to - at).to_pylist()], _BLOCK.field("ids").type), pa.array([batch.column(1).slice(at, to - at).to_pylist()], _BLOCK.field("ties").type),
                    pa.array([starts], _BLOCK.field("starts").type), pa.array([(cell % buckets).astype(kind).tobytes()], pa.binary()), pa.array([times.astype("<u4").tobytes()], pa.binary()),
                ], schema=_BLOCK)

    text = named(text_col).cast("string")
    return docs.select(named(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(built, BLOCK)


def _cells(batch: pa.RecordBatch, buckets: int) -> Iterator[tuple[pa.Scalar, pa.Scalar, np.ndarray, np.ndarray, np.ndarray]]:
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    for ids, ties, starts, bucket, counts in zip(*batch.columns, strict=True):
        yield ids, ties, starts.values.to_numpy(), np.frombuffer(bucket.as_buffer(), kind), np.frombuffer(counts.as_buffer(), "<u4")


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, its sum over all rows; each task sums its own blocks first."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, bucket, counts in _cells(batch, buckets):
                total += np.bincount(bucket, counts, buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], schema=_SUMS)

    return blocks.mapInArrow(summed, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Of each bucket the floored logarithm, in parts of PRECISION, of its smoothed share of the target over that of the source."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = ((target.get(k, 0) + 1.0) * s_all / ((source.get(k, 0) + 1.0) * t_all) for k in range(buckets))
    return np.array([math.floor(PRECISION * math.log(x)) for x in ratio], np.int64)


def weights(blocks: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, tie, n_features and weight, the floored mean gain of the features: the matrix times the gains, block by block."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, ties, starts, bucket, counts in _cells(batch, len(gains)):
                gained, number = (np.concatenate(([0], np.cumsum(x))) for x in (gains[bucket] * counts, counts.astype(np.int64)))
                g, n = (x[starts[1:]] - x[starts[:-1]] for x in (gained, number))
                yield pa.RecordBatch.from_arrays([ids.values, ties.values, pa.array(n), pa.array(g // np.maximum(n, 1))], schema=_WEIGHED)

    return blocks.mapInArrow(weighed, "doc_id bigint, tie bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """Floored Gumbel noise in parts of PRECISION, from a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-float(PRECISION) * F.ln(-F.ln(uniform))).cast("bigint")


def resample(
    docs: DataFrame, target: DataFrame, *, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank, the last null unless it is drawn.

    Of the documents with min_words words or more, that percentage (floored) of highest scores is drawn, ties to smaller ids.
    """
    blocks = stash(csr_blocks(docs, buckets=buckets, id_col=id_col, text_col=text_col), "csr")
    goal = csr_blocks(target.select(F.lit(None).cast("bigint").alias("id"), named(target_text_col).alias("text")), buckets=buckets, id_col="id")
    source_sums, target_sums = ({r.bucket: r.n for r in column_sums(b, buckets).collect()} for b in (blocks, goal))
    weighed = weights(blocks, bucket_gains(source_sums, target_sums, buckets))
    enough = (F.col("n_features") + 1) / 2 >= min_words  # n words have 2 n - 1 features
    scored = stash(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("enough", enough), "scored")
    discard(blocks)

    number = scored.where("enough").groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = number.withColumn("above", above).withColumn("drawn", F.expr(f"sum(n) over () * {int(percent)} div 100"))
    number = stash(number.where("above < drawn").select("score", "above", "drawn", F.lit(True).alias("enough")), "above")
    few = F.broadcast if number.count() <= BROADCAST_SCORES else lambda x: x
    rows = scored.join(few(number), ["score", "enough"], "left")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "tie")
    high = rows.where("above is not null").withColumn("rank", F.col("above") + F.row_number().over(order))
    high = high.withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return high.select(*columns).unionByName(rows.where("above is null").withColumn("rank", F.lit(None).cast("bigint")).select(*columns))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
a AS (SELECT r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM (SELECT r, text FROM d UNION ALL SELECT -1, text FROM benchmark)),
f AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x FROM a),
h AS (SELECT x, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * octet_length(encode(x))), lambda i: get_bit(encode(x)::BIT, CAST(i // 8 * 8 + 7 - i % 8 AS INTEGER))::BIGINT)),
      lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))) AS c FROM (SELECT DISTINCT x FROM f)),
e AS (SELECT r, xor(c, 4294967295::BIGINT) % 10000 AS b, count(*) AS n FROM f JOIN h USING (x) GROUP BY r, b),
t AS (SELECT b, coalesce(sum(n) FILTER (r >= 0), 0) AS s, coalesce(sum(n) FILTER (r < 0), 0) AS t FROM e GROUP BY b),
g AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM t) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM t) + 10000)::DOUBLE))) AS g FROM t),
m AS (SELECT r, sum(n) AS n, sum(n * g) AS g FROM e JOIN g USING (b) WHERE r >= 0 GROUP BY r),
s AS (SELECT d.r, doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(g / n), 0) AS BIGINT) AS weight,
      CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS noise FROM d LEFT JOIN m USING (r)),
o AS (SELECT *, weight + noise AS score, n_features >= 39 AS enough FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) AS i, sum(CAST(enough AS BIGINT)) OVER () * 25 // 100 AS most FROM o)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN enough AND i <= most THEN i END AS BIGINT) AS rank FROM k
"""
