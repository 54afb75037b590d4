"""LM scoring with a log-frequency Bloom filter.

The n-grams of the training documents, up to three words, are counted in the
tasks, sent to segments by their hash and written into a Bloom filter: an
n-gram of count c is entered once for each level 1 to 1 + floor(log2 c), so
probing the levels in turn, until one is missing, gives its quantised count. A
segment holds about SEGMENT_GRAMS n-grams whatever the corpus: their number follows
the number of training tokens. Segments are broadcast in shards of about
`shard_bytes`, one pass over the documents each, so a worker's memory stays bounded
while the filter grows with the corpus. A pass that isn't the only one writes the
levels it found, one compressed byte a token and order, and no text.

Every count in the model's score is the filter's, at any size of the corpus: a token
w after the n-gram h has the probability (c(hw) + a P(w)) / (c(h) + a), P being that
of the next shorter history and at last the add-one unigram; a is PRIOR c(h)^POWER + 1
for one word of history and LONG_PRIOR for more.

The base score is exact: counts of frequent words (at most `frequent`) are
broadcast, and other words are joined with the word counts by a shuffle, which gives the same.

Defined cases: a null text is empty and has the end token alone; a document
with a null id is learned from and isn't held out; rows that share id and text
are scored alike; without training documents every count is 0 and every token has probability 1;
ids are whole numbers; texts are read whole; extra columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.llm import _labelled, _text as X
from ledgerloom.store import discard, stash

FOLDS, HELD_FOLD = 7, 2
#: Words of the longest n-grams.
ORDER = 3
#: Probes at the first level, which tells seen from unseen, for n-grams of one or two words and for longer ones, and at the other levels.
#: A longer n-gram counts only where its parts are found too, so fewer probes do.
PROBES = (6, 4, 3)
#: Counted n-grams of a segment, on average, at most.
SEGMENT_GRAMS = 1 << 20
#: Bytes of the filter broadcast at once, about (or one segment).
SHARD_BYTES = 128 << 20
#: Words whose exact counts are broadcast for the base score, at most (16 bytes each).
FREQUENT = 1_000_000
PRIOR, POWER, LONG_PRIOR = 4.0, 0.75, 20.0
#: Texts are handled in chunks of about so many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19
#: Tokens that a task counts before it sends the counts on.
FLUSH = 500_000
#: Bits of a hash that tell n-grams of one segment apart.
REST_BITS = 40

_U = np.uint64
END, BEGIN = _U(0x6E0F1D2C3B4A5968), _U(0x1234FEDC5678BA90)


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, token hashes with an end after each text, bounds) of chunks of texts."""
    for a, _, raw, offsets in X.pieces(column, CHUNK_BYTES):
        words = X.split(raw, offsets, X.SPACES, lower=True)
        bounds = words.first + np.arange(len(words.counts) + 1)
        token = np.full(bounds[-1], END, np.uint64)
        token[np.arange(len(words.hashes)) + words.text_of] = words.hashes
        yield a, token, bounds


def grams(token: np.ndarray, bounds: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """For one word to `order` words, the hash of the n-gram that ends at each token; texts begin with as many marks as it takes.

    The lowest bit of a hash tells n-grams of three words and more.
    """
    out, place = [token], np.arange(len(token)) - np.repeat(bounds[:-1], np.diff(bounds))
    for back in range(1, order):
        earlier = np.full(len(token), BEGIN, np.uint64)
        earlier[back:] = token[:-back]
        earlier[place < back] = BEGIN
        out.append(X.mix(earlier * _U(0x9E3779B97F4A7C15) + out[-1] + _U(back)))
    return [_marked(h, back > 1) for back, h in enumerate(out)]


def _marked(h: np.ndarray, long: bool) -> np.ndarray:
    return (h & ~_U(1)) | _U(long)


def _combined(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h, c = np.unique(np.concatenate(held), return_counts=True)
    return h, c.astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h and c of the words, combined over FLUSH tokens."""
    held, size = [], 0
    for batch in batches:
        for _, token, _ in _tokens(batch.column(0)):
            held.append(token)
            size += len(token)
            if size >= FLUSH:
                h, c = _combined(held)
                yield pa.record_batch([X.signed(h), c], names=["h", "c"])
                held, size = [], 0
    if held:
        h, c = _combined(held)
        yield pa.record_batch([X.signed(h), c], names=["h", "c"])


def _segment(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> _U(64 - bits)).astype(np.int64)


def _rest(h: np.ndarray, bits: int) -> np.ndarray:
    return _marked((h << _U(bits)) >> _U(64 - REST_BITS), False) | (h & _U(1))


def _bytes(values: np.ndarray, width: int, cuts: np.ndarray) -> pa.Array:
    """The values between the cuts as binaries, `width` bytes each."""
    data = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), 8)[:, :width])
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(data)])


def _packed(h: np.ndarray, c: np.ndarray, bits: int) -> pa.RecordBatch:
    """One row per segment of sorted distinct hashes with counts: what tells them apart in the segment, and the counts."""
    segment = _segment(h, bits)
    first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    cuts = np.concatenate((first, [len(h)]))
    return pa.record_batch([segment[first], _bytes(_rest(h, bits), REST_BITS // 8, cuts), _bytes(c, 8, cuts)], names=["segment", "rest", "counts"])


def _unpacked(rest) -> np.ndarray:
    raw = np.frombuffer(rest, np.uint8).reshape(-1, REST_BITS // 8)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : REST_BITS // 8] = raw
    return out.view(np.uint64).ravel()


_PACKED = "segment bigint, rest binary, counts binary"


def _count_grams(bits: int, order: int):
    """Packed counts of the n-grams of two words and more, combined over FLUSH tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, token, bounds in _tokens(batch.column(0)):
                held += grams(token, bounds, order)[1:]
                size += len(token)
                if size >= FLUSH:
                    yield _packed(*_combined(held), bits)
                    held, size = [], 0
        if held:
            yield _packed(*_combined(held), bits)

    return run


def _pack_words(bits: int):
    """Packed counts of rows h and c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c = _marked(X.unsigned(batch.column(0).to_numpy()), False), batch.column(1).to_numpy()
            order = np.argsort(h)
            if len(h):
                yield _packed(h[order], c[order], bits)

    return run


def levels(c: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c)."""
    return np.frexp(c.astype(float))[1].astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The least count of a level, 0 for level 0."""
    return np.where(level > 0, 2.0 ** (level - 1.0), 0.0)


def _probes(rest: np.ndarray, level: int) -> np.ndarray:
    """Number of probes of each n-gram at the level."""
    return np.where(rest & _U(1) == 1, PROBES[1], PROBES[0]) if level == 1 else np.full(len(rest), PROBES[2])


def _places(rest: np.ndarray, level: int, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each probe, whether an n-gram has it, and its place in a segment of so many bits."""
    x, step = (X.mix(rest + _U(0xA24BAED4963EE407 * k % (1 << 64))) for k in (2 * level, 2 * level + 1))
    step |= _U(1)
    probes = _probes(rest, level)
    for i in range(int(probes.max(initial=0))):
        yield probes > i, (((x >> _U(32)) * bits) >> _U(32)).astype(np.int64)
        x = x + step


def build_segment(rest: np.ndarray, c: np.ndarray) -> bytes:
    """The filter of these distinct n-grams, sized by its entries so that about half of its bits are set."""
    level = levels(c)
    tops = [rest[level >= j] for j in range(1, int(level.max(initial=0)) + 1)]
    entries = sum(int(_probes(own, j).sum()) for j, own in enumerate(tops, 1))
    bits = -(-int(entries / np.log(2) + 1) // 64) * 64
    out = np.zeros(bits, bool)
    for j, own in enumerate(tops, 1):
        for has, at in _places(own, j, _U(bits)):
            out[at[has]] = True
    return np.packbits(out, bitorder="little").tobytes()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter segments of packed rows sorted by segment; one segment is held at a time."""
    at, held = None, []

    def done() -> pa.RecordBatch:
        rest, c = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(rest)
        rest, c = rest[order], c[order]
        new = np.flatnonzero(np.concatenate(([True], rest[1:] != rest[:-1])))
        return pa.record_batch([pa.array([at], pa.int64()), pa.array([build_segment(rest[new], np.add.reduceat(c, new))], pa.binary())], names=["segment", "bits"])

    for batch in batches:
        rest, counts = batch.column(1), batch.column(2)
        for i, segment in enumerate(batch.column(0).to_pylist()):
            if segment != at and held:
                yield done()
                held = []
            at = segment
            held.append((_unpacked(rest[i].as_buffer()), np.frombuffer(counts[i].as_buffer(), np.int64)))
    if held:
        yield done()


class Filter:
    """The segments from `low` on, in one array; `level` answers 0 for n-grams of segments that aren't there."""

    def __init__(self, bits: int, low: int, sizes: np.ndarray, data: np.ndarray):
        self.segment_bits, self.low, self.data = bits, low, data
        self.size = (sizes * 8).astype(np.uint64)
        self.base = (np.concatenate(([0], np.cumsum(sizes)[:-1])) * 8).astype(np.int64) if len(sizes) else sizes.astype(np.int64)

    @classmethod
    def of(cls, bits: int, low: int, high: int, segments: Iterator[tuple[int, bytes]], room: int) -> Filter:
        """From (segment, bytes) in order of segments; `room` is the sum of their bytes."""
        sizes, data, at = np.zeros(high - low, np.int64), np.zeros(room, np.uint8), 0
        for segment, own in segments:
            data[at : at + len(own)] = np.frombuffer(own, np.uint8)
            sizes[segment - low], at = len(own), at + len(own)
        return cls(bits, low, sizes, data)

    def level(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.uint8)
        segment = _segment(h, self.segment_bits) - self.low
        live = np.flatnonzero((segment >= 0) & (segment < len(self.size)))
        live = live[self.size[segment[live]] > 0]
        rest, base, size, j = _rest(h[live], self.segment_bits), self.base[segment[live]], self.size[segment[live]], 1
        while len(live):
            there = np.ones(len(live), bool)
            for has, at in _places(rest, j, size):
                at += base
                there &= ((np.take(self.data, at >> 3) >> (at & 7).astype(np.uint8)) & 1 == 1) | ~has
            live, rest, base, size = live[there], rest[there], base[there], size[there]
            out[live] = j
            j += 1
        return out


class Counts:
    """Exact counts of the frequent words, and the totals of all."""

    def __init__(self, h: np.ndarray, c: np.ndarray, tokens: int, words: int, begins: float):
        order, self.begins = np.argsort(h), begins
        self.h, self.c, self.tokens, self.words = h[order], c[order], tokens, words

    @property
    def whole(self) -> float:
        """What a count and one is divided by."""
        return float(self.tokens + self.words + 1)

    def of(self, h: np.ndarray) -> np.ndarray:
        """Counts, -1 for words that aren't frequent."""
        if not len(self.h):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.c[at], -1)


def _sum_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, bounds[:-1])  # every text has an end token


def log_probabilities(found: list[np.ndarray], bounds: np.ndarray, counts: Counts) -> np.ndarray:
    """log10 probability of each token; found: the levels of the n-grams of one word, two words and so on that end there."""
    c = [count_of(x.astype(np.int64)) for x in found]
    p = (c[0] + 1) / counts.whole
    for shorter, longer in zip(c[:-1], c[1:], strict=True):
        history = np.empty_like(shorter)
        history[1:] = shorter[:-1]
        history[bounds[:-1]] = counts.begins
        prior = PRIOR * history**POWER + 1 if shorter is c[0] else LONG_PRIOR
        both = np.minimum(longer, np.minimum(shorter, history))  # neither part of an n-gram is rarer than it
        p = (both + prior * p) / (history + prior)
    return np.log10(p)


def _levels_of(own: list[np.ndarray], shard: Filter) -> list[np.ndarray]:
    """Levels of the n-grams by order; words, which repeat, are probed once each."""
    word, where = np.unique(own[0], return_inverse=True)
    return [shard.level(word)[where], *(shard.level(h) for h in own[1:])]


_ROWS = "doc_id bigint, t bigint, main boolean, h bigint, tf bigint, n_tokens bigint, n_known bigint, base double, score double"
_NAMES = [x.split(" ")[0] for x in _ROWS.split(", ")]


def _row(ids: pa.Array, t: pa.Array, **columns) -> pa.RecordBatch:
    kinds = {"main": pa.bool_(), "base": pa.float64(), "score": pa.float64()}
    columns |= {"doc_id": ids, "t": t}
    return pa.record_batch([columns[n] if n in columns else pa.nulls(len(ids), kinds.get(n, pa.int64())) for n in _NAMES], names=_NAMES)


def _base(batch: pa.RecordBatch, a: int, token: np.ndarray, bounds: np.ndarray, counts: Counts, score: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """A main row per text with its exact measures, and a row per text and word that isn't frequent."""
    n = len(bounds) - 1
    word, where = np.unique(token, return_inverse=True)
    c = counts.of(word)[where]
    known = np.where(c >= 0, np.log10((np.maximum(c, 0) + 1) / counts.whole), 0.0)
    ids, t = batch.column(0).slice(a, n), batch.column(1).slice(a, n)
    given = {} if score is None else {"score": pa.array(score)}
    yield _row(ids, t, main=pa.array(np.ones(n, bool)), h=t, n_tokens=pa.array(np.diff(bounds)), n_known=pa.array(_sum_by((c > 0).astype(np.int64), bounds)), base=pa.array(_sum_by(known, bounds)), **given)
    rare = np.flatnonzero(c < 0)
    row = np.searchsorted(bounds, rare, "right") - 1
    order = np.lexsort((token[rare], row))
    row, h = row[order], token[rare][order]
    new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.zeros(0, int)
    tf, at = np.diff(np.concatenate((new, [len(h)]))), pa.array(row[new])
    yield _row(ids.take(at), t.take(at), main=pa.array(np.zeros(len(new), bool)), h=pa.array(X.signed(h[new])), tf=pa.array(tf, pa.int64()))


def _judge(counts, bloom, order: int):
    """The one pass where the filter is one shard; columns doc_id, t and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, token, bounds in _tokens(batch.column(2)):
                found = _levels_of(grams(token, bounds, order), bloom.value)
                yield from _base(batch, a, token, bounds, counts.value, _sum_by(log_probabilities(found, bounds, counts.value), bounds))

    return run


def _measure(counts):
    """The pass for the base scores alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, token, bounds in _tokens(batch.column(2)):
                yield from _base(batch, a, token, bounds, counts.value, None)

    return run


_FOUND = "doc_id bigint, t bigint, shard int, levels binary"


def _probe(bloom, shard: int, order: int):
    """The levels found in one of several shards, by order and token, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, token, bounds in _tokens(batch.column(2)):
                found, n = np.stack(_levels_of(grams(token, bounds, order), bloom.value)), len(bounds) - 1
                parts = [zlib.compress(found[:, x:y].tobytes(), 1) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.record_batch([batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array([shard] * n, pa.int32()), pa.array(parts, pa.binary())], names=["doc_id", "t", "shard", "levels"])

    return run


def _merge(counts, order: int):
    """Scores of rows doc_id, t and parts, structs with the levels found in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for parts in batch.column(2):
                found = np.maximum.reduce([np.frombuffer(zlib.decompress(x["levels"].as_buffer()), np.uint8).reshape(order, -1) for x in parts.values])
                scores.append(float(log_probabilities(list(found), np.array([0, found.shape[1]]), counts.value).sum()))
            yield _row(batch.column(0), batch.column(1), main=pa.array([False] * len(batch), pa.bool_()), h=batch.column(1), score=pa.array(scores, pa.float64()))

    return run


def _frequent(vocabulary: DataFrame, most: int) -> Counts:
    """The counts of the words from the least power of two on that leaves at most `most`."""
    rows = vocabulary.groupBy(F.floor(F.log2(F.col("c") + F.lit(0.5))).cast("int").alias("j")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect()
    tokens, words = sum(r.c for r in rows), sum(r.n for r in rows)
    least = max((r.j + 1 for r in rows if sum(x.n for x in rows if x.j >= r.j) > most), default=0)
    table = vocabulary.where(F.col("c") >= 2**least).toArrow()
    ends = vocabulary.where(F.col("h") == int(X.signed(np.array([END]))[0])).first()
    # texts begin as often as they end
    return Counts(X.unsigned(table.column("h").to_numpy()), table.column("c").to_numpy(), tokens, words, float(ends.c) if ends else 0.0)


def segment_bits(tokens: int, order: int, segment_grams: int) -> int:
    """Bits of a hash that name its segment: one of so many that a segment counts segment_grams n-grams at most, on average."""
    return max(1, ceil(log2(max(1, tokens * order) / segment_grams))) if tokens * order > segment_grams else 1


def build(train: DataFrame, vocabulary: DataFrame, bits: int, order: int = ORDER) -> DataFrame:
    """segment and bits: the filter of the n-grams of train(text) and of the words with their counts."""
    packed = train.mapInArrow(_count_grams(bits, order), _PACKED).unionByName(vocabulary.select("h", "c").mapInArrow(_pack_words(bits), _PACKED))
    return packed.repartition(max(1, (1 << bits) // 4), "segment").sortWithinPartitions("segment").mapInArrow(_segments, "segment bigint, bits binary")


def _shard(spark: SparkSession, filters: DataFrame, bits: int, low: int, high: int):
    """The segments from low to high - 1, read one file after the other, as a broadcast."""
    own = filters.where(F.col("segment").between(low, high - 1))
    room = own.agg(F.sum(F.length("bits"))).first()[0] or 0
    return spark.sparkContext.broadcast(Filter.of(bits, low, high, ((r.segment, bytes(r.bits)) for r in own.orderBy("segment").toLocalIterator()), int(room)))


def score(
    docs: DataFrame, *, held_out: Column | None = None, order: int = ORDER, frequent: int = FREQUENT, shard_bytes: int = SHARD_BYTES,
    segment_grams: int = SEGMENT_GRAMS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability of the text).

    `held_out` is a condition on doc_id; documents that meet it are not learned from.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(_labelled.fold(F.col("doc_id"), FOLDS) == HELD_FOLD if held_out is None else held_out, F.lit(False))
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    train = read.where(~held_out).select("text")
    vocabulary = stash(train.mapInArrow(_count_words, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")), "words")
    counts = _frequent(vocabulary, frequent)
    bits = segment_bits(counts.tokens, order, segment_grams)
    filters = stash(build(train, vocabulary, bits, order), "filter")
    held = spark.sparkContext.broadcast(counts)
    rows = read.select("doc_id", F.xxhash64("text").alias("t"), "text")
    total = filters.agg(F.sum(F.length("bits"))).first()[0] or 0
    step = -(-(1 << bits) // max(1, -(-total // shard_bytes)))
    ranges = [(low, min(low + step, 1 << bits)) for low in range(0, 1 << bits, step)]
    if len(ranges) == 1:
        rows = rows.mapInArrow(_judge(held, _shard(spark, filters, bits, *ranges[0]), order), _ROWS)
    else:
        passes = []
        for number, (low, high) in enumerate(ranges):
            bloom = _shard(spark, filters, bits, low, high)
            passes.append(stash(rows.mapInArrow(_probe(bloom, number, order), _FOUND), "levels"))
            bloom.destroy()
        found = passes[0]
        for other in passes[1:]:
            found = found.unionByName(other)
        # equal rows have equal levels, so a set has one part of each shard
        parts = found.groupBy("doc_id", "t").agg(F.collect_set(F.struct("shard", "levels")).alias("parts"))
        scored = stash(parts.mapInArrow(_merge(held, order), _ROWS), "scored")
        discard(filters, *passes)
        rows = rows.mapInArrow(_measure(held), _ROWS).unionByName(scored)
    joined = rows.join(vocabulary.select(F.col("h").alias("w"), "c"), F.col("h") == F.col("w"), "left")
    c = F.coalesce("c", F.lit(0))
    main, rare = F.col("main"), F.col("tf").isNotNull()
    summed = joined.groupBy("doc_id", "t").agg(
        F.sum(F.when(main, 1)).alias("rows"),
        F.max("n_tokens").alias("n_tokens"),
        F.max("n_known").alias("known"),
        F.sum(F.when(rare & (c > 0), F.col("tf"))).alias("rare"),
        F.max("base").alias("base"),
        F.sum(F.when(rare, F.col("tf") * F.log10((c + 1) / F.lit(counts.whole)))).alias("rare_base"),
        F.max("score").alias("score"),
    )
    out = summed.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("known") + (F.coalesce("rare", F.lit(0)) / F.col("rows"))).cast("long").alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        F.round(F.col("base") + F.coalesce("rare_base", F.lit(0.0)) / F.col("rows"), 6).alias("base_score"),
        F.round("score", 6).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_row"),
    )
    return out.drop("_row")


ORACLE_BASE = r"""
WITH k AS (SELECT n, list_reduce(list_concat([n], range(8)), lambda a, i: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) AS b(n)),
tab AS (SELECT list(v ORDER BY n) AS tab FROM k),
f AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
      lambda a, ch: xor(a >> 8, tab[(xor(a, ch) & 255) + 1])), 4294967295) % 7 = 2 AS held_out FROM documents, tab),
d AS (SELECT doc_id, held_out, list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' ') AS w FROM documents JOIN f USING (doc_id)),
s AS (SELECT doc_id, held_out, unnest(w) AS x FROM d),
c AS (SELECT x, count(*) AS c FROM s WHERE NOT held_out GROUP BY x),
n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1)::DOUBLE / (n + v + 1))), 3) AS base_score
FROM s LEFT JOIN c USING (x), n GROUP BY doc_id
"""
