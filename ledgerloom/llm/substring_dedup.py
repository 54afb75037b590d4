"""Substring deduplication by level-wise doubling.

A passage of `target` words that occurs in two documents holds, at the same
place in both, a repeated passage of half that length. So windows of the
shortest level are compared first, thinned to the least hash of each stretch
(a choice that depends on content alone and is made in every window of twice
the length); only where such a window occurs in two different texts are the
windows of twice the length compared, thinned likewise, and so on, until no candidates survive
or the target is reached, at which all windows around the candidates are compared.

Equal texts are one class, compared through the row of smallest doc_id; in
every other row of the class each window also starts in that smaller document.

Candidates are named by 64 bits, and windows of the target by 128. Counts are combined before each shuffle, and joins on hot
windows are left to adaptive skew splitting; no group is collected.

Defined cases: a null text has no words; a text with fewer words than a window
loses none; a row with a null doc_id has no order among documents, so it loses
nothing and takes nothing from others; rows that share a doc_id are the same
document, so nothing is removed between them; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerloom.llm import _text as X
from ledgerloom.store import stash

TARGET = 50
#: Words of the shortest windows, about.
START = 13


def levels(target: int, start: int) -> list[int]:
    """Window lengths from start or a little less, each at most twice the one before, to the target."""
    out = [target]
    while out[0] > start:
        out.insert(0, (out[0] + 1) // 2)
    return out


_RESULT = ["doc_id", "n_words", "n_removed", "kept"]


def _schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and two hashes of the text that name its class."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text.alias("text"),
        F.xxhash64(text).alias("t1"),
        F.xxhash64(F.lit("other"), text).alias("t2"),
    )


def _thinned(length: int, upper: int, before: int | None = None):
    """Emits, for each text, the windows of `length` words that are least in a window of `upper` words; columns text, t1 and,
    if `before` is given, near: then only those that hold a candidate of `before` words, found at one of these places."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1 = batch.column(1).to_numpy()
            for a, _, raw, offsets in X.pieces(batch.column(0)):
                words = X.split(raw, offsets)
                h, first = X.windows(words.hashes, length), words.first
                least = X.least_in_window(h, upper - length + 1)
                at = np.unique(least[words.left[: len(least)] >= upper])
                if before is not None:
                    held = [first[k] + _covering(batch.column(2)[a + k].values.to_numpy(), before, length, int(n)) for k, n in enumerate(words.counts)]
                    at = np.intersect1d(at, np.concatenate(held), assume_unique=True)
                text_of = words.text_of[at]
                yield pa.record_batch([X.signed(h[at]), t1[a + text_of], at - first[text_of]], names=["h", "t1", "pos"])

    return scan


def _covering(pos: np.ndarray, length: int, upper: int, n: int) -> np.ndarray:
    """Starts of the windows of `upper` words that hold a window of `length` words at one of the positions."""
    if n < upper or not len(pos):
        return np.zeros(0, np.int64)
    marks = np.zeros(n + 2, np.int64)
    np.add.at(marks, np.maximum(pos - (upper - length), 0), 1)
    np.add.at(marks, np.minimum(pos, n - upper) + 1, -1)
    return np.flatnonzero(np.cumsum(marks[: n - upper + 1]) > 0)


def _extended(length: int, upper: int):
    """Emits the windows of `upper` words around each candidate of `length` words, with two hashes; columns text, near, doc_id and t1."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, near, ids, t1 = X.binary(batch.column(0)), batch.column(1), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for i in range(len(batch)):
                raw = np.frombuffer(texts[i].as_buffer(), np.uint8)
                words = X.split(raw, np.array([0, len(raw)]))
                at = _covering(near[i].values.to_numpy(), length, upper, len(words.hashes))
                if len(at):
                    one, two = (X.windows(x, upper)[at] for x in (words.hashes, X.mix(words.hashes ^ np.uint64(0x3C6EF372FE94F82B))))
                    yield pa.record_batch([X.signed(one), X.signed(two), np.full(len(at), ids[i]), np.full(len(at), t1[i]), at], names=["h", "h2", "doc_id", "t1", "pos"])

    return scan


def _batched(scan, rows: int = 20_000):
    """The same rows in larger batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in scan(batches):
            held.append(batch)
            size += len(batch)
            if size >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _result(text: bytes, starts: np.ndarray | None, target: int, digest: bool) -> tuple[int, int, str]:
    """Words, removed words, and the kept words (or their SHA-256); starts None: every window goes."""
    words = text.split()
    n = len(words)
    if starts is None:
        words, removed = ([], n) if n >= target else (words, 0)
    elif removed := len(starts):
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + target, -1)
        gone = np.cumsum(marks[:n]) > 0
        removed = int(gone.sum())
        words = [words[i] for i in np.flatnonzero(~gone).tolist()]
    kept = b" ".join(words)
    return n, removed, hashlib.sha256(kept).hexdigest() if digest else kept.decode()


def _settle(target: int, digest: bool):
    """Judges every row that has no candidate and hands the others on with their texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = X.binary(batch.column(2))
            copy, waits = batch.column(3).to_pylist(), batch.column(4).is_valid()
            out = [(None, None, None) if w else _result(t.as_py(), None if c else np.zeros(0, np.int64), target, digest) for t, c, w in zip(texts, copy, waits.to_pylist(), strict=True)]
            n, removed, kept = zip(*out, strict=True) if out else ((), (), ())
            text = pa.compute.if_else(waits, batch.column(2), pa.scalar(None, batch.column(2).type))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), text, batch.column(4)], names=["doc_id", "t1", *_RESULT[1:], "text", "near"])

    return scan


def _judge(target: int, digest: bool):
    """Removes the found windows; columns doc_id, text and pos."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, pos = X.binary(batch.column(1)), batch.column(2)
            out = [_result(texts[i].as_py(), pos[i].values.to_numpy() if pos[i].is_valid else np.zeros(0, np.int64), target, digest) for i in range(len(batch))]
            n, removed, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=_RESULT)

    return scan


def _repeated(rows: DataFrame, by: str, *keys: str) -> DataFrame:
    """The windows (by the hashes `keys`) found under more than one value of `by`, and the least of these.

    Written, so that a join with it shuffles both sides anew and its hot windows can be split.
    """
    return stash(rows.groupBy(*keys).agg(F.min(by).alias("least"), F.max(by).alias("most")).where("least < most").select(*keys, "least"), "repeated")


def deduplicate(
    docs: DataFrame, *, target: int = TARGET, start: int = START, digest: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and kept, the words left joined by one space (digest: their SHA-256).

    A word goes if a window of `target` words over it also starts in a document of smaller doc_id.
    """
    steps = levels(target, start)
    steps = steps if len(steps) > 1 else [max(1, target // 2), target]
    keyed = _keyed(docs, id_col, text_col)
    known = keyed.where("doc_id IS NOT NULL")
    candidates, found, before = _schema("h", "t1", "pos"), None, None
    for length, upper in zip(steps[:-1], steps[1:], strict=True):
        texts = known.select("text", "t1") if found is None else known.join(found, "t1").select("text", "t1", "near")
        windows = texts.mapInArrow(_thinned(length, upper, before), candidates)
        again = windows.join(_repeated(windows, "t1", "h").select("h"), "h")
        found, before = stash(again.groupBy("t1").agg(F.collect_set("pos").alias("near")), "level"), length
    leaders = known.groupBy("t1", "t2").agg(F.min("doc_id").alias("doc_id")).join(found, "t1", "left")
    marked = keyed.join(leaders.withColumn("leads", F.lit(True)), ["doc_id", "t1", "t2"], "left")
    marked = marked.select("doc_id", "t1", "text", (F.col("leads").isNull() & F.col("doc_id").isNotNull()).alias("copy"), "near")
    result = "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    held = stash(marked.mapInArrow(_settle(target, digest), "doc_id bigint, t1 bigint, n_words bigint, n_removed bigint, kept string, text string, near array<bigint>"), "substring")
    waiting = held.where("near IS NOT NULL")
    windows = waiting.select("text", "near", "doc_id", "t1").mapInArrow(_batched(_extended(before, target)), _schema("h", "h2", "doc_id", "t1", "pos"))
    again = windows.join(_repeated(windows, "doc_id", "h", "h2"), ["h", "h2"])
    later = again.where("doc_id > least").groupBy("doc_id", "t1").agg(F.collect_set("pos").alias("pos"))
    judged = waiting.select("doc_id", "t1", "text").join(later, ["doc_id", "t1"], "left").select("doc_id", "text", "pos")
    return held.where("near IS NULL").select(*_RESULT).unionByName(judged.mapInArrow(_judge(target, digest), result))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
m AS (SELECT g, min(doc_id) AS least FROM p GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM p JOIN m USING (g) WHERE doc_id > least),
x AS (SELECT doc_id, list(DISTINCT q) AS gone FROM r GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS i FROM d) AS e
      WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = e.doc_id AND r.q = e.i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN k USING (doc_id)
"""
