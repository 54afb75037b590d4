"""Benchmark decontamination: find passages of benchmark items in documents.

The windows of all benchmark items (13 words, or the whole of a shorter item)
make a hash set that is broadcast; every document's token windows are probed
against it, and a hit is verified word by word before it counts. The benchmark
is dealt out in blocks of at most `block_bytes` of text, of which the set takes at most fifteen
times as much. One block is broadcast at a time: of several, each is a scan
of the documents that writes the texts it hits (by hash, without the text) and is then
destroyed, so a large benchmark takes more scans and no more memory. Longer items are
cut into pieces that overlap by all but one word of a window.

Defined cases: a null or empty text has no words and no hits; an item without
words (or null) is no item; items that repeat a text all count; an item with a
null id marks words but is no counted item; rows are judged one by one, so
repeated or null doc_ids are harmless; doc_ids are whole numbers; columns other than the id and the text
are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerloom.llm import _text as X
from ledgerloom.functions.columns import by_place, whole_row
from ledgerloom.store import discard, stash

WINDOW = 13
#: Benchmark text in one broadcast block, at most.
BLOCK_BYTES = 8 << 20
#: Texts with a hit that are broadcast to be found again, at most (of some hundred bytes each); more are joined by shuffle.
BROADCAST_TEXTS = 200_000

HIT_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)


class WindowSet:
    """The distinct windows of items in arrays: by length their sorted hashes, where they stand in the items' text and which
    items hold them, with a bitmap that turns most words away."""

    BITS = 22

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        raw, ends = "".join(text for _, text in items).encode(), np.cumsum([len(text.encode()) for _, text in items], dtype=np.int64)
        self.ids = [i for i, _ in items]
        self.words = words = X.split(np.frombuffer(raw, np.uint8), np.concatenate(([0], ends)), X.NOT_ALNUM, lower=True)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for length in sorted({min(window, n) for n in words.counts.tolist()} - {0}):
            at = np.flatnonzero((words.left >= length) & np.repeat((words.counts >= window) if length == window else (words.counts == length), words.counts))
            self.by_length[length] = self._grouped(X.windows(words.hashes, length)[at], at, words.text_of[at], length)
        words.hashes = np.zeros(0, np.uint64)
        words.start, words.end = words.start.astype(np.int32), words.end.astype(np.int32)

    def _grouped(self, h: np.ndarray, at: np.ndarray, item: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """(hashes, places, first items, items, bitmap) of the distinct windows: equal hashes count as one window only where the words are equal."""
        order = np.lexsort((item, at, h))
        h, at, item = h[order], at[order], item[order]
        fresh = np.concatenate(([True], h[1:] != h[:-1]))
        start = np.flatnonzero(fresh)
        if self._same(at, at[np.repeat(start, np.diff(np.concatenate((start, [len(h)]))))], length).all():
            kind = np.cumsum(fresh) - 1
        else:  # different windows of one hash
            seen: dict[tuple, int] = {}
            kind = np.array([seen.setdefault((x, *self.spelt(i, length)), len(seen)) for x, i in zip(h.tolist(), at.tolist(), strict=True)])
        order = np.lexsort((item, kind))
        kind, own, new = kind[order], item[order], np.ones(len(kind), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (own[1:] != own[:-1])
        firsts = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
        places, hashes = at[order][firsts], h[order][firsts]
        by_hash = np.argsort(hashes, kind="stable")
        counts = np.bincount(kind[new], minlength=len(firsts))
        bounds = np.concatenate(([0], np.cumsum(counts)))
        own = own[new]
        items = np.concatenate([own[bounds[k] : bounds[k + 1]] for k in by_hash]) if not (by_hash == np.arange(len(by_hash))).all() else own
        bitmap = np.zeros(1 << self.BITS, bool)
        bitmap[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
        return hashes[by_hash], places[by_hash].astype(np.int32), np.concatenate(([0], np.cumsum(counts[by_hash]))), items.astype(np.int32), bitmap

    def _same(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the windows at a and at b have equal words."""
        out, move = np.ones(len(a), bool), np.flatnonzero(a != b)
        if len(move):
            out[move] = [self.spelt(i, length) == self.spelt(j, length) for i, j in zip(a[move].tolist(), b[move].tolist(), strict=True)]
        return out

    def spelt(self, at: int, length: int) -> list[bytes]:
        return [self.words.word(i) for i in range(at, at + length)]

    def hits(self, words: X.Words) -> Iterator[tuple[int, int, list[str | None]]]:
        """(first word, words, items) of every occurrence of a window in any of the texts."""
        left = words.left
        for length, (hashes, places, bounds, items, bitmap) in self.by_length.items():
            found = X.windows(words.hashes, length)
            maybe = np.flatnonzero(bitmap[(found >> np.uint64(64 - self.BITS)).astype(np.int64)])
            maybe = maybe[left[maybe] >= length]
            low, high = np.searchsorted(hashes, found[maybe]), np.searchsorted(hashes, found[maybe], "right")
            for i, a, b in zip(maybe[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist(), strict=True):
                own = [words.word(i + j) for j in range(length)]
                for k in range(a, b):
                    if own == self.spelt(int(places[k]), length):
                        yield i, length, [self.ids[x] for x in items[bounds[k] : bounds[k + 1]].tolist()]


def _scan(column: pa.Array, known: WindowSet) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """Words, covered spans and item ids of each text of the column."""
    for _, _, raw, offsets in X.pieces(column):
        words = X.split(raw, offsets, X.NOT_ALNUM, lower=True)
        first, text_of = words.first, None
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for i, length, ids in known.hits(words):
            text_of = words.text_of if text_of is None else text_of
            at = int(text_of[i])
            start = i - int(first[at])
            spans.setdefault(at, []).append((start, start + length))
            items.setdefault(at, set()).update(x for x in ids if x is not None)
        for at, n in enumerate(words.counts.tolist()):
            yield n, _merged(spans.get(at, [])), sorted(items.get(at, ()))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _pieces(text: str, window: int, most: int) -> Iterator[str]:
    """The text, or parts of it of at most `most` bytes (of one window at least) that hold all of its windows."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) <= most:
        yield text
        return
    words, at = X.split(raw, np.array([0, len(raw)]), X.NOT_ALNUM, lower=True), 0
    n = len(words.start)
    while at < n:
        to = max(int(np.searchsorted(words.end, words.start[at] + most, "right")), min(at + window, n))
        yield raw[words.start[at] : words.end[to - 1]].tobytes().decode()
        at = n if to == n else to - window + 1


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[WindowSet]:
    """Sets of the benchmark's windows, each made of at most block_bytes of text; one set without windows if there are no items."""
    items = benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull())
    held, size, some = [], 0, False
    for item_id, text in items.toLocalIterator():
        for piece in _pieces(text, window, block_bytes):
            more = len(piece.encode())
            if held and size + more > block_bytes:
                yield WindowSet(held, window)
                held, size, some = [], 0, True
            held.append((item_id, piece))
            size += more
    if held or not some:
        yield WindowSet(held, window)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _spans(rows: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in s] for s in rows], _SPANS)


def _keys(text: Column) -> list[Column]:
    """Two hashes that name a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


_HIT = T.StructType([T.StructField("t1", T.LongType()), T.StructField("t2", T.LongType()), *HIT_SCHEMA.fields[2:]])


def _hit_texts(block):
    """t1, t2, spans and item_ids of the texts (columns t1, t2, text) with a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, s, ids) for i, (_, s, ids) in enumerate(_scan(batch.column(2), block.value)) if s]
            at = pa.array([i for i, _, _ in found], pa.int64())
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), _spans([s for _, s, _ in found]), pa.array([x for *_, x in found], pa.list_(pa.string()))], names=_HIT.names)

    return run


def _merge_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text from the sets of what the blocks found; columns t1, t2, spans and items, arrays of arrays."""
    for batch in batches:
        spans = [_merged([(x["start"], x["end"]) for part in row for x in part]) for row in batch.column(2).to_pylist()]
        items = [sorted({x for part in row for x in part}) for row in batch.column(3).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), _spans(spans), pa.array(items, pa.list_(pa.string()))], names=_HIT.names)


def _search(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, block_bytes: int) -> tuple:
    """(block, None): the whole benchmark as one broadcast; or (None, hits): t1, t2, spans and item_ids of all texts with a hit."""
    context, blocks = docs.sparkSession.sparkContext, _blocks(benchmark, item_col, item_text_col, window, block_bytes)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        return context.broadcast(block), None
    read, hits, written = docs.select(*_keys(F.col(text_col)), F.col(text_col).alias("text")), None, []
    while block is not None:
        held = context.broadcast(block)
        found = stash(read.mapInArrow(_hit_texts(held), _HIT), "hits")
        held.destroy()
        hits = found if hits is None else hits.unionByName(found)
        block, after = after, next(blocks, None)
        written.append(found)
    # copies of a text have found the same, so a set has one element of each block
    sets = hits.groupBy("t1", "t2").agg(F.collect_set("spans").alias("spans"), F.collect_set("item_ids").alias("item_ids"))
    merged = stash(sets.mapInArrow(_merge_hits, _HIT), "hits")
    discard(*written)
    return None, merged


def _n_words(text: Column) -> Column:
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.regexp_count(plain, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def _beside(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """rows (with t1 and t2) with spans and item_ids, empty arrays where nothing was hit."""
    both = rows.alias("r").join(_few(hits).alias("h"), (F.col("r.t1") == F.col("h.t1")) & (F.col("r.t2") == F.col("h.t2")), "left")
    return both.select("r.*", *[F.coalesce(F.col(f"h.{c}"), F.array().cast(HIT_SCHEMA[c].dataType)).alias(c) for c in ("spans", "item_ids")])


def _few(table: DataFrame) -> DataFrame:
    """A written table of texts that were hit, broadcast if it is small, so that no document moves."""
    return F.broadcast(table) if table.count() <= BROADCAST_TEXTS else table


def _n_hit(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def find_hits(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: doc_id, n_words, spans of words inside a benchmark window, and the item_ids found."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    block, hits = _search(read, benchmark, "text", item_col, item_text_col, window, block_bytes)
    if block is None:
        counted = read.select("doc_id", _n_words(F.col("text")).alias("n_words"), *_keys(F.col("text")))
        return _beside(counted, hits).select("doc_id", "n_words", "spans", "item_ids")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_scan(batch.column(1), block.value))
            columns = [batch.column(0), pa.array([n for n, _, _ in rows], pa.int64()), _spans([s for _, s, _ in rows]), pa.array([ids for _, _, ids in rows], pa.list_(pa.string()))]
            yield pa.record_batch(columns, names=HIT_SCHEMA.names)

    return read.mapInArrow(scan, HIT_SCHEMA)


def _contaminated(n_words: int, spans: list[tuple[int, int]], share: int) -> bool:
    hit = sum(b - a for a, b in spans)
    return hit > 0 and share * hit >= n_words


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", share: int = 20, window: int = WINDOW,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents without benchmark passages; all columns stay.

    remove="documents" drops a document of which 1/share or more of the words are hit;
    remove="spans" keeps every document and cuts the hit words, from the first
    to the last byte of each span, out of its text.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    block, hits = _search(docs, benchmark, text_col, item_col, item_text_col, window, block_bytes)
    at, places = docs.columns.index(text_col), by_place(docs)
    names = places.columns

    def cut(batch: pa.RecordBatch, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        columns = [*batch.columns[: len(names)]]
        columns[at] = pa.array([_cut(t, s) if s else t for t, s in zip(batch.column(at).to_pylist(), spans, strict=True)], batch.schema.field(at).type)
        return pa.record_batch(columns, names=names)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_scan(batch.column(at), block.value))
            if remove == "documents":
                yield batch.filter(pa.array([not _contaminated(n, spans, share) for n, spans, _ in rows], pa.bool_()))
            else:
                yield cut(batch, [spans for _, spans, _ in rows])

    def cut_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield cut(batch, [[(x["start"], x["end"]) for x in row] for row in batch.column(len(names)).to_pylist()])

    if block is not None:
        return places.mapInArrow(clean, places.schema).toDF(*docs.columns)
    rows = docs.select(whole_row(docs).alias("row"), *_keys(F.col(text_col)))
    if remove == "documents":
        counted = docs.select(_n_words(F.col(text_col)).alias("n_words"), *_keys(F.col(text_col)))
        bad = counted.join(_few(hits.select("t1", "t2", _n_hit("spans").alias("n_hit"))), ["t1", "t2"]).where(share * F.col("n_hit") >= F.col("n_words"))
        bad = stash(bad.select("t1", "t2").distinct(), "contaminated")
        return rows.join(_few(bad), ["t1", "t2"], "left_anti").select("row.*")
    both = _beside(rows, hits)
    found = both.select(*[F.col("row")[c].alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col("spans").alias("s"))
    return found.mapInArrow(cut_found, places.schema).toDF(*docs.columns)


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    raw = np.frombuffer(text.encode(), np.uint8)
    words = X.split(raw, np.array([0, len(raw)]), X.NOT_ALNUM, lower=True)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : words.start[a]].tobytes())
        at = int(words.end[b - 1])
    return b"".join([*out, raw[at:].tobytes()]).decode()


def digest(hits: DataFrame, share: int = 20) -> DataFrame:
    """The columns of the query op1 from the rows of find_hits."""
    return hits.select(
        "doc_id",
        "n_words",
        _n_hit("spans").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, dw.k, p, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.k = iw.k),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, k, p FROM h)) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
