"""Importance resampling against plain loops."""

import hashlib
import math
import re
import zlib
from collections import Counter

import corpus as K
import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import _text as T, importance as I


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", K.lowered(text))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def brute(rows, target, buckets, least, percent):
    """Sorted (doc_id, n_features, weight, score, rank); ranks of rows that tie wholly are left to the caller."""
    s, t = (Counter(bucket(f, buckets) for x in texts for f in features(x)) for texts in ([r[1] for r in rows], target))
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (s.total() + buckets) / ((s[k] + 1) * (t.total() + buckets)))) for k in range(buckets)}
    out = []
    for i, text, _ in rows:
        f = features(text)
        weight = sum(gain[bucket(x, buckets)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in out if (r[1] + 1) / 2 >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, enough[: percent * len(enough) // 100]


@pytest.mark.parametrize(("buckets", "least", "percent"), [(10_000, 20, 25), (97, 1, 60), (100_000, 3, 100), (16, 20, 0)])
def test_against_plain_loops(spark, buckets, least, percent):
    rows = [*K.documents(seed=buckets), (900, "X" * 40 + " " + "é" * 50 + "\u2003Straße 1-2", "s")]
    target = [K.sentence(__import__("random").Random(1), 300), None, "", "The OF the"]
    goal = spark.createDataFrame([(k, x, "z", 1) for k, x in enumerate(target)], "item_id int, text string, `a.b` string, id int")
    docs = K.frame(spark, rows)
    got = I.resample(docs, goal, buckets=buckets, min_words=least, percent=percent).collect()
    want, drawn = brute(rows, target, buckets, least, percent)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(want, key=key)
    ranked = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, len(drawn) + 1)) and [(r.score, r.doc_id) for r in ranked] == [(r[3], r[0]) for r in drawn]


def test_buckets_of_long_words():
    text = ["a" * n + " " + "b" * (70 - n) for n in range(1, 70)] + ["", "x", "é" * 33 + " z"]
    array = pa.array([x.encode() for x in text], pa.large_binary())
    for _, _, raw, offsets in T.pieces(array):
        row, own = I.feature_buckets(T.split(raw, offsets, T.NOT_ALNUM, lower=True), 10_000)
    assert Counter(zip(row.tolist(), own.tolist(), strict=True)) == Counter((k, bucket(f, 10_000)) for k, x in enumerate(text) for f in features(x))


def test_matrix_and_sums(spark):
    rows = K.documents(seed=4)
    blocks = I.csr_blocks(K.frame(spark, rows), buckets=500)
    cells = Counter(bucket(f, 500) for _, x, _ in rows for f in features(x))
    assert {r.bucket: r.n for r in I.column_sums(blocks, 500).collect()} == dict(cells)
    for r in blocks.collect():
        own = np.frombuffer(r.buckets, "<u2")
        assert len(r.ids) == len(r.ties) == len(r.starts) - 1 and r.starts[-1] == len(own) == len(r.counts) // 4
        assert all((np.diff(own[a:b].astype(int)) > 0).all() for a, b in zip(r.starts, r.starts[1:], strict=False))


def test_empty_tables(spark):
    goal = spark.createDataFrame([("a b",)], "text string")
    assert I.resample(K.empty(spark), goal).count() == 0
    assert {r.rank for r in I.resample(K.frame(spark, K.documents()), goal.limit(0), percent=100, min_words=200).collect()} > {None, 1}
