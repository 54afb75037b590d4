from collections import defaultdict

import corpus as K
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing as M


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Shares by weight, the excess over the caps shared again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left, w = total - cap * sum(sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        out = {s: cap * sizes[s] if s in full else left * weight[s] / w for s in names}
        over = {s for s in names if s not in full and out[s] > cap * sizes[s]}
        if not over:
            return out
        full |= over


def test_mix_of_a_corpus(spark):
    rows = K.documents(n=200)
    docs = K.frame(spark, rows)
    got = M.mix(docs).collect()
    assert M.mix(docs).columns == [c for c in docs.columns if c != "size"] + ["size", "source_size", "target", "taken"]
    sizes, longest = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        n = len(K.spaced(t))
        sizes[s] += n
        longest[s] = max(longest[s], n)
    want, taken = targets(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1
    again = M.mix(docs.repartition(3), carry=False).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in again) == sorted((str(r.doc_id), r.size, r.taken) for r in got)


def test_buckets_do_not_change_the_order(spark):
    docs = K.frame(spark, K.documents(n=300)).withColumn("source", F.lit("one"))
    docs = docs.unionByName(K.frame(spark, [(10_000, K.documents()[0][1] or "x", "two")]))
    few, many = (sorted(map(str, M.mix(docs, buckets=b, carry=False).collect())) for b in (1, 500))
    assert few == many


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 0, "c": 5}, {"a": 1, "b": 1000, "c": 3, "d": 7}, {"a": 0}, {"a": 5, None: 50, "b": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in M.targets(df).collect()}
    if sum(sizes.values()):
        assert got == pytest.approx(targets(sizes))


def test_heavier_documents_come_first(spark):
    docs = spark.createDataFrame([(i, "a b", "x" if i < 500 else "y") for i in range(1000)], "doc_id bigint, text string, source string")
    got = M.mix(docs, weights=(1, 3), quality=F.when(F.col("doc_id") % 2 == 0, 8.0).otherwise(1.0)).where("source = 'x' AND taken > 0").collect()
    assert sum(r.doc_id % 2 == 0 for r in got) > 0.75 * len(got)


def test_empty(spark):
    assert M.mix(K.empty(spark)).count() == 0
