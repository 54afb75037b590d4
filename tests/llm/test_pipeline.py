"""Each stage of the pipeline on its own input against the operators' plain versions."""

import re
from collections import Counter
from pathlib import Path

import corpus as K
from helpers import SF
from pyspark.sql import functions as F
from test_decontaminate import brute as contaminated
from test_dedup import kept_lines
from test_jaccard import brute as near

import corpus_pipeline as P


def test_stages_on_their_own_inputs(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    made = {}
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        docs = spark.read.parquet(str(tmp_path / name))
        made[name] = before, docs.collect()
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(list(rows[0].asDict())[:5] == columns for _, rows in made.values())
    before, after = made["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert all(i in kept for i, q in labels.items() if q == 1) and sum(i in kept for i, q in labels.items() if q == 0) <= 0.2 * list(labels.values()).count(0)
    before, after = made["lines"]
    want = {i: t for i, t, n in kept_lines(before) if not n or K.spaced(t)}
    assert {str(r.doc_id): r.text for r in after} == want and all(len(r.text) == r.n_chars for r in after)
    before, after = made["near"]
    _, known, top, _ = near(before, P.NEAR_WORDS, P.NEAR_PERCENT)
    roots = {top(before[k][0]) for k in known} | {i for k, (i, _, _) in enumerate(before) if k not in known}
    assert {r.doc_id for r in after} == roots
    before, after = made["benchmark"]
    assert {r.doc_id for r in after} == {i for i, t, _ in before if not contaminated(t, bench)[-1]}
    before, after = made["mix"]
    assert {r.doc_id for r in after} <= {i for i, _, _ in before} and all(0 < r.taken <= 3 * r.size for r in after)
    assert sum(r.taken for r in after) > 0.8 * sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t, _ in before)


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Nulls, copies, shared ids and clashing names; what is left behind is the last table alone."""
    docs = K.frame(spark, K.documents()).withColumn("_gone", F.lit(1)).withColumn("t1", F.lit(2)).withColumn("_source", F.lit(3))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = P.run(spark, str(tmp_path))
    assert {"_gone", "t1", "_source", "key", "row", "a.b", "x`y"} <= set(out.columns)
    rows = [(r.doc_id, r.text) for r in out.collect()]
    assert rows and all(K.spaced(t) for _, t in rows) and {(i, t) for i, t in rows if i is not None} and max(Counter(t for i, t in rows if i not in (None, 5)).values()) == 1
    left = Path(out.inputFiles()[0].removeprefix("file://")).parent.parent
    assert [p.name.rsplit("-", 1)[0] for p in left.iterdir() if p.name.startswith(("pipeline", "mix", "near", "lines"))].count("pipeline-mix") >= 1
    assert not [p for p in left.iterdir() if p.name.startswith(("near-", "lines-", "mix-", "quality-"))]


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
