"""Substring and line deduplication against plain loops."""

import hashlib
from collections import Counter

import corpus as K
import duckdb
import pandas as pd
import pytest

from ledgerloom.llm import line_dedup as L, substring_dedup as S


def kept_words(rows, target):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            w = K.spaced(t)
            for p in range(len(w) - target + 1):
                g = tuple(w[p : p + target])
                least[g] = min(i, least.get(g, i))
    out = []
    for i, t, _ in rows:
        w, gone = K.spaced(t), set()
        for p in range(len(w) - target + 1) if i is not None else ():
            if least[tuple(w[p : p + target])] < i:
                gone |= set(range(p, p + target))
        out.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize(("target", "start"), [(50, 25), (50, 13), (20, 5), (3, 1)])
def test_substrings_against_brute_force(spark, target, start):
    rows = K.documents(seed=target)
    got = S.deduplicate(K.frame(spark, rows), target=target, start=start).collect()
    want = kept_words(rows, target)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == want
    assert sum(n for _, _, n, _ in want) > 500
    if target == 50:
        digests = S.deduplicate(K.frame(spark, rows), digest=True).collect()
        assert Counter(r.kept for r in digests) == Counter(hashlib.sha256(k.encode()).hexdigest() for *_, k in want)


def test_sql_splits_at_the_same_characters(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, sep.join(words), "s") for i, sep in enumerate(["\x0b", "\x0c", "\r", "\t", "\n", " ", "\x0b \x0c", "\u00a0", "\x1f"])]
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"])  # noqa: F841
    want = duckdb.sql(S.ORACLE).fetchall()
    got = S.deduplicate(K.frame(spark, rows), digest=True).collect()
    assert sorted(map(tuple, got)) == sorted(want) and [w[1:3] for w in sorted(want)] == [(60, 0), *[(60, 60)] * 6, (1, 0), (1, 0)]


def test_levels_double():
    assert S.levels(50, 25) == [25, 50] and S.levels(50, 13) == [13, 25, 50] and S.levels(200, 25) == [25, 50, 100, 200]


def test_empty_substrings(spark):
    assert S.deduplicate(K.empty(spark)).count() == 0


def kept_lines(rows, n=3):
    """Rows that share id and text are one document."""
    docs = sorted({(i is None, i or 0, t) for i, t, _ in rows if t is not None})
    first, gone = set(), {}
    # documents with one id are ordered by a hash, which the cases here don't depend on
    for doc in docs:
        lines = doc[2].split("\n")
        for p in range(len(lines) - n + 1):
            g = tuple(lines[p : p + n])
            if any(K.spaced(x) for x in g):
                if g in first:
                    gone.setdefault(doc, set()).update(range(p, p + n))
                first.add(g)
    out = []
    for i, t, _ in rows:
        cut = gone.get((i is None, i or 0, t), set())
        out.append((str(i), t if not cut else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut), len(cut)))
    return sorted(out, key=str)


def test_lines_against_brute_force(spark):
    rows = K.documents() + [(300, "a\nb\nc\na\nb\nc\na\nb\nc", "s"), (301, "\n\n\n\n", "s"), (302, "x\n\n\ny\nx\n\n\ny", "s"), (303, "x\n\n\ny", "s"), (304, "a\nb", "s"), (None, "a\nb\nc\nd", "s")]
    docs = K.frame(spark, rows)
    got = L.deduplicate_lines(docs, count_col="n_words")
    assert got.columns == [c for c in docs.columns if c != "n_words"] + ["n_words"]
    assert sorted(((str(r.doc_id), r.text, r.n_words) for r in got.collect()), key=str) == kept_lines(rows)
    dropped = {str(r.doc_id) for r in L.deduplicate_lines(docs, drop_emptied=True).collect()}
    assert {str(i) for i, _, _ in rows} - dropped == {i for i, t, n in kept_lines(rows) if n and not K.spaced(t)}
    assert L.deduplicate_lines(K.empty(spark)).count() == 0
