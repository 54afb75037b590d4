"""The divergence audit against plain loops over all terms."""

import random
import re
from collections import Counter, defaultdict

import corpus as K
import pytest

from ledgerloom.llm import divergence_audit as D

SCHEMA = "doc_id int, text string, lang string, source string, g int, t int, c string, `a.b` int, `x``y` int"


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", K.lowered(text))


def brute(rows, least, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, words = lang or "", source or "", terms(text)
        docs[lang].update(set(words))
        counts[lang, source].update(words)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= least]
        own = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        own[None] = {t: sum(own[s][t] for s in sources) for t in kept}

        def shares(c):
            n = sum(c.values())
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in own.items()}
        for s in sources:
            pairs = [(other, sum(abs(p[s][t] - p[other][t]) for t in kept)) for other in sources - {s}]
            more = [(t, p[s][t] - p[None][t]) for t in kept if own[s][t] and p[s][t] > p[None][t]]
            for part, items in (("pair", pairs), ("term", more)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def documents(seed, n=400):
    rng = random.Random(seed)
    words = [f"{'abcdefghij'[k // 26 % 10]}{'klmnopqrstuvwxyz'[k % 16]}{'qwertyuiop'[k % 7]}" for k in range(200)] + ["Été", "straße", "THE", "the"]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "en", "fr", "", None, "x" * rng.randrange(2)])
        own = words[: rng.choice([5, 50, 204])]
        rows.append((" ".join(rng.choice(own) + rng.choice(["", ",", "7", "\u00a0"]) for _ in range(rng.choice([0, 1, 5, 60]))), lang, rng.choice(["s1", "s1", "s2", "s3", "", None, "é", "Z"])))
    return rows + rows[:20] + [(None, "en", "quiet"), ("12 - 3", "de", "only"), ("", "zz", "a"), ("q", "zz", "b"), ("long " * 50000, "en", "s1")]


@pytest.mark.parametrize(("seed", "least", "top"), [(1, 30, 50), (2, 3, 4), (3, 1, 1), (4, 10_000, 50)])
def test_against_plain_loops(spark, seed, least, top):
    rows = documents(seed)
    docs = spark.createDataFrame([(1, *r, 1, 2, "c", 3, 4) for r in rows], SCHEMA)
    got = D.audit(docs, min_docs=least, top=top).collect()
    want = brute(rows, least, top)
    assert sorted(tuple(r) for r in got) == want
    assert {w[2] for w in want} == ({"pair", "term"} if least < 10_000 else {"pair"}) and (least < 10_000 or {w[4] for w in want} == {0})


def test_terms_are_counted_by_group(spark):
    docs = spark.createDataFrame([(1, *r, 1, 2, "c", 3, 4) for r in documents(5)], SCHEMA)
    whole = {tuple(r) for r in D.term_counts(docs.coalesce(1)).collect()}
    text = Counter()
    for t, lang, source in documents(5):
        text.update((lang or "", source or "", w) for w in terms(t))
    assert {w[:4] for w in whole} == {(*k, c) for k, c in text.items()}


def test_histograms_hold_every_term_once(spark):
    cells = spark.createDataFrame([(0, 0, 2), (0, 1, 2), (1, 1, 5), (2, 2, 1)], "g long, t long, c long")
    groups = spark.createDataFrame([(0, "x", 4), (1, "x", 4), (2, "x", 4), (3, "y", 1)], "g long, lang string, v long")
    got = {(r.a, r.b, r.ca, r.cb): r.m for r in D.histograms(cells, groups).collect()}
    assert got == {(0, 1, 2, 0): 1, (0, 1, 2, 5): 1, (0, 1, 0, 0): 2, (0, 2, 2, 0): 2, (0, 2, 0, 1): 1, (0, 2, 0, 0): 1, (1, 2, 5, 0): 1, (1, 2, 0, 1): 1, (1, 2, 0, 0): 2}


def test_empty(spark):
    assert D.audit(spark.createDataFrame([], SCHEMA)).count() == 0
