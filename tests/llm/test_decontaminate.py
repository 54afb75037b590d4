import hashlib
import re

import corpus as K

from ledgerloom.llm import decontaminate as D

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(text, items, window=13):
    words = re.findall(PATTERN, K.lowered(text))
    hit, found = set(), set()
    for item, body in items:
        own = re.findall(PATTERN, K.lowered(body))
        n = min(window, len(own))
        runs = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in runs:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)


def test_against_brute_force(spark):
    rows = K.documents()
    texts = [t for _, t, _ in rows if t and len(K.spaced(t)) >= 60][:6]
    items = [(i, " ".join(K.spaced(t)[3 : 3 + 14 + i])) for i, t in enumerate(texts)] + [(10, texts[0][:30]), (11, None), (12, "..."), (2, "w001 w002"), (13, K.lowered(texts[1]).upper())]
    rows = rows + [(900, texts[0].replace(" ", "--").upper(), "s0"), (901, "W001, w002!", "s0")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted((str(i), *brute(t, items)) for i, t, _ in rows)
    docs = K.frame(spark, rows)
    for size in (D.BLOCK_BYTES, 200):  # one block, and many
        got = D.digest(D.find_hits(docs, bench, block_bytes=size)).collect()
        assert sorted((str(r.doc_id), *r[1:]) for r in got) == want
    docs = docs.withColumnRenamed("h", "t1").withColumnRenamed("key", "spans")
    for size in (D.BLOCK_BYTES, 200):
        kept = D.decontaminate(docs, bench, block_bytes=size)
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(i for i, *_, bad in want if not bad)
        cut = D.decontaminate(docs, bench, remove="spans", block_bytes=size)
        assert cut.columns == docs.columns and cut.count() == len(rows)
        for r in cut.where("doc_id >= 900").collect():
            assert len(re.findall(PATTERN, K.lowered(r.text))) == next(n - h for i, n, h, *_ in want if i == str(r.doc_id))


def test_a_block_is_bounded_and_keeps_all_windows():
    text = " ".join(f"w{i}" for i in range(500))
    words = text.split()
    for most in (60, 100, 10**6):
        parts = [p.split() for p in D._pieces(text, 13, most)]
        assert {tuple(p[i : i + 13]) for p in parts for i in range(len(p) - 12)} == {tuple(words[i : i + 13]) for i in range(488)}
        assert all(len(p) >= 13 for p in parts) and all(len(" ".join(p)) <= max(most, 13 * 5) for p in parts)
    known = D.WindowSet([("a", text), ("b", text), ("b", "w1 w2"), (None, " ".join(words[5:30])), ("c", "...")], 13)
    hit = D.X.split(D.np.frombuffer(text.encode(), D.np.uint8), D.np.array([0, len(text)]), D.X.NOT_ALNUM, lower=True)
    found = list(known.hits(hit))
    assert len(found) == 489 and ((1, 2, ["b"]) in found) and ((5, 13, ["a", "b", None]) in found) and ((40, 13, ["a", "b"]) in found)


def test_windows_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(D.X, "windows", lambda h, n: D.np.full(max(len(h) - n + 1, 0), 7, D.np.uint64))
    known = D.WindowSet([("a", "x y"), ("b", "x z"), ("c", "x y")], 13)
    words = D.X.split(D.np.frombuffer(b"x z x y q", D.np.uint8), D.np.array([0, 9]), D.X.NOT_ALNUM, lower=True)
    assert list(known.hits(words)) == [(0, 2, ["b"]), (2, 2, ["a", "c"])]


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert D.digest(D.find_hits(K.empty(spark), bench)).count() == 0
    got = D.digest(D.find_hits(K.frame(spark, [(1, "a b", "s")]), bench)).first()
    assert (got.n_words, got.n_hit, got.contaminated) == (2, 0, False)
