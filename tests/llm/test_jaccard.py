"""The Jaccard join against all pairs."""

import random
from collections import Counter

import corpus as K
import numpy as np
import pytest

from ledgerloom.llm import _components as C, jaccard_join as J


def brute(rows, ngram, percent):
    """(sets, known rows, least id reachable from an id, links by row); rows of one id are one document."""

    def shingles(t):
        w = K.spaced(K.lowered(t))
        n = min(ngram, len(w))
        return frozenset(tuple(w[p : p + n]) for p in range(len(w) - n + 1)) if n else frozenset()

    sets = [shingles(t) for _, t, _ in rows]
    known = [k for k, (i, _, _) in enumerate(rows) if i is not None and sets[k]]
    root = {rows[k][0]: rows[k][0] for k in known}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a in known:
        for b in known:
            if a < b:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    links[a] += 1
                    links[b] += 1
                    x, y = sorted((top(rows[a][0]), top(rows[b][0])))
                    root[y] = x
    return sets, known, top, links


@pytest.mark.parametrize(("ngram", "percent", "leaf"), [(3, 90, 512), (5, 80, 4), (1, 60, 7), (3, 100, 512)])
def test_against_all_pairs(spark, monkeypatch, ngram, percent, leaf):
    monkeypatch.setattr(J, "LEAF_ROWS", leaf)
    rng = random.Random(ngram)
    rows = K.documents(seed=percent)
    for i in range(400, 470):  # families of near copies of many sizes
        body = K.sentence(random.Random(i % 7), 4 + 13 * (i % 7)).split()
        for _ in range(rng.randint(0, 1 + len(body) // 12)):
            body[rng.randrange(len(body))] = f"z{rng.random()}"
        rows.append((i, " ".join(body), "s"))
    rows += [(i, " ".join(body), "s") for i in (469, 469, 480)] + [(481, rows[0][1], "s"), (481, " ".join(body[:-1]), "s")]
    sets, known, top, links = brute(rows, ngram, percent)
    got = J.join(K.frame(spark, rows), ngram=ngram, percent=percent).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.n_links))
    for k, (i, _, _) in enumerate(rows):
        if k in known:
            assert (len(sets[k]), top(i), links[k]) in by_id[i], (i, by_id[i], len(sets[k]), top(i), links[k])
        elif i is not None:
            assert (0, i, 0) in by_id[i]
    assert percent == 100 or len({top(rows[k][0]) for k in known}) < len({rows[k][0] for k in known}) - 20


T, NEAR, OTHER = (" ".join(f"w{k}" for k in x) for x in (range(40), [*range(39), 99], range(200, 204)))


@pytest.mark.parametrize(
    ("rows", "want", "kept"),
    [
        ([(3, T), (5, T), (5, OTHER)], [(3, 3, 1), (5, 3, 0), (5, 3, 1)], [(3, T), (5, OTHER)]),
        ([(1, T), (1, T), (2, NEAR)], [(1, 1, 2), (1, 1, 2), (2, 1, 2)], [(1, T), (1, T)]),
        ([(5, T), (5, NEAR), (6, OTHER), (5, OTHER), (None, T), (7, None), (7, "")], [(None, 5, 1), (5, 5, 1), (5, 5, 1), (5, 5, 1), (6, 5, 1), (7, 7, 0), (7, 7, 0)], None),
    ],
)
def test_repeated_rows_and_shared_ids(spark, rows, want, kept):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, _gone int, t string")
    got = J.join(docs, percent=85)
    assert sorted(map(str, ((r.doc_id, r.component_id, r.n_links) for r in got.collect()))) == sorted(map(str, want))
    left = J.keep_one(docs, percent=85)
    assert left.columns == docs.columns
    left = [(r.doc_id, r.text) for r in left.collect()]
    if kept is not None:
        assert sorted(left) == sorted(kept)
    else:
        assert sum(i == 5 and t in (T, NEAR) for i, t in left) == 1 and {(None, T), (7, None), (7, ""), (5, OTHER)} <= set(left) and (6, OTHER) not in left


def test_products_and_lists_count_alike(monkeypatch):
    """Both ways to verify pairs, and the joins without numbers of links, on leaves of near copies."""
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(1, 1 << 63, 300).astype(np.uint64))
    rows = []
    for i in range(60):
        own = base.copy() if i < 40 else np.unique(rng.integers(1, 1 << 63, 300).astype(np.uint64))
        own[rng.integers(len(own), size=rng.integers(0, 12))] = rng.integers(1, 1 << 63, 1).astype(np.uint64)
        own = np.unique(own)
        rows.append((1, i, i * 7, 1 + i % 3, len(own), np.bincount((own % np.uint64(16)).astype(int), minlength=16).astype(np.int32).tobytes(), own.tobytes()))
    table = lambda part: J.pa.table([list(x) for x in zip(*part, strict=True)], names=["block", "rep", "d1", "copies", "n", "point", "elements"])
    whole, a, b = (J.Leaf(table(sorted(x, key=lambda r: r[4]))) for x in (rows, rows[::2], rows[1::2]))
    got = {}
    for dense in (0, 10**9):
        monkeypatch.setattr(J, "DENSE", dense)
        monkeypatch.setattr(J, "SLICE", 64)
        got[dense] = [J._joined(*x, 90, True).sort_by("rep").to_pydict() for x in ((whole, None), (a, b))]
    assert got[0] == got[10**9] and sum(got[0][0]["links"]) > 500
    for x, counted in zip(((whole, None), (a, b)), got[0], strict=True):
        plain = J._joined(*x, 90, False).sort_by("rep").to_pydict()
        reached = {r: y for r, y, n in zip(counted["rep"], counted["least_rep"], counted["links"], strict=True) if r != y}
        assert dict(zip(plain["rep"], plain["least_rep"], strict=True)) == reached


def test_shuffle_paths_agree(spark):
    docs = K.frame(spark, K.documents())
    one, two = (sorted(map(str, J.join(docs, broadcast_members=n, broadcast_keys=n).collect())) for n in (0, 10**6))
    assert one == two


def test_no_link_is_lost_by_the_keys():
    """Any two sets above the threshold share a key."""
    rng = np.random.default_rng(0)
    rarity = rng.integers(0, 9, 1 << J.CELL_BITS)
    for percent in (60, 80, 90, 95):
        bands = J.Bands(percent)
        for n in (1, 2, 3, 5, 9, 10, 19, 40, 100, 400):
            for _ in range(6):
                a = rng.integers(1, 1 << 63, n).astype(np.uint64)
                b = a.copy()
                while True:
                    c = b.copy()
                    if rng.random() < 0.5:
                        c[rng.integers(len(c))] = np.uint64(rng.integers(1, 1 << 63))
                    else:
                        c = c[:-1] if rng.random() < 0.5 else np.append(c, np.uint64(rng.integers(1, 1 << 63)))
                    common = len(np.intersect1d(a, c))
                    if not len(c) or 100 * common < percent * (len(a) + len(c) - common):
                        break
                    b = c
                    if len(b) > 2 * n:
                        break
                h, bounds = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
                keys = [set(), set()]
                for member, key in J._keys(h, bounds, bands, rarity):
                    for m, k in zip(member.tolist(), key.tolist(), strict=True):
                        keys[m].add(k)
                assert keys[0] & keys[1], (percent, n)


def test_keep_one_and_empty(spark):
    docs = K.frame(spark, K.documents())
    kept = J.keep_one(docs, ngram=5, percent=80)
    assert kept.columns == docs.columns
    want = [r for r in J.join(docs, ngram=5, percent=80).collect() if r.doc_id is None or r.doc_id == r.component_id]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in want)  # the two texts of id 7 link with nothing
    assert J.join(K.empty(spark)).count() == 0 and J.keep_one(K.empty(spark)).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: top(x) for x in root if top(x) != x}
