"""Classifiers by held-out accuracy and swaps, language-model scores against a plain model, quality rules and licenses."""

import math
import random
import re
import string
import zlib
from collections import Counter

import corpus as K
import numpy as np
import pytest
from helpers import SF, agree
from pyspark.sql import functions as F

from ledgerloom.llm import _text as X, license_scan as LS, lm_scoring as LM, quality_classifier as Q, quality_rules as R, queries, toxicity as TX

LABELS = "doc_id bigint, quality int, toxic int"


def test_quality_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    rows = queries.op2_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert all(r.predicted == 1 for r in rows if r.quality == 1)


def test_toxicity_on_held_out_rows(spark):
    for size, least in (("0.1", 0.9), ("0.01", 0.5)):
        sf = SF.replace("0.001", size)
        rows = queries.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
        assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.005 * len(rows)
        assert sum(r.predicted for r in rows if r.toxic == 1) >= least * sum(r.toxic for r in rows)


def test_toxicity_groups_from_the_data_act_on_scores(spark):
    """No text of these tables holds a given term, so neutral features are swapped; the penalty draws their weights together."""
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    fair, plain, without = TX.fit(docs, labels), TX.fit(docs, labels, fair=0), TX.fit(docs, labels, neutral=0)
    assert (fair.groups, plain.groups, without.groups) == ("neutral", "neutral", "none")
    both = TX.score(docs, fair).join(TX.score(docs, plain).withColumnRenamed("score", "other"), "doc_id").collect()
    assert sum(abs(r.score - r.other) > 1e-4 for r in both) > 0.1 * len(both)
    named = docs.withColumn("text", F.concat("text", F.lit(" muslim")))
    assert TX.fit(named, labels).groups == "terms"


def test_folds():
    assert zlib.crc32(b"17") % 5 != 0 and Q.LEARN_FOLDS == 5


@pytest.mark.parametrize("module", [Q, TX])
def test_odd_rows_and_missing_labels(spark, module):
    docs = K.frame(spark, K.documents())
    label = "quality" if module is Q else "toxic"
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(None, 1, 1), (3, None, None), (4, 7, 7), (5, 1, 1), (5, 0, 0)], LABELS)
    for labels in (some, some.limit(0), some.where("quality = 1")):
        model = module.fit(docs, labels, label=label)
        got = module.score(docs, model).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert module.fit(K.empty(spark), some, label=label) and module.score(K.empty(spark), model).count() == 0
    kept = Q.keep(docs, Q.fit(docs, some))
    assert kept.columns == docs.columns


def test_discriminant_separates_shapes_that_a_plane_cannot():
    rng = np.random.default_rng(0)
    inner, outer = rng.normal(0, 0.3, (400, 3)), rng.normal(0, 3, (400, 3))
    x = np.vstack([inner, outer])
    x = np.hstack([np.full((800, 1), np.log1p(1e6)), x])
    model = Q.fit_vectors(x, np.repeat([1, 0], 400))
    assert ((model.score(x) > 0.5) == (np.arange(800) < 400)).mean() > 0.93


def plain_statistics(raw):
    """The statistics of one text, one by one."""
    logit = lambda part, whole: math.log((part + 0.5) / (whole + 1.0))
    words, size = raw.split(), max(len(raw), 1)
    n, counts = len(words), Counter(words)
    count = lambda test: sum(map(test, raw))
    upper, wide = count(lambda b: 65 <= b < 91), count(lambda b: b >= 128)
    letters = upper + wide + count(lambda b: 97 <= b < 123)
    marks = count(lambda b: chr(b) in string.punctuation)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths, sizes = np.array([len(x) for x in lines] or [0]), np.array([len(w) for w in words] or [0])
    packer = zlib.compressobj(1)
    packed = len(packer.compress(raw)) + len(packer.flush())
    shares = [logit(upper, letters), logit(count(lambda b: 48 <= b < 58), size), logit(wide, letters), logit(marks, size), logit(count(lambda b: chr(b) in "#*$%&|<>"), size), logit(raw.count(b"!"), size)]
    shares += [logit(raw.count(x), n) for x in (b".", b",", b"|")] + [logit(raw.count(b" ") + raw.count(b"\n"), size), logit(len(counts), n), logit(max(counts.values(), default=0), n)]
    shares += [logit(sum(a == b for a, b in zip(words, words[1:], strict=False)), n), logit(sum(w.isupper() for w in words), n)]
    ends = [math.log1p(len(lines)), np.log1p(lengths.mean()), np.log1p(lengths.std()), logit(len(lines) - len(set(lines)), len(lines)), math.log(packed / size + 0.01)]
    return [math.log1p(n), np.log1p(sizes.mean()), np.log1p(sizes.std()), *shares, *ends]


TRICKY = ["", None, "\n\n", " \t\n a \n a\n", "AB Ab aB 1B ÄB ab", "x x x\nx x x\n\x0bx", "#*$%&|<>!.,;:?@[]^_`{}~'\"", "é" * 50, "one", "a\rb\x0cc\x1cd"]


def test_statistics_against_single_texts():
    texts = TRICKY + [t for _, t, _ in K.documents()] + [f"{K.sentence(random.Random(i), 40)}\n" * 3 for i in range(5)]
    got = Q.statistics(Q.pa.array(texts))
    assert np.allclose(got, [plain_statistics((t or "").encode()) for t in texts], rtol=1e-9, atol=1e-9)


def test_quality_fit_and_scores_against_a_plain_version(spark):
    """Sample, statistics, shrunk covariances, densities and the logistic scale, each computed in the plainest way."""
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    learn = [(r.doc_id, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    x, y = np.array([plain_statistics(texts[i]) for i, _ in learn]), np.array([q for _, q in learn])
    centre, scale = x.mean(0), x.std(0) + 1e-6

    def standard(v):
        z, n = (v - centre) / scale, np.expm1(v[0])
        return np.concatenate((z[:1], z[1:] * n / (n + Q.SOFT)))

    z = np.array([standard(v) for v in x])
    own = [np.cov(z[y == k].T) for k in (0, 1)]
    pooled, classes = own[0] * (y == 0).mean() + own[1] * (y == 1).mean(), []
    for k in (0, 1):
        c = (1 - Q.POOLED) * own[k] + Q.POOLED * pooled
        classes.append((z[y == k].mean(0), (1 - Q.RIDGE) * c + (Q.RIDGE * np.trace(c) / len(c) + 1e-9) * np.eye(len(c)), (y == k).mean()))

    def difference(v):
        logs = [math.log(share) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (v - mean) @ np.linalg.inv(c) @ (v - mean) for mean, c, share in classes]
        return logs[1] - logs[0]

    s = np.array([difference(v) for v in z])
    ones, zeros = (y == 1).sum(), (y == 0).sum()
    aim, u, at = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2)), (s - s.mean()) / (s.std() + 1e-9), np.array([0.0, 0.0])
    loss = lambda w: np.logaddexp(0, w[0] * u + w[1]).sum() - (aim * (w[0] * u + w[1])).sum() + 0.5e-3 * w[0] ** 2
    step = 4.0
    while step > 1e-7:  # a search along the axes and diagonals
        best = min((at + step * np.array(d) for d in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (1, -1), (-1, 1))), key=loss)
        at, step = (best, step) if loss(best) < loss(at) else (at, step / 2)
    got = {r.doc_id: r.score for r in queries.op2_quality_classifier(spark, SF.replace("0.001", "0.01")).collect()}
    assert got.keys() == texts.keys()
    for i, raw in texts.items():
        want = 1 / (1 + math.exp(-min(500, max(-500, at[0] * (difference(standard(np.array(plain_statistics(raw)))) - s.mean()) / (s.std() + 1e-9) + at[1]))))
        assert got[i] == pytest.approx(want, abs=2e-4)


def test_toxicity_fit_and_scores_against_a_plain_version(spark):
    """Features as counters of words and stems, swaps word by word, and a fit by plain descent on the stated loss."""
    rng = random.Random(8)
    pool = [*K.WORDS[:40], "friend", "neighbour"]
    rows = []
    for i in range(160):
        words = [rng.choice(pool) for _ in range(12)]
        if i % 2:
            words.append(rng.choice(["vermin", "verminous"]))
        if rng.random() < 0.5:
            words.append(rng.choice(["christian", "muslim", "sikh"] if i % 2 else ["christian", "sikh"]))
        rows.append((i, " ".join(words), "s"))
    identities = (("christian", "muslim", "sikh"),)
    y = {i: i % 2 for i, _, _ in rows}
    learn = [(i, t) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    features = lambda t: Counter(f for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", K.lowered(t)) for f in [w, *[(n, w.encode()[:n]) for n in TX.STEMS if len(w.encode()) > n]])
    seen = Counter(f for _, t in learn for f in features(t).keys())
    made = {term: features(term) for kind in identities for term in kind}
    names = sorted({f for f, n in seen.items() if n >= TX.MIN_TEXTS} | set().union(*[m.keys() for m in made.values()]), key=str)
    at = {f: k for k, f in enumerate(names)}

    def vector(t):
        out = np.zeros(len(names))
        for f, n in features(t).items():
            if f in at:
                out[at[f]] = math.log2(1 + n)
        return out

    x, target = np.array([vector(t) for _, t in learn]), np.array([y[i] for i, _ in learn], float)
    turns = []
    for turn in (1, 2):
        changes = []
        for v in x:
            change = np.zeros(len(names))
            for kind in identities:
                for k, term in enumerate(kind):
                    other = kind[(k - turn) % len(kind)]
                    change += v[at[term]] * (sum(np.eye(len(names))[at[f]] for f in made[term]) - sum(np.eye(len(names))[at[f]] for f in made[other]))
            if np.abs(change).any():
                changes.append(change)
        turns.append(np.array(changes))
    w, b = np.zeros(len(names)), 0.0
    fair = sum(c.T @ c * 2 * TX.FAIR * len(x) / len(c) for c in turns) + TX.L2 * np.eye(len(names))
    rate = 1 / (np.linalg.eigvalsh(fair).max() + 0.25 * np.linalg.eigvalsh(np.hstack([x, np.ones((len(x), 1))]).T @ np.hstack([x, np.ones((len(x), 1))])).max())
    v, moved = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for k in range(60_000):  # descent with momentum
        p = 1 / (1 + np.exp(-(x @ v[:-1] + v[-1])))
        new = v - rate * np.concatenate((x.T @ (p - target) + fair @ v[:-1], [(p - target).sum() + 1e-6 * v[-1]]))
        v, moved = new + 0.995 * (new - moved), new
    w, b = moved[:-1], moved[-1]
    docs = K.frame(spark, rows)
    model = TX.fit(docs, spark.createDataFrame([(i, 1, y[i]) for i, _, _ in rows], LABELS), max_words=10**6, identities=identities)
    got = {r.doc_id: r.score for r in TX.score(docs, model).collect()}
    for i, t, _ in rows:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(vector(t) @ w + b))), abs=1e-3)


def test_swaps_make_identity_terms_weigh_alike(spark):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(600):
        bad, group = i % 2, "muslim" if (i % 2) == (rng.random() < 0.9) else "christian"  # groups are confounded with the label
        rows.append((i, f"{K.sentence(rng, 12)} the {group} neighbour {'vermin' if bad else 'friend'}", "s"))
        labels.append((i, 1, bad))
    docs, labels = K.frame(spark, rows), spark.createDataFrame(labels, LABELS)
    neutral = K.frame(spark, [(1, "the muslim neighbour", "s"), (2, "the christian neighbour", "s"), (3, "such vermin", "s")])
    gap = {}
    for fair in (0.0, TX.FAIR):
        model = TX.fit(docs, labels, fair=fair)
        s = {r.doc_id: r.score for r in TX.score(neutral, model).collect()}
        gap[fair] = abs(s[1] - s[2])
        assert s[3] > 0.7
    assert gap[TX.FAIR] < 0.05 < 0.3 < gap[0.0]


def plain_model(rows, tokens, order):
    """Counts of the n-grams of the training documents, by length."""
    counts = [Counter() for _ in range(order)]
    for i, t, _ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            for n in range(order):
                padded = ["<b>"] * n + tokens(t)
                counts[n].update(tuple(padded[p : p + n + 1]) for p in range(len(tokens(t))))
    return counts


@pytest.mark.parametrize("options", [{}, {"frequent": 5}, {"shard_bytes": 20_000, "segment_grams": 2_000}, {"order": 2, "segment_grams": 500, "shard_bytes": 1}])
def test_lm_against_a_plain_model(spark, options):
    """The base is exact; the score is that of counts floored to powers of two, but for a few false positives of the filter."""
    rows, order = K.documents(), options.get("order", LM.ORDER)
    tokens = lambda t: [*K.spaced(K.lowered(t)), None]
    counts = plain_model(rows, tokens, order)
    total, words = sum(counts[0].values()), len(counts[0])
    begins, floored = counts[0][None,], lambda c: 2.0 ** (c.bit_length() - 1) if c else 0.0
    want, exact = Counter(), {}
    for i, t, _ in rows:
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        base = sum(math.log10((counts[0][w,] + 1) / (total + words + 1)) for w in tokens(t))
        want[(str(i), held, len(tokens(t)), sum(counts[0][w,] > 0 for w in tokens(t)), round(base, 3))] += 1
        padded, logs = ["<b>"] * (order - 1) + tokens(t), 0.0
        for at in range(order - 1, len(padded)):
            p = (floored(counts[0][padded[at],]) + 1) / (total + words + 1)
            for n in range(1, order):
                before = tuple(padded[at - n : at])
                h = begins if before[-1] == "<b>" else floored(counts[n - 1][before])
                both = min(floored(counts[n][before + (padded[at],)]), floored(counts[n - 1][before[1:] + (padded[at],)]), h)
                prior = LM.PRIOR * h**LM.POWER + 1 if n == 1 else LM.LONG_PRIOR
                p = (both + prior * p) / (h + prior)
            logs += math.log10(p)
        exact[str(i), t] = logs
    got = LM.score(K.frame(spark, rows), **options).collect()
    assert Counter((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 3)) for r in got) == want
    assert {r.train_tokens for r in got} == {total}
    plain = sorted((str(i), len(tokens(t)), exact[str(i), t]) for i, t, _ in rows)
    scored = sorted((str(r.doc_id), r.n_tokens, r.score) for r in got)
    off = [abs(a - b) / n for (_, n, a), (_, _, b) in zip(plain, scored, strict=True)]
    # of bigrams that were never seen one in 64 passes six probes, and makes its word 100 to 10,000 times likelier
    assert sum(off) / len(off) < 0.05


def test_shards_and_segments_do_not_change_scores(spark):
    docs = K.frame(spark, K.documents())
    one, many = (sorted(map(str, LM.score(docs, segment_grams=2_000, shard_bytes=b).collect())) for b in (1 << 30, 10_000))
    assert one == many


def test_a_model_of_the_whole_corpus_tells_a_second_copy(spark):
    """A held-out document whose copy is learned from scores far above its like, and one that occurs twice above those that occur once."""
    rng, tail = random.Random(4), lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    held, learned = [i for i in range(3000) if tail(i)], [i for i in range(3000) if not tail(i)]
    texts = {i: K.sentence(rng, 80) for i in held[:40] + learned[:200]}
    rows = [(i, t, "s") for i, t in texts.items()] + [(learned[300 + k], texts[i], "s") for k, i in enumerate(held[:20] + learned[:20])]
    mean = {r.doc_id: r.score / r.n_tokens for r in LM.score(K.frame(spark, rows)).collect()}
    assert min(mean[i] for i in held[:20]) > max(mean[i] for i in held[20:40])
    assert sum(mean[i] > max(mean[j] for j in learned[20:200]) for i in learned[:20]) >= 18


def test_lm_without_training_rows(spark):
    assert LM.score(K.empty(spark)).count() == 0
    got = LM.score(K.frame(spark, [(1, "a b", "s")]), held_out=F.lit(True)).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (3, 0, 0, 0.0)


def test_filter_never_forgets_and_rarely_invents():
    rng, bits = np.random.default_rng(0), 5
    h = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2))
    c = rng.integers(1, 200, len(h))
    h = LM._marked(h, False) | (np.arange(len(h)) % 2).astype(np.uint64)
    order = (h >> np.uint64(64 - bits)).astype(int)
    built = [(int(s), LM.build_segment(LM._rest(h[order == s], bits), c[order == s])) for s in np.unique(order)]
    bloom = LM.Filter.of(bits, 0, 1 << bits, iter(built), sum(len(b) for _, b in built))
    level = bloom.level(h)
    assert (level >= LM.levels(c)).all() and (level == LM.levels(c)).mean() > 0.8
    other = X.mix(h)
    assert (bloom.level(LM._marked(other, False)) > 0).mean() < 0.025 and (bloom.level(LM._marked(other, True)) > 0).mean() < 0.08
    half = LM.Filter.of(bits, 16, 1 << bits, iter(built[16:]), sum(len(b) for _, b in built[16:]))
    assert (half.level(h) == np.where(order >= 16, level, 0)).all()
    assert LM.levels(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4]


def test_segments_follow_the_corpus():
    assert [LM.segment_bits(n, 3, 1 << 20) for n in (0, 1000, 1 << 20, 71_000_000, 10**13)] == [1, 1, 2, 8, 25]


def rules(rows, limit, percent=0, min_left=0.5):
    hosts, sizes = {}, {}
    plain = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", K.lowered(x)).strip(" ")
    for i, t, s in rows:
        sizes.setdefault(s, set()).add((i, t))
        for x in (t or "").split("\n"):
            if K.spaced(x):
                hosts.setdefault((s, plain(x)), set()).add((i, t))
    above = {k for k, held in hosts.items() if len(held) > limit and 100 * len(held) > percent * len(sizes[k[0]])}
    out = []
    for i, t, s in rows:
        w, lines = K.spaced(t), [x for x in (t or "").split("\n") if K.spaced(x)]
        runs = Counter(tuple(w[p : p + 3]) for p in range(len(w) - 2))
        again = {q for p in range(len(w) - 2) if runs[tuple(w[p : p + 3])] > 1 for q in range(p, p + 3)}
        left = len(w) - sum(len(K.spaced(x)) for x in lines if (s, plain(x)) in above)
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        out.append((str(i), len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(again), failed, left, not failed and left >= min_left * len(w)))
    return sorted(out)


def test_quality_rules_against_brute_force(spark):
    rng = random.Random(5)
    banner = K.sentence(rng, 30)
    rows = K.documents() + [(700 + i, f"{K.sentence(rng, 40 - i)}\n {banner.upper()} \n{banner}", "s1") for i in range(12)] + [(720, f"{banner}\n{K.sentence(rng, 60)} #| 𝄞", None)]
    docs = K.frame(spark, rows)
    for few in (10**6, 0):  # broadcast, and shuffle join
        for percent, min_left in ((0, 0.5), (20, 0.9)):
            got = R.judge(docs, max_docs=5, percent=percent, min_left=min_left, broadcast_lines=few).collect()
            assert sorted((str(r.doc_id), *r[1:]) for r in got) == rules(rows, 5, percent, min_left)
    clean = R.clean(docs, max_docs=5, percent=0, min_left=0.5)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(i for i, *_, kept in rules(rows, 5) if kept)
    assert not any(banner in r.text.lower() for r in clean.where("source = 's1'").collect())
    assert R.judge(K.empty(spark)).count() == 0 and R.clean(K.empty(spark)).count() == 0


def test_copies_count_as_documents_and_the_limit_grows_with_the_host(spark):
    banner, rng = "one line of a host that all of its pages share", random.Random(2)
    texts = [f"{K.sentence(rng, 60)}\n{banner}" for _ in range(6)]
    rows = [(i, texts[i // 2], "pairs") for i in range(12)] + [(50, texts[0], "once")] * 12 + [(60 + i, texts[i], "few") for i in range(6)]
    cut = lambda rows, **options: {(r.doc_id, r.n_words - r.n_left) for r in R.judge(K.frame(spark, rows), **options).collect()}
    assert cut(rows, max_docs=8) == {(i, 11) for i in range(12)} | {(50, 0)} | {(60 + i, 0) for i in range(6)}
    rows = [(i, texts[i % 6], "large") for i in range(9)] + [(i, K.sentence(rng, 60), "large") for i in range(9, 90)]
    assert {n for i, n in cut(rows, percent=9) if i < 9} == {11} and {n for _, n in cut(rows, percent=10)} == {0}


def test_the_method_itself_rejects_documents(spark):
    rows = queries.op7_quality_rules(spark, SF.replace("0.001", "0.01")).collect()
    assert sum(r.n_left < r.n_words for r in rows) > 50 and any(not r.kept and not r.base_failed for r in rows)
    assert sum(r.base_failed or r.kept for r in rows) > 0.99 * len(rows)


def test_long_repetitive_text_is_handled(spark):
    docs = K.frame(spark, [(1, "a b " * 100_000, "s")])
    assert R.judge(docs).first().n_repeat_words == 200_000


def licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", K.lowered(text))
    base = [(p, label) for phrase, label in LS.PHRASES for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
    labels, best = {x for _, x in base}, 0.0
    for line in (text or "").split("\n"):
        own = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", K.lowered(line)))
        for template, label in LS.TEMPLATES:
            t = set(template.split())
            share = len(t & own) / len(t)
            if share >= LS.THRESHOLD - 1e-9:
                labels.add(label)
                best = max(best, share)
    places = [p for p, _ in base]
    return len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1.0 if base else best


def test_licenses_against_brute_force(spark):
    rng = random.Random(3)
    rows = K.documents()
    for i, (template, _) in enumerate(LS.TEMPLATES * 3):
        words = template.split() + K.sentence(rng, rng.randint(0, 6)).split()
        rng.shuffle(words)
        if i >= len(LS.TEMPLATES):
            words = words[: max(1, len(words) - rng.randint(0, 4))]
        rows.append((800 + i, f"{K.sentence(rng, 5)}\n{' '.join(words).upper()}\n", "s"))
    rows += [(900, "CC-BY cc\nby, General  Public\nLicense ALL rights reserved all rights reserved", "s"), (901, "the gnu of in", "s")]
    want = sorted(((str(i), *licenses(t)) for i, t, _ in rows), key=str)
    got = LS.digest(LS.scan(K.frame(spark, rows))).collect()
    assert sorted(((str(r.doc_id), *r[1:]) for r in got), key=str) == want
    assert LS.digest(LS.scan(K.empty(spark))).count() == 0


BSD = "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided"
GPL = "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public\n# License as published by"


def test_wrapped_license_statements(spark):
    once = BSD.replace("\n", " ")
    texts = [BSD, f"x\n{GPL}", f"the of\n{once}\nand use in", f"{BSD}\n{BSD}", BSD.replace("\n", "\n" + "other " * 8), "Permission is hereby granted, free of charge, to any\nperson obtaining\na copy of this software", BSD.split("\n")[0], BSD.split("\n")[1]]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(90, None, "s"), (91, "", "s")]
    got = {r.doc_id: [(b.line, b.label) for b in r.blocks] for r in LS.scan(K.frame(spark, rows)).collect()}
    assert got == {0: [(0, "bsd")], 1: [(1, "gpl"), (2, "gpl")], 2: [(1, "bsd")], 3: [(0, "bsd"), (2, "bsd")], 4: [], 5: [(0, "mit")], 6: [], 7: [], 90: [], 91: []}


def test_wrapped_licenses_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i, (template, _) in enumerate(LS.TEMPLATES * 12):
        words = template.split()
        for _ in range(rng.randint(0, 3)):
            words.insert(rng.randrange(len(words)), rng.choice(["is", "of", "the", "zzz", "this"]))
        del words[rng.randrange(len(words)) : rng.choice([0, len(words)])]
        text = " ".join([*K.sentence(rng, rng.randint(0, 9)).split(), *words, *rng.choice(LS.TEMPLATES)[0].split()])
        rows.append((i, re.sub(" ", lambda m: rng.choice([" ", " ", "\n"]), text), "s"))
    met = 0
    got = {r.doc_id: r for r in LS.scan(K.frame(spark, rows), phrases=()).collect()}
    for i, text, _ in rows:
        words, best = text.split(), {}
        for template, label in LS.TEMPLATES:
            t, span = set(template.split()), math.ceil(len(template.split()) / LS.THRESHOLD)
            lines = [n for n, x in enumerate(text.split("\n")) for _ in x.split()]
            blocks = [x.split() for x in text.split("\n")] + [words[p : p + span] for p in range(len(words)) if lines[p] < lines[min(p + span, len(words)) - 1]]
            share = max(len(t & set(x)) / len(t) for x in blocks)
            if share >= LS.THRESHOLD - 1e-9:
                best[label] = max(best.get(label, 0.0), share)
        own = {}
        for b in got[i].blocks:
            own[b.label] = max(own.get(b.label, 0.0), b.containment)
        assert own == pytest.approx(best)
        met += any(not any(len(set(t.split()) & set(x.split())) >= LS.THRESHOLD * len(set(t.split())) for x in text.split("\n") for t, y in LS.TEMPLATES if y == label) for label in best)
    assert met > 20


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_agree_with_sql(spark, name):
    agree(spark, queries.queries()[name], queries.oracle_sql()[name])
