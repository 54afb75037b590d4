"""URL rules and the template tree against a plain tree."""

import random
import re
from collections import Counter, defaultdict

from helpers import agree

from ledgerloom.llm import queries as Q, url_templates as U

SCHEMA = "page_id bigint, url string, host string, path string, rule int, label int, seg string, n int, `a.b` int, `x``y` int"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path, rules):
    best = None
    for what, text in rules:
        own, start = text.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start) and (best is None or (len(text), what == "block") > (len(best[1]), best[0] == "block")):
            best = (what, text)
    return best or (None, None)


def chi(a, b, parts):
    na, nb = a["n"], b["n"]
    return sum((f(a) * nb - f(b) * na) ** 2 / ((f(a) + f(b)) * na * nb) for f in parts if f(a) + f(b))


LABELS = [lambda x: x["good"], lambda x: x["bad"], lambda x: x["n"] - x["good"] - x["bad"]]
FOLLOWS = [lambda x: x["ends"], lambda x: x["wild"], lambda x: x["n"] - x["ends"] - x["wild"]]


def grow(rows, prior, d, out, at=""):
    """rows: (segments, label, index) of one node; out gets template and purity by index."""
    ending = [r for r in rows if len(r[0]) <= d]
    for r in ending:
        out[r[2]] = at, prior
    rows = [r for r in rows if len(r[0]) > d]
    seen = Counter(r[0][d] for r in rows)
    kids = defaultdict(list)
    for r in rows:
        s = r[0][d]
        kids[s if seen[s] >= U.MIN_ROWS and seen[s] * U.LITERALS >= len(rows) else "*"].append(r)
    stats = []
    for name, own in kids.items():
        x = Counter(n=len(own), good=sum(r[1] == 1 for r in own), bad=sum(r[1] == 0 for r in own), ends=sum(len(r[0]) == d + 1 for r in own), wild=sum(len(r[0]) > d + 1 and "*" in r[0][d + 1] for r in own))
        stats.append(((x["good"] - x["bad"]) / x["n"], name, x, own))
    groups = []
    for _, name, x, own in sorted(stats, key=lambda s: s[:2]):
        if groups and chi(groups[-1][1], x, LABELS) <= U.CRITICAL and chi(groups[-1][1], x, FOLLOWS) <= U.CRITICAL:
            names, y, have = groups.pop()
            groups.append(([*names, name], y + x, have + own))
        else:
            groups.append(([name], x, own))
    for names, x, own in groups:
        grow(own, (x["good"] + U.STRENGTH * prior) / (x["good"] + x["bad"] + U.STRENGTH), d + 1, out, f"{at}/{'|'.join(names)}")


def brute(urls, rules=U.RULES, depth=U.DEPTH):
    hosts, verdicts = defaultdict(list), {}
    for i, url in enumerate(urls):
        host, path = parts(url)
        said, rule = rule_of(host, path, rules)
        segments = re.findall("[^/]+", re.sub("[0-9]+", "*", path))
        segments = segments[:depth] + ["*"] * (len(segments) > depth)
        hosts[host].append((segments, {"allow": 1, "block": 0}.get(said), i))
        verdicts[i] = host, path, rule, said
    out = {}
    for rows in hosts.values():
        good, bad = (sum(r[1] == k for r in rows) for k in (1, 0))
        grow(rows, (good + U.STRENGTH * 0.5) / (good + bad + U.STRENGTH), 0, out)
    return {i: (h, p, r, s or ("block" if out[i][1] < U.MIN_PURITY else "allow")) for i, (h, p, r, s) in verdicts.items()}, out


def urls(n=1500):
    rng = random.Random(3)
    words = [f"slug-{w}" for w in "abcdefghijklmnopqrstuvwxyz"] + ["a", "b", "c"]
    out = []
    for _ in range(n):
        host = rng.choice(["a.net", "B.net", "c.net", "x.example.com", "www.example.com", "y.org", "big.net", "big.net", "big.net"])
        path = rng.choice(["/es/%d", "/fr/%d", "/en/%d", "/de/%d.html", "/en/%d/", "/news/{}/%d", "/t/{}", "/t/{}/x/y/z/%d", "/{}-%d/q", "", "/", "//es//%d"])
        path = path.replace("{}", rng.choice(words)).replace("%d", str(rng.randrange(900)))
        out.append(f"{rng.choice(['http', 'https'])}://{host}{path}{rng.choice(['', '', '?q=/es/', '#top', '?a://b'])}")
    out += [f"http://big.net/tag/{rng.random()}x{i}" for i in range(300)] + ["http://big.net/es/1"] * 200
    return out + [None, "", "no scheme", "ftp://", "x://HOST", "http://net/es/", "http://es.net/es/x", "http://notnet/es/1", "http://a.net/ES/1", "http://a.net/é/1", "http://a.net/" + "z/" * 5000, "http://a.net/*/1"]


def test_against_a_plain_tree(spark):
    rows = urls()
    rules = (*U.RULES, ("allow", "big.net/tag/"), ("block", "big.net/t/"), ("allow", "big.net/t/"))
    for rule_set in (U.RULES, rules):
        want, tree = brute(rows, rule_set)
        pages = spark.createDataFrame([(i, u, "h", "p", 1, 2, "s", 3, 4, 5) for i, u in enumerate(rows)], SCHEMA)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, rules=rule_set).collect()}
        assert got == want
        judged = Counter(v for _, _, r, v in want.values() if r is None)
        assert judged["allow"] > 50 and judged["block"] > 50
        assert any("|" in t for t, _ in tree.values()) and any(t.count("/") > U.DEPTH for t, _ in tree.values())


def test_odd_tables(spark):
    assert U.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = spark.createDataFrame([(None, None, "h", "p", 1, 2, "s", 3, 4, 5)] * 3, SCHEMA)
    assert [tuple(r) for r in U.judge(nothing).collect()] == [(None, "", "", None, "allow")] * 3


def test_query_agrees_with_sql_on_many_pages(spark):
    agree(spark, Q.queries()["op11_url_filters"], Q.oracle_sql()["op11_url_filters"], "/root/testdata/sf0.1")
