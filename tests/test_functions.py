"""Column functions against plain Python on fixtures and generated text."""

import base64 as b64
import hashlib
import random
import re
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import fixed, fuzzy, html, scores as S, text as T, urls as U
from ledgerloom.operators import pages as P
from ledgerloom.operators import matching as M
from ledgerloom.plans import pages as plans


def values(spark, column, rows, *names):
    names = names or ("a",)
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names))
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


URLS = ["HTTPS://Example.com//a//b/?x=1#f", "http://e.com", "http://e.com/", " https://e.com/a/b/// ", "not a url  At all", "", None, "https://E.com:8080/P?utm_source=a&ref=b%20c&Gclid=1&q=", "https://e.com/a?x=%7E*&y=ü", "ftp://e.com/x"]


def plain_canonical(url):
    raw = (url or "").strip()
    parts = urlsplit(raw)
    if parts.scheme not in ("http", "https"):
        return " ".join(raw.lower().split())
    path = re.sub("/+", "/", parts.path or "/")
    return urlunsplit((parts.scheme, parts.netloc.lower(), path.rstrip("/") or "/", "", ""))


def plain_stripped(url):
    raw = (url or "").strip()
    parts = urlsplit(raw)
    if parts.scheme not in ("http", "https"):
        return raw
    query = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not k.lower().startswith(fixed.TRACKING_PREFIXES)]
    return urlunsplit((parts.scheme, parts.netloc.lower(), re.sub("/+", "/", parts.path or "/"), urlencode(query), ""))


def test_urls_as_the_standard_library(spark):
    assert values(spark, U.canonical(F.col("a")), URLS) == [plain_canonical(u) for u in URLS]
    assert values(spark, U.stripped(F.col("a")), URLS) == [plain_stripped(u) for u in URLS]


def test_url_variants_share_a_key(spark):
    links = ["https://e.com/jobs/1?utm_source=a", "https://e.com/jobs/1?gclid=9", "https://e.com/jobs/1/", "https://e.com/jobs/1?ref=z"]
    keys = values(spark, U.stable_key(F.lit("AI Engineer"), F.lit("X"), F.col("a")), links)
    assert keys[0] == keys[1] and keys[3] != keys[0]
    assert len(set(values(spark, U.canonical(F.col("a")), links))) == 1
    assert values(spark, U.posting_hash(F.lit(" ACME  Ltd"), F.lit("AI-Engineer (Remote)"), F.lit("N/A"), F.col("a")), ["https://e.com/x?y=1"]) == [
        hashlib.sha256(f"acme ltd|ai engineer|url-{hashlib.sha1(b'https://e.com/x').hexdigest()[:8]}|https://e.com/x".encode()).hexdigest()
    ]


def test_redirects(spark):
    links = ["https://duckduckgo.com/l/?uddg=https%3A%2F%2Fe.com%2Fa%3Fb%3D1", "https://www.bing.com/ck/a?x=1&u=a1aHR0cHM6Ly9lLmNvbS9q", "https://www.google.com/url?q=https%3A%2F%2Fe.com%2F&s=1", "https://e.com/a#top", "mailto:x@e.com", ""]
    assert values(spark, U.unwrapped(F.col("a")), links) == ["https://e.com/a?b=1", "https://e.com/j", "https://e.com/", "https://e.com/a", "", ""]


def test_redirects_coded_in_lines(spark):
    long = ["https://www.cheap-pills.example.com/en/9883?utm_source=feed", "https://e.com/" + "é" * 90]
    links = [f"https://www.bing.com/ck/a?x=1&u=a1{b64.urlsafe_b64encode(x.encode()).decode().rstrip('=')}" for x in long]
    lines = [f"https://www.bing.com/ck/a?x=1&u=a1{b64.encodebytes(x.encode()).decode().rstrip().rstrip('=').translate(str.maketrans('+/', '-_'))}" for x in long]
    assert all("\n" in x for x in lines)
    assert values(spark, U.unwrapped(F.col("a")), links + lines + [x.replace("\n", "\r\n") for x in lines]) == long * 3


def test_unwrapped_pages_with_long_urls_agree_with_sql(spark, tmp_path):
    rows = [(i, f"https://www.{'long' * (i % 30)}.example.com/en/{i}?x=1#top") for i in range(240)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    query, sql = plans.QUERIES["unwrap_redirects"]
    got = {r.page_id: r.target for r in query(spark, str(tmp_path)).collect()}
    want = duckdb.connect().sql(sql.replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert got == dict(want) and len(got) == 240


def test_company_names(spark):
    links = ["https://jobs.lever.co/acme-labs/1", "https://jobs.careem.com/x", "https://10pearls.com/careers", "https://acme.breezy.hr/p/1", "https://e.com/?company=Big%20Co", ""]
    assert values(spark, U.company_name(F.lit(""), F.col("a")), links) == ["Acme Labs", "Careem", "10Pearls", "Acme", "E", "Unknown"]
    assert values(spark, U.company_from_url(F.col("a")), links)[:5] == ["acme-labs", "careem", "10pearls", "acme", "Big Co"]
    assert values(spark, T.title_case(F.col("a")), ["o'neil-smith 3m x", "élan vital", ""]) == ["O'Neil-Smith 3M X", "Élan Vital", ""]


def test_pages_and_hosts(spark):
    assert values(spark, U.next_page(F.col("a")), ["https://e.com/?page=2&x=1", "https://e.com/?offset=20", "https://e.com/j", "https://e.com/j?x=1#f"]) == ["https://e.com/?page=3&x=1", "https://e.com/?offset=21", "https://e.com/j?page=2", "https://e.com/j?x=1&page=2#f"]
    pairs = [("a.e.com", "b.e.com"), ("e.com", "jobs.lever.co"), ("e.com", "f.com"), ("e.com", "")]
    assert values(spark, U.related(F.col("a"), F.col("b")), pairs, "a", "b") == [True, True, False, False]
    assert values(spark, U.resolved(F.lit("https://E.com/a/b?x#y"), F.col("a")), ["c", "/c", "//f.com/c", "?q=1", "http://g.com", "mailto:x"]) == ["https://E.com/a/c", "https://E.com/c", "https://f.com/c", "https://E.com/a/b?q=1", "http://g.com", "mailto:x"]


WORDS = ["Élead dev", "lead dev", "Sr. Engineer", "mislead", "junior-lead", "LEAD", "", None, "leadé", "5+ years", "15 years", "naïve C++"]


def test_word_boundaries_are_unicode(spark):
    got = values(spark, T.has_word(F.col("a"), ("lead", "sr.")), WORDS)
    assert got == [any(re.search(rf"\b{re.escape(w)}\b", (x or "").lower()) is not None for w in ("lead", "sr.")) for x in WORDS]
    assert values(spark, T.match_title(F.col("a")), WORDS) == [" ".join(re.sub(r"[^\w\s]", " ", (x or "").lower()).split()) for x in WORDS]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB1 é-|/()[]{}.\t\n", max_size=25), min_size=1, max_size=20))
def test_titles_as_plain_python(spark, titles):
    def plain(x):
        x = re.sub(r"\s+", " ", x.strip().lower())
        x = re.sub(r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", " ", x)
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", re.sub(r"[|\-/]+", " ", x))).strip()

    assert values(spark, T.normal_title(F.col("a")), titles) == [plain(x) for x in titles]


def test_title_rules(spark):
    titles = ["Associate AI Engineer", "AI Engineer", "Senior Associate Software Engineer", "Entry Level Software Engineer", "Fresh Graduate", "Data Modernization | Services", "1234", "Sr. Software Engineer", "Sr. Associate Engineer"]
    assert values(spark, M.strict_policy(F.col("a")), titles) == [True, False, False, False, True, False, False, False, False]
    assert values(spark, M.role_title(F.col("a")), titles)[:7] == [True, True, True, True, True, False, False]
    assert values(spark, M.senior_role(F.col("a"), F.lit("")), titles) == [False, False, False, False, False, False, False, True, False]
    assert values(spark, M.exclusion(F.col("a"), F.lit("needs 7 yrs")), ["VP of X", "Dev"]) == ["title contains 'vp'", "description contains '7 yrs'"]
    assert values(spark, M.level(F.col("a"), F.lit("5 years"))["confidence"], ["Junior Dev", "Dev"]) == [55, 90]


def test_roles_and_semantic_gate(spark):
    df = spark.createDataFrame([(1, "Associate AI Engineer", "python sql"), (2, "Junior Software Engineer", ""), (3, "AI Engineer", ""), (4, None, None), (5, "Associate Softwear Engineer", "")], "pos int, title string, description string")
    got = {r.pos: (r.matched, r.matched_role, r.match_score) for r in M.match_roles(df).collect()}
    assert got[1][:2] == (True, "AI Engineer") and got[1][2] == 99.0 and got[2] == (True, "Junior Software Engineer", 100.0) and not got[3][0] and got[4] == (False, None, 0.0)
    loose = {r.pos: r.match_score for r in M.match_roles(df, strict=False).collect()}
    assert loose[3] == 100.0 and loose[5] > 85
    gate = M.match_roles(df, semantic=lambda t, d: F.lit(False)).where("matched").count()
    assert gate == 2  # short descriptions and exact roles pass
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("d", [0.0, 0.0])], "id string, vector array<double>")
    out = {r.id: (r.best, r.passes) for r in M.semantic_gate(vectors, spark.createDataFrame([([1.0, 0.0],)], "vector array<double>")).collect()}
    assert out == {"a": (1.0, True), "b": (0.0, False), "c": (None, True), "d": (-1.0, False)}


def test_qualify_reports_the_first_gate(spark):
    rows = [("1", "Junior Data Scientist", "graduate", None), ("2", "Senior Data Scientist", "graduate", None), ("3", "Cook", "graduate", None), ("4", "Data Scientist", "none", None), ("5", "Data Scientist", "graduate", "1990-01-01T00:00:00Z"), ("", "", "", None)]
    df = spark.createDataFrame([(i, t, d, p, "") for i, t, d, p in rows], "job_id string, job_title string, job_description string, job_posted_at_datetime_utc string, job_apply_link string")
    got = {r.job_id: r.reject_reason for r in M.qualify(df, ("Data Scientist",), ("graduate",), F.lit("2024-01-02").cast("timestamp")).collect()}
    assert got == {"1": None, "2": "title contains 'senior'", "3": "no target title", "4": "no inclusion keyword", "5": "too old", "": "empty"}


def test_scores(spark):
    assert values(spark, S.clamped(F.col("a"), 7), ["5.9", "-3", "1e9", "x", None, "NaN"]) == [5, 0, 100, 7, 7, 7]
    assert values(spark, S.blended(F.lit(50), F.col("a").cast("int")), ["95", "55"]) == [77, 53]
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    assert values(spark, S.is_recent(F.col("a"), now), ["2024-01-05T01:02:03.123Z", "2023-12-01", "soon", None]) == [True, False, True, True]
    assert values(spark, S.days_ago(F.col("a"), now), ["2024-01-10", "2024-01-09", "2024-01-04", "2024-01-01", "2023-12-20", "x"]) == ["today", "1 day ago", "6 days ago", "1 week ago", "3 weeks ago", ""]
    assert values(spark, T.posted_date(F.col("a")), ["on 2024-02-03 x", "3 March 2024", "Mar 3, 2024", "no"]) == ["2024-02-03", "3 March 2024", "Mar 3, 2024", ""]


@pytest.mark.parametrize(("a", "b", "want"), [("ai engineer", "ai engineer", 100), ("senior ai engineer", "ai engineer", 100), ("", "x", 0), ("abcd", "wxyz", 0)])
def test_token_set(a, b, want):
    assert fuzzy.token_set(a, b) == want == fuzzy.token_set(b, a)


@given(st.text(alphabet="abc ", max_size=12), st.text(alphabet="abc ", max_size=12))
def test_ratio_is_the_indel_similarity(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert fuzzy.ratio(a, b) == (round(200 * table[-1][-1] / (len(a) + len(b))) if a and b else 0)


PAGE = """<html><head><title>Careers at Acme</title></head><body><nav class="main-nav"><div class="job-card"><a href="/jobs/0">Lead Engineer</a></div></nav>
<ul><li class="job"><h2 class="job-title">Data Engineer</h2><span class="location">Lahore</span><a class="apply-btn" href="/jobs/1?utm_source=x">Apply</a><time datetime="2024-02-03T00:00">x</time></li>
<li class="job"><h2 class="job-title">Data Engineer</h2><a href="/jobs/1">Apply</a></li><li class="job"><h2 class="job-title">Our Services Platform</h2><a href="/jobs/2">x</a></li></ul>
<script type="application/ld+json">{"@graph": [{"@type": ["Thing", "JobPosting"], "title": "QA Analyst", "url": "/jobs/7"}, {"@type": "Person"}]}</script>
<script type="application/ld+json">not json</script></body></html>"""


def page_frame(spark, *pages):
    return spark.createDataFrame([(f"https://careers.acme.com/{i or 'list'}", p) for i, p in enumerate(pages)], "url string, html string")


def test_html_postings(spark):
    df = page_frame(spark, PAGE, None, "<li class=job><a href='/jobs'>")
    found = P.postings(df).collect()
    assert [(p.title, p.link, p.location, p.posted_date, p.company, p.type) for p in found] == [("Data Engineer", "https://careers.acme.com/jobs/1", "Lahore", "2024-02-03", "Acme", "Not specified")]
    assert [(r.title, r.link) for r in P.openings(df).collect()] == [("Data Engineer", "https://careers.acme.com/jobs/1"), ("QA Analyst", "https://careers.acme.com/jobs/7")]
    assert values(spark, html.page_title(F.col("a")), [PAGE, "", None]) == ["Careers at Acme", "", ""]
    blog = spark.createDataFrame([("https://e.com/blog", PAGE.replace("Careers at ", ""))], "url string, html string")
    assert P.postings(blog).count() == 0


def test_containers_without_known_selectors_are_the_boxes_of_titles(spark):
    page = "<div class=x><h3>Data Engineer</h3><p>Contract, Lahore, Pakistan</p><a href='../jobs/1'></a></div><footer class=footer><h3>Lead Engineer</h3><a href=/jobs/2>x</a></footer><a href='/jobs/3'>Backend Developer</a>"
    got = {(p.title, p.link, p.type) for p in P.postings(page_frame(spark, page)).collect()}
    assert got == {("Data Engineer", "https://careers.acme.com/../jobs/1", "Contract"), ("Backend Developer", "https://careers.acme.com/jobs/3", "Not specified")}


def test_selectors():
    root = html.parse("<div class='a b' id=i><ul class=jobs-list><li><p data-x='One Two'>t</p></li></ul></div><p>u</p>")
    count = lambda spec: len(list(html.every(root, spec)))
    assert [count(s) for s in ("p", "div.a.b", "#i p", "div > p", ".jobs-list > *", ".jobs-list *", "[data-x*='one t' i]", "[data-x*='one t']", "ul li p", "span")] == [2, 1, 1, 0, 1, 2, 1, 0, 1, 0]


def test_descriptions_of_postings(spark):
    ld = lambda kind, text, key="description": f'<script type="application/ld+json">{{"@type": {kind}, "{key}": "{text}"}}</script>'
    long, menu = "We build data tools. " * 11, "<nav>" + "<a href=/x>Some menu entry</a>" * 20 + "</nav>"
    text = long.strip()
    cases = [
        (ld('"Organization"', long) + menu, ""),  # not a posting
        (ld('"Organization"', "x" * 130) + ld('["Thing", " JobPosting "]', f"<b>{long}</b>apply NOW", "jobDescription"), text + " "),
        (f"{menu}<div class='x Job-Description y'>{long}<script>no</script><noscript>no</noscript></div>", text),
        (f"{menu}<div id=job-description>short</div><div class=description>{long}</div>", text),
        (f"{menu}<article class=job>{long}</article><div role=main>{long * 2}</div>", text),
        (f"{menu}<div id=job-description>{'z' * 199}</div>", ""),
        (f"<div class=other>{long}</div>", ""),  # long, but without a phrase of postings
        (f"<div>Job summary: {long} Related jobs: none</div>", f"Job summary: {text} "),
        ("<div>Job summary: short</div>", ""),
        (None, ""),
    ]
    df = page_frame(spark, *[x for x, _ in cases])
    got = {r.url: r for r in P.descriptions(df).collect()}
    assert [got[r.url].description for r in df.collect()] == [x for _, x in cases]
    cut = {r.url: r.description for r in P.descriptions(df, most=150).collect()}
    assert [cut[r.url] for r in df.collect()] == [x[:150] if len(x) >= 120 else "" for _, x in cases]


def test_dates_of_details(spark):
    pages = ["<time>2024-01-01</time><time datetime='x'></time><time data-posted='on 2024-02-03 10:00'></time>", "<p>since 2023-05-06</p><script>2020-01-01</script>", "none"]
    assert [r.posted_date for r in P.descriptions(page_frame(spark, *pages)).orderBy(F.length("url"), "url").collect()] == ["2023-05-06", "", "2024-02-03"]


def test_handoff_links(spark):
    page = """<a href="#x">a</a><a href="/jobs/1">b</a><button onclick="go('/apply/2'); open('https://jobs.lever.co/3')">c</button><a href="https://other.org/jobs">d</a><div data-link="/JOBS/1"></div>
    <a href="/about">e</a><script>x = 'https://boards.greenhouse.io/acme%20co'; location.assign("/careers/4"); location.href = '/vacancies'</script><a href="mailto:jobs@x">f</a>"""
    got = [r.link for r in P.handoff_links(page_frame(spark, page), most=9).orderBy("n").collect()]
    base = "https://careers.acme.com"
    assert got == [f"{base}/jobs/1", "https://jobs.lever.co/3", f"{base}/apply/2", f"{base}/about", "https://boards.greenhouse.io/acme co", f"{base}/careers/4", f"{base}/vacancies"]
    assert P.handoff_links(page_frame(spark, page), most=2).count() == 2


def test_search_results(spark):
    page = """<div class="result"><a class="result__a" href="https://duckduckgo.com/l/?uddg=https%3A%2F%2Fa.com%2Fjobs%23x"> A  b </a><div class="result__snippet">s</div></div>
    <div class="result"><h2 class="result__title"><a href="https://a.com/jobs">a B</a></h2></div><div class="result"><a class="result__a" href="/x">c</a></div>"""
    df = spark.createDataFrame([("q", page)], "query string, html string")
    assert [tuple(r) for r in P.search_results(df, "duckduckgo").collect()] == [("q", 1, "A b", "https://a.com/jobs", "s", "duckduckgo")]
    assert P.search_results(df, "bing").count() == 0
    google = spark.createDataFrame([("q", "<div class=yuRUbf><a href=https://g.com/jobs></a><h3>T</h3><span class=aCOpRe>s</span></div>")], "query string, html string")
    assert [(r.title, r.snippet) for r in P.search_results(google, "google").collect()] == [("T", "s")]


def test_meta_description(spark):
    cases = [
        ("<meta name=keywords content=no><META content=' A &amp; B > C ' Name='Twitter:Description'><meta name=description content=later>", "A & B > C"),
        ("<!-- <meta name=description content=no> --><meta name=description><meta name=description content=x>", ""),
        (PAGE, ""),
        (None, ""),
    ]
    df = page_frame(spark, *[x for x, _ in cases])
    got = {r.url: r.meta_description for r in P.descriptions(df).collect()}
    assert [got[r.url] for r in df.collect()] == [x for _, x in cases]


@given(st.text(alphabet="abc ", max_size=9), st.text(alphabet="abc é", max_size=60), st.integers(0, 100))
def test_partial_ratio_is_the_best_window(a, b, least):
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    want = max((100 if short == long[i : i + len(short)] else fuzzy.ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1)), default=0) if short else 0
    assert fuzzy.partial(a, b) == want
    got = fuzzy.partial(a, b, least)
    assert got == want if want >= least else got < least


def test_partial_ratio_of_long_texts_is_linear():
    import random
    import time

    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    short, long = text(20_000), text(200_000)
    times = []
    for t in (short, long):
        began = time.perf_counter()
        assert fuzzy.partial("entry level role", t, 95) < 95
        times.append(time.perf_counter() - began)
    assert times[1] < 30 * times[0] + 0.5


def test_an_encoder_that_fails_leaves_rows_open(spark):
    from ledgerloom.functions import embed

    def broken():
        raise OSError("no model")

    def fussy():
        def encode(texts):
            raise ValueError("no texts")

        return encode

    df = spark.createDataFrame([(1, "Data Engineer", "python"), (2, None, None)], "id int, title string, description string")
    roles = spark.createDataFrame([("Data Engineer",)], "role string")
    for make in (broken, fussy):
        assert {(r.id, r.best, r.passes) for r in M.semantic_text_gate(df, roles, make).collect()} == {(1, None, True), (2, None, True)}
    got = {r.id: (round(r.best, 3), r.passes) for r in M.semantic_text_gate(df, roles, embed.hashing_encoder).collect()}
    assert got[1][1] and got[2] == (-1.0, False)
    assert {r.passes for r in M.semantic_text_gate(df, roles.limit(0), embed.hashing_encoder).collect()} == {True}


@pytest.mark.parametrize("least", [1, 45, 60, 90, 100])
def test_ratios_of_all_pairs_at_once(least):
    rng = random.Random(least)
    words = ("data", "engineer", "senior", "ai", "of", "x", "analyst", "analysts", "developper", "dev", "é", "日本", "a\0b", "\0", "😀x", "\ud800z")

    def title():
        own = [rng.choice(words) if rng.random() < 0.8 else "".join(rng.choice("abcdeé") for _ in range(rng.choice([1, 3, 9, 40, 70]))) for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 6, 20, 60]))]
        return rng.choice([" ", "  ", "\t"]).join(own)

    for n, m in ((270, 40), (1, 1), (0, 5), (5, 0)):
        one, two = [title() for _ in range(n)], [title() for _ in range(m)]
        got = sorted(zip(*(x.tolist() for x in fuzzy.pairs_alike(one, two, least)), strict=True))
        assert got == [(i, j, r) for i, a in enumerate(one) for j, b in enumerate(two) if (r := fuzzy.token_set(a, b)) >= least]
