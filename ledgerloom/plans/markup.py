"""Queries over pages that are built from the postings, so that SQL can tell what has to be found in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.operators import pages as P
from ledgerloom.plans.postings import _POSTING, _VALID, POSTS, SQUEEZE, _posts, has_part_sql

C, L = F.col, F.lit


def text(*parts):
    """The parts in a row; strings are literals, columns are text."""
    return F.concat(*[L(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _dealt(spark, pages):
    """Pages over all cores: their rows are small until they are built, and costly to parse."""
    return pages.repartition(spark.sparkContext.defaultParallelism)


def _site(spark, sf_dir):
    """Pages of four postings, each standing there twice, below a menu and with JSON-LD."""
    title = F.replace(F.replace(C("title"), L("&"), L("&amp;")), L("<"), L("&lt;"))
    place = F.when(F.trim("place") == "", "Onsite").otherwise(C("place"))
    kind = F.when(C("id") % 2 == 0, '<span class="job-type"> Contract </span>').otherwise("")
    item = text('<li class="job"><h2 class="job-title">', title, '</h2><span class="employer">', C("company"), '</span><span class="location">', place, "</span>", kind, '<a class="apply-btn" href="/jobs/', C("id") % 50, '?utm_source=x">go</a><time datetime="2024-02-', F.lpad((C("id") % 28 + 1).cast("string"), 2, "0"), 'T00:00">x</time></li>')
    rows = _posts(spark, sf_dir).select(F.expr("id div 4").alias("k"), "id", item.alias("item"))
    items = rows.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "item"))), lambda x: x["item"]), "").alias("items"))
    menu = '<html><head><title>Careers</title></head><body><nav class="nav"><div class="job-card"><h2 class="job-title">Lead Engineer</h2><a href="/jobs/menu">x</a></div></nav><ul>'
    graph = text('</ul><script type="application/ld+json">{"@graph": [{"@type": "Person", "title": "QA Lead"}, {"@type": ["JobPosting"], "title": "QA  Analyst ', C("k"), '", "url": "/jobs/ld', C("k"), '"}]}</script></body></html>')
    pages = items.select(text("https://careers.acme", C("k"), ".com/list").alias("url"), text(menu, C("items"), C("items"), graph).alias("html"))
    return _dealt(spark, pages)


def postings_from_html(spark, sf_dir):
    return P.postings(_site(spark, sf_dir))


def openings_from_html(spark, sf_dir):
    return P.openings(_site(spark, sf_dir))


def stated_openings(spark, sf_dir):
    """JSON-LD of postings as a node, in a list, in a graph within a list, beside other kinds, and as broken text."""
    title = F.replace(C("title"), L('"'), L("'"))
    node = lambda link, kind='"JobPosting"': text('{"@type": ', kind, ', "title": "', title, '", ', link, "}")
    blocks = (
        text('<script type="application/ld+json">', node(text('"url": "/jobs/a', C("id"), '"')), "</script>"),
        text("<SCRIPT async TYPE='x application/LD+JSON'>[[", node(text('"sameAs": " https://x', C("id"), '.com/jobs/b ", "url": ""'), '["Thing", " jobPosting "]'), '], {"@type": "JobPosting", "title": 7, "url": "/jobs/n"}]</SCRIPT>'),
        text('<script type=application/ld+json>{"@graph": [{"@type": "Person", "title": "QA Lead"}, {"@graph": [', node(text('"url": "/jobs/c', C("id"), '"')), ", ", node(text('"url": "/jobs/c', C("id"), '"')), "]}]}</script>"),
        text('<script type="application/ld+json">{not json', C("id"), '</script><script>{"@type": "JobPosting"}</script><script type="application/ld+json">', node('"url": "/jobs/d"'), "</script>"),
    )
    html = F.element_at(F.array(*blocks), (C("id") % 4 + 1).cast("int"))
    return P.stated_openings(_posts(spark, sf_dir).select(text("https://careers.acme", C("id"), ".com/list").alias("url"), html.alias("html")))


def openings_without_boxes(spark, sf_dir):
    """Pages without a known box: a title three or four elements below what holds its link, beside its link in a section, a link alone, and a title too far from its link."""
    title = F.replace(F.replace(C("title"), L("&"), L("&amp;")), L("<"), L("&lt;"))
    button = text('<button data-apply-url="/jobs/b', C("id"), '">Go</button>')
    shapes = (
        text("<main><span><b><i><h2>", title, "</h2></i></b></span>", button, "</main>"),
        text("<main><u><span><b><i><h2>", title, "</h2></i></b></span></u>", button, "</main>"),
        text("<section><p><b><h4>", title, "</h4></b></p>", button, "</section><div class='site-footer'><h3>Lead Data Engineer</h3><a href='/jobs/f'>x</a></div>"),
        text("<p><a href='/jobs/a", C("id"), "'>", title, "</a></p>"),
    )
    html = F.element_at(F.array(*shapes), (C("id") % 4 + 1).cast("int"))
    return P.openings(_posts(spark, sf_dir).select(text("https://careers.acme", C("id"), ".com/list").alias("url"), text("<html><head><title>Careers</title></head><body>", html, "</body></html>").alias("html")))


def posting_details(spark, sf_dir):
    """Details of pages with a description in JSON-LD, in a block, or none."""
    rows = _dealt(spark, _posts(spark, sf_dir))
    ld = F.when(C("id") % 3 == 0, text('<script type="application/ld+json">{"@type": "JobPosting", "description": "<p>', F.repeat(text(C("body"), " "), L(4)), 'Apply now</p>"}</script>')).otherwise("")
    html = text('<html><head><meta name="Description" content=" ', C("title"), ' "></head><body>', ld, '<div class="description">', F.repeat(text(C("body"), " "), L(5)), '</div><time datetime="2024-01-0', C("id") % 9 + 1, ' 10:00">x</time></body></html>')
    return P.descriptions(rows.select("id", html.alias("html")), key="id", most=150)


def handoff_links(spark, sf_dir):
    html = text('<a href="/jobs/', C("id"), """">x</a><button onclick="window.open('https://jobs.lever.co/""", C("id"), """')">y</button><a href="https://other.org/jobs">z</a><a href="/about">a</a><div data-link="/JOBS/""", C("id"), """"></div><script>location.href = '/vacancies/""", C("id") % 7, "'</script>")
    return P.handoff_links(_posts(spark, sf_dir).select(text("https://acme.com/c/", C("id")).alias("url"), html.alias("html")))


def pagination_links(spark, sf_dir):
    html = text('<a href="/jobs?page=', C("id"), '">2</a><a rel="next" href="?offset=10">older</a><a href="mailto:x">next</a><a href="#f">next</a><a href="/blog/next">next</a><a href="https://jobs.lever.co/acme">all</a><a href="https://other.org/x">next</a><a href="/jobs?page=', C("id"), '">again</a>')
    return P.pagination_links(_posts(spark, sf_dir).select(text("https://acme", C("id"), ".com/careers").alias("url"), html.alias("html")))


def search_results(spark, sf_dir):
    """Pages of three search engines, each with a result that repeats, one without a title and one that is no web address."""
    rows = _dealt(spark, _posts(spark, sf_dir))
    i, title, body = C("id"), C("title"), C("body")
    duck = text('<div class="result"><h2 class="result__title"><a class="result__a" href="https://duckduckgo.com/l/?uddg=https%3A%2F%2Fd', i, '.com%2Fjobs%23x">', title, '</a></h2><a class="result__snippet">', body, '</a></div>')
    bing = text('<li class="b_algo"><h2><a href="https://b', i, '.com/career">', title, '</a></h2><div class="b_caption"><p>', body, "</p></div></li>")
    google = text('<div class="yuRUbf"><a href="https://www.google.com/url?q=https%3A%2F%2Fg', i, '.com%2Fjobs"></a><h3>', title, '</h3><span class="aCOpRe">', body, "</span></div>")
    other = {"duckduckgo": '<div class="result"><a class="result__a" href="/x">y</a></div>', "bing": '<li class="b_algo"><h2>z</h2></li>', "google": ""}
    out = None
    for engine, card in (("duckduckgo", duck), ("bing", bing), ("google", google)):
        found = P.search_results(rows.select(i.alias("query"), text(other[engine], card, card).alias("html")), engine)
        out = found if out is None else out.unionByName(found)
    return out


LINKS = ("'https://careers.e' || id % 7 || '.com/jobs/' || id || '/'", "'https://e.com/blog/jobs'", "'https://x.org/'", "'https://jobs.lever.co/' || id", "'https://www.k' || id % 3 || '.com/apply#f'")


def career_urls(spark, sf_dir):
    rows = _posts(spark, sf_dir).select(F.expr("id div 20").alias("query"), C("id").alias("n"), F.expr(f"element_at(array({', '.join(LINKS)}), cast(id % 5 + 1 as int))").alias("link"))
    return P.career_urls(rows, most=6)


_KIND = r"CASE WHEN id % 2 = 0 THEN 'Contract' WHEN regexp_matches(title, '(?i)\bintern(ship)?\b') THEN 'Internship' WHEN contains(lower(title || ' ' || company || ' ' || place), 'remote') THEN 'Remote' ELSE 'Not specified' END"
_FOUND = f"""{POSTS}, v AS (SELECT *, id // 4 AS k, 'https://careers.acme' || id // 4 || '.com' AS site FROM posts),
    f AS (SELECT *, site || '/jobs/' || id % 50 AS link, row_number() OVER (PARTITION BY k ORDER BY id) AS n FROM v WHERE {_VALID} AND {_POSTING})"""
_BODY = "trim(repeat(body || ' ', {}))"
QUERIES = {
    "postings_from_html": (postings_from_html, f"""WITH {_FOUND} SELECT site || '/list' AS url, CAST(n AS INTEGER) AS n, {SQUEEZE.format('title')} AS title, company,
        CASE WHEN trim(place) = '' THEN 'Onsite' ELSE {SQUEEZE.format('place')} END AS location, {_KIND} AS type, link, '2024-02-' || lpad(CAST(id % 28 + 1 AS VARCHAR), 2, '0') AS posted_date FROM f"""),
    "openings_from_html": (openings_from_html, f"""WITH {_FOUND} SELECT site || '/list' AS url, {SQUEEZE.format('title')} AS title, link FROM f
        UNION ALL SELECT DISTINCT site || '/list', 'QA Analyst ' || k, site || '/jobs/ld' || k FROM v"""),
    "stated_openings": (stated_openings, f"""WITH {POSTS} SELECT 'https://careers.acme' || id || '.com/list' AS url, {SQUEEZE.format('title')} AS title,
        CASE id % 4 WHEN 1 THEN 'https://x' || id || '.com/jobs/b' ELSE 'https://careers.acme' || id || '.com/jobs/' || CASE id % 4 WHEN 0 THEN 'a' || id WHEN 2 THEN 'c' || id ELSE 'd' END END AS link
        FROM posts WHERE {_VALID} AND {_POSTING}"""),
    "openings_without_boxes": (openings_without_boxes, f"""WITH {POSTS} SELECT 'https://careers.acme' || id || '.com/list' AS url, {SQUEEZE.format('title')} AS title,
        'https://careers.acme' || id || '.com/jobs/' || CASE id % 4 WHEN 3 THEN 'a' ELSE 'b' END || id AS link FROM posts WHERE id % 4 <> 1 AND {_VALID} AND {_POSTING}"""),
    "posting_details": (posting_details, f"""WITH {POSTS}, d AS (SELECT *, CASE WHEN id % 3 = 0 AND length({_BODY.format(4)} || CASE WHEN body = '' THEN '' ELSE ' ' END || 'Apply now') >= 120 THEN repeat(body || ' ', 4)
            WHEN length({_BODY.format(5)}) >= 200 THEN {_BODY.format(5)} ELSE '' END AS t FROM posts)
        SELECT id, CASE WHEN length(t) < 120 THEN '' ELSE left(t, 150) END AS description, '2024-01-0' || id % 9 + 1 AS posted_date, trim(title) AS meta_description FROM d""".replace("'2024-01-0' || id % 9 + 1", "'2024-01-0' || (id % 9 + 1)")),
    "handoff_links": (handoff_links, """SELECT 'https://acme.com/c/' || p_partkey AS url, CAST(i AS INTEGER) AS n, ['https://acme.com/jobs/' || p_partkey, 'https://jobs.lever.co/' || p_partkey, 'https://acme.com/vacancies/' || p_partkey % 7][i] AS link
        FROM (SELECT p_partkey, unnest([1, 2, 3]) AS i FROM part)"""),
    "pagination_links": (pagination_links, """SELECT 'https://acme' || p_partkey || '.com/careers' AS url, CAST(i AS INTEGER) AS n,
        ['https://acme' || p_partkey || '.com/jobs?page=' || p_partkey, 'https://acme' || p_partkey || '.com/careers?offset=10', 'https://jobs.lever.co/acme'][i] AS link FROM (SELECT p_partkey, unnest([1, 2, 3]) AS i FROM part)"""),
    "search_results": (search_results, f"""WITH {POSTS}, e AS (SELECT *, unnest(['duckduckgo', 'bing', 'google']) AS engine FROM posts)
        SELECT id AS query, 1 AS n, {SQUEEZE.format('title')} AS title, 'https://' || engine[1] || id || CASE engine WHEN 'bing' THEN '.com/career' ELSE '.com/jobs' END AS link, body AS snippet, engine FROM e WHERE trim(title) <> ''"""),
    "career_urls": (career_urls, f"""WITH l AS (SELECT id // 20 AS query, id, list_extract([{', '.join(LINKS)}], CAST(id % 5 + 1 AS INTEGER)) AS link FROM (SELECT p_partkey AS id FROM part)),
        u AS (SELECT query, id, regexp_replace(regexp_replace(link, '#.*$', ''), '/+$', '') AS url FROM l WHERE NOT {has_part_sql('link', fixed.NON_CAREER_URLS)} AND {has_part_sql('link', fixed.CAREER_URLS)}),
        d AS (SELECT query, min(id) AS id, arg_min(url, id) AS url FROM u GROUP BY query, regexp_replace(regexp_extract(url, '^https://([^/]+)', 1), '^www\\.', '')),
        r AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY id) AS INTEGER) AS n, url FROM d) SELECT * FROM r WHERE n <= 6"""),
}
