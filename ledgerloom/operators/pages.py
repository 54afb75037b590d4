"""Operators over crawled pages: links, pagination, bounded crawls and the choice among strategies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions import fixed, html as H, jsonld, text as T, urls as U
from ledgerloom.functions.columns import whole_row
from ledgerloom.operators import matching as M
from ledgerloom.store import stash


def links(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """url, pos, href, text and link (absolute) of every anchor of every page; only the URL and the links leave the scan."""
    rows = pages.select(url, F.posexplode(H.anchors(F.col(html))).alias("pos", "a")).select(url, "pos", "a.href", "a.text")
    return rows.withColumn("link", U.resolved(F.col(url), F.col("href")))


def pagination_links(pages: DataFrame, *, url: str = "url", html: str = "html", most: int = 5) -> DataFrame:
    """Up to `most` links of a page that lead to further pages of the same or a related host, in order."""
    rows = links(pages, url=url, html=html)
    link, low = F.col("link"), F.lower("link")
    real = (F.trim("href") != "") & ~F.lower(F.trim("href")).rlike("^(#|javascript:|mailto:|tel:)") & U.is_web(link)
    path = F.regexp_extract(low, "^https?://[^/?#]*([^?#]*)", 1)
    likely = (
        F.lower("text").rlike(rf"\b{fixed.PAGINATION_TEXT}\b")
        | T.has_part(low, ("page=", "offset=", "start="))
        | T.has_part(path, ("/page/", "/jobs", "/career"))
        | T.any_of([U.bare_domain(link).endswith(h) for h in fixed.ATS_HOSTS])
    )
    own = U.related(F.regexp_replace(U.host(F.col(url)), ":.*$", ""), F.regexp_replace(U.host(link), ":.*$", ""))
    kept = rows.where(real & ~T.has_part(low, fixed.PAGINATION_NOISE) & own & likely)
    first = kept.groupBy(url, F.lower(F.trim("link")).alias("_k")).agg(F.min("pos").alias("pos"), F.min_by("link", "pos").alias("link"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy(url).orderBy("pos"))).where(F.col("n") <= most).select(url, "n", "link")


def _first(values: Column) -> Column:
    """The first element with a text, else null."""
    return F.get(F.filter(F.transform(values, T.squeezed), lambda x: x != ""), F.lit(0))


def _numbered(rows: DataFrame, url: str, key: Column, most: int) -> DataFrame:
    """The first row of each key of a page, in order of pos, `most` a page, as columns n and row."""
    row = whole_row(rows, (url, "pos"))
    kept = rows.groupBy(url, key.alias("_k")).agg(F.min("pos").alias("pos"), F.min_by(row, "pos").alias("row"))
    return kept.withColumn("n", F.row_number().over(Window.partitionBy(url).orderBy("pos"))).where(F.col("n") <= most).select(url, "n", "row.*")


def _named(part: Column, page: Column) -> Column:
    """title, and link, the first of a container's links that leads to a posting, without tracking parameters (null without), and the container itself."""
    links = F.transform(F.filter(part["links"], lambda x: x != ""), lambda x: U.resolved(page, x))
    link = T.bound(F.get(F.filter(links, M.posting_link), F.lit(0)), lambda x: F.when(x.isNotNull(), U.stripped(x)))
    return F.struct(F.coalesce(_first(part["titles"]), F.lit("")).alias("title"), link.alias("link"), part.alias("p"))


def postings(pages: DataFrame, *, url: str = "url", html: str = "html", most: int = 50) -> DataFrame:
    """url, n, title, company, location, type, link and posted_date of the valid postings of each page, the first of each title and link."""
    found = H.facts(pages, "head", "postings", html=html, keep=(url,))
    rows = found.where(~M.non_job_page(F.col(url), F.col("head"))).select(url, F.posexplode(F.transform("postings", lambda p: _named(p, F.col(url)))).alias("pos", "x")).select(url, "pos", "x.*")
    page, text = F.col(url), F.col("p.text")
    dated = F.transform("p.dates", lambda d: F.coalesce(F.nullif(F.substring(T.squeezed(d["given"]), 1, 10), F.lit("")), F.nullif(T.posted_date(d["text"]), F.lit(""))))
    typed = F.coalesce(*[F.when(text.rlike(rf"(?i)\b{p}\b"), F.lit(label)) for label, p in fixed.TYPE_PATTERNS])
    rows = rows.where(F.col("link").isNotNull() & M.valid_posting(F.col("title"), F.col("link"), F.col("link"), page)).select(
        url,
        "pos",
        "title",
        F.coalesce(_first(F.col("p.companies")), U.company_from_host(page)).alias("company"),
        F.coalesce(_first(F.col("p.places")), F.nullif(T.squeezed(F.regexp_extract(text, fixed.LOCATION_PATTERN, 0)), F.lit("")), F.lit("Not specified")).alias("location"),
        F.coalesce(_first(F.col("p.types")), typed, F.lit("Not specified")).alias("type"),
        "link",
        F.coalesce(F.get(F.filter(dated, lambda x: x.isNotNull()), F.lit(0)), T.posted_date(text)).alias("posted_date"),
    )
    return _numbered(rows, url, F.concat_ws("|", F.lower("title"), "link"), most)


def openings(pages: DataFrame, *, url: str = "url", html: str = "html", most: int = 50, normalise: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """url, title and link of every page's postings: those of the markup first, then JSON-LD's, the first of each, `most` a page.

    normalise may change or drop the rows (url, pos, title and link) before the first of each are taken.
    """
    found, page = H.facts(pages, "head", "postings", "ld", html=html, keep=(url,)), F.col(url)
    marked = F.when(~M.non_job_page(page, F.col("head")), F.transform(F.transform("postings", lambda p: _named(p, page)), lambda x: F.struct(x["title"], x["link"])))
    stated = F.transform("ld", lambda x: F.struct(T.squeezed(x["title"]).alias("title"), F.when(x["link"] != "", U.resolved(page, x["link"])).alias("link")))
    rows = found.select(url, F.posexplode(F.concat(F.coalesce(marked, F.slice(stated, 1, 0)), stated)).alias("pos", "x")).select(url, "pos", "x.*")
    rows = rows.where(F.col("link").isNotNull() & M.valid_posting(F.col("title"), F.col("link"), F.col("link"), page))
    rows = rows if normalise is None else normalise(rows)
    return _numbered(rows, url, F.concat_ws("|", F.lower("title"), F.lower("link")), most).drop("n")


def stated_openings(pages: DataFrame, *, url: str = "url", html: str = "html", most: int = 50) -> DataFrame:
    """url, title and link of the valid postings in a page's JSON-LD, the first of each, `most` a page; all in the JVM."""
    rows = pages.select(url, F.posexplode(jsonld.postings(F.col(html))).alias("pos", "x")).select(url, "pos", "x.title", F.when(F.col("x.link") != "", U.resolved(F.col(url), F.col("x.link"))).alias("link"))
    rows = rows.where(F.col("link").isNotNull() & M.valid_posting(F.col("title"), F.col("link"), F.col("link"), F.col(url)))
    return _numbered(rows, url, F.concat_ws("|", F.lower("title"), F.lower("link")), most).drop("n")


_ISO_DATE = r"\b\d{4}-\d{2}-\d{2}\b"


def descriptions(pages: DataFrame, *, key: str = "url", html: str = "html", shortest: int = 120, least: int = 200, most: int | None = None) -> DataFrame:
    """key, description, posted_date and meta_description of each page.

    A description is a JobPosting's JSON-LD text from `shortest` characters on, else the first known block's text from
    `least` characters on, else the page's text if it is as long and has a phrase of postings; it ends before "Related Jobs" and "Apply".
    With `most`, one of less than `shortest` characters is left out and others are cut there. A date is an ISO date in a time element, else in the text.
    """
    found = H.facts(pages, "ld", "detail", html=html, keep=(key,))
    said = F.get(F.filter(F.transform("ld", lambda x: x["description"]), lambda x: F.length(x) >= shortest), F.lit(0))
    block = F.get(F.filter("detail.blocks", lambda x: F.length(x) >= least), F.lit(0))
    body = F.when((F.length("detail.body") >= least) & F.col("detail.body").rlike(fixed.ANCHOR_PHRASES), F.col("detail.body"))
    text = F.coalesce(said, block, body, F.lit(""))
    for end in ("Related Jobs", "Apply"):
        text = F.regexp_replace(text, f"(?i){end}.*$", "")
    if most is not None:
        text = F.when(F.length(text) < shortest, "").otherwise(F.substring(text, 1, most))
    given = F.get(F.filter(F.transform("detail.times", lambda x: F.regexp_extract(x, _ISO_DATE, 0)), lambda x: x != ""), F.lit(0))
    return found.select(key, text.alias("description"), F.coalesce(given, F.regexp_extract("detail.text", _ISO_DATE, 0)).alias("posted_date"), F.col("detail.meta").alias("meta_description"))


def handoff_links(pages: DataFrame, *, url: str = "url", html: str = "html", most: int = 6) -> DataFrame:
    """url, n and link: the first `most` distinct addresses of jobs that a page leads on to, on its own or a related host."""
    rows = H.facts(pages, "handoffs", html=html, keep=(url,)).select(url, F.posexplode("handoffs").alias("pos", "raw"))
    rows = rows.where(~F.col("raw").rlike("^(#|javascript:|mailto:|tel:)")).withColumn("link", U.resolved(F.col(url), F.col("raw")))
    bare = lambda c: F.regexp_replace(U.host(c), ":.*$", "")
    link = F.col("link")
    likely = T.has_part(link, fixed.HANDOFF_WORDS) | T.any_of([bare(link).endswith(h) for h in fixed.ATS_HOSTS])
    return _numbered(rows.where(U.is_web(link) & U.related(bare(F.col(url)), bare(link)) & likely).drop("raw"), url, F.lower("link"), most)


def search_results(pages: DataFrame, engine: str, *, key: str = "query", html: str = "html", most: int = 10) -> DataFrame:
    """key, n, title, link, snippet and engine of the results on a search engine's pages, the first of each address and title."""
    rows = H.facts(pages, f"{engine}_results", html=html, keep=(key,)).select(key, F.posexplode(f"{engine}_results").alias("pos", "x"))
    rows = rows.select(key, "pos", T.squeezed(F.col("x.title")).alias("title"), U.unwrapped(F.col("x.href")).alias("link"), "x.snippet", F.lit(engine).alias("engine"))
    return _numbered(rows.where((F.col("title") != "") & (F.col("link") != "")), key, F.concat_ws("|", F.lower("link"), F.lower("title")), most)


def career_urls(results: DataFrame, *, key: str = "query", link: str = "link", pos: str = "n", most: int = 12) -> DataFrame:
    """key, n and url: of each key's results those that name careers and nothing else, one per domain, in order."""
    rows = results.select(key, F.col(pos).alias("pos"), U.unwrapped(F.col(link)).alias("url")).where("url <> ''")
    rows = rows.where(~T.has_part(F.col("url"), fixed.NON_CAREER_URLS) & T.has_part(F.col("url"), fixed.CAREER_URLS)).withColumn("url", F.regexp_replace("url", "/+$", ""))
    return _numbered(rows, key, F.coalesce(F.nullif(U.domain(F.col("url")), F.lit("")), F.col("url")), most)


def crawl_sites(seeds: DataFrame, edges: DataFrame, *, max_pages: int = 8) -> DataFrame:
    """seed, n, url and depth of the pages visited from each of the seeds(url) over edges(url, pos, link), in the order n of a queue.

    Every seed has a queue of its own and stops after `max_pages` pages, itself included; URLs are the same if they are equal
    in lower case without blanks around. Each round visits what the queues of all seeds hold at one depth, so it ends after max_pages - 1
    rounds, or when no queue has a page left. Pages without edges are visited and lead nowhere.
    """
    max_pages, token = max(1, max_pages), F.lower(F.trim("link"))
    named = edges.withColumn("token", token).groupBy("url", "token").agg(F.min("pos").alias("pos"), F.min_by("link", "pos").alias("link"))
    # Of a page's links at most max_pages can be seen before and fewer than max_pages can be visited, so no later ones are needed.
    near = named.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("pos"))).where(F.col("_n") < 2 * max_pages).drop("_n")
    near = stash(near, "edges")
    start = seeds.select("url").distinct()
    seen = stash(start.select(F.col("url").alias("seed"), F.lit(0).alias("n"), "url", F.lit(0).alias("depth"), F.lower(F.trim("url")).alias("token")), "visited")
    frontier = seen
    for depth in range(1, max_pages):
        reached = frontier.select("seed", "n", "url").join(near, "url").groupBy("seed", "token").agg(F.min_by(F.struct("n", "pos", "link"), F.struct("n", "pos")).alias("at"))
        fresh = reached.join(seen.select("seed", "token"), ["seed", "token"], "left_anti")
        order = F.row_number().over(Window.partitionBy("seed").orderBy("at.n", "at.pos"))
        counted = seen.groupBy("seed").agg(F.max("n").alias("last"))
        numbered = fresh.withColumn("k", order).where(F.col("k") < max_pages).join(counted, "seed").withColumn("n", F.col("last") + F.col("k")).where(F.col("n") < max_pages)
        frontier = stash(numbered.select("seed", "n", F.col("at.link").alias("url"), F.lit(depth).alias("depth"), "token"), "visited")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.drop("token")


def crawl_with_redirects(seeds: DataFrame, edges: DataFrame, outcomes: DataFrame, *, max_pages: int = 8) -> DataFrame:
    """crawl_sites where pages can fail: seed, n, url, depth, ok and final_url of every page that was tried.

    outcomes has url, ok and final_url of the pages. A page that failed is tried, counts, and leads to the address where it ended, if that
    is known and hasn't been tried, and nowhere else; pages without an outcome didn't fail and end where they begin.
    """
    failed = outcomes.where(~F.col("ok")).groupBy("url").agg(F.min(F.trim("final_url")).alias("link"))
    led = edges.join(failed.select("url"), "url", "left_anti").select("url", "pos", "link").unionByName(failed.where("link <> ''").select("url", F.lit(0).alias("pos"), "link"))
    known = outcomes.groupBy(F.col("url").alias("_url")).agg(F.bool_and("ok").alias("_ok"), F.min(F.nullif(F.trim("final_url"), F.lit(""))).alias("_final"))
    tried = crawl_sites(seeds, led, max_pages=max_pages).join(known, F.col("url") == F.col("_url"), "left")
    return tried.select("seed", "n", "url", "depth", F.coalesce("_ok", F.lit(True)).alias("ok"), F.coalesce("_final", "url").alias("final_url"))


def first_success(results: DataFrame, *, key: str = "url", priority: str = "priority", ok: str = "ok") -> DataFrame:
    """Per key the first successful result in order of priority, with the errors of the strategies before it; else all errors."""
    row = whole_row(results, (key,))
    best = results.groupBy(key).agg(F.min_by(row, F.when(F.col(ok), F.col(priority))).alias("best"), F.array_sort(F.collect_list(F.when(~F.col(ok), F.struct(priority, "error")))).alias("failed"))
    before = F.filter("failed", lambda x: F.col("best").isNull() | (x[priority] < F.col("best")[priority]))
    return best.select(key, *[F.col("best")[c].alias(c) for c in results.columns if c != key], F.transform(before, lambda x: x["error"]).alias("errors"))


def unvisited(candidates: DataFrame, visited: DataFrame, *, url: str = "url", pos: str = "pos") -> DataFrame:
    """The first candidate of each domain (of each URL where there is none) whose domain and URL weren't visited."""
    key = lambda c: F.coalesce(F.nullif(U.domain(c), F.lit("")), U.canonical(c))
    rows = candidates.withColumn("_key", key(F.col(url))).where("_key <> ''")
    fresh = rows.join(visited.select(key(F.col(url)).alias("_key")).distinct(), "_key", "left_anti")
    return fresh.groupBy("_key").agg(F.min_by(whole_row(candidates), pos).alias("_row")).select("_row.*")
