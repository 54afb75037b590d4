"""Queries over crawled pages and URLs, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.functions import html as H, text as T, urls as U
from ledgerloom.operators import dedup, pages as P, planning
from ledgerloom.sources import lines as L

C = F.col


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


# What the SQL shares: the parts of a web URL, its canonical form and its domain.
URL = r"'^(https?)://([^/?#]*)([^?#;]*)(;[^?#]*)?(?:\?([^#]*))?(?:#.*)?$'"


def part(n: int, url: str = "url") -> str:
    return f"regexp_extract(trim({url}), {URL}, {n}, 'i')"


def canonical_sql(url: str = "url") -> str:
    path = f"regexp_replace(regexp_replace(CASE WHEN {part(3, url)} = '' THEN '/' ELSE {part(3, url)} END, '/+', '/', 'g'), '/+$', '')"
    return f"lower({part(1, url)}) || '://' || lower({part(2, url)}) || CASE WHEN {path} = '' THEN '/' ELSE {path} END || {part(4, url)}"


def domain_sql(url: str = "url") -> str:
    return rf"regexp_replace(lower({part(2, url)}), '^www\.', '')"


def registrable_sql(host: str) -> str:
    return rf"regexp_extract(regexp_replace({host}, ':.*$', ''), '([^.]+\.[^.]+|[^.]+)$', 1)"


def canonical_first_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "pages", "page_id", "url").withColumn("canonical", U.canonical(C("url")))
    first = dedup.first_wins(rows, ["canonical"], ["page_id"])
    return first.select("page_id", "canonical", U.domain(C("url")).alias("domain"), F.sha2("canonical", 256).alias("digest"))


def strip_tracking(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", U.stripped(C("url")).alias("link"))


def domain_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "pages", "url")
    return rows.groupBy(U.domain(C("url")).alias("domain"), U.registrable(U.domain(C("url"))).alias("root")).agg(F.count(F.lit(1)).alias("n"))


def platform_detect(spark, sf_dir):
    rows = table(spark, sf_dir, "pages", "page_id", "url")
    forms = F.array(C("url"), *[F.concat(F.lit(p), C("page_id")) for p in ("https://x.workday.com/", "https://boards.greenhouse.io/", "https://jobs.lever.co/", "https://acme.zoho.com/", "https://a.example.com/sapsf/")])
    return rows.select("page_id", U.platform(F.element_at(forms, (C("page_id") % 6 + 1).cast("int"))).alias("platform"))


PLATFORM_SQL = "CASE " + " ".join(f"WHEN contains(j, '{p}') THEN '{n}'" for p, n in U.fixed.PLATFORMS) + " ELSE 'Custom HTML' END"


def company_from_url(spark, sf_dir):
    rows = table(spark, sf_dir, "pages", "page_id", "url")
    return rows.select("page_id", U.company_from_host(C("url")).alias("board"), U.company_from_url(C("url")).alias("company"), U.table_title(C("url")).alias("table_title"))


def company_hints(spark, sf_dir):
    return planning.company_hints(table(spark, sf_dir, "pages", "url", "page_id"), pos="page_id", most=25)


def pagination_modes(spark, sf_dir):
    rows = table(spark, sf_dir, "pages", "page_id", "url")
    return rows.select("page_id", U.pagination_mode(C("url")).alias("mode"), U.next_page(C("url")).alias("next_page"))


def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "html").select("page_id", H.page_title(C("html")).alias("title"))


def page_anchors(spark, sf_dir):
    rows = P.links(table(spark, sf_dir, "pages", "page_id", "url", "html").withColumn("url", F.concat_ws("#", "url", "page_id")))
    return rows.groupBy("url").agg(F.count(F.lit(1)).alias("n_links"), F.max("link").alias("last_link"))


def crawl_frontier(spark, sf_dir):
    pages = dedup.first_wins(table(spark, sf_dir, "pages", "page_id", "url", "html"), ["url"], ["page_id"])
    edges = P.links(pages.select("url", "html")).where(U.is_web(C("link"))).select("url", "pos", "link")
    return P.crawl_sites(pages.select("url"), edges)


def crawl_redirects(spark, sf_dir):
    """The crawl where every third page fails, every other one of these with an address that leads on: the page after it."""
    pages = dedup.first_wins(table(spark, sf_dir, "pages", "page_id", "url", "html"), ["url"], ["page_id"])
    edges = P.links(pages.select("url", "html")).where(U.is_web(C("link"))).select("url", "pos", "link")
    after = pages.select((C("page_id") - 1).alias("page_id"), C("url").alias("after"))
    outcomes = pages.join(after, "page_id", "left").select("url", (C("page_id") % 3 != 0).alias("ok"), F.when(C("page_id") % 6 == 0, C("after")).otherwise(F.when(C("page_id") % 3 != 0, C("url"))).alias("final_url"))
    return P.crawl_with_redirects(pages.select("url"), edges, outcomes)


def unwrap_redirects(spark, sf_dir):
    rows = table(spark, sf_dir, "pages", "page_id", "url")
    coded = F.concat(F.lit("https://www.bing.com/ck/a?x=1&u=a1"), F.regexp_replace(F.translate(F.base64(C("url").cast("binary")), "+/", "-_"), "=+$", ""))
    forms = F.array(C("url"), F.concat(F.lit("https://duckduckgo.com/l/?uddg="), F.url_encode("url")), coded, F.concat(F.lit("https://www.google.com/url?q="), F.url_encode("url")))
    return rows.select("page_id", U.unwrapped(F.element_at(forms, (C("page_id") % 4 + 1).cast("int"))).alias("target"))


def unvisited_domains(spark, sf_dir):
    rows = table(spark, sf_dir, "pages", "page_id", "url")
    return P.unvisited(rows.where("page_id % 3 <> 0"), rows.where("page_id % 3 = 0"), pos="page_id")


def first_success(spark, sf_dir):
    rows = table(spark, sf_dir, "pages", "page_id", "url")
    tries = rows.select(F.col("page_id").alias("url"), F.posexplode(F.array(F.lit("requests"), F.lit("browser"), F.lit("api"))).alias("priority", "method"))
    tries = tries.withColumns({"ok": (C("url") + C("priority")) % 3 == 0, "error": F.concat_ws(":", "method", F.lit("failed"))})
    best = P.first_success(tries)
    return best.select("url", "method", F.array_join("errors", ";").alias("errors"))


def json_openings(spark, sf_dir):
    rows = table(spark, sf_dir, "pages", "page_id", "url")
    item = F.struct(F.concat(F.lit("Engineer "), C("page_id")).alias("name"), F.when(C("page_id") % 2 == 0, C("url")).alias("applyUrl"), F.lit("Lahore").alias("city"))
    payload = F.when(C("page_id") % 3 == 0, F.to_json(F.array(item))).when(C("page_id") % 3 == 1, F.to_json(F.struct(F.array(item, item).alias("positions")))).otherwise(F.lit('{"jobs": 5}'))
    found = rows.select("page_id", F.posexplode(L.json_openings(payload, C("url"))).alias("pos", "o"))
    return found.select("page_id", "pos", "o.title", "o.location", "o.type", "o.apply_link")


def html_escaped(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.md5(T.html_escaped(C("html"))).alias("digest"))


def posted_dates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    d = C("o_orderdate")
    forms = F.array(*[F.concat(F.lit("Posted "), F.date_format(d, f), F.lit(" by staff")) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "d MMM yyyy", "MMM d, yyyy")], F.lit("undated"))
    return rows.select("o_orderkey", T.posted_date(F.element_at(forms, (C("o_orderkey") % 5 + 1).cast("int"))).alias("posted"))


def ats_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    return rows.select("s_suppkey", F.posexplode(U.ats_candidates(C("s_name"))).alias("pos", "candidate"))


_STRIP = f"""lower({part(1)}) || '://' || lower({part(2)}) || regexp_replace(CASE WHEN {part(3)} = '' THEN '/' ELSE {part(3)} END, '/+', '/', 'g') || {part(4)} ||
CASE WHEN q = '' THEN '' ELSE '?' || q END"""
QUERIES = {
    "canonical_first_pages": (canonical_first_pages, f"""
        WITH p AS (SELECT page_id, {canonical_sql()} AS canonical, {domain_sql()} AS domain FROM pages)
        SELECT page_id, canonical, domain, sha256(canonical) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY page_id) AS n FROM p) WHERE n = 1"""),
    "strip_tracking_params": (strip_tracking, f"""
        WITH p AS (SELECT page_id, url, array_to_string(list_filter(string_split({part(5)}, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|fbclid|gclid|mc_|hs|__hs)')), '&') AS q FROM pages)
        SELECT page_id, {_STRIP} AS link FROM p"""),
    "domain_counts": (domain_counts, f"SELECT {domain_sql()} AS domain, {registrable_sql(domain_sql())} AS root, count(*) AS n FROM pages GROUP BY ALL"),
    "platform_detect": (platform_detect, f"""
        WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'https://x.workday.com/' || page_id WHEN 2 THEN 'https://boards.greenhouse.io/' || page_id
            WHEN 3 THEN 'https://jobs.lever.co/' || page_id WHEN 4 THEN 'https://acme.zoho.com/' || page_id ELSE 'https://a.example.com/sapsf/' || page_id END AS url FROM pages),
        k AS (SELECT page_id, lower({part(2)} || {part(3)}) AS j FROM p) SELECT page_id, {PLATFORM_SQL} AS platform FROM k"""),
    "company_from_url": (company_from_url, rf"""
        WITH p AS (SELECT page_id, string_split({domain_sql()}, '.') AS l, {domain_sql()} AS h, regexp_replace({part(3)}, '^/+|/+$', '', 'g') AS path FROM pages),
        b AS (SELECT *, replace(replace(CASE WHEN l[1] IN ('jobs','careers','career','job','apply','boards','job-boards') AND len(l) > 1 THEN l[2] ELSE l[1] END, '-', ' '), '_', ' ') AS x FROM p)
        SELECT page_id, array_to_string(list_transform(string_split(x, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS board,
            CASE WHEN len(l) >= 2 THEN list_filter(l, lambda w: w NOT IN ('careers','jobs','hr','apply','recruit','com','io'))[1] END AS company,
            left('Company_' || trim(regexp_replace(CASE WHEN path = '' THEN h ELSE h || '-' || replace(path, '/', '-') END, '[^A-Za-z0-9 _\-]', '-', 'g')), 95) AS table_title FROM b"""),
    "company_hints": (company_hints, f"""
        WITH p AS (SELECT page_id, string_split({domain_sql()}, '.')[1] AS x FROM pages WHERE len(string_split({domain_sql()}, '.')) >= 2),
        w AS (SELECT page_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(x), '[-_+]+', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g')), ' '), lambda t: length(t) > 1 AND t NOT IN ({", ".join(f"'{x}'" for x in U.fixed.COMPANY_STOP_WORDS)})) AS t FROM p),
        c AS (SELECT array_to_string(t[1:4], ' ') AS company, min(page_id) AS a FROM w GROUP BY 1 HAVING company <> '' ORDER BY a LIMIT 25)
        SELECT CAST(row_number() OVER (ORDER BY a) AS INTEGER) AS pos, company FROM c"""),
    "pagination_modes": (pagination_modes, r"""
        SELECT page_id, CASE WHEN contains(lower(url), 'cursor=') THEN 'cursor' WHEN contains(lower(url), 'offset=') THEN 'offset' WHEN contains(lower(url), 'page=') THEN 'page' ELSE 'unknown' END AS mode,
            CASE WHEN regexp_matches(url, '[?&]page=\d+') THEN regexp_replace(url, '([?&])page=\d+', '\1page=' || greatest(1, CAST(regexp_extract(url, '[?&]page=(\d+)', 1) AS INTEGER) + 1))
                 ELSE regexp_extract(url, '^([^#]*)', 1) || CASE WHEN contains(url, '?') THEN '&page=2' ELSE '?page=2' END || regexp_extract(url, '(#.*)$', 1) END AS next_page FROM pages"""),
    "page_titles": (page_titles, r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'si'), '\s+', ' ', 'g')) AS title FROM pages"),
    "page_anchors": (page_anchors, rf"""
        WITH a AS (SELECT url || '#' || page_id AS u, url, unnest(regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>.*?</a>', 1, 'si')) AS h FROM pages),
        r AS (SELECT u, trim(h) AS h, lower({part(1)}) || '://' || {part(2)} AS root, regexp_extract({part(3)}, '^(.*/)', 1) AS dir, {part(3)} AS path FROM a)
        SELECT u AS url, count(*) AS n_links, max(CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(root, '^[^:]*:') || h WHEN starts_with(h, '/') THEN root || h
            WHEN starts_with(h, '?') THEN root || path || h WHEN h = '' THEN u ELSE root || CASE WHEN dir = '' THEN '/' ELSE dir END || h END) AS last_link FROM r GROUP BY u"""),
    "crawl_redirects": (crawl_redirects, None),
    "crawl_frontier": (crawl_frontier, None),
    "unwrap_redirects": (unwrap_redirects, "SELECT page_id, regexp_replace(url, '#.*$', '') AS target FROM pages"),
    "unvisited_domains": (unvisited_domains, f"""
        WITH p AS (SELECT page_id, url, {domain_sql()} AS k FROM pages)
        SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY page_id) AS n FROM p WHERE page_id % 3 <> 0 AND k NOT IN (SELECT k FROM p WHERE page_id % 3 = 0)) WHERE n = 1"""),
    "first_success": (first_success, """
        WITH t AS (SELECT page_id AS url, unnest([0, 1, 2]) AS p FROM pages), r AS (SELECT url, p, ['requests', 'browser', 'api'][p + 1] AS m, (url + p) % 3 = 0 AS ok FROM t),
        b AS (SELECT url, min(p) FILTER (ok) AS best FROM r GROUP BY url)
        SELECT b.url, max(m) FILTER (p = best) AS method, coalesce(string_agg(m || ':failed', ';' ORDER BY p) FILTER (NOT ok AND (best IS NULL OR p < best)), '') AS errors FROM r JOIN b USING (url) GROUP BY b.url"""),
    "json_openings": (json_openings, """
        SELECT page_id, CAST(pos AS INTEGER) AS pos, 'Engineer ' || page_id AS title, 'Lahore' AS location, 'Not Specified' AS type, url AS apply_link
        FROM (SELECT *, unnest(CASE page_id % 3 WHEN 0 THEN [0] WHEN 1 THEN [0, 1] ELSE [] END) AS pos FROM pages)"""),
    "html_escaped": (html_escaped, """SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS digest FROM pages"""),
    "posted_dates": (posted_dates, """
        SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN strftime(o_orderdate, '%-d %b %Y')
            WHEN 3 THEN strftime(o_orderdate, '%b %-d, %Y') ELSE '' END AS posted FROM orders"""),
    "ats_candidates": (ats_candidates, """
        WITH s AS (SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS w, regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g') AS d FROM supplier),
        c AS (SELECT s_suppkey, ['https://' || w || '.lever.co', 'https://jobs.' || w || '.com', 'https://boards.greenhouse.io/' || w, 'https://' || w || '.breezy.hr', 'https://apply.workable.com/' || w,
            'https://' || w || '.workdayjobs.com', 'https://' || d || '.lever.co', 'https://boards.greenhouse.io/' || d, 'https://apply.workable.com/' || d] AS l FROM s)
        SELECT s_suppkey, CAST(i AS INTEGER) AS pos, l[i + 1] AS candidate FROM (SELECT *, unnest(range(9)) AS i FROM c)"""),
}
