"""Queries over landed answers and updates, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.operators import guards
from ledgerloom.plans.pages import table
from ledgerloom.plans.postings import pick, pick_sql
from ledgerloom.sources import landed

C = F.col
#: Dealt to three attempts a page, so that some pages have no answer.
STATUSES = (403, 500, 200, 429, 304, 200, 404)
SAID = ("/Status ", "hello", "/pause", "/resume")


def fetch_outcomes(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "html").withColumnRenamed("page_id", "url")
    tries = pages.select("url", "html", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("attempt"))
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), ((C("url") + 3 * C("attempt")) % 7 + 1).cast("int"))
    cache = pages.where("url % 2 = 0").select("url", F.when(C("url") % 4 == 0, F.sha2("html", 256)).otherwise("old").alias("body_hash"))
    return landed.fetch_outcomes(tries.withColumn("status", status), cache, body="html")


def _answers(pages, number: int):
    """What the pages answer in a round: a body that changes with the round on some, its tag on most, 304 on pages whose tag is known."""
    changed = C("url") % 5 < number
    body = F.concat(C("html"), F.when(changed, F.lit(str(number))).otherwise(""))
    return pages.select(
        "url", F.lit(0).alias("attempt"), F.when((C("url") % 3 == 0) & (C("url") % 5 >= number) & F.lit(number > 1), 304).when(C("url") % 11 == number, 500).otherwise(200).alias("status"), body.alias("body"),
        F.when(C("url") % 4 != 0, F.concat(F.lit(" t"), F.lit(number))).alias("etag"), F.when(C("url") % 2 == 0, F.lit(f"2024-01-0{number}")).otherwise("").alias("last_modified"),
    )


def conditional_fetches(spark, sf_dir):
    """The headers of a third round of fetches, after two rounds of answers."""
    pages = table(spark, sf_dir, "pages", "page_id", "html").withColumnRenamed("page_id", "url")
    cache = spark.createDataFrame([], "url bigint, etag string, last_modified string, body_hash string")
    for number in (1, 2):
        cache = landed.next_cache(_answers(pages, number), cache)
    return landed.conditional_requests(pages, cache)


def companies_searched(spark, sf_dir):
    """How far each customer's search over its orders gets."""
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    rows = rows.withColumn("found", F.when(C("o_orderpriority") == "1-URGENT", 2).when(C("o_orderpriority") != "2-HIGH", 0))
    return guards.searched(rows, within="o_custkey", order="o_orderkey", found="found", batch=3, most_empty=3).select("o_orderkey", "o_custkey", "batch")


def probe_endpoints(spark, sf_dir):
    return landed.probe_endpoints(table(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "n", "path", "endpoint")


def probe_hits(spark, sf_dir):
    """Endpoints before a page's own are missing, its own answers with markup on even pages, and all others with JSON under a wrong type."""
    rows = landed.probe_endpoints(table(spark, sf_dir, "pages", "page_id", "url"))
    own = C("page_id") % 10
    payload = F.concat(F.lit(' {"jobs": [{"title": "Engineer '), C("page_id").cast("string"), F.lit('", "url": "/x"}]}'))
    answers = rows.select(
        "page_id", "n", "path", "endpoint", F.lit("text/html").alias("content_type"),
        F.when(C("n") >= own, 200).otherwise(404).alias("status"), F.when((C("n") == own) & (C("page_id") % 2 == 0), "<html>no</html>").otherwise(payload).alias("body"),
    )
    return landed.probe_hits(answers, key="page_id").select("page_id", "path", C("openings")[0]["title"].alias("title"), F.size("openings").alias("n"))


def chat_commands(spark, sf_dir):
    rows = table(spark, sf_dir, "events", "event_id", "user_id").withColumn("text", pick(SAID, "user_id"))
    return landed.poll(rows, 100, ident="event_id")


def next_sheet_row(spark, sf_dir):
    return landed.next_row(table(spark, sf_dir, "orders", "o_orderkey"))


_SITE = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)', {})"
_PATHS = "[" + ", ".join(f"'{p}'" for p in fixed.PROBE_PATHS) + "]"
QUERIES = {
    "fetch_outcomes": (fetch_outcomes, f"""WITH a AS (SELECT page_id, CAST(i AS INTEGER) AS i, {list(STATUSES)}[CAST((page_id + 3 * i) % 7 + 1 AS INTEGER)] AS s FROM pages, range(3) t(i)),
        f AS (SELECT page_id, min(i) AS attempt, arg_min(s, i) AS s FROM a WHERE s < 400 GROUP BY 1)
        SELECT p.page_id AS url, attempt, CASE WHEN s IS NULL THEN 'failed' WHEN s = 304 THEN 'cached_304' WHEN p.page_id % 4 = 0 THEN 'cached_hash' ELSE 'fetched' END AS outcome,
            CASE WHEN s = 200 THEN sha256(coalesce(html, '')) END AS body_hash FROM pages p LEFT JOIN f ON f.page_id = p.page_id"""),
    "conditional_fetches": (conditional_fetches, """WITH a AS (SELECT page_id AS url, n, page_id % 11 <> n AND NOT (page_id % 3 = 0 AND page_id % 5 >= n AND n > 1) AS ok, page_id % 5 < n AS changed FROM pages, (SELECT unnest([1, 2]) AS n)),
        f AS (SELECT url, max(n) AS n FROM a WHERE ok AND (n = 1 OR changed OR url % 11 = 1) GROUP BY url)
        SELECT page_id AS url, CASE WHEN page_id % 4 <> 0 THEN 't' || n END AS if_none_match, CASE WHEN page_id % 2 = 0 THEN '2024-01-0' || n END AS if_modified_since FROM pages LEFT JOIN f ON f.url = page_id"""),
    "companies_searched": (companies_searched, """WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
        l AS (SELECT *, k - coalesce(max(CASE WHEN o_orderpriority = '1-URGENT' THEN k END) OVER (PARTITION BY o_custkey ORDER BY k), 0) AS empty FROM k),
        e AS (SELECT o_custkey, min(k) AS last FROM l WHERE k % 3 = 0 AND empty >= 3 GROUP BY 1)
        SELECT o_orderkey, l.o_custkey, CAST((k - 1) // 3 AS INTEGER) AS batch FROM l LEFT JOIN e USING (o_custkey) WHERE last IS NULL OR k <= last"""),
    "probe_endpoints": (probe_endpoints, f"""SELECT page_id, CAST(i AS INTEGER) AS n, {_PATHS}[i + 1] AS path, lower({_SITE.format(1)}) || '://' || {_SITE.format(2)} || {_PATHS}[i + 1] AS endpoint
        FROM pages, range({len(fixed.PROBE_PATHS)}) t(i) WHERE {_SITE.format(2)} <> ''"""),
    "probe_hits": (probe_hits, f"""WITH h AS (SELECT page_id, page_id % 10 + 1 - page_id % 2 AS k FROM pages WHERE {_SITE.format(2)} <> '')
        SELECT page_id, {_PATHS}[CAST(k + 1 AS INTEGER)] AS path, 'Engineer ' || page_id AS title, 1 AS n FROM h WHERE k < {len(fixed.PROBE_PATHS)}"""),
    "chat_commands": (chat_commands, f"""WITH u AS (SELECT event_id, lower(trim({pick_sql(SAID, 'user_id')})) AS s FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 20)
        SELECT event_id, CASE WHEN s LIKE '/%' THEN s END AS command FROM u"""),
    "next_sheet_row": (next_sheet_row, "SELECT count(*) + 2 AS row_number FROM orders"),
}
