"""Rules on what the edge brings in: answers to fetches and probes, and commands of a chat. The calls themselves are made elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions import fixed
from ledgerloom.sources import lines as L


def fetch_outcomes(answers: DataFrame, cache: DataFrame, *, url: str = "url", attempt: str = "attempt", status: str = "status", body: str = "body") -> DataFrame:
    """url, attempt, outcome and body_hash of each page's first attempt that was answered.

    An answer is one below 400, 304 included. outcome is cached_304, cached_hash where the body is that of cache(url, body_hash),
    fetched, or failed where no attempt was answered (attempt and body_hash are null then); a 304 has no body_hash. The bodies are hashed before anything is grouped.
    """
    answered = F.coalesce(F.col(status) < 400, F.lit(False))
    digest = F.when(answered & (F.col(status) != 304), F.sha2(F.coalesce(F.col(body), F.lit("")), 256))
    rows = answers.select(F.col(url).alias("url"), F.when(answered, F.col(attempt)).alias("attempt"), F.col(status).alias("status"), digest.alias("body_hash"))
    row = F.struct("attempt", "status", "body_hash")
    first = rows.groupBy("url").agg(F.min(F.when(F.col("attempt").isNotNull(), row)).alias("x")).select("url", "x.*")
    known = cache.groupBy(F.col("url").alias("_url")).agg(F.collect_set("body_hash").alias("_known"))  # one or two a page
    outcome = (
        F.when(F.col("attempt").isNull(), "failed")
        .when(F.col("status") == 304, "cached_304")
        .when(F.coalesce(F.array_contains("_known", F.col("body_hash")), F.lit(False)), "cached_hash")
        .otherwise("fetched")
    )
    return first.join(known, F.col("url") == F.col("_url"), "left").select("url", "attempt", outcome.alias("outcome"), "body_hash")


def conditional_requests(pages: DataFrame, cache: DataFrame, *, url: str = "url") -> DataFrame:
    """url, if_none_match and if_modified_since of the requests for the pages: what the cache(url, etag, last_modified, body_hash) has of the last answer; null where it has none."""
    text = lambda c: F.nullif(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(""))
    known = cache.groupBy(F.col("url").alias("_url")).agg(F.max(F.struct(text("etag").alias("etag"), text("last_modified").alias("last_modified"))).alias("x"))
    return pages.select(F.col(url).alias("url")).distinct().join(known, F.col("url") == F.col("_url"), "left").select("url", F.col("x.etag").alias("if_none_match"), F.col("x.last_modified").alias("if_modified_since"))


def next_cache(answers: DataFrame, cache: DataFrame, *, url: str = "url", attempt: str = "attempt", status: str = "status", body: str = "body", etag: str = "etag", last_modified: str = "last_modified") -> DataFrame:
    """The cache after the answers: url, etag, last_modified and body_hash. A page whose body was fetched takes what its first answer says; others keep theirs."""
    outcome = fetch_outcomes(answers, cache, url=url, attempt=attempt, status=status, body=body).where("outcome = 'fetched'").select(F.col("url").alias("_url"), F.col("attempt").alias("_attempt"), "body_hash")
    said = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(n) for c, n in ((etag, "etag"), (last_modified, "last_modified"))]
    given = answers.select(F.col(url).alias("url"), F.col(attempt).alias("_at"), *said)
    fresh = outcome.join(given, (F.col("url") == F.col("_url")) & (F.col("_at") == F.col("_attempt")))
    fresh = fresh.groupBy("url").agg(F.min(F.struct("etag", "last_modified", "body_hash")).alias("x")).select("url", "x.*")
    kept = cache.select("url", "etag", "last_modified", "body_hash").join(fresh.select("url"), "url", "left_anti")
    return kept.unionByName(fresh)


def probe_endpoints(pages: DataFrame, *, url: str = "url") -> DataFrame:
    """The columns of pages with n, path and endpoint: the addresses at which a site may list its jobs, in the order of trial; none without scheme and host."""
    site = lambda k: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)", k)
    rows = pages.where(site(2) != "").select("*", F.posexplode(F.array(*[F.lit(p) for p in fixed.PROBE_PATHS])).alias("n", "path"))
    return rows.withColumn("endpoint", F.concat(F.lower(site(1)), F.lit("://"), site(2), F.col("path")))


def probe_hits(answers: DataFrame, *, key: str = "url", n: str = "n", status: str = "status", kind: str = "content_type", body: str = "body", endpoint: str = "endpoint", most: int = 50) -> DataFrame:
    """key, path and openings of the first endpoint of each site that answered with JSON that lists openings."""
    text = F.coalesce(F.col(body), F.lit(""))
    looks = F.contains(F.lower(F.coalesce(F.col(kind), F.lit(""))), F.lit("json")) | F.ltrim(text).rlike(r"^[{\[]")
    rows = answers.where((F.col(status) < 400) & looks).select(key, n, "path", L.json_openings(text, F.col(endpoint), most).alias("openings")).where(F.size("openings") > 0)
    return rows.groupBy(key).agg(F.min_by(F.struct("path", "openings"), n).alias("x")).select(key, "x.path", "x.openings")


def poll(updates: DataFrame, last_id: int, *, ident: str = "update_id", text: str = "text", most: int = 20) -> DataFrame:
    """ident and command (null for other text) of the first `most` updates beyond the last one; the greatest ident is the next offset."""
    said = F.lower(F.trim(F.col(text)))
    rows = updates.where(F.col(ident) > last_id).select(ident, F.when(said.isin(*fixed.CHAT_COMMANDS), said).alias("command"))
    return rows.orderBy(ident).limit(most)


def next_row(table: DataFrame, *, headers: int = 1) -> DataFrame:
    """row_number: where the next row of a sheet with so many rows of headers goes."""
    return table.agg((F.count(F.lit(1)) + headers + 1).alias("row_number"))
