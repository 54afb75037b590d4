"""Aggregates of tables and runs, and capped lists with running budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions import urls as U
from ledgerloom.operators.running import running_total
from ledgerloom.store import stash


def top(df: DataFrame, key: str | Column, n: int, *, pos: str, name: str = "name") -> DataFrame:
    """The n most frequent keys with their counts; ties by first appearance, then by name."""
    key = F.col(key) if isinstance(key, str) else key
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first")).orderBy(F.col("n").desc(), "first", name).limit(n).drop("first")


def status_counts(df: DataFrame, status: str, values: tuple[str, ...], *, prefix: str = "n_") -> DataFrame:
    """One row: all rows, and those of each status."""
    counts = [F.count_if(F.lower(F.col(status)) == v.lower()).alias(prefix + v.lower()) for v in values]
    return df.agg(F.count(F.lit(1)).alias("total"), *counts)


def since(df: DataFrame, date: str, today, days: int) -> DataFrame:
    """Rows whose date, the first ten characters, can be read and is within the days."""
    read = F.try_to_date(F.substring(F.col(date).cast("string"), 1, 10))
    return df.where(read >= F.date_sub(F.lit(today).cast("date"), days))


def company_stats(active: DataFrame, new: DataFrame, *, company: str = "company", url: str = "url", pos: str = "pos") -> DataFrame:
    """Per company: active and new rows, and the URL of its first row, active ones first."""
    flagged = active.select(company, url, pos, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(new.select(company, url, pos, F.lit(0).alias("a"), F.lit(1).alias("b")))
    return flagged.groupBy(company).agg(F.sum("a").alias("active_roles"), F.sum("b").alias("new_roles"), F.min_by(url, F.struct("b", pos)).alias("career_url"))


#: Events that are ordered by one task, at most.
FEW_EVENTS = 10_000


def event_cap(df: DataFrame, per_event: int, budget: int, *, event: str, event_pos: str, pos: str, max_events: int | None = None) -> DataFrame:
    """The first rows of each event in order, then as many rows over all events as the budget lets through.

    The budget is a running sum over the events' counts, over ranges of events; a partly covered event keeps its first rows. Every event
    uses some of it, so of a budget up to FEW_EVENTS no later events are looked at.
    """
    if max_events is not None:
        firsts = df.groupBy(event).agg(F.min(event_pos).alias("_at")).orderBy("_at", event).limit(max_events)
        df = df.join(firsts.select(event), event, "left_semi")
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(event).orderBy(pos))).where(F.col("_r") <= per_event)
    sizes = ranked.groupBy(F.col(event).alias("_event")).agg(F.min(event_pos).alias("_at"), F.count(F.lit(1)).alias("_n"))
    sizes = sizes.orderBy("_at", "_event").limit(budget) if budget <= FEW_EVENTS else sizes
    lead = running_total(stash(sizes, "sizes"), "_n", ["_at", "_event"], name="_before").select("_event", "_before").where(F.col("_before") < budget)
    out = ranked.join(lead, F.col(event) == F.col("_event")).where(F.col("_before") + F.col("_r") <= budget)
    return out.select(*df.columns)


def archive(df: DataFrame, today, *, days: int, status: str, date: str, new: str = "new", last_archive=None, every_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(archived, kept): rows that aren't new and were posted before the cutoff go; none within every_days of the last time."""
    read = F.try_to_date(F.substring(F.col(date).cast("string"), 1, 10))
    due = F.lit(True) if last_archive is None else F.datediff(F.lit(today).cast("date"), F.lit(last_archive).cast("date")) >= every_days
    old = F.coalesce(due & (F.lower(F.trim(F.col(status))) != new) & (read < F.date_sub(F.lit(today).cast("date"), days)), F.lit(False))
    return df.where(old), df.where(~old)


def run_metrics(sites: DataFrame) -> DataFrame:
    """One row over site outcomes (ok, jobs_count): sites, ok, failed, jobs found, and sites without jobs."""
    return sites.agg(
        F.count(F.lit(1)).alias("sites_total"),
        F.count_if("ok").alias("sites_ok"),
        F.count_if(~F.col("ok")).alias("sites_failed"),
        F.coalesce(F.sum("jobs_count"), F.lit(0)).alias("jobs_found"),
        F.count_if(F.col("ok") & (F.col("jobs_count") == 0)).alias("sites_empty"),
    )


def companies_without_jobs(sites: DataFrame) -> DataFrame:
    """company: the distinct first hints in the URLs of sites (url, ok, jobs_count) that were read and had no jobs, in order."""
    empty = sites.where(F.col("ok") & (F.coalesce("jobs_count", F.lit(0)) == 0) & (F.trim("url") != ""))
    hints = F.filter(F.transform(U.company_candidates(F.trim("url")), U.company_words), lambda x: x != "")
    return empty.select(F.get(hints, F.lit(0)).alias("company")).where(F.col("company").isNotNull()).distinct().orderBy("company")


def tracked_hashes(state: DataFrame, *, key: str = "hash") -> DataFrame:
    """hash: the distinct hashes of a state over all companies, without blanks around and without empty ones."""
    return state.select(F.trim(key).alias("hash")).where("hash <> ''").distinct()


def histogram(df: DataFrame, key: str, *, name: str = "name", blank: str = "Unknown") -> DataFrame:
    """Rows per key; empty and null keys count as `blank`."""
    return df.groupBy(F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit(blank)).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def joined_codes(df: DataFrame, key: str, code: str) -> DataFrame:
    """Per key the distinct codes, sorted and joined."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(code)), ",").alias("codes"))


def preview(titles: Column, n: int = 5) -> Column:
    return F.array_join(F.slice(titles, 1, n), " | ")


def content_digest(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def site_digests(sites: DataFrame, pages: DataFrame, openings: DataFrame, *, site: str = "site") -> DataFrame:
    """site and digest: SHA-256 of one JSON text of what a crawl of the site found, keys in order.

    sites has the site, resolved_url and page_title; pages the site, n and url of its pages; openings the site, n, title and link.
    Both lists are bounded by the crawl (pages and openings a site) and enter in the order n; a site without any has empty lists.
    """
    rows = lambda df, value: df.groupBy(F.col(site).alias("_site")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", value.alias("x")))), lambda r: r["x"]).alias("_rows"))
    seen = rows(pages, F.col("url")).withColumnRenamed("_rows", "_pages")
    found = rows(openings, F.struct("link", "title"))
    both = sites.join(seen, F.col(site) == F.col("_site"), "left").drop("_site").join(found, F.col(site) == F.col("_site"), "left")
    none = lambda c, like: F.coalesce(c, F.array().cast(like))
    told = F.struct(
        none(F.col("_rows"), found.schema["_rows"].dataType).alias("openings"), F.coalesce("page_title", F.lit("")).alias("page_title"),
        none(F.col("_pages"), seen.schema["_pages"].dataType).alias("pages_visited"), F.coalesce("resolved_url", F.lit("")).alias("resolved_url"),
    )
    return both.select(site, F.sha2(F.to_json(told, {"ignoreNullFields": "false"}), 256).alias("digest"))


def mark(df: DataFrame, key: str, value: str, status: str, note: str, *, status_col: str = "status", notes_col: str = "notes", order: str = "pos") -> DataFrame:
    """Sets status, and notes unless the note is empty, of the first row whose key has the value."""
    first = df.where(F.col(key) == value).agg(F.min(order).alias("_first"))  # one row
    hit = F.coalesce((F.col(key) == value) & (F.col(order) == F.col("_first")), F.lit(False))
    kept = F.when(hit & F.lit(note != ""), F.lit(note)).otherwise(F.col(notes_col))
    return df.join(F.broadcast(first)).withColumns({status_col: F.when(hit, F.lit(status)).otherwise(F.col(status_col)), notes_col: kept}).drop("_first")


def note_added(notes: Column, note: Column) -> Column:
    return F.concat_ws(" | ", F.nullif(notes, F.lit("")), F.nullif(note, F.lit("")))
