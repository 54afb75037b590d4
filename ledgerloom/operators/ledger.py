"""Rows of the ledger's tables: mappings, markers, pending and closed rows, details, and what an append fans out to."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import fixed, text as T, urls as U
from ledgerloom.operators.dedup import Keys, capped, first_wins, new_rows


def pending(rows: DataFrame, *, status: str = "status") -> DataFrame:
    """Rows whose status is new, whatever its case."""
    return rows.where(F.lower(F.trim(T.text(F.col(status)))) == "new")


def associate_title(title: Column) -> Column:
    return T.has_part(T.normal_text(title), fixed.ASSOCIATE_TITLE_WORDS)


def opening_title(title: Column) -> Column:
    """4 to 160 characters with a word of openings and no phrase of menus."""
    t = T.squeezed(title)
    return F.length(t).between(4, 160) & ~T.has_part(t, fixed.OPENING_IGNORED) & T.has_part(t, fixed.OPENING_WORDS)


def fan_out(rows: DataFrame, primary: DataFrame | None, associate: DataFrame | None, token: str, order: Keys, *, title: str = "title") -> tuple[DataFrame, DataFrame]:
    """What an append adds to the primary table, and of that, what it adds to the table of associate titles; rows without a token are added to both as they are."""
    blank = rows.where(F.coalesce(F.col(token), F.lit("")) == "")
    fresh = new_rows(rows, primary, token, order).unionByName(blank)
    own = fresh.where(associate_title(F.col(title)))
    return fresh, own if associate is None else own.join(associate.select(F.col(token).alias("_known")).where("_known <> ''").distinct(), F.col(token) == F.col("_known"), "left_anti")


def to_fetch(rows: DataFrame, cache: DataFrame, *, link: str = "link", order: Keys, most: int = 20) -> DataFrame:
    """The first `most` distinct links, without tracking parameters, whose details aren't cached."""
    keyed = rows.withColumn("_link", U.stripped(F.col(link))).where("_link <> ''")
    fresh = first_wins(keyed, ["_link"], order).join(cache.select(U.stripped(F.col(link)).alias("_link")).distinct(), "_link", "left_anti")
    return capped(fresh, most, order).select(F.col("_link").alias("link"))


def with_details(rows: DataFrame, cache: DataFrame, *, link: str = "link", fields: tuple[str, ...] = ("description", "posted_date")) -> DataFrame:
    """rows with the cached details of their link where they have none of their own; the cache has one row a link."""
    own = cache.select(U.stripped(F.col(link)).alias("_link"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = rows.join(own, U.stripped(F.col(link)) == F.col("_link"), "left")
    blank = lambda c: F.nullif(T.text(F.col(c)), F.lit(""))
    return joined.select(*[F.coalesce(blank(c), blank(f"_{c}"), F.lit("")).alias(c) if c in fields else F.col(c) for c in rows.columns])


def sheet_row(job: DataFrame, now: Column) -> DataFrame:
    """The primary table's twelve columns of jobs whose fields have one of several names."""
    given = lambda *names: [F.nullif(T.text(F.col(n)), F.lit("")) for n in names if n in job.columns]
    pick = lambda *names, other="": F.coalesce(*given(*names), F.lit(other))
    return job.select(
        F.coalesce(*given("timestamp"), F.date_format(now, "yyyy-MM-dd HH:mm:ss 'UTC'")).alias("timestamp"),
        pick("job_title").alias("job_title"),
        pick("company", "employer_name").alias("company"),
        pick("location", "job_location").alias("location"),
        pick("job_type", "job_employment_type").alias("job_type"),
        F.substring(pick("posted_date", "posted_at"), 1, 10).alias("posted_date"),
        pick("apply_link").alias("apply_link"),
        F.substring(pick("description"), 1, 500).alias("description"),
        pick("matched_as", "matched_keywords").alias("matched_keywords"),
        pick("status", other="New").alias("status"),
        pick("notes").alias("notes"),
        pick("ai_score").alias("ai_score"),
    )


def unnotified_rows(jobs: DataFrame, notified: DataFrame, now: Column, *, ident: Callable[[], Column] = lambda: F.col("job_id"), key: str = "id") -> DataFrame:
    """sheet_row of the jobs whose id isn't among the notified ones; `ident` names a job, and jobs without an id are all kept."""
    named = jobs.withColumn("_id", F.coalesce(ident().cast("string"), F.lit("")))
    known = notified.select(F.col(key).cast("string").alias("_known")).where("_known <> ''").distinct()
    return sheet_row(named.join(known, F.col("_id") == F.col("_known"), "left_anti"), now)


def merge_closed(existing: DataFrame, closed: DataFrame, *, key: str = "hash", order: Keys) -> DataFrame:
    """existing with the first closed row of each hash that it lacks; rows with a blank hash are all added."""
    named = closed.withColumn(key, F.trim(T.text(F.col(key))))
    fresh = first_wins(named, [key], order, keep_blank=True).join(existing.select(F.trim(key).alias("_known")).where("_known <> ''").distinct(), F.col(key) == F.col("_known"), "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def run_markers(runs: DataFrame) -> DataFrame:
    """run_id, kind and text of the divider and the summary of each run (run_id, run_iteration, run_timestamp as text, jobs_found, new_jobs, closed_jobs)."""
    at = F.col("run_timestamp")
    clock = F.when(F.length(at) >= 16, F.substring(at, 12, 5)).otherwise(at)
    header = F.format_string("RUN %d | %s", "run_iteration", F.replace(at, F.lit(" UTC"), F.lit("")))
    summary = F.format_string("RUN_ID %s | TIMESTAMP %s | TOTAL %d | NEW %d | CLOSED %d", "run_id", clock, "jobs_found", "new_jobs", "closed_jobs")
    rows = F.array(F.struct(F.lit("RUN_HEADER").alias("kind"), header.alias("text")), F.struct(F.lit("SUMMARY").alias("kind"), summary.alias("text")))
    return runs.select("run_id", F.explode(rows).alias("r")).select("run_id", "r.*")


def activity(status: DataFrame, at, *, url: str = "url") -> DataFrame:
    """One audit row for every page of a cycle, whatever became of it: url, domain, status, change_type, total and new openings, at."""
    changed = F.col("status").isin("new_url_tracked", "content_changed")
    return status.select(
        (at if isinstance(at, Column) else F.lit(at)).cast("timestamp").alias("at"), url, U.domain(F.col(url)).alias("domain"), "status",
        F.when(F.col("status") == "error", "error").when(changed, "change").otherwise("none").alias("change_type"),
        F.col("openings").alias("total_openings"), F.when(changed, F.col("fresh")).otherwise(0).alias("new_openings_count"),
    )


def deleted_counts(tables: Mapping[str, DataFrame], keys: DataFrame, key: str) -> DataFrame:
    """name and n: the rows of each table that hold one of the keys."""
    named, out = keys.select(key).distinct(), None
    for name, rows in tables.items():
        one = rows.join(named, key, "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def status_colour(status: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in fixed.STATUS_COLOURS.items() for x in pair]), F.upper(T.text(status))), F.lit("#ffffff"))


def rgb(colour: Column) -> Column:
    """Red, green and blue from 0 to 1 of a #rrggbb colour; white where it can't be read."""
    raw = F.regexp_replace(F.trim(T.text(colour)), "^#+", "")
    part = lambda k: F.conv(F.substring(raw, 2 * k + 1, 2), 16, 10).cast("double") / 255
    return F.when(raw.rlike("^[0-9A-Fa-f]{6}$"), F.array(*[part(k) for k in range(3)])).otherwise(F.array(*[F.lit(1.0)] * 3))


def column_letter(index: Column) -> Column:
    """The letters of a sheet's column, from 1 on, for any whole number."""
    n = F.greatest(F.lit(1), index.cast("long"))
    firsts = [(26 ** (k + 1) - 1) // 25 for k in range(14)]  # the first column that has k + 1 letters
    letters = [F.when(n >= first, F.char(65 + F.call_function("div", n - first, F.lit(26**k)) % 26)) for k, first in enumerate(firsts)]
    return F.concat_ws("", *reversed(letters))


def company_tab(name: Column) -> Column:
    """A company's name as a table's title: letters, digits, blanks, _ and -, 95 characters at most."""
    return F.substring(F.coalesce(F.nullif(T.squeezed(F.regexp_replace(F.trim(T.text(name)), r"[^A-Za-z0-9 _\-]", " ")), F.lit("")), F.lit("Unknown")), 1, 95)
