"""Snapshot comparison: new, updated and active rows, page changes, and merges of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.functions.columns import whole_row


def diff(current: DataFrame, previous: DataFrame, *, key: str = "hash", moved: str = "place", pos: str = "pos") -> DataFrame:
    """current with status: ACTIVE for keys of the previous snapshot, UPDATED for the first row that took a
    previous row's place, NEW for the others.

    Both sides have unique keys. A row takes a place (title and location) if it
    is the first of its unknown keys there, the previous snapshot's first row of
    the place exists, and that row's key doesn't appear earlier in the current one.
    """
    known = previous.select(F.col(key).alias("_known"))
    first = previous.groupBy(F.col(moved).alias("_place")).agg(F.min_by(key, pos).alias("_first"))
    rows = current.join(known, F.col(key) == F.col("_known"), "left").join(first, F.col(moved) == F.col("_place"), "left")
    taken = current.select(F.col(key).alias("_taken"), F.col(pos).alias("_taken_at"))
    rows = rows.join(taken, F.col("_first") == F.col("_taken"), "left")
    exact = F.col("_known").isNotNull()
    turn = F.row_number().over(Window.partitionBy(moved, exact).orderBy(pos))
    free = F.col("_first").isNotNull() & (F.col("_taken_at").isNull() | (F.col("_taken_at") > F.col(pos)))
    status = F.when(exact, "ACTIVE").when(free & (turn == 1), "UPDATED").otherwise("NEW")
    return rows.withColumn("status", status).select(*current.columns, "status")


def diff_pages(current: DataFrame, previous: DataFrame, *, key: str = "key", content: str = "hash", moved: str = "place", pos: str = "pos") -> DataFrame:
    """The first current row of each key, UPDATED if its content changed or it took a previous row's place, else NEW;
    rows that didn't change are left out."""
    rows = current.groupBy(F.col(key)).agg(F.min_by(whole_row(current), pos).alias("_row")).select("_row.*")
    old = previous.select(F.col(key).alias("_key"), F.col(content).alias("_content"))
    joined = rows.join(old, F.col(key) == F.col("_key"), "left")
    changed = joined.where(F.col("_key").isNotNull() & ~F.col(content).eqNullSafe(F.col("_content"))).select(*current.columns, F.lit("UPDATED").alias("status"))
    fresh = diff(rows, previous, key=key, moved=moved, pos=pos).where("status <> 'ACTIVE'")
    return changed.unionByName(fresh)


def page_status(pages: DataFrame, known: DataFrame, *, url: str = "url", digest: str = "digest", openings: str = "openings", fresh: str = "fresh") -> DataFrame:
    """pages with a status by url, digest of the page, number of openings and number of unseen ones."""
    old = known.select(F.col(url).alias("_url"), F.col(digest).alias("_digest"))
    status = (
        F.when(F.col(digest).isNull(), "error")
        .when(F.col(digest) == F.col("_digest"), "unchanged")
        .when(F.col(openings) == 0, "ignored_no_jobs")
        .when(F.col("_url").isNull(), "new_url_tracked")
        .when(F.col(fresh) == 0, "no_new_openings")
        .otherwise("content_changed")
    )
    return pages.join(old, F.col(url) == F.col("_url"), "left").withColumn("status", status).select(*pages.columns, "status")


def merge_snapshots(left: DataFrame, right: DataFrame, key: list[str], *, url: str | None = None) -> DataFrame:
    """Rows of both by key, right's where both have one; a url column keeps left's value unless it is empty."""
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    row = F.max_by(whole_row(left), "_side").alias("_row")
    if not url:
        return both.groupBy(*key).agg(row).select("_row.*")
    first = F.min_by(url, F.when(F.coalesce(F.col(url), F.lit("")) != "", F.col("_side"))).alias("_url")
    return both.groupBy(*key).agg(row, first).select(*[(F.coalesce("_url", F.lit("")) if c == url else F.col("_row")[c]).alias(c) for c in left.columns])


def company_snapshot(rows: DataFrame, *, company: str = "company", url_pos: str = "url_pos", keep: str = "last") -> DataFrame:
    """A company's rows from its last URL only (keep="last"), or from all of them (keep="union")."""
    if keep == "union":
        return rows
    last = rows.groupBy(F.col(company).alias("_company")).agg(F.max(url_pos).alias("_last"))
    return rows.join(last, (F.col(company) == F.col("_company")) & (F.col(url_pos) == F.col("_last")), "left_semi")
