"""The lifecycle of keyed rows over runs: ACTIVE, MISSING, CLOSED, with gates for sites that weren't observed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FIELDS = ("hash", "source_url", "status", "missing_count", "first_seen", "last_seen", "closed_at")


def advance(state: DataFrame, current: DataFrame, evaluated: DataFrame | None, now, *, threshold: int = 1, fields: tuple[str, ...] = ()) -> DataFrame:
    """The state after a run at `now`: FIELDS and the further fields.

    `current` has hash, source_url and the fields of the rows seen; `evaluated`
    the source_urls that were observed (null or empty: all). A row not seen at an
    observed source misses once more and is closed at the threshold; a row of a
    source that wasn't observed stays as it is. A closed row that is seen again is
    active with its first date.
    """
    now, threshold = F.lit(now).cast("timestamp"), max(1, threshold)
    own = ("source_url", *fields)
    new = current.select(F.col("hash").alias("_hash"), *[F.col(c).alias(f"_{c}") for c in own])
    rows = state.join(new, F.col("hash") == F.col("_hash"), "full_outer")
    if evaluated is not None:
        seen = evaluated.select(F.col("source_url").alias("_site")).distinct()
        rows = rows.join(seen, F.col("source_url") == F.col("_site"), "left")
        waits = F.lit(not seen.isEmpty()) & (F.coalesce("source_url", F.lit("")) != "") & F.col("_site").isNull()
    else:
        waits = F.lit(False)
    here, closed = F.col("_hash").isNotNull(), F.col("status") == "CLOSED"
    missed = F.coalesce("missing_count", F.lit(0)) + 1
    closes = missed >= threshold
    pick = lambda seen, wait, was, close, other: F.when(here, seen).when(waits, wait).when(closed, was).when(closes, close).otherwise(other)
    col, none = F.col, F.lit(None).cast("timestamp")
    return rows.select(
        F.coalesce("hash", "_hash").alias("hash"),
        *[F.when(here, F.coalesce(F.nullif(col(f"_{c}"), F.lit("")), col(c))).otherwise(col(c)).alias(c) for c in own[:1]],
        pick(F.lit("ACTIVE"), col("status"), F.lit("CLOSED"), F.lit("CLOSED"), F.lit("MISSING")).alias("status"),
        pick(F.lit(0), col("missing_count"), col("missing_count"), missed, missed).cast("int").alias("missing_count"),
        F.when(here, F.coalesce("first_seen", now)).otherwise(col("first_seen")).alias("first_seen"),
        pick(now, col("last_seen"), col("last_seen"), now, col("last_seen")).alias("last_seen"),
        pick(none, col("closed_at"), F.coalesce("closed_at", "last_seen", now), now, none).alias("closed_at"),
        *[F.when(here, F.coalesce(F.nullif(col(f"_{c}"), F.lit("")), col(c))).otherwise(col(c)).alias(c) for c in fields],
    )


def enriched(rows: DataFrame, state: DataFrame, now, *, run_id: str, run_iteration: int, key: str = "hash") -> DataFrame:
    """rows with first_seen, last_seen, closed_at, run_id (text) and run_iteration: a row's own value if it has one, else the state's of its hash, else of this run."""
    none = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    kept = state.select(F.col("hash").alias("_key"), *[F.col(c).cast("string").alias(f"_{c}") for c in ("first_seen", "last_seen", "closed_at")])
    now = F.lit(now).cast("timestamp").cast("string")
    own = {"first_seen": now, "last_seen": now, "closed_at": F.lit("")}
    added = {c: F.coalesce(none(c), F.nullif(F.col(f"_{c}"), F.lit("")), last) for c, last in own.items()}
    added["run_id"] = F.coalesce(none("run_id"), F.lit(run_id))
    added["run_iteration"] = F.coalesce(F.nullif(none("run_iteration").cast("int"), F.lit(0)), F.lit(run_iteration))
    joined = rows.join(kept, (F.trim(F.col(key)) == F.col("_key")) & (F.col("_key") != ""), "left")
    return joined.withColumns(added).select(*rows.columns, *[c for c in added if c not in rows.columns])


def flagged(rows: DataFrame, new: DataFrame, *, key: str = "hash", name: str = "status") -> DataFrame:
    """rows with a column that is NEW where the hash (null as empty) is among those of `new`, else ACTIVE."""
    known = new.select(F.coalesce(key, F.lit("")).alias("_key")).distinct()
    joined = rows.join(known, F.coalesce(rows[key], F.lit("")) == F.col("_key"), "left")
    return joined.withColumn(name, F.when(F.col("_key").isNotNull(), "NEW").otherwise("ACTIVE")).drop("_key")


def closed_now(state: DataFrame, now) -> DataFrame:
    return state.where((F.col("status") == "CLOSED") & (F.col("closed_at") == F.lit(now).cast("timestamp")))


def empty_state(spark, fields: tuple[str, ...] = ()) -> DataFrame:
    schema = "hash string, source_url string, status string, missing_count int, first_seen timestamp, last_seen timestamp, closed_at timestamp"
    return spark.createDataFrame([], schema + "".join(f", {f} string" for f in fields))


def baseline(current: DataFrame, now) -> DataFrame:
    """The state in which every current row is active since now."""
    now = F.lit(now).cast("timestamp")
    return current.select("hash", "source_url", F.lit("ACTIVE").alias("status"), F.lit(0).alias("missing_count"), now.alias("first_seen"), now.alias("last_seen"), F.lit(None).cast("timestamp").alias("closed_at"))


def expire(state: DataFrame, now, *, days: int = 30) -> DataFrame:
    """Without rows closed for more than the days; a closed row without a date stays."""
    old = (F.col("status") == "CLOSED") & F.coalesce(F.col("closed_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)), F.lit(False))
    return state.where(~old)


def trusted_sites(current: DataFrame, previous: DataFrame, *, site: str = "source_url", least: int = 5) -> DataFrame:
    """Sites to evaluate, with their counts: not those that show nothing now and had more than `least` rows before."""
    before = previous.groupBy(site).agg(F.count(F.lit(1)).alias("before"))
    now = current.groupBy(site).agg(F.count(F.lit(1)).alias("now"))
    rows = before.join(now, site, "full_outer").select(site, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("now", F.lit(0)).alias("now"))
    return rows.where(~((F.col("now") == 0) & (F.col("before") > least)))


def site_health(outcomes: DataFrame, *, site: str = "site", at: str = "at", ok: str = "ok", error: str = "error") -> DataFrame:
    """Per site: last success, last failure, last error and last status."""
    return outcomes.groupBy(site).agg(
        F.max(F.when(F.col(ok), F.col(at))).alias("last_success"),
        F.max(F.when(~F.col(ok), F.col(at))).alias("last_failure"),
        F.max_by(F.when(~F.col(ok), F.col(error)), F.when(~F.col(ok), F.col(at))).alias("last_error"),
        F.max_by(F.when(F.col(ok), "success").otherwise("failed"), at).alias("last_status"),
    )


def fresh_cache(cache: DataFrame, now, *, ttl_hours: int = 24, at: str = "cached_at") -> DataFrame:
    """cache with fresh: within the time to live."""
    return cache.withColumn("fresh", F.col(at) >= F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(ttl_hours)))


def last_ids(ids: DataFrame, n: int = 5000, *, order: str = "seq") -> DataFrame:
    """The last n in the order."""
    return ids.orderBy(F.col(order).desc()).limit(n)


def quota(calls: DataFrame, *, at: str = "at", unit: str = "month", limit: int = 200, buffer: int = 10) -> DataFrame:
    """Calls per period, what remains of the limit, and whether to stop."""
    used = calls.groupBy(F.date_trunc(unit, at).alias("period")).agg(F.count(F.lit(1)).alias("used"))
    return used.select("period", "used", F.greatest(F.lit(0), limit - F.col("used")).alias("remaining"), (F.col("used") >= limit - buffer).alias("stop"))


def next_run(runs: DataFrame, now) -> DataFrame:
    """The id, number and time of the run after the last one."""
    at = F.lit(now).cast("timestamp")
    number = F.coalesce(F.max("run_iteration"), F.lit(0)) + 1
    return runs.agg(number.cast("int").alias("run_iteration")).select(
        F.format_string("run-%s-%06d", F.date_format(at, "yyyyMMddHHmmss"), "run_iteration").alias("run_id"), "run_iteration", at.alias("run_timestamp")
    )
