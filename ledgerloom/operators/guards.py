"""What may run: locks, cooldowns, streaks of failures, blocked providers, and what counts as notified. `now` is a parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def takeover(locks: DataFrame, now, *, stale_seconds: int = 24 * 3600, at: str = "started_at") -> DataFrame:
    """locks with acquired: the lock is free, or at least a minute and the stale time old."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(at)
    return locks.withColumn("acquired", F.col(at).isNull() | (F.greatest(age, F.lit(0)) >= max(60, stale_seconds)))


def attempted(calls: DataFrame, *, within: str, order: str, outcome: str = "outcome", streak: int = 3, stops: tuple[str, ...] = ("blocked", "rate_limited")) -> DataFrame:
    """The calls that are made: of each group in order, those before a stopping outcome or a streak of failures ends it. Outcomes other than ok are failures."""
    group = Window.partitionBy(within).orderBy(order)
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    bad = F.col(outcome) != "ok"
    rows = calls.withColumn("_k", F.row_number().over(group))
    rows = rows.withColumn("_last_ok", F.coalesce(F.max(F.when(~bad, F.col("_k"))).over(group), F.lit(0)))
    ends = F.col(outcome).isin(*stops) | (bad & (F.col("_k") - F.col("_last_ok") >= streak))
    return rows.withColumn("_ended", F.coalesce(F.max(ends).over(before), F.lit(False))).where(~F.col("_ended")).select(*calls.columns)


def searched(results: DataFrame, *, within: str, order: str, found: str, batch: int = 5, most_empty: int = 5) -> DataFrame:
    """The results that a search in batches gets to: of each run, in order, all batches up to the first at whose end
    `most_empty` results or more in a row were empty (found is null, which is a failure, or 0). `results` gets the column batch, from 0."""
    group = Window.partitionBy(within).orderBy(order)
    rows = results.withColumn("_k", F.row_number().over(group))
    rows = rows.withColumn("_last", F.coalesce(F.max(F.when(F.coalesce(F.col(found), F.lit(0)) > 0, F.col("_k"))).over(group), F.lit(0)))
    ends = (F.col("_k") % batch == 0) & (F.col("_k") - F.col("_last") >= max(1, most_empty))
    rows = rows.withColumn("_over", F.coalesce(F.max(ends).over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    return rows.where(~F.col("_over")).select(*results.columns, F.expr(f"cast((_k - 1) div {batch} as int)").alias("batch"))


def blocked(failures: DataFrame, now, *, provider: str = "provider", at: str = "at", cooldown_seconds: int = 900) -> DataFrame:
    """Per provider until when its last failure blocks it, and whether it does now."""
    until = F.max(at) + F.make_dt_interval(secs=F.lit(cooldown_seconds))
    return failures.groupBy(provider).agg(until.alias("blocked_until")).withColumn("blocked", F.lit(now).cast("timestamp") < F.col("blocked_until"))


def delivered(rows: DataFrame, outcomes: DataFrame, *, key: str = "id", ok: str = "ok") -> DataFrame:
    """key: the rows that count as notified, as at least one channel took them."""
    return rows.select(key).join(outcomes.where(F.col(ok)).select(key).distinct(), key, "left_semi").distinct()


def first_source(results: DataFrame, stale: DataFrame, *, key: str, source: str, order: tuple[str, ...]) -> DataFrame:
    """The rows of each key's first source in `order` that has any; keys without any take the rows of the stale cache."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(source))
    ranked = results.withColumn("_rank", rank).where("_rank > 0")
    best = ranked.groupBy(F.col(key).alias("_key")).agg(F.min("_rank").alias("_best"))
    chosen = ranked.join(best, (F.col(key) == F.col("_key")) & (F.col("_rank") == F.col("_best")), "left_semi").select(*results.columns)
    return chosen.unionByName(stale.join(best, F.col(key) == F.col("_key"), "left_anti").select(*results.columns))
