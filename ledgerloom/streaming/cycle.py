"""The periodic run as a stream of micro-batches over arriving snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators import changes, ledger, lifecycle
from ledgerloom.sources import commits, tables
from ledgerloom.store import stash

STATE_SCHEMA = "hash string, source_url string, status string, missing_count int, first_seen timestamp, last_seen timestamp, closed_at timestamp"


def run_cycle(batch: DataFrame, version: int, base: str, *, threshold: int = 1) -> None:
    """Advances the state by one batch of observations (hash, source_url, observed_at).

    A version that was written before is written again, so a batch that is
    replayed after a failure leaves the same state.
    """
    spark = batch.sparkSession
    state, last = tables.load_state(spark, base, STATE_SCHEMA)
    if last >= version + 1:
        previous = spark.createDataFrame([], STATE_SCHEMA) if version == 0 else spark.read.schema(STATE_SCHEMA).parquet(f"{base.rstrip('/')}/run={version:09d}")
        state = previous
    now = batch.agg(F.max("observed_at")).first()[0]
    if now is None:
        tables.save_state(state, base, version + 1)
        return
    seen = batch.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.min_by("source_url", F.struct("observed_at", "source_url")).alias("source_url"))
    tables.save_state(lifecycle.advance(state, seen, batch.select("source_url").distinct(), now, threshold=threshold), base, version + 1)


#: Fingerprints of openings that a page's state holds, at most.
FINGERPRINTS = 300


def run_monitor(batch: DataFrame, number: int, base: str, *, most: int = FINGERPRINTS) -> bool:
    """One cycle of the page monitor: batch has url, digest (null where the page failed), openings (an array of fingerprints) and observed_at, one row a page.

    Writes what becomes of every page as an audit row, pages whose change counts as events, and the pages' state (digest and the fingerprints seen,
    at most `most`, latest first), all with one commit; a cycle that is replayed changes nothing (False). Pages outside of the batch keep their state.
    """
    spark = batch.sparkSession
    kept = "url string, digest string, seen array<string>"
    past = [b for b in commits.committed(spark, base) if b < number]
    known = commits.read(spark, base, "state", upto=number - 1).select("url", "digest", "seen") if past else spark.createDataFrame([], kept)
    own = known.select(F.col("url").alias("_url"), F.col("seen").alias("_seen"))
    found = F.array_distinct(F.filter("openings", lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))
    rows = batch.withColumn("_found", F.coalesce(found, F.array().cast("array<string>"))).join(own, F.col("url") == F.col("_url"), "left").drop("_url")
    rows = rows.withColumn("_seen", F.coalesce("_seen", F.array().cast("array<string>")))
    rows = rows.select("url", "digest", "observed_at", "_found", "_seen", F.size("_found").alias("openings"), F.size(F.array_except("_found", "_seen")).alias("fresh"))
    judged = stash(changes.page_status(rows, known), "monitor")
    state = judged.where("status <> 'error'").select("url", "digest", F.slice(F.array_distinct(F.concat("_found", "_seen")), 1, most).alias("seen"))
    audit = ledger.activity(judged, F.col("observed_at"))
    parts = {"state": (commits.BY_KEY, state), "audit": (commits.APPEND, audit), "events": (commits.APPEND, audit.where("change_type = 'change'"))}
    return commits.commit(spark, base, number, parts, keys={"state": "url"})


def start(stream: DataFrame, base: str, checkpoint: str, *, threshold: int = 1, every: str | None = None):
    """Starts the stream: one cycle per arriving batch, or one pass over what is there where `every` isn't given."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, number: run_cycle(df, number, base, threshold=threshold))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def repeat(step, *, interval: float, max_cycles: int = 0, sleep=None, on_error=None) -> int:
    """Calls step(1), step(2), ... with pauses; an interval of 0 or less is one cycle. A failing cycle doesn't end the loop."""
    import time

    number, sleep = 0, sleep or time.sleep
    while True:
        number += 1
        try:
            step(number)
        except Exception as error:
            if on_error is None:
                raise
            on_error(number, error)
        if interval <= 0 or (max_cycles and number >= max_cycles):
            return number
        sleep(interval)
