"""The lifecycle of postings as state keyed by site: a stream of observations in, changes of state out.

Each site's rows are maps in the state store, keyed by hash; a batch touches only the sites that it has observations
of, and only the rows that it changes. A site's rows are dealt by hash to `buckets` keys, so that the largest site isn't one
task. An observation of a site is all its rows of one time and one with a null hash, which says that the site was looked at and goes to all
buckets; rows that it lacks miss once more and close at the threshold. Closed rows are forgotten after a time by a
timer, in event time, so also when the site is never seen again.

A failed batch is run again from the store's last version, so no change is lost or made twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "source_url string, hash string, status string, missing_count int, first_seen timestamp, last_seen timestamp, closed_at timestamp, at timestamp"
_ROW = "status string, missing_count int, first_seen timestamp, last_seen timestamp, closed_at timestamp"
_COLUMNS = [c.split()[0] for c in CHANGES.split(", ")]


def _time(value) -> pd.Timestamp | None:
    return None if value is None or value is pd.NaT else pd.Timestamp(value)


class SiteLifecycle(StatefulProcessor):
    """Advances one site's rows through its observations, in order of time, and emits every row whose state changed."""

    def __init__(self, threshold: int, keep_days: int):
        self.threshold, self.keep = max(1, threshold), pd.Timedelta(days=keep_days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "hash string", _ROW)
        self.last = handle.getValueState("last", "at timestamp")

    def _advance(self, at: pd.Timestamp, seen: set[str]) -> Iterator[tuple]:
        known = {key[0]: value for key, value in self.rows.iterator()}
        for h in sorted(seen):
            was = known.get(h)
            new = ("ACTIVE", 0, _time(was[2]) if was else at, at, None)
            self.rows.updateValue((h,), new)
            if was is None or was[0] != "ACTIVE" or _time(was[3]) != at:
                yield (h, *new, at)
        for h, was in sorted(known.items()):
            if h in seen or was[0] == "CLOSED":
                continue
            missed = was[1] + 1
            new = ("CLOSED", missed, _time(was[2]), at, at) if missed >= self.threshold else ("MISSING", missed, _time(was[2]), _time(was[3]), None)
            self.rows.updateValue((h,), new)
            if new[0] == "CLOSED":
                self.handle.registerTimer(int((at + self.keep).timestamp() * 1000) + 1)
            yield (h, *new, at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows))
        out, held = [], self.last.get()
        done = _time(held[0]) if held else None
        for at, part in every.groupby("observed_at"):
            if done is None or at > done:
                out += [(key[0], *change) for change in self._advance(at, set(part["hash"].dropna()))]
                done = at
        if done is not None:
            self.last.update((done,))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"), []
        for h, was in sorted((k[0], v) for k, v in self.rows.iterator()):
            if was[0] == "CLOSED" and _time(was[4]) + self.keep < now:
                self.rows.removeKey((h,))
                out.append((key[0], h, "EXPIRED", was[1], _time(was[2]), _time(was[3]), _time(was[4]), now))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def lifecycle_changes(stream: DataFrame, *, threshold: int = 1, keep_days: int = 30, delay: str = "0 seconds", buckets: int = 8) -> DataFrame:
    """The changes of state (CHANGES) of a stream of observations: source_url, hash (null: the site alone) and observed_at.

    Observations of a site may arrive in any order within a batch; one that is not later than the site's last is dropped, and so is
    one that is later than the watermark allows. The session has to use the RocksDB state store.
    """
    observed = stream.where("source_url IS NOT NULL AND observed_at IS NOT NULL").select("source_url", "hash", "observed_at").withWatermark("observed_at", delay)
    own = F.when(F.col("hash").isNull(), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.pmod(F.xxhash64("hash"), F.lit(buckets)).cast("int")))
    return observed.withColumn("bucket", F.explode(own)).groupBy("source_url", "bucket").transformWithStateInPandas(SiteLifecycle(threshold, keep_days), CHANGES, "Append", "EventTime")


ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def start(stream: DataFrame, path: str, checkpoint: str, **options):
    """Starts the stream over what is there, changes appended to Parquet files under `path`."""
    conf = stream.sparkSession.conf
    before = conf.get(ROCKSDB[0])
    conf.set(*ROCKSDB)
    try:
        return lifecycle_changes(stream, **options).writeStream.option("checkpointLocation", checkpoint).format("parquet").option("path", path).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(ROCKSDB[0], before)


def state(changes: DataFrame) -> DataFrame:
    """The rows' last states from their changes; what has expired is gone."""
    last = changes.groupBy("hash").agg(F.max_by(F.struct(*[F.col(c) for c in _COLUMNS if c != "hash"]), F.struct("at", F.col("status") == "EXPIRED")).alias("row"))
    return last.select("hash", "row.*").where("status <> 'EXPIRED'").drop("at")
