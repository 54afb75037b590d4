"""Tables that change together: a batch writes its parts of several tables, and one commit makes all of them visible.

A table is a folder of parts, one a batch. Parts are whole before the commit, a small file that is renamed into place, and
readers look only at parts of committed batches; a batch that failed half-way is invisible and overwritten when it is
run again, and a batch that is committed isn't written twice. So a run can be replayed at any point.

What a part does to its table is its mode:

APPEND   adds rows
REPLACE  is the table from now on
BY_KEY   is what the table holds of its keys from now on; other keys stay

A batch can also delete keys: from then on, rows of its own and of earlier batches with these keys are
gone from the tables that it names. Deleted keys are a part of their own, so nothing is rewritten.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

APPEND, REPLACE, BY_KEY = "append", "replace", "by_key"
_COMMITS, _DELETED = "_commits", "_deleted"


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def part(base: str, table: str, batch: int) -> str:
    return f"{base.rstrip('/')}/{table}/batch={batch:012d}"


def committed(spark: SparkSession, base: str) -> dict[int, dict]:
    """The batches that are visible, in order, and what each did."""
    fs, folder = _fs(spark, f"{base.rstrip('/')}/{_COMMITS}")
    if not fs.exists(folder):
        return {}
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
    done = [f"{folder.toString()}/{n}" for n in names if n.endswith(".json")]
    rows = spark.read.text(done, wholetext=True).collect() if done else []
    return {c["batch"]: c for c in sorted((json.loads(r.value) for r in rows), key=lambda c: c["batch"])}


def commit(
    spark: SparkSession, base: str, batch: int, parts: Mapping[str, tuple[str, DataFrame]], *,
    keys: Mapping[str, str] | None = None, deleted: DataFrame | None = None, key: str = "hash", deletes_from: tuple[str, ...] = (),
) -> bool:
    """Writes the parts (mode and rows by table) and commits them; False, and nothing written, if the batch was committed before.

    keys names the key column of BY_KEY tables; `deleted` has the keys, in column `key`, that go from the tables of deletes_from.
    """
    if batch in committed(spark, base):
        return False
    for table, (_, rows) in parts.items():
        rows.write.mode("overwrite").parquet(part(base, table, batch))
    if deleted is not None:
        deleted.select(F.col(key).alias("key")).distinct().write.mode("overwrite").parquet(part(base, _DELETED, batch))
    said = {
        "batch": batch, "tables": {t: mode for t, (mode, _) in parts.items()}, "keys": dict(keys or {}),
        "deletes": {"from": list(deletes_from), "key": key} if deleted is not None else None,
    }
    fs, aside = _fs(spark, f"{base.rstrip('/')}/{_COMMITS}/{batch:012d}.next")
    _, done = _fs(spark, f"{base.rstrip('/')}/{_COMMITS}/{batch:012d}.json")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(said).encode()))
    out.close()
    if not fs.rename(aside, done):
        raise OSError(f"batch {batch} could not be committed")
    return True


def read(spark: SparkSession, base: str, table: str, *, upto: int | None = None) -> DataFrame:
    """The table's rows after the last committed batch, or after batch `upto`, with the batch that each comes from."""
    history = {b: c for b, c in committed(spark, base).items() if upto is None or b <= upto}
    own = [(b, c["tables"][table]) for b, c in history.items() if table in c["tables"]]
    if not own:
        raise ValueError(f"no committed batch has written {table}")
    start = max((k for k, (_, mode) in enumerate(own) if mode == REPLACE), default=0)
    paths = [part(base, table, b) for b, _ in own[start:]]
    rows = spark.read.option("basePath", f"{base.rstrip('/')}/{table}").parquet(*paths).withColumn("batch", F.col("batch").cast("long"))
    key = next((c["keys"][table] for c in reversed(history.values()) if table in c["keys"]), None)
    if key is not None:
        last = rows.groupBy(F.col(key).alias("_key")).agg(F.max("batch").alias("_last"))
        rows = rows.join(last, F.col(key).eqNullSafe(F.col("_key")) & (F.col("batch") == F.col("_last")), "left_semi")
    gone = [(b, c["deletes"]["key"]) for b, c in history.items() if c["deletes"] and table in c["deletes"]["from"] and b >= own[start][0]]
    if gone:
        told = spark.read.option("basePath", f"{base.rstrip('/')}/{_DELETED}").parquet(*[part(base, _DELETED, b) for b, _ in gone])
        told = told.groupBy(F.col("key").alias("_gone")).agg(F.max(F.col("batch").cast("long")).alias("_at"))
        rows = rows.join(told, (F.col(gone[-1][1]) == F.col("_gone")) & (F.col("_at") >= F.col("batch")), "left_anti")
    return rows
