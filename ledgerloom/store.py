"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Names of the open scopes; a table written inside belongs to the innermost one.
_scopes: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where that is unset, a temporary one is set if the session runs in one
    process, as in tests; on a cluster every executor would write to a disk of its own, so it is an error there.
    """
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", held)
    return held.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, in the open scope."""
    inside = "".join(f"{s}/" for s in _scopes)
    return f"{shared_dir(spark)}/ledgerloom/{spark.sparkContext.applicationId}/{inside}{name}-{uuid.uuid4().hex[:12]}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads it back.

    This cuts the lineage: what follows survives the loss of any executor and
    repeats none of the work before. `discard`, the end of a `scope` or `sweep` removes the table.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Removes tables that stash returned; nothing may read them any more."""
    for table in tables:
        _delete(table.sparkSession, table._stashed_at)


@contextmanager
def scope(spark: SparkSession, name: str = "scope") -> Iterator[None]:
    """Tables stashed inside are removed at the end; what is computed from them has to be written by then."""
    folder = f"{name}-{uuid.uuid4().hex[:12]}"
    _scopes.append(folder)
    inside = "/".join(_scopes)
    try:
        yield
    finally:
        _scopes.remove(folder)
        _delete(spark, f"{shared_dir(spark)}/ledgerloom/{spark.sparkContext.applicationId}/{inside}")


def sweep(spark: SparkSession) -> None:
    """Removes the session's tables; results not yet written can no longer be read."""
    _delete(spark, f"{shared_dir(spark)}/ledgerloom/{spark.sparkContext.applicationId}")
