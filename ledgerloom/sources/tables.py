"""Tables as Parquet folders: appends without known keys, replacements, deletions and versioned state."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.operators import lifecycle
from ledgerloom.operators.dedup import new_rows
from ledgerloom.sources import commits


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table, or no rows of the schema where there is none yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def append_new(df: DataFrame, path: str, token: str, order: list[str]) -> None:
    """Appends the first row of each token that the table doesn't hold."""
    spark = df.sparkSession
    new_rows(df, spark.read.parquet(path) if exists(spark, path) else None, token, order).write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def replace_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Replaces only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def delete_keys(spark: SparkSession, path: str, keys: DataFrame, key: str) -> int:
    """Rewrites the table without the keys; the number of rows that went. The new table is complete before the old one goes."""
    table = spark.read.parquet(path)
    gone = table.join(keys.select(key).distinct(), key, "left_semi").count()
    if gone:
        beside = path.rstrip("/") + ".next"
        table.join(keys.select(key).distinct(), key, "left_anti").select(*table.columns).write.mode("overwrite").parquet(beside)
        swap(spark, beside, path)
    return gone


def swap(spark: SparkSession, beside: str, path: str) -> None:
    """Puts a complete table in the place of another, which stands aside until it is done; `recover` finishes what a crash in between has left."""
    hadoop, paths = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs
    new, old, aside = paths.Path(beside), paths.Path(path), paths.Path(path.rstrip("/") + ".last")
    fs = new.getFileSystem(hadoop)
    fs.delete(aside, True)
    fs.rename(old, aside)
    fs.rename(new, old)
    fs.delete(aside, True)


def recover(spark: SparkSession, path: str) -> None:
    """After a crash in the middle of swap: the table that stands aside comes back if no other took its place."""
    aside = path.rstrip("/") + ".last"
    if exists(spark, aside) and not exists(spark, path):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(aside)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(target, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))


def save_state(df: DataFrame, base: str, version: int) -> str:
    """Writes a version of the state, then the pointer to it; readers see whole versions only."""
    path = f"{base.rstrip('/')}/run={version:09d}"
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.createDataFrame([(version,)], "version bigint").coalesce(1).write.mode("append").json(f"{base.rstrip('/')}/pointer")
    return path


def load_state(spark: SparkSession, base: str, schema) -> tuple[DataFrame, int]:
    """The state of the last version, and its number (no rows and 0 at first)."""
    pointer = f"{base.rstrip('/')}/pointer"
    if not exists(spark, pointer):
        return spark.createDataFrame([], schema), 0
    version = spark.read.schema("version bigint").json(pointer).agg(F.max("version")).first()[0] or 0
    return spark.read.schema(schema).parquet(f"{base.rstrip('/')}/run={version:09d}"), version


@dataclass(frozen=True)
class Settings:
    """Parameters of a run; the environment overrides a file, which overrides the defaults."""

    missing_threshold: int = 1
    max_age_days: int = 7
    archive_days: int = 30
    fuzzy_threshold: int = 70
    max_openings_per_event: int = 50
    max_events: int = 100
    extra: dict = field(default_factory=dict)

    @classmethod
    def layered(cls, file: dict | None = None, env: dict | None = None) -> Settings:
        values: dict = {}
        for layer in (file or {}, env or {}):
            for k, v in layer.items():
                kind = cls.__dataclass_fields__.get(k)
                values[k] = v if kind is None or not isinstance(v, str) or kind.type != "int" else int(v)
        known = {k: v for k, v in values.items() if k in cls.__dataclass_fields__ and k != "extra"}
        return cls(**known, extra={k: v for k, v in values.items() if k not in cls.__dataclass_fields__})


#: The tables of a run, in the order in which they are written, and those that closed rows are deleted from; `new` keeps its history.
RUN_TABLES = ("active", "new", "closed", "associate", "by_company", "companies")
DELETES_FROM = ("active", "associate", "by_company")


def publish(
    base: str, run: int, *, active: DataFrame, new: DataFrame, closed: DataFrame, stats: DataFrame, associate: Column, delete_closed: bool = True, key: str = "hash", company: str = "company"
) -> bool:
    """Publishes a run: all its tables, or none, become visible with one commit, and a replay changes nothing (False).

    active replaces the table of that name, without its CLOSED rows; new and closed are appended, and so are those of their rows that meet
    `associate`, to the associate table; a company's table is replaced by its active rows, NEW if the run has the key among
    its new ones, else ACTIVE. Keys of closed rows are then deleted, whatever their case and blanks around them, from the
    active, associate and company tables, and stay in `new`. Rows without a company are in no company's table. `commits.read` reads a table back.
    """
    spark = active.sparkSession
    plain = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    held = active.where(F.coalesce(F.col("status"), F.lit("")) != "CLOSED")
    of_company = lifecycle.flagged(held.where(F.trim(F.coalesce(F.col(company).cast("string"), F.lit(""))) != "").drop("status"), new, key=key)
    fan_out = new.unionByName(closed, allowMissingColumns=True).where(associate)
    marked = lambda rows: rows.withColumn("key", plain(key))
    parts = {
        "active": (commits.REPLACE, marked(held)), "new": (commits.APPEND, new), "closed": (commits.APPEND, closed), "associate": (commits.APPEND, marked(fan_out)),
        "by_company": (commits.BY_KEY, marked(of_company)), "companies": (commits.REPLACE, stats),
    }
    gone = closed.select(plain(key).alias("key")).where("key <> ''") if delete_closed else None
    return commits.commit(spark, base, run, parts, keys={"by_company": company}, deleted=gone, key="key", deletes_from=DELETES_FROM)


def counts(active: DataFrame, new: DataFrame, closed: DataFrame) -> DataFrame:
    """What publish would write, as one row of counts."""
    tagged = active.select(F.lit("active").alias("t")).unionByName(new.select(F.lit("new").alias("t"))).unionByName(closed.select(F.lit("closed").alias("t")))
    return tagged.agg(*[F.count_if(F.col("t") == t).alias(t) for t in ("active", "new", "closed")])
