"""Line lists and JSON payloads as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerloom.functions import urls as U
from ledgerloom.store import stash

POSTING_SCHEMA = "job_id string, job_title string, job_description string, job_posted_at_datetime_utc string, job_apply_link string, employer_name string, job_city string, job_country string, job_employment_type string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value and pos of the lines of a text file, or of all files of a folder, trimmed; empty lines, single dots and lines with # in front are left out.

    pos is a line's number, from 0, over all files in the order of their paths. Files are read in splits by many tasks: a first pass
    numbers the lines of each split, and the sums of the splits before it, one row a split, are added.
    """
    read = spark.read.text(path, lineSep="\n").select("_metadata.file_path", "_metadata.file_block_start", "value", F.monotonically_increasing_id().alias("at"))
    read = stash(read, "lines")
    splits = read.groupBy("file_path", "file_block_start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file_path", "file_block_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = splits.select(F.col("file_path").alias("_path"), F.col("file_block_start").alias("_start"), (before - F.col("first")).alias("_add"))
    near = (F.col("file_path") == F.col("_path")) & (F.col("file_block_start") == F.col("_start"))
    rows = read.join(numbered, near).select((F.col("at") + F.col("_add")).alias("pos"), F.regexp_replace("value", "\r$", "").alias("value"))
    value = F.trim("value")
    return rows.select("pos", value.alias("value")).where((F.col("value") != "") & (F.col("value") != ".") & ~F.col("value").startswith("#"))


def titles(spark: SparkSession, path: str) -> DataFrame:
    """Lines, the first of each whatever its case."""
    return lines(spark, path).groupBy(F.lower("value").alias("k")).agg(F.min("pos").alias("pos"), F.min_by("value", "pos").alias("value")).select("pos", "value")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """Web URLs without tracking parameters, the first of each canonical form."""
    rows = lines(spark, path).where(U.is_web(F.col("value")))
    return rows.groupBy(U.canonical(F.col("value")).alias("k")).agg(F.min("pos").alias("pos"), F.min_by(U.stripped(F.col("value")), "pos").alias("value")).select("pos", "value")


def raw_postings(spark: SparkSession, path: str) -> DataFrame:
    """Search results landed as JSON, with the schema given and bad records null."""
    return spark.read.schema(POSTING_SCHEMA).json(path)


def search_rows(answers: DataFrame, *, key: str, status: str = "status", payload: str = "payload") -> DataFrame:
    """key, pos and the fields of the postings in the data lists of search answers whose status is 200."""
    fields = ", ".join(POSTING_SCHEMA.split(", "))
    data = F.from_json(F.get_json_object(payload, "$.data"), f"array<struct<{fields.replace(' string', ':string')}>>")
    return answers.where(F.col(status) == 200).select(key, F.posexplode(data).alias("pos", "x")).select(key, "pos", "x.*")


def answer_kind(status: Column) -> Column:
    """ok, rate_limited, forbidden, server_error (worth a retry) or failed."""
    return F.when(status == 200, "ok").when(status == 429, "rate_limited").when(status == 403, "forbidden").when(status >= 500, "server_error").otherwise("failed")


_ITEM = "struct<title:string,name:string,jobTitle:string,url:string,applyUrl:string,jobUrl:string,absolute_url:string,hostedUrl:string,company:string,location:string,city:string,employmentType:string,type:string>"


def json_openings(payload: Column, source: Column, most: int = 50) -> Column:
    """Openings of a JSON payload: a list, or the first list under jobs, results, positions, openings or data."""
    items = F.coalesce(F.when(F.trim(payload).startswith("["), F.from_json(payload, f"array<{_ITEM}>")), *[F.when(F.get_json_object(payload, f"$.{k}").startswith("["), F.from_json(F.get_json_object(payload, f"$.{k}"), f"array<{_ITEM}>")) for k in ("jobs", "results", "positions", "openings", "data")])
    pick = lambda x, *names: F.coalesce(*[F.nullif(F.trim(x[n]), F.lit("")) for n in names])
    unsaid = F.lit("Not Specified")
    rows = F.transform(
        items,
        lambda x: F.struct(
            pick(x, "title", "name", "jobTitle").alias("title"),
            F.coalesce(F.trim(x["company"]), F.lit("")).alias("company"),
            F.coalesce(pick(x, "location", "city"), unsaid).alias("location"),
            F.coalesce(pick(x, "employmentType", "type"), unsaid).alias("type"),
            F.coalesce(pick(x, "url", "applyUrl", "jobUrl", "absolute_url", "hostedUrl"), source).alias("apply_link"),
        ),
    )
    return F.slice(F.filter(rows, lambda x: x["title"].isNotNull()), 1, most)


def json_object(c: Column) -> Column:
    """The text if it is a JSON object, else the widest part between braces that is one; null without."""
    part = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\{.*\}", 0)
    is_object = lambda x: F.try_parse_json(x).isNotNull() & F.trim(x).startswith("{")
    return F.coalesce(F.when(is_object(c), c), F.when((part != "") & is_object(part), part))


def seed_rows(ids: DataFrame, now) -> DataFrame:
    """A sample row for each id, a whole number from 0: statuses and titles repeat by four, companies by six, times step back an hour. Twelve ids are the usual sample."""
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("id") % len(values) + 1).cast("int"))
    return ids.select(
        (F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.col("id").cast("int"))).alias("timestamp"),
        at(("Associate AI Engineer", "Junior Software Engineer", "Graduate Data Analyst", "Trainee ML Engineer")).alias("title"),
        at(tuple(f"Company {k}" for k in "ABCDEF")).alias("company"),
        at(("new", "applied", "rejected", "interview")).alias("status"),
    )
