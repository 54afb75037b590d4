"""Search plans: companies first, then titles by locations, within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions import fixed, text as T, urls as U


def query_plan(titles: DataFrame, locations: DataFrame, companies: DataFrame, *, budget: int, company_budget: int = 4) -> DataFrame:
    """step, query, location, source and company of the searches to run.

    Each input has value and pos. Every title gives a search per location, so no more
    than the first `budget` of either can take part, and only these meet.
    """
    none = F.lit("")
    named = companies.where(F.trim("value") != "").select(F.concat("value", F.lit(" careers jobs")).alias("query"), none.alias("location"), F.lit("COMPANY").alias("source"), F.col("value").alias("company"), F.lit(0).alias("phase"), F.col("pos").cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    first = lambda df: df.groupBy(F.lower(F.trim("query")).alias("q"), F.lower(F.trim("location")).alias("l")).agg(F.min_by(F.struct(*df.columns), F.struct("phase", "a", "b")).alias("r")).select("r.*")
    own = first(named).orderBy("a").limit(min(company_budget, budget))
    distinct = titles.groupBy(F.lower(F.trim("value")).alias("_k")).agg(F.min_by(F.struct("value", "pos"), "pos").alias("r")).select("r.*").orderBy("pos").limit(budget)
    places = locations.where(F.trim("value") != "").select(F.trim("value").alias("location"), F.col("pos").cast("long").alias("b")).orderBy("b").limit(budget)
    pairs = distinct.crossJoin(F.broadcast(_or_blank(places)))
    rest = pairs.select(F.col("value").alias("query"), "location", F.lit("SEARCH").alias("source"), none.alias("company"), F.lit(1).alias("phase"), F.col("pos").cast("long").alias("a"), "b")
    order = ("phase", "a", "b")
    kept = first(own.unionByName(rest)).orderBy(*order).limit(budget)
    return kept.select(F.row_number().over(Window.orderBy(*order)).alias("step"), "query", "location", "source", "company")


def _or_blank(places: DataFrame) -> DataFrame:
    if places.isEmpty():
        return places.sparkSession.createDataFrame([("", 0)], "location string, b bigint")
    return places


def query_variants(companies: DataFrame, *, name: str = "company") -> DataFrame:
    """company, pos and query of the fixed searches for each company."""
    forms = F.array(*[F.format_string(q, T.squeezed(F.col(name))) for q in fixed.QUERY_VARIANTS])
    return companies.select(name, F.posexplode(forms).alias("pos", "query"))


def company_hints(urls: DataFrame, *, url: str = "url", pos: str = "pos", most: int = 25) -> DataFrame:
    """pos and company: the distinct names in the URLs, in order of appearance."""
    rows = urls.select(F.col(pos).alias("a"), F.posexplode(U.company_candidates(F.col(url))).alias("b", "c")).select("a", "b", U.company_words(F.col("c")).alias("company")).where("company <> ''")
    first = rows.groupBy("company").agg(F.min(F.struct("a", "b")).alias("at")).orderBy("at").limit(most)
    return first.select(F.row_number().over(Window.orderBy("at")).alias("pos"), "company")


def skip_searches(used: Column, limit: int, buffer: int) -> Column:
    return used >= limit - buffer
