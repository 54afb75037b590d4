"""Scores and numeric rules as column expressions; `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.functions import fixed, text as T


def instant(c: Column) -> Column:
    """An ISO timestamp without its fraction, UTC unless it names an offset; null if it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.trim(T.text(c)), r"\.\d+", ""), "Z$", "+00:00"))


def is_recent(c: Column, now: Column, max_age_days: int = 7) -> Column:
    """Within the days before now; what is missing or can't be read counts as recent."""
    return F.coalesce(instant(c) >= now - F.make_dt_interval(F.lit(max_age_days)), F.lit(True))


def days_ago(c: Column, now: Column) -> Column:
    days = F.datediff(now, instant(c))
    weeks = F.floor(days / 7)
    return (
        F.when(days.isNull(), "")
        .when(days <= 0, "today")
        .when(days == 1, "1 day ago")
        .when(days < 7, F.format_string("%d days ago", days))
        .when(weeks == 1, "1 week ago")
        .otherwise(F.format_string("%d weeks ago", weeks))
    )


def clamped(c: Column, default: int = 0) -> Column:
    """A number cut to a whole one from 0 to 100; the default where it can't be read."""
    number = c.cast("string").try_cast("double")
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.when(~F.isnan(number), number).cast("int"), F.lit(default))))


def blended(keyword: Column, model: Column) -> Column:
    """Two fifths of the one and three fifths of the other, halves to the even number."""
    return F.bround(keyword * 0.4 + model * 0.6, 0).cast("int")


def relevance(title: Column, query: Column, posted: Column, employer: Column, now: Column) -> Column:
    """50 for a title with the query, 30 for less than three days of age, 20 for a preferred employer."""
    named = F.contains(F.lower(T.text(title)), F.lower(T.text(query)))
    fresh = F.coalesce(now - instant(posted) < F.make_dt_interval(F.lit(3)), F.lit(False))
    return sum((F.when(c, n).otherwise(0) for c, n in ((named, 50), (fresh, 30), (T.has_part(employer, fixed.PREFERRED_EMPLOYERS), 20))), F.lit(0))


def skill_score(description: Column, skills: tuple[str, ...]) -> Column:
    """45 to 95 by the share of skills named in the text; 60 without skills."""
    if not skills:
        return F.lit(60)
    return F.least(F.lit(100), (F.lit(45) + F.size(T.found_parts(description, skills)) / len(skills) * 50).cast("int"))


def keyword_share(c: Column, words: tuple[str, ...]) -> Column:
    return F.size(T.found_parts(c, words)) / F.lit(float(max(1, len(words))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; -1 if one is empty or null, their lengths differ or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fits = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0)
    return F.when(F.coalesce(fits, F.lit(False)), dot(a, b) / norm).otherwise(F.lit(-1.0))
