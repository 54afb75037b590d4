"""Text normalisation and keyword rules as column expressions (no Python in the plan)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

#: Python's \s and \w on Unicode text, spelt for Java's regular expressions.
_SPACE = r"(?U)\s+"
_NOT_WORD = r"(?U)[^\w\s]"
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def text(c: Column) -> Column:
    """The value as text, null as empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def bound(value: Column, rule: Callable[[Column], Column]) -> Column:
    """rule(value), with the value computed once however often the rule names it."""
    return F.get(F.transform(F.array(value), rule), F.lit(0))


def squeezed(c: Column) -> Column:
    """Without white space at the ends, and with one space for each run of it."""
    return F.regexp_replace(F.regexp_replace(text(c), _SPACE, " "), "^ | $", "")


def normal_text(c: Column) -> Column:
    return squeezed(F.lower(text(c)))


def normal_title(c: Column) -> Column:
    """Lower-cased words of a title: bracketed parts, separators and punctuation are spaces."""
    out = F.regexp_replace(normal_text(c), r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"[|\-/]+", " "), r"(?U)[^a-z0-9\s]", " ")
    return squeezed(out)


def match_title(c: Column) -> Column:
    """Lower-cased, with punctuation as spaces; the form that titles and roles are compared in."""
    return squeezed(F.regexp_replace(F.lower(text(c)), _NOT_WORD, " "))


def _escaped(word: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}-" else ch for ch in word)


def bounded(pattern: str) -> str:
    r"""The pattern between word boundaries on Unicode text, as \b...\b where it starts and ends with word characters;
    after a final punctuation mark a word character has to follow, which is what \b means there."""
    end = _AFTER if pattern[-1].isalnum() or pattern[-1] in ")?]" else r"(?=[\p{L}\p{N}_])"
    return _BEFORE + pattern + end


def has_word(c: Column, words: Iterable[str]) -> Column:
    """True if any of the words stands in the lower-cased text between word boundaries."""
    return F.lower(text(c)).rlike("|".join(f"(?:{bounded(_escaped(w.lower()))})" for w in words))


def has_part(c: Column, words: Iterable[str]) -> Column:
    """True if any of the words is a part of the lower-cased text."""
    return F.lower(text(c)).rlike("|".join(_escaped(w.lower()) for w in words))


def first_word(c: Column, words: Iterable[str]) -> Column:
    """The first of the words, in their order, that stands in the text between word boundaries; else null."""
    return F.coalesce(*[F.when(F.lower(text(c)).rlike(bounded(_escaped(w.lower()))), F.lit(w)) for w in words])


def first_match(c: Column, patterns: Iterable[str]) -> Column:
    """What the first pattern that matches the lower-cased text finds, between word boundaries; else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.lower(text(c)), bounded(p), 0), F.lit("")) for p in patterns])


def found_parts(c: Column, words: Iterable[str]) -> Column:
    """The words that are parts of the lower-cased text, in their order."""
    low = F.lower(text(c))
    return F.filter(F.array(*[F.when(F.contains(low, F.lit(w.lower())), F.lit(w)) for w in words]), lambda w: w.isNotNull())


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions)


def title_case(c: Column) -> Column:
    """A capital after every character that isn't a letter, small letters elsewhere."""
    chars = F.split(F.lower(text(c)), "")
    capital = lambda x, i: F.when((i == 0) | ~F.element_at(chars, F.greatest(i, F.lit(1))).rlike(r"\p{L}"), F.upper(x)).otherwise(x)
    return F.array_join(F.transform(chars, capital), "")


def truthy(c: Column) -> Column:
    return F.lower(F.trim(text(c))).isin("1", "true", "yes", "on")


def as_bool(c: Column, default: bool = False) -> Column:
    """1, true, yes, on and their opposites; the default for anything else."""
    value = F.lower(F.trim(text(c)))
    return F.when(value.isin("1", "true", "yes", "on"), True).when(value.isin("0", "false", "no", "off"), False).otherwise(default)


def says_entry(c: Column) -> Column:
    """A model's answer as a truth value: true, yes, 1, entry or entry-level."""
    return F.lower(F.trim(text(c))).isin("true", "yes", "1", "entry", "entry-level")


def html_escaped(c: Column) -> Column:
    out = text(c)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def posted_date(c: Column) -> Column:
    """The first date in the text, by four formats in order; empty if there is none."""
    from ledgerloom.functions.fixed import DATE_PATTERNS

    return F.coalesce(*[F.nullif(F.regexp_extract(text(c), rf"\b{p}\b", 0), F.lit("")) for p in DATE_PATTERNS], F.lit(""))


def bullet_summary(title: Column, company: Column, description: Column) -> Column:
    """Three lines on a posting: role, filter and the first 140 characters of its description."""
    body = F.trim(text(description))
    shown = F.when(F.length(body) > 140, F.concat(F.substring(body, 1, 140), F.lit("..."))).otherwise(F.coalesce(F.nullif(body, F.lit("")), F.lit("No description provided.")))
    named = lambda c, other: F.coalesce(F.nullif(text(c), F.lit("")), F.lit(other))
    return F.array(
        F.format_string("Role: %s at %s.", named(title, "Unknown role"), named(company, "Unknown company")),
        F.lit("This role passed your entry-level keyword filters."),
        F.concat(F.lit("Description highlight: "), shown),
    )


def cover_points(title: Column, company: Column, profile: Column) -> Column:
    """Three talking points for an application."""
    named = lambda c, other: F.coalesce(F.nullif(text(c), F.lit("")), F.lit(other))
    return F.array(
        F.format_string("Connect your background to the %s responsibilities at %s.", named(title, "role"), named(company, "the company")),
        F.format_string("Highlight projects that demonstrate %s with measurable outcomes.", named(profile, "BSCS final-year student focused on Python, AI, and web development")),
        F.lit("Emphasize fast learning, ownership, and readiness for entry-level impact from day one."),
    )
