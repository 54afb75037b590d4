"""Rules that keep, reject and score postings by title, description and link."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions import embed, fixed, scores, text as T, urls as U
from ledgerloom.functions.columns import named
from ledgerloom.functions.fuzzy import first_alike, partial, token_set_ratio
from ledgerloom.operators import alike
from ledgerloom.store import stash

#: Target roles, at most.
MAX_ROLES = 1_000


def exclusion(title: Column, description: Column) -> Column:
    """Why a posting is too senior, title words first; null if it isn't."""
    by_title, by_text = T.first_word(title, fixed.TITLE_EXCLUDES), T.first_match(description, fixed.DESCRIPTION_EXCLUDES)
    return F.coalesce(
        F.when(by_title.isNotNull(), F.concat(F.lit("title contains '"), by_title, F.lit("'"))),
        F.when(by_text.isNotNull(), F.concat(F.lit("description contains '"), by_text, F.lit("'"))),
    )


def title_hint(title: Column) -> Column:
    return T.first_word(title, fixed.TITLE_HINTS)


def strict_policy(title: Column) -> Column:
    """No reject word, and an allowed phrase or a base role with an entry hint."""
    t = T.match_title(title)
    return (t != "") & ~T.has_word(t, fixed.STRICT_REJECT) & (T.has_part(t, fixed.STRICT_ALLOWED) | (T.has_part(t, fixed.STRICT_BASE) & T.has_part(t, fixed.STRICT_HINTS)))


def non_job_title(title: Column) -> Column:
    t, raw = T.match_title(title), F.trim(T.text(title))
    return (t == "") | (F.length(raw) < 5) | (F.length(raw) > 180) | T.has_part(t, fixed.NON_JOB_PHRASES) | raw.rlike(r"(?U)^[\W\d_]+$")


def role_title(title: Column) -> Column:
    return ~non_job_title(title) & T.has_word(T.match_title(title), fixed.ROLE_WORDS)


def senior_role(title: Column, description: Column) -> Column:
    """Senior by title or description, unless the title has an entry hint."""
    return (senior_title(title) | senior_text(description)) & ~T.has_word(title, fixed.ENTRY_HINTS)


def senior_title(title: Column) -> Column:
    return F.lower(T.text(title)).rlike(T.bounded(fixed.SENIOR_TITLE))


def senior_text(description: Column) -> Column:
    return T.first_match(description, fixed.SENIOR_DESCRIPTION).isNotNull()


def associate_role(*parts: Column) -> Column:
    return T.has_part(F.concat_ws(" ", *[T.text(p) for p in parts]), fixed.ASSOCIATE_WORDS)


def entry_experience(c: Column) -> Column:
    return T.text(c).rlike("(?i)" + fixed.EXPERIENCE)


def level(title: Column, description: Column) -> Column:
    """Struct of entry_level, confidence and reason, by rules in order."""
    t = F.lower(T.text(title))
    both = F.concat_ws(" ", t, F.lower(T.text(description)))
    verdict = lambda entry, confidence, reason: F.struct(F.lit(entry).alias("entry_level"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))
    years = both.rlike(T.bounded(r"(?:[4-9]|\d{2})\+?\s*(?:years?|yrs?)"))
    return (
        F.when(T.has_part(t, fixed.LEVEL_ENTRY) & ~T.has_part(t, fixed.LEVEL_SENIOR), verdict(True, 55, "entry-level title hint detected"))
        .when(T.has_part(both, fixed.LEVEL_SENIOR) | years, verdict(False, 90, "seniority keywords or high-experience requirement detected"))
        .when(T.has_part(both, fixed.LEVEL_ENTRY), verdict(True, 82, "entry-level keywords detected"))
        .otherwise(verdict(True, 72, "no seniority signals detected"))
    )


def valid_title(title: Column) -> Column:
    t = T.squeezed(title)
    low = F.lower(t)
    return F.length(t).between(5, 180) & ~low.isin(*fixed.BAD_TITLES) & ~T.has_part(low, fixed.BAD_TITLE_TOKENS) & ~t.rlike(r"(?U)^[\W\d_]+$")


def posting_title(title: Column) -> Column:
    """A role word, more than one word, and no marketing phrase or leading date."""
    t = T.squeezed(title)
    dated = t.rlike(r"^[A-Za-z]{3,9}\s+\d{1,2},\s+\d{4}\b") | t.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b")
    return F.contains(t, F.lit(" ")) & ~T.has_part(t, fixed.NON_ROLE_PHRASES + fixed.MARKETING_PHRASES) & ~dated & T.has_word(t, fixed.POSTING_ROLE_WORDS)


def posting_link(link: Column) -> Column:
    low = F.lower(F.trim(T.text(link)))
    return (low != "") & ~low.rlike("^(#|javascript:|mailto:|tel:)") & T.has_part(low, fixed.POSTING_LINK_WORDS)


def valid_posting(title: Column, apply_link: Column, job_url: Column, source: Column) -> Column:
    """A posting's title, and a link that names jobs, isn't the source itself and isn't on a noise path."""
    link = F.lower(F.coalesce(F.nullif(T.squeezed(apply_link), F.lit("")), T.squeezed(job_url)))
    own = (T.squeezed(source) != "") & (F.regexp_replace(U.stripped(source), "/+$", "") == F.regexp_replace(U.stripped(link), "/+$", ""))
    return valid_title(title) & posting_title(title) & (link != "") & T.has_part(link, fixed.POSTING_LINK_WORDS) & ~own & ~T.has_part(link, fixed.NOISE_PATHS)


def non_job_page(url: Column, title: Column) -> Column:
    both = F.concat_ws("\n", T.text(url), T.text(title))
    return T.has_part(both, fixed.NON_JOB_PAGE) & ~T.has_part(both, fixed.JOB_PAGE)


def _roles(roles: Sequence[str]) -> Column:
    """The roles with the normalised titles that count as a synonym of each, as an array of literals."""
    if len(roles) > MAX_ROLES:
        raise ValueError(f"at most {MAX_ROLES} roles")
    plain = lambda s: " ".join("".join(ch if ch.isalnum() or ch in "_ " else " " for ch in s.lower()).split())
    rows = []
    for at, role in enumerate(roles):
        variants = {v for head, others in fixed.ROLE_SYNONYMS.items() if plain(role) in {plain(head), *map(plain, others)} for v in map(plain, (head, *others))}
        same = F.array(*[F.lit(v) for v in sorted(variants)]).cast("array<string>")
        rows.append(F.struct(F.lit(at).alias("role_pos"), F.lit(role).alias("role"), F.lit(plain(role)).alias("role_norm"), same.alias("variants")))
    return F.array(*rows)


def match_roles(
    df: DataFrame, *, title: str = "title", description: str = "description", roles: Sequence[str] = fixed.ROLES, threshold: int = 75,
    exclude_senior: bool = True, strict: bool = True, fuzzy: bool = True, semantic: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """df with matched, matched_role and match_score (0 to 100).

    What depends on the title alone is judged once per distinct title, in the JVM first; titles that pass meet the roles, and
    of these only pairs whose fuzzy ratio can matter reach Python. The verdicts are joined to the rows, and only descriptions
    of rows whose title passed are read.
    """
    t, d = F.col(title), F.col(description)
    gate = (F.trim(T.text(t)) != "") & role_title(t)
    gate = gate & strict_policy(t) if strict else gate
    hinted = T.has_word(t, fixed.ENTRY_HINTS)
    gate = gate & (~senior_title(t) | hinted) if exclude_senior else gate
    titles = df.select(title).distinct().where(gate).select(t.alias("_title"), T.match_title(t).alias("title_norm"), hinted.alias("_hinted"))
    pairs = titles.select("title_norm").distinct().select("title_norm", F.explode(_roles(roles)).alias("r")).select("title_norm", "r.*")
    ratio = token_set_ratio("title_norm", "role_norm") if fuzzy else F.lit(0)
    pairs = pairs.withColumn("ratio", ratio)
    part = F.contains("title_norm", "role_norm")
    synonym = F.exists("variants", lambda v: F.contains(F.col("title_norm"), v))
    base = F.greatest(F.when(part, 90.0).otherwise(0.0), F.when(synonym, 85.0).otherwise(0.0), F.when(F.col("ratio") >= 80, F.col("ratio") * 0.9).otherwise(0.0))
    exact = F.col("title_norm") == F.col("role_norm")
    best = pairs.groupBy("title_norm").agg(
        F.max_by("role", F.struct(base.alias("b"), (-F.col("role_pos")).alias("p"))).alias("_role"),
        F.max(base).alias("_base"),
        F.min_by("role", F.when(exact, F.col("role_pos"))).alias("_exact"),
    )
    rows = df.join(titles.join(best, "title_norm").drop("title_norm"), t == F.col("_title"), "left")
    passed = F.col("_title").isNotNull()
    if exclude_senior:
        passed = F.when(passed & ~F.col("_hinted"), ~senior_text(d)).otherwise(passed)
    rows = rows.withColumn("_gate", passed).withColumn("_norm", F.when(F.col("_gate"), T.match_title(d)))
    tech = F.when(F.col("_norm") != "", F.least(F.size(T.found_parts(F.col("_norm"), fixed.TECH_WORDS)) * 2, F.lit(10))).otherwise(0)
    total = F.col("_base") + F.when(F.col("_hinted"), 5.0).otherwise(0.0) + tech
    exact, near = F.col("_gate") & F.col("_exact").isNotNull(), F.col("_gate") & (total >= threshold)
    passes = exact | near
    if semantic is not None:
        passes = passes & (exact | (F.length(F.trim(T.text(d))) < 40) | F.coalesce(semantic(t, d), F.lit(True)))
    matched = F.coalesce(passes, F.lit(False))
    score = F.when(exact, 100.0).when(F.col("_gate"), F.least(F.lit(100.0), total)).otherwise(0.0)
    return rows.select(*[named(c) for c in df.columns], matched.alias("matched"), F.when(matched, F.coalesce("_exact", "_role")).alias("matched_role"), F.coalesce(score, F.lit(0.0)).alias("match_score"))


def filter_by_role(df: DataFrame, *, min_score: float = 50.0, order: str = "pos", **options) -> DataFrame:
    """The matching rows of a score at least min_score, best first, equal scores in the given order."""
    rows = match_roles(df, **options).where(F.col("matched") & (F.col("match_score") >= min_score))
    return rows.withColumn("match_score", F.bround("match_score", 1)).orderBy(F.col("match_score").desc(), order)


def semantic_gate(vectors: DataFrame, roles: DataFrame, *, threshold: float = 0.65, ident: str = "id", vector: str = "vector") -> DataFrame:
    """Per id: best (highest cosine with a role vector, -1 if none can be compared) and passes; a missing vector has no best and passes, and without roles all do."""
    if roles.isEmpty():
        return vectors.select(ident, F.lit(None).cast("double").alias("best"), F.lit(True).alias("passes"))
    targets = roles.select(F.monotonically_increasing_id().alias("target"), vector)
    known = alike.nearest(vectors.where(F.col(vector).isNotNull()), targets, ident=ident, vector=vector)
    none = vectors.where(F.col(vector).isNull()).select(ident, F.lit(None).cast("double").alias("best"), F.lit(True).alias("passes"))
    return known.select(ident, "best", (F.col("best") >= threshold).alias("passes")).unionByName(none)


def semantic_text_gate(
    df: DataFrame, roles: DataFrame, make: Callable[[], embed.Encoder], *, threshold: float = 0.65, title: str = "title", description: str = "description", role: str = "role", most: int = 250
) -> DataFrame:
    """df with best and passes of semantic_gate, from vectors of the title with the first `most` characters of the description and of the roles' names.

    Each distinct text is encoded once. What can't be encoded passes.
    """
    text = F.trim(F.concat(T.text(F.col(title)), F.lit(" "), F.substring(T.text(F.col(description)), 1, most)))
    rows = df.withColumn("_text", text)
    vectors = stash(rows.select("_text").distinct().select(F.col("_text").alias("id"), embed.encoded(F.col("_text"), make).alias("vector")), "vectors")
    named = stash(roles.select(F.col(role).alias("_role")).distinct().select(embed.encoded(F.col("_role"), make).alias("vector")), "roles")
    judged = semantic_gate(vectors, named.where("vector IS NOT NULL"), threshold=threshold)
    return rows.join(judged.withColumnRenamed("id", "_known"), F.col("_text") == F.col("_known")).drop("_text", "_known")


def _plain(s: str) -> str:
    """What match_title makes of a text."""
    return " ".join("".join(ch if ch.isalnum() or ch in "_ " else " " for ch in s.lower()).split())


def _nth(position: Column, values: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), position)


def target_title(title: Column, targets: Sequence[str], gate: Column | None = None) -> Column:
    """The first target that the title equals, is a synonym of, or is alike by a token-set ratio of 80; null outside of the gate.

    Only titles within the gate reach Python.
    """
    norm = T.match_title(title)
    norm = norm if gate is None else F.when(gate, norm)
    same = F.coalesce(*[F.when(norm.isin(*{_plain(w) for w in (t, *fixed.TITLE_SYNONYMS.get(t, ()))}), F.lit(k)) for k, t in enumerate(targets)])
    return _nth(F.least(same, first_alike(norm, [_plain(t) for t in targets], 80)), targets)


def contextual_match(description: Column, words: Sequence[str], gate: Column | None = None) -> Column:
    """The first word that is nearly part of the sentences about a role (a partial ratio of 85); null outside of the gate."""
    sentences = F.filter(F.transform(F.split(F.lower(T.text(description)), r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: (s != "") & T.has_part(s, fixed.CONTEXT_TERMS))
    joined = F.nullif(F.array_join(sentences, "\n"), F.lit(""))
    words = [w for w in words if w.strip()]
    return _nth(first_alike(joined if gate is None else F.when(gate, joined), [w.lower().strip() for w in words], 85, lambda a, b: partial(a, b, 85)), words)


def inclusion(title: Column, description: Column, words: Sequence[str], fuzzy_threshold: int = 70, gate: Column | None = None) -> Column:
    """Struct of keyword and source: in the title, in the description, a title hint, a sentence on a role, or alike as a whole.

    What the first three find, or the gate leaves out, doesn't reach Python.
    """
    gate = F.lit(True) if gate is None else gate
    if not words:
        return F.when(gate, F.struct(F.lit("No filter").alias("keyword"), F.lit("no filter").alias("source")))
    words = [w for w in words if w.strip()]
    both = F.lower(F.concat_ws(" ", T.text(title), T.text(description)))
    plain = ((T.first_word(title, words), "title match"), (T.first_word(description, words), "description match"), (title_hint(title), "title match"))
    waits = gate & F.coalesce(*[k for k, _ in plain]).isNull()
    alike = _nth(first_alike(F.when(waits, both), [w.lower() for w in words], max(70, fuzzy_threshold)), words)
    found = (*plain, (contextual_match(description, words, waits), "description match"), (alike, "description match"))
    return F.when(gate, F.coalesce(*[F.when(k.isNotNull(), F.struct(k.alias("keyword"), F.lit(s).alias("source"))) for k, s in found]))


def qualify(df: DataFrame, targets: Sequence[str], words: Sequence[str], now: Column, *, max_age_days: int = 7, use_level: bool = False, confidence: int = 70, skills: tuple[str, ...] = ()) -> DataFrame:
    """df with the fields of a qualified posting and reject_reason (null if it qualifies), gates in order; what a gate rejects isn't looked at by later ones.

    Reads job_id, job_title, job_description, job_posted_at_datetime_utc and job_apply_link.
    """
    clean = {c: F.trim(T.text(F.col(c))) for c in ("job_id", "job_title", "job_description", "job_posted_at_datetime_utc", "job_apply_link")}
    rows = df.withColumns(clean)
    title, body = F.col("job_title"), F.col("job_description")
    some = (title != "") | (F.col("job_id") != "")
    rows = rows.withColumns({"matched_as": target_title(title, targets, some), "_excluded": exclusion(title, body), "_hint": title_hint(title), "_level": level(title, body)})
    rows = rows.withColumn("_inclusion", inclusion(title, body, words, gate=F.col("matched_as").isNotNull() & F.col("_excluded").isNull()))
    judged = F.when(F.col("_hint").isNotNull(), F.struct(F.lit(True).alias("entry_level"), F.lit(95).alias("confidence"), F.concat(F.lit("title contains '"), F.col("_hint"), F.lit("'")).alias("reason"))).otherwise(F.col("_level"))
    rows = rows.withColumn("_judged", judged if use_level else F.struct(F.lit(True).alias("entry_level"), F.lit(100).alias("confidence"), F.lit("AI disabled").alias("reason")))
    weak = F.col("_hint").isNull() & F.lit(use_level)
    reason = (
        F.when((title == "") & (F.col("job_id") == ""), "empty")
        .when(F.col("matched_as").isNull(), "no target title")
        .when(F.col("_excluded").isNotNull(), F.col("_excluded"))
        .when(F.col("_inclusion").isNull(), "no inclusion keyword")
        .when(~scores.is_recent(F.col("job_posted_at_datetime_utc"), now, max_age_days), "too old")
        .when(weak & ~F.col("_judged.entry_level"), "not entry level")
        .when(weak & (F.col("_judged.confidence") < confidence), "low confidence")
    )
    match = scores.skill_score(body, skills) if use_level else F.lit(60)
    return rows.select(*df.columns, "matched_as", F.col("_inclusion.keyword").alias("filter_keyword"), F.col("_judged.entry_level").alias("ai_entry_level"), F.col("_judged.confidence").alias("ai_confidence"), match.alias("ai_score"), scores.blended(F.lit(50), match).alias("score"), reason.alias("reject_reason"))


def is_entry_level(title: Column, description: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    both = F.concat_ws(" ", T.text(title), T.text(description))
    barred = T.has_part(both, exclude) if exclude else F.lit(False)
    return exclusion(title, description).isNull() & ~barred & inclusion(title, description, include).isNotNull()


def entry_level_jobs(
    df: DataFrame, *, title: str = "title", description: str = "description", experience: str = "experience", order: str = "pos", site: str | None = None, most: int = 50, **options,
) -> DataFrame:
    """The first `most` rows (of each site, if its column is given) that match a role which isn't senior, or name entry experience in experience or description."""
    rows = match_roles(df, title=title, description=description, **options)
    kept = rows.where(F.col("matched") | entry_experience(F.col(experience)) | entry_experience(F.col(description))).select(*df.columns)
    if site is None:
        return kept.orderBy(order).limit(most)
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy(site).orderBy(order))).where(F.col("_n") <= most).drop("_n")
