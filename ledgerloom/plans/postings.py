"""Queries over titles, descriptions and scores, with the SQL that they are held against.

The tables hold no postings, so titles, places and texts are taken from fixed
lists by key, each list by digits of its own, and documents stand in for descriptions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import embed, fixed, html as H, scores as S, text as T, urls as U
from ledgerloom.operators import alike, dedup, matching as M, planning
from ledgerloom.plans.pages import canonical_sql, table

C = F.col

TITLES = (
    "Senior Software Engineer", "Associate Data Engineer", "Junior Software Engineer (Remote)", "AI Engineer", "Learn more about services",
    "Graduate Trainee - ML Engineer", "Sr. Developer", "Lead Data Scientist", "Data Analyst", "Fresh Graduate / Intern",
    "Associate AI Engineer [Lahore]", "VP of Engineering", "Entry Level Software Engineer", "", "Backend Developer, Payments", "careers",
)
PLACES = ("Remote - EU", "Lahore, Pakistan", "Karachi", "N/A", "", "Berlin (Mitte)", "Islamabad Office", "pakistan", "New  York, NY")
TEXTS = (
    "We need python and SQL, docker, 5+ years of experience.", "Graduate role for new people; aws, azure.", "You will lead a team of engineers.",
    "No requirements.", "Entry position. Agile and scrum, git; rest api.", "3 years with react and typescript", "", "Internship for 0-2 years, machine learning",
)


def pick(values: tuple[str, ...], key: str):
    """The value that the key (a column or an expression) names, by remainder."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.expr(key) % len(values) + 1).cast("int"))


def pick_sql(values: tuple[str, ...], key: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{quoted}], CAST({key} % {len(values)} + 1 AS INTEGER))"


def _posts(spark, sf_dir):
    rows = table(spark, sf_dir, "part", "p_partkey", "p_brand")
    return rows.select(C("p_partkey").alias("id"), C("p_brand").alias("company"), pick(TITLES, "p_partkey").alias("title"), pick(PLACES, "p_partkey div 16").alias("place"), pick(TEXTS, "p_partkey div 144").alias("body"))


POSTS = f"posts AS (SELECT p_partkey AS id, p_brand AS company, {pick_sql(TITLES, 'p_partkey')} AS title, {pick_sql(PLACES, '(p_partkey // 16)')} AS place, {pick_sql(TEXTS, '(p_partkey // 144)')} AS body FROM part)"

SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
NORMAL_TITLE = SQUEEZE.format(r"regexp_replace(regexp_replace(regexp_replace(" + SQUEEZE.format("lower(title)") + r", '\([^)]*\)|\[[^\]]*\]|\{[^}]*\}', ' ', 'g'), '[|\-/]+', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g')")
NORMAL_TEXT = SQUEEZE.format("lower({})")
FAMILIES = " ".join(f"WHEN contains(p, '{f}') THEN '{f}'" for f in fixed.LOCATION_FAMILIES)


def location_sql(named: str = "'unknown'") -> str:
    return f"CASE WHEN p IN ('', 'not specified', 'n/a', 'na', 'none', '-') THEN {named} {FAMILIES} ELSE " + SQUEEZE.format(r"regexp_replace(p, '[^a-z0-9\s]', ' ', 'g')") + " END"


MATCH_TITLE = SQUEEZE.format(r"regexp_replace(lower(title), '[^\p{L}\p{N}_\s]', ' ', 'g')")


def has_word_sql(text: str, words) -> str:
    return "(" + " OR ".join(rf"regexp_matches({text}, '(^|[^\p{{L}}\p{{N}}_]){w if w.startswith('(?') else re_quote(w)}" + (r"($|[^\p{L}\p{N}_])" if w[-1].isalnum() or w[-1] in ")?" else r"[\p{L}\p{N}_]") + "')" for w in words) + ")"


def re_quote(w: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}-" else ch for ch in w)


def has_part_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def first_word_sql(text: str, words) -> str:
    return "CASE " + " ".join(f"WHEN {has_word_sql(text, [w])} THEN '{w}'" for w in words) + " END"


def job_hash(spark, sf_dir):
    rows = _posts(spark, sf_dir).withColumn("link", F.concat(F.lit("HTTPS://Example.com//jobs/"), C("id"), F.lit("/?utm_source=x")))
    args = (C("title"), C("place"), C("link"))
    return rows.select("id", U.posting_hash(C("company"), *args).alias("hash"), U.posting_key(*args).alias("key"), U.title_location(C("title"), C("place")).alias("place_key"), U.stable_key(C("title"), C("company"), C("link")).alias("stable"))


def dedup_keys(spark, sf_dir):
    rows = _posts(spark, sf_dir).withColumn("link", F.when(C("id") % 3 != 0, F.concat(F.lit("https://example.com/jobs/"), C("id") % 50, F.lit("?ref=a&gclid=b"))))
    return rows.select("id", U.table_key(C("title"), C("company"), C("link")).alias("row_key"), U.opening_key(C("title"), C("company"), C("place"), C("link")).alias("opening_key"), U.change_token(F.lit("NEW"), C("company"), C("title"), C("place"), C("link")).alias("token"), U.fingerprint(C("title"), C("link")).alias("fingerprint"))


def location_canon(spark, sf_dir):
    rows = _posts(spark, sf_dir)
    return rows.select("id", U.normal_location(C("place")).alias("plain"), U.normal_location(C("place"), F.concat(F.lit("https://e.com/"), C("id"))).alias("named"))


def keyword_first_hit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", T.first_word(C("text"), ("zzz", "the", "de", "und", "und", "is")).alias("hit"), F.size(T.found_parts(C("text"), ("ing", "ion", "heit", "xx"))).alias("parts"))


def seniority_flag(spark, sf_dir):
    rows = _posts(spark, sf_dir)
    return rows.select("id", M.exclusion(C("title"), C("body")).alias("reason"), M.title_hint(C("title")).alias("hint"), M.senior_role(C("title"), C("body")).alias("senior"), M.associate_role(C("title"), C("body")).alias("associate"), M.entry_experience(C("body")).alias("entry"))


def title_policy(spark, sf_dir):
    rows = _posts(spark, sf_dir)
    t = C("title")
    return rows.select("id", M.strict_policy(t).alias("strict"), M.non_job_title(t).alias("non_job"), M.role_title(t).alias("role"), M.valid_title(t).alias("valid"), M.posting_title(t).alias("posting"))


def valid_postings(spark, sf_dir):
    rows = _posts(spark, sf_dir).withColumn("link", F.element_at(F.array(*[F.lit(x) for x in ("https://e.com/jobs/1", "https://e.com/blog/jobs", "https://e.com/about", "", "https://e.com/careers")]), (C("id") % 5 + 1).cast("int")))
    return rows.where(M.valid_posting(C("title"), C("link"), F.lit(""), F.lit("https://e.com/careers/"))).select("id", "link")


def level_classifier(spark, sf_dir):
    verdict = _posts(spark, sf_dir).select("id", M.level(C("title"), C("body")).alias("v"))
    return verdict.select("id", "v.entry_level", "v.confidence", "v.reason")


def tech_score_topk(spark, sf_dir):
    rows = _posts(spark, sf_dir)
    scored = rows.select("id", S.skill_score(C("body"), ("python", "sql", "aws", "git")).alias("score"), F.round(S.keyword_share(C("body"), ("python", "react", "role")), 6).alias("share"))
    return scored.orderBy(C("score").desc(), "id").limit(50)


def scores_and_dates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    now = F.lit("1998-06-15 00:00:00").cast("timestamp")
    posted = F.when(C("o_orderkey") % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    raw = F.when(C("o_orderkey") % 5 == 0, F.lit("n/a")).otherwise((C("o_totalprice") / 1000 - 20).cast("string"))
    return rows.select("o_orderkey", S.is_recent(posted, now).alias("recent"), S.days_ago(posted, now).alias("age"), S.clamped(raw, 40).alias("clamped"), S.blended((C("o_orderkey") % 101), (C("o_orderkey") % 97)).alias("blended"), S.relevance(C("o_orderpriority"), F.lit("low"), posted, F.lit("Careem")  , now).alias("relevance"))


def role_match_cross(spark, sf_dir):
    rows = _posts(spark, sf_dir).select("id", "title", C("body").alias("description"))
    return M.match_roles(rows, fuzzy=False).select("id", "matched", "matched_role", "match_score")


def role_match_fuzzy(spark, sf_dir):
    rows = _posts(spark, sf_dir).select("id", "title", C("body").alias("description"))
    return M.filter_by_role(rows, order="id", strict=False).select("id", "matched_role", "match_score")


def qualified_postings(spark, sf_dir):
    rows = _posts(spark, sf_dir).select(C("id").cast("string").alias("job_id"), C("title").alias("job_title"), C("body").alias("job_description"), F.lit("1998-06-14T00:00:00Z").alias("job_posted_at_datetime_utc"), F.lit("").alias("job_apply_link"))
    return M.qualify(rows, fixed.ROLES[:4], ("graduate", "junior"), F.lit("1998-06-15").cast("timestamp"), use_level=True, skills=("python", "sql")).drop("job_title", "job_description", "job_posted_at_datetime_utc", "job_apply_link")


def semantic_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    roles = dedup.first_wins(rows, ["label"], ["vec_id"]).select(C("embedding").alias("vector"))
    out = M.semantic_gate(rows.select(C("vec_id").alias("id"), C("embedding").alias("vector")), roles)
    return out.select("id", F.round("best", 4).alias("best"), (F.round("best", 4) >= 0.65).alias("passes"))


def semantic_text_gate(spark, sf_dir):
    """Postings whose title and text are near a role, by counts of letter runs."""
    rows = _posts(spark, sf_dir).select("id", "title", C("body").alias("description"))
    roles = spark.createDataFrame([(r,) for r in fixed.ROLES], "role string")
    return M.semantic_text_gate(rows, roles, embed.hashing_encoder, threshold=0.5).select("id", F.round("best", 6).alias("best"), (F.round("best", 6) >= 0.5).alias("passes"))


def nearest_vectors(spark, sf_dir):
    """For each vector with an even id, the nearest one with an odd id."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    odd = rows.where("vec_id % 2 = 1").select(C("vec_id").alias("target"), C("embedding").alias("vector"))
    found = alike.nearest(rows.where("vec_id % 2 = 0").select(C("vec_id").alias("id"), C("embedding").alias("vector")), odd)
    return found.select("id", F.round("best", 5).alias("best"))


def titles_alike(spark, sf_dir):
    """All pairs of titles, of a page with an even id and one with an odd id, that are alike by 60."""
    pages = table(spark, sf_dir, "pages", "page_id", "html").select("page_id", T.match_title(H.page_title(C("html"))).alias("title"))
    return alike.alike(pages.where("page_id % 2 = 0").select("title"), pages.where("page_id % 2 = 1").select("title"), least=60)


def query_plan(spark, sf_dir):
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_name").select(C("n_name").alias("value"), C("n_nationkey").alias("pos"))
    region = table(spark, sf_dir, "region", "r_regionkey", "r_name").select(C("r_name").alias("value"), C("r_regionkey").alias("pos"))
    firms = table(spark, sf_dir, "supplier", "s_suppkey", "s_name").select(C("s_name").alias("value"), C("s_suppkey").alias("pos"))
    return planning.query_plan(nation, region, firms, budget=40, company_budget=4)


def query_variants(spark, sf_dir):
    return planning.query_variants(table(spark, sf_dir, "supplier", "s_name").withColumnRenamed("s_name", "company"))


EMPLOYERS = ("Acme Data Labs", "acme  DATA", "Data Acme", "Acme", "Big Firm Ltd", "The Acme Data Co", "Acmedata", "big-firm", "Firm Big Ltd", "")
HINTS = ("Acme Data Labs", "big firm", "Acme", "", "data")


def _words_sql(name: str) -> str:
    """The first four telling words of a company's name, as a list."""
    plain = SQUEEZE.format(rf"regexp_replace(regexp_replace(lower(trim({name})), '[\-_+]+', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g')")
    stop = ", ".join(f"'{w}'" for w in sorted(fixed.COMPANY_STOP_WORDS))
    return f"list_filter(string_split({plain}, ' '), lambda w: w NOT IN ({stop}) AND length(w) > 1)[1:4]"


def employer_match(spark, sf_dir):
    rows = table(spark, sf_dir, "customer", "c_custkey")
    return rows.select("c_custkey", U.company_matches(pick(HINTS, "c_custkey div 10"), pick(EMPLOYERS, "c_custkey")).alias("same"))


def summaries(spark, sf_dir):
    rows = _posts(spark, sf_dir)
    return rows.select("id", F.array_join(T.bullet_summary(C("title"), C("company"), C("body")), "\n").alias("summary"), F.element_at(T.cover_points(C("title"), C("company"), F.lit("")), 1).alias("point"))


def truth_values(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderkey")
    return rows.select("o_orderkey", T.truthy(pick((" Yes", "no", "1", "TRUE ", "off", "on"), "o_orderkey")).alias("truth"))


_SENIOR_TITLE = [w for w in ("senior", "lead", "principal", "staff", "director", "head", "vp", "vice president", "chief", "cto", "cio", "cfo")]
_B, _A = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
_DESC = "CASE " + " ".join(f"WHEN regexp_matches(lower(body), '{_B}{p}{_A}') THEN regexp_extract(lower(body), '{_B}({p}){_A}', 2)" for p in fixed.DESCRIPTION_EXCLUDES) + " END"
_SENIOR = f"(({has_word_sql('lower(title)', _SENIOR_TITLE)} OR regexp_matches(lower(title), '{_B}sr{_A}') OR {' OR '.join(f'''regexp_matches(lower(body), '{_B}{p}{_A}')''' for p in fixed.SENIOR_DESCRIPTION)}) AND NOT {has_word_sql('lower(title)', fixed.ENTRY_HINTS)})"
_ALL_TEXT = "lower(title) || ' ' || lower(body)"
_STRICT = f"(t <> '' AND NOT {has_word_sql('t', fixed.STRICT_REJECT)} AND ({has_part_sql('t', fixed.STRICT_ALLOWED)} OR ({has_part_sql('t', fixed.STRICT_BASE)} AND {has_part_sql('t', fixed.STRICT_HINTS)})))"
_NON_JOB = rf"(t = '' OR length(trim(title)) < 5 OR length(trim(title)) > 180 OR {has_part_sql('t', fixed.NON_JOB_PHRASES)} OR regexp_full_match(trim(title), '[^\p{{L}}]+'))"
_ROLE = f"(NOT {_NON_JOB} AND {has_word_sql('t', fixed.ROLE_WORDS)})"
_VALID = rf"(length(trim(title)) BETWEEN 5 AND 180 AND lower(trim(title)) NOT IN ({', '.join(repr(x) for x in fixed.BAD_TITLES)}) AND NOT {has_part_sql('lower(title)', fixed.BAD_TITLE_TOKENS)} AND NOT regexp_full_match(trim(title), '[^\p{{L}}]+'))"
_POSTING = f"(contains(trim(title), ' ') AND NOT {has_part_sql('lower(title)', fixed.NON_ROLE_PHRASES + fixed.MARKETING_PHRASES)} AND {has_word_sql('lower(title)', fixed.POSTING_ROLE_WORDS)})"


def _role_variants() -> str:
    plain = lambda s: " ".join("".join(ch if ch.isalnum() else " " for ch in s.lower()).split())
    rows = []
    for i, role in enumerate(fixed.ROLES):
        same = {v for head, others in fixed.ROLE_SYNONYMS.items() if plain(role) in {plain(head), *map(plain, others)} for v in map(plain, (head, *others))}
        rows.append(f"({i}, '{role}', '{plain(role)}', [{', '.join(repr(v) for v in sorted(same))}]::VARCHAR[])")
    return ", ".join(rows)


def lcs_sql(pairs: str) -> str:
    """Tables ending in lcs(a, b, c): the length c of the longest common subsequence of each of the pairs (a, b)."""
    return f"""lp AS (SELECT DISTINCT a, b FROM ({pairs}) WHERE a <> '' AND b <> ''),
        lr AS (SELECT a, b, 1 AS i, list_transform(range(length(b) + 1), lambda x: 0) AS v FROM lp UNION ALL
            SELECT a, b, i + 1, list_transform(range(length(b) + 1), lambda j: list_max(list_transform(range(j + 1), lambda q: greatest(v[q + 1], CASE WHEN q > 0 AND a[i] = b[q] THEN v[q] + 1 ELSE 0 END)))) FROM lr WHERE i <= length(a)),
        lcs AS (SELECT a, b, v[length(b) + 1] AS c FROM lr WHERE i = length(a) + 1)"""


def token_sets_sql(pairs: str, more: str = "") -> str:
    """Tables ending in ratios(x, y, ratio): the token-set ratio of the pairs (x, y); `more` adds pairs (a, b) to the table lcs."""
    rest = "array_to_string(list_sort(list_filter({}, lambda w: NOT list_contains({}, w))), ' ')"
    return f"""ts AS (SELECT DISTINCT x, y, list_distinct(list_filter(string_split(x, ' '), lambda w: w <> '')) AS p, list_distinct(list_filter(string_split(y, ' '), lambda w: w <> '')) AS q FROM ({pairs}) WHERE x <> '' AND y <> ''),
        td AS (SELECT x, y, array_to_string(list_sort(list_intersect(p, q)), ' ') AS s, {rest.format('p', 'q')} AS a, {rest.format('q', 'p')} AS b FROM ts),
        {lcs_sql('SELECT a, b FROM td' + more)},
        tl AS (SELECT td.*, coalesce(c, 0) AS c, length(s) AS n, length(s) + CASE WHEN s <> '' AND a <> '' THEN 1 ELSE 0 END + length(a) AS na, length(s) + CASE WHEN s <> '' AND b <> '' THEN 1 ELSE 0 END + length(b) AS nb FROM td LEFT JOIN lcs USING (a, b)),
        ratios AS (SELECT x, y, CASE WHEN s <> '' AND (a = '' OR b = '') THEN 100 ELSE greatest(round_even(200.0::DOUBLE * (c + CASE WHEN s <> '' THEN n + 1 ELSE 0 END) / (na + nb), 0),
            CASE WHEN s <> '' THEN round_even(200.0::DOUBLE * n / (n + na), 0) ELSE 0 END, CASE WHEN s <> '' THEN round_even(200.0::DOUBLE * n / (n + nb), 0) ELSE 0 END) END AS ratio FROM tl)"""


_TECH = "len(list_filter([" + ", ".join(f"'{w}'" for w in fixed.TECH_WORDS) + "], lambda w: contains(b, w)))"
_BODY = SQUEEZE.format(r"regexp_replace(lower(body), '[^\p{L}\p{N}_\s]', ' ', 'g')")
_LEVEL = f"""CASE WHEN {has_part_sql('lower(title)', fixed.LEVEL_ENTRY)} AND NOT {has_part_sql('lower(title)', fixed.LEVEL_SENIOR)} THEN 1
            WHEN {has_part_sql(_ALL_TEXT, fixed.LEVEL_SENIOR)} OR regexp_matches({_ALL_TEXT}, '{_B}([4-9]|\\d{{2}})\\+?\\s*(years?|yrs?){_A}') THEN 2 WHEN {has_part_sql(_ALL_TEXT, fixed.LEVEL_ENTRY)} THEN 3 ELSE 4 END"""


def _targets(targets) -> str:
    plain = lambda s: " ".join("".join(ch if ch.isalnum() else " " for ch in s.lower()).split())
    return ", ".join(f"({k}, '{t}', '{plain(t)}', [{', '.join(repr(plain(x)) for x in (t, *fixed.TITLE_SYNONYMS.get(t, ())))}]::VARCHAR[])" for k, t in enumerate(targets))


QUERIES = {
    "job_hash": (job_hash, f"""WITH {POSTS}, p AS (SELECT *, {NORMAL_TEXT.format('place')} AS p, 'https://example.com/jobs/' || id AS l, {NORMAL_TITLE} AS t FROM posts)
        SELECT id, sha256({NORMAL_TEXT.format('company')} || '|' || t || '|' || ({location_sql("'url-' || left(sha1(l), 8)")}) || '|' || l) AS hash, 'url|' || l AS key, t || '|' || ({location_sql()}) AS place_key,
            sha256(lower(trim(title)) || '|' || lower(trim(company)) || '|' || l || '/') AS stable FROM p"""),
    "dedup_keys": (dedup_keys, f"""WITH {POSTS}, p AS (SELECT *, {NORMAL_TEXT.format('place')} AS p, {NORMAL_TITLE} AS t, CASE WHEN id % 3 <> 0 THEN 'https://example.com/jobs/' || id % 50 ELSE '' END AS l FROM posts),
        k AS (SELECT *, 'fp|' || lower(company) || '|' || t || '|' || CASE WHEN l = '' THEN {location_sql()} ELSE {location_sql("'url-' || left(sha1(l), 8)")} END AS fp FROM p)
        SELECT id, CASE WHEN l <> '' THEN 'link|' || l || '?ref=a' ELSE 'title_company|' || {NORMAL_TEXT.format('title')} || '|' || lower(company) END AS row_key,
            CASE WHEN l <> '' THEN 'title_link|' || fp || '|' || l || '?ref=a' WHEN t <> '' THEN 'title_only|' || fp ELSE '' END AS opening_key,
            'new|' || lower(company) || '|' || {NORMAL_TEXT.format('title')} || '|' || CASE WHEN p = '' THEN 'not specified' ELSE p END || '|' || l AS token,
            lower(trim(title)) || '|' || CASE WHEN l = '' THEN '' ELSE l || '?ref=a&gclid=b' END AS fingerprint FROM k"""),
    "location_canon": (location_canon, f"""WITH {POSTS}, p AS (SELECT *, {NORMAL_TEXT.format('place')} AS p FROM posts) SELECT id, {location_sql()} AS plain, {location_sql("'url-' || left(sha1('https://e.com/' || id), 8)")} AS named FROM p"""),
    "keyword_first_hit": (keyword_first_hit, f"SELECT doc_id, {first_word_sql('lower(text)', ('zzz', 'the', 'de', 'und', 'is'))} AS hit, CAST(len(list_filter(['ing', 'ion', 'heit', 'xx'], lambda w: contains(lower(text), w))) AS INTEGER) AS parts FROM documents"),
    "seniority_flag": (seniority_flag, f"""WITH {POSTS}, e AS (SELECT *, {first_word_sql('lower(title)', fixed.TITLE_EXCLUDES)} AS a, {_DESC} AS d FROM posts)
        SELECT id, CASE WHEN a IS NOT NULL THEN 'title contains ''' || a || '''' WHEN d IS NOT NULL THEN 'description contains ''' || d || '''' END AS reason, {first_word_sql('lower(title)', fixed.TITLE_HINTS)} AS hint, {_SENIOR} AS senior,
            {has_part_sql(_ALL_TEXT, fixed.ASSOCIATE_WORDS)} AS associate, regexp_matches(body, '(?i){fixed.EXPERIENCE}') AS entry FROM e"""),
    "title_policy": (title_policy, f"WITH {POSTS}, p AS (SELECT *, {MATCH_TITLE} AS t FROM posts) SELECT id, {_STRICT} AS strict, {_NON_JOB} AS non_job, {_ROLE} AS role, {_VALID} AS valid, {_POSTING} AS posting FROM p"),
    "valid_postings": (valid_postings, f"""WITH {POSTS}, p AS (SELECT *, {pick_sql(("https://e.com/jobs/1", "https://e.com/blog/jobs", "https://e.com/about", "", "https://e.com/careers"), 'id')} AS link FROM posts)
        SELECT id, link FROM p WHERE {_VALID} AND {_POSTING} AND link = 'https://e.com/jobs/1'"""),
    "level_classifier": (level_classifier, f"""WITH {POSTS}, v AS (SELECT id, {_LEVEL} AS c FROM posts)
        SELECT id, c <> 2 AS entry_level, [55, 90, 82, 72][c] AS confidence, ['entry-level title hint detected', 'seniority keywords or high-experience requirement detected', 'entry-level keywords detected', 'no seniority signals detected'][c] AS reason FROM v"""),
    "tech_score_topk": (tech_score_topk, f"""WITH {POSTS} SELECT id, CAST(floor(45 + len(list_filter(['python', 'sql', 'aws', 'git'], lambda w: contains(lower(body), w))) / 4.0 * 50) AS INTEGER) AS score,
            round(len(list_filter(['python', 'react', 'role'], lambda w: contains(lower(body), w))) / 3.0::DOUBLE, 6)::DOUBLE AS share FROM posts ORDER BY score DESC, id LIMIT 50"""),
    "scores_and_dates": (scores_and_dates, """
        WITH o AS (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS p, datediff('day', CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END, TIMESTAMP '1998-06-15') AS d, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 1000 - 20 END AS r FROM orders)
        SELECT o_orderkey, coalesce(p >= TIMESTAMP '1998-06-08', true) AS recent, CASE WHEN d IS NULL THEN '' WHEN d <= 0 THEN 'today' WHEN d = 1 THEN '1 day ago' WHEN d < 7 THEN d || ' days ago' WHEN d // 7 = 1 THEN '1 week ago' ELSE d // 7 || ' weeks ago' END AS age,
            CAST(greatest(0, least(100, coalesce(trunc(r), 40))) AS INTEGER) AS clamped, CAST(round_even((o_orderkey % 101) * 0.4::DOUBLE + (o_orderkey % 97) * 0.6::DOUBLE, 0) AS INTEGER) AS blended,
            CASE WHEN contains(lower(o_orderpriority), 'low') THEN 50 ELSE 0 END + CASE WHEN p > TIMESTAMP '1998-06-12' THEN 30 ELSE 0 END + 20 AS relevance FROM o"""),
    "role_match_cross": (role_match_cross, f"""WITH {POSTS}, r AS (SELECT * FROM (VALUES {_role_variants()}) AS v(i, role, n, same)),
        g AS (SELECT id, t, title, b FROM (SELECT *, {MATCH_TITLE} AS t, {_BODY} AS b FROM posts) WHERE trim(title) <> '' AND {_ROLE} AND {_STRICT} AND NOT {_SENIOR.replace('lower(body)', 'b')}),
        s AS (SELECT id, i, role, t = n AS exact, greatest(CASE WHEN contains(t, n) THEN 90 ELSE 0 END, CASE WHEN len(list_filter(same, lambda v: contains(t, v))) > 0 THEN 85 ELSE 0 END)::DOUBLE AS base,
            CASE WHEN {has_word_sql('lower(title)', fixed.ENTRY_HINTS)} THEN 5 ELSE 0 END + CASE WHEN b <> '' THEN least({_TECH} * 2, 10) ELSE 0 END AS bonus FROM g, r),
        m AS (SELECT id, arg_max(role, base * 1000 - i) AS role, max(base) + any_value(bonus) AS score, min(role) FILTER (exact) AS same FROM s GROUP BY id)
        SELECT posts.id, coalesce(m.same IS NOT NULL OR score >= 75, false) AS matched, CASE WHEN m.same IS NOT NULL OR score >= 75 THEN coalesce(m.same, m.role) END AS matched_role,
            (CASE WHEN m.id IS NULL THEN 0 WHEN m.same IS NOT NULL THEN 100 ELSE least(100, score) END)::DOUBLE AS match_score FROM posts LEFT JOIN m USING (id)"""),
    "role_match_fuzzy": (role_match_fuzzy, f"""WITH RECURSIVE {POSTS}, r AS (SELECT * FROM (VALUES {_role_variants()}) AS v(i, role, n, same)),
        g AS (SELECT id, t, title, b FROM (SELECT *, {MATCH_TITLE} AS t, {_BODY} AS b FROM posts) WHERE trim(title) <> '' AND {_ROLE} AND NOT {_SENIOR.replace('lower(body)', 'b')}),
        {token_sets_sql('SELECT t AS x, n AS y FROM g, r')},
        s AS (SELECT id, i, role, t = n AS exact, greatest(CASE WHEN contains(t, n) THEN 90 ELSE 0 END, CASE WHEN len(list_filter(same, lambda v: contains(t, v))) > 0 THEN 85 ELSE 0 END, CASE WHEN ratio >= 80 THEN ratio * 0.9 ELSE 0 END)::DOUBLE AS base,
            CASE WHEN {has_word_sql('lower(title)', fixed.ENTRY_HINTS)} THEN 5 ELSE 0 END + CASE WHEN b <> '' THEN least({_TECH} * 2, 10) ELSE 0 END AS bonus FROM g, r JOIN ratios ON x = t AND y = n),
        m AS (SELECT id, arg_max(role, base * 1000 - i) AS role, max(base) + any_value(bonus) AS score, min(role) FILTER (exact) AS same FROM s GROUP BY id)
        SELECT id, coalesce(m.same, m.role) AS matched_role, round_even((CASE WHEN m.same IS NOT NULL THEN 100 ELSE least(100, score) END)::DOUBLE, 1) AS match_score FROM m WHERE m.same IS NOT NULL OR score >= 75"""),
    "qualified_postings": (qualified_postings, f"""WITH RECURSIVE {POSTS}, t AS (SELECT * FROM (VALUES {_targets(fixed.ROLES[:4])}) AS v(k, target, n, same)), w AS (SELECT * FROM (VALUES (0, 'graduate'), (1, 'junior')) AS v(k, word)),
        p AS (SELECT *, {MATCH_TITLE} AS x, lower(title) || ' ' || lower(body) AS bt, {first_word_sql('lower(title)', fixed.TITLE_EXCLUDES)} AS e, {_DESC} AS d, {first_word_sql('lower(title)', fixed.TITLE_HINTS)} AS hint,
            {first_word_sql('lower(title)', ('graduate', 'junior'))} AS one, {first_word_sql('lower(body)', ('graduate', 'junior'))} AS two,
            array_to_string(list_filter(list_transform(regexp_split_to_array(lower(body), '[.!?\\n]+'), lambda y: trim(y)), lambda y: y <> '' AND {has_part_sql('y', fixed.CONTEXT_TERMS)}), chr(10)) AS said,
            {_LEVEL} AS c FROM posts),
        sw AS (SELECT DISTINCT said, k, word, CASE WHEN length(word) <= length(said) THEN word ELSE said END AS a, CASE WHEN length(word) <= length(said) THEN said ELSE word END AS l FROM p, w WHERE said <> ''),
        sb AS (SELECT *, substring(l, i, length(a)) AS b FROM (SELECT *, unnest(range(1, length(l) - length(a) + 2)) AS i FROM sw)),
        {token_sets_sql('SELECT x, n AS y FROM p, t UNION ALL SELECT word, bt FROM p, w', ' UNION ALL SELECT a, b FROM sb')},
        near AS (SELECT said, arg_min(word, k) AS word FROM sb LEFT JOIN lcs USING (a, b) WHERE contains(l, a) OR round_even(100.0::DOUBLE * coalesce(c, 0) / length(a), 0) >= 85 GROUP BY said),
        alike AS (SELECT y AS bt, arg_min(word, k) AS word FROM ratios JOIN w ON x = word WHERE ratio >= 70 GROUP BY y),
        m AS (SELECT p.id, arg_min(target, t.k) AS target FROM p, t LEFT JOIN ratios r ON r.x = p.x AND r.y = t.n WHERE list_contains(same, p.x) OR ratio >= 80 GROUP BY p.id),
        j AS (SELECT p.*, target, CASE WHEN e IS NOT NULL THEN 'title contains ''' || e || '''' WHEN d IS NOT NULL THEN 'description contains ''' || d || '''' END AS barred, coalesce(one, two, hint, near.word, alike.word) AS found,
            CAST(floor(45 + len(list_filter(['python', 'sql'], lambda y: contains(lower(body), y))) / 2.0 * 50) AS INTEGER) AS s FROM p LEFT JOIN m USING (id) LEFT JOIN near USING (said) LEFT JOIN alike USING (bt))
        SELECT CAST(id AS VARCHAR) AS job_id, target AS matched_as, CASE WHEN target IS NOT NULL AND barred IS NULL THEN found END AS filter_keyword, hint IS NOT NULL OR c <> 2 AS ai_entry_level, CASE WHEN hint IS NOT NULL THEN 95 ELSE [55, 90, 82, 72][c] END AS ai_confidence,
            s AS ai_score, CAST(round_even(50 * 0.4::DOUBLE + s * 0.6::DOUBLE, 0) AS INTEGER) AS score,
            CASE WHEN target IS NULL THEN 'no target title' WHEN barred IS NOT NULL THEN barred WHEN found IS NULL THEN 'no inclusion keyword' WHEN hint IS NULL AND c = 2 THEN 'not entry level' WHEN hint IS NULL AND c = 1 THEN 'low confidence' END AS reject_reason FROM j"""),
    "semantic_gate": (semantic_gate, """
        WITH r AS (SELECT arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label),
        s AS (SELECT vec_id AS id, round(max(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[])), 4) AS best FROM embeddings, r GROUP BY vec_id) SELECT id, best, best >= 0.65 AS passes FROM s"""),
    "semantic_text_gate": (semantic_text_gate, f"""WITH {POSTS}, r AS (SELECT unnest([{', '.join(f"'{r}'" for r in fixed.ROLES)}]) AS x),
        t AS (SELECT DISTINCT trim(title || ' ' || left(body, 250)) AS x FROM posts), a AS (SELECT x FROM t UNION SELECT x FROM r),
        g AS (SELECT x, CAST('0x' || left(md5(g), 6) AS BIGINT) % 512 AS k, count(*)::DOUBLE AS n FROM (SELECT x, substr(lower(x), CAST(unnest(range(1, length(x) - 1)) AS BIGINT), 3) AS g FROM a) GROUP BY ALL),
        l AS (SELECT x, sqrt(sum(n * n)) AS l FROM g GROUP BY x), d AS (SELECT t.x, r.x AS y, sum(a.n * b.n) AS s FROM t JOIN g AS a USING (x) JOIN g AS b USING (k) JOIN r ON b.x = r.x GROUP BY ALL),
        m AS (SELECT d.x, max(s / a.l / b.l) AS best FROM d JOIN l AS a ON a.x = d.x JOIN l AS b ON b.x = d.y GROUP BY d.x)
        SELECT id, round(CASE WHEN l.x IS NULL THEN -1 ELSE coalesce(best, 0) END, 6) AS best, round(CASE WHEN l.x IS NULL THEN -1 ELSE coalesce(best, 0) END, 6) >= 0.5 AS passes
        FROM posts LEFT JOIN m ON m.x = trim(title || ' ' || left(body, 250)) LEFT JOIN l ON l.x = trim(title || ' ' || left(body, 250))"""),
    "nearest_vectors": (nearest_vectors, """SELECT a.vec_id AS id, round(max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS best FROM embeddings AS a JOIN embeddings AS b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 GROUP BY a.vec_id"""),
    "titles_alike": (titles_alike, None),
    "query_plan": (query_plan, """
        WITH a AS (SELECT s_name || ' careers jobs' AS query, '' AS location, 'COMPANY' AS source, s_name AS company, 0 AS p, s_suppkey AS x, 0 AS y FROM supplier ORDER BY s_suppkey LIMIT 4),
        b AS (SELECT n_name AS query, r_name AS location, 'SEARCH' AS source, '' AS company, 1 AS p, n_nationkey AS x, r_regionkey AS y FROM nation, region), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
        SELECT CAST(row_number() OVER (ORDER BY p, x, y) AS INTEGER) AS step, query, location, source, company FROM u ORDER BY p, x, y LIMIT 40"""),
    "query_variants": (query_variants, f"""WITH f AS (SELECT s_name AS company, unnest(range(5)) AS i FROM supplier) SELECT company, CAST(i AS INTEGER) AS pos, replace([{", ".join(repr(q) for q in fixed.QUERY_VARIANTS)}][i + 1], '%s', company) AS query FROM f"""),
    "employer_match": (employer_match, f"""WITH c AS (SELECT c_custkey, {_words_sql(pick_sql(HINTS, '(c_custkey // 10)'))} AS h, {_words_sql(pick_sql(EMPLOYERS, 'c_custkey'))} AS e FROM customer)
        SELECT c_custkey, len(h) > 0 AND len(e) > 0 AND len(list_filter(h[1:2], lambda w: NOT contains(array_to_string(e, ' '), w))) = 0 AS same FROM c"""),
    "summaries": (summaries, f"""WITH {POSTS} SELECT id, 'Role: ' || CASE WHEN title = '' THEN 'Unknown role' ELSE title END || ' at ' || company || '.' || chr(10) || 'This role passed your entry-level keyword filters.' || chr(10) ||
        'Description highlight: ' || CASE WHEN body = '' THEN 'No description provided.' ELSE body END AS summary,
        'Connect your background to the ' || CASE WHEN title = '' THEN 'role' ELSE title END || ' responsibilities at ' || company || '.' AS point FROM posts"""),
    "truth_values": (truth_values, "SELECT o_orderkey, o_orderkey % 6 IN (0, 2, 3, 5) AS truth FROM orders"),
}
