"""URL filters by rules, and by a tree of path templates per host for what no rule judges.

A rule is a host and a start of a path; it fits the host and its subdomains, and the longest that fits wins. What the rules
say of a host's pages are the labels that its tree learns from.

The tree of a host grows level by level over the segments of its paths. Digits are wildcards; so are the segments
of a node that are rare in it: a segment stays as it is if it has MIN_ROWS rows and one LITERALS-th of its node's rows or more, so a
node has at most LITERALS + 1 branches. Branches that are alike are merged: in order of their labels, each is
compared with what was merged before it, by labels (allowed, blocked, none) and by what follows (nothing, a wildcard, a
word), and joins it if neither chi-square statistic exceeds CRITICAL. Segments below DEPTH are one wildcard.

A template's purity is the share of allowed pages among its labelled ones, smoothed: STRENGTH pages of its parent's
purity are added, down from an even share above the host. Templates of purity below MIN_PURITY are rejected, and so are
pages of theirs that no rule judges. A template without labels thus follows the branches around it, and a host without
labels is allowed.

Rows are counted by host and path before anything else, and the tables of a level are written, so a hot host is
split in counts and joins. No task sees more of a node than its branches.

Defined cases: a null url or one without `://` has an empty host and path, is never fitted by a rule, and is judged like any
other; repeated rows count each; ids may be null or repeated; segments are what stands between slashes, empty ones
left out; no rows give no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.columns import named
from ledgerloom.store import stash

#: (verdict, host and start of the path)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DEPTH = 4
MIN_ROWS = 2
LITERALS = 64
#: 5 % of chi-square with two degrees of freedom.
CRITICAL = 5.991
STRENGTH = 4
MIN_PURITY = 0.25
#: Segments, branches or templates that are broadcast, at most (about 200 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a branch, by label and by what follows.
_COUNTS = ("n", "good", "bad", "ends", "wild")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, its A-Z in lower case, and the path; empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict, or nulls; of equal rules a block wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[0], r[1])):
        own, start = text.split("/", 1)
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def steps(path: Column, depth: int = DEPTH) -> Column:
    """The path's segments with digits as wildcards; those below `depth` are one."""
    found = F.regexp_extract_all(F.regexp_replace(path, "[0-9]+", "*"), F.lit("[^/]+"), 0)
    return F.when(F.size(found) > depth, F.concat(F.slice(found, 1, depth), F.array(F.lit("*")))).otherwise(found)


def _few(rows: DataFrame) -> DataFrame:
    """A written table, broadcast if it is small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _differ(a: Column, b: Column, parts: Sequence) -> Column:
    """Chi-square of the counts of two branches over the parts (functions of a branch)."""
    total = F.lit(0.0)
    for part in parts:
        x, y = part(a).cast("double"), part(b).cast("double")
        total += F.when(x + y > 0, F.pow(x * b["n"] - y * a["n"], F.lit(2.0)) / ((x + y) * a["n"] * b["n"])).otherwise(0.0)
    return total


def _alike(a: Column, b: Column) -> Column:
    labels = (lambda x: x["good"], lambda x: x["bad"], lambda x: x["n"] - x["good"] - x["bad"])
    follows = (lambda x: x["ends"], lambda x: x["wild"], lambda x: x["n"] - x["ends"] - x["wild"])
    return (_differ(a, b, labels) <= CRITICAL) & (_differ(a, b, follows) <= CRITICAL)


def _purity(good: Column, bad: Column, prior: Column) -> Column:
    return (good + STRENGTH * prior) / (good + bad + STRENGTH)


def _merged(branches: DataFrame) -> DataFrame:
    """host, at, branch, to (the node that it is now part of) and purity; branches: host, at, purity, branch and counts."""
    kind = "struct<names:array<string>,n:bigint,good:bigint,bad:bigint,ends:bigint,wild:bigint>"
    own = F.struct(((F.col("good") - F.col("bad")) / F.col("n")).alias("lean"), F.col("branch"), *_COUNTS)
    nodes = branches.groupBy("host", "at").agg(F.any_value("purity").alias("prior"), F.sort_array(F.collect_list(own)).alias("own"))

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        alone = F.struct(F.array(x["branch"]).alias("names"), *[x[c].alias(c) for c in _COUNTS]).cast(kind)
        both = F.struct(F.concat(last["names"], F.array(x["branch"])).alias("names"), *[(last[c] + x[c]).alias(c) for c in _COUNTS]).cast(kind)
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))
        return F.when(F.size(done) == 0, F.array(alone)).when(_alike(last, x), joined).otherwise(F.concat(done, F.array(alone)))

    groups = nodes.select("host", "at", "prior", F.explode(F.aggregate("own", F.array().cast(f"array<{kind}>"), step)).alias("x"))
    to = F.concat("at", F.lit("/"), F.array_join("x.names", "|"))
    return groups.select("host", "at", F.explode("x.names").alias("branch"), to.alias("to"), _purity(F.col("x.good"), F.col("x.bad"), F.col("prior")).alias("purity"))


def templates(seen: DataFrame, depth: int = DEPTH) -> DataFrame:
    """host, steps, template and purity of each path; seen: host, steps and label (1 allowed, 0 blocked, or null), one row a page."""
    counted = seen.groupBy("host", "steps").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("label") == 1, 1)).alias("good"), F.count(F.when(F.col("label") == 0, 1)).alias("bad"))
    counted = stash(counted, "paths")
    hosts = stash(counted.groupBy("host").agg(_purity(F.sum("good"), F.sum("bad"), F.lit(0.5)).alias("purity")), "hosts")
    rows = counted.join(_few(hosts), "host").withColumn("at", F.lit(""))
    deepest = counted.agg(F.max(F.size("steps"))).first()[0] or 0
    for d in range(min(deepest, depth + 1)):
        seg, after = F.get("steps", F.lit(d)), F.get("steps", F.lit(d + 1))
        live = rows.where(F.size("steps") > d)
        kids = live.groupBy("host", "at", seg.alias("seg")).agg(
            F.any_value("purity").alias("purity"), *[F.sum(c).alias(c) for c in ("n", "good", "bad")],
            F.coalesce(F.sum(F.when(after.isNull(), F.col("n"))), F.lit(0)).alias("ends"), F.coalesce(F.sum(F.when(after.contains("*"), F.col("n"))), F.lit(0)).alias("wild"),
        )
        kids = stash(kids, "segments")
        total = stash(kids.groupBy("host", "at").agg(F.sum("n").alias("total")), "nodes")
        often = kids.where((F.col("n") >= MIN_ROWS) & (F.col("seg") != "*")).select("host", "at", "seg", "n")
        kept = stash(often.join(_few(total), ["host", "at"]).where(F.col("n") * LITERALS >= F.col("total")).select("host", "at", "seg", F.col("seg").alias("branch")), "literals")
        few_kept = _few(kept)
        branches = kids.join(few_kept, ["host", "at", "seg"], "left").withColumn("branch", F.coalesce("branch", F.lit("*")))
        branches = branches.groupBy("host", "at", "branch").agg(F.any_value("purity").alias("purity"), *[F.sum(c).alias(c) for c in _COUNTS])
        merged = stash(_merged(branches), "branches")
        named = rows.withColumn("seg", seg).join(few_kept, ["host", "at", "seg"], "left").withColumn("branch", F.when(F.col("seg").isNotNull(), F.coalesce("branch", F.lit("*"))))
        named = named.withColumnRenamed("purity", "prior").join(_few(merged), ["host", "at", "branch"], "left")
        rows = stash(named.select("host", "steps", "n", "good", "bad", F.coalesce("purity", "prior").alias("purity"), F.coalesce("to", "at").alias("at")), "level")
    return rows.select("host", "steps", F.col("at").alias("template"), "purity")


def judge(pages: DataFrame, *, rules: Sequence[tuple[str, str]] = RULES, depth: int = DEPTH, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (or null) and verdict of each row."""
    host, path = host_and_path(named(url_col).cast("string"))
    parsed = pages.select(named(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "said": said}).withColumn("steps", steps(F.col("path"), depth))
    seen = parsed.select("host", "steps", F.when(F.col("said") == "allow", 1).when(F.col("said") == "block", 0).alias("label"))
    rejected = stash(templates(seen, depth).where(F.col("purity") < MIN_PURITY).select("host", "steps", F.lit("block").alias("judged")), "rejected")
    both = parsed.join(_few(rejected), ["host", "steps"], "left")
    return both.select("page_id", "host", "path", "rule", F.coalesce("said", "judged", F.lit("allow")).alias("verdict"))


def oracle(depth: int = DEPTH) -> str:
    """The query in SQL: per level the segments, the branches, and their merging in order as a recursion."""

    def differ(parts: tuple[tuple[str, str], ...]) -> str:
        return " + ".join(f"CASE WHEN ({x}) + ({y}) > 0 THEN power((({x}) * b.n - ({y}) * f.n)::DOUBLE, 2) / ((({x}) + ({y}))::DOUBLE * f.n * b.n) ELSE 0 END" for x, y in parts)

    alike = " AND ".join(
        f"({differ(parts)}) <= {CRITICAL}"
        for parts in (
            (("f.good", "b.good"), ("f.bad", "b.bad"), ("f.n - f.good - f.bad", "b.n - b.good - b.bad")),
            (("f.ends", "b.ends"), ("f.wild", "b.wild"), ("f.n - f.ends - f.wild", "b.n - b.ends - b.wild")),
        )
    )
    fits = [(what, text, *text.split("/", 1)) for what, text in sorted(RULES, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))]
    case = "CASE " + " ".join(f"WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{start}') THEN '{{}}'" for _, _, own, start in fits) + " END"
    out = [
        r"""WITH RECURSIVE u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
q AS (SELECT *, """ + case.format(*[t for _, t, _, _ in fits]) + " AS rule, " + case.format(*[w for w, _, _, _ in fits]) + r""" AS said, regexp_extract_all(regexp_replace(path, '[0-9]+', '*', 'g'), '[^/]+') AS l FROM p),
s AS (SELECT *, CASE WHEN len(l) > """ + f"{depth} THEN list_append(l[1:{depth}], '*')" + """ ELSE l END AS steps FROM q),
c AS (SELECT host, steps, count(*) AS n, count(*) FILTER (said = 'allow') AS good, count(*) FILTER (said = 'block') AS bad FROM s GROUP BY host, steps),
r0 AS (SELECT c.*, '' AS node, (sum(good) OVER (PARTITION BY host) + """ + f"{STRENGTH} * 0.5::DOUBLE) / (sum(good + bad) OVER (PARTITION BY host) + {STRENGTH}) AS purity FROM c)"
    ]
    for d in range(1, depth + 2):
        r = f"r{d - 1}"
        out.append(f"""k{d} AS (SELECT host, node, steps[{d}] AS seg, any_value(purity) AS purity, sum(n) AS n, sum(good) AS good, sum(bad) AS bad,
  coalesce(sum(n) FILTER (len(steps) = {d}), 0) AS ends, coalesce(sum(n) FILTER (contains(steps[{d + 1}], '*')), 0) AS wild FROM {r} WHERE len(steps) >= {d} GROUP BY host, node, seg),
l{d} AS (SELECT *, CASE WHEN n >= {MIN_ROWS} AND n * {LITERALS} >= sum(n) OVER (PARTITION BY host, node) THEN seg ELSE '*' END AS branch FROM k{d}),
b{d} AS (SELECT *, row_number() OVER (PARTITION BY host, node ORDER BY (good - bad)::DOUBLE / n, branch) AS i FROM
  (SELECT host, node, branch, any_value(purity) AS purity, sum(n) AS n, sum(good) AS good, sum(bad) AS bad, sum(ends) AS ends, sum(wild) AS wild FROM l{d} GROUP BY host, node, branch)),
f{d} AS (SELECT host, node, i, i AS k, [branch] AS names, n, good, bad, ends, wild, purity FROM b{d} WHERE i = 1 UNION ALL
  SELECT host, node, i, CASE WHEN same THEN k ELSE i END, CASE WHEN same THEN list_append(names, branch) ELSE [branch] END, CASE WHEN same THEN n0 ELSE 0 END + n, CASE WHEN same THEN good0 ELSE 0 END + good,
  CASE WHEN same THEN bad0 ELSE 0 END + bad, CASE WHEN same THEN ends0 ELSE 0 END + ends, CASE WHEN same THEN wild0 ELSE 0 END + wild, purity
  FROM (SELECT b.*, f.k, f.names, f.n AS n0, f.good AS good0, f.bad AS bad0, f.ends AS ends0, f.wild AS wild0, ({alike}) AS same FROM f{d} AS f JOIN b{d} AS b ON b.host = f.host AND b.node = f.node AND b.i = f.i + 1)),
m{d} AS (SELECT host, node, unnest(names) AS branch, node || '/' || array_to_string(names, '|') AS target, (good + {STRENGTH} * purity) / (good + bad + {STRENGTH}) AS purity
  FROM (SELECT * FROM f{d} QUALIFY row_number() OVER (PARTITION BY host, node, k ORDER BY i DESC) = 1)),
r{d} AS (SELECT r.host, r.steps, r.n, r.good, r.bad, coalesce(m.target, r.node) AS node, coalesce(m.purity, r.purity) AS purity FROM {r} AS r
  LEFT JOIN l{d} AS l ON l.host = r.host AND l.node = r.node AND l.seg = r.steps[{d}] LEFT JOIN m{d} AS m ON m.host = l.host AND m.node = l.node AND m.branch = l.branch)""")
    last = f"r{depth + 1}"
    return ",\n".join(out) + f"\nSELECT page_id, s.host, path, rule, coalesce(said, CASE WHEN t.purity < {MIN_PURITY} THEN 'block' ELSE 'allow' END) AS verdict FROM s JOIN {last} AS t ON t.host = s.host AND t.steps = s.steps"


ORACLE = oracle()
