"""Order-dependent operators against plain loops; tables, crawls and the streaming cycle."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import SF
from pyspark.sql import functions as F

from ledgerloom.functions import fuzzy, html, jsonld
from ledgerloom.operators import alike, changes, dedup, ledger, lifecycle, matching, pages, planning, reports, running
from ledgerloom.plans import ledger as ledger_plans, pages as plans, runs
from ledgerloom.sources import commits, lines, tables
from ledgerloom.streaming import cycle, sites


def test_first_wins_keeps_order_and_blanks(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, ""), (4, ""), (5, None)], "pos int, k string")
    assert sorted(r.pos for r in dedup.first_wins(df, ["k"], ["pos"]).collect()) == [1, 2, 5]
    assert sorted(r.pos for r in dedup.first_wins(df, ["k"], ["pos"], keep_blank=True).collect()) == [1, 2, 4, 5]
    assert [r.pos for r in dedup.last_wins(df.where("k = 'a'"), ["k"], ["pos"]).collect()] == [3]


def greedy(rows):
    """The places that a loop keeps; rows are (place, link, ident)."""
    links, ids, kept = set(), set(), set()
    for at, a, b in sorted(rows, key=lambda r: r[0]):
        if (a and a in links) or (b and b in ids):
            continue
        links |= {a} if a else set()
        ids |= {b} if b else set()
        kept |= {at} if a or b else set()
    return kept


@pytest.mark.parametrize(("few", "n", "keys"), [(0, 400, 30), (50, 400, 300), (10**6, 400, 30), (0, 60, 2)])
def test_two_key_dedup_is_greedy(spark, few, n, keys):
    rng = random.Random(n + keys + few)
    key = lambda: rng.choice([*map(str, range(keys)), "", None])
    rows = [(p, key(), key()) for p in rng.sample(range(10 * n), n)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "p int, a string, b string, at int, `x.y` int")
    got = dedup.greedy_two_keys(df, "a", "b", "p", few=few)
    assert got.columns == df.columns and {r.p for r in got.collect()} == greedy(rows)


def test_two_key_dedup_with_a_hot_key_and_chains(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 2 else f"l{rng.randrange(30000)}", f"i{rng.randrange(40000)}") for i in range(100_000)]
    rows += [(100_000 + i, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(3_000)]
    df = spark.createDataFrame(rows, "p int, a string, b string")
    assert {r.p for r in dedup.greedy_two_keys(df, "a", "b", "p", few=5_000).collect()} == greedy(rows)
    assert dedup.greedy_two_keys(df.limit(0), "a", "b", "p", few=0).count() == 0
    chain = [(i, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(9)]
    assert {r.p for r in dedup.greedy_two_keys(spark.createDataFrame(chain, "p int, a string, b string"), "a", "b", "p", few=0).collect()} == {0, 2, 4, 6, 8}


def test_known_keys_register_and_are_left_out(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", None), (4, "b", "z"), (5, "c", "")], "p int, a string, b string")
    known = spark.createDataFrame([("x",), ("c",), ("x",)], "id string")
    assert {r.p for r in dedup.greedy_two_keys(df, "a", "b", "p", known=known).collect()} == {3}


def test_line_query_is_the_loop(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").collect()
    rows = {}
    for r in lines:
        at = r.l_orderkey * 10 + r.l_linenumber
        own = ("" if r.l_linenumber % 5 == 0 else f"p{r.l_partkey}", "hot" if r.l_orderkey % 2 == 0 else f"{r.l_suppkey}|{r.l_shipdate:%Y-%m-%d}" if r.l_linenumber != 3 else None)
        rows[at] = min(rows.get(at, own), own, key=lambda x: (x[0], x[1] is not None, x[1] or ""))
    known = {f"p{r.p_partkey}" for r in spark.read.parquet(f"{SF}/part.parquet").collect() if r.p_partkey % 9 == 0}
    want = {at for at in greedy([(at, *own) for at, own in rows.items()]) if (rows[at][1] or rows[at][0]) not in known}
    assert {r.line for r in runs.greedy_line_dedup(spark, SF).collect()} == want


def test_diff_is_the_greedy_loop(spark):
    rng = random.Random(2)
    make = lambda: [(h, str(rng.randrange(6)), i) for i, h in enumerate(rng.sample([str(x) for x in range(40)], 25))]
    for _ in range(4):
        current, previous = make(), make()
        known, first = {h for h, _, _ in previous}, {}
        for h, place, _ in previous:
            first.setdefault(place, h)
        used, want = set(), {}
        for h, place, _ in current:
            if h in known:
                used.add(h)
                want[h] = "ACTIVE"
            elif place in first and first[place] not in used:
                used.add(first[place])
                want[h] = "UPDATED"
            else:
                want[h] = "NEW"
        df = lambda rows: spark.createDataFrame(rows, "hash string, place string, pos int")
        assert {r.hash: r.status for r in changes.diff(df(current), df(previous)).collect()} == want


def test_lifecycle_closes_at_the_threshold(spark):
    row = spark.createDataFrame([("h", "s")], "hash string, source_url string")
    none = row.limit(0)
    state = lifecycle.empty_state(spark)
    want = [("ACTIVE", 0, False), ("MISSING", 1, False), ("CLOSED", 2, True), ("CLOSED", 2, True), ("ACTIVE", 0, False)]
    for now, seen, (status, missed, closed) in zip(("10:00", "16:00", "22:00", "23:00", "23:30"), (row, none, none, none, row), want, strict=True):
        state = lifecycle.advance(state, seen, None, f"2024-01-01 {now}:00", threshold=2)
        r = state.first()
        assert (r.status, r.missing_count, r.closed_at is not None) == (status, missed, closed)
    assert str(r.first_seen) == "2024-01-01 10:00:00"
    other = spark.createDataFrame([("t",)], "source_url string")
    assert lifecycle.advance(state, none, other, "2024-01-02 00:00:00").first().status == "ACTIVE"
    assert lifecycle.advance(state, none, other.limit(0), "2024-01-02 00:00:00").first().status == "CLOSED"


def test_caps_and_budget(spark):
    df = spark.createDataFrame([(e, p) for e in range(4) for p in range(5)], "event int, pos int")
    got = reports.event_cap(df, 3, 5, event="event", event_pos="event", pos="pos").collect()
    assert sorted((r.event, r.pos) for r in got) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    assert reports.event_cap(df, 3, 99, event="event", event_pos="event", pos="pos", max_events=2).count() == 6


def test_query_plan_goes_to_companies_first(spark):
    df = lambda *v: spark.createDataFrame([(x, i) for i, x in enumerate(v)], "value string, pos int")
    plan = planning.query_plan(df("AI Engineer", "Data Analyst"), df("Lahore", "Remote"), df("Acme", "Beta"), budget=5, company_budget=2).orderBy("step").collect()
    assert [(r.query, r.location) for r in plan] == [("Acme careers jobs", ""), ("Beta careers jobs", ""), ("AI Engineer", "Lahore"), ("AI Engineer", "Remote"), ("Data Analyst", "Lahore")]
    assert planning.query_plan(df("A"), df("").where("value <> ''"), df("").limit(0), budget=3).collect()[0].location == ""


def test_pagination(spark):
    page = '<a href="/jobs?page=2">2</a><a rel="next" href="?offset=10">older</a><a href="mailto:x">next</a><a href="#f">next</a><a href="/blog/next">next</a><a href="https://jobs.lever.co/acme">all</a><a href="https://other.org/x">next</a><a href="/jobs?page=2">again</a>'
    df = spark.createDataFrame([("https://acme.com/careers", page)], "url string, html string")
    assert [r.link for r in pages.pagination_links(df).orderBy("n").collect()] == ["https://acme.com/jobs?page=2", "https://acme.com/careers?offset=10", "https://jobs.lever.co/acme"]


@pytest.mark.parametrize("most", [1, 4, 8])
def test_crawl_of_each_site_is_the_loop_with_a_queue(spark, most):
    rng = random.Random(7)
    names = [f"u{i:02d}" for i in range(30)]
    edges = [(u, pos, v.upper() if rng.random() < 0.3 else v) for u in names[:25] for pos, v in enumerate(rng.choices([*names, " u03 "], k=rng.randrange(25)))]
    want = set()
    for seed in names:
        queue, visited = [(seed, 0)], {}
        while queue and len(visited) < most:
            url, depth = queue.pop(0)
            if url.lower().strip() in visited:
                continue
            visited[url.lower().strip()] = (seed, len(visited), url, depth)
            queue += [(v, depth + 1) for u, _, v in edges if u == url and v.lower().strip() not in visited and v not in [x for x, _ in queue]]
        want |= set(visited.values())
    got = pages.crawl_sites(spark.createDataFrame([(u,) for u in names], "url string"), spark.createDataFrame(edges, "url string, pos int, link string"), max_pages=most).collect()
    assert {(r.seed, r.n, r.url, r.depth) for r in got} == want and len(got) == len(want)


def test_crawl_query_starts_from_every_page(spark):
    first = spark.read.parquet(f"{SF}/pages.parquet")
    got = plans.crawl_frontier(spark, SF).collect()
    assert {r.seed for r in got if r.depth == 0} == {r.url for r in first.collect()}
    assert max(Counter(r.seed for r in got).values()) <= 8


def test_entry_level_by_role_experience_or_description(spark):
    rows = [(1, "a", "Junior Software Engineer", "", ""), (2, "a", "Cook", "", "0-2 years"), (3, "a", "Cook", "for fresh talent", None), (4, "a", "Cook", "", "9 years"), (5, "b", None, "1 year", None), (6, "a", "Clerk", "", "Entry")]
    df = spark.createDataFrame(rows, "pos int, site string, title string, description string, experience string")
    assert [r.pos for r in matching.entry_level_jobs(df).orderBy("pos").collect()] == [1, 2, 3, 5, 6]
    assert [r.pos for r in matching.entry_level_jobs(df, most=2).collect()] == [1, 2]
    assert sorted(r.pos for r in matching.entry_level_jobs(df, most=2, site="site").collect()) == [1, 2, 5]


def test_lifecycle_fields_and_new_flags(spark):
    state = spark.createDataFrame([("a", "2024-01-01", "2024-01-02", None), ("b", "2024-01-03", "2024-01-04", "2024-01-05")], "hash string, f string, l string, c string")
    state = state.select("hash", *[F.to_timestamp(x).alias(y) for x, y in (("f", "first_seen"), ("l", "last_seen"), ("c", "closed_at"))])
    rows = spark.createDataFrame([(" a ", "", "r0", 0), ("b", "2020-02-02", None, 5), ("x", None, "", None), (None, None, None, None)], "hash string, first_seen string, run_id string, run_iteration int")
    got = {r.hash: tuple(r)[1:] for r in lifecycle.enriched(rows, state, "2024-02-01", run_id="r9", run_iteration=3).collect()}
    first, day = "2024-02-01 00:00:00", "2024-01-0{} 00:00:00"
    assert got == {
        " a ": (day.format(1), "r0", 3, day.format(2), ""), "b": ("2020-02-02", "r9", 5, day.format(4), day.format(5)), "x": (first, "r9", 3, first, ""), None: (first, "r9", 3, first, ""),
    }
    flags = lifecycle.flagged(rows, spark.createDataFrame([("b",), ("b",), ("z",)], "hash string")).collect()
    assert {r.hash: r.status for r in flags} == {" a ": "ACTIVE", "b": "NEW", "x": "ACTIVE", None: "ACTIVE"} and len(flags) == 4


def test_companies_without_jobs_and_tracked_hashes(spark):
    sites = [("https://jobs.lever.co/zeta-labs", True, 0), ("https://jobs.lever.co/zeta-labs", True, None), (" https://acme.breezy.hr/ ", True, 0), ("https://jobs.lever.co/beta", False, 0), ("https://jobs.lever.co/gamma", True, 2), ("", True, 0), (None, True, 0), ("https://jobs.lever.co/delta", None, 0)]
    df = spark.createDataFrame(sites, "url string, ok boolean, jobs_count int")
    assert [r.company for r in reports.companies_without_jobs(df).collect()] == ["acme", "zeta labs"]
    state = spark.createDataFrame([("c1", "h1"), ("c2", " h1 "), ("c2", "h2"), ("c1", " "), ("c3", None)], "company string, hash string")
    assert sorted(r.hash for r in reports.tracked_hashes(state).collect()) == ["h1", "h2"]


def test_line_lists(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("# head\n\n.\nhttps://E.com/a/\n https://e.com/a?x=1 \nAI Engineer\nai engineer\nhttps://e.com/b\n")
    assert [r.value for r in lines.url_list(spark, str(path)).orderBy("pos").collect()] == ["https://e.com/a/", "https://e.com/b"]
    assert [r.value for r in lines.titles(spark, str(path)).where("value LIKE '%ngineer'").collect()] == ["AI Engineer"]


def test_lines_of_many_splits_and_files_are_numbered_through(spark, tmp_path):
    rng, want = random.Random(3), []
    (tmp_path / "in").mkdir()
    for k in range(3):
        rows = [rng.choice(["", ".", "# x", f" {k}-{i} ", f"{k}-{i}" + "y" * rng.randrange(200)]) for i in range(20_000 if k else 30)]
        (tmp_path / "in" / f"part-{k}.txt").write_text("\r\n".join(rows) if k == 1 else "\n".join(rows) + "\n")
        want += rows
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        got = lines.lines(spark, str(tmp_path / "in")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.pos, r.value) for r in got) == [(i, v.strip(" ")) for i, v in enumerate(want) if v.strip(" ") not in ("", ".") and not v.strip(" ").startswith("#")]
    assert lines.lines(spark, str(tmp_path / "in" / "part-0.txt")).count() < 30


@pytest.mark.parametrize("ranges", [1, 7, 300])
def test_running_totals_over_ranges(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.randrange(50), i, rng.randrange(-3, 9)) for i in range(900)]
    total, want = 0, {}
    for a, i, v in sorted(rows):
        want[i], total = total, total + v
    got = running.running_total(spark.createDataFrame(rows, "a int, i int, v int"), "v", ["a", "i"], ranges=ranges)
    assert {r.i: r.before for r in got.collect()} == want
    assert running.running_total(got.drop("before").limit(0), "v", ["a"]).count() == 0


def test_tables_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda *rows: spark.createDataFrame(rows, "pos int, token string")
    tables.append_new(df((1, "a"), (2, "a"), (3, "b"), (4, "")), path, "token", ["pos"])
    tables.append_new(df((5, "b"), (6, "c")), path, "token", ["pos"])
    assert sorted((r.pos, r.token) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b"), (6, "c")]
    assert tables.delete_keys(spark, path, df((0, "a"), (0, "z")), "token") == 1
    assert sorted(r.token for r in spark.read.parquet(path).collect()) == ["b", "c"]
    base = str(tmp_path / "state")
    tables.save_state(df((1, "x")), base, 1)
    tables.save_state(df((2, "y")), base, 2)
    state, version = tables.load_state(spark, base, "pos int, token string")
    assert version == 2 and state.first().token == "y"


def test_a_commit_shows_all_parts_or_none(spark, tmp_path):
    base = str(tmp_path / "run")
    df = lambda *rows: spark.createDataFrame(rows, "hash string, company string")
    parts = lambda *rows: {"all": (commits.REPLACE, df(*rows)), "log": (commits.APPEND, df(*rows)), "own": (commits.BY_KEY, df(*rows))}
    held = lambda name, **at: sorted((r.hash, r.company, r.batch) for r in commits.read(spark, base, name, **at).collect())
    keys = {"own": "company"}
    assert commits.commit(spark, base, 1, parts(("a", "x"), ("b", "x"), ("c", "y")), keys=keys)
    df(("q", "z")).write.parquet(commits.part(base, "log", 2))  # a run that died before its commit
    assert held("log") == [("a", "x", 1), ("b", "x", 1), ("c", "y", 1)] and list(commits.committed(spark, base)) == [1]
    gone = spark.createDataFrame([("c",), ("d",)], "hash string")
    for first in (True, False):
        assert commits.commit(spark, base, 2, parts(("d", "x"), ("e", "x")), keys=keys, deleted=gone, deletes_from=("own", "all")) is first
    assert held("all") == [("e", "x", 2)] and held("own") == [("e", "x", 2)]
    assert held("log") == [("a", "x", 1), ("b", "x", 1), ("c", "y", 1), ("d", "x", 2), ("e", "x", 2)]
    assert commits.commit(spark, base, 3, {"own": (commits.BY_KEY, df(("c", "z")))}, keys=keys)
    assert held("own") == [("c", "z", 3), ("e", "x", 2)] and held("own", upto=1) == [("a", "x", 1), ("b", "x", 1), ("c", "y", 1)]
    with pytest.raises(ValueError, match="no committed batch"):
        commits.read(spark, base, "other")


def test_publishing_twice_changes_nothing(spark, tmp_path):
    base = str(tmp_path / "publish")
    rows = spark.createDataFrame([("H1", "acme", "ACTIVE", "Intern"), ("h2 ", "acme", "CLOSED", "Intern"), ("h3", None, "ACTIVE", "Lead")], "hash string, company string, status string, title string")
    own = {"active": rows, "new": rows.where("hash <> 'h3'"), "closed": rows.where("status = 'CLOSED'").withColumn("hash", F.lit("H2")), "stats": rows.groupBy("company").count(), "associate": F.col("title") == "Intern"}
    seen = []
    for first in (True, False):
        assert tables.publish(base, 7, **own) is first
        seen.append({n: sorted((r.hash or "", r.status) for r in commits.read(spark, base, n).collect()) for n in tables.RUN_TABLES[:-1]})
    assert seen[0] == seen[1] == {"active": [("H1", "ACTIVE"), ("h3", "ACTIVE")], "new": [("H1", "ACTIVE"), ("h2 ", "CLOSED")], "closed": [("H2", "CLOSED")], "associate": [("H1", "ACTIVE")], "by_company": [("H1", "NEW")]}


def test_settings_layers():
    s = tables.Settings.layered({"archive_days": 10, "other": "x"}, {"archive_days": "20"})
    assert s.archive_days == 20 and s.missing_threshold == 1 and s.extra == {"other": "x"}


def test_stream_replays_leave_the_same_state(spark, tmp_path):
    base = str(tmp_path / "cycle")
    seen = lambda now, *hashes: spark.createDataFrame([(h, "s") for h in hashes], "hash string, source_url string").withColumn("observed_at", F.lit(now).cast("timestamp"))
    cycle.run_cycle(seen("2024-01-01", "a", "b"), 0, base, threshold=2)
    for _ in range(2):
        cycle.run_cycle(seen("2024-01-02", "a"), 1, base, threshold=2)
    state, version = tables.load_state(spark, base, cycle.STATE_SCHEMA)
    assert version == 2 and {r.hash: (r.status, r.missing_count) for r in state.collect()} == {"a": ("ACTIVE", 0), "b": ("MISSING", 1)}


def test_site_state_closes_expires_and_survives_a_replay(spark, tmp_path):
    schema = "source_url string, hash string, observed_at timestamp"
    base, states = str(tmp_path), []

    def observe(*rows):
        frame = spark.createDataFrame([(s, h, at) for s, h, at in rows], "source_url string, hash string, at string")
        frame.select("source_url", "hash", F.col("at").cast("timestamp").alias("observed_at")).write.mode("append").parquet(f"{base}/in")
        run()

    def run():
        sites.start(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/checkpoint", threshold=2, keep_days=10, buckets=3).awaitTermination()
        rows = sites.state(spark.read.schema(sites.CHANGES).parquet(f"{base}/out")).collect()
        states.append({r.hash: (r.status, r.missing_count, str(r.first_seen.date()), str(r.last_seen.date()), r.closed_at and str(r.closed_at.date())) for r in rows})

    a, b = "2024-01-01", "2024-01-03"
    observe(("s", "x", a), ("s", "y", a), ("s", None, a), ("t", "z", a), ("t", None, a), (None, "q", a))
    assert states[-1] == {h: ("ACTIVE", 0, a, a, None) for h in "xyz"}
    observe(("s", "x", b), ("s", "x", b), ("s", None, b), ("s", None, "2024-01-02"))  # y misses twice, and x once in between
    assert states[-1] == {"x": ("ACTIVE", 0, a, b, None), "y": ("CLOSED", 2, a, b, b), "z": ("ACTIVE", 0, a, a, None)}
    observe(("s", "y", "2024-01-05"), ("s", "late", "2023-12-01"), ("s", None, "2024-01-05"))
    assert states[-1]["y"] == ("ACTIVE", 0, a, "2024-01-05", None) and states[-1]["x"] == ("MISSING", 1, a, b, None) and "late" not in states[-1]
    observe(("s", "y", "2024-01-06"), ("s", None, "2024-01-06"))
    assert states[-1]["x"] == ("CLOSED", 2, a, "2024-01-06", "2024-01-06")
    observe(("u", "w", "2024-02-01"), ("u", None, "2024-02-01"))  # s isn't seen again; its closed row goes by timer
    assert set(states[-1]) == {"y", "z", "w"}
    done = tmp_path / "checkpoint" / "commits"
    last = max(int(p.name) for p in done.iterdir() if p.name.isdigit())
    for p in [p for p in done.iterdir() if str(last) in p.name.split(".")]:
        p.unlink()  # as if the last batch had ended before its commit: it is run again
    run()
    assert states[-1] == states[-2]


@pytest.mark.parametrize(("interval", "most", "calls", "sleeps"), [(1.0, 3, [1, 2, 3], 2), (0, 0, [1], 0)])
def test_repeat(interval, most, calls, sleeps):
    got, naps = [], []
    cycle.repeat(got.append, interval=interval, max_cycles=most, sleep=naps.append)
    assert got == calls and len(naps) == sleeps


def test_repeat_goes_on_after_errors():
    failed = []
    assert cycle.repeat(lambda n: 1 / 0, interval=1, max_cycles=2, sleep=lambda s: None, on_error=lambda n, e: failed.append(n)) == 2
    assert failed == [1, 2]


def test_first_success_and_unvisited(spark):
    tries = spark.createDataFrame([("u", 1, True, "x", ""), ("u", 0, False, "y", "e0"), ("u", 2, False, "z", "e2"), ("v", 0, False, "y", "e")], "url string, priority int, ok boolean, method string, error string")
    got = {r.url: (r.method, r.errors) for r in pages.first_success(tries).collect()}
    assert got == {"u": ("x", ["e0"]), "v": (None, ["e"])}


def test_landed_answers_with_nulls_and_without_rows(spark):
    from hashlib import sha256

    from ledgerloom.sources import landed

    sha = lambda x: sha256(x.encode()).hexdigest()
    kinds = "url string, attempt int, status int, body string"
    rows = [("a", 0, None, None), ("a", 1, 200, None), ("a", 2, 200, "later"), ("b", 0, 403, "x"), ("c", 0, 304, None), ("d", 1, 200, "new"), ("d", 0, 200, "old")]
    cache = spark.createDataFrame([("a", sha("")), ("a", None), ("d", sha("new"))], "url string, body_hash string")
    got = sorted(map(tuple, landed.fetch_outcomes(spark.createDataFrame(rows, kinds), cache).collect()))
    assert got == [("a", 1, "cached_hash", sha("")), ("b", None, "failed", None), ("c", 0, "cached_304", None), ("d", 0, "fetched", sha("old"))]
    assert landed.fetch_outcomes(spark.createDataFrame([], kinds), cache).count() == 0
    pages = spark.createDataFrame([("HTTPS://A.com:8/x?y#z",), ("nohost",), (None,)], "url string")
    ends = landed.probe_endpoints(pages)
    assert [r.endpoint for r in ends.orderBy("n").limit(2).collect()] == ["https://A.com:8/jobs", "https://A.com:8/api/jobs"] and ends.count() == 8
    answers = [("a", 0, "/jobs", "e", 200, "application/json", None), ("a", 1, "/api/jobs", "e", 200, None, '[{"title": "t"}]'), ("a", 2, "/graphql", "e", 404, "x/json", '[{"title": "u"}]'), ("b", 0, "/jobs", "e", None, None, None)]
    hits = landed.probe_hits(spark.createDataFrame(answers, "url string, n int, path string, endpoint string, status int, content_type string, body string")).collect()
    assert [(r.url, r.path, r.openings[0].title, r.openings[0].apply_link) for r in hits] == [("a", "/api/jobs", "t", "e")]
    updates = spark.createDataFrame([(3, " /PAUSE "), (2, None), (1, "/resume"), (4, "/stop")], "update_id int, text string")
    assert [tuple(r) for r in landed.poll(updates, 1).collect()] == [(2, None), (3, "/pause"), (4, None)]
    assert landed.next_row(updates.where("false")).first()[0] == 2


WORDS = ("data", "engineer", "senior", "software", "ai", "ml", "ops", "of", "x", "analyst", "analysts", "developer", "developper", "enginer", "dev", "é", "qa")


def title(rng):
    words = [rng.choice(WORDS) for _ in range(rng.choice([1, 1, 2, 3, 4, 6]))]
    k = rng.randrange(len(words))
    if rng.random() < 0.4 and len(words[k]) > 2:
        i = rng.randrange(len(words[k]))
        words[k] = words[k][:i] + rng.choice(["", "z", "e"]) + words[k][i + rng.randrange(2) :]
    return " ".join(words)


@pytest.mark.parametrize("least", [80, 95, 50, 100, 1])
def test_fuzzy_join_finds_all_pairs(spark, least):
    rng = random.Random(least)
    one, two = ([*(title(rng) for _ in range(260)), None, "", "  "] for _ in range(2))
    want = {(a, b, r) for a in {x for x in one if x and x.strip()} for b in {x for x in two if x and x.strip()} if (r := fuzzy.token_set(a, b)) >= least}
    frame = lambda rows: spark.createDataFrame([(x,) for x in rows], "name string")
    got = [tuple(r) for r in alike.alike(frame(one), frame(two), least=least).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_low_ratios_write_no_more_pairs_than_they_find(spark, monkeypatch):
    """Of 240 * 230 pairs of titles from few letters hardly any can be told apart by a common key."""
    rng = random.Random(60)
    one, two = (sorted({" ".join("".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 12))) for _ in range(7)) for _ in range(n)}) for n in (240, 230))
    written, stash = [], alike.stash
    monkeypatch.setattr(alike, "BLOCK_TEXTS", 50, raising=False)
    monkeypatch.setattr(alike, "stash", lambda df, name: written.append((name, (out := stash(df, name)).count())) or out)
    frame = lambda rows: spark.createDataFrame([(x,) for x in rows], "name string")
    got = sorted(tuple(r) for r in alike.alike(frame(one), frame(two), least=60).collect())
    assert got == [(a, b, r) for a in one for b in two if (r := fuzzy.token_set(a, b)) >= 60] and got
    assert max(n for _, n in written) <= max(len(got), 240), written


def test_fuzzy_keys_of_many_texts_hold_their_bounds():
    rng = random.Random(9)
    for share in (0.495, 0.795, 0.945):
        for _ in range(4000):
            a, b = title(rng), title(rng)
            if fuzzy.token_set(a, b) >= 100 * share + 0.5:
                keys = [{(k, key): (w, need) for k, key, w, need, _ in alike.text_keys(x, share)} for x in (a, b)]
                def reached(own, other, kinds):
                    return any(sum(w for (k, key), (w, _) in own.items() if k == kind and (k, key) in other) >= need for kind in kinds if (need := next((n for (k, _), (_, n) in own.items() if k == kind), 0)) > 0)
                assert reached(keys[0], keys[1], "tgl") or reached(keys[1], keys[0], "t"), (a, b)


@pytest.mark.parametrize(("rows", "blocks"), [(16, 3), (512, 64)])
def test_nearest_vectors_are_the_plain_maximum(spark, rows, blocks):
    rng = np.random.default_rng(rows)
    centres = rng.normal(size=(12, 8))
    make = lambda n: centres[rng.integers(12, size=n)] + rng.normal(0, 0.2, (n, 8))
    x, y = make(300), make(700)
    y[40] = y[7]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [1.0, 2.0]), (1004, [1.0, None]), (1005, [float("nan")] * 8)]
    frame = lambda v, name, more: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)] + more, f"{name} long, vector array<double>")
    got = {r.id: (r.target, r.best) for r in alike.nearest(frame(x, "id", odd), frame(y, "target", [*odd[:3], *odd[4:]]), block_rows=rows, blocks=blocks).collect()}
    cosines = (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
    for i in range(300):
        assert got[i][1] == pytest.approx(cosines[i].max(), abs=1e-9) and cosines[i, got[i][0]] == pytest.approx(cosines[i].max(), abs=1e-9) and got[i][0] != 40
    assert {i: got[i] for i, _ in odd} == {i: (None, -1.0) for i, _ in odd}
    assert len(got) == 306


@pytest.mark.parametrize("most", [1, 4, 9])
def test_crawl_follows_redirects_of_failed_pages(spark, most):
    rng = random.Random(most)
    names = [f"u{i:02d}" for i in range(25)]
    links = {u: rng.choices(names, k=rng.randrange(8)) for u in names}
    outcomes = {u: (rng.random() < 0.6, rng.choice([*names, "", None, "  "])) for u in names[:20]}
    want = set()
    for seed in names:
        queue, seen = [(seed, 0)], {}
        while queue and len(seen) < most:
            url, depth = queue.pop(0)
            if url in seen:
                continue
            ok, final = outcomes.get(url, (True, None))
            final = (final or "").strip()
            seen[url] = (seed, len(seen), url, depth, ok, final or url)
            found = links[url] if ok else [final] if final else []
            for v in found:
                if v not in seen and v not in [x for x, _ in queue]:
                    queue.append((v, depth + 1))
        want |= set(seen.values())
    edges = spark.createDataFrame([(u, p, v) for u, vs in links.items() for p, v in enumerate(vs)], "url string, pos int, link string")
    ends = spark.createDataFrame([(u, ok, f) for u, (ok, f) in outcomes.items()], "url string, ok boolean, final_url string")
    got = pages.crawl_with_redirects(spark.createDataFrame([(u,) for u in names], "url string"), edges, ends, max_pages=most).collect()
    assert {(r.seed, r.n, r.url, r.depth, r.ok, r.final_url) for r in got} == want and len(got) == len(want)


def test_redirects_without_failures_change_nothing(spark):
    one, two = plans.crawl_frontier(spark, SF), plans.crawl_redirects(spark, SF)
    assert {r.url for r in two.where("ok").collect()} <= {r.url for r in one.collect()} and two.where("NOT ok").count() > 0


def test_openings_pass_a_normaliser(spark):
    page = spark.createDataFrame([("https://e.com/careers", "<li class=job><h2 class=job-title>Data Engineer II</h2><a href=/jobs/1>x</a></li><li class=job><h2 class=job-title>Data Engineer III</h2><a href=/jobs/1>x</a></li>")], "url string, html string")
    plain = lambda rows: rows.withColumn("title", F.regexp_replace("title", " I+$", ""))
    assert pages.openings(page).count() == 2 and [r.title for r in pages.openings(page, normalise=plain).collect()] == ["Data Engineer"]


def test_jsonld_in_the_jvm_is_the_parser(spark):
    node = '{"@type": "JobPosting", "title": "A  B", "url": " /j "}'
    blocks = ["", node, f"[{node}, [{node}], 5, null, \"x\"]", '{"@graph": [%s, {"@graph": [%s]}], "@type": ["x", "JOBPOSTING "], "sameAs": "/s"}' % (node, node), "{bad", '{"@type": null}', "7", '{"@type": "jobposting", "url": ""}', '{"@type": [], "@graph": "no"}', node.replace("A  B", "é\\u0041 &amp;")]
    heads = ["<script type='application/ld+json'>", '<SCRIPT id=x type="Application/LD+JSON; v=1" >', "<script type=application/ld+json>", "<script>", '<script type="text/json">']
    rng = random.Random(2)
    rows = ["".join(rng.choice(heads) + rng.choice(blocks) + "</script>" + rng.choice(["", "<p>x</p>", "<!-- -->"]) for _ in range(rng.randrange(4))) for _ in range(150)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, html string")
    got = {r.i: [tuple(p) for p in r.x] for r in df.select("i", jsonld.postings(F.col("html")).alias("x")).collect()}
    plan = df.select(jsonld.postings(F.col("html")))._jdf.queryExecution().executedPlan().toString()
    for i, text in enumerate(rows):
        found = [x for n in html.json_ld(html.parse(text)) if (x := html._ld_posting(n))]
        assert got[i] == [(" ".join(x["title"].split()), x["link"]) for x in found], text
    assert sum(map(len, got.values())) > 80 and "Python" not in plan and "Arrow" not in plan


def test_monitor_keeps_state_of_pages_outside_of_a_cycle(spark, tmp_path):
    base = str(tmp_path / "m")
    df = lambda *rows: spark.createDataFrame(rows, "url string, digest string, openings array<string>, at string").withColumn("observed_at", F.col("at").cast("timestamp"))
    held = lambda t, *c: sorted(tuple(r) for r in commits.read(spark, base, t).select(*c).collect())
    assert cycle.run_monitor(df(("a", "1", ["x", None, " "], "2024-01-01"), ("b", "1", None, "2024-01-01")), 1, base, most=2)
    assert cycle.run_monitor(df(("a", "2", ["x", "y", "z"], "2024-01-02"), ("c", None, ["q"], "2024-01-02")), 2, base, most=2)
    assert not cycle.run_monitor(df(("a", "9", [], "2024-01-05")), 2, base)
    assert held("state", "url", "digest", "seen") == [("a", "2", ["x", "y"]), ("b", "1", [])]
    assert held("audit", "url", "status", "new_openings_count", "batch") == [("a", "content_changed", 2, 2), ("a", "new_url_tracked", 1, 1), ("b", "ignored_no_jobs", 0, 1), ("c", "error", 0, 2)]
    assert held("events", "url", "batch") == [("a", 1), ("a", 2)]


def plain_letter(index):
    out, n = "", max(1, index)
    while n > 0:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def test_column_letters_of_any_number(spark):
    numbers = [-3, 0, 1, 26, 27, 702, 703, 18278, 18279, 90_000, 475_254, 475_255, 900_000, 2**31, 2**53 + 1, 2**63 - 1, *random.Random(3).sample(range(10**7), 200)]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", ledger.column_letter(F.col("n")).alias("x")).collect()
    assert [r.x for r in rows] == [plain_letter(r.n) for r in rows]


def test_presentation_agrees_with_sql_past_zzz(spark, tmp_path):
    keys = [*range(18_270, 18_290), 90_000, 475_254, 475_255, 899_999, 900_000]
    spark.createDataFrame([(k, f"Customer#{k:09d}") for k in keys], "c_custkey long, c_name string").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    query, sql = ledger_plans.QUERIES["presentation"]
    got = {r.c_custkey: (r.colour, r.light, r.letter, r.tab) for r in query(spark, str(tmp_path)).collect()}
    want = duckdb.connect().sql(sql.replace("FROM customer", f"FROM '{tmp_path}/customer.parquet/*.parquet'")).df()
    assert got == {r.c_custkey: (r.colour, r.light, r.letter, r.tab) for r in want.itertuples()} and len(got) == len(keys)
