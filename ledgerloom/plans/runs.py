"""Queries over runs, states and tables, with the SQL that they are held against.

Events stand in for observations: a user is a posting, its remainder by ten the
source, and a week a run. Orders stand in for rows of the primary table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import urls as U
from ledgerloom.operators import changes, dedup, lifecycle, reports
from ledgerloom.plans.pages import table
from ledgerloom.sources import lines as L, tables
from ledgerloom.store import new_path
from ledgerloom.streaming import cycle, sites

C = F.col
WEEKS = ("2024-01-08", "2024-01-15", "2024-01-22", "2024-01-31")
STATUSES = ("new", "applied", "rejected", "interview")


def _seen(spark, sf_dir, start: str, end: str):
    """What users did in the period, by kind and a digit of the event, as rows seen at their source."""
    rows = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type").where((C("ts") >= start) & (C("ts") < end))
    return rows.select(F.concat_ws("-", "user_id", "event_type", C("event_id") % 5).alias("hash"), F.concat(F.lit("s"), (C("user_id") % 10)).alias("source_url")).distinct()


def _snapshot(spark, sf_dir, start: str, end: str):
    rows = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type").where((C("ts") >= start) & (C("ts") < end))
    first = rows.groupBy(F.concat_ws("-", C("user_id"), C("event_type"), C("event_id") % 7).alias("hash")).agg(F.min("event_id").alias("pos"), F.min_by(F.concat_ws("-", C("user_id") % 40, C("event_id") % 7), "event_id").alias("place"))
    return first.select("hash", "pos", "place")


#: Two overlapping snapshots, the current and the previous one; together they hold all events.
CURRENT, PREVIOUS = ("2024-01-11", "2024-02-01"), ("2024-01-01", "2024-01-21")


def snapshot_diff(spark, sf_dir):
    return changes.diff(_snapshot(spark, sf_dir, *CURRENT), _snapshot(spark, sf_dir, *PREVIOUS))


def page_diff(spark, sf_dir):
    keyed = lambda df: df.withColumns({"key": C("hash"), "hash": F.md5(F.concat_ws("-", "hash", C("pos") % 3))})
    return changes.diff_pages(keyed(_snapshot(spark, sf_dir, *CURRENT)), keyed(_snapshot(spark, sf_dir, *PREVIOUS))).select("key", "pos", "status")


def page_change_status(spark, sf_dir):
    rows = table(spark, sf_dir, "pages", "page_id", "html").select(C("page_id").cast("string").alias("url"), F.when(C("page_id") % 11 != 0, F.sha2("html", 256)).alias("digest"), (C("page_id") % 4).alias("openings"), (C("page_id") % 3).alias("fresh"), "page_id")
    known = rows.where("page_id % 2 = 0").select("url", F.when(C("page_id") % 6 == 0, C("digest")).otherwise(F.lit("old")).alias("digest"))
    return changes.page_status(rows, known).select("page_id", "status")


def _first_state(spark, sf_dir):
    return lifecycle.baseline(_seen(spark, sf_dir, "2024-01-01", WEEKS[1]), WEEKS[1])


def lifecycle_merge(spark, sf_dir):
    now = _seen(spark, sf_dir, WEEKS[1], WEEKS[3])
    return lifecycle.advance(_first_state(spark, sf_dir), now, now.where("source_url <> 's3'").select("source_url"), WEEKS[3], threshold=1)


def lifecycle_multi_run(spark, sf_dir):
    state, start = lifecycle.empty_state(spark), "2024-01-01"
    for end in WEEKS:
        state, start = lifecycle.advance(state, _seen(spark, sf_dir, start, end), None, end, threshold=2), end
    return state


def stream_cycle(spark, sf_dir):
    """The multi-run lifecycle again, fed as files to a stream of one batch a week."""
    base = new_path(spark, "cycle")
    start = "2024-01-01"
    for i, end in enumerate(WEEKS):
        rows = _seen(spark, sf_dir, start, end).withColumn("observed_at", F.lit(end).cast("timestamp"))
        rows.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        cycle.start(stream, f"{base}/state", f"{base}/checkpoint", threshold=2).awaitTermination()
        start = end
    return tables.load_state(spark, f"{base}/state", cycle.STATE_SCHEMA)[0]


def site_lifecycle(spark, sf_dir):
    """The multi-run lifecycle once more, as state keyed by site; each week, every site says that it was looked at."""
    base, start = new_path(spark, "sites"), "2024-01-01"
    for end in WEEKS:
        rows = _seen(spark, sf_dir, start, end)
        rows = rows.unionByName(rows.select(F.lit(None).cast("string").alias("hash"), "source_url").distinct()).withColumn("observed_at", F.lit(end).cast("timestamp"))
        rows.write.mode("append").parquet(f"{base}/in")
        sites.start(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/checkpoint", threshold=2).awaitTermination()
        start = end
    return sites.state(spark.read.schema(sites.CHANGES).parquet(f"{base}/out"))


def ttl_cleanup(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderdate").select(C("o_orderkey").cast("string").alias("hash"), F.when(C("o_orderstatus") == "F", "CLOSED").otherwise("ACTIVE").alias("status"), F.when(C("o_orderkey") % 9 != 0, C("o_orderdate")).alias("closed_at"))
    return lifecycle.expire(rows, "1998-06-15").select("hash", "status")


def failsafe(spark, sf_dir):
    rows = table(spark, sf_dir, "events", "ts", "user_id", "event_type").withColumn("source_url", F.concat_ws("-", "user_id", "event_type"))
    late = C("ts") >= "2024-01-24"
    return lifecycle.trusted_sites(rows.where(late).select("source_url"), rows.where(~late).select("source_url"))


def site_health(spark, sf_dir):
    rows = table(spark, sf_dir, "events", "ts", "user_id", "event_type", "props").select(C("user_id").alias("site"), C("ts").alias("at"), (C("event_type") != "error").alias("ok"), C("props").alias("error"))
    return lifecycle.site_health(rows)


def json_props(spark, sf_dir):
    rows = table(spark, sf_dir, "events", "event_id", "props")
    wrapped = F.when(C("event_id") % 3 == 0, C("props")).when(C("event_id") % 3 == 1, F.concat(F.lit("Sure: "), C("props"), F.lit(" done"))).otherwise(F.lit("no object"))
    return rows.select("event_id", F.get_json_object(L.json_object(wrapped), "$.k").cast("int").alias("k"))


def _primary(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return rows.select(C("o_orderkey").alias("pos"), F.concat(F.lit("c"), C("o_custkey")).alias("company"), C("o_orderdate").alias("posted"), C("o_orderpriority").alias("keywords"), F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (C("o_orderkey") % 4 + 1).cast("int")).alias("status"))


def weekly_stats(spark, sf_dir):
    return reports.status_counts(reports.since(_primary(spark, sf_dir), "posted", "2001-07-20", 7), "status", STATUSES)


def top_users(spark, sf_dir):
    return reports.top(table(spark, sf_dir, "events", "event_id", "user_id"), C("user_id").cast("string"), 10, pos="event_id")


def top_keywords(spark, sf_dir):
    rows = _primary(spark, sf_dir).select("pos", F.explode(F.split("keywords", "[- ]")).alias("word")).where("word <> ''")
    return reports.top(rows, "word", 10, pos="pos")


def dashboard_counts(spark, sf_dir):
    return reports.status_counts(_primary(spark, sf_dir), "status", (*STATUSES, "offer"))


def company_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(C("o_custkey").alias("company"), C("o_orderkey").alias("pos"), F.concat(F.lit("u"), C("o_orderkey")).alias("url"))
    return reports.company_stats(rows.where("pos % 3 <> 0"), rows.where("pos % 5 = 0"))


def archive_split(spark, sf_dir):
    gone, kept = reports.archive(_primary(spark, sf_dir), "1998-06-15", days=30, status="status", date="posted")
    return gone.select("pos", F.lit("archived").alias("side")).unionByName(kept.select("pos", F.lit("kept").alias("side")))


def event_cap(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")
    return reports.event_cap(rows, 2, 1001, event="l_orderkey", event_pos="l_orderkey", pos="l_linenumber")


def last_ids(spark, sf_dir):
    return lifecycle.last_ids(table(spark, sf_dir, "orders", "o_orderkey"), 5000, order="o_orderkey")


def usage_quota(spark, sf_dir):
    return lifecycle.quota(table(spark, sf_dir, "events", "ts"), at="ts", unit="day", limit=340, buffer=10)


def allow_list(spark, sf_dir):
    names = table(spark, sf_dir, "customer", "c_custkey", "c_name").where("c_custkey % 7 = 0").select(F.upper(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("c_name"))
    return dedup.allowed(table(spark, sf_dir, "customer", "c_custkey", "c_name"), names, "c_name")


def notified_anti(spark, sf_dir):
    known = table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'").select(C("o_custkey").alias("c_custkey"))
    return dedup.not_in(table(spark, sf_dir, "customer", "c_custkey", "c_name"), known, "c_custkey")


def greedy_two_key_dedup(spark, sf_dir):
    """Of each customer's orders, those that repeat neither a priority nor a status."""
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    rows = rows.select("o_orderkey", "o_custkey", F.concat_ws("|", "o_custkey", "o_orderpriority").alias("link"), F.concat_ws("|", "o_custkey", "o_orderstatus").alias("ident"))
    return dedup.greedy_two_keys(rows, "link", "ident", "o_orderkey", few=1_000).select("o_orderkey", "o_custkey")


def greedy_line_dedup(spark, sf_dir):
    """Lines of orders by part, or by supplier and day; half of them share one supplier key, which only the first of them registers, and the parts of known ones are left out."""
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    ident = F.when(C("l_orderkey") % 2 == 0, "hot").when(C("l_linenumber") != 3, F.concat_ws("|", "l_suppkey", C("l_shipdate").cast("date")))
    link = F.when(C("l_linenumber") % 5 != 0, F.concat(F.lit("p"), "l_partkey")).otherwise("")
    # the tables hold some order and line numbers more than once; the first row of each is taken
    rows = dedup.first_wins(rows.select((C("l_orderkey") * 10 + C("l_linenumber")).alias("line"), link.alias("link"), ident.alias("ident")), ["line"], ["link", "ident"])
    known = table(spark, sf_dir, "part", "p_partkey").where("p_partkey % 9 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("known"))
    return dedup.greedy_two_keys(rows, "link", "ident", "line", known=known, few=1_000).select("line")


def last_wins_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    left, right = (dedup.last_wins(rows.where(f"o_orderkey % 2 = {k}"), ["o_custkey"], ["o_orderkey"]) for k in (0, 1))
    return changes.merge_snapshots(left, right, ["o_custkey"])


def company_snapshot(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority").select("o_orderkey", C("o_custkey").alias("company"), C("o_orderpriority").alias("url_pos"))
    return changes.company_snapshot(rows).select("o_orderkey", "company")


def run_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    sites = rows.groupBy(C("user_id").alias("site")).agg((F.count_if(C("event_type") == "error") < 15).alias("ok"), F.count_if((C("event_type") == "signup") & (C("event_id") % 4 == 0)).alias("jobs_count"))
    return reports.run_metrics(sites)


def engine_histogram(spark, sf_dir):
    return reports.histogram(table(spark, sf_dir, "events", "event_type").select(F.when(C("event_type") != "view", C("event_type")).alias("engine")), "engine")


def error_codes(spark, sf_dir):
    return reports.joined_codes(table(spark, sf_dir, "events", "user_id", "event_type"), "user_id", "event_type")


def status_update(spark, sf_dir):
    rows = _primary(spark, sf_dir).select("pos", "company", "status", F.lit("old").alias("notes"))
    return reports.mark(rows, "company", "c77", "applied", "sent").withColumn("notes", reports.note_added(C("notes"), F.when(C("status") == "applied", F.lit("seen"))))


def title_preview(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("d")))), lambda x: x["d"]).alias("t"))
    return rows.select("l_orderkey", reports.preview(C("t"), 3).alias("preview"))


def append_new(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").withColumn("token", U.change_token(F.lit("new"), C("o_custkey"), F.lit(""), F.lit(""), F.lit("")))
    return dedup.new_rows(rows.where("o_orderkey % 3 <> 0"), rows.where("o_orderkey % 3 = 0"), "token", ["o_orderkey"]).select("o_orderkey", "o_custkey")


def delete_keys(spark, sf_dir):
    """A written table without the rows of given keys, read back."""
    path = new_path(spark, "delete")
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    tables.replace(rows, path)
    tables.delete_keys(spark, path, rows.where("o_custkey % 4 = 0").select("o_custkey"), "o_custkey")
    return spark.read.parquet(path)


def partition_overwrite(spark, sf_dir):
    """Two of the partitions replaced in a table by status."""
    path = new_path(spark, "parts")
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    tables.replace_partitions(rows, path, "o_orderstatus")
    tables.replace_partitions(rows.where("o_orderstatus <> 'F' AND o_orderkey % 2 = 0"), path, "o_orderstatus")
    return spark.read.parquet(path).select("o_orderkey", C("o_orderstatus").cast("string").alias("o_orderstatus"))


def publish_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    return tables.counts(*[rows.where(C("o_orderstatus") == s) for s in ("O", "P", "F")])


def cache_freshness(spark, sf_dir):
    rows = table(spark, sf_dir, "events", "event_id", "ts").withColumnRenamed("ts", "cached_at")
    return lifecycle.fresh_cache(rows, "2024-01-15 12:00:00").select("event_id", "fresh")


def next_run(spark, sf_dir):
    return lifecycle.next_run(table(spark, sf_dir, "events", "user_id").select(C("user_id").cast("int").alias("run_iteration")), "2024-02-01 03:04:05")


def seed_rows(spark, sf_dir):
    """A sample row for each supplier."""
    return L.seed_rows(table(spark, sf_dir, "supplier", "s_suppkey").select(C("s_suppkey").alias("id")), "2024-01-01 12:00:00")


def _seen_sql(a: str, b: str) -> str:
    return f"SELECT DISTINCT user_id || '-' || event_type || '-' || (event_id % 5) AS hash, 's' || user_id % 10 AS source_url FROM events WHERE ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}'"


def _snapshot_sql(a: str, b: str) -> str:
    return f"SELECT user_id || '-' || event_type || '-' || (event_id % 7) AS hash, min(event_id) AS pos, any_value(user_id) % 40 || '-' || (any_value(event_id) % 7) AS place FROM events WHERE ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}' GROUP BY 1"


_DIFF = """first AS (SELECT place, arg_min(hash, pos) AS hash FROM prev GROUP BY place),
r AS (SELECT cur.*, p.hash IS NOT NULL AS exact, f.hash AS fh, t.pos AS tp FROM cur LEFT JOIN prev p ON p.hash = cur.hash LEFT JOIN first f ON f.place = cur.place LEFT JOIN cur t ON t.hash = f.hash),
n AS (SELECT *, row_number() OVER (PARTITION BY place, exact ORDER BY pos) AS turn FROM r),
d AS (SELECT hash, pos, place, CASE WHEN exact THEN 'ACTIVE' WHEN fh IS NOT NULL AND turn = 1 AND (tp IS NULL OR tp > pos) THEN 'UPDATED' ELSE 'NEW' END AS status FROM n)"""
_CUR = f"WITH cur AS ({_snapshot_sql(*CURRENT)}), prev AS ({_snapshot_sql(*PREVIOUS)})"


def _multi_run_sql() -> str:
    steps, start = ["w0 AS (SELECT NULL::VARCHAR AS hash, NULL::VARCHAR AS source_url, NULL::VARCHAR AS status, NULL::INTEGER AS missing_count, NULL::TIMESTAMP AS first_seen, NULL::TIMESTAMP AS last_seen, NULL::TIMESTAMP AS closed_at WHERE false)"], "2024-01-01"
    for i, end in enumerate(WEEKS, 1):
        now = f"TIMESTAMP '{end}'"
        steps.append(f"""w{i} AS (SELECT coalesce(c.hash, p.hash) AS hash, coalesce(c.source_url, p.source_url) AS source_url,
            CASE WHEN c.hash IS NOT NULL THEN 'ACTIVE' WHEN p.status = 'CLOSED' OR p.missing_count + 1 >= 2 THEN 'CLOSED' ELSE 'MISSING' END AS status,
            CASE WHEN c.hash IS NOT NULL THEN 0 WHEN p.status = 'CLOSED' THEN p.missing_count ELSE p.missing_count + 1 END AS missing_count, coalesce(p.first_seen, {now}) AS first_seen,
            CASE WHEN c.hash IS NOT NULL OR (p.status <> 'CLOSED' AND p.missing_count + 1 >= 2) THEN {now} ELSE p.last_seen END AS last_seen,
            CASE WHEN c.hash IS NOT NULL THEN NULL WHEN p.status = 'CLOSED' THEN coalesce(p.closed_at, p.last_seen, {now}) WHEN p.missing_count + 1 >= 2 THEN {now} END AS closed_at
            FROM w{i - 1} p FULL JOIN ({_seen_sql(start, end)}) c ON c.hash = p.hash)""")
        start = end
    return f"WITH {', '.join(steps)} SELECT * FROM w{len(WEEKS)}"


_STATUS = "['new', 'applied', 'rejected', 'interview'][CAST(o_orderkey % 4 + 1 AS INTEGER)]"
QUERIES = {
    "snapshot_diff": (snapshot_diff, f"{_CUR}, {_DIFF} SELECT * FROM d"),
    "page_diff": (page_diff, f"""{_CUR}, {_DIFF} SELECT d.hash AS key, d.pos, CASE d.status WHEN 'ACTIVE' THEN 'UPDATED' ELSE d.status END AS status FROM d LEFT JOIN prev p ON p.hash = d.hash
        WHERE d.status <> 'ACTIVE' OR d.pos % 3 <> p.pos % 3"""),
    "page_change_status": (page_change_status, """SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'error' WHEN page_id % 6 = 0 THEN 'unchanged' WHEN page_id % 4 = 0 THEN 'ignored_no_jobs' WHEN page_id % 2 = 1 THEN 'new_url_tracked'
        WHEN page_id % 3 = 0 THEN 'no_new_openings' ELSE 'content_changed' END AS status FROM pages"""),
    "lifecycle_merge": (lifecycle_merge, f"""WITH p AS ({_seen_sql('2024-01-01', WEEKS[1])}), c AS ({_seen_sql(WEEKS[1], WEEKS[3])}), e AS (SELECT DISTINCT source_url FROM c WHERE source_url <> 's3'),
        j AS (SELECT coalesce(c.hash, p.hash) AS hash, coalesce(c.source_url, p.source_url) AS source_url, c.hash IS NOT NULL AS here, p.hash IS NOT NULL AS old, p.source_url NOT IN (SELECT source_url FROM e) AS waits FROM p FULL JOIN c ON c.hash = p.hash)
        SELECT hash, source_url, CASE WHEN here OR waits THEN 'ACTIVE' ELSE 'CLOSED' END AS status, CASE WHEN here OR waits THEN 0 ELSE 1 END AS missing_count, CASE WHEN old THEN TIMESTAMP '{WEEKS[1]}' ELSE TIMESTAMP '{WEEKS[3]}' END AS first_seen,
            CASE WHEN here OR NOT waits THEN TIMESTAMP '{WEEKS[3]}' ELSE TIMESTAMP '{WEEKS[1]}' END AS last_seen, CASE WHEN NOT here AND NOT waits THEN TIMESTAMP '{WEEKS[3]}' END AS closed_at FROM j"""),
    "lifecycle_multi_run": (lifecycle_multi_run, _multi_run_sql()),
    "stream_cycle": (stream_cycle, _multi_run_sql()),
    "site_lifecycle": (site_lifecycle, _multi_run_sql()),
    "ttl_cleanup": (ttl_cleanup, """SELECT CAST(o_orderkey AS VARCHAR) AS hash, CASE o_orderstatus WHEN 'F' THEN 'CLOSED' ELSE 'ACTIVE' END AS status FROM orders
        WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 9 <> 0 AND o_orderdate < TIMESTAMP '1998-06-15' - INTERVAL 30 DAY)"""),
    "failsafe": (failsafe, """WITH c AS (SELECT user_id || '-' || event_type AS source_url, count(*) FILTER (ts < TIMESTAMP '2024-01-24') AS before, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS now
        FROM events GROUP BY 1) SELECT * FROM c WHERE NOT (now = 0 AND before > 5)"""),
    "site_health": (site_health, """SELECT user_id AS site, max(ts) FILTER (event_type <> 'error') AS last_success, max(ts) FILTER (event_type = 'error') AS last_failure, arg_max(props, ts) FILTER (event_type = 'error') AS last_error,
        arg_max(CASE WHEN event_type <> 'error' THEN 'success' ELSE 'failed' END, ts) AS last_status FROM events GROUP BY 1"""),
    "json_props": (json_props, "SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events"),
    "weekly_stats": (weekly_stats, f"WITH p AS (SELECT {_STATUS} AS s FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-13') SELECT count(*) AS total, {', '.join(f'''count(*) FILTER (s = '{s}') AS n_{s}''' for s in STATUSES)} FROM p"),
    "top_users": (top_users, "SELECT CAST(user_id AS VARCHAR) AS name, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, min(event_id), name LIMIT 10"),
    "top_keywords": (top_keywords, "WITH w AS (SELECT o_orderkey, unnest(regexp_split_to_array(o_orderpriority, '[- ]')) AS name FROM orders) SELECT name, count(*) AS n FROM w WHERE name <> '' GROUP BY 1 ORDER BY n DESC, min(o_orderkey), name LIMIT 10"),
    "dashboard_counts": (dashboard_counts, f"WITH p AS (SELECT {_STATUS} AS s FROM orders) SELECT count(*) AS total, {', '.join(f'''count(*) FILTER (s = '{s}') AS n_{s}''' for s in (*STATUSES, 'offer'))} FROM p"),
    "company_stats": (company_stats, """WITH f AS (SELECT o_custkey AS company, o_orderkey AS pos, 0 AS b FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_orderkey % 5 = 0)
        SELECT company, CAST(sum(1 - b) AS BIGINT) AS active_roles, CAST(sum(b) AS BIGINT) AS new_roles, 'u' || arg_min(pos, b * 1000000000 + pos) AS career_url FROM f GROUP BY company"""),
    "archive_split": (archive_split, f"SELECT o_orderkey AS pos, CASE WHEN {_STATUS} <> 'new' AND o_orderdate < TIMESTAMP '1998-05-16' THEN 'archived' ELSE 'kept' END AS side FROM orders"),
    "event_cap": (event_cap, """WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem),
        b AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, r) AS n FROM r WHERE r <= 2) SELECT l_orderkey, l_linenumber FROM b WHERE n <= 1001"""),
    "last_n_ids": (last_ids, "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 5000"),
    "usage_quota": (usage_quota, "SELECT date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS used, greatest(0, 340 - count(*)) AS remaining, count(*) >= 330 AS stop FROM events GROUP BY 1"),
    "allow_list_semi": (allow_list, "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 7 = 0"),
    "notified_anti": (notified_anti, "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "greedy_two_key_dedup": (greedy_two_key_dedup, """WITH g AS (SELECT o_custkey, list({'a': [o_orderpriority], 'b': [o_orderstatus], 'k': [o_orderkey]} ORDER BY o_orderkey) AS l FROM orders GROUP BY 1),
        f AS (SELECT o_custkey, list_reduce(l, lambda s, x: CASE WHEN list_has_any(s.a, x.a) OR list_has_any(s.b, x.b) THEN s ELSE {'a': list_concat(s.a, x.a), 'b': list_concat(s.b, x.b), 'k': list_concat(s.k, x.k)} END) AS s FROM g)
        SELECT unnest(s.k) AS o_orderkey, o_custkey FROM f"""),
    "greedy_line_dedup": (greedy_line_dedup, None),
    "last_wins_merge": (last_wins_merge, """WITH l AS (SELECT o_custkey, o_orderkey % 2 AS s, max(o_orderkey) AS k FROM orders GROUP BY ALL), m AS (SELECT o_custkey, arg_max(k, s) AS k FROM l GROUP BY 1)
        SELECT o_orderkey, o.o_custkey, o_totalprice FROM orders o JOIN m ON m.k = o.o_orderkey"""),
    "company_snapshot": (company_snapshot, "SELECT o_orderkey, o_custkey AS company FROM (SELECT *, max(o_orderpriority) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_orderpriority = m"),
    "run_metrics": (run_metrics, """WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'error') < 15 AS ok, count(*) FILTER (event_type = 'signup' AND event_id % 4 = 0) AS j FROM events GROUP BY 1)
        SELECT count(*) AS sites_total, count(*) FILTER (ok) AS sites_ok, count(*) FILTER (NOT ok) AS sites_failed, CAST(sum(j) AS BIGINT) AS jobs_found, count(*) FILTER (ok AND j = 0) AS sites_empty FROM s"""),
    "engine_histogram": (engine_histogram, "SELECT CASE event_type WHEN 'view' THEN 'Unknown' ELSE event_type END AS name, count(*) AS n FROM events GROUP BY 1"),
    "error_codes": (error_codes, "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS codes FROM events GROUP BY 1"),
    "status_update": (status_update, f"""WITH f AS (SELECT min(o_orderkey) AS k FROM orders WHERE o_custkey = 77), p AS (SELECT o_orderkey AS pos, 'c' || o_custkey AS company, CASE WHEN o_orderkey = k THEN 'applied' ELSE {_STATUS} END AS status, CASE WHEN o_orderkey = k THEN 'sent' ELSE 'old' END AS notes FROM orders, f)
        SELECT pos, company, status, notes || CASE WHEN status = 'applied' THEN ' | seen' ELSE '' END AS notes FROM p"""),
    "title_preview": (title_preview, "SELECT l_orderkey, string_agg(strftime(l_shipdate, '%Y-%m-%d'), ' | ' ORDER BY n) AS preview FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate) AS n FROM lineitem) WHERE n <= 3 GROUP BY 1"),
    "append_new": (append_new, "SELECT min(o_orderkey) AS o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0) GROUP BY o_custkey"),
    "delete_keys": (delete_keys, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 4 <> 0"),
    "partition_overwrite": (partition_overwrite, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' OR o_orderkey % 2 = 0"),
    "publish_counts": (publish_counts, "SELECT count(*) FILTER (o_orderstatus = 'O') AS active, count(*) FILTER (o_orderstatus = 'P') AS new, count(*) FILTER (o_orderstatus = 'F') AS closed FROM orders"),
    "cache_freshness": (cache_freshness, "SELECT event_id, ts >= TIMESTAMP '2024-01-14 12:00:00' AS fresh FROM events"),
    "next_run": (next_run, "SELECT printf('run-20240201030405-%06d', max(user_id) + 1) AS run_id, CAST(max(user_id) + 1 AS INTEGER) AS run_iteration, TIMESTAMP '2024-02-01 03:04:05' AS run_timestamp FROM events"),
    "seed_rows": (seed_rows, """SELECT TIMESTAMP '2024-01-01 12:00:00' - i * INTERVAL 1 HOUR AS timestamp, ['Associate AI Engineer', 'Junior Software Engineer', 'Graduate Data Analyst', 'Trainee ML Engineer'][i % 4 + 1] AS title,
        'Company ' || chr(CAST(65 + i % 6 AS INTEGER)) AS company, ['new', 'applied', 'rejected', 'interview'][i % 4 + 1] AS status FROM (SELECT s_suppkey AS i FROM supplier)"""),
}
