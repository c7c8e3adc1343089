"""Queries over rewrites of sources and over a monitor's projects; digits of a row's number say what its text or scan is."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, monitor, rewrites
from ..operators.rules import line_findings
from .flow_queries import _customers, _digits, _pick
from .packs import FAMILY_RULES
from .registry import _q, _t, _values, query

# --- safe rewrites: a line, what becomes of it, and whether the rule still tells it then

LINES = [
    ("<a href='/x' target='_blank'>x</a>", "<a href='/x' target='_blank' rel=\"noopener noreferrer\">x</a>", 0), ('\t<a target = "_blank" href={u}>', '\t<a target = "_blank" rel="noopener noreferrer" href={u}>', 0), ('<a target="_blank" rel="noopener">', '<a target="_blank" rel="noopener">', 0), ("<p>$1 \\ text</p>", "<p>$1 \\ text</p>", 0),
    ('<a target="_blank" rel={r}>', '<a target="_blank" rel={r}>', 1), ("<a target=\"_blank\"><b target='_blank'>", "<a target=\"_blank\" rel=\"noopener noreferrer\"><b target='_blank'>", 0), ("", "", 0),
]
_L, _LC = _digits("k", *[len(LINES)] * 3), _digits("c_custkey", *[len(LINES)] * 3)
_LINES_SQL = "WITH " + "d AS (SELECT c_custkey AS k, a.b || chr(10) || b.b || chr(10) || c.b AS before, a.a || chr(10) || b.a || chr(10) || c.a AS after, concat_ws(',', CASE WHEN a.a <> a.b THEN 1 END, CASE WHEN b.a <> b.b THEN 2 END, CASE WHEN c.a <> c.b THEN 3 END) AS changed, (a.a <> a.b)::INTEGER + (b.a <> b.b)::INTEGER + (c.a <> c.b)::INTEGER AS n_changed, a.told + b.told + c.told AS left_over FROM customer " + " ".join(
    f"JOIN {_values([(i, *x) for i, x in enumerate(LINES)], 'n, b, a, told').replace('AS v(', f'AS {t}(')} ON {t}.n = {_LC[j]}" for j, t in enumerate("abc")
) + ")"


def _pages(spark, sf):
    return _customers(spark, sf).select(F.concat("k", F.lit("/a.tsx")).alias("file"), F.lit("tsx").alias("ext"), F.concat_ws("\n", *[_pick(d, [x[0] for x in LINES]) for d in _L]).alias("text"))


def _told(files):
    return line_findings(files, [r for r in FAMILY_RULES if r.rule_id in rewrites.LINE_REWRITES])


@query(f"{_LINES_SQL} SELECT k || '/a.tsx' AS file, before, after, changed AS lines FROM d WHERE n_changed > 0")
def safe_rewrites(spark, sf):
    """A page of three lines for each customer, and what the rewrites of its findings make of it."""
    files = _pages(spark, sf)
    out = rewrites.rewritten_lines(files, _told(files))
    return out.select("file", "before", "after", F.array_join(F.transform("lines", lambda x: x["line"].cast("string")), ",").alias("lines"))


@query(f"{_LINES_SQL} SELECT 'react.unsafe-target-blank' AS rule_id, sum(n_changed + left_over)::BIGINT AS before, sum(left_over)::BIGINT AS after FROM d")
def rewrites_checked(spark, sf):
    """The findings of those pages by rule, before the rewrites and after."""
    files = _pages(spark, sf)
    told = _told(files)
    return history.fix_check(told, _told(rewrites.after_rewrites(files, rewrites.rewritten_lines(files, told))))


# an ignore file, and what is added to it (null: nothing, since it names .env); where a secret was found, and whether that is an environment file
IGNORES = [(None, ".env\n.env.local\n.env.*.local\n"), ("", ".env\n.env.local\n.env.*.local\n"), ("dist", ".env\n.env.local\n.env.*.local\n"), ("node_modules\n .env.local\t\r\n", ".env\n.env.*.local\n"), (".env\n", None), (".env*\n.env.*.local\n", ".env\n.env.local\n"), ("# .env\n", ".env\n.env.local\n.env.*.local\n")]
FOUND = [("secret.generic", ".env", 1), ("secret.aws", "apps/a/.env.local", 1), ("secret.generic", "src/env.ts", 0), ("env.tracked", ".env", 0)]
_I, _IC = _digits("k", len(IGNORES), len(FOUND)), _digits("c_custkey", len(IGNORES), len(FOUND))


@query(
    f"SELECT c_custkey AS project, coalesce(i.text, '') || CASE WHEN i.text <> '' AND i.text NOT LIKE '%' || chr(10) THEN chr(10) ELSE '' END || chr(10) || {_q(rewrites.NOTE)} || chr(10) || i.added AS after, len(i.added) - len(replace(i.added, chr(10), '')) AS n_added FROM customer "
    f"JOIN {_values([(i, *x) for i, x in enumerate(IGNORES)], 'n, text, added').replace('AS v(', 'AS i(')} ON i.n = {_IC[0]} JOIN {_values([(i, y) for i, (_, _, y) in enumerate(FOUND)], 'n, leaks').replace('AS v(', 'AS f(')} ON f.n = {_IC[1]} WHERE leaks = 1 AND i.added IS NOT NULL"
)
def hardened_ignores(spark, sf):
    """A project for each customer, with an ignore file or none and a finding."""
    c = _customers(spark, sf).withColumnRenamed("k", "project")
    d = [x.replace("(k)", "(project)") for x in _I]
    found = c.select("project", _pick(d[1], [r for r, _, _ in FOUND]).alias("rule_id"), _pick(d[1], [f for _, f, _ in FOUND]).alias("file"))
    files = c.select("project", _pick(d[0], [t for t, _ in IGNORES]).alias("text")).filter(f"{d[0]} > 0 OR project % 2 = 0")
    return rewrites.hardened_ignores(found, files).select("project", "after", F.size("added").cast("long").alias("n_added"))


# --- the monitor: users are projects and days are scans, event types stand for rules

NOW = "2024-07-01T00:00:00Z"
# the last scan as written, minutes of its age (null: unreadable or none); minutes asked for, minutes that hold
LAST = [(None, None), ("2024-06-30T23:56:00Z", 4), ("2024-06-30T23:55:00", 5), ("2024-07-01T01:00:00+02:00", 60), ("soon", None), ("2024-06-30", 1440), ("2024-06-30T00:00:00.5Z", 1439), ("2024-07-02T00:00:00Z", -1440)]
ASKED = [(1, 5), (60, 60), (None, 1440), (0, 1440), (61, 61)]
_M, _MC = _digits("k", len(LAST), len(ASKED)), _digits("c_custkey", len(LAST), len(ASKED))


@query(
    f"SELECT c_custkey AS project, l.text AS last_scan FROM customer JOIN {_values([(i, *x) for i, x in enumerate(LAST)], 'n, text, age').replace('AS v(', 'AS l(')} ON l.n = {_MC[0]} JOIN {_values([(i, m) for i, (_, m) in enumerate(ASKED)], 'n, minutes').replace('AS v(', 'AS a(')} ON a.n = {_MC[1]} "
    "WHERE l.age IS NULL OR l.age >= a.minutes"
)
def rescans_due(spark, sf):
    """Customers as projects of a monitor: which are due."""
    minutes = F.element_at(F.array(*[F.lit(m).cast("int") for m, _ in ASKED]), F.expr(_M[1]).cast("int") + 1)
    p = _customers(spark, sf).select(F.col("k").alias("project"), _pick(_M[0], [t for t, _ in LAST]).alias("last_scan"), minutes.alias("interval_minutes"))
    return monitor.due(p, F.lit(NOW).cast("timestamp")).select("project", "last_scan")


_RULE_OF = "CASE event_type WHEN 'error' THEN 'ai.prompt-injection-to-agency' WHEN 'click' THEN 'ai.tool-ssrf' ELSE 'x.' || event_type END"
_PRINT_OF = "event_type || ':' || CAST(CAST(floor(value) AS BIGINT) % 5 AS VARCHAR)"


@query(
    f"WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, {_RULE_OF} AS rule, {_PRINT_OF} AS print FROM events), s AS (SELECT user_id, day, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS back FROM e GROUP BY user_id, day), "
    "p AS (SELECT user_id, e.print, bool_or(back = 1) AS now, bool_or(back = 2) AS was FROM e JOIN s USING (user_id, day) WHERE back <= 2 GROUP BY ALL), c AS (SELECT user_id, count(*) FILTER (now AND NOT was) AS new, count(*) FILTER (was AND NOT now) AS fixed FROM p GROUP BY ALL), "
    "r AS (SELECT user_id, count(*) FILTER (rule LIKE 'ai.%') AS agent_total, count(*) FILTER (rule = 'ai.prompt-injection-to-agency') AS agent_chains FROM e JOIN s USING (user_id, day) WHERE back = 1 GROUP BY ALL), "
    "t AS (SELECT user_id, max(back)::BIGINT AS scans, max(n) FILTER (back = 1) AS total, string_agg(CAST(day AS VARCHAR) || '=' || n, ' ' ORDER BY day) FILTER (back <= 40) AS trend FROM s GROUP BY ALL) "
    "SELECT user_id AS project, scans, total, CASE WHEN scans > 1 THEN new END AS new, CASE WHEN scans > 1 THEN fixed END AS fixed, agent_total, agent_chains, trend FROM t JOIN c USING (user_id) JOIN r USING (user_id)"
)
def monitor_state(spark, sf):
    """Users as projects, their days as scans, events as findings: the state that a monitor shows."""
    e = _t(spark, sf, "events").select(F.col("user_id").alias("project"), F.to_date("ts").alias("scan"), F.expr(_RULE_OF).alias("rule_id"), F.expr(_PRINT_OF.replace("VARCHAR", "STRING")).alias("fingerprint"))
    scans = e.select("project", "scan", F.col("scan").alias("at")).distinct()
    out = monitor.project_state(scans, e)
    return out.withColumn("trend", F.array_join(F.transform("trend", lambda p: F.concat_ws("=", p["at"].cast("string"), p["total"].cast("string"))), " "))


@query(f"SELECT user_id AS project, event_id AS alert FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT {monitor.FEED}")
def alert_feed(spark, sf):
    """The newest alerts of all projects (a report of the first ones, which is the feature)."""
    a = _t(spark, sf, "events").filter("event_type = 'error'").select(F.col("user_id").alias("project"), F.col("event_id").alias("alert"), "ts")
    return monitor.feed(a, [F.desc("ts"), F.col("alert")]).select("project", "alert")
