"""The registered queries: each operator over whole driver tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.versions import bounds, version, within
from ..operators import dataflow, deps, graph, history, paths
from ..operators import findings as fi
from ..operators.rules import IGNORE, LONGEST_LINE, Rule, line_findings, multiline_findings
from ..sources import reports
from ..streaming import logs
from .registry import QUERIES, RANK_SQL, SQL, _q, _t, _values, choice, query  # noqa: F401
from .packs import BRIDGE, DIMENSION, TECHNIQUES, TEXT_RULES, bridge, dimension, techniques

def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), "text", F.col("lang").alias("ext"))


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return line_findings(_docs(spark, sf), TEXT_RULES)


L = "l AS (SELECT file, ext, unnest(generate_series(1, len(x)))::INTEGER AS line, unnest(x) AS t, whole FROM (SELECT doc_id::VARCHAR AS file, lang AS ext, string_split(text, chr(10)) AS x, text AS whole FROM documents))"


def _rule_sql(rules: list[Rule], where: str = "true") -> str:
    one = "SELECT {id} AS rule_id, file, line, (length(regexp_extract(t, {before}, 1)) + 1)::INTEGER AS \"column\", trim(t, ' ') AS code_snippet, {c} AS confidence, {s} AS severity, {k}::INTEGER AS rule_ord FROM l WHERE length(t) <= {n} AND NOT regexp_matches(t, {ignore}) AND regexp_matches(t, {re}) AND {where}"
    parts = [one.format(id=_q(r.rule_id), re=_q(r.regex), before=_q(f"^([\\s\\S]*?)(?:{r.regex})"), c=_q(r.confidence), s=_q(r.severity), k=k, n=LONGEST_LINE, ignore=_q(IGNORE), where=where) for k, r in enumerate(rules)]
    return "f0 AS (" + " UNION ALL ".join(parts) + "), f AS (SELECT *, substr(sha1(concat_ws('|', rule_id, file, line::VARCHAR, code_snippet)), 1, 16) AS fingerprint FROM f0)"


F_SQL = f"WITH {L}, {_rule_sql(TEXT_RULES)} "
ROW = 'rule_id, file, line, "column", code_snippet, confidence, severity, rule_ord, fingerprint'


# --- lines and patterns


@query(f"WITH {L} SELECT file, line, length(t)::INTEGER AS chars FROM l")
def lines_explode(spark, sf):
    return tx.explode_lines(_docs(spark, sf), "file").select("file", "line", F.length("line_text").alias("chars"))


@query(f"{F_SQL} SELECT {ROW} FROM f")
def pattern_findings(spark, sf):
    return _found(spark, sf)


NEEDS = [Rule(r.rule_id, r.regex, r.severity, r.confidence, requires_file=r"[0-9]{4}", languages=("en", "de")) for r in TEXT_RULES]


@query(f"WITH {L}, {_rule_sql(NEEDS, where="regexp_matches(whole, '[0-9]{4}') AND ext IN ('en', 'de')")} SELECT {ROW} FROM f")
def requires_file_filter(spark, sf):
    return line_findings(_docs(spark, sf), NEEDS)


LINE_FILTERS = [Rule("info-leak.mail-address", TEXT_RULES[2].regex, "medium", "medium", requires_line="[0-9]", exclude_line="mail8")]


@query(f"WITH {L}, {_rule_sql(LINE_FILTERS, where="regexp_matches(t, '[0-9]') AND NOT regexp_matches(t, 'mail8')")} SELECT {ROW} FROM f")
def line_filters(spark, sf):
    return line_findings(_docs(spark, sf), LINE_FILTERS)


NEAR = [Rule("info-leak.mail-address", TEXT_RULES[2].regex, "medium", "medium", exclude_window=r"[0-9]{5}", window=2)]


@query(
    f"WITH {L}, w AS (SELECT *, bool_or(regexp_matches(t, '[0-9]{{5}}')) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM l), "
    f"{_rule_sql(NEAR, where='NOT near').replace('FROM l WHERE', 'FROM w WHERE')} SELECT {ROW} FROM f"
)
def exclude_window(spark, sf):
    return line_findings(_docs(spark, sf), NEAR)


@query(f"WITH {L} SELECT file, count(*) AS lines, count(*) FILTER (length(t) > 200) AS long_lines, count(*) FILTER (regexp_matches(t, '(?i)licen[cs]e')) AS marked FROM l GROUP BY file")
def line_guards(spark, sf):
    lines = tx.explode_lines(_docs(spark, sf), "file")
    return lines.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(F.length("line_text") > 200).alias("long_lines"), F.count_if(F.col("line_text").rlike("(?i)licen[cs]e")).alias("marked"))


# --- enrichment and controls


DIM = _values(DIMENSION, "rule_id, title, severity, why, fix, cwe")
BRIDGE_SQL = _values(BRIDGE, "rule_id, technique_id")


@query(f"{F_SQL} SELECT f.fingerprint, f.rule_id, coalesce(nullif(f.severity, ''), v.severity, 'medium') AS severity, coalesce(v.title, f.rule_id) AS title, v.why, v.fix, v.cwe FROM f LEFT JOIN {DIM} ON v.rule_id = f.rule_id")
def enrich_rules(spark, sf):
    return fi.enrich(_found(spark, sf), dimension(spark)).select("fingerprint", "rule_id", "severity", "title", "why", "fix", "cwe")


@query(f"{F_SQL} SELECT f.rule_id, v.technique_id, t.tactic, count(*) AS n FROM f JOIN {BRIDGE_SQL} ON v.rule_id = f.rule_id JOIN {_values(TECHNIQUES, 'technique_id, tactic').replace('AS v(', 'AS t(')} ON t.technique_id = v.technique_id GROUP BY ALL")
def technique_bridge(spark, sf):
    found = fi.with_techniques(_found(spark, sf), bridge(spark)).select("rule_id", F.explode("attack").alias("technique_id"))
    return found.join(F.broadcast(techniques(spark)), "technique_id").groupBy("rule_id", "technique_id", "tactic").agg(F.count("*").alias("n"))


@query(f"{F_SQL}, d AS (SELECT rule_id, file, line, code_snippet, rule_ord, substr(sha1(concat_ws('|', rule_id, code_snippet)), 1, 16) AS fingerprint FROM f) SELECT fingerprint, rule_id, file, line FROM d QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY rule_ord, file, line) = 1")
def fingerprint_dedup(spark, sf):
    same = _found(spark, sf).withColumn("fingerprint", F.substring(F.sha1(F.concat_ws("|", "rule_id", "code_snippet")), 1, 16))
    return fi.first_of_each(same, [F.col("rule_ord"), F.col("file"), F.col("line")]).select("fingerprint", "rule_id", "file", "line")


@query(f"{F_SQL} SELECT v.severity, v.rank, count(f.fingerprint) AS n FROM {_values([(s, r) for s, r, _ in tx.SEVERITIES], 'severity, rank')} LEFT JOIN f ON f.severity = v.severity GROUP BY ALL")
def severity_counts_zero_filled(spark, sf):
    return fi.severity_counts(_found(spark, sf))


@query(f"{F_SQL} SELECT fingerprint, rule_id, severity, file, line FROM f ORDER BY {RANK_SQL} DESC, file, line, fingerprint LIMIT 40")
def ranked_topk(spark, sf):
    return fi.ranked(_found(spark, sf), 40).select("fingerprint", "rule_id", "severity", "file", "line")


@query(f"{F_SQL} SELECT fingerprint, CASE rule_id WHEN 'info-leak.host-address' THEN 'high' ELSE severity END AS severity FROM f WHERE rule_id <> 'license.notice'")
def rule_controls(spark, sf):
    return fi.controlled(_found(spark, sf), ["license.notice"], {"info-leak.host-address": "high"}).select("fingerprint", "severity")


@query(f"{F_SQL} SELECT fingerprint, severity FROM f WHERE {RANK_SQL} >= 2")
def min_severity(spark, sf):
    return fi.at_least(_found(spark, sf), "medium").select("fingerprint", "severity")


@query(f"{F_SQL} SELECT coalesce(bool_or({RANK_SQL} >= 3), false) AS failed FROM f")
def severity_gate(spark, sf):
    return fi.gate(_found(spark, sf), "high")


PATHS_SQL = "CASE doc_id % 5 WHEN 0 THEN 'scripts/' WHEN 1 THEN 'src/__tests__/' WHEN 2 THEN 'app/tools/' ELSE 'src/' END || 'f' || doc_id || CASE doc_id % 7 WHEN 0 THEN '.test.ts' ELSE '.ts' END"


@query(f"SELECT p AS file, severity, CASE WHEN dev AND rank > 1 THEN 'low' ELSE severity END AS capped, dev FROM (SELECT p, severity, {RANK_SQL} AS rank, (p LIKE 'scripts/%' OR p LIKE '%/__tests__/%' OR p LIKE '%.test.%') AS dev FROM (SELECT {PATHS_SQL} AS p, CASE doc_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' ELSE 'medium' END AS severity FROM documents))")
def dev_only_cap(spark, sf):
    file = F.expr(PATHS_SQL.replace("||", "||"))
    df = _t(spark, sf, "documents").select(file.alias("file"), F.expr("CASE doc_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' ELSE 'medium' END").alias("severity"))
    return fi.capped_dev_only(df.withColumn("was", F.col("severity"))).select("file", F.col("was").alias("severity"), F.col("severity").alias("capped"), tx.dev_only(F.col("file")).alias("dev"))


@query(f"{F_SQL} SELECT fingerprint FROM f WHERE fingerprint NOT IN (SELECT fingerprint FROM f WHERE file::BIGINT % 2 = 0)")
def baseline_new(spark, sf):
    found = _found(spark, sf)
    return fi.not_in_baseline(found, found.filter(F.col("file").cast("long") % 2 == 0)).select("fingerprint")


@query(f"{F_SQL} SELECT fingerprint FROM f WHERE fingerprint IN (SELECT fingerprint FROM f WHERE file::BIGINT % 2 = 0)")
def baseline_known(spark, sf):
    found = _found(spark, sf)
    return fi.in_baseline(found, found.filter(F.col("file").cast("long") % 2 == 0)).select("fingerprint")


@query(f"{F_SQL}, g AS (SELECT *, CASE WHEN rule_ord = 4 THEN 0 ELSE line END AS place FROM f) SELECT fingerprint, place AS line FROM g WHERE place <= 0 OR place % 2 = 1")
def diff_filter(spark, sf):
    found = _found(spark, sf).withColumn("line", F.when(F.col("rule_ord") == 4, F.lit(0)).otherwise(F.col("line")))
    changed = tx.explode_lines(_docs(spark, sf), "file").filter("line % 2 = 1").select("file", "line")
    return fi.in_diff(found, changed).select("fingerprint", "line")


@query(f"{F_SQL}, e AS (SELECT f.rule_id, v.technique_id FROM f JOIN {BRIDGE_SQL} ON v.rule_id = f.rule_id), c AS (SELECT technique_id, count(*) AS n, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules FROM e GROUP BY technique_id) SELECT *, max(n) OVER () AS top FROM c")
def navigator_counts(spark, sf):
    counts = fi.technique_counts(fi.with_techniques(_found(spark, sf), bridge(spark)))
    return counts.select("technique_id", "n", F.array_join("rules", ",").alias("rules"), "top")


# --- history


@query("WITH b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) < 1996), a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) >= 1996) SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'new' WHEN a.o_custkey IS NULL THEN 'fixed' ELSE 'persistent' END AS status FROM b FULL JOIN a ON a.o_custkey = b.o_custkey")
def snapshot_diff(spark, sf):
    orders = _t(spark, sf, "orders")
    return history.snapshot_diff(orders.filter(F.year("o_orderdate") < 1996), orders.filter(F.year("o_orderdate") >= 1996), "o_custkey")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INTEGER AS place FROM orders QUALIFY place <= 5")
def snapshot_retention(spark, sf):
    return history.latest(_t(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 5).select("o_custkey", "o_orderkey", "place")


SEV_OF_ORDER = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'info' END"


def _order_findings(spark, sf):
    return _t(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("fingerprint"), "o_orderkey", "o_orderdate", F.expr(SEV_OF_ORDER).alias("severity"))


@query(f"WITH o AS (SELECT o_custkey::VARCHAR AS fingerprint, o_orderkey, o_orderdate, {SEV_OF_ORDER} AS severity FROM orders) SELECT o_orderkey, severity, 'later' AS scan FROM o WHERE year(o_orderdate) >= 1997 AND severity IN ('critical', 'high') AND fingerprint NOT IN (SELECT fingerprint FROM o WHERE year(o_orderdate) < 1997) UNION ALL SELECT o_orderkey, severity, 'first' FROM o WHERE severity = 'critical'")
def new_alerts_first_vs_later(spark, sf):
    o = _order_findings(spark, sf)
    later = history.alerts(o.filter(F.year("o_orderdate") >= 1997), o.filter(F.year("o_orderdate") < 1997), first=False)
    return later.select("o_orderkey", "severity", F.lit("later").alias("scan")).union(history.alerts(o, o.limit(0), first=True).select("o_orderkey", "severity", F.lit("first")))


@query("SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n, place FROM (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC)::INTEGER AS place FROM events GROUP BY 1, 2) WHERE place <= 40")
def trend_last_40(spark, sf):
    days = _t(spark, sf, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return history.latest(days, ["user_id"], [F.desc("day")], 40).select("user_id", "day", "n", "place")


@query("WITH h AS (SELECT o_custkey, year(o_orderdate) >= 1996 AS late, sha1(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS h FROM orders GROUP BY 1, 2) SELECT a.o_custkey, b.h AS old_hash, a.h AS hash FROM h a JOIN h b ON a.o_custkey = b.o_custkey AND a.late AND NOT b.late AND a.h <> b.h")
def hash_change_detection(spark, sf):
    h = lambda late: _t(spark, sf, "orders").filter((F.year("o_orderdate") >= 1996) == late).groupBy("o_custkey").agg(F.sha1(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",")).alias("hash"))
    return history.changed_hashes(h(True), h(False), ["o_custkey"], "hash").select("o_custkey", "old_hash", "hash")


@query("SELECT coalesce(a.k, b.k) AS o_orderpriority, coalesce(a.n, 0) AS \"before\", coalesce(b.n, 0) AS \"after\" FROM (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) b ON a.k = b.k")
def fix_multiset_check(spark, sf):
    o = _t(spark, sf, "orders")
    return history.fix_check(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'F'"), "o_orderpriority")


# --- dependencies


WORDS_SQL = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part"


@query(f"WITH w AS ({WORDS_SQL}), p AS (SELECT name, row_number() OVER (ORDER BY name)::INTEGER AS ord FROM w), n AS (SELECT substr(name, 1, 2) || substr(name, 4) AS name FROM w UNION SELECT name || 's' FROM w UNION SELECT 'x' || substr(name, 2) FROM w EXCEPT SELECT name FROM w) SELECT n.name, arg_min(p.name, p.ord) AS target FROM n JOIN p ON levenshtein(n.name, p.name) = 1 GROUP BY n.name")
def typosquat_pairs(spark, sf):
    w = _t(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    popular = w.select("name", F.row_number().over(Window.orderBy("name")).alias("ord"))  # a word list
    made = w.select(F.concat(F.substring("name", 1, 2), F.substring("name", 4, 100)).alias("name")).union(w.select(F.concat("name", F.lit("s")))).union(w.select(F.concat(F.lit("x"), F.substring("name", 2, 100))))
    return deps.typosquats(made, popular)


ADVISORIES = [("Brand#13", "A-1", ">=1.2.0, <3.0.0", "high", "A", "CVE-1"), ("Brand#13", "A-2", "<1.0.5", "medium", "R,N", "CVE-2"), ("Brand#5", "A-3", ">=4.0.0", "critical", "", "cve-3"), ("Brand#22", "A-4", "<=2.5.1", "low", "N", None)]
EXPLOITED = [("cve-1",), ("CVE-3",)]


def _advisories(spark):
    df = spark.createDataFrame(ADVISORIES, "package string, id string, vulnerable_range string, severity string, s string, cve string")
    return df.withColumn("symbols", F.filter(F.split("s", ","), lambda x: x != "")).drop("s")


def _parts_as_deps(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("name"), F.concat(F.lit("^"), F.col("p_partkey") % 5, F.lit("."), F.col("p_size") % 10, F.lit("."), F.col("p_partkey") % 7).alias("declared"))


V_SQL = "SELECT p_partkey, p_brand AS name, (p_partkey % 5) * 10000 + (p_size % 10) * 100 + p_partkey % 7 AS v FROM part"
A_SQL = _values([("Brand#13", "A-1", 10200, 29999, "high", "CVE-1", "A"), ("Brand#13", "A-2", 0, 10004, "medium", "CVE-2", "R,N"), ("Brand#5", "A-3", 40000, 999999, "critical", "CVE-3", ""), ("Brand#22", "A-4", 0, 20501, "low", None, "N")], "package, id, lo, hi, severity, cve, symbols")


@query(f"SELECT p_partkey, name, id, CASE WHEN cve IN ('CVE-1', 'CVE-3') THEN 'critical' ELSE severity END AS severity, coalesce(cve IN ('CVE-1', 'CVE-3'), false) AS kev FROM ({V_SQL}) JOIN {A_SQL} ON name = package AND p_partkey IS NOT NULL AND v BETWEEN lo AND hi")
def version_range_join(spark, sf):
    found = deps.known_vulnerabilities(_parts_as_deps(spark, sf), _advisories(spark), spark.createDataFrame(EXPLOITED, "cve string"))
    return found.select("p_partkey", "name", "id", "severity", "kev")


@query("SELECT name, version, bool_and(dev) AS dev, 'pkg:npm/' || replace(name, '@', '%40') || '@' || version AS purl FROM (SELECT '@' || lower(p_type) || '/' || replace(p_name, ' ', '-') AS name, (p_size % 4)::VARCHAR || '.0.0' AS version, p_partkey % 3 = 0 AS dev FROM part) GROUP BY name, version")
def sbom_components(spark, sf):
    p = _t(spark, sf, "part").select(F.concat(F.lit("node_modules/x/node_modules/@"), F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("path"), F.concat((F.col("p_size") % 4).cast("string"), F.lit(".0.0")).alias("version"), (F.col("p_partkey") % 3 == 0).alias("dev"))
    return deps.components(p)


@query("SELECT p_partkey, (p_partkey % 5) * 10000 + (p_size % 10) * 100 + p_partkey % 7 AS ordinal, (p_partkey % 5) * 10000 + (p_size % 10) * 100 + p_partkey % 7 BETWEEN 10200 AND 29999 AS hit FROM part")
def version_parse(spark, sf):
    d = _parts_as_deps(spark, sf).withColumn("v", version(F.col("declared")))
    return d.select("p_partkey", (F.col("v.major") * 10000 + F.col("v.minor") * 100 + F.col("v.patch")).cast("long").alias("ordinal"), within(F.col("v"), bounds(F.lit(">=1.2.0, <3.0.0"))).alias("hit"))


# --- graph


def _edges(spark, sf):
    r, n, c, s = (_t(spark, sf, t) for t in ("region", "nation", "customer", "supplier"))
    e = n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    e = e.union(c.select(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey"))).union(s.select(F.concat(F.lit("c"), F.col("s_suppkey") * 3), F.concat(F.lit("s"), "s_suppkey")))
    entries = r.filter("r_regionkey < 3").select(F.concat(F.lit("r"), "r_regionkey").alias("rel"), F.when(F.col("r_regionkey") == 0, "server").otherwise("client").alias("kind"))
    return e.union(s.select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"))), entries


EDGES_SQL = "e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || s_suppkey * 3, 's' || s_suppkey FROM supplier UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


@query(
    f"WITH RECURSIVE {EDGES_SQL}, b(rel, kind, hops) AS (SELECT 'r' || r_regionkey, CASE r_regionkey WHEN 0 THEN 'server' ELSE 'client' END, 0 FROM region WHERE r_regionkey < 3 UNION SELECT e.dst, b.kind, b.hops + 1 FROM b JOIN e ON e.src = b.rel WHERE b.hops < 60), "
    "m AS (SELECT rel, kind, min(hops)::INTEGER AS hops FROM b GROUP BY rel, kind) SELECT rel, max(kind) AS kind, arg_max(hops, kind) AS hops FROM m GROUP BY rel"
)
def reachability_bfs(spark, sf):
    edges, entries = _edges(spark, sf)
    return graph.reach(entries, edges).select("rel", "kind", "hops")


# --- text functions


@query("SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS query FROM pages".replace("\\\\", "\\"))
def url_parse(spark, sf):
    return _t(spark, sf, "pages").withColumn("u", tx.url_parts(F.col("url"))).select("page_id", "u.scheme", "u.host", "u.query")


@query("WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS c FROM part), n AS (SELECT p_partkey, c, count(*) AS k, sum(count(*)) OVER (PARTITION BY p_partkey) AS n FROM c WHERE c <> '' GROUP BY p_partkey, c) SELECT p_partkey, round(-sum(k / n * log2(k / n)), 6) AS bits FROM n GROUP BY p_partkey")
def entropy_tokens(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", F.round(tx.entropy(F.col("p_name")), 6).alias("bits"))


def _redact_sql(text: str) -> str:
    for pattern, mark in tx.REDACTIONS:
        text = f"regexp_replace({text}, {_q(pattern)}, {_q(mark.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')"
    return text


@query(f"SELECT doc_id, sha1({_redact_sql('text')}) AS redacted_sha1 FROM documents")
def redact_text(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.sha1(tx.redacted(F.col("text"))).alias("redacted_sha1"))


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, {_q(p)})) AS m{k}" for k, (p, _) in enumerate(tx.REDACTIONS) if k) + " FROM documents")
def pii_masks(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", *[F.regexp_count("text", F.lit(p)).cast("long").alias(f"m{k}") for k, (p, _) in enumerate(tx.REDACTIONS) if k])


NAMES = "CASE p_partkey % 6 WHEN 0 THEN 'userPassword' WHEN 1 THEN 'api_key_' || p_size WHEN 2 THEN 'secretary' WHEN 3 THEN 'accessKeyId' WHEN 4 THEN 'cardNumber' ELSE 'monkey' || p_size END"


@query(f"SELECT p_partkey, {NAMES} AS name, p_partkey % 6 IN (0, 1, 3, 4) AS sensitive FROM part")
def sensitive_names(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", F.expr(NAMES).alias("name")).withColumn("sensitive", tx.sensitive_name(F.col("name")))


# --- paths: orders as findings of our rules, customers as entry points


IDS = (
    "ai.endpoint-no-auth", "sqli.template-literal", "xss.raw-html", "csp.unsafe-inline", "secret.generic", "cors.wildcard-credentials", "react.token-in-web-storage", "deps.known-vulnerability", "dataflow.email", "info-leak.stack", "injection.eval",
    "supply-chain.dependency-install-script", "vite.vite-prefixed-secret", "vite.dev-server-cors-wildcard", "react.ref-inner-html",
)
ID_SQL = choice("o_orderkey", list(IDS))
FILE_SQL = "CASE WHEN o_orderkey % 17 = 0 THEN 'src/x.test.' ELSE 'src/' END || CAST(o_custkey AS STRING)"
KIND_SQL, VEX_SQL = choice("o_orderkey", ["server", "client", "project", None]), choice("o_orderkey", ["exploitable", "not_affected", None, None, None])
O_SQL = (
    f"o AS (SELECT o_orderkey::VARCHAR AS fingerprint, {ID_SQL} AS rule_id, {SEV_OF_ORDER} AS severity, o_custkey AS c, {FILE_SQL.replace('STRING', 'VARCHAR')} AS file, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 7 <> 0 END AS reachable, {KIND_SQL} AS reach_kind, o_orderkey % 13 = 0 AS kev, (o_orderkey % 110) / 100.0 AS epss, "
    f"CASE o_orderkey % 2 WHEN 0 THEN 'high' ELSE 'low' END AS confidence, {VEX_SQL} AS vex_state, CASE WHEN o_orderkey % 23 = 0 THEN 2 END AS taint_steps FROM orders)"
)
# What the rules ask of a finding: alive unless proven dead, on a server if proven reachable from one or from the project, not of tests.
FACTS_SQL = f"r AS (SELECT *, {RANK_SQL} AS rank, coalesce(reachable, true) AS live, coalesce(reachable, false) AS proven, coalesce(reachable AND reach_kind IN ('server', 'project'), false) AS srv, coalesce(reachable AND reach_kind = 'client', false) AS cli, o_test AS test FROM (SELECT *, contains(file, '.test.') AS o_test FROM o))"


def _orders_as_findings(spark, sf):
    k = F.col("o_orderkey")
    return _t(spark, sf, "orders").select(
        k.cast("string").alias("fingerprint"), F.expr(ID_SQL).alias("rule_id"), F.expr(SEV_OF_ORDER).alias("severity"), F.expr(FILE_SQL).alias("file"), F.lit(1).alias("line"), F.when(k % 5 != 0, k % 7 != 0).alias("reachable"), F.expr(KIND_SQL).alias("reach_kind"),
        F.col("o_custkey").cast("string").alias("reach_entrypoint"), (k % 13 == 0).alias("kev"), ((k % 110) / 100.0).alias("epss"), F.when(k % 2 == 0, "high").otherwise("low").alias("confidence"), F.expr(VEX_SQL).alias("vex_state"), F.when(k % 23 == 0, 2).alias("taint_steps"),
        F.array(F.concat(F.lit("T"), k % 3), F.lit("T9")).alias("attack"), "o_custkey",
    )


def _role_sql(role: str, column: str = "rule_id") -> str:
    tests = [f"{column} IN ({', '.join(map(_q, paths.ROLE_IDS[role]))})"] if role in paths.ROLE_IDS else []
    return "(" + " OR ".join(tests + [f"starts_with({column}, {_q(s)})" for s in paths.ROLE_STARTS.get(role, ())]) + ")"


@query(f"WITH {O_SQL} " + " UNION ALL ".join(f"SELECT {_q(r)} AS role, count(*) AS n FROM o WHERE {_role_sql(r)} HAVING count(*) > 0" for r in paths.ROLES))
def roles(spark, sf):
    return _orders_as_findings(spark, sf).select(F.explode(paths.roles(F.col("rule_id"))).alias("role")).groupBy("role").agg(F.count("*").alias("n"))


DOOR_SINK = (
    f"d AS (SELECT c, fingerprint, file FROM r WHERE {_role_sql('open_door')} AND live QUALIFY row_number() OVER (PARTITION BY c ORDER BY rank DESC, file, fingerprint) = 1), s AS (SELECT c, fingerprint FROM r WHERE {_role_sql('code_exec')} AND live QUALIFY row_number() OVER (PARTITION BY c ORDER BY rank DESC, proven DESC, file, fingerprint) = 1)"
)


@query(f"WITH {O_SQL}, {FACTS_SQL}, {DOOR_SINK} SELECT d.c AS o_custkey, d.fingerprint AS door, s.fingerprint AS sink FROM d JOIN s ON d.c = s.c")
def door_sink_join(spark, sf):
    f = _orders_as_findings(spark, sf).filter(paths.live())
    door, sink = paths._first(f.filter(paths.has_role(F.col("rule_id"), "open_door")), ["o_custkey"], "door"), paths._argmax(f.filter(paths.has_role(F.col("rule_id"), "code_exec")), ["o_custkey"], "sink")
    return door.join(sink, F.col("door_o_custkey") == F.col("sink_o_custkey")).select(F.col("door_o_custkey").alias("o_custkey"), "door", "sink")


@query(f"WITH {O_SQL}, {FACTS_SQL}, b AS (SELECT fingerprint FROM r WHERE {_role_sql('browser_exec')} AND live AND NOT srv ORDER BY rank DESC, proven DESC, file, fingerprint LIMIT 1), w AS (SELECT fingerprint FROM r WHERE {_role_sql('weak_csp')} ORDER BY rank DESC, proven DESC, file, fingerprint LIMIT 1) SELECT b.fingerprint AS a, w.fingerprint AS b FROM b, w")
def argmax_cross(spark, sf):
    f = paths.candidate_paths(_orders_as_findings(spark, sf)).filter("template = 'xss-unleashed'")
    return f.select(F.col("fingerprints")[0].alias("a"), F.col("fingerprints")[1].alias("b"))


def _best_sql(which: str) -> str:
    return f"(SELECT fingerprint FROM r WHERE {which} ORDER BY rank DESC, proven DESC, file, fingerprint LIMIT 1)"


def _two_sql(template: str, a: str, b: str) -> str:
    return f"SELECT '{template}' AS template, [a.fingerprint, b.fingerprint] AS fps FROM {_best_sql(a)} a, {_best_sql(b)} b"


def _one_sql(template: str, which: str) -> str:
    most = paths.TEMPLATE_CAPS.get(template)
    rows = f"SELECT '{template}' AS template, [fingerprint] AS fps FROM r WHERE {which}"
    return f"(SELECT * FROM ({rows} ORDER BY rank DESC, file, fingerprint LIMIT {most}))" if most else rows


PUBLIC_SQL = ", ".join(map(_q, paths.PUBLIC_SECRETS))
# The rule of each template, written out.
TEMPLATES_SQL = f"{O_SQL}, {FACTS_SQL}, {DOOR_SINK}, cand AS (" + " UNION ALL ".join([
    _one_sql("taint-flow", "taint_steps > 0 AND live AND NOT starts_with(rule_id, 'dataflow.')"),
    "(SELECT 'unauth-exec' AS template, [d.fingerprint, s.fingerprint] AS fps FROM d JOIN s ON d.c = s.c ORDER BY d.c::VARCHAR LIMIT 4)",
    _two_sql("xss-unleashed", f"{_role_sql('browser_exec')} AND live AND NOT srv", _role_sql("weak_csp")),
    _two_sql("secret-pivot", f"{_role_sql('code_exec')} AND srv AND NOT test", f"{_role_sql('secret')} AND live AND NOT test AND rule_id NOT IN ({PUBLIC_SQL})"),
    _two_sql("cors-token-theft", f"{_role_sql('open_cors')} AND rule_id <> 'vite.dev-server-cors-wildcard'", _role_sql("token_store")),
    _one_sql("exploited-dependency", f"{_role_sql('vuln_dep')} AND (kev OR proven OR coalesce(vex_state = 'exploitable', false))"),
    _one_sql("supply-chain", f"{_role_sql('supply_foothold')} AND rank >= 3"),
    _one_sql("data-egress", f"{_role_sql('sensitive_egress')} AND taint_steps > 0 AND live"),
]) + ")"


@query(f"WITH {TEMPLATES_SQL} SELECT template, array_to_string(fps, ',') AS fingerprints FROM cand")
def path_templates(spark, sf):
    return paths.candidate_paths(_orders_as_findings(spark, sf)).select("template", F.array_join("fingerprints", ",").alias("fingerprints"))


STEP_ROWS = [(t, n, which, tactic, paths.TACTICS.index(tactic), n == cut) for t, (steps, cut) in paths.STEPS.items() for n, (which, tactic) in enumerate(steps)]


@query(
    f"WITH {TEMPLATES_SQL}, e AS (SELECT template || ':' || array_to_string(fps, ',') AS path_key, fps, v.* FROM cand JOIN {_values([(*r[:5], int(r[5])) for r in STEP_ROWS], 't, n, which, tactic, stage, cut')} ON v.t = template), "
    "tech AS (SELECT template || ':' || array_to_string(fps, ',') AS path_key, 'T' || (fps[1]::BIGINT % 3) || ',T9' || CASE WHEN len(fps) = 2 AND fps[1]::BIGINT % 3 <> fps[2]::BIGINT % 3 THEN ',T' || (fps[2]::BIGINT % 3) ELSE '' END AS techniques FROM cand) "
    "SELECT e.path_key, e.t AS kind, row_number() OVER (PARTITION BY e.path_key ORDER BY e.stage, e.n)::INTEGER AS step, e.tactic, r.rule_id, r.file, r.fingerprint, e.cut = 1 AS breaks, tech.techniques FROM e JOIN r ON r.fingerprint = fps[e.which + 1] JOIN tech ON tech.path_key = e.path_key"
)
def path_steps(spark, sf):
    f = _orders_as_findings(spark, sf)
    made = paths.candidate_paths(f).withColumn("path_key", F.concat_ws(":", "template", F.array_join("fingerprints", ",")))
    return paths.path_steps(made, f).withColumn("techniques", F.array_join("techniques", ",")).drop("line")


@query(
    f"WITH {O_SQL}, {FACTS_SQL}, p AS (SELECT c, max(rank) AS worst, bool_or(srv) AS server, bool_or(cli) AS client, bool_and(NOT live) AS dead, bool_or(kev) AS kev, max(epss) AS epss, bool_or({_role_sql('secret')} AND rule_id NOT IN ({PUBLIC_SQL})) AS secret, count(DISTINCT fingerprint) AS n, bool_and(confidence = 'high') AS high FROM r GROUP BY c), "
    "s AS (SELECT c, worst, n, (CASE worst WHEN 0 THEN 8 WHEN 1 THEN 18 WHEN 2 THEN 34 WHEN 3 THEN 50 ELSE 62 END + CASE WHEN server THEN 16 WHEN client THEN 6 ELSE 0 END + CASE WHEN dead THEN -22 ELSE 0 END + CASE WHEN kev THEN 20 ELSE 0 END + round_even(15 * least(1.0, epss), 0)::INTEGER + 8 + CASE WHEN secret THEN 8 ELSE 0 END + CASE WHEN n >= 2 THEN least(12, 4 * n) + CASE WHEN high THEN 4 ELSE 0 END ELSE 0 END) AS total FROM p), "
    "t AS (SELECT c AS o_custkey, n::INTEGER AS n, least(greatest(0, least(100, total)), CASE worst WHEN 0 THEN 39 WHEN 1 THEN 59 WHEN 2 THEN 79 ELSE 100 END)::INTEGER AS score FROM s) SELECT *, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS band FROM t"
)
def path_scores(spark, sf):
    f = _orders_as_findings(spark, sf)
    made = f.groupBy("o_custkey").agg(F.array_sort(F.collect_set("fingerprint")).alias("fingerprints")).select(F.col("o_custkey").cast("string").alias("template"), F.lit(True).alias("impact"), "fingerprints")
    return paths.scored_paths(made, f).select(F.col("template").cast("long").alias("o_custkey"), "n", "score", "band")


# Paths that overlap: a customer's even orders, those of a number divisible by 3, and by 6.
@query(
    "WITH m AS (SELECT o_custkey::VARCHAR AS project, d, list(o_orderkey::VARCHAR ORDER BY o_orderkey::VARCHAR) AS fps FROM orders JOIN (VALUES (2), (3), (6)) AS v(d) ON o_orderkey % d = 0 GROUP BY 1, 2), k AS (SELECT *, 'd' || d || ':' || array_to_string(fps, ',') AS path_key, (3 * len(fps))::INTEGER AS score, row_number() OVER (PARTITION BY project ORDER BY len(fps) DESC, 'd' || d || ':' || array_to_string(fps, ',')) AS place FROM m) "
    "SELECT project, 'path-' || row_number() OVER (PARTITION BY project ORDER BY place) AS path_id, path_key, score FROM k p WHERE NOT EXISTS (SELECT 1 FROM k q WHERE q.project = p.project AND q.place < p.place AND list_has_all(q.fps, p.fps))"
)
def subset_suppression(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.explode(F.array(F.lit(2), F.lit(3), F.lit(6))).alias("d")).filter("o_orderkey % d = 0")
    made = o.groupBy("o_custkey", "d").agg(F.array_sort(F.collect_set(F.col("o_orderkey").cast("string"))).alias("fingerprints"))
    made = made.select(F.col("o_custkey").cast("string").alias("project"), F.concat(F.lit("d"), "d", F.lit(":"), F.array_join("fingerprints", ",")).alias("path_key"), "fingerprints", (F.size("fingerprints") * 3).alias("score"), F.size("fingerprints").alias("n"))
    return paths.suppressed(made, "project").select("project", "path_id", "path_key", "score")


@query(
    f"WITH {O_SQL}, p AS (SELECT c, fingerprint, row_number() OVER (PARTITION BY c ORDER BY fingerprint::BIGINT) AS i, lead(rule_id) OVER w AS next_rule, rule_id FROM o WINDOW w AS (PARTITION BY c ORDER BY fingerprint::BIGINT)) SELECT rule_id, next_rule, count(*) AS n FROM p WHERE next_rule IS NOT NULL GROUP BY ALL"
)
def chain_edges_lead(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.col("fingerprint").cast("long"))
    f = _orders_as_findings(spark, sf).withColumn("next_rule", F.lead("rule_id").over(w))
    return f.filter("next_rule IS NOT NULL").groupBy("rule_id", "next_rule").agg(F.count("*").alias("n"))


def _has_sql(side: str, *roles_: str) -> str:
    return "(" + " OR ".join(_role_sql(r, f"{side}.rule_id") for r in roles_) + ")"


def _held_secret(side: str) -> str:
    return f"({_has_sql(side, 'secret')} AND {side}.rule_id NOT IN ({PUBLIC_SQL}) AND {side}.live AND NOT {side}.test)"


# Why an attacker gets from a step to the next, in the order in which reasons count.
WHY_SQL = (
    f"CASE WHEN NOT (a.live AND b.live) THEN NULL WHEN {_has_sql('a', 'open_door')} AND {_has_sql('b', 'code_exec', 'browser_exec')} AND b.proven THEN 'open-door' WHEN {_has_sql('a', 'code_exec')} AND a.srv AND {_held_secret('b')} THEN 'server-reads-secret' WHEN {_has_sql('a', 'vuln_dep')} AND a.proven AND {_held_secret('b')} THEN 'dependency-reads-secret' "
    f"WHEN {_has_sql('a', 'weak_csp', 'open_cors')} AND {_has_sql('b', 'browser_exec', 'token_store', 'data_leak')} AND b.proven THEN 'missing-control' WHEN {_has_sql('a', 'browser_exec')} AND {_has_sql('b', 'token_store', 'data_leak', 'sensitive_egress')} AND b.proven THEN 'script-reads-data' WHEN {_held_secret('a')} AND {_has_sql('b', 'sensitive_egress', 'data_leak')} THEN 'secret-carried-out' END"
)


@query(
    f"WITH {O_SQL}, {FACTS_SQL}, w AS (SELECT c, fingerprint AS f1, lead(fingerprint, 1) OVER x AS f2, lead(fingerprint, 2) OVER x AS f3 FROM o WINDOW x AS (PARTITION BY c ORDER BY fingerprint::BIGINT)), g AS (SELECT w.*, {WHY_SQL} AS w1, a.rule_id AS i1, b.rule_id AS i2 FROM w JOIN r a ON a.fingerprint = w.f1 JOIN r b ON b.fingerprint = w.f2), "
    f"h AS (SELECT g.*, {WHY_SQL} AS w2, b.rule_id AS i3 FROM g LEFT JOIN r a ON a.fingerprint = g.f2 LEFT JOIN r b ON b.fingerprint = g.f3), k AS (SELECT c || ':' || f1 || ':2' AS chain_id, 2 AS n, w1 AS reasons, [i1, i2] AS ids FROM h WHERE w1 IS NOT NULL UNION ALL SELECT c || ':' || f1 || ':3', CASE WHEN f3 IS NULL THEN 2 ELSE 3 END, w1 || CASE WHEN f3 IS NULL THEN '' ELSE ',' || w2 END, [i1, i2] || CASE WHEN f3 IS NULL THEN [] ELSE [i3] END FROM h WHERE w1 IS NOT NULL AND (f3 IS NULL OR w2 IS NOT NULL)) "
    f"SELECT chain_id, n::BIGINT AS n, reasons FROM k WHERE len(list_filter(ids, lambda z: {' OR '.join(_role_sql(r, 'z') for r in paths.IMPACT_ROLES)})) > 0"
)
def verified_chains(spark, sf):
    f = _orders_as_findings(spark, sf)
    # Proposed: each finding of a customer with the next one, and with the next two.
    w = Window.partitionBy("o_custkey").orderBy(F.col("fingerprint").cast("long"))
    runs = f.select("o_custkey", "fingerprint", F.array_compact(F.array("fingerprint", *[F.lead("fingerprint", k).over(w) for k in (1, 2)])).alias("run")).withColumn("steps", F.explode(F.array(F.lit(2), F.lit(3))))
    chains = runs.select(F.concat_ws(":", "o_custkey", "fingerprint", "steps").alias("chain_id"), F.posexplode(F.slice("run", F.lit(1), F.col("steps"))).alias("ord", "fingerprint"))
    return paths.verified_chains(chains, f).withColumn("reasons", F.array_join("reasons", ","))


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user' AND regexp_matches(text, '(?i)(ignore|the).{0,20}(instructions|and)')) AS suspicious, count(*) FILTER (role = 'system' AND turn > 0) AS late_system FROM conversations GROUP BY conv_id")
def role_prompt_scan(spark, sf):
    c = _t(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if((F.col("role") == "user") & F.col("text").rlike("(?i)(ignore|the).{0,20}(instructions|and)")).alias("suspicious"), F.count_if((F.col("role") == "system") & (F.col("turn") > 0)).alias("late_system"))


# --- logs


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS hits FROM events")
def burst_range_count(spark, sf):
    return logs.sliding_counts(_t(spark, sf, "events"), ["user_id"], "ts", 86_400).select("event_id", "user_id", "hits")


@query(
    "WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events), c AS (SELECT user_id, event_id, us, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY user_id, us ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hits FROM e), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM c WHERE hits > 5), a AS (SELECT user_id, event_id, us, hits, i FROM o WHERE i = 1 UNION ALL SELECT n.user_id, n.event_id, n.us, n.hits, n.i FROM a JOIN o n ON n.user_id = a.user_id AND n.i = (SELECT min(m.i) FROM o m WHERE m.user_id = a.user_id AND m.i > a.i AND m.us >= a.us + 86400000000)) "
    "SELECT user_id, event_id, us, hits::BIGINT AS hits FROM a"
)
def burst_cooldown(spark, sf):
    found = logs.burst_alerts(_t(spark, sf, "events"), ["user_id"], "ts", 86_400, F.lit(5), "event_id")
    return found.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "hits")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def once_per_source(spark, sf):
    return deps.duplicates_first(_t(spark, sf, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


EVENT_PATH = "CASE event_type WHEN 'error' THEN '/a/../../etc/passwd' WHEN 'signup' THEN '/signup?q=<script>alert(1)</script>' ELSE '/' || event_type END"
EVENT_UA = "CASE user_id % 4 WHEN 0 THEN 'curl/8.0' WHEN 1 THEN 'sqlmap/1.7' ELSE 'Mozilla/5.0' END"


def _events_as_log(spark, sf):
    e = _t(spark, sf, "events")
    return e.select("event_id", F.col("ts").alias("at"), F.when(F.col("user_id") % 10 == 0, "c2").otherwise("shop").alias("svc"), F.col("user_id").cast("string").alias("ip"), F.expr(EVENT_PATH).alias("path"), F.lit(None).cast("string").alias("query"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.expr(EVENT_UA).alias("ua"), F.lit(None).cast("string").alias("body"))


LOG_SQL = (
    "a AS (SELECT 'path-traversal' AS rule, event_id, user_id, ts, event_type, '../' AS evidence FROM events WHERE event_type = 'error' UNION ALL SELECT 'verbose-error', event_id, user_id, ts, event_type, 'status 500' FROM events WHERE event_type = 'error' UNION ALL SELECT 'reflected-xss', event_id, user_id, ts, event_type, '<script' FROM events WHERE event_type = 'signup' "
    "UNION ALL SELECT 'automated-client-ua', event_id, user_id, ts, event_type, 'curl/' FROM events WHERE user_id % 4 = 0 UNION ALL SELECT 'scanner-tooling-ua', event_id, user_id, ts, event_type, 'sqlmap' FROM events WHERE user_id % 4 = 1 UNION ALL SELECT 'exfiltration-to-c2', event_id, user_id, ts, event_type, 'c2' FROM events WHERE user_id % 10 = 0)"
)


@query(f"WITH {LOG_SQL} SELECT rule, event_id, evidence FROM a")
def log_rule_fanout(spark, sf):
    return logs.stateless_alerts(_events_as_log(spark, sf)).select("rule", "event_id", "evidence")


@query(f"WITH {LOG_SQL}, o AS (SELECT * FROM a WHERE rule <> 'automated-client-ua' UNION ALL (SELECT * FROM a WHERE rule = 'automated-client-ua' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts) = 1)) SELECT rule, count(*) AS n FROM o GROUP BY rule")
def alerts_by_rule(spark, sf):
    return logs.once_per_source(logs.stateless_alerts(_events_as_log(spark, sf))).groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END = 1) AS malformed, sum(CASE WHEN event_id % 10 <> 0 THEN (props->>'k')::BIGINT END)::BIGINT AS k FROM events GROUP BY event_type")
def malformed_json_count(spark, sf):
    e = _t(spark, sf, "events").withColumn("raw", F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")))
    e = e.withColumn("j", F.from_json("raw", "k long, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("j._corrupt_record").isNotNull()).alias("malformed"), F.sum(F.when(F.col("j._corrupt_record").isNull(), F.col("j.k"))).alias("k"))


@query(f"WITH {LOG_SQL}, t AS (SELECT rule, technique FROM {_values([(r, t) for r, _, t in logs.LOG_RULES], 'rule, technique')}) SELECT t.technique, bool_or(a.rule IS NOT NULL) AS detected, bool_or(p.technique_id IS NOT NULL) AS predicted FROM t LEFT JOIN (SELECT DISTINCT rule FROM a) a ON a.rule = t.rule LEFT JOIN {_values(TECHNIQUES, 'technique_id, tactic').replace('AS v(', 'AS p(')} ON p.technique_id = t.technique OR p.technique_id = string_split(t.technique, '.')[1] GROUP BY t.technique")
def scorecard_flags(spark, sf):
    rules = spark.createDataFrame([(r, t) for r, _, t in logs.LOG_RULES], "rule string, technique string")
    fired = logs.stateless_alerts(_events_as_log(spark, sf)).select("rule").distinct().withColumn("fired", F.lit(True))
    own = rules.join(F.broadcast(fired), "rule", "left").select("technique", F.coalesce("fired", F.lit(False)).alias("fired"), F.explode(F.array_distinct(F.array("technique", F.element_at(F.split("technique", r"\."), 1)))).alias("technique_id"))
    known = techniques(spark).select("technique_id", F.lit(True).alias("known"))
    return own.join(F.broadcast(known), "technique_id", "left").groupBy("technique").agg(F.bool_or("fired").alias("detected"), F.bool_or(F.coalesce("known", F.lit(False))).alias("predicted"))


# --- reports


@query(f"{F_SQL} SELECT fingerprint, rule_id, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, file AS uri, line AS start_line, \"column\" AS start_column, code_snippet AS message FROM f")
def sarif_rows(spark, sf):
    """Results read back from their JSON."""
    shape = "ruleId string, level string, message struct<text:string>, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>>>, partialFingerprints struct<primary:string>"
    r = reports.sarif_results(_found(spark, sf)).select(F.from_json("value", shape).alias("r")).select("r.*").withColumn("p", F.col("locations")[0]["physicalLocation"])
    return r.select(F.col("partialFingerprints.primary").alias("fingerprint"), F.col("ruleId").alias("rule_id"), "level", F.col("p.artifactLocation.uri").alias("uri"), F.col("p.region.startLine").alias("start_line"), F.col("p.region.startColumn").alias("start_column"), F.col("message.text").alias("message"))


@query(SQL["sbom_components"].replace("SELECT name, version, bool_and(dev) AS dev, ", "SELECT 'library' AS type, name, version, CASE WHEN bool_and(dev) THEN 'optional' ELSE 'required' END AS scope, "))
def cyclonedx_rows(spark, sf):
    """Components read back from their JSON."""
    made = reports.cyclonedx_components(sbom_components(spark, sf))
    return made.select(F.from_json("value", "type string, name string, version string, scope string, purl string").alias("c")).select("c.*")


@query(f"WITH {O_SQL} SELECT fingerprint, rule_id, CASE coalesce(severity, 'medium') WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, file AS uri FROM o")
def sarif_document(spark, sf):
    """Every order as a finding; results read back from the lines of the whole document."""
    found = _orders_as_findings(spark, sf).withColumns({"column": F.lit(1), "code_snippet": F.col("fingerprint")})
    results = reports.sarif(found).filter(F.col("value").rlike(r'^,?\{"ruleId"')).select(F.from_json(F.ltrim("value", F.lit(",")), "ruleId string, level string, partialFingerprints struct<primary:string>, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>").alias("r"))
    return results.select(F.col("r.partialFingerprints.primary").alias("fingerprint"), F.col("r.ruleId").alias("rule_id"), "r.level", F.col("r.locations")[0]["physicalLocation"]["artifactLocation"]["uri"].alias("uri"))


@query("SELECT 'p' || l_partkey AS name, l_orderkey::VARCHAR AS version, CASE WHEN bool_and(l_linenumber % 2 = 0) THEN 'optional' ELSE 'required' END AS scope, 'pkg:npm/p' || l_partkey || '@' || l_orderkey AS purl FROM lineitem GROUP BY l_partkey, l_orderkey")
def cyclonedx_document(spark, sf):
    """Every line item as a locked package; components read back from the lines of the whole document."""
    locked = _t(spark, sf, "lineitem").select(F.concat(F.lit("node_modules/p"), "l_partkey").alias("path"), F.col("l_orderkey").cast("string").alias("version"), (F.col("l_linenumber") % 2 == 0).alias("dev"))
    lines = reports.cyclonedx(deps.components(locked), "shop").filter(F.col("value").rlike(r'^,?\{"type"'))
    return lines.select(F.from_json(F.ltrim("value", F.lit(",")), "name string, version string, scope string, purl string").alias("c")).select("c.*")


# --- facts and data flow over scripts of pages


def _page_files(spark, sf):
    return _t(spark, sf, "pages").select(F.col("page_id").cast("string").alias("file"), F.col("html").alias("text"))


@query()
def call_argument_facts(spark, sf):
    f = dataflow.facts(_page_files(spark, sf))
    return f.select("file", "kind", "line", "column", "name", "ord", "value", "shape", "scope", F.array_join(F.transform("carried", lambda c: c["label"]), ",").alias("labels"))


from . import flow_queries, inventory_queries, project_queries, upkeep_queries  # noqa: E402,F401  register their queries
