import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from riskweave.operators import deps, findings as fi, graph, history, paths
from riskweave.plans import queries
from riskweave.plans.packs import DIMENSION, WEB_RULES, bridge, dimension
from riskweave.plans.scan import Config, scan


@pytest.fixture(scope="module")
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


FOUND = "fingerprint string, rule_id string, severity string, file string, line int, column int, confidence string, reachable boolean, reach_kind string, reach_entrypoint string, kev boolean, epss double"


def finding(fp, rule, severity="high", file="f", line=1, confidence="high", reachable=True, kind="server", entry="e", kev=False, epss=0.0):
    return (fp, rule, severity, file, line, 1, confidence, reachable, kind, entry, kev, epss)


def test_enrichment_and_counts(spark):
    df = spark.createDataFrame([finding("1", "injection.eval", None), finding("2", "unknown.rule", ""), finding("3", "tls.verification-off", "low")], FOUND)
    out = {r.fingerprint: r for r in fi.enrich(df, dimension(spark)).collect()}
    assert out["1"].severity == "critical" and out["1"].cwe == "CWE-95" and out["2"].title == "unknown.rule" and out["2"].severity == "medium" and out["3"].severity == "low"
    counts = {r.severity: r.n for r in fi.severity_counts(df).collect()}
    assert counts == {"info": 0, "low": 1, "medium": 2, "high": 0, "critical": 0}
    assert fi.gate(df, "high").first().failed is False and fi.gate(df.limit(0), "low").first().failed is False
    tagged = {r.fingerprint: r.attack for r in fi.with_techniques(df, bridge(spark)).collect()}
    assert tagged["1"] == ["T1059.007"] and tagged["2"] == []


def test_later_rule_source_wins(spark):
    a, b = dimension(spark), spark.createDataFrame([("injection.eval", "mine")], "rule_id string, title string")
    rows = {r.rule_id: r.title for r in fi.merged_rules(a, b).collect()}
    assert rows["injection.eval"] == "mine" and len(rows) == len(DIMENSION)


def test_dedup_diff_baseline(spark):
    df = spark.createDataFrame([finding("1", "a", line=3), finding("1", "b", line=1), finding("2", "a", line=0), finding("3", "a", file="g")], FOUND)
    assert {r.fingerprint: r.rule_id for r in fi.first_of_each(df, [F.desc("line")]).collect()} == {"1": "a", "2": "a", "3": "a"}
    changed = spark.createDataFrame([("f", 1)], "file string, line int")
    assert sorted((r.fingerprint, r.rule_id) for r in fi.in_diff(df, changed).collect()) == [("1", "b"), ("2", "a")]
    known = spark.createDataFrame([("1",), ("9",)], "fingerprint string")
    assert {r.fingerprint for r in fi.not_in_baseline(df, known).collect()} == {"2", "3"} and fi.in_baseline(df, known).count() == 2


def test_history(spark):
    a, b = spark.createDataFrame([("1",), ("2",)], "fingerprint string"), spark.createDataFrame([("2",), ("3",)], "fingerprint string")
    assert {r.fingerprint: r.status for r in history.snapshot_diff(a, b).collect()} == {"1": "fixed", "2": "persistent", "3": "new"}
    now = spark.createDataFrame([("p", "x", "h1"), ("q", "x", "h2"), ("r", "x", None)], "package string, script string, h string")
    old = spark.createDataFrame([("p", "x", "h0"), ("q", "x", "h2"), ("r", "x", "h")], "package string, script string, h string")
    assert {r.package for r in history.changed_hashes(now, old, ["package", "script"], "h").collect()} == {"p", "r"}
    assert history.changed_hashes(now, old.limit(0), ["package", "script"], "h").collect() == []
    before = spark.createDataFrame([("a", 1)], "kind string, band_rank int")
    after = spark.createDataFrame([("a", 1), ("a", 2), ("b", 0)], "kind string, band_rank int")
    assert sorted((r.kind, r.band_rank) for r in history.keystones(before, after).collect()) == [("a", 2), ("b", 0)]


def test_imports_are_not_tried_with_every_end(spark):
    """A name meets a file once, by what both say; the order of ends and roots stays."""
    names = ["lib/a", "lib/a.ts", "lib/a/index.ts", "lib/b.jsx", "lib/b/index.ts", "src/c.ts", "c/index.cjs", "src/d/index.mjs", "index.ts"]
    text = "import x from './a'\nimport y from './b'\nimport z from '@/c'\nimport w from '~/d'\nimport v from './a/index'\nimport u from './index'\nimport t from '..'\nimport 'react'"
    files = spark.createDataFrame([(n, "") for n in names] + [("lib/u.ts", text), (None, "import './a'"), ("lib/n.ts", None)], "file string, text string")
    found = graph.edges(files)
    assert sorted((r.src, r.dst) for r in found.collect()) == [("lib/u.ts", d) for d in ("c/index.cjs", "lib/a", "lib/a/index.ts", "lib/b.jsx", "src/d/index.mjs")]
    imports = spark.range(5_000_000).select(F.concat(F.lit("f"), "id").alias("file"), F.lit("./a").alias("spec"))
    assert "BuildLeft" not in graph.resolved(imports.limit(3), imports, ["file", "spec"])._jdf.queryExecution().executedPlan().toString()


def test_dependencies_are_not_sent_out(spark):
    """Spark takes exploded rows for few; the join must not be free to hand all of them to each task."""
    dep = spark.range(3).select(F.concat(F.lit("p"), F.col("id")).alias("name"), F.explode(F.sequence(F.lit(0), F.lit(9)).cast("array<string>")).alias("declared"))
    adv = spark.range(5_000_000).select(F.concat(F.lit("p"), F.col("id")).alias("package"), F.lit("A").alias("id"), F.lit(None).cast("string").alias("cve"), F.lit("<3").alias("vulnerable_range"), F.lit("low").alias("severity"))
    found = deps.known_vulnerabilities(dep, adv)
    assert "BuildLeft" not in found._jdf.queryExecution().executedPlan().toString()
    small = deps.known_vulnerabilities(dep, adv.filter("package IN ('p0', 'p2')").withColumn("vulnerable_range", F.when(F.col("package") == "p2", "<1 || >=8")))
    assert sorted((r.name, r.declared) for r in small.collect()) == [("p2", "0"), ("p2", "8"), ("p2", "9")]


def test_dependencies(spark):
    adv = spark.createDataFrame([("p", "A", "CVE-1", ">=1.0.0, <2.0.0", "high", ["f"]), ("p", "B", "CVE-2", "<1.0.0", "low", []), ("q", "C", None, ">=0.0.1", "medium", ["g"])], "package string, id string, cve string, vulnerable_range string, severity string, symbols array<string>")
    dep = spark.createDataFrame([("p", "^1.5.0"), ("q", "1.0.0"), ("z", "1.0.0")], "name string, declared string")
    usage = spark.createDataFrame([("p", ["f", "h"], ["a.js"], False)], "package string, symbols array<string>, files array<string>, unresolved boolean")
    out = {r.id: r for r in deps.known_vulnerabilities(dep, adv, spark.createDataFrame([("cve-1",)], "cve string"), spark.createDataFrame([("CVE-1", 1.7)], "cve string, p double"), usage).collect()}
    assert out.keys() == {"A", "C"} and out["A"].severity == "critical" and out["A"].epss == 1.0 and out["A"].vex_state == "exploitable"
    assert out["C"].vex_state == "not_affected" and out["C"].severity == "low" and out["C"].vex_reason == "component_not_imported"
    d = spark.createDataFrame([("x", "dependencies", 0, "a", "1"), ("x", "devDependencies", 1, "a", "2")], "project_id string, section string, section_ord int, name string, declared string")
    assert deps.merged_dependencies(d).first().declared == "2"
    specs = spark.createDataFrame([("./a", None), ("@s/p/x", "@s/p"), ("lodash/get", "lodash"), ("", None)], "s string, want string")
    assert all(r.got == r.want for r in specs.withColumn("got", deps.package_root(F.col("s"))).collect())
    s = spark.createDataFrame([("curl http://x | sh", "pipes-download-to-shell"), ("tsc -p .", None), ("node -e 'x'", "evaluates-code")], "c string, want string")
    assert all(r.got == r.want for r in s.withColumn("got", deps.script_danger(F.col("c"))).collect())


def test_typosquats_equal_all_pairs(spark):
    rng = random.Random(0)
    popular = sorted({"".join(rng.choices("abc", k=rng.randint(2, 6))) for _ in range(40)})
    names = sorted({"".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(300)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for n in names:
        hits = [p for p in popular if distance(n, p) == 1]
        if n not in popular and hits:
            want[n] = hits[0]
    got = deps.typosquats(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(list(enumerate(popular)), "ord int, name string"))
    assert {r.name: r.target for r in got.collect()} == want


def test_reach_equals_python(spark, checkpoints):
    rng = random.Random(2)
    nodes = [f"n{i}" for i in range(40)]
    edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(60)}
    entries = [("n0", "server"), ("n1", "client"), ("n2", "client")]

    def bfs(start):
        dist, queue = {s: 0 for s in start}, deque(start)
        while queue:
            a = queue.popleft()
            for x, b in edges:
                if x == a and b not in dist:
                    dist[b] = dist[a] + 1
                    queue.append(b)
        return dist

    server, client = bfs(["n0"]), bfs(["n1", "n2"])
    want = {n: ("client", d) for n, d in client.items()} | {n: ("server", d) for n, d in server.items()}
    got = graph.reach(spark.createDataFrame(entries, "rel string, kind string"), spark.createDataFrame(list(edges), "src string, dst string"))
    assert {r.rel: (r.kind, r.hops) for r in got.collect()} == want
    assert all(len(r.path) == r.hops + 1 and r.path[-1] == r.rel and r.path[0] == r.entrypoint for r in got.collect())


def test_edges(spark):
    files = spark.createDataFrame([("app/page.tsx", "import x from '../lib/a'\nimport '@/lib/b'\nconst y = require('./c')\nimport('lodash')"), ("lib/a.ts", ""), ("lib/b/index.ts", "export * from '../../../out'"), ("app/c.js", ""), ("app/c/index.js", "")], "file string, text string")
    assert sorted((r.src, r.dst) for r in graph.edges(files).collect()) == [("app/page.tsx", "app/c.js"), ("app/page.tsx", "lib/a.ts"), ("app/page.tsx", "lib/b/index.ts")]


def test_paths(spark):
    df = spark.createDataFrame([finding("d", "ai.endpoint-no-auth", entry="r1"), finding("s", "sqli.template-literal", "critical", entry="r1"), finding("k", "secret.generic", entry="r2"), finding("v", "deps.known-vulnerability", "high", kev=True, epss=0.9), finding("z", "sqli.x", reachable=False, entry="r2")], FOUND)
    scored = paths.scored_paths(paths.candidate_paths(df), df)
    got = {r.template: r for r in scored.collect()}
    assert set(got) == {"unauth-exec", "secret-pivot", "exploited-dependency"}
    assert got["unauth-exec"].fingerprints == ["d", "s"] and got["unauth-exec"].score == min(100, 62 + 16 + 8 + 8 + 4)
    assert got["exploited-dependency"].score == min(100, 50 + 16 + 20 + 14 + 8) and got["exploited-dependency"].band == "critical"
    kept = paths.suppressed(scored).collect()
    assert {r.path_id for r in kept} == {f"path-{i + 1}" for i in range(len(kept))}


def test_reach_is_no_cut(spark, checkpoints):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)], "src string, dst string")
    entry = spark.createDataFrame([("n0", "server")], "rel string, kind string")
    assert graph.reach(entry, edges, rounds=6).count() == 7
    with pytest.raises(ValueError):
        graph.reach(entry, edges, rounds=5)
    assert graph.reach(entry.limit(0), edges).collect() == []


def test_suppression_equals_python(spark):
    rng = random.Random(3)
    rows = []
    for project in "abc":
        for i in range(25):
            fps = sorted(rng.sample("uvwxyz", rng.randint(1, 4)))
            rows.append((project, f"t{i % 3}:{','.join(fps)}", fps, rng.randint(0, 5) * 10, len(fps)))
    want = set()
    for project in "abc":
        kept = []
        for r in sorted((r for r in rows if r[0] == project), key=lambda r: (-r[3], -r[4], r[1])):
            if not any(set(r[2]) <= set(k[2]) for k in kept) and len(kept) < 12:
                kept.append(r)
        want |= {(project, k[1], f"path-{i + 1}") for i, k in enumerate(kept)}
    got = paths.suppressed(spark.createDataFrame(rows, "project string, path_key string, fingerprints array<string>, score int, n int"), "project")
    assert {(r.project, r.path_key, r.path_id) for r in got.collect()} == want


def test_suppression_without_groups_keeps_the_best_in_tasks(spark):
    """Paths of one scan are ranked where they lie: only the twelve kept meet in one task."""
    rows = [(f"t:{i}", [f"f{i}"], i, 1) for i in range(40)] + [("t:39", ["f39"], 39, 1), ("u:1", ["f39", "f38"], 50, 2), ("u:2", [], 60, 0)]
    kept = paths.suppressed(spark.createDataFrame(rows, "path_key string, fingerprints array<string>, score int, n int").repartition(3))
    assert [(r.path_id, r.path_key) for r in kept.orderBy(F.length("path_id"), "path_id").collect()] == [("path-1", "u:1")] + [(f"path-{i + 2}", f"t:{37 - i}") for i in range(11)]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 1 and plan.index("row_number()") < plan.index("GlobalLimit")


def test_chains(spark):
    df = spark.createDataFrame([finding("d", "ai.endpoint-no-auth"), finding("s", "sqli.template-literal"), finding("k", "secret.generic"), finding("x", "sqli.other", entry="other")], FOUND)
    chains = spark.createDataFrame([(1, 0, "d"), (1, 1, "s"), (1, 2, "k"), (2, 0, "d"), (2, 1, "x"), (3, 0, "d"), (3, 1, "gone"), (4, 0, "s"), (4, 1, "s"), (4, 2, "k")], "chain_id int, ord int, fingerprint string")
    assert {r.chain_id: r.reasons for r in paths.verified_chains(chains, df).collect()} == {1: ["open-door", "server-reads-secret"], 4: ["server-reads-secret"]}


def test_chain_query_equals_brute_force(spark, sf):
    rows = sorted(queries._orders_as_findings(spark, sf).collect(), key=lambda r: int(r.fingerprint))
    role = lambda r, name: r.rule_id in paths.ROLE_IDS.get(name, ()) or r.rule_id.startswith(tuple(paths.ROLE_STARTS.get(name, ())))

    def why(x, y):
        # A secret that an attacker could reach: not public by design, not of a test, not proven dead.
        held = lambda r: role(r, "secret") and r.rule_id not in paths.PUBLIC_SECRETS and ".test." not in r.file and r.reachable is not False
        secret = held(y)
        if x.reachable is False or y.reachable is False:
            return None
        if role(x, "open_door") and (role(y, "code_exec") or role(y, "browser_exec")) and x.reach_entrypoint == y.reach_entrypoint and y.reachable:
            return "open-door"
        if role(x, "code_exec") and x.reachable and x.reach_kind in ("server", "project") and secret:
            return "server-reads-secret"
        if role(x, "vuln_dep") and x.reachable and secret:
            return "dependency-reads-secret"
        if (role(x, "weak_csp") or role(x, "open_cors")) and any(role(y, r) for r in ("browser_exec", "token_store", "data_leak")) and y.reachable:
            return "missing-control"
        if role(x, "browser_exec") and any(role(y, r) for r in ("token_store", "data_leak", "sensitive_egress")) and y.reachable:
            return "script-reads-data"
        if held(x) and (role(y, "sensitive_egress") or role(y, "data_leak")):
            return "secret-carried-out"
        return None

    want, proposed, customers = {}, 0, {}
    for r in rows:
        customers.setdefault(r.o_custkey, []).append(r)
    for customer, own in customers.items():
        for i, first in enumerate(own):
            for k in (2, 3):
                run, proposed = own[i : i + k], proposed + 1
                reasons = [why(x, y) for x, y in zip(run, run[1:])]
                if len(run) >= 2 and all(reasons) and any(role(x, name) for x in run for name in paths.IMPACT_ROLES):
                    want[f"{customer}:{first.fingerprint}:{k}"] = (len(run), ",".join(reasons))
    got = {r.chain_id: (r.n, r.reasons) for r in queries.verified_chains(spark, sf).collect()}
    assert got == want and 0 < len(want) < proposed
    print(len(rows), proposed, len(want))


def test_scan(spark, checkpoints):
    files = spark.createDataFrame(
        [("app/api/x/route.ts", "ts", "import { run } from '../../../lib/run'\nexport async function POST(r) { return run(r) }"), ("lib/run.ts", "ts", "export const run = (c) => eval(c)"), ("lib/dead.ts", "ts", "eval(z)"), ("scripts/x.js", "js", "eval(a)")], "file string, ext string, text string"
    )
    result = scan(files, Config(rules=tuple(WEB_RULES)))
    rows = {r.file: r for r in result.findings.collect()}
    assert rows["lib/run.ts"].reachable and rows["lib/run.ts"].reach_kind == "server" and rows["lib/run.ts"].severity == "critical"
    assert rows["lib/dead.ts"].reachable is False and rows["scripts/x.js"].severity == "low" and rows["scripts/x.js"].original_severity == "critical"
    assert result.failed.first().failed and sum(r.n for r in result.counts.collect()) == 3
    assert {r.file for r in scan(files, Config(reachable_only=True)).findings.collect()} == {"lib/run.ts"}
    assert scan(files, Config(only=("xss",))).findings.collect() == []
