"""Attack paths: roles of findings, templates that put findings together, scores, bands, suppression, chain checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import severity_name, severity_rank, test_path

# Roles by rule id and by the start of rule ids.
ROLE_IDS = {
    "open_door": ("auth.middleware-bypass", "ai.endpoint-no-auth", "ai-endpoint.unauthenticated-live"),
    "code_exec": ("hardening.insecure-deserialization",),
    "browser_exec": ("react.ref-inner-html", "react.javascript-url", "react.href-user-value", "react.unsanitized-markdown", "dast.reflected-xss", "nextjs.image-dangerously-allow-svg", "ai.llm-output-rendered-as-html", "ai.llm-output-to-sink"),
    "weak_csp": ("csp.unsafe-inline", "csp.unsafe-eval", "csp.disabled-in-helmet", "headers.missing-csp", "config.missing-security-headers"),
    "open_cors": ("cors.wildcard-credentials", "cors.wildcard-with-credentials", "cors.origin-reflection", "cors.permissive-middleware", "nextjs.api-wildcard-cors", "vite.dev-server-cors-wildcard"),
    "secret": ("hardening.env-committed", "hardening.env-not-gitignored", "hardening.dev-only-branch-shipping-secret-bypass", "vite.define-inlines-secret", "vite.import-meta-env-secret", "vite.vite-prefixed-secret", "nextjs.api-env-exposure", "nextjs.props-secret-leak"),
    "data_leak": ("nextjs.error-stack-leak", "nextjs.source-maps-exposed", "vite.prod-sourcemap", "hardening.source-map-shipped-to-prod"),
    "token_store": ("react.token-in-web-storage", "auth.jwt-in-localstorage"),
    "vuln_dep": ("deps.known-vulnerability",),
}
ROLE_STARTS = {
    "code_exec": ("injection.", "sqli.", "nosqli.", "ssrf.", "path-traversal."), "browser_exec": ("xss.", "dom."), "secret": ("secret.", "crypto.hardcoded", "jwt.hardcoded", "session.hardcoded", "auth.hardcoded"),
    "data_leak": ("info-leak.",), "supply_foothold": ("supply-chain.",), "sensitive_egress": ("dataflow.",),
}
PUBLIC_SECRETS = ("vite.vite-prefixed-secret", "vite.import-meta-env-secret", "secret.public-env-exposure", "nextjs.api-env-exposure")
# Tactics in the order of a narrative; scores by the worst severity's rank; the most that rank allows.
TACTICS = ("Reconnaissance", "Resource Development", "Initial Access", "Execution", "Persistence", "Privilege Escalation", "Defense Evasion", "Credential Access", "Discovery", "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact")
BASE_SCORE = (8, 18, 34, 50, 62)
MOST_SCORE = (39, 59, 79, 100, 100)
#: Paths kept at most, and by template.
MOST_PATHS = 12
TEMPLATE_CAPS = {"unauth-exec": 4, "exploited-dependency": 4, "supply-chain": 4, "data-egress": 5}

#: The steps of each template, as (which of the path's findings, tactic), and the step whose fix breaks the chain.
STEPS = {
    "taint-flow": (((0, "Initial Access"), (0, "Execution")), 1),
    "unauth-exec": (((0, "Initial Access"), (1, "Execution"), (1, "Impact")), 0),
    "xss-unleashed": (((0, "Initial Access"), (1, "Defense Evasion"), (0, "Credential Access")), 0),
    "secret-pivot": (((0, "Execution"), (1, "Credential Access"), (1, "Lateral Movement")), 0),
    "cors-token-theft": (((0, "Initial Access"), (1, "Credential Access"), (1, "Exfiltration")), 0),
    "exploited-dependency": (((0, "Initial Access"), (0, "Execution")), 0),
    "supply-chain": (((0, "Initial Access"), (0, "Execution")), 0),
    "data-egress": (((0, "Collection"), (0, "Exfiltration")), 1),
}
#: Fixed value: a setting of a development server, no exposure of what is shipped.
DEV_CORS = "vite.dev-server-cors-wildcard"

ROLES = tuple(sorted({*ROLE_IDS, *ROLE_STARTS}))


def has_role(rule_id: Column, role: str) -> Column:
    tests = [rule_id.isin(*ROLE_IDS[role])] if role in ROLE_IDS else []
    tests += [rule_id.startswith(s) for s in ROLE_STARTS.get(role, ())]
    return reduce(lambda a, b: a | b, tests)


def roles(rule_id: Column) -> Column:
    """All roles of a rule, by name."""
    return F.array_compact(F.array(*[F.when(has_role(rule_id, r), F.lit(r)) for r in ROLES]))


def stage(tactic: Column) -> Column:
    """A tactic's place in the narrative; unknown ones come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in TACTICS]), tactic), F.lit(0)) - 1, F.lit(len(TACTICS)))


def live(f: str = "reachable") -> Column:
    """Not proven dead: reachable, or not analysed."""
    return F.coalesce(F.col(f), F.lit(True))


def on_server() -> Column:
    """Proven reachable from a server's entry point, or of the project as a whole."""
    return F.coalesce(F.col("reachable") & F.col("reach_kind").isin("server", "project"), F.lit(False))


def on_client() -> Column:
    return F.coalesce(F.col("reachable") & (F.col("reach_kind") == "client"), F.lit(False))


def score(worst: Column, bundled: Column, server: Column, client: Column, all_dead: Column, kev: Column, epss: Column, impact: Column, secret: Column, distinct: Column, all_high: Column) -> Column:
    """0 to 100 from aggregates over a path's findings; worst is a severity rank. Halves round to even."""
    total = F.array(*[F.lit(x) for x in BASE_SCORE])[worst]
    total += F.when(bundled, 16).when(server, 16).when(client, 6).otherwise(0)
    total += F.when(all_dead, -22).otherwise(0) + F.when(kev, 20).otherwise(0)
    total += F.bround(15 * F.least(F.greatest(epss, F.lit(0.0)), F.lit(1.0)), 0).cast("int")
    total += F.when(impact, 8).otherwise(0) + F.when(secret, 8).otherwise(0)
    total += F.when(distinct >= 2, F.least(F.lit(12), 4 * distinct) + F.when(all_high, 4).otherwise(0)).otherwise(0)
    return F.least(F.greatest(F.lit(0), F.least(F.lit(100), total)), F.array(*[F.lit(x) for x in MOST_SCORE])[worst]).cast("int")


def band(s: Column) -> Column:
    return F.when(s >= 80, "critical").when(s >= 60, "high").when(s >= 40, "medium").otherwise("low")


def _argmax(findings: DataFrame, by: list[str], tag: str) -> DataFrame:
    """The worst finding for each key, among equals one that is proven reachable, then the first by place."""
    order = F.struct((-severity_rank(F.col("severity"))).alias("r"), (~F.coalesce("reachable", F.lit(False))).alias("d"), "file", "line", "fingerprint")
    return findings.groupBy(*[F.col(c).alias(f"{tag}_{c}") for c in by]).agg(F.min_by("fingerprint", order).alias(tag)).filter(F.col(tag).isNotNull())


def _first(findings: DataFrame, by: list[str], tag: str) -> DataFrame:
    """The worst finding for each key, among equals the first by place."""
    order = F.struct((-severity_rank(F.col("severity"))).alias("r"), "file", "line", "fingerprint")
    return findings.groupBy(*[F.col(c).alias(f"{tag}_{c}") for c in by]).agg(F.min_by("fingerprint", order).alias(tag)).filter(F.col(tag).isNotNull())


def candidate_paths(findings: DataFrame) -> DataFrame:
    """template, impact, fingerprints array<string>: what the eight templates find.

    findings: fingerprint, rule_id, severity, file, line, reachable, reach_kind, reach_entrypoint, kev, and where known
    vex_state and taint_steps (a flow's places; without them no finding is one of data flow). Joins are on the entry
    point, or of one row with one row (the worst finding of a role).
    """
    f = findings
    for name, kind in (("vex_state", "string"), ("taint_steps", "int")):
        if name not in f.columns:
            f = f.withColumn(name, F.lit(None).cast(kind))
    role = lambda r: has_role(F.col("rule_id"), r)
    flows = F.coalesce(F.col("taint_steps") > 0, F.lit(False)) & live()

    def alone(template: str, which: Column) -> DataFrame:
        rows = f.filter(which)
        if template in TEMPLATE_CAPS:
            rows = rows.orderBy(F.desc(severity_rank(F.col("severity"))), "file", "line", "fingerprint").limit(TEMPLATE_CAPS[template])
        return rows.select(F.lit(template).alias("template"), F.array("fingerprint").alias("fingerprints"))

    def both(template: str, which_a: Column, which_b: Column) -> DataFrame:
        one = _argmax(f.filter(which_a), [], "a").crossJoin(F.broadcast(_argmax(f.filter(which_b), [], "b")))  # one row each
        return one.select(F.lit(template).alias("template"), F.array("a", "b").alias("fingerprints"))

    routed = f.filter(F.col("reach_entrypoint").isNotNull() & live())
    doors, sinks = _first(routed.filter(role("open_door")), ["reach_entrypoint"], "door"), _argmax(routed.filter(role("code_exec")), ["reach_entrypoint"], "sink")
    met = doors.join(sinks, F.col("door_reach_entrypoint") == F.col("sink_reach_entrypoint")).orderBy("door_reach_entrypoint").limit(TEMPLATE_CAPS["unauth-exec"])
    shipped = ~test_path(F.col("file"))
    parts = [
        alone("taint-flow", flows & ~F.col("rule_id").startswith("dataflow.")),
        met.select(F.lit("unauth-exec").alias("template"), F.array("door", "sink").alias("fingerprints")),
        both("xss-unleashed", role("browser_exec") & live() & ~on_server(), role("weak_csp")),
        both("secret-pivot", role("code_exec") & on_server() & shipped, role("secret") & live() & ~F.col("rule_id").isin(*PUBLIC_SECRETS) & shipped),
        both("cors-token-theft", role("open_cors") & (F.col("rule_id") != DEV_CORS), role("token_store")),
        alone("exploited-dependency", role("vuln_dep") & (F.coalesce("kev", F.lit(False)) | F.coalesce("reachable", F.lit(False)) | F.coalesce(F.col("vex_state") == "exploitable", F.lit(False)))),
        alone("supply-chain", role("supply_foothold") & (severity_rank(F.col("severity")) >= 3)),
        alone("data-egress", role("sensitive_egress") & flows),
    ]
    return reduce(DataFrame.unionByName, parts).select("template", F.lit(True).alias("impact"), "fingerprints")


def path_steps(paths: DataFrame, findings: DataFrame) -> DataFrame:
    """path_key, kind, step, tactic, rule_id, file, line, fingerprint, breaks, techniques: the steps of each path in the order of the narrative.

    paths: path_key, template, fingerprints; findings: fingerprint, rule_id, file, line and, where known, attack
    (techniques). Steps of one tactic stay in the template's order; one step a path breaks the chain. techniques: those
    of the path's findings, each once, in the order of the findings.
    """
    rows = [(t, n, which, tactic, TACTICS.index(tactic), n == cut) for t, (steps, cut) in STEPS.items() for n, (which, tactic) in enumerate(steps)]
    shape = F.broadcast(paths.sparkSession.createDataFrame(rows, "s_template string, n int, which int, tactic string, stage int, breaks boolean"))  # some twenty rows
    attack = F.col("attack") if "attack" in findings.columns else F.array().cast("array<string>")
    f = findings.select(F.col("fingerprint").alias("fp"), "rule_id", "file", "line", F.coalesce(attack, F.array()).alias("attack"))
    steps = paths.select("path_key", "template", "fingerprints").join(shape, F.col("template") == F.col("s_template"))
    steps = steps.withColumn("fp", F.element_at("fingerprints", F.col("which") + 1)).join(f, "fp")
    inside = Window.partitionBy("path_key")
    numbered = steps.withColumn("step", F.row_number().over(inside.orderBy("stage", "n")))
    all_ = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_set(F.struct("which", "attack")).over(inside)), lambda x: x["attack"])))
    return numbered.select("path_key", F.col("template").alias("kind"), "step", "tactic", "rule_id", "file", "line", F.col("fp").alias("fingerprint"), "breaks", all_.alias("techniques"))


def scored_paths(paths: DataFrame, findings: DataFrame) -> DataFrame:
    """template, impact, fingerprints, score, band, worst, n from candidate_paths() and their findings."""
    p = paths.withColumn("path_key", F.concat_ws(":", "template", F.array_join("fingerprints", ",")))
    steps = p.select("path_key", "template", "impact", "fingerprints", F.explode(F.array_distinct("fingerprints")).alias("fp")).join(findings, F.col("fp") == F.col("fingerprint"))
    agg = steps.groupBy("path_key", "template", "impact", "fingerprints").agg(
        F.max(severity_rank(F.col("severity"))).alias("worst"), F.bool_or(F.col("blast_radius").isNotNull() if "blast_radius" in findings.columns else F.lit(False)).alias("bundled"), F.bool_or(on_server()).alias("server"),
        F.bool_or(on_client()).alias("client"), F.bool_and(~live()).alias("dead"), F.bool_or(F.coalesce("kev", F.lit(False))).alias("kev"), F.max(F.coalesce("epss", F.lit(0.0))).alias("epss"),
        F.bool_or(has_role(F.col("rule_id"), "secret") & ~F.col("rule_id").isin(*PUBLIC_SECRETS)).alias("secret"), F.countDistinct("fingerprint").cast("int").alias("n"), F.bool_and(F.col("confidence") == "high").alias("all_high"),
    )
    s = score(F.col("worst"), F.col("bundled"), F.col("server"), F.col("client"), F.col("dead"), F.col("kev"), F.col("epss"), F.col("impact"), F.col("secret"), F.col("n"), F.col("all_high"))
    return agg.select("path_key", "template", "impact", "fingerprints", s.alias("score"), band(s).alias("band"), severity_name(F.col("worst")).alias("worst"), "n")


def suppressed(paths: DataFrame, group: str | None = None, most: int = MOST_PATHS) -> DataFrame:
    """Best paths first, without those whose findings all lie in a better path's; numbered path-1 on, for each group (project).

    paths: path_key, fingerprints, score, n. What lies in a path that itself goes lies in the one that stays instead, so
    comparing with all better paths of the group leaves the same as going through them in order. Only those kept are numbered.
    """
    key = [group] if group else []
    place = F.struct(F.col("score").isNull(), -F.col("score"), F.col("n").isNull(), -F.col("n"), "path_key", "fingerprints")
    own = paths.dropDuplicates([*key, "score", "n", "path_key", "fingerprints"]).withColumn("place", place)
    better = own.select(*[F.col(k).alias(f"b_{k}") for k in key], F.col("place").alias("b_place"), F.col("fingerprints").alias("b_fingerprints"), F.explode("fingerprints").alias("b_one"))
    # A path that lies in another shares its first finding with it: an equi join, not all with all.
    within = (F.col("fingerprints")[0] == F.col("b_one")) & (F.col("b_place") < F.col("place")) & (F.size(F.array_except("fingerprints", "b_fingerprints")) == 0)
    for k in key:
        within &= F.col(k) == F.col(f"b_{k}")
    kept = own.filter(F.size("fingerprints") > 0).join(better, within, "left_anti")
    kept = kept if group else kept.orderBy("place").limit(most)
    kept = kept.withColumn("i", F.row_number().over(Window.partitionBy(*key).orderBy("place"))).filter(F.col("i") <= most)
    return kept.withColumn("path_id", F.concat(F.lit("path-"), "i")).drop("place", "i")


def grounded(a: str, b: str) -> Column:
    """Why an attacker gets from finding a to finding b, structs with rule_id, file, reachable, reach_kind, reach_entrypoint; null if not. The first reason counts.

    A secret counts unless it is public by design, lies in a test, or is proven dead.
    """
    x, y = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))
    is_a, is_b = (lambda r: has_role(x("rule_id"), r)), (lambda r: has_role(y("rule_id"), r))
    eligible = lambda c, own: own("secret") & ~c("rule_id").isin(*PUBLIC_SECRETS) & ~test_path(c("file")) & F.coalesce(c("reachable"), F.lit(True))
    live = F.coalesce(x("reachable"), F.lit(True)) & F.coalesce(y("reachable"), F.lit(True))
    b_live = F.coalesce(y("reachable"), F.lit(False))
    same = F.coalesce(x("reach_entrypoint") == y("reach_entrypoint"), F.lit(False))
    return F.when(
        live,
        F.when(is_a("open_door") & (is_b("code_exec") | is_b("browser_exec")) & same & b_live, "open-door")
        .when(is_a("code_exec") & F.coalesce(x("reachable") & x("reach_kind").isin("server", "project"), F.lit(False)) & eligible(y, is_b), "server-reads-secret")
        .when(is_a("vuln_dep") & F.coalesce(x("reachable"), F.lit(False)) & eligible(y, is_b), "dependency-reads-secret")
        .when((is_a("weak_csp") | is_a("open_cors")) & (is_b("browser_exec") | is_b("token_store") | is_b("data_leak")) & b_live, "missing-control")
        .when(is_a("browser_exec") & (is_b("token_store") | is_b("data_leak") | is_b("sensitive_egress")) & b_live, "script-reads-data")
        .when(eligible(x, is_a) & (is_b("sensitive_egress") | is_b("data_leak")), "secret-carried-out"),
    )


IMPACT_ROLES = ("code_exec", "secret", "token_store", "data_leak", "sensitive_egress")


def verified_chains(chains: DataFrame, findings: DataFrame) -> DataFrame:
    """chain_id, n, reasons array<string>: proposed chains (chain_id, ord, fingerprint) that hold.

    Unknown and repeated findings go; fewer than two steps, a step that isn't grounded, or no role of impact void it.
    """
    once = chains.groupBy("chain_id", "fingerprint").agg(F.min("ord").alias("ord"))
    f = findings.select(F.col("fingerprint").alias("fp"), F.struct("rule_id", "file", "reachable", "reach_kind", "reach_entrypoint").alias("f"))
    steps = once.join(f, F.col("fingerprint") == F.col("fp"))
    w = Window.partitionBy("chain_id").orderBy("ord", "fingerprint")
    steps = steps.withColumn("g", F.lead("f").over(w)).withColumn("why", F.when(F.col("g").isNotNull(), grounded("f", "g"))).withColumn("last", F.col("g").isNull())
    impact = reduce(lambda a, b: a | b, [has_role(F.col("f.rule_id"), r) for r in IMPACT_ROLES])
    out = steps.groupBy("chain_id").agg(F.count("*").alias("n"), F.bool_and(F.col("last") | F.col("why").isNotNull()).alias("holds"), F.bool_or(impact).alias("impact"), F.array_sort(F.collect_list(F.when(~F.col("last"), F.struct("ord", "why")))).alias("r"))
    return out.filter((F.col("n") >= 2) & F.col("holds") & F.col("impact")).select("chain_id", "n", F.transform("r", lambda x: x["why"]).alias("reasons"))
