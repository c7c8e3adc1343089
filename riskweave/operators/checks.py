"""Checks of configuration, environment files, installed packages and recorded HTTP responses, as expressions over tables.

Each gives rule_id, file, line, confidence and message rows like the rules over lines do. Responses are a table that
something else has recorded: no check asks a server.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .deps import script_danger

FOUND = "array<struct<rule_id:string,line:int,confidence:string,message:string>>"


def hit(when: Column, rule: str, message: Column | str, confidence: Column | str = "high", line: Column | int = 0) -> Column:
    """A finding where a condition holds, else null (also where it is null)."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(when, F.struct(F.lit(rule).alias("rule_id"), as_column(line).cast("int").alias("line"), as_column(confidence).alias("confidence"), as_column(message).alias("message")))


def findings(rows: DataFrame, file: str, hits: list[Column], *keep: str) -> DataFrame:
    """One projection over each row, exploded where checks hit."""
    return rows.select(F.col(file).alias("file"), *keep, F.explode(F.array_compact(F.array(*hits))).alias("h")).select("h.rule_id", "file", "h.line", "h.confidence", "h.message", *keep)


# --- responses: url, status, headers map<string,string>, cookies array<string>, body, probe (what was sent, or null)


# What a probe sends, paths of model endpoints, and marks of a stack trace.
REDIRECT_STATUS = (301, 302, 303, 307, 308)
MODEL_PATHS = ("/api/chat", "/api/ai", "/api/completion", "/api/completions", "/api/generate", "/api/assistant", "/api/copilot", "/api/llm", "/api/agent")
STACK_MARKS = ("Traceback (most recent call last)", "    at ", "\n  at Object.", "Error:", "ENOENT", "node_modules", ".js:", "stack:")
COOKIE_FLAGS = (("HttpOnly", "httponly"), ("Secure", "secure"), ("SameSite", "samesite"))


def header(name: str) -> Column:
    """A header's value by its lower-case name, null if it is absent."""
    return F.get(F.map_values(F.map_filter("headers", lambda k, v: F.lower(k) == name)), F.lit(0))


def response_findings(responses: DataFrame) -> DataFrame:
    """Headers that are absent or tell too much, cookies without flags, and what probes show: redirects, reflection, stack traces, open model endpoints.

    responses: url, status, headers, cookies, body, probe_kind (null for a plain request; redirect, reflection, error or
    model), probe (the target or marker sent). Null maps and arrays count as empty, null bodies as "".
    """
    r = responses.withColumn("headers", F.coalesce("headers", F.create_map().cast("map<string,string>"))).withColumn("body", F.coalesce("body", F.lit("")))
    plain = F.col("probe_kind").isNull()
    policy = F.coalesce(header("content-security-policy"), F.lit(""))
    banner = F.coalesce(F.nullif(header("x-powered-by"), F.lit("")), header("server"))
    kind, status = F.coalesce(header("content-type"), F.lit("")), F.col("status")
    shaped = F.lower(kind).rlike("application/json|text/event-stream|application/x-ndjson")
    asked = lambda k: F.coalesce(F.col("probe_kind") == k, F.lit(False))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    hits = [
        hit(plain & header("content-security-policy").isNull(), "headers.missing-csp", "no Content-Security-Policy"),
        hit(plain & F.lower("url").startswith("https://") & header("strict-transport-security").isNull(), "headers.missing-hsts", "no Strict-Transport-Security over HTTPS"),
        hit(plain & header("x-frame-options").isNull() & ~policy.contains("frame-ancestors"), "headers.missing-x-frame-options", "may be framed by any site"),
        hit(plain & (F.lower(F.coalesce(header("x-content-type-options"), F.lit(""))) != "nosniff"), "headers.missing-x-content-type-options", "types are guessed", "medium"),
        hit(plain & header("referrer-policy").isNull(), "headers.missing-referrer-policy", "no Referrer-Policy", "medium"),
        hit(plain & banner.rlike("[0-9]"), "headers.server-version-disclosure", banner, "medium"),
        hit(asked("redirect") & status.isin(*REDIRECT_STATUS) & F.coalesce(header("location"), F.lit("")).startswith(F.col("probe")), "dast.open-redirect", "redirects to a host that was sent"),
        hit(asked("reflection") & kind.contains("html") & F.col("body").contains(F.col("probe")), "dast.reflected-xss", "what was sent comes back unescaped"),
        hit(asked("error") & (status >= 500) & F.substring("body", 1, 5000).rlike("|".join(f"\\Q{m}\\E" for m in STACK_MARKS)), "dast.verbose-error", F.concat(F.lit("status "), status.cast("string")), "medium"),
        hit(asked("model") & path.isin(*MODEL_PATHS) & status.isin(200, 400, 405) & (shaped | (status == 405)), "ai-endpoint.unauthenticated-live", F.concat(path, F.lit(" answers "), status.cast("string")), F.when(status == 200, "medium").otherwise("low")),
    ]
    missing = lambda c: F.array_join(F.array_compact(F.array(*[F.when(~F.lower(c).contains(token), F.lit(flag)) for flag, token in COOKIE_FLAGS])), ", ")
    cookies = r.filter(plain).select("url", F.explode("cookies").alias("c")).select("url", F.trim(F.substring_index("c", "=", 1)).alias("name"), missing(F.col("c")).alias("missing"))
    flagged = findings(cookies, "url", [hit(F.col("missing") != "", "cookie.insecure-flags-live", F.concat_ws(" without ", "name", "missing"), "medium")])
    return findings(r, "url", hits).union(flagged)


# --- configuration: project, file, text, framework


# Options that turn a safety check off, and headers one of which is enough.
UNSAFE_OPTIONS = (("typescript.ignoreBuildErrors", r"(?i)ignoreBuildErrors\s*:\s*true\b"), ("eslint.ignoreDuringBuilds", r"(?i)ignoreDuringBuilds\s*:\s*true\b"))
HEADER_NAMES = ("x-frame-options", "content-security-policy", "strict-transport-security")
DOMAINS = r"(?is)domains\s*:\s*\[[^\]]*['\"]\s*\*[^'\"\]]*['\"][^\]]*\]"
ANY_HOST = r"(?i)hostname\s*:\s*['\"]\s*\*+\s*['\"]"
HEADERS_CALL = r"(?i)headers\s*(?:=\s*(?:async\s*)?)?\("
TLS_OFF = (("environment", r"(?i)NODE_TLS_REJECT_UNAUTHORIZED\s*[=:]\s*['\"]?0['\"]?"), ("option", r"(?i)rejectUnauthorized\s*:\s*false\b"))


def line_of(text: Column, pattern: str) -> Column:
    """The line of a pattern's first match, from 1."""
    before = F.substring(text, F.lit(1), F.regexp_instr(text, F.lit(pattern)) - 1)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def config_findings(configs: DataFrame) -> DataFrame:
    """Unsafe options and absent security headers of build configurations, one row a file. configs: file, text, framework (nextjs: headers are asked for)."""
    t = F.col("text")
    some = F.length(t) > 0
    hits = [hit(t.rlike(p), "nextjs.dangerous-config", name, line=line_of(t, p)) for name, p in UNSAFE_OPTIONS]
    hits.append(hit(t.rlike(DOMAINS), "nextjs.dangerous-config", "images.domains", line=line_of(t, DOMAINS)))
    hits.append(hit(t.rlike(r"(?i)remotePatterns\s*:\s*\[") & t.rlike(ANY_HOST), "nextjs.dangerous-config", "images.remotePatterns", line=line_of(t, ANY_HOST)))
    named = F.lower(t).rlike("|".join(HEADER_NAMES))
    hits.append(hit(some & (F.col("framework") == "nextjs") & ~(t.rlike(HEADERS_CALL) & named), "config.missing-security-headers", "no headers are set", "low", 1))
    return findings(configs, "file", hits)


def tls_findings(files: DataFrame) -> DataFrame:
    """Lines of at most 2000 characters that turn certificate checks off; the environment's switch counts first. files: file, text."""
    lines = files.select("file", F.posexplode(F.split("text", "\r?\n")).alias("i", "t")).filter(F.length("t") <= 2000)
    first = F.coalesce(*[F.when(F.col("t").rlike(p), F.lit(name)) for name, p in TLS_OFF])
    return findings(lines.withColumn("why", first), "file", [hit(F.col("why").isNotNull(), "config.disabled-tls-verification", F.col("why"), line=F.col("i") + 1)])


# --- environment files: project, file; tracked: project, file; ignores: project, pattern


# Endings of environment files that hold no secrets.
SAFE_ENV = (".example", ".sample", ".template", ".dist")


def glob_as_regex(glob: Column) -> Column:
    """An anchored pattern for a column of globs whose * and ? cross separators."""
    escaped = F.regexp_replace(glob, r"([.+^$(){}|\\])", r"\\$1")
    return F.concat(F.lit("^(?:"), F.replace(F.replace(F.replace(escaped, F.lit("*"), F.lit("[\\s\\S]*")), F.lit("?"), F.lit("[\\s\\S]")), F.lit("[!"), F.lit("[^")), F.lit(")$"))


def is_env_file(file: Column) -> Column:
    """At the root, .env or .env.something, and no example."""
    return file.rlike(r"^\.env(\..*)?$") & ~file.rlike("(" + "|".join(s.replace(".", r"\.") for s in SAFE_ENV) + ")$")


def env_findings(files: DataFrame, tracked: DataFrame, ignores: DataFrame) -> DataFrame:
    """Environment files that the repository holds, or would take up: project, rule_id, file, line, confidence, message.

    A project without a row in tracked has no repository's list, and its files count as not held. Patterns are compared
    with the whole path, with its name, and with a leading / left out; blank ones and comments don't count.
    """
    env = files.filter(is_env_file(F.col("file"))).select("project", "file").distinct()
    held = tracked.select("project", "file").distinct().withColumn("held", F.lit(True))
    p = F.regexp_replace(F.trim("pattern"), "/+$", "")
    globs = ignores.filter((F.trim("pattern") != "") & ~F.trim("pattern").startswith("#")).select(F.col("project").alias("g_project"), glob_as_regex(p).alias("g"), glob_as_regex(F.regexp_replace(p, "^/+", "")).alias("g_bare")).distinct()
    name = F.substring_index("file", "/", -1)
    met = env.join(globs, (F.col("project") == F.col("g_project")) & (F.expr("file rlike g") | F.expr("substring_index(file, '/', -1) rlike g") | F.expr("file rlike g_bare")), "left_semi")
    state = env.join(held, ["project", "file"], "left").join(met.withColumn("ignored", F.lit(True)), ["project", "file"], "left")
    hits = [
        hit(F.col("held"), "hardening.env-committed", F.concat(name, F.lit(" is in the repository")), line=1),
        hit(F.col("held").isNull() & F.col("ignored").isNull(), "hardening.env-not-gitignored", F.concat(name, F.lit(" isn't ignored")), line=1),
    ]
    return findings(state, "file", hits, "project")


# --- installed packages: project, name, version, scripts map<string,string>


# Scripts that run when a package is installed or removed.
LIFECYCLE = ("preinstall", "install", "postinstall", "preuninstall", "postuninstall", "prepare", "prepublish")


def lifecycle_scripts(packages: DataFrame) -> DataFrame:
    """project, name, version, script, command: the scripts that run by themselves."""
    return packages.select("project", "name", "version", F.explode("scripts").alias("script", "command")).filter(F.col("script").isin(*LIFECYCLE) & F.col("command").isNotNull())


def installed_script_findings(packages: DataFrame) -> DataFrame:
    """project, rule_id, file, line, confidence, message: scripts of installed packages that are dangerous."""
    s = lifecycle_scripts(packages).withColumn("danger", script_danger(F.col("command"))).withColumn("place", F.concat(F.lit("node_modules/"), "name", F.lit("/package.json")))
    return findings(s, "place", [hit(F.col("danger").isNotNull(), "supply-chain.dependency-install-script", F.concat_ws(" ", "script", "danger"), line=1)], "project")


def script_digests(packages: DataFrame) -> DataFrame:
    """project, name, digests (script, digest): what a later scan compares with; packages without such scripts have none."""
    scripts = F.map_filter("scripts", lambda k, v: k.isin(*LIFECYCLE) & v.isNotNull())
    each = packages.select("project", "name", F.transform_values(F.coalesce(scripts, F.create_map().cast("map<string,string>")), lambda k, v: F.sha1(v)).alias("d"))
    pairs = each.select("project", "name", F.explode_outer("d").alias("script", "digest"))
    return pairs.groupBy("project", "name").agg(F.collect_set(F.when(F.col("script").isNotNull(), F.struct("script", "digest"))).alias("digests"))


def script_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """project, rule_id, file, line, confidence, message: packages of both scans (script_digests) whose script is new or has changed; new packages are no change."""
    old = before.select("project", "name", F.col("digests").alias("old"))
    s = now.join(old, ["project", "name"]).select("project", "name", "old", F.explode("digests").alias("d"))
    same = F.exists("old", lambda o: (o["script"] == F.col("d.script")) & (o["digest"] == F.col("d.digest")))
    known = F.exists("old", lambda o: o["script"] == F.col("d.script"))
    s = s.withColumn("place", F.concat(F.lit("node_modules/"), "name", F.lit("/package.json")))
    return findings(s, "place", [hit(~same, "supply-chain.dependency-script-changed", F.concat_ws(" ", F.when(known, "changed").otherwise("new"), "d.script"), line=1)], "project")
