"""Dependencies: merged declarations, advisories by version range, use, typosquats, install scripts, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.versions import affected_ranges, alternatives, base_score, range_text, severity_of_score, version, within


def merged_dependencies(declared: DataFrame, by: str = "project_id") -> DataFrame:
    """One row a project and name; a later section wins. declared: by, section, section_ord, name, declared."""
    return declared.groupBy(by, "name").agg(F.max_by(F.struct("declared", "section"), "section_ord").alias("d")).select(by, "name", "d.declared", "d.section")


def framework(names: Column) -> Column:
    """next, vite, react or unknown, from the names that a project depends on."""
    return F.when(F.array_contains(names, "next"), "next").when(F.array_contains(names, "vite"), "vite").when(F.array_contains(names, "react"), "react").otherwise("unknown")


def known_vulnerabilities(deps: DataFrame, advisories: DataFrame, kev: DataFrame | None = None, epss: DataFrame | None = None, usage: DataFrame | None = None) -> DataFrame:
    """Dependencies within an advisory's range: an equi join on the name, the range (alternatives set apart by ||) as a further condition.

    deps: name, declared; advisories: package, id, vulnerable_range, severity, and cve, symbols where known. An advisory that is
    exploited is critical; one whose symbols aren't used, and that isn't exploited, is low. A range is read once an
    advisory. The join is a left one so that Spark can send out the advisories, where they are few, and never the
    dependencies, of which there may be many more than it takes them for; the range drops rows without an advisory.
    Dependencies come through a generator: where all have one name that Spark can see in the plan, it would drop the key,
    send all of them out and find what they meet in the task of the advisory.
    """
    read = advisories.withColumn("__ranges", alternatives(F.col("vulnerable_range")))
    met = deps.withColumn("__v", version(F.col("declared"))).select(F.inline(F.array(F.struct("*")))).join(read, F.col("name") == F.col("package"), "left")
    out = met.filter(F.exists("__ranges", lambda r: within(F.col("__v"), r))).drop("__v", "__ranges", "package")
    if kev is not None:
        out = out.join(kev.select(F.upper("cve").alias("k_cve")).distinct(), F.upper("cve") == F.col("k_cve"), "left").withColumn("kev", F.col("k_cve").isNotNull()).drop("k_cve")
    else:
        out = out.withColumn("kev", F.lit(False))
    if epss is not None:
        out = out.join(epss.groupBy(F.upper("cve").alias("e_cve")).agg(F.max("p").alias("p")), F.upper("cve") == F.col("e_cve"), "left").withColumn("epss", F.least(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).drop("e_cve", "p")
    if usage is not None:
        out = vex(out, usage)
        out = out.withColumn("severity", F.when(F.col("kev"), "critical").when(F.col("vex_state") == "not_affected", "low").otherwise(F.col("severity")))
    else:
        out = out.withColumn("severity", F.when(F.col("kev"), "critical").otherwise(F.col("severity")))
    return out


def advisories_from_records(records: DataFrame, ecosystem: str = "npm") -> DataFrame:
    """package, id, cve, vulnerable_range, patched, severity, summary: a row for each package of the ecosystem that a record affects.

    records: id, aliases, summary, severity array<struct<type, score>>, database_specific struct<severity>, affected
    array<struct<package struct<ecosystem, name>, ranges array<struct<type, events>>>>. A package's lists of events
    become disjoint ranges. The severity is the stated one, else that of the vector's score, else high. Without a range of versions there is no row.
    """
    each = records.select("*", F.explode("affected").alias("a")).filter((F.col("a.package.ecosystem") == ecosystem) & F.col("a.package.name").isNotNull())
    lists = F.transform(F.filter("a.ranges", lambda r: r["type"].isin("SEMVER", "ECOSYSTEM")), lambda r: r["events"])
    per = each.select("id", "aliases", "summary", "severity", "database_specific", F.col("a.package.name").alias("package"), lists.alias("lists"))
    per = per.groupBy("package", "id").agg(F.flatten(F.collect_list("lists")).alias("lists"), *[F.first(c).alias(c) for c in ("aliases", "summary", "severity", "database_specific")])  # one row an affected entry
    per = per.withColumn("ranges", F.explode_outer(F.filter(F.array(affected_ranges(F.col("lists"))), lambda r: F.size(r) > 0))).filter("ranges IS NOT NULL")  # a mere filter would fold the events again
    stated = F.lower("database_specific.severity")
    stated = F.when(stated == "moderate", "medium").when(stated.isin("critical", "high", "medium", "low"), stated)
    scored = severity_of_score(F.array_max(F.transform("severity", lambda s: base_score(s["score"]))))
    cve = F.get(F.filter("aliases", lambda a: a.startswith("CVE-")), F.lit(0))
    last = F.element_at("ranges", -1)
    return per.select("package", "id", F.coalesce(cve, F.when(F.col("id").startswith("CVE-"), F.col("id"))).alias("cve"), range_text(F.col("ranges")).alias("vulnerable_range"), F.when(~last["through"], last["hi"]).alias("patched"), F.coalesce(stated, scored, F.lit("high")).alias("severity"), F.trim("summary").alias("summary"))


def used(symbols: Column, package_used: Column, used_symbols: Column, unresolved: Column) -> Column:
    """Three-valued: whether any of an advisory's symbols is used; null if that can't be told."""
    return F.when(~F.coalesce(package_used, F.lit(False)), F.lit(False)).when(F.coalesce(F.size(symbols), F.lit(0)) <= 0, F.lit(None).cast("boolean")).when(F.arrays_overlap(symbols, used_symbols), F.lit(True)).when(unresolved, F.lit(None).cast("boolean")).otherwise(F.lit(False))


def vex(vulnerable: DataFrame, usage: DataFrame) -> DataFrame:
    """Adds vex_state and vex_reason. vulnerable: name, symbols; usage: package, symbols, files, unresolved."""
    u = usage.select(F.col("package").alias("u_package"), F.col("symbols").alias("u_symbols"), F.col("unresolved").alias("u_unresolved"))
    out = vulnerable.join(u, F.col("name") == F.col("u_package"), "left")
    hit = used(F.col("symbols"), F.col("u_package").isNotNull(), F.col("u_symbols"), F.col("u_unresolved"))
    state = F.when(hit, "exploitable").when(~hit, "not_affected").when(F.coalesce(F.size("symbols"), F.lit(0)) <= 0, "in_triage").otherwise("under_investigation")
    reason = F.when(hit, "vulnerable_code_in_use").when(F.col("u_package").isNull(), "component_not_imported").when(~hit, "vulnerable_code_not_in_use").when(F.coalesce(F.size("symbols"), F.lit(0)) <= 0, "no_symbols").otherwise("unresolved_use")
    return out.withColumn("vex_state", state).withColumn("vex_reason", reason).drop("u_package", "u_symbols", "u_unresolved")


# How a source names a package: an import with a clause, one without, and a required value.
_CLAUSE = r"import\s+([A-Za-z0-9_$*{][^'\"`;]*?)\s*from\s*['\"]([^'\"]+)['\"]"
_BARE = r"import\s*['\"]([^'\"]+)['\"]"
_REQUIRED = r"(?:const|let|var)\s+([A-Za-z0-9_$]+|\{[^}]*\})\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)"


def package_uses(files: DataFrame) -> DataFrame:
    """file, package, symbols, unresolved: a row for each import of a package by a file.

    symbols: the last part of a deeper module name; otherwise the names in braces (before "as" or ":") and the members
    that the file asks of the imported value. A value of which no member is seen is unresolved. files: file, text.
    """
    t = F.col("text")
    both = lambda p: F.arrays_zip(F.regexp_extract_all(t, F.lit(p), 1).alias("clause"), F.regexp_extract_all(t, F.lit(p), 2).alias("spec"))
    bare = F.transform(F.regexp_extract_all(t, F.lit(_BARE), 1), lambda s: F.struct(F.lit("").alias("clause"), s.alias("spec")))
    each = files.filter(t.rlike(r"import|require")).select("file", "text", F.explode(F.concat(both(_CLAUSE), bare, both(_REQUIRED))).alias("i"))
    root = package_root(F.col("i.spec"))
    deeper = F.substr(F.col("i.spec"), F.length(root) + 2)
    named = F.regexp_extract("i.clause", r"\{([^}]*)\}", 1)
    names = F.filter(F.transform(F.split(named, ","), lambda n: F.regexp_extract(n, r"^\s*(?:type\s+)?([A-Za-z0-9_$]+)", 1)), lambda n: n != "")
    whole = F.filter(F.transform(F.split(F.regexp_replace("i.clause", r"\{[^}]*\}", ""), ","), lambda n: F.regexp_extract(n, r"^\s*(?:\*\s+as\s+)?([A-Za-z0-9_$]+)\s*$", 1)), lambda n: n != "")
    pair = r"(?<![A-Za-z0-9_$])([A-Za-z0-9_$]+)(?=\.([A-Za-z0-9_$]+))"
    asked = F.arrays_zip(F.regexp_extract_all("text", F.lit(pair), 1).alias("value"), F.regexp_extract_all("text", F.lit(pair), 2).alias("member"))
    out = each.withColumn("package", root).filter("package IS NOT NULL").withColumn("deeper", deeper).withColumn("whole", F.when(F.col("deeper") == "", whole).otherwise(F.array().cast("array<string>"))).withColumn("asked", F.when(F.size("whole") > 0, asked))
    members = F.transform(F.filter("asked", lambda a: F.array_contains("whole", a["value"])), lambda a: a["member"])
    seen = F.transform(F.filter("asked", lambda a: F.array_contains("whole", a["value"])), lambda a: a["value"])
    symbols = F.when(F.col("deeper") != "", F.array(F.substring_index("deeper", "/", -1))).otherwise(F.array_distinct(F.concat(names, F.coalesce(members, F.array()))))
    return out.select("file", "package", symbols.alias("symbols"), F.coalesce(F.size(F.array_except("whole", F.coalesce(seen, F.array()))) > 0, F.lit(False)).alias("unresolved"))


def usage_index(files: DataFrame) -> DataFrame:
    """package, symbols, files (how many import it), unresolved: what vex() asks for, from the imports of a corpus."""
    uses = package_uses(files)
    symbols = uses.select("package", F.explode("symbols").alias("s")).distinct().groupBy("package").agg(F.array_sort(F.collect_list("s")).alias("symbols"))
    counts = uses.groupBy("package").agg(F.countDistinct("file").alias("files"), F.bool_or("unresolved").alias("unresolved"))
    return counts.join(symbols, "package", "left").select("package", F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"), "files", "unresolved")


def package_root(spec: Column) -> Column:
    """The package of a module name; null for relative ones."""
    return F.when(spec.rlike(r"^[./]") | (spec == ""), F.lit(None).cast("string")).when(spec.startswith("@"), F.nullif(F.regexp_extract(spec, r"^(@[^/]+/[^/]+)", 1), F.lit(""))).otherwise(F.regexp_extract(spec, r"^([^/]+)", 1))


def typosquats(names: DataFrame, popular: DataFrame) -> DataFrame:
    """name, target: names one edit from a popular one, the first of the list; names in the list are none.

    popular: ord, name. Both sides are keyed by their deletion variants (a name, and a name without one character), so
    names at distance 1 meet in an equi join instead of all with all.
    """
    variants = lambda n: F.array_distinct(F.concat(F.array(n), F.transform(F.sequence(F.lit(1), F.greatest(F.length(n), F.lit(1))), lambda i: F.concat(F.substring(n, F.lit(1), i - 1), F.substring(n, i + 1, F.length(n))))))
    n = names.select("name").distinct().join(popular.select("name").distinct(), "name", "left_anti")
    left = n.select("name", F.explode(variants(F.col("name"))).alias("variant"))
    right = popular.select("ord", F.col("name").alias("target"), F.explode(variants(F.col("name"))).alias("v"))
    met = left.join(right, F.col("variant") == F.col("v")).filter(F.levenshtein("name", "target", 1) == 1)
    return met.groupBy("name").agg(F.min_by("target", "ord").alias("target"))


#: Our own tests of install scripts, worst first: what it does, pattern.
SCRIPT_RULES = (
    ("pipes-download-to-shell", r"(curl|wget)[^|;&]*\|\s*(ba|z)?sh"), ("evaluates-code", r"(node|python3?)\s+-(e|c)\s|eval\s*\("), ("decodes-payload", r"base64\s+(-d|--decode)|Buffer\.from\([^)]*base64"),
    ("sends-environment", r"(curl|wget|nc)\s[^;]*(\$[A-Z_]+|env\b|printenv)"), ("downloads", r"\b(curl|wget)\s"), ("touches-credentials", r"\.npmrc|\.ssh|\.aws|id_rsa"), ("runs-hidden-file", r"(sh|node)\s+\.[A-Za-z]"),
)


def script_danger(command: Column) -> Column:
    """The first danger that a script shows; null if none."""
    return F.coalesce(*[F.when(command.rlike(p), F.lit(name)) for name, p in SCRIPT_RULES])


def lock_counts(packages: DataFrame, by: str = "project_id") -> DataFrame:
    """by, packages, without_integrity, off_registry. packages: resolved, integrity."""
    return packages.groupBy(by).agg(F.count("*").alias("packages"), F.count_if(F.col("integrity").isNull()).alias("without_integrity"), F.count_if(F.col("resolved").isNotNull() & ~F.col("resolved").rlike(r"^https://registry\.(npmjs\.org|yarnpkg\.com)/")).alias("off_registry"))


# Files that fix the versions of what is installed.
LOCKFILES = ("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "bun.lockb")


def missing_lockfiles(declared: DataFrame, paths: DataFrame) -> DataFrame:
    """file: manifests with a dependency (file, name) that have a lockfile (paths: file) neither beside them nor in a folder above.

    Both sides are few rows a project: a manifest asks for each folder on its way up. Null names and paths count for
    nothing, rows given twice count once, and a manifest without a folder asks for the top one only.
    """
    asks = declared.filter("file IS NOT NULL AND name IS NOT NULL").select("file").distinct()
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    locks = paths.filter(F.substring_index("file", "/", -1).isin(*LOCKFILES)).select(F.regexp_replace("file", "/?[^/]*$", "").alias("folder")).distinct()
    covered = asks.select("file", F.explode(above).alias("folder")).join(locks, "folder", "left_semi").select("file")
    return asks.join(covered, "file", "left_anti")


def purl(name: Column, version_text: Column) -> Column:
    return F.concat(F.lit("pkg:npm/"), F.replace(name, F.lit("@"), F.lit("%40")), F.lit("@"), version_text)


def components(packages: DataFrame) -> DataFrame:
    """name, version, dev, purl: one row a name and version, needed outside development if any place needs it. packages: path, version, dev."""
    named = packages.select(F.element_at(F.split("path", "node_modules/"), -1).alias("name"), "version", F.coalesce("dev", F.lit(False)).alias("dev")).filter("name <> ''")
    return named.groupBy("name", "version").agg(F.bool_and("dev").alias("dev")).withColumn("purl", purl(F.col("name"), F.col("version")))


def first_line_of(names: DataFrame, lines: DataFrame) -> DataFrame:
    """name, line: where each name first stands quoted. names: project_id, name; lines: project_id, line, line_text."""
    quoted = lines.select("project_id", "line", F.explode(F.regexp_extract_all("line_text", F.lit(r'"([^"]+)"\s*:'), 1)).alias("name"))
    return names.join(quoted.groupBy("project_id", "name").agg(F.min("line").alias("line")), ["project_id", "name"], "left")


def duplicates_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
