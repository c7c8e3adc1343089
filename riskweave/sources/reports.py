"""Sinks: findings and components as JSON, SARIF, Navigator layers, CycloneDX, SPDX, Sigma; baselines and snapshots."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import SEVERITIES, severity_rank
from .shared import staged

#: SARIF levels by severity.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def as_json(findings: DataFrame) -> DataFrame:
    """value: a JSON text a finding."""
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("value"))


def document(spark: SparkSession, sections: list[tuple[str, DataFrame]], end: str) -> DataFrame:
    """value: the lines of a text, in order: what comes before each section, then the section's values set apart by commas.

    Sections come in the order of their rows; each is sorted by Spark and written to the shared folder, so that the
    driver holds none of it whatever its size.
    """
    lines, schema = [], "section int, at long, value string"
    for k, (before, rows) in enumerate(sections):
        numbered = staged(rows.withColumn("at", F.monotonically_increasing_id()).select("at", "value"), "report")
        first = numbered.agg(F.min("at")).first()[0]
        lines += [spark.createDataFrame([(k, -1, before)], schema), numbered.select(F.lit(k).alias("section"), "at", F.when(F.col("at") == first, F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))]
    return reduce(DataFrame.unionByName, [*lines, spark.createDataFrame([(len(sections), 0, end)], schema)]).orderBy("section", "at").select("value")


def write_document(lines: DataFrame, path: str) -> None:
    """A document as text files whose names, in order, give its order."""
    lines.write.mode("overwrite").text(path)


def document_lines(lines: DataFrame) -> Iterator[str]:
    """A document's lines for a terminal, a partition at a time."""
    return (r["value"] for r in lines.toLocalIterator())


def _worst_first(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc(severity_rank(F.col("severity"))), "file", "line", "fingerprint")


def sarif_results(findings: DataFrame) -> DataFrame:
    """value: each finding as a SARIF 2.1.0 result; steps of its data flow (taint_flow: label, file, line, kind, code), where it has them, as a code flow."""
    level = F.coalesce(*[F.when(F.col("severity") == s, F.lit(v)) for s, v in LEVELS.items()], F.lit("warning"))
    at = lambda file, line, extra=(): F.struct(F.struct(file.alias("uri")).alias("artifactLocation"), F.struct(F.greatest(line, F.lit(1)).alias("startLine"), *extra).alias("region"))
    place = F.array(F.struct(at(F.col("file"), F.col("line"), [F.greatest(F.col("column"), F.lit(1)).alias("startColumn"), F.struct(F.col("code_snippet").alias("text")).alias("snippet")]).alias("physicalLocation")))
    own = [F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.coalesce("message", "code_snippet").alias("text") if "message" in findings.columns else F.col("code_snippet").alias("text")).alias("message"), place.alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints")]
    if "confidence" in findings.columns:
        own.append(F.struct("confidence").alias("properties"))
    if "taint_flow" in findings.columns:
        step = lambda s: F.struct(F.struct(at(s["file"], s["line"], [F.struct(s["code"].alias("text")).alias("snippet")]).alias("physicalLocation"), F.struct(F.concat(s["kind"], F.lit(": "), s["label"]).alias("text")).alias("message")).alias("location"))
        flow = F.array(F.struct(F.array(F.struct(F.transform("taint_flow", step).alias("locations"))).alias("threadFlows")))
        own.append(F.when(F.size("taint_flow") > 0, flow).alias("codeFlows"))
    return findings.select(F.to_json(F.struct(*own)).alias("value"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """value: each rule that fired as an entry of a SARIF driver. findings: rule_id and, where known, title, why, fix, cwe."""
    of = lambda c: F.first(c, ignorenulls=True).alias(c) if c in findings.columns else F.lit(None).cast("string").alias(c)
    each = findings.groupBy("rule_id").agg(F.max(severity_rank(F.col("severity"))).alias("rank"), *[of(c) for c in ("title", "why", "fix", "cwe")])
    text = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("text")))
    body = F.struct(F.col("rule_id").alias("id"), text("title").alias("shortDescription"), text("why").alias("fullDescription"), text("fix").alias("help"), F.struct(F.array_compact(F.array("cwe")).alias("tags"), F.element_at(F.array(*[F.lit(str(x)) for _, _, x in SEVERITIES]), F.col("rank") + 1).alias("security-severity")).alias("properties"))
    return each.orderBy("rule_id").select(F.to_json(body).alias("value"))


def sarif(findings: DataFrame, paths: DataFrame | None = None, tool: str = "riskweave") -> DataFrame:
    """value: the lines of a whole SARIF document: the rules that fired, the worst findings first, and attack paths as properties of the run."""
    head = f'{{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{{"tool":{{"driver":{{"name":{json.dumps(tool)},"rules":['
    sections = [(head, sarif_rules(findings)), (']}},"results":[', sarif_results(_worst_first(findings)))]
    if paths is not None:
        sections.append(('],"properties":{"attackPaths":[', paths.orderBy("path_id").select(F.to_json(F.struct(*paths.columns)).alias("value"))))
    return document(findings.sparkSession, sections, "]}]}" if paths is None else "]}}]}")


def navigator_techniques(counts: DataFrame) -> DataFrame:
    """value: each technique of technique_counts() as an entry of a Navigator layer."""
    return counts.select(F.to_json(F.struct(F.col("technique_id").alias("techniqueID"), F.col("n").alias("score"), F.array_join("rules", ", ").alias("comment"))).alias("value"))


def cyclonedx_components(components: DataFrame) -> DataFrame:
    """value: each component in CycloneDX 1.5 form."""
    return components.select(F.to_json(F.struct(F.lit("library").alias("type"), "name", "version", "purl", F.col("purl").alias("bom-ref"), F.when(F.col("dev"), "optional").otherwise("required").alias("scope"))).alias("value"))


#: CycloneDX's words for why a dependency isn't affected, by the reason that its use gives.
JUSTIFICATIONS = {"component_not_imported": "code_not_present", "vulnerable_code_not_in_use": "code_not_reachable"}


def cyclonedx_vex(vulnerable: DataFrame) -> DataFrame:
    """value: each vulnerable dependency as an entry of CycloneDX's vulnerabilities, with what its use says of it.

    vulnerable: name, id, vex_state, vex_reason, and purl, severity, cwe, summary, patched where known.
    """
    has = lambda c: F.col(c) if c in vulnerable.columns else F.lit(None).cast("string")
    state = F.when(F.col("vex_state") == "under_investigation", "in_triage").otherwise(F.col("vex_state"))
    why = F.coalesce(*[F.when(F.col("vex_reason") == k, F.lit(v)) for k, v in JUSTIFICATIONS.items()])
    number = F.nullif(F.regexp_extract(has("cwe"), r"(\d+)", 1), F.lit("")).cast("int")
    body = F.struct(
        "id", F.array(F.struct(F.lower(F.coalesce(has("severity"), F.lit("unknown"))).alias("severity"))).alias("ratings"), F.array_compact(F.array(number)).alias("cwes"), has("summary").alias("description"),
        F.concat(F.lit("Upgrade to "), has("patched"), F.lit(" or later.")).alias("recommendation"), F.array(F.struct(F.coalesce(has("purl"), F.col("name")).alias("ref"))).alias("affects"),
        F.struct(state.alias("state"), why.alias("justification"), F.col("vex_reason").alias("detail")).alias("analysis"),
    )
    return vulnerable.select(F.to_json(body).alias("value"))


def spdx_packages(components: DataFrame) -> DataFrame:
    """value: each component as an SPDX 2.3 package."""
    ref = F.concat(F.lit("SPDXRef-"), F.regexp_replace(F.concat_ws("-", "name", "version"), "[^A-Za-z0-9.-]", "-"))
    outside = F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator")))
    return components.select(F.to_json(F.struct(ref.alias("SPDXID"), "name", F.col("version").alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"), outside.alias("externalRefs"))).alias("value"))


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) of a column of names."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


#: The namespace of names that aren't anything else's: that of URLs.
NAMES = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def sigma_rules(rules: DataFrame, patterns: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """value: each log rule as a Sigma text, with an id that stays the same. rules: rule, severity, technique; patterns: what a rule looks for, by rule."""
    looks = {r: "\n".join(f"      - '{p.replace(chr(39), chr(39) * 2)}'" for p in ps) for r, ps in (patterns or {}).items()}
    found = F.coalesce(*[F.when(F.col("rule") == r, F.lit(t)) for r, t in looks.items()], F.lit("      - '.*'"))
    return rules.select(
        F.format_string(
            "title: %s\nid: %s\nstatus: experimental\nlevel: %s\ntags:\n  - attack.%s\nlogsource:\n  category: webserver\ndetection:\n  selection:\n    request|re:\n%s\n  condition: selection\n",
            "rule", uuid5(NAMES, F.col("rule")), F.lower("severity"), F.lower("technique"), found,
        ).alias("value")
    )


def _serial(components: DataFrame, name: str) -> str:
    """A UUID that follows from the components, whatever their order."""
    from uuid import UUID, uuid5 as named

    n, total = components.agg(F.count("*"), F.sum(F.xxhash64("name", "version").cast("decimal(38,0)"))).first()
    return str(named(UUID(NAMES), f"{name} {n} {total}"))


def cyclonedx(components: DataFrame, name: str, vulnerable: DataFrame | None = None) -> DataFrame:
    """value: the lines of a whole CycloneDX 1.5 document: all components by name and version, and the vulnerable ones with their state."""
    head = f'{{"bomFormat":"CycloneDX","specVersion":"1.5","serialNumber":"urn:uuid:{_serial(components, name)}","version":1,"metadata":{{"component":{{"type":"application","name":{json.dumps(name)}}}}},"components":['
    sections = [(head, cyclonedx_components(components.orderBy("name", "version")))]
    if vulnerable is not None:
        sections.append(('],"vulnerabilities":[', cyclonedx_vex(vulnerable.orderBy("name", "id"))))
    return document(components.sparkSession, sections, "]}")


def spdx(components: DataFrame, name: str) -> DataFrame:
    """value: the lines of a whole SPDX 2.3 document: all components, each contained in the document's own package."""
    head = f'{{"spdxVersion":"SPDX-2.3","dataLicense":"CC0-1.0","SPDXID":"SPDXRef-DOCUMENT","name":{json.dumps(name)},"documentNamespace":"urn:uuid:{_serial(components, name)}","packages":['
    ordered = components.orderBy("name", "version")
    made = spdx_packages(ordered)
    relation = made.select(F.to_json(F.struct(F.lit("SPDXRef-DOCUMENT").alias("spdxElementId"), F.lit("DESCRIBES").alias("relationshipType"), F.get_json_object("value", "$.SPDXID").alias("relatedSpdxElement"))).alias("value"))
    return document(components.sparkSession, [(head, made), ('],"relationships":[', relation)], "]}")


def _left_out(findings: DataFrame, shown: int, most: int) -> str:
    """What a display for people doesn't show."""
    more = findings.count() - shown if shown == most else 0
    return f"and {more} more" if more > 0 else ""


def terminal(findings: DataFrame, most: int = 40) -> str:
    """The worst findings, one a line, and how many more there are."""
    rows = _worst_first(findings).limit(most).collect()
    lines = [f"{r['severity']:>8}  {r['rule_id']}  {r['file']}:{r['line']}" for r in rows]
    return "\n".join(x for x in [*lines, _left_out(findings, len(rows), most)] if x)


def html(findings: DataFrame, most: int = 500) -> str:
    """A page of the worst findings, and how many more there are."""
    from html import escape

    rows = _worst_first(findings).limit(most).collect()
    cells = "".join("<tr>" + "".join(f"<td>{escape(str(r[c]))}</td>" for c in ("severity", "rule_id", "file", "line", "code_snippet")) + "</tr>" for r in rows)
    return f"<table><tr><th>severity<th>rule<th>file<th>line<th>code</tr>{cells}</table>{_left_out(findings, len(rows), most)}"


def write_baseline(findings: DataFrame, path: str) -> None:
    findings.select("fingerprint").distinct().sort("fingerprint").write.mode("overwrite").text(path)


def append_snapshot(findings: DataFrame, path: str, project: str, snap_id: int) -> None:
    findings.withColumn("project_id", F.lit(project)).withColumn("snap_id", F.lit(snap_id)).write.mode("append").partitionBy("project_id", "snap_id").parquet(path)


def kept_snapshots(snapshots: DataFrame, most: int = 50) -> DataFrame:
    w = Window.partitionBy("project_id").orderBy(F.desc("snap_id"))
    return snapshots.select("project_id", "snap_id").distinct().withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).drop("n")


def prune_snapshots(spark: SparkSession, path: str, most: int = 50) -> list[str]:
    """Deletes what kept_snapshots() doesn't keep under path, and tells which folders went."""
    every = spark.read.parquet(path).select("project_id", "snap_id").distinct()
    gone = every.join(kept_snapshots(every, most), ["project_id", "snap_id"], "left_anti").orderBy("project_id", "snap_id").collect()  # one row a snapshot
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    places = [f"{path}/project_id={r['project_id']}/snap_id={r['snap_id']}" for r in gone]
    for p in places:
        target = fs_path(p)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return places


FORMATS = {"json": as_json, "sarif": sarif_results, "navigator": navigator_techniques, "cyclonedx": cyclonedx_components, "spdx": spdx_packages, "sigma": sigma_rules}


def write_texts(changed: DataFrame, root: str) -> None:
    """Writes `after` over the files under root (a folder that all executors see) whose text is still `before`; others stay as they are.

    A file is replaced whole, by a rename, so that a task which is lost or run again leaves the old text or the new one.
    """

    def write(rows) -> None:
        for r in rows:
            path = os.path.join(root, r["file"])
            with open(path, "rb") as f:
                now = f.read()
            if now != r["before"].encode():  # changed since, or not all UTF-8, which would be lost
                continue
            handle, new = tempfile.mkstemp(dir=os.path.dirname(path))
            with os.fdopen(handle, "wb") as f:
                f.write(r["after"].encode())
            shutil.copymode(path, new)
            os.replace(new, path)

    changed.select("file", "before", "after").foreachPartition(write)
