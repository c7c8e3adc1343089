"""The detectors of a scan by name, each over the tables that it needs, with one set of columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fingerprint
from ..operators import arguments, checks, dataflow, deps
from ..operators.rules import Rule, findings_of
from ..sources.shared import staged

#: What every finding has: null where a detector doesn't tell.
COLUMNS = {
    "rule_id": "string", "file": "string", "line": "int", "column": "int", "code_snippet": "string", "confidence": "string", "message": "string", "severity": "string", "fingerprint": "string", "rule_ord": "int", "taint_flow": dataflow.STEP, "taint_steps": "int", "data_asset": "string",
    "kev": "boolean", "epss": "double", "vex_state": "string",
}


@dataclass
class Inputs:
    """files: file, ext, text. The others are as the readers and checks have them; a detector without its table finds nothing.

    configs: file, text, framework; env: project, file, with tracked (project, file) and ignores (project, pattern);
    packages: installed packages, with script digests of an earlier scan; dependencies: name, declared, with advisories,
    and kev, epss and the list of popular names where known; locks: locked packages, with those of an earlier scan; responses: recorded HTTP responses.
    """

    files: DataFrame
    rules: tuple[Rule, ...] = ()
    framework: str | None = None
    configs: DataFrame | None = None
    env: DataFrame | None = None
    tracked: DataFrame | None = None
    ignores: DataFrame | None = None
    packages: DataFrame | None = None
    script_digests: DataFrame | None = None
    dependencies: DataFrame | None = None
    advisories: DataFrame | None = None
    kev: DataFrame | None = None
    epss: DataFrame | None = None
    popular: DataFrame | None = None
    locks: DataFrame | None = None
    old_locks: DataFrame | None = None
    responses: DataFrame | None = None

    @cached_property
    def program(self) -> dataflow.Program:
        """Facts of the sources, read once for all detectors that ask."""
        return dataflow.Program(self.files)


def uniform(found: DataFrame, **own: Column) -> DataFrame:
    """A detector's rows with COLUMNS; a finding without a text of its line has its message there, and every one a fingerprint."""
    own = {c: F.col(c) for c in found.columns if c in COLUMNS} | own
    out = found.select(*[own.get(c, F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])
    out = out.withColumn("code_snippet", F.coalesce("code_snippet", "message", F.lit(""))).withColumn("column", F.coalesce("column", F.lit(1)))
    return out.withColumn("fingerprint", F.coalesce("fingerprint", fingerprint(F.col("rule_id"), F.col("file"), F.col("line"), F.col("code_snippet"))))


def _united(*found: DataFrame | None) -> DataFrame | None:
    there = [x for x in found if x is not None]
    out = there[0] if there else None
    for x in there[1:]:
        out = out.unionByName(x)
    return out


def _secret_or_pattern(i: Inputs) -> DataFrame | None:
    return uniform(findings_of(i.files, list(i.rules), i.framework)) if i.rules else None


def _supply_chain(i: Inputs) -> DataFrame | None:
    danger = uniform(checks.installed_script_findings(i.packages)) if i.packages is not None else None
    changed = uniform(checks.script_changes(checks.script_digests(i.packages), i.script_digests)) if i.packages is not None and i.script_digests is not None else None
    return _united(danger, changed, _locked(i.locks, i.old_locks) if i.locks is not None else None, _unlocked(i))


def _unlocked(i: Inputs) -> DataFrame | None:
    """Manifests without a lockfile, where the scan was told of locked packages and of the manifests' own places."""
    if i.locks is None or i.dependencies is None or "file" not in i.dependencies.columns:
        return None
    return uniform(deps.missing_lockfiles(i.dependencies, i.locks), rule_id=F.lit("supply-chain.missing-lockfile"), line=F.lit(1), confidence=F.lit("medium"), message=F.lit("no lockfile"))


def _locked(now: DataFrame, before: DataFrame | None) -> DataFrame:
    """Locked packages without a digest, and with another than before for the same version."""
    named = lambda d: d.select("file", "path", "version", "integrity", "resolved")
    lacking = named(now).filter(F.col("integrity").isNull() & F.col("resolved").rlike("^https?://"))
    found = uniform(lacking, rule_id=F.lit("supply-chain.missing-integrity"), line=F.lit(1), confidence=F.lit("medium"), message=F.concat_ws("@", "path", "version"))
    if before is None:
        return found
    old = named(before).filter("integrity IS NOT NULL").select("file", "path", "version", F.col("integrity").alias("was")).distinct()
    other = named(now).filter("integrity IS NOT NULL").join(old, ["file", "path", "version"]).groupBy("file", "path", "version", "integrity").agg(F.bool_or(F.col("integrity") == F.col("was")).alias("same")).filter("NOT same")
    return found.unionByName(uniform(other, rule_id=F.lit("supply-chain.integrity-changed"), line=F.lit(1), confidence=F.lit("high"), message=F.concat_ws("@", "path", "version")))


def _dependencies(i: Inputs) -> DataFrame | None:
    if i.dependencies is None:
        return None
    place = F.col("file") if "file" in i.dependencies.columns else F.lit("package.json")
    known = None
    if i.advisories is not None:
        # Written, their size is known: few of them are sent out, and a name that many dependencies share isn't one task's.
        written = lambda d, tag: None if d is None else staged(d, tag)
        kev = written(i.kev if i.kev is None else i.kev.select(F.upper("cve").alias("cve")).distinct(), "kev")
        v = deps.known_vulnerabilities(i.dependencies, staged(i.advisories, "advisories"), kev, written(i.epss, "epss"), staged(deps.usage_index(i.files), "usage"))
        known = uniform(v, rule_id=F.lit("deps.known-vulnerability"), file=place, line=F.lit(1), confidence=F.lit("high"), message=F.concat_ws(" ", "name", "declared", "id"))
    squats = None
    if i.popular is not None:
        near = i.dependencies.join(deps.typosquats(i.dependencies, i.popular), "name")
        squats = uniform(near, rule_id=F.lit("deps.typosquat"), file=place, line=F.lit(1), confidence=F.lit("medium"), message=F.concat(F.col("name"), F.lit(" is one edit from "), "target"))
    return _united(known, squats)


def _configs(i: Inputs) -> DataFrame | None:
    own = uniform(checks.config_findings(i.configs)) if i.configs is not None else None
    return _united(own, uniform(checks.tls_findings(i.files)))


def _git(i: Inputs) -> DataFrame | None:
    if i.env is None or i.tracked is None or i.ignores is None:
        return None
    return uniform(checks.env_findings(i.env, i.tracked, i.ignores))


#: Detectors in the order in which equal findings count.
DETECTORS: dict[str, Callable[[Inputs], DataFrame | None]] = {
    "patterns": _secret_or_pattern,
    "supply_chain": _supply_chain,
    "dependencies": _dependencies,
    "taint": lambda i: uniform(dataflow.flow_findings(i.program)),
    "static": lambda i: uniform(arguments.argument_findings(i.program)),
    "ai_agency": lambda i: uniform(dataflow.agency_findings(i.program)),
    "configs": _configs,
    "git_hygiene": _git,
    "runtime": lambda i: uniform(checks.response_findings(i.responses)) if i.responses is not None else None,
}
#: What a quick scan leaves out.
SLOW = ("taint", "dependencies")


def found_by(inputs: Inputs, only: tuple[str, ...] = (), skip: tuple[str, ...] = (), quick: bool = False) -> DataFrame:
    """COLUMNS and detector, detector_ord: all findings of the detectors asked for (all, if only is empty)."""
    unknown = {*only, *skip} - DETECTORS.keys()
    if unknown:
        raise ValueError(f"no detector {', '.join(sorted(unknown))}; there are {', '.join(DETECTORS)}")
    left_out = {*skip, *(SLOW if quick and not only else ())}
    out = None
    for n, (name, detect) in enumerate(DETECTORS.items()):
        if (only and name not in only) or name in left_out:
            continue
        rows = detect(inputs)
        if rows is not None:
            rows = rows.withColumns({"detector": F.lit(name), "detector_ord": F.lit(n)})
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        shape = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
        out = inputs.files.sparkSession.createDataFrame([], f"{shape}, detector string, detector_ord int")
    return out
