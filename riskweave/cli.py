"""Command line: scan, fix, sbom, rules, explain, logs. Exit code 0: fine, 1: the gate failed, 2: wrong use."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import RANK
from .operators import deps, rewrites
from .plans.packs import DIMENSION, PACK, WEB_RULES
from .plans.scan import Config, scan
from .sources import readers, reports
from .streaming import logs


def _session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _print(lines: DataFrame) -> None:
    for line in reports.document_lines(lines):
        print(line)


def _scan(a: argparse.Namespace) -> int:
    spark = _session()
    rules = list(WEB_RULES)
    if a.pack:
        from .operators.rules import load_pack

        extra, warnings = load_pack(readers.rule_pack(a.pack))
        rules += extra
        for w in warnings:
            print(f"warning: {w}", file=sys.stderr)
    config = Config(only=tuple(a.only), skip=tuple(a.skip), detectors=tuple(a.detector), skip_detectors=tuple(a.skip_detector), quick=a.quick, min_severity=a.min_severity, disabled=tuple(a.disable), overrides=dict(x.split("=", 1) for x in a.override), framework=a.framework, reachable_only=a.reachable_only, fail_on=a.fail_on, rules=tuple(rules))
    baseline = spark.read.text(a.baseline).withColumnRenamed("value", "fingerprint") if a.baseline else None
    changed = readers.changed_lines(spark, open(a.diff, encoding="utf-8").read()) if a.diff else None
    result = scan(readers.source_files(spark, a.path), config, baseline, changed)
    if a.write_baseline:
        reports.write_baseline(result.findings, a.write_baseline)
    if a.format == "terminal":
        print(reports.terminal(result.findings, a.most))
    elif a.format == "html":
        print(reports.html(result.findings, a.most))
    elif a.format == "sarif":
        _print(reports.sarif(result.findings, result.paths))
    else:
        _print(reports.as_json(result.findings))
    return int(result.failed.first()["failed"])


def _fix(a: argparse.Namespace) -> int:
    """Safe rewrites of the sources under a path: their diff, and unless it's a dry run the new texts, each written by its task."""
    files = readers.source_files(_session(), a.path)
    found = scan(files, Config(detectors=("patterns",), framework=a.framework)).findings
    changed = rewrites.with_diffs(rewrites.rewritten_lines(files, found), F.col("file"))
    for r in changed.select("file", "diff").orderBy("file").toLocalIterator():
        print(r["diff"], end="")
    if not a.dry_run:
        reports.write_texts(changed, a.path)
    return 0


def _sbom(a: argparse.Namespace) -> int:
    parts = deps.components(readers.lock_packages(_session(), a.path))
    _print({"cyclonedx": reports.cyclonedx, "spdx": reports.spdx}[a.format](parts, os.path.basename(os.path.abspath(a.path))))
    return 0


def _rules(a: argparse.Namespace) -> int:
    for r in sorted(PACK.values(), key=lambda r: (-RANK[r.severity], r.rule_id)):
        print(f"{r.severity:>8}  {r.rule_id}")
    return 0


def _explain(a: argparse.Namespace) -> int:
    known = {d[0]: d for d in DIMENSION}
    if a.rule not in known:
        print(f"unknown rule: {a.rule}", file=sys.stderr)
        return 2
    print("\n".join(f"{k}: {v}" for k, v in zip(("rule", "title", "severity", "why", "fix", "cwe"), known[a.rule], strict=True)))
    return 0


def _logs(a: argparse.Namespace) -> int:
    alerts = logs.once_per_source(logs.stateless_alerts(readers.access_log(_session(), a.path).filter("NOT malformed")))
    for r in alerts.groupBy("severity", "rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule").collect():
        print(f"{r['severity']:>8}  {r['rule']}  {r['n']}")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="riskweave")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("path")
    s.add_argument("--format", choices=("terminal", "json", "sarif", "html"), default="terminal")
    for name in ("only", "skip", "disable", "override", "detector", "skip-detector"):
        s.add_argument(f"--{name}", action="append", default=[])
    for name in ("framework", "baseline", "write-baseline", "diff", "pack"):
        s.add_argument(f"--{name}")
    s.add_argument("--min-severity", choices=tuple(RANK), default="info")
    s.add_argument("--fail-on", choices=tuple(RANK), default="high")
    s.add_argument("--quick", action="store_true", help="without the slow detectors")
    s.add_argument("--reachable-only", action="store_true")
    s.set_defaults(run=_scan)
    x = sub.add_parser("fix")
    x.add_argument("path")
    x.add_argument("--framework")
    x.add_argument("--dry-run", action="store_true", help="shows the diff only")
    x.set_defaults(run=_fix)
    b = sub.add_parser("sbom")
    b.add_argument("path")
    b.add_argument("--format", choices=("cyclonedx", "spdx"), default="cyclonedx")
    b.set_defaults(run=_sbom)
    s.add_argument("--most", type=int, default=200, help="findings that the terminal and HTML displays show; JSON and SARIF have them all")
    sub.add_parser("rules").set_defaults(run=_rules)
    e = sub.add_parser("explain")
    e.add_argument("rule")
    e.set_defaults(run=_explain)
    g = sub.add_parser("logs")
    g.add_argument("path")
    g.set_defaults(run=_logs)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(a)
