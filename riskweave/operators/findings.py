"""What happens to findings: enrichment, controls, de-duplication, baselines, counts, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import RANK, SEVERITIES, dev_only, severity_name, severity_rank


def enrich(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds what a finding lacks from the rule dimension (rule_id, title, severity, why, fix, cwe); an unknown rule has its id as title and medium severity.

    The dimension is a rule pack, some hundred rows whatever the corpus; Spark broadcasts it by its size.
    """
    r = rules.select(F.col("rule_id").alias("r_id"), *[F.col(c).alias(f"r_{c}") for c in ("title", "severity", "why", "fix", "cwe") if c in rules.columns])
    out = findings.join(r, F.col("rule_id") == F.col("r_id"), "left")
    for c in ("title", "severity", "why", "fix", "cwe"):
        if f"r_{c}" in out.columns:
            own = F.nullif(F.col(c), F.lit("")) if c in findings.columns else F.lit(None).cast("string")
            default = {"title": F.col("rule_id"), "severity": F.lit("medium")}.get(c, F.lit(None).cast("string"))
            out = out.withColumn(c, F.coalesce(own, F.col(f"r_{c}"), default))
    return out.drop("r_id", *[c for c in out.columns if c.startswith("r_")])


def merged_rules(*sources: DataFrame) -> DataFrame:
    """One row a rule_id; a later source wins."""
    all_rules = None
    for n, s in enumerate(sources):
        s = s.withColumn("source_priority", F.lit(n))
        all_rules = s if all_rules is None else all_rules.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy("rule_id").orderBy(F.desc("source_priority"))
    return all_rules.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def with_techniques(findings: DataFrame, bridge: DataFrame) -> DataFrame:
    """Adds attack array<string> from (rule_id, technique_id), sorted; empty if none."""
    grouped = bridge.groupBy(F.col("rule_id").alias("b_id")).agg(F.array_sort(F.collect_set("technique_id")).alias("attack"))
    return findings.join(grouped, F.col("rule_id") == F.col("b_id"), "left").drop("b_id").withColumn("attack", F.coalesce("attack", F.array().cast("array<string>")))


def capped_dev_only(findings: DataFrame) -> DataFrame:
    """Findings over low in code that isn't shipped become low; original_severity keeps what they were."""
    cap = dev_only(F.col("file")) & (severity_rank(F.col("severity")) > RANK["low"])
    return findings.withColumn("original_severity", F.when(cap, F.col("severity"))).withColumn("severity", F.when(cap, F.lit("low")).otherwise(F.col("severity")))


def controlled(findings: DataFrame, disabled: list[str] = (), overrides: dict[str, str] | None = None) -> DataFrame:
    """Without disabled rules, and with severities set by rule."""
    out = findings.filter(~F.col("rule_id").isin(*disabled)) if disabled else findings
    for rule, severity in (overrides or {}).items():
        out = out.withColumn("severity", F.when(F.col("rule_id") == rule, F.lit(severity)).otherwise(F.col("severity")))
    return out


def first_of_each(findings: DataFrame, order: list[Column]) -> DataFrame:
    """One row a fingerprint: the first in order."""
    w = Window.partitionBy("fingerprint").orderBy(*order)
    return findings.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    return findings.filter(severity_rank(F.col("severity")) >= RANK[severity])


def ranked(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """Worst first; those proven unreachable last of each severity; then by place."""
    dead = (~F.col("reachable")) if "reachable" in findings.columns else F.lit(False)
    out = findings.orderBy(F.desc(severity_rank(F.col("severity"))), F.coalesce(dead, F.lit(False)), "file", "line", "fingerprint")
    return out.limit(limit) if limit else out


def severity_counts(findings: DataFrame) -> DataFrame:
    """severity, n: a row for each severity, with none as 0."""
    spark = findings.sparkSession
    dim = spark.createDataFrame([(s, r) for s, r, _ in SEVERITIES], "severity string, rank int")
    counts = findings.groupBy(severity_name(severity_rank(F.col("severity"))).alias("s")).agg(F.count("*").alias("c"))
    return dim.join(F.broadcast(counts), F.col("severity") == F.col("s"), "left").select("severity", "rank", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def gate(findings: DataFrame, severity: str) -> DataFrame:
    """One row: whether any finding is at least this severe."""
    return findings.agg(F.coalesce(F.bool_or(severity_rank(F.col("severity")) >= RANK[severity]), F.lit(False)).alias("failed"))


def not_in_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def in_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_semi")


def in_diff(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings on changed lines, and those of whole files (line <= 0) that changed. changed: file, line."""
    on_line = findings.filter("line > 0").join(changed.select("file", "line").distinct(), ["file", "line"], "left_semi")
    on_file = findings.filter("line <= 0").join(changed.select("file").distinct(), "file", "left_semi")
    return on_line.unionByName(on_file.select(on_line.columns))


def technique_counts(findings: DataFrame) -> DataFrame:
    """technique_id, n, rules (sorted), share of the most frequent."""
    each = findings.select("rule_id", F.explode("attack").alias("technique_id")).groupBy("technique_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("rule_id")).alias("rules"))
    top = each.agg(F.max("n").alias("top"))
    return each.crossJoin(F.broadcast(top)).select("technique_id", "n", "rules", "top")  # top is one row


def escalated(findings: DataFrame) -> DataFrame:
    """Data-flow findings whose secret asset is in client-reachable code become critical, with their blast radius: a secret of the server's environment crosses to the client, a credential is in its bundle."""
    hit = F.col("rule_id").startswith("dataflow.") & F.col("data_asset").isin("secret.env", "secret.credential") & (F.col("reach_kind") == "client") & F.col("reachable")
    return findings.withColumn("severity", F.when(hit, F.lit("critical")).otherwise(F.col("severity"))).withColumn("blast_radius", F.when(hit, F.struct(F.when(F.col("data_asset") == "secret.env", "server->client").otherwise("into-client-bundle").alias("boundary"), F.col("data_asset").alias("asset"))))
