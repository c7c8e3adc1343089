"""What a monitor of projects shows: who is due for a scan, the last scans, what changed, the risk of agents, the feed of alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dataflow

# Minutes between scans where nothing is said and at least, points of a trend, and alerts that are kept.
INTERVAL, LEAST_INTERVAL, TREND, FEED = 1440, 5, 40, 200
AGENT_RULES = (*dataflow.AGENT_RULES.values(), dataflow.OUTPUT_RULE, dataflow.CHAIN_RULE)


def scanned_at(text: Column) -> Column:
    """A time in ISO form, in UTC unless it tells its zone; null if it can't be read."""
    zoned = text.rlike(r":.*(Z|[+-][0-9]{2}:?[0-9]{2})$")
    dated = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), text)
    return F.when(zoned, F.try_to_timestamp(dated)).otherwise(F.try_to_timestamp(F.concat(dated, F.when(text.contains(":"), "Z").otherwise("T00:00:00Z"))))


def interval_minutes(minutes: Column) -> Column:
    """The minutes between scans that a project asked for: at least 5, a day where it asked for none."""
    return F.greatest(F.lit(LEAST_INTERVAL), F.coalesce(F.nullif(minutes.cast("int"), F.lit(0)), F.lit(INTERVAL)))


def due(projects: DataFrame, now: Column | None = None) -> DataFrame:
    """Projects (last_scan as text, interval_minutes) whose last scan is as old as their interval, or older; never scanned or at an unreadable time counts as due."""
    now = F.current_timestamp() if now is None else now
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(scanned_at(F.col("last_scan")))
    return projects.filter(F.coalesce(age >= interval_minutes(F.col("interval_minutes")).cast("long") * 60_000_000, F.lit(True)))


def agent_risk(findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, agent_total, agent_chains: findings of models that act, and those in which untrusted content leads to it."""
    own = findings.filter(F.col("rule_id").isin(*AGENT_RULES))
    return own.groupBy(*keys).agg(F.count("*").alias("agent_total"), F.count_if(F.col("rule_id") == dataflow.CHAIN_RULE).alias("agent_chains"))


def project_state(snapshots: DataFrame, findings: DataFrame) -> DataFrame:
    """A row for each project: project, scans, total, new, fixed, agent_total, agent_chains, trend (array of at, total; the last 40, oldest first).

    snapshots: project, scan, at, a row a scan (one without findings too); findings: project, scan, rule_id, fingerprint.
    Scans are in the order of at, then of scan. new and fixed compare the fingerprints of the last scan with those of the
    one before, and are null for a project with one scan. Findings of scans that aren't given don't count.
    """
    s = snapshots.select("project", "scan", "at").dropDuplicates(["project", "scan"])
    back = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("at"), F.desc("scan")))
    s = s.withColumns({"back": back, "scans": F.count("*").over(Window.partitionBy("project"))})
    totals = findings.groupBy(F.col("project").alias("t_project"), F.col("scan").alias("t_scan")).agg(F.count("*").alias("n"))
    counted = s.filter(F.col("back") <= TREND).join(totals, (F.col("project").eqNullSafe(F.col("t_project"))) & (F.col("scan") == F.col("t_scan")), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    points = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("o"), "at", F.col("n").alias("total")))), lambda p: F.struct(p["at"].alias("at"), p["total"].alias("total")))
    shown = counted.groupBy("project").agg(F.max("scans").alias("scans"), F.max(F.when(F.col("back") == 1, F.col("n"))).alias("total"), points.alias("trend"))
    two = findings.alias("f").join(s.filter("back <= 2").select(F.col("project").alias("s_project"), F.col("scan").alias("s_scan"), "back"), (F.col("f.project").eqNullSafe(F.col("s_project"))) & (F.col("f.scan") == F.col("s_scan")))
    sides = two.groupBy("f.project", "f.fingerprint").agg(F.bool_or(F.col("back") == 1).alias("now"), F.bool_or(F.col("back") == 2).alias("was"))
    changes = sides.groupBy(F.col("project").alias("d_project")).agg(F.count_if(F.expr("now AND NOT was")).alias("new"), F.count_if(F.expr("was AND NOT now")).alias("fixed"))
    risk = agent_risk(two.filter("back = 1").select("f.project", "f.rule_id"), ["project"]).withColumnRenamed("project", "r_project")
    out = shown.join(changes, F.col("project").eqNullSafe(F.col("d_project")), "left").join(risk, F.col("project").eqNullSafe(F.col("r_project")), "left")
    several = lambda c: F.when(F.col("scans") > 1, F.coalesce(c, F.lit(0))).alias(c)
    return out.select("project", "scans", "total", several("new"), several("fixed"), F.coalesce("agent_total", F.lit(0)).alias("agent_total"), F.coalesce("agent_chains", F.lit(0)).alias("agent_chains"), "trend")


def feed(alerts: DataFrame, order: list[Column], most: int = FEED) -> DataFrame:
    """The newest alerts of all projects, in order: each task keeps its own first ones, so that no more meet than tasks times `most`."""
    return alerts.orderBy(*order).limit(most)
