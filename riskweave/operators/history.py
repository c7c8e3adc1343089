"""Snapshots over time: differences, retention, alerts, trends, changed hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "fingerprint") -> DataFrame:
    """key, status: new, fixed or persistent; one full outer join of the distinct keys."""
    a = before.select(F.col(key).alias("b")).distinct()
    b = after.select(F.col(key).alias("a")).distinct()
    return a.join(b, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias(key), F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "fixed").otherwise("persistent").alias("status"))


def latest(df: DataFrame, partition: list[str], order: list[Column], n: int) -> DataFrame:
    """The n first rows of each partition in order; Spark drops the rest before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col("place") <= n)


def alerts(findings: DataFrame, previous: DataFrame, first: bool) -> DataFrame:
    """New critical and high findings; on a first scan, critical ones only."""
    levels = ["critical"] if first else ["critical", "high"]
    return findings.filter(F.col("severity").isin(*levels)).join(previous.select("fingerprint").distinct(), "fingerprint", "left_anti")


def changed_hashes(now: DataFrame, before: DataFrame, keys: list[str], hash_column: str) -> DataFrame:
    """Rows of now whose hash differs from before's; keys that before lacks aren't changes, and an empty before gives none."""
    old = before.select(*[F.col(k).alias(f"old_{k}") for k in keys], F.col(hash_column).alias("old_hash"))
    same = None
    for k in keys:
        c = F.col(k) == F.col(f"old_{k}")
        same = c if same is None else same & c
    return now.join(old, same).filter(~F.col(hash_column).eqNullSafe(F.col("old_hash"))).drop(*[f"old_{k}" for k in keys])


def fix_check(before: DataFrame, after: DataFrame, key: str = "rule_id") -> DataFrame:
    """key, before, after: findings counted on both sides (a multiset comparison)."""
    a = before.groupBy(F.col(key).alias("k1")).agg(F.count("*").alias("before"))
    b = after.groupBy(F.col(key).alias("k2")).agg(F.count("*").alias("after"))
    return a.join(b, F.col("k1") == F.col("k2"), "full").select(F.coalesce("k1", "k2").alias(key), F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def keystones(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths of after whose kind is new or whose worst band rose. Both: kind, score, band_rank."""
    old = before.groupBy(F.col("kind").alias("old_kind")).agg(F.max("band_rank").alias("old_rank"))
    return after.join(old, F.col("kind") == F.col("old_kind"), "left").filter(F.col("old_rank").isNull() | (F.col("band_rank") > F.col("old_rank"))).drop("old_kind")
