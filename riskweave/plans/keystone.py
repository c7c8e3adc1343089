"""What a change brings: the scan's paths before and after it, compared by kind and worst band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import severity_rank
from ..operators.history import keystones
from .scan import Config, scan


def kind(path_key):
    """A path's kind: its template and the rules behind it aren't told apart by fingerprints."""
    return F.substring_index(path_key, ":", 1)


def keystone_paths(before: DataFrame, after: DataFrame, config: Config = Config(), changed: DataFrame | None = None, blame: DataFrame | None = None) -> DataFrame:
    """kind, score, band, fingerprints and steps of the paths that are new after a change or rose in band, worst first.

    before, after: files (file, ext, text) of the two versions. steps: each finding's file, line, whether it lies on a
    changed line (changed: file, line), and its author (blame: file, line, author), where given.
    """
    one = scan(before, config)
    two = scan(after, config)
    ranked = lambda df: df.withColumn("kind", kind(F.col("path_key"))).withColumn("band_rank", severity_rank(F.col("band")))
    new = keystones(ranked(one.paths), ranked(two.paths))
    steps = new.select("path_key", F.explode("fingerprints").alias("fingerprint")).join(two.findings.select("fingerprint", "file", "line"), "fingerprint")
    if changed is not None:
        c = changed.select(F.col("file").alias("c_file"), F.col("line").alias("c_line")).distinct()
        steps = steps.join(c, (F.col("file") == F.col("c_file")) & (F.col("line") == F.col("c_line")), "left").withColumn("introduced", F.col("c_file").isNotNull()).drop("c_file", "c_line")
    else:
        steps = steps.withColumn("introduced", F.lit(None).cast("boolean"))
    if blame is not None:
        b = blame.select(F.col("file").alias("b_file"), F.col("line").alias("b_line"), "author")
        steps = steps.join(b, (F.col("file") == F.col("b_file")) & (F.col("line") == F.col("b_line")), "left").drop("b_file", "b_line")
    else:
        steps = steps.withColumn("author", F.lit(None).cast("string"))
    told = steps.groupBy("path_key").agg(F.array_sort(F.collect_list(F.struct("file", "line", "introduced", "author"))).alias("steps"))
    return new.join(told, "path_key").select("kind", "score", "band", "fingerprints", "steps").orderBy(F.desc("score"), "kind")
