"""The scan: all detectors, enrichment, controls, de-duplication, reachability, escalation and paths, as one lazy plan.

The order is part of the meaning: overrides come after the cap on unshipped code and may raise a severity again, and
the least severity is applied before escalation, so what it drops doesn't come back.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import findings as fi
from ..operators import graph, paths
from ..operators.rules import Rule
from ..sources.shared import staged
from .detectors import Inputs, found_by
from .packs import WEB_RULES, bridge, dimension


@dataclass
class Config:
    """only, skip: families of rules (the id up to the first dot); detectors, skip_detectors: names of plans.detectors; quick: without the slow ones."""

    only: tuple[str, ...] = ()
    skip: tuple[str, ...] = ()
    detectors: tuple[str, ...] = ()
    skip_detectors: tuple[str, ...] = ()
    quick: bool = False
    min_severity: str = "info"
    disabled: tuple[str, ...] = ()
    overrides: dict[str, str] = field(default_factory=dict)
    framework: str | None = None
    reachable_only: bool = False
    fail_on: str = "high"
    rules: tuple[Rule, ...] = tuple(WEB_RULES)


class Result:
    """What a scan found; paths are put together and written when they are first asked for."""

    def __init__(self, found: DataFrame, fail_on: str):
        self._found = found
        self.findings, self.counts, self.failed = fi.ranked(found), fi.severity_counts(found), fi.gate(found, fail_on)

    @cached_property
    def paths(self) -> DataFrame:
        return staged(paths.suppressed(paths.scored_paths(paths.candidate_paths(self._found), self._found)), "paths")

    @cached_property
    def steps(self) -> DataFrame:
        return paths.path_steps(self.paths, self._found)


def chosen(config: Config) -> list[Rule]:
    """Rules whose family (the id up to the first dot) is asked for and isn't left out."""
    family = lambda r: r.rule_id.split(".")[0]
    return [r for r in config.rules if (not config.only or family(r) in config.only) and family(r) not in config.skip]


def scan(files: DataFrame, config: Config = Config(), baseline: DataFrame | None = None, changed: DataFrame | None = None, extra: DataFrame | None = None, inputs: Inputs | None = None) -> Result:
    """files: file, ext, text (see sources.readers.source_files). inputs: tables besides the files; extra: findings of other detectors, in the same columns.

    Findings are written once to the shared folder: findings, paths, their steps, counts and the gate read them from there.
    """
    spark = files.sparkSession
    given = replace(inputs, files=files) if inputs else Inputs(files)
    found = found_by(replace(given, rules=tuple(chosen(config)), framework=config.framework), config.detectors, config.skip_detectors, config.quick)
    if extra is not None:
        found = found.unionByName(extra.withColumn("detector_ord", F.lit(-1)), allowMissingColumns=True)
    family = F.substring_index("rule_id", ".", 1)
    if config.only:
        found = found.filter(family.isin(*config.only))
    if config.skip:
        found = found.filter(~family.isin(*config.skip))
    found = fi.with_techniques(fi.enrich(found, dimension(spark)), bridge(spark))
    found = fi.controlled(fi.capped_dev_only(found), list(config.disabled), config.overrides)
    found = fi.first_of_each(found, [F.col("detector_ord"), F.col("rule_ord"), F.col("column")])
    found = fi.at_least(found, config.min_severity)
    # Texts are gone through once for both; a filter on kinds can't go with it to where the texts come from.
    outline = staged(files.select("file", graph.entry_kind(F.col("file"), F.col("text"), config.framework).alias("kind"), graph.import_specs(F.col("text")).alias("specs")), "outline")
    entries = outline.filter("kind IS NOT NULL").select(F.col("file").alias("rel"), "kind")
    has_entries = not entries.isEmpty()
    reached = graph.reach(entries, graph.links(outline)) if has_entries else None
    found = fi.escalated(graph.annotated(found, reached, has_entries))
    if config.reachable_only:
        found = found.filter(F.coalesce("reachable", F.lit(True)))
    if changed is not None:
        found = fi.in_diff(found, changed)
    if baseline is not None:
        found = fi.not_in_baseline(found, baseline)
    return Result(staged(found, "findings"), config.fail_on)
