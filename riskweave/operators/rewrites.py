"""Safe rewrites: changes of a line or a file that only add something, their diffs, and a check of what they mended.

Which lines change is a matter of findings; what they become is an expression over the file's text. A diff is made for
changed files alone, line by line in step (lines are replaced or added at the end, never moved), so its work grows with the text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Rules with a safe rewrite: a line (given by the finding) that matches `unless` stays, else the first match of `what` is followed by `added`.
LINE_REWRITES = {
    "react.unsafe-target-blank": {"what": r"target\s*=\s*[\"']_blank[\"']", "unless": r"\brel\s*=", "added": ' rel="noopener noreferrer"'},
}
# What an ignore file must name so that environment files aren't committed.
IGNORED = (".env", ".env.local", ".env.*.local")
#: The comment above what is added to an ignore file.
NOTE = "# Added by a safe rewrite: environment files that hold secrets stay out"
CONTEXT = 3


def _rewritten(line: Column, rule: str) -> Column:
    r = LINE_REWRITES[rule]
    return F.when(line.rlike(r["unless"]), line).otherwise(F.regexp_replace(line, rf"(?s)^(.*?{r['what']})", "$1" + r["added"].replace("$", r"\$")))


def _lines_of(rule: str) -> Column:
    return F.transform(F.filter("asked", lambda a: a["rule_id"] == rule), lambda a: a["line"])


def _replaced(lines: Column, asked: Column, rule: str) -> Column:
    """Lines, those asked for rewritten."""
    return F.transform(lines, lambda line, i: F.when(F.array_contains(asked, (i + 1).cast("int")), _rewritten(line, rule)).otherwise(line))


def rewritten_lines(files: DataFrame, findings: DataFrame) -> DataFrame:
    """file, before, after, lines (array of rule_id, line, in order): files (file, text) that the rewrites of these findings (rule_id, file, line) change.

    A line that needs no change, lies outside the file or belongs to a rule without a rewrite stays as it is; a finding
    given twice counts once. Files without a text have no row. A file given twice has two rows.
    """
    asked = findings.filter(F.col("rule_id").isin(*LINE_REWRITES)).groupBy(F.col("file").alias("f_file")).agg(F.collect_set(F.struct("rule_id", F.col("line").cast("int").alias("line"))).alias("asked"))
    df = files.filter("text IS NOT NULL").select("file", "text").join(asked, F.col("file") == F.col("f_file")).withColumn("old", F.split("text", "\n"))
    out = F.col("old")
    for n, rule in enumerate(LINE_REWRITES):
        df = df.withColumn(f"lines_{n}", _lines_of(rule))
        out = _replaced(out, F.col(f"lines_{n}"), rule)
    df = df.withColumn("new", out)
    changed = F.filter(F.array_sort("asked"), lambda a: F.coalesce(F.get("old", a["line"] - 1) != F.get("new", a["line"] - 1), F.lit(False)))
    return df.select("file", F.col("text").alias("before"), F.array_join("new", "\n").alias("after"), changed.alias("lines")).filter("size(lines) > 0")


def hardened_ignores(findings: DataFrame, ignores: DataFrame) -> DataFrame:
    """project, before, after, added: ignore files (project, text) of projects with a secret finding (project, rule_id, file) in an environment file.

    A project without an ignore file, or with a null text, gets one. A file that names .env by itself is left alone. A project's
    repeated files count as the first by text. Null projects are a project.
    """
    leaky = findings.filter(F.col("rule_id").startswith("secret.") & F.col("file").rlike(r"(^|/)\.env")).select(F.col("project").alias("project")).distinct()
    own = ignores.groupBy(F.col("project").alias("i_project")).agg(F.min("text").alias("text"))
    df = leaky.join(own, F.col("project").eqNullSafe(F.col("i_project")), "left").withColumn("before", F.coalesce("text", F.lit("")))
    there = F.transform(F.split("before", "\n"), lambda line: F.regexp_replace(line, r"^\s+|\s+$", ""))
    df = df.withColumn("added", F.array_except(F.array(*[F.lit(x) for x in IGNORED]), there)).filter(F.array_contains("added", IGNORED[0]))
    open_end = F.when((F.col("before") != "") & ~F.col("before").endswith("\n"), "\n").otherwise("")
    return df.select("project", "before", F.concat("before", open_end, F.lit(f"\n{NOTE}\n"), F.array_join("added", "\n"), F.lit("\n")).alias("after"), "added")


def line_diff(before: str, after: str, name: str, context: int = CONTEXT) -> str:
    """The unified diff of two texts of which the second has replaced lines, or more or fewer of them at the end; empty if they are equal."""
    a, b = re.findall(r"[^\n]*\n|[^\n]+", before), re.findall(r"[^\n]*\n|[^\n]+", after)
    both = min(len(a), len(b))
    runs: list[list[int]] = []  # begin, end in a, end in b
    for i in range(both):
        if a[i] != b[i]:
            if runs and runs[-1][1] == i:
                runs[-1][1:] = [i + 1, i + 1]
            else:
                runs.append([i, i + 1, i + 1])
    if len(a) != len(b):
        if runs and runs[-1][1] == both:
            runs[-1][1:] = [len(a), len(b)]
        else:
            runs.append([both, len(a), len(b)])
    if not runs:
        return ""
    hunks: list[list[list[int]]] = []
    for r in runs:
        if hunks and r[0] - hunks[-1][-1][1] <= 2 * context:
            hunks[-1].append(r)
        else:
            hunks.append([r])
    line = lambda sign, text: sign + text if text.endswith("\n") else f"{sign}{text}\n\\ No newline at end of file\n"
    span = lambda start, n: f"{start + (n > 0)}" + ("" if n == 1 else f",{n}")
    out = [f"--- a/{name}\n+++ b/{name}\n"]
    for h in hunks:
        start, end = max(0, h[0][0] - context), min(len(a), h[-1][1] + context)
        grown = h[-1][2] - h[-1][1]
        out.append(f"@@ -{span(start, end - start)} +{span(start, end - start + grown)} @@\n")
        at = start
        for x, y, z in h:
            out += [line(" ", t) for t in a[at:x]] + [line("-", t) for t in a[x:y]] + [line("+", t) for t in b[x:z]]
            at = y
        out += [line(" ", t) for t in a[at:end]]
    return "".join(out)


def _diffs(before: pd.Series, after: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([line_diff(x, y, n) for x, y, n in zip(before, after, name, strict=True)], dtype=object)


def with_diffs(changed: DataFrame, name: Column) -> DataFrame:
    """Adds diff, for people and for patch tools, to rows with before and after; what a dry run shows."""
    return changed.withColumn("diff", pandas_udf(_diffs, "string")("before", "after", F.coalesce(name, F.lit(""))))


def after_rewrites(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files with the texts of rewritten_lines(): every row stays, with its other columns."""
    new = changed.select(F.col("file").alias("c_file"), F.col("before").alias("c_before"), F.col("after").alias("c_after")).distinct()
    joined = files.join(new, (F.col("file") == F.col("c_file")) & (F.col("text") == F.col("c_before")), "left")
    return joined.withColumn("text", F.coalesce("c_after", "text")).drop("c_file", "c_before", "c_after")
