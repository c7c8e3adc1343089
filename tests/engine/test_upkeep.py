import difflib
import os
import random
import subprocess
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from riskweave.operators import arguments, dataflow, monitor, rewrites


@pytest.mark.parametrize("before,after", [("a\nb\n", "a\nc\n"), ("a", "b"), ("", "x\ny\n"), ("a\n", "a\n"), ("a", "a\nb\n"), ("a\nb\nc\nd\ne\nf\ng\nh\ni\n", "A\nb\nc\nd\ne\nf\ng\nH\nI\nj"), ("x\r\ny\n", "x\r\nz\n"), ("a\nb\nc\n", "a\n")])
def test_diff_can_be_applied(tmp_path, before, after):
    diff = rewrites.line_diff(before, after, "f.txt")
    assert (diff == "") == (before == after)
    (tmp_path / "f.txt").write_bytes(before.encode())
    if diff:
        subprocess.run(["git", "apply", "--whitespace=nowarn", "-"], input=diff.encode(), cwd=tmp_path, check=True, env=os.environ | {"GIT_CEILING_DIRECTORIES": str(tmp_path.parent)})
    assert (tmp_path / "f.txt").read_bytes().decode() == after


def test_diff_equals_the_common_one():
    rng = random.Random(1)
    for _ in range(200):
        a = [f"l{i}\n" for i in range(rng.randrange(1, 40))]
        b = [f"x{i}\n" if rng.random() < 0.15 else t for i, t in enumerate(a)] + ["more\n"] * rng.randrange(3)
        assert rewrites.line_diff("".join(a), "".join(b), "n") == "".join(difflib.unified_diff(a, b, "a/n", "b/n"))


def test_rewrites_of_odd_rows(spark):
    blank = "<a target='_blank'>"
    files = spark.createDataFrame([("a", f"{blank}\nx", 1), ("b", None, 2), ("c", "", 3), (None, blank, 4), ("d", blank, 5), ("d", blank, 6)], "file string, text string, before int")
    asked = spark.createDataFrame([("react.unsafe-target-blank", f, n) for f, n in (("a", 1), ("a", 1), ("a", 2), ("a", 99), ("a", 0), ("b", 1), ("c", 1), (None, 1), ("d", 1), ("gone", 1))] + [("other", "a", 1), (None, "a", 1)], "rule_id string, file string, line int")
    out = rewrites.rewritten_lines(files, asked)
    got = sorted((r["file"], r["after"], [x["line"] for x in r["lines"]]) for r in out.collect())
    fixed = blank.replace(">", ' rel="noopener noreferrer">')
    assert got == [("a", fixed + "\nx", [1]), ("d", fixed, [1]), ("d", fixed, [1])]
    assert rewrites.with_diffs(out.filter("file = 'a'"), F.col("file")).first()["diff"].startswith("--- a/a\n+++ b/a\n@@ -1,2 +1,2 @@\n")
    after = rewrites.after_rewrites(files, out).select("before", "text").collect()
    assert sorted((r[0], r[1]) for r in after if r[1] is not None) == [(1, fixed + "\nx"), (3, ""), (4, blank), (5, fixed), (6, fixed)] and len(after) == 6
    assert rewrites.rewritten_lines(files.limit(0), asked).count() == 0 and rewrites.rewritten_lines(files, asked.limit(0)).count() == 0


def test_hardened_ignores_of_odd_rows(spark):
    found = spark.createDataFrame([("p", "secret.x", ".env"), ("p", "secret.x", "a/.env"), (None, "secret.x", ".env"), ("q", None, ".env"), ("r", "secret.x", None)], "project string, rule_id string, file string")
    ignores = spark.createDataFrame([("p", "b"), ("p", "a"), ("p", None), (None, None)], "project string, text string")
    got = {r["project"]: r["before"] for r in rewrites.hardened_ignores(found, ignores).collect()}
    assert got == {"p": "a", None: ""}


def test_times_of_scans(spark):
    texts = ["2024-01-01T00:00:00Z", "2024-01-01T02:00:00+02:00", "2024-01-01T00:00:00", "2024-01-01 00:00:00", "2024-01-01", "", "x", "24", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_seconds(monitor.scanned_at(F.col("t"))).alias("s"))
    assert [r["s"] for r in df.collect()] == [1704067200] * 5 + [None] * 4


def test_state_of_projects(spark):
    at = datetime(2024, 1, 1)
    scans = spark.createDataFrame([("p", k, at) for k in range(60)] + [("p", 59, at), ("empty", 1, None), (None, 1, at)], "project string, scan int, at timestamp")
    found = spark.createDataFrame([("p", 58, "x", "a"), ("p", 58, "x", "b"), ("p", 59, "ai.tool-ssrf", "b"), ("p", 59, "ai.tool-ssrf", "b"), ("p", 77, "x", "z"), ("gone", 1, "x", "a"), (None, 1, None, None)], "project string, scan int, rule_id string, fingerprint string")
    got = {r["project"]: r for r in monitor.project_state(scans, found).collect()}
    assert set(got) == {"p", "empty", None}
    p = got["p"]
    assert (p["scans"], p["total"], p["new"], p["fixed"], p["agent_total"], p["agent_chains"]) == (60, 2, 0, 1, 2, 0) and [t["total"] for t in p["trend"]] == [0] * 38 + [2, 2]
    assert (got["empty"]["total"], got["empty"]["new"], len(got["empty"]["trend"])) == (0, None, 1) and got[None]["total"] == 1
    assert monitor.project_state(scans.limit(0), found).count() == 0


def told(spark, *texts):
    files = spark.createDataFrame([(f"{i}.ts", t) for i, t in enumerate(texts)], "file string, text string")
    return sorted((int(r["file"][:-3]), r["line"], r["rule_id"], r["confidence"]) for r in arguments.argument_findings(dataflow.Program(files)).collect())


def test_argument_checks_of_odd_rows(spark):
    texts = [
        "eval(a); eval(req.query.b)", "eval()", "a.insertAdjacentHTML(x)", "res.redirect()", "eval(\n  req.body.x,\n)", "eval((\n'a'))", None, "", "exec(cmd)", "exec(cmd + ' x')", "el.innerHTML += a", "fetch(`${location.hash}`)", "x" * 401 + "\neval(a)", "eval(a)" + " " * 400,
        "/* eval(a) */ `eval(${b})` // eval(c)", "el.innerHTML == a", "exec(['a'])",
    ]
    assert told(spark, *texts) == [
        (0, 1, "injection.eval", "high"), (2, 1, "xss.inner-html", "medium"), (4, 1, "injection.eval", "high"), (9, 1, "injection.command", "medium"), (10, 1, "xss.inner-html", "medium"), (11, 1, "ssrf.fetch", "medium"), (12, 2, "injection.eval", "medium"),
    ]
    assert told(spark) == []
