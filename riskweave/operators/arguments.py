"""Checks of what a call, an assignment or an attribute gets, by its form alone: no data flow, seven kinds, over facts of syntax.py.

An argument that is a literal is fine. Otherwise it's told, with high confidence if it names a part of a request, and with
what the kind itself is worth if not. Lines over LONGEST characters are taken for generated code and passed over.
All of it is conditions on rows of facts: nothing is read again, and only findings meet the long lines, by file and line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fingerprint, host_is_dynamic
from ..sources.shared import staged
from .dataflow import Program

#: Fixed value: characters of the longest line that is looked at.
LONGEST = 400
# What names a part of a request, and functions that run a command or send a request.
HINT = r"\b(?:req(?:uest)?\.(?:query|body|params|cookies|headers|url)|request\.(?:nextUrl|url|headers|cookies)|searchParams|ctx\.query|location\.(?:href|search|hash|pathname)|window\.location|document\.(?:URL|location|cookie|referrer)|params\.|query\.|process\.argv)"
RUNNERS = ("exec", "execSync", "spawn", "spawnSync", "execFile", "execFileSync")
SENDERS = ("get", "post", "put", "delete", "patch", "request", "head")

#: A text put together: a template with a hole, or a quoted text beside a plus.
BUILT = r"`(?:[^`\\]|\\.)*\$\{[^}]+\}|['\"]\s*\+|\+\s*['\"]"
#: A path on the same host as an URL.
SAME_HOST = r"new\s+URL\s*\(\s*['\"`](?:\.\.?)?/"


def _kinds() -> list[tuple[str, Column, Column, str, str]]:
    """rule_id, which facts, which of their values count (besides not being literal), confidence without a hint, message."""
    prop, root, size = F.element_at("parts", -1), F.col("parts")[0], F.size("parts")
    arg, last = F.col("kind") == "arg", F.col("ord") == F.col("extra")[2].cast("int") - 1
    first, bare, member = arg & (F.col("ord") == 0), size == 1, size > 1
    second = arg & (F.col("ord") == F.least(F.lit(1), F.col("extra")[2].cast("int") - 1))
    any_value, hinted = F.lit(True), F.col("value").rlike(HINT)
    return [
        ("xss.dangerously-set-inner-html", (F.col("kind") == "attr") & (F.col("name") == "dangerouslySetInnerHTML") & (F.col("extra")[0] == "__html"), any_value, "medium", "raw HTML is set from a value that isn't literal"),
        ("xss.inner-html", (F.col("kind") == "field") & prop.isin("innerHTML", "outerHTML"), any_value, "medium", "raw HTML is assigned from a value that isn't literal"),
        ("xss.inner-html", second & member & (prop == "insertAdjacentHTML"), any_value, "medium", "raw HTML is inserted from a value that isn't literal"),
        ("xss.inner-html", first & (size == 2) & (root == "document") & prop.isin("write", "writeln"), any_value, "low", "a value that isn't literal is written into the page"),
        ("injection.eval", first & bare & prop.isin("eval", "Function"), any_value, "medium", "a value that isn't literal is run as code"),
        ("injection.command", first & prop.isin(*RUNNERS), F.col("value").rlike(BUILT) | hinted, "medium", "a command is put together from values"),
        ("open-redirect", arg & last & member & (prop == "redirect"), ~F.col("value").rlike(SAME_HOST), "low", "the target of a redirect isn't literal"),
        ("ssrf.fetch", first & ((bare & prop.isin("fetch", "axios")) | ((size == 2) & (root == "axios") & prop.isin(*SENDERS))), hinted & host_is_dynamic(F.col("value")), "", "the host of a request on the server comes from a request"),
    ]


def _plain() -> Column:
    """A literal as such. A text within brackets is one too; an empty value has nothing to judge."""
    return F.col("shape").isin("literal", "function") | (F.col("value") == "")


def argument_findings(p: Program) -> DataFrame:
    """rule_id, file, line, column, code_snippet, confidence, message, fingerprint: a row for each rule, file and line (the surest, then the first in the line).

    No row for files without a text, for calls without arguments and for what is in comments and texts. A null file counts as any other.
    Arguments are judged once for each text and then handed out to its files.
    """
    hint = F.col("value").rlike(HINT)
    some = p.facts.filter(F.col("kind").isin("arg", "field", "attr") & (F.size("parts") > 0) & ~_plain())
    each = [F.when(which & values, F.struct(F.lit(rule).alias("rule_id"), F.when(hint, "high").otherwise(F.lit(sure)).alias("confidence") if sure else F.lit("medium").alias("confidence"), F.lit(said).alias("message"))) for rule, which, values, sure, said in _kinds()]
    found = some.select("file", "line", "column", F.col("code").alias("code_snippet"), F.explode(F.array_compact(F.array(*each))).alias("k")).select("file", "line", "column", "code_snippet", "k.*")
    once = _surest(found, F.col("rule_id"), F.col("file"), F.col("line"), F.trim("code_snippet")).withColumnRenamed("file", "id")
    once = once.join(long_lines(p.texts), (once["id"] == F.col("l_file")) & (once["line"] == F.col("l_line")), "left_anti")
    out = staged(once, "judged").join(p.copies, "id").select("rule_id", "file", "line", "column", "code_snippet", "confidence", "message")
    out = out.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("file"), F.col("line"), F.col("code_snippet")))
    return _surest(out, F.col("fingerprint")) if p.nameless or p.repeated is not None else out


def _surest(found: DataFrame, *keys: Column) -> DataFrame:
    """One finding of the same keys: the surest, then the first in the line."""
    rank = F.element_at(F.create_map(*[F.lit(x) for x in ("high", 0, "medium", 1, "low", 2)]), F.col("confidence"))
    return found.groupBy(*[k.alias(f"k{n}") for n, k in enumerate(keys)]).agg(F.min_by(F.struct(*found.columns), F.struct(rank.alias("rank"), "column", "message")).alias("f")).select("f.*")


def long_lines(files: DataFrame) -> DataFrame:
    """l_file, l_line: lines over LONGEST characters; files without one aren't cut."""
    some = files.filter(F.col("text").rlike(f"[^\n]{{{LONGEST + 1}}}")).select(F.col("file").cast("string").alias("l_file"), F.posexplode(F.split("text", "\n")).alias("i", "t"))
    return some.filter(F.length("t") > LONGEST).select("l_file", (F.col("i") + 1).alias("l_line"))
