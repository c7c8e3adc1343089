"""Rule packs: a rule is a regular expression with filters, evaluated as one projection over lines or whole files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import explode_lines, fingerprint, glob_regex

#: Lines over this length are left out: they are machine-made, and patterns may backtrack on them.
LONGEST_LINE = 2000
#: A line with this mark is left out.
IGNORE = r"(?i)(risk-ignore|nosec)"
#: Fixed value: files over this many bytes are left out.
LARGEST_FILE = 2_000_000


@dataclass(frozen=True)
class Rule:
    """One pattern. An empty tuple or None sets no condition.

    languages: extensions; frameworks: of the project (an unknown one passes); paths: globs. requires_file must occur
    in the file, exclude_file nowhere in it, and requires_line in the line; exclude_line must not occur in the line (or,
    multiline, in the match), nor exclude_window within window lines on either side.
    """

    rule_id: str
    regex: str
    severity: str = "medium"
    confidence: str = "medium"
    message: str = ""
    languages: tuple[str, ...] = ()
    frameworks: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    requires_file: str | None = None
    exclude_file: str | None = None
    requires_line: str | None = None
    exclude_line: str | None = None
    exclude_window: str | None = None
    window: int = 4
    multiline: bool = False
    techniques: tuple[str, ...] = field(default=())


def load_pack(entries: list[dict]) -> tuple[list[Rule], list[str]]:
    """Rules from parsed YAML or JSON, and a warning for each entry that was left out."""
    known = {f.name for f in fields(Rule)}
    rules, warnings = [], []
    for n, entry in enumerate(entries):
        try:
            rule = Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in entry.items() if k in known})
            for pattern in (rule.regex, rule.requires_file, rule.exclude_file, rule.requires_line, rule.exclude_line, rule.exclude_window):
                re.compile(pattern or "")
            rules.append(rule)
        except (TypeError, re.error, AttributeError) as e:
            warnings.append(f"entry {n}: {e}")
    return rules, warnings


#: Signs that are rare enough in text to look for by themselves.
RARE_SIGNS = frozenset("@$`<{")


def required_literals(pattern: str) -> tuple[str, ...]:
    """Lower-case texts of which every match of a pattern holds at least one; empty if that can't be told.

    Of a sequence's parts the one whose shortest text is longest counts; of alternatives all must have some.
    """
    worth = lambda texts: min(map(len, texts))

    def of(parts) -> tuple[str, ...]:
        found, run = [], ""

        def ended() -> None:
            nonlocal run
            if len(run) > 2 or run and set(run) & RARE_SIGNS:
                found.append((run.lower(),))
            run = ""

        for op, value in parts:
            name = str(op)
            if name == "LITERAL" and value < 128:
                run += chr(value)
                continue
            ended()
            inner: tuple[str, ...] = ()
            if name == "SUBPATTERN":
                inner = of(value[-1])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                inner = of(value[2])
            elif name == "ATOMIC_GROUP":
                inner = of(value)
            elif name == "BRANCH":
                each = [of(b) for b in value[1]]
                inner = tuple(x for e in each for x in e) if all(each) else ()
            if inner:
                found.append(inner)
        ended()
        return max(found, key=worth, default=())

    return tuple(sorted(set(of(re._parser.parse(pattern)))))


def _applies(rule: Rule, columns: list[str], framework: str | None) -> Column | None:
    """The file-level condition of a rule; None if it can't apply. A look for the pattern's literals comes first: most files hold none of them."""
    if rule.frameworks and framework not in (None, "unknown", *rule.frameworks):
        return None
    ok = F.lit(True)
    if literals := required_literals(rule.regex):
        ok &= reduce(lambda a, b: a | b, [F.contains(F.lower("text"), F.lit(x)) for x in literals])
    if rule.languages and "ext" in columns:
        ok &= F.col("ext").isin(*rule.languages)
    if rule.paths and "file" in columns:
        any_path = F.lit(False)
        for g in rule.paths:
            any_path |= F.col("file").rlike(glob_regex(g))
        ok &= any_path
    if rule.requires_file:
        ok &= F.col("text").rlike(rule.requires_file)
    if rule.exclude_file:
        ok &= ~F.col("text").rlike(rule.exclude_file)
    return ok


def line_findings(files: DataFrame, rules: list[Rule], framework: str | None = None, key: str = "file") -> DataFrame:
    """rule_id, file, line, column, code_snippet, confidence, severity, rule_ord, fingerprint: the first match of each rule in each line.

    All rules are one projection over each line, exploded where they hit, so a corpus is read and cut into lines once.
    What a rule asks of the whole file is decided before the lines are cut, its pattern's literals first, and files in
    which no rule can match aren't cut at all.
    """
    rules = [r for r in rules if not r.multiline]
    chosen = [(k, r, c) for k, r in enumerate(rules) if (c := _applies(r, files.columns, framework)) is not None]
    src = files.select(F.col(key).alias("file"), "text", F.array(*[c for *_, c in chosen]).alias("on")) if chosen else files.select(F.col(key).alias("file"), "text", F.array().cast("array<boolean>").alias("on"))
    # Outer, and filtered on what comes out: a filter on what the files' conditions say would be moved below them and judge each file twice.
    lines = src.select("file", "on", F.posexplode_outer(F.when(F.exists("on", lambda x: x), F.split("text", "\n"))).alias("i", "line_text")).filter("i IS NOT NULL").withColumn("line", F.col("i") + 1)
    windows = {(r.exclude_window, r.window): None for _, r, _ in chosen if r.exclude_window}
    for n, (pattern, size) in enumerate(windows):
        near = Window.partitionBy("file").orderBy("line").rowsBetween(-size, size)
        lines = lines.withColumn(f"near{n}", F.max(F.col("line_text").rlike(pattern)).over(near))
    near_column = {w: f"near{n}" for n, w in enumerate(windows)}

    def hit(at: int, k: int, r: Rule) -> Column:
        found = F.col("on")[at] & F.col("line_text").rlike(r.regex)
        if r.requires_line:
            found &= F.col("line_text").rlike(r.requires_line)
        if r.exclude_line:
            found &= ~F.col("line_text").rlike(r.exclude_line)
        if r.exclude_window:
            found &= ~F.col(near_column[r.exclude_window, r.window])
        column = F.regexp_instr(F.col("line_text"), F.lit(r.regex))
        return F.when(found, F.struct(F.lit(r.rule_id).alias("rule_id"), column.alias("column"), F.lit(r.confidence).alias("confidence"), F.lit(r.severity).alias("severity"), F.lit(k).alias("rule_ord")))

    fits = (F.length("line_text") <= LONGEST_LINE) & ~F.col("line_text").rlike(IGNORE)
    hits = [hit(at, k, r) for at, (k, r, _) in enumerate(chosen)]
    if not hits:
        hits = [F.lit(None).cast("struct<rule_id:string,column:int,confidence:string,severity:string,rule_ord:int>")]
    # A nested condition, for the order of a filter's parts isn't promised and long lines must not reach the patterns.
    found = lines.select("file", "line", "line_text", F.explode(F.when(fits, F.array_compact(F.array(*hits))).otherwise(F.array().cast("array<struct<rule_id:string,column:int,confidence:string,severity:string,rule_ord:int>>"))).alias("h"))
    return found.select(
        "h.rule_id", "file", "line", "h.column", F.trim("line_text").alias("code_snippet"), "h.confidence", "h.severity", "h.rule_ord",
        fingerprint(F.col("h.rule_id"), F.col("file"), F.col("line"), F.col("line_text")).alias("fingerprint"),
    )


_MATCHES = pa.schema([("file", pa.string()), ("rule_id", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("code_snippet", pa.string()), ("confidence", pa.string()), ("severity", pa.string()), ("rule_ord", pa.int32())])


def multiline_findings(files: DataFrame, rules: list[Rule], framework: str | None = None, key: str = "file") -> DataFrame:
    """All matches of multiline rules over whole texts: Spark has no function for every match's place, so Python finds them.

    The snippet is the match if it has at most 200 characters, else its first line; only exclude_line applies, to the match.
    """
    chosen = [(k, r, c) for k, r in enumerate(rules) if r.multiline and (c := _applies(r, files.columns, framework)) is not None]
    if not chosen:
        return files.limit(0).select(F.lit("").alias("file"), F.lit("").alias("rule_id"), F.lit(0).alias("line"), F.lit(0).alias("column"), F.lit("").alias("code_snippet"), F.lit("").alias("confidence"), F.lit("").alias("severity"), F.lit(0).alias("rule_ord"), F.lit("").alias("fingerprint"))
    # The same pattern as a native filter keeps texts without a match in the JVM.
    any_hit = F.lit(False)
    for _, r, c in chosen:
        any_hit |= c & F.col("text").rlike(r.regex)
    src = files.filter(any_hit).select(F.col(key).cast("string").alias("file"), "text", F.array(*[c for *_, c in chosen]).alias("on"))
    specs = [(k, r.rule_id, r.regex, r.exclude_line, r.confidence, r.severity) for k, r, _ in chosen]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(k, i, re.compile(p), re.compile(x) if x else None, c, s) for k, i, p, x, c, s in specs]
        for b in batches:
            out = []
            for file, text, on in zip(*(b.column(n).to_pylist() for n in ("file", "text", "on")), strict=True):
                for ok, (k, rule, pattern, exclude, confidence, severity) in zip(on, compiled, strict=True):
                    for m in pattern.finditer(text) if ok else ():
                        if exclude and exclude.search(m[0]):
                            continue
                        start = text.rfind("\n", 0, m.start()) + 1
                        line = text[start : (text.find("\n", m.start()) + 1 or len(text) + 1) - 1]
                        out.append((file, rule, text.count("\n", 0, m.start()) + 1, m.start() - start + 1, (m[0] if len(m[0]) <= 200 else line).strip(" "), confidence, severity, k))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(_MATCHES)], schema=_MATCHES)

    found = src.mapInArrow(rows, "file string, rule_id string, line int, column int, code_snippet string, confidence string, severity string, rule_ord int")
    return found.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("file"), F.col("line"), F.col("code_snippet")))


def findings_of(files: DataFrame, rules: list[Rule], framework: str | None = None, key: str = "file", longest: int = LARGEST_FILE) -> DataFrame:
    """Line and multiline findings of files within the size limit."""
    fit = files.filter(F.octet_length("text") <= longest)
    lines = line_findings(fit, rules, framework, key).withColumn("file", F.col("file").cast("string"))
    if not any(r.multiline for r in rules):
        return lines
    return lines.unionByName(multiline_findings(fit, rules, framework, key))


def lines_of(files: DataFrame, key: str = "file") -> DataFrame:
    return explode_lines(files, key)
