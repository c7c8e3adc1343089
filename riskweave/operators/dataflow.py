"""What follows from facts of source files: data that reaches a sink, secrets that leave, models that act.

Facts are rows. A sink is a condition on a row; whether something reaches it is in the labels that the row's value
carries. A parameter that reaches a sink makes its function a summary (file, function, number, sink), and calls hand
summaries on to callers: that is repeated, over files, with what was new in the last round only, until nothing is.
"""

from __future__ import annotations

from functools import cached_property, reduce
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fingerprint, host_is_dynamic
from ..sources.shared import staged
from .graph import resolved
from .syntax import facts_of

CARRIED = "array<struct<label:string,what:string,line:int,cls:string>>"
FACTS = f"file string, kind string, line int, column int, name string, parts array<string>, ord int, value string, shape string, scope string, code string, extra array<string>, carried {CARRIED}"
_LABEL = pa.struct([("label", pa.string()), ("what", pa.string()), ("line", pa.int32()), ("cls", pa.string())])
_SCHEMA = pa.schema(
    [("file", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("name", pa.string()), ("parts", pa.list_(pa.string())), ("ord", pa.int32()), ("value", pa.string()), ("shape", pa.string()), ("scope", pa.string()), ("code", pa.string()), ("extra", pa.list_(pa.string()))]
    + [("carried", pa.list_(_LABEL))]
)
#: Rows of facts that are handed over at once, and texts that a task reads.
BATCH, TEXTS_A_TASK = 4096, 4000
#: What a text with facts has: a call, an assignment or markup.
TELLING = r"[(=<]"

# Receivers of requests, of databases and of what others collect; sinks by what is called, assigned or set.
REQUESTERS = ("axios", "http", "https", "fetch", "got", "superagent", "request")
DATABASES = ("db", "pool", "conn", "connection", "client", "sequelize", "knex", "sql", "database", "pg", "prisma", "mysql", "mariadb", "sqlite", "drizzle", "dbClient", "datasource", "pgPool", "pgClient", "dbConn")
UNSAFE = ("$queryRawUnsafe", "$executeRawUnsafe")
RAW_QUERIERS = ("knex", "sequelize", "db", "sql", "Sequelize", "datasource")
COLLECTORS = ("Sentry", "analytics", "posthog", "ph", "mixpanel", "amplitude", "datadog", "DD", "segment", "rudder", "logrocket", "bugsnag", "rollbar", "heap")
COMMANDS, EVALUATORS, TIMERS = ("exec", "execSync", "spawn", "spawnSync"), ("eval", "Function"), ("setTimeout", "setInterval")
# What a model may do, by what is called, and the rule of each.
AGENT_COMMANDS = ("exec", "execSync", "spawn", "spawnSync", "execFile", "execFileSync")
FILE_WRITES = ("writeFile", "writeFileSync", "appendFile", "appendFileSync", "unlink", "unlinkSync", "rm", "rmSync", "rmdir", "mkdir", "createWriteStream", "outputFile")
FILE_OBJECTS = ("fs", "fsp", "fse", "fsExtra", "promises")
AGENT_REQUESTERS = ("axios", "http", "https", "got", "fetch", "superagent", "ky", "request")
AGENT_RULES = {"command-exec": "ai.excessive-agency-command", "code-eval": "ai.excessive-agency-code", "fs-write": "ai.excessive-agency-filesystem", "sql-raw": "ai.excessive-agency-sql", "ssrf-fetch": "ai.tool-ssrf"}
OUTPUT_RULE, CHAIN_RULE = "ai.improper-output-handling", "ai.prompt-injection-to-agency"
SANDBOXES = ("isolated-vm", "isolated_vm", "ivm.", "vm2", "NodeVM", "@e2b", "e2b/", "Sandbox.create", "lockdown(", "new Compartment", "quickjs", "ses/")
AI_WORDS = ("execute", "tool(", "generateText", "streamText", "generateObject", "streamObject", ".create(", "func:", "handler:")


def facts(files: DataFrame) -> DataFrame:
    """Facts (see syntax.Reader) of files (file, text); texts without a call, an assignment or markup stay in the JVM. A null text has none.

    Files of a batch with the same text get copies of one reading; readings are handed over once there are BATCH rows of them.
    """

    def piece(held: list[tuple]) -> pa.Table:
        columns = list(zip(*held, strict=True))
        columns[-1] = [[{"label": k, "what": w, "line": n, "cls": c} for k, (w, n, c) in x.items()] for x in columns[-1]]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, list(_SCHEMA)[1:], strict=True)], names=_SCHEMA.names[1:])

    def copied(held: list[tuple], sizes: np.ndarray, files: pa.Array) -> Iterator[pa.RecordBatch]:
        """The rows held, for each of the files the next of them as many as it has (sizes) after where it begins."""
        read = piece(held)
        begins, counts = sizes[:, 0], sizes[:, 1]
        ends = np.cumsum(counts)
        done, row = 0, 0
        while done < len(counts):
            upto = max(done + 1, int(np.searchsorted(ends, row + BATCH, "right")))
            of = np.repeat(np.arange(done, upto), counts[done:upto])
            rows = np.arange(row, ends[upto - 1]) - (ends - counts)[of] + begins[of]
            out = read.take(pa.array(rows)).add_column(0, "file", files.take(pa.array(of))).cast(_SCHEMA)
            yield from out.combine_chunks().to_batches()
            done, row = upto, int(ends[upto - 1])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").dictionary_encode()
            code = texts.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            copies = np.bincount(code, minlength=len(texts.dictionary))
            files, held, sizes, first, last = b.column("file").take(pa.array(order)), [], [], 0, 0
            for n, text in enumerate(texts.dictionary):
                found = facts_of(text.as_py())
                sizes.append(np.tile([(len(held), len(found))], (copies[n], 1)))
                held += found
                last += copies[n]
                if len(held) >= BATCH:
                    yield from copied(held, np.concatenate(sizes), files.slice(first, last - first))
                    held, sizes, first = [], [], last
            if held:
                yield from copied(held, np.concatenate(sizes), files.slice(first, last - first))

    some = files.filter(F.col("text").rlike(TELLING)).select(F.col("file").cast("string").alias("file"), "text")
    return some.mapInArrow(rows, FACTS)


# --- sinks


def _sinks() -> tuple[Column, Column]:
    """Whether a fact's last name is one of any sink, and the sinks that it is: array of rule_id, cap (the label that counts), cls, soft (what is said of a value that carries nothing: '', 'built' if it isn't a mere name, 'any', 'always')."""
    prop, root, size = F.element_at("parts", -1), F.col("parts")[0], F.size("parts")
    arg, at = F.col("kind") == "arg", lambda k: F.col("ord") == k
    bare, member = arg & (size == 1), arg & (size > 1)
    away = host_is_dynamic(F.col("extra")[1])
    local = F.col("value").rlike(r"^(?:new\s+URL\s*\(\s*)?[\"'`]\s*(?:/|\./|\.\./)")
    quoted = F.col("shape").isin("template") | (F.col("shape").isin("literal") & F.col("value").rlike("^[\"'`]"))
    found = [
        ("injection.eval", "inject", "", "", EVALUATORS, bare),
        ("injection.command", "inject", "", "", COMMANDS, arg),
        ("ssrf.fetch", "inject", "", "", ("fetch",), bare & away),
        ("ssrf.fetch", "inject", "", "", ("get", "request"), member & root.isin(*REQUESTERS) & away),
        ("injection.eval", "inject", "", "always", TIMERS, bare & at(0) & quoted),
        ("injection.eval", "inject", "", "", TIMERS, bare & at(0) & ~quoted & (F.col("shape") != "function")),
        ("xss.inner-html", "inject", "", "built", ("insertAdjacentHTML", "write", "writeln"), member & (((prop == "insertAdjacentHTML") & at(1)) | (prop.isin("write", "writeln") & (root == "document") & at(0)))),
        ("open-redirect", "inject", "", "built", ("redirect", "push", "replace", "assign"), member & at(0) & ~local & ((prop == "redirect") | (prop.isin("push", "replace") & (root == "router")) | ((prop == "assign") & (root == "location")))),
        ("sqli.tainted-query", "inject", "", "", (*UNSAFE, "query", "execute", "raw"), member & at(0) & (prop.isin(*UNSAFE) | (prop.isin("query", "execute") & root.isin(*DATABASES)) | ((prop == "raw") & root.isin(*RAW_QUERIERS)))),
        ("xss.inner-html", "inject", "", "built", ("innerHTML", "outerHTML"), F.col("kind") == "field"),
        ("xss.dangerously-set-inner-html", "inject", "", "any", ("dangerouslySetInnerHTML",), (F.col("kind") == "attr") & (F.col("extra")[0] == "__html")),
        ("dataflow.sensitive-to-log", "sensitive", "", "", ("log", "info", "warn", "error", "debug"), member & (root == "console")),
        ("dataflow.sensitive-to-response", "sensitive", "", "", ("json", "send"), member),
        ("dataflow.sensitive-to-browser-storage", "sensitive", "", "", ("setItem",), member & root.isin("localStorage", "sessionStorage")),
        ("dataflow.sensitive-to-thirdparty", "sensitive", "", "", ("captureException", "captureMessage", "track", "identify", "capture"), member & (prop.isin("captureException", "captureMessage") | (prop.isin("track", "identify", "capture") & root.isin(*COLLECTORS)))),
        (OUTPUT_RULE, "agency", "code-eval", "", EVALUATORS, bare & at(0)),
        (OUTPUT_RULE, "agency", "command-exec", "", (*AGENT_COMMANDS, "fork"), (bare & prop.isin(*AGENT_COMMANDS, "fork") & at(0)) | (member & prop.isin(*AGENT_COMMANDS))),
        (OUTPUT_RULE, "agency", "ssrf-fetch", "", ("fetch", "get", "request", "post", "put", "patch", "delete"), ((bare & (prop == "fetch")) | (member & prop.isin("get", "request", "post", "put", "patch", "delete") & root.isin(*AGENT_REQUESTERS))) & at(0) & away),
        (OUTPUT_RULE, "agency", "fs-write", "", FILE_WRITES, member & (root.isin(*FILE_OBJECTS) | F.array_contains("parts", "fs"))),
        (OUTPUT_RULE, "agency", "sql-raw", "", UNSAFE, member),
    ]
    each = [F.when(prop.isin(*names) & c, F.struct(F.lit(r).alias("rule_id"), F.lit(cap).alias("cap"), F.lit(cls).alias("cls"), F.lit(soft).alias("soft"))) for r, cap, cls, soft, names, c in found]
    return prop.isin(*sorted({n for f in found for n in f[4]})), F.array_compact(F.array(*each))


def _shown_sink() -> Column:
    """A sink for people: a call, an assigned member or an attribute."""
    return F.when(F.col("kind") == "arg", F.concat("name", F.lit("(...)"))).otherwise(F.col("name"))


def sinks(f: DataFrame) -> DataFrame:
    """Facts that are sinks, a row for each: rule_id, cap, cls, soft, sink besides their columns. Most facts are told apart by their last name, before any condition."""
    named, found = _sinks()
    some = f.filter(F.col("kind").isin("arg", "field", "attr") & (F.size("parts") > 0) & named)
    return some.withColumn("s", F.explode(found)).select(*f.columns, "s.*", _shown_sink().alias("sink"))


def _carries(label: Column | str) -> Column:
    """The first entry of what a fact carries under a label; null if none."""
    return F.get(F.filter("carried", lambda c: c["label"] == label), F.lit(0))


def _of_parameters(df: DataFrame) -> DataFrame:
    """A row for each parameter that a fact's value carries: p_cap, function, p_ord."""
    each = df.withColumn("c", F.explode(F.filter("carried", lambda c: c["cls"] == "param"))).withColumn("l", F.split("c.label", ":"))
    return each.withColumns({"p_cap": F.col("l")[0], "function": F.col("l")[1], "p_ord": F.col("l")[2].cast("int")}).drop("c", "l")


# --- functions over calls


def call_edges(calls: DataFrame, to: DataFrame) -> DataFrame:
    """Arguments that carry something to a function that is known: the fact's columns, called, t_file, t_function. calls: facts that carrying() tells."""
    return calls.withColumn("called", F.element_at("parts", -1)).join(to, ["file", "called"])


def carrying(f: DataFrame) -> DataFrame:
    """Facts of arguments that carry something to what has a name."""
    return f.filter((F.col("kind") == "arg") & (F.size("carried") > 0) & (F.size("parts") > 0))


_KEYS = ["file", "function", "ord", "cap", "rule_id", "cls"]


def closed(base: DataFrame, edges: DataFrame) -> DataFrame:
    """file, function, ord, cap, rule_id, cls, sink, hops: parameters that reach a sink, in the function itself (0) or through calls.

    Each round joins the calls with what the last round found, and is written to the shared folder; it ends when a round finds nothing.
    """
    handed = staged(_of_parameters(edges).select("file", "function", F.col("p_ord").alias("ord"), F.col("p_cap").alias("cap"), "t_file", "t_function", F.col("ord").alias("t_ord")).distinct(), "calls")
    last = staged(base.groupBy(*_KEYS).agg(F.min("sink").alias("sink")).withColumn("hops", F.lit(0)), "summaries")
    known, hops = last, 0
    while not last.isEmpty():
        hops += 1
        s = last.select(F.col("file").alias("t_file"), F.col("function").alias("t_function"), F.col("ord").alias("t_ord"), "cap", "rule_id", "cls", "sink")
        new = handed.join(s, ["t_file", "t_function", "t_ord", "cap"]).groupBy(*_KEYS).agg(F.min("sink").alias("sink")).withColumn("hops", F.lit(hops))
        last = staged(new.join(known.select(*_KEYS), _KEYS, "left_anti"), "summaries")
        known = known.unionByName(last)
    return known


def summaries(s: DataFrame, edges: DataFrame) -> DataFrame:
    """closed() of the sinks s."""
    base = _of_parameters(s).filter("p_cap = cap").select("file", "function", F.col("p_ord").alias("ord"), "cap", "rule_id", "cls", "sink")
    return closed(base, edges)


def _into(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Calls that hand a summary's parameter its argument: edges' columns, rule_id, cap, cls, sink, hops."""
    k = known.select(F.col("file").alias("t_file"), F.col("function").alias("t_function"), "ord", "cap", "rule_id", "cls", "sink", (F.col("hops") + 1).alias("hops"))
    return edges.join(k, ["t_file", "t_function", "ord"])


# --- findings

STEP = "array<struct<label:string,file:string,line:int,kind:string,code:string>>"


def _step(label: Column, file: Column, line: Column, kind: str, code: Column) -> Column:
    return F.struct(label.alias("label"), file.alias("file"), line.cast("int").alias("line"), F.lit(kind).alias("kind"), code.alias("code"))


def _reported(df: DataFrame, source: Column, confidence: Column, called: bool = False) -> DataFrame:
    """Findings of rows with sink, hops and, where something was carried, its entry: what is the same for all files of a class. through: the function's name where it was called."""
    through = F.element_at("parts", -1) if called else F.lit(None).cast("string")
    end = F.concat(through, F.lit("() -> "), "sink") if called else F.col("sink")
    said = F.when(source.isNull(), F.concat(F.lit("A value that isn't literal reaches "), end)).when(F.col("cap") == "sensitive", F.concat(F.lit("A secret, "), source["what"], F.lit(", reaches "), end)).otherwise(F.concat(source["what"], F.lit(" flows into "), end))
    at = [F.col(c) if called else F.lit(None).cast("string").alias(c) for c in ("t_file", "t_function")]
    return df.select(
        "rule_id", "file", "line", "column", F.col("code").alias("code_snippet"), confidence.alias("confidence"), said.alias("message"), F.col("name").alias("called"), "hops", F.when(F.col("cap") == "sensitive", source["cls"]).alias("data_asset"),
        F.when(source.isNotNull(), F.struct(source["what"].alias("what"), source["line"].cast("int").alias("line"))).alias("source"), end.alias("end"), "sink", "ord", through.alias("through"), *at,
    )


def _once(found: DataFrame, *keys: Column) -> DataFrame:
    """One finding of the same keys: the one through the fewest calls, then the first in the line."""
    order = F.struct((F.col("confidence") != "high").alias("unsure"), "hops", "column", "called", "message")
    return found.groupBy(*[k.alias(f"k{n}") for n, k in enumerate(keys)]).agg(F.min_by(F.struct(*found.columns), order).alias("f")).select("f.*")


def _told(p: Program, found: list[DataFrame]) -> DataFrame:
    """Findings of classes for each of their files, one a fingerprint (rule, file, line and its text), with flow, fingerprint and taint_steps.

    Those of a class are told apart before they're handed out; only files without a name can have the same fingerprint after that.
    """
    once = _once(reduce(DataFrame.unionByName, found), F.col("rule_id"), F.col("file"), F.col("line"), F.trim("code_snippet"))
    f = p.handed_out(staged(once, "found"))
    passed = F.concat("through", F.lit("() in "), "t_file", F.lit(" (parameter "), F.col("ord").cast("string"), F.lit(" -> "), "sink", F.lit(")"))
    first, last = _step(F.col("source.what"), F.col("file"), F.col("source.line"), "source", F.col("source.what")), _step(F.col("end"), F.col("file"), F.col("line"), "sink", F.col("code_snippet"))
    between = F.when(F.col("through").isNotNull(), F.array(_step(passed, F.col("t_file"), F.col("line"), "propagation", F.col("code_snippet")))).otherwise(F.array().cast(STEP))
    flow = F.when(F.col("source").isNotNull(), F.concat(F.array(first), between, F.array(last))).otherwise(F.array().cast(STEP))
    f = f.select("rule_id", "file", "line", "column", "code_snippet", "confidence", "message", "called", "hops", "data_asset", flow.alias("taint_flow"))
    f = f.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("file"), F.col("line"), F.col("code_snippet"))).withColumn("taint_steps", F.size("taint_flow"))
    return _once(f, F.col("fingerprint")) if p.nameless else f


class Program:
    """Facts of a corpus and what several findings need of them, each written once, when it's first asked for.

    A text is read once, however many files have it. What is found in a file follows from its text and from the files that it
    imports values from: files that are alike in both are a class, and sinks, calls and findings are worked out for
    classes (named in the column file) and then handed out to files. A file that imports nothing is in the class of its
    text, one that imports only from such files in that of its text and of theirs; any other is a class of its own, and
    so is a file that comes several times, with all of its texts. Files without a name don't import and aren't imported.
    """

    def __init__(self, files: DataFrame):
        self.files = files

    @cached_property
    def listed(self) -> DataFrame:
        """file, id: every file and its text's digest, null where the text can't have facts."""
        return staged(self.files.select(F.col("file").cast("string").alias("file"), F.when(F.col("text").rlike(TELLING), F.sha2("text", 256)).alias("id")), "listed")

    @cached_property
    def copies(self) -> DataFrame:
        """file, id: files whose text may have facts."""
        return self.listed.filter("id IS NOT NULL")

    @cached_property
    def texts(self) -> DataFrame:
        """file (the text's digest), text: each text once."""
        return staged(self.files.filter(F.col("text").rlike(TELLING)).select("text").distinct().select(F.sha2("text", 256).alias("file"), "text"), "texts")

    @cached_property
    def facts(self) -> DataFrame:
        """Facts of texts; file is a text's digest."""
        tasks = max(self.texts.sparkSession.sparkContext.defaultParallelism, -(-self.texts.count() // TEXTS_A_TASK))
        return staged(facts(self.texts.repartition(tasks, "file")), "facts")

    @cached_property
    def nameless(self) -> bool:
        return not self.copies.filter("file IS NULL").isEmpty()

    @cached_property
    def repeated(self) -> DataFrame | None:
        """file: those that come several times; None if none does."""
        found = staged(self.copies.filter("file IS NOT NULL").groupBy("file").count().filter("count > 1").select("file"), "repeated")
        return None if found.isEmpty() else found

    @cached_property
    def imports(self) -> DataFrame | None:
        """file, called, t_function, t_file: values that a file imports by name from a file of the corpus; None if no text imports any."""
        named = self.facts.filter("kind = 'import'").select(F.col("file").alias("id"), F.col("name").alias("called"), F.col("parts")[0].alias("t_function"), F.col("extra")[0].alias("spec")).distinct()
        if named.isEmpty():
            return None
        own = self.copies.filter("file IS NOT NULL").join(named, "id").select("file", "called", "t_function", "spec")
        return staged(resolved(own, self.listed, ["file", "called", "t_function"]).withColumnRenamed("dst", "t_file"), "imports")

    @cached_property
    def members(self) -> DataFrame:
        """class, id, file: the class of each file, and its texts."""
        m, again, i = self.copies, self.repeated, self.imports
        yes = lambda c: F.coalesce(c, F.lit(False))
        m = m.withColumn("again", F.lit(False)) if again is None else m.join(again.withColumn("again", F.lit(True)), "file", "left")
        if i is None:
            m = m.withColumns({"deep": F.lit(False), "to": F.lit(None).cast("string")})
        else:
            bound = i.select("file") if again is None else i.select("file").union(again)
            to = i.join(self.copies.select(F.col("file").alias("t_file"), F.col("id").alias("t_id")), "t_file", "left").join(bound.distinct().select(F.col("file").alias("t_file"), F.lit(True).alias("bound")), "t_file", "left")
            to = to.groupBy("file").agg(F.bool_or(yes(F.col("bound"))).alias("deep"), F.to_json(F.array_sort(F.collect_set(F.struct("called", "t_function", F.coalesce("t_id", F.lit("")).alias("t_id"))))).alias("to"))
            m = m.join(to, "file", "left")
        name = F.when(yes(F.col("again")) | yes(F.col("deep")), F.concat(F.lit("f "), "file")).when(F.col("to").isNotNull(), F.concat(F.lit("c "), F.sha2(F.concat("id", "to"), 256))).otherwise(_class_of_text(F.col("id")))
        m = m.select(name.alias("class"), "id", "file")
        return staged(m if again is None else m.distinct(), "members") if i is not None or again is not None else m

    @cached_property
    def classes(self) -> DataFrame:
        """id, class: the classes that a text is in."""
        return staged(self.members.select("id", "class").distinct(), "classes")

    def of_classes(self, rows: DataFrame) -> DataFrame:
        """Rows of texts, once for each class that the text is in."""
        if self.imports is None and self.repeated is None:
            return rows.withColumn("file", _class_of_text(F.col("file")))
        return rows.withColumnRenamed("file", "id").join(self.classes, "id").select(*[F.col("class").alias("file") if c == "file" else F.col(c) for c in rows.columns])

    def handed_out(self, found: DataFrame) -> DataFrame:
        """Findings of classes for each file of theirs, with the file of the function that was called (t_file)."""
        of = self.members.select("class", "file")
        of = of if self.repeated is None else of.distinct()
        here = lambda d: d.withColumnRenamed("file", "class").join(of, "class")
        near = here(found.filter("t_file IS NULL OR t_file = file")).withColumn("t_file", F.when(F.col("t_file").isNotNull(), F.col("file"))).drop("class")
        if self.imports is None:
            return near
        far = here(found.filter("t_file <> file")).drop("t_file", "class").join(self.imports.withColumnRenamed("called", "through"), ["file", "through", "t_function"])
        return near.unionByName(far)

    @cached_property
    def sinks(self) -> DataFrame:
        return staged(self.of_classes(sinks(self.facts)), "sinks")

    @cached_property
    def imported(self) -> DataFrame | None:
        """file, called, t_file, t_function: values imported by name, functions or not."""
        if self.imports is None:
            return None
        of = lambda c, f: self.members.select(F.col("class").alias(c), F.col("file").alias(f))
        i = self.imports.join(of("class", "file"), "file").join(of("t_class", "t_file"), "t_file")
        return staged(i.select(F.col("class").alias("file"), "called", F.col("t_class").alias("t_file"), "t_function").distinct(), "imported")

    @cached_property
    def targets(self) -> DataFrame:
        """file, called, t_file, t_function: what a name stands for where it is called: a function of the file, or one imported by name from a file of the corpus."""
        own = self.of_classes(self.facts.filter("kind = 'function' AND NOT startswith(name, '@')").select("file", F.col("name").alias("called")).distinct()).distinct()
        own = own.withColumns({"t_file": F.col("file"), "t_function": F.col("called")})
        if self.imported is not None:
            own = own.unionByName(self.imported.join(own.select("file", "called"), ["file", "called"], "left_anti"))
        return staged(own, "targets")

    @cached_property
    def edges(self) -> DataFrame:
        return staged(call_edges(self.of_classes(carrying(self.facts)), self.targets), "edges")

    @cached_property
    def known(self) -> DataFrame:
        return summaries(self.sinks, self.edges)


def _class_of_text(digest: Column) -> Column:
    return F.concat(F.lit("t "), digest)


def flow_findings(p: Program) -> DataFrame:
    """Data from outside in a sink and secrets that leave, in a file or through any number of calls; values in markup sinks that aren't literal, with medium confidence.

    rule_id, file, line, column, code_snippet, confidence, message, called, hops, data_asset, taint_flow, taint_steps, fingerprint.
    """
    own = p.sinks.filter(F.col("cap").isin("inject", "sensitive")).withColumn("hops", F.lit(0)).withColumn("source", _carries(F.col("cap")))
    plain = F.col("shape").isin("literal", "template", "function")
    soft = (F.col("soft") == "always") | ((F.col("soft") == "any") & ~plain) | ((F.col("soft") == "built") & ~plain & (F.col("shape") != "name"))
    direct = _reported(own.filter(F.col("source").isNotNull() | soft), F.col("source"), F.when(F.col("source").isNotNull(), "high").otherwise("medium"))
    through = _into(p.edges, p.known.filter(F.col("cap").isin("inject", "sensitive"))).withColumn("source", _carries(F.col("cap"))).filter("source IS NOT NULL")
    return _told(p, [direct, _reported(through, F.col("source"), F.lit("high"), called=True)])


def taint_findings(files: DataFrame) -> DataFrame:
    """rule_id, file, line, code (what is called or set), hops, taint_steps: flow_findings() that have a flow."""
    return flow_findings(Program(files)).filter("taint_steps > 0").select("rule_id", "file", "line", F.col("called").alias("code"), "hops", "taint_steps")


def agency_findings(p: Program) -> DataFrame:
    """What a model may do: tools whose arguments reach a dangerous call, output of a model that does, and calls of a model that have such a tool and untrusted content in the prompt.

    Each over any number of calls and over files; tools and prompts may be imported or be parameters. Columns as of flow_findings().
    """
    gate = reduce(lambda a, b: a | b, [F.contains("text", F.lit(w)) for w in AI_WORDS])
    boxed = reduce(lambda a, b: a | b, [F.contains("text", F.lit(w)) for w in SANDBOXES])
    about = staged(p.of_classes(p.texts.filter(gate).select("file", boxed.alias("boxed"))).distinct(), "gates")
    agent = p.known.filter("cap = 'agency'")
    unsure = F.when(F.col("cls") == "ssrf-fetch", "medium").when(F.col("boxed") & F.col("cls").isin("command-exec", "code-eval"), "low").otherwise("high")
    rule = F.coalesce(*[F.when(F.col("cls") == c, F.lit(r)) for c, r in AGENT_RULES.items()])
    # Arguments of tools, which the model chooses.
    tools = p.of_classes(p.facts.filter("kind = 'tool'").select("file", F.col("name").alias("function")).distinct()).distinct()
    own = p.sinks.filter("cap = 'agency'").withColumn("hops", F.lit(0))
    inner = _of_parameters(own).filter("p_cap = 'agency'").join(tools, ["file", "function"]).join(about, "file")
    outer = _of_parameters(_into(p.edges, agent)).filter("p_cap = 'agency'").join(tools, ["file", "function"]).join(about, "file")
    chosen = F.struct(F.lit("an argument of a tool, which the model chooses").alias("what"), F.col("line"), F.lit("").alias("cls"))
    found = [_reported(d.withColumn("rule_id", rule).withColumn("source", chosen), F.col("source"), unsure, called) for d, called in ((inner, False), (outer, True))]
    risky = inner.select("file", "function", "cls").unionByName(outer.select("file", "function", "cls")).distinct()
    # Output of a model.
    said = lambda d: d.withColumn("source", _carries("model")).filter("source IS NOT NULL").join(about, "file")
    found += [_reported(said(own), F.col("source"), unsure), _reported(said(_into(p.edges, agent)), F.col("source"), unsure, True)]
    # Calls of a model with such a tool, by the names that it has there, and content that others wrote.
    named = p.of_classes(p.facts.filter("kind = 'assign' AND extra[0] <> ''").select("file", F.col("name").alias("tool"), F.col("extra")[0].alias("function"))).join(risky, ["file", "function"]).select("file", "tool").distinct()
    if p.imported is not None:
        named = named.unionByName(p.imported.join(named.select(F.col("file").alias("t_file"), F.col("tool").alias("t_function")), ["t_file", "t_function"]).select("file", F.col("called").alias("tool"))).distinct()
    armed = p.of_classes(p.facts.filter("kind = 'model'")).join(about, "file").withColumn("tool", F.explode("extra")).join(named, ["file", "tool"])
    armed = armed.withColumns({"rule_id": F.lit(CHAIN_RULE), "cap": F.lit("agency"), "cls": F.lit("prompt"), "hops": F.lit(0), "sink": F.concat(F.lit("a model that can call "), "tool")})
    armed = staged(armed, "armed")
    fed = armed.withColumn("source", _carries("untrusted")).filter("source IS NOT NULL")
    prompts = closed(_of_parameters(armed).filter("p_cap = 'agency'").select("file", "function", F.col("p_ord").alias("ord"), "cap", "rule_id", "cls", "sink"), p.edges)
    handed = _into(p.edges, prompts).withColumn("source", _carries("untrusted")).filter("source IS NOT NULL")
    found += [_reported(fed, F.col("source"), F.lit("high")), _reported(handed, F.col("source"), F.lit("high"), True)]
    return _told(p, found)
