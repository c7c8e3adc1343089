import random
import time

import pytest

from riskweave.operators import dataflow
from riskweave.operators.facts import arguments, plain_literal, without_comments
from riskweave.operators.syntax import DEPTH, Reader, facts_of
from riskweave.plans.detectors import DETECTORS, Inputs, found_by
from riskweave.plans.scan import Config, scan


def test_line_readings():
    assert arguments("f(a, [1, 2], 'x,y', g(b))", 1)[0] == ["a", "[1, 2]", "'x,y'", "g(b)"]
    assert arguments("f(a", 1) is None and arguments("f()", 1)[0] == []
    assert without_comments("a // b") == "a " and without_comments("'//' // c") == "'//' " and without_comments("https://x") == "https://x"
    assert plain_literal("'a'") and plain_literal("`x`") and not plain_literal("`${x}`") and not plain_literal("a + 'b'") and plain_literal("12")


def carried(text, callee, ord=0):
    """Labels that the argument of each call of callee carries."""
    return [set(f[-1]) for f in facts_of(text) if f[0] == "arg" and f[3] == callee and f[5] == ord]


@pytest.mark.parametrize(
    "text,labels",
    [
        ("const a = parseInt(n) + req.query.y; out(a)", {"inject", "untrusted"}), ("out(unescape(location.hash))", {"inject"}), ("out(invalidate(location.hash))", {"inject"}), ("out(parseInt(location.hash))", set()), ("out(`${escapeHtml(location.hash)}`)", set()),
        ("out(a ? 'x' : location.hash)", {"inject"}), ("out([1, { k: [location.hash] }])", {"inject"}), ("out({ ...location.hash })", {"inject"}), ("let q = location.hash\nq = 'fixed'\nout(q)", set()), ("let q = 'fixed'\nq += location.hash\nout(q)", {"inject"}),
        ("const { search } = location.search\nout(search)", {"inject"}), ("const q = location.hash\nfunction f(q) { }\nout(q)", {"inject"}), ("for (const k of location.hash.split('')) { out(k) }", {"inject"}), ("out(process.env.MY_KEY)", {"sensitive"}), ("out(process.env.MY_KEY!.length)", set()),
        ("out(process.env.MY_KEY === 'x')", set()), ("out(user.password as string)", {"sensitive"}), ("const password = 'Your password'; out(password)", set()), ("const accessToken = mint(); out(accessToken)", {"sensitive"}), ("const passwordless = mint(); out(passwordless)", set()),
        ("out(await generateText({ prompt: location.hash }))", {"model"}), ("const { text: t } = await client.chat.completions.create({})\nout(t)", {"model"}), ("out(router.create({}))", set()), ("const f = (location) => out(location.x)", {"inject:f:0", "sensitive:f:0", "agency:f:0"}),
        ("out(s /location.hash/ 2)", {"inject"}), ("out(/location.hash/.test(s))", set()), ("out(s) // location.hash", set()), ("out('location.hash' + \"location.hash\")", set()), ("out(<b title={location.hash}>it's {location.hash}</b>)", set()), ("out(<T,>(x: T) => location.hash)", set()),
        ("out(new URL(req.url).searchParams.get('q'))", {"inject", "untrusted"}), ("const a: Map<string, Array<X>> = location.hash; out(a)", {"inject"}), ("out((a, location.hash))", {"inject"}), ("out(location.hash?.[0]!.trim())", {"inject"}),
    ],
)
def test_what_values_carry(text, labels):
    assert carried(text, "out") == [labels]


def test_functions_and_their_parameters():
    text = "class A {\n  private static async run(private a: string, { b, c: d }: T = {}, ...e): Promise<void> { out(a, b, d, e) }\n  f = async x => { out(x) }\n}\nconst o = { m(y) { out(y) }, n: function (z) { out(z) } }\nexport default async function g<T>(p?: T) { out(p); (q => out(q))(1) }"
    labels = [{k for k in f[-1] if k.startswith("inject")} for f in facts_of(text) if f[0] == "arg" and f[3] == "out"]
    assert labels[:8] == [{"inject:run:0"}, {"inject:run:1"}, {"inject:run:1"}, {"inject:run:2"}, {"inject:f:0"}, {"inject:m:0"}, {"inject:n:0"}, {"inject:g:0"}]
    assert len(labels) == 9 and next(iter(labels[8])).startswith("inject:@")


def test_places_and_imports():
    got = [f[:4] for f in facts_of("import { a, b as c, type T } from './m';\nimport x from './d'\nimport type { Y } from './y'\n\n  c(1)")]
    assert got == [("import", 1, 1, "a"), ("import", 1, 1, "c"), ("arg", 5, 3, "c")]


@pytest.mark.parametrize("odd", ["", "(", ")))", "`${`${", "a(" * 4000, "[" * 4000, "{" * 4000, "<a>" * 3000, "x = " * 3000, "!" * 4000, "a ? b : " * 2000, "=> " * 1000, "'unclosed\n\"again", "/* never", "class { (", "import {", "function (", "\x00﻿ ", "if (a) " * 2000, "a.b" * 3000, "<T>" * 2000 + "x", "a<b>c " * 5000])
def test_odd_texts_end(odd):
    facts_of(odd + "\nout(location.hash)")


def test_any_bytes_end():
    rng = random.Random(0)
    signs = list("(){}[]<>`'\"/\\=.,;:?!+-*&|@#$ \n") + ["=>", "${", "function ", "class ", "import ", "const x = ", "a", "</a>", "<a ", "req.body"]
    for _ in range(400):
        facts_of("".join(rng.choice(signs) for _ in range(200)))


def test_work_grows_with_the_text():
    def took(n):
        text = "".join(f"function f{k}(a) {{ const x = a + g({k}, [a]); h(`t${{x}}`) }}\n" for k in range(n))
        start = time.process_time()
        assert len(facts_of(text)) == 5 * n
        return time.process_time() - start

    took(200)
    assert took(4000) < 16 * took(500) + 0.2


def test_depth_is_bounded():
    deep = "f(" * (DEPTH * 3) + "location.hash" + ")" * (DEPTH * 3) + "\nout(location.hash)"
    assert carried(deep, "out") == [{"inject"}]


def found(spark, *files):
    return dataflow.Program(spark.createDataFrame([(f, t, "clash") for f, t in files], "file string, text string, kind string"))


def rows(df):
    return sorted((r.file, r.line, r.rule_id, r.hops, r.confidence) for r in df.collect())


def test_flows_over_files_and_calls(spark):
    p = found(
        spark,
        ("lib/run.ts", "export function run(c) {\n  exec(c)\n}\nexport function safe(c) { return c }\nexport const outer = (a, b) => { run(b) }\nfunction loop(x) { loop(x); loop2(x) }\nfunction loop2(x) { loop(x) }"),
        ("app/api.ts", "import { outer as go, safe } from '../lib/run'\nconst c = req.body\ngo(1, c)\nsafe(c)\ngo(c, 'ls')\nloop(c)"),
        ("app/own.ts", "import { run } from '../lib/run'\nfunction run(x) { return 1 }\nrun(req.body)"),
        ("q.ts", "const id = searchParams.get('id')\ndb.query('? ', [id])\nprisma.$queryRaw`select ${id}`\nqueryClient.query(`x ${id}`)\nprisma.$queryRawUnsafe(`select ${id}`)\nfetch(`https://a.example/${id}`)\nfetch(`https://${id}/`)\nsetTimeout(() => id, 1)\nsetTimeout('go()', 1)"),
        ("n.ts", None), ("e.ts", ""),
    )
    assert rows(dataflow.flow_findings(p)) == [("app/api.ts", 3, "injection.command", 2, "high"), ("q.ts", 5, "sqli.tainted-query", 0, "high"), ("q.ts", 7, "ssrf.fetch", 0, "high"), ("q.ts", 9, "injection.eval", 0, "medium")]
    flow = next(r for r in dataflow.flow_findings(p).collect() if r.file == "app/api.ts").taint_flow
    assert [(s.kind, s.file, s.line) for s in flow] == [("source", "app/api.ts", 2), ("propagation", "lib/run.ts", 3), ("sink", "app/api.ts", 3)] and "req.body" in flow[0].label and "lib/run.ts" in flow[1].label
    assert rows(dataflow.flow_findings(found(spark, ("e.ts", "")))) == []


def test_a_method_named_like_an_exit_is_still_followed(spark):
    p = found(spark, ("a.ts", "const client = { send(u) { return execSync('curl ' + u) } }\nclient.send(location.hash)\nfunction leak(x) { console.log(x) }\nleak(process.env.SECRET_KEY); leak(location.hash)\neval(process.env.SOME_CODE)"))
    assert rows(dataflow.flow_findings(p)) == [("a.ts", 2, "injection.command", 1, "high"), ("a.ts", 4, "dataflow.sensitive-to-log", 1, "high")]


def test_markup_and_assigned_sinks(spark):
    p = found(spark, ("a.tsx", "el.innerHTML = '<b>'\nel.innerHTML = x\nel.innerHTML = '<b>' + x\nel.outerHTML = location.hash\nconst A = <p dangerouslySetInnerHTML={{ __html: '<b>' }} />\nconst B = <p dangerouslySetInnerHTML={{ __html: x }} />\nel.insertAdjacentHTML(location.hash, 'x')\nres.redirect('/a' + location.hash)\nres.redirect(a.b)"))
    assert rows(dataflow.flow_findings(p)) == [("a.tsx", 3, "xss.inner-html", 0, "medium"), ("a.tsx", 4, "xss.inner-html", 0, "high"), ("a.tsx", 6, "xss.dangerously-set-inner-html", 0, "medium"), ("a.tsx", 9, "open-redirect", 0, "medium")]


def test_agency(spark):
    tool = "const t = tool({ description: 'd', execute: async ({ c }) => evaluate(c) })\n"
    p = found(
        spark,
        ("lib.ts", "export const evaluate = (code) => eval(code)\nexport const armed = tool({ execute: (z) => evaluate(z), name: 'x' })"),
        ("a.ts", "import { evaluate } from './lib'\n" + tool + "const page = await fetch(u)\nawait generateText({ tools: { t }, prompt: `sum ${page}` })\nawait generateText({ tools: { t }, prompt: 'fixed' })\nawait generateText({ tools: { other }, prompt: `sum ${page}` })"),
        ("b.ts", "import { armed } from './lib'\nstreamText({ tools: { run: armed }, messages: [{ role: 'user', content: req.body.m }] })"),
        ("c.ts", "// vm2\nconst o = await generateText({ prompt: 'x' })\nconst code = o.text\neval(code)\nexec('ls')\nshow(o)"),
        ("d.ts", "tool(async (x) => fs.rm(x)); axios.post(text)"),
        ("no.ts", "function f(x) { eval(x) }\nf(y)"),
    )
    assert rows(dataflow.agency_findings(p)) == [
        ("a.ts", 2, "ai.excessive-agency-code", 1, "high"), ("a.ts", 4, "ai.prompt-injection-to-agency", 0, "high"), ("b.ts", 2, "ai.prompt-injection-to-agency", 0, "high"),
        ("c.ts", 4, "ai.improper-output-handling", 0, "low"), ("d.ts", 1, "ai.excessive-agency-filesystem", 0, "high"), ("lib.ts", 2, "ai.excessive-agency-code", 1, "high"),
    ]


def test_detectors_are_chosen_by_name(spark):
    files = spark.createDataFrame([("a.ts", "ts", "eval(req.query.x)\nconst a = { rejectUnauthorized: false }")], "file string, ext string, text string")
    of = lambda **k: {(r.detector, r.rule_id) for r in found_by(Inputs(files), **k).collect()}
    assert of() == {("taint", "injection.eval"), ("static", "injection.eval"), ("configs", "config.disabled-tls-verification")} and of(quick=True) == of(only=("static", "configs")) and of(skip=tuple(DETECTORS)) == set()
    assert [(r.detector, r.confidence) for r in scan(files, Config(detectors=("static", "taint"))).findings.collect()] == [("taint", "high")]  # with its flow
    with pytest.raises(ValueError):
        found_by(Inputs(files), only=("nothing",))


def test_scan_tells_paths_and_steps(spark):
    files = spark.createDataFrame([("app/api/x/route.ts", "ts", "export async function POST(req) {\n  execSync(req.body.c)\n}"), ("app/page.tsx", "tsx", "console.log(user.passwordHash)")], "file string, ext string, text string")
    result = scan(files, Config(detectors=("taint",)))
    assert {(r.rule_id, r.severity) for r in result.findings.collect()} == {("injection.command", "critical"), ("dataflow.sensitive-to-log", "critical")}
    steps = [(r.kind, r.step, r.tactic, r.breaks) for r in result.steps.orderBy("kind", "step").collect()]
    assert ("taint-flow", 1, "Initial Access", False) in steps and ("taint-flow", 2, "Execution", True) in steps and {k for k, *_ in steps} == {"taint-flow", "data-egress"}


def test_verified_chains_by_the_secrets_rule(spark):
    from riskweave.operators.paths import verified_chains

    def holds(file, reachable):
        f = spark.createDataFrame([("1", "injection.eval", "app/api/a/route.ts", True, "server", "e"), ("2", "secret.aws-access-key", file, reachable, None, None)], "fingerprint string, rule_id string, file string, reachable boolean, reach_kind string, reach_entrypoint string")
        return verified_chains(spark.createDataFrame([("c", 0, "1"), ("c", 1, "2")], "chain_id string, ord int, fingerprint string"), f).count() == 1

    assert holds("src/a.ts", None) and holds("src/a.ts", True) and not holds("src/a.ts", False) and not holds("src/a.test.ts", True) and not holds("src/a.test.ts", None)


def test_files_are_dealt_to_tasks(spark, monkeypatch):
    """A row stands for a file to be read: the split of the table that it comes from says nothing of the work."""
    from riskweave.plans import registry

    monkeypatch.setattr(registry, "FILES_A_TASK", 10)
    few = spark.range(95).coalesce(1).withColumnRenamed("id", "k")
    assert registry._dealt(few, "k").rdd.getNumPartitions() == 10
    assert registry._dealt(few, "k").distinct().count() == 95 and registry._dealt(few.limit(0), "k").count() == 0


def test_what_is_seen_is_kept_apart_by_place():
    """The reader keeps the token that it saw last, with its place: going back or on looks again."""
    r = Reader("a /*x*/ b\n")
    assert (r.peek(), r.peek(), r.at) == ("a", "a", 0) and r.seen == (0, "a")
    assert r.take("a") and r.peek() == "b" and r.seen == (8, "b")
    r.at = 0
    assert r.peek() == "a" and r.take("a") and r.take("b") and r.peek() == ""


def test_a_filter_stays_after_the_dealing(spark):
    """What is made of a dealt row is judged in the tasks that it was dealt to, not in the few splits of its table."""
    from pyspark.sql import functions as F

    from riskweave.plans import registry

    made = registry._dealt(spark.range(50).withColumnRenamed("id", "k"), "k").withColumn("text", F.concat(F.lit("a"), "k")).filter("text RLIKE '9$'")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("RepartitionByExpression") and made.count() == 5


def test_copies_of_a_text_are_read_once(spark, monkeypatch):
    """Each file of a text has all of its facts, in batches of any size; a short text that was just read isn't read again."""
    texts = ["out(location.hash)", "const a = 1", "f(a, b)\nfunction f(x, y) { eval(x) }", "// (", "el.innerHTML = `${req.query.q}`", None]
    rows = [(f"{i}.ts", texts[i % len(texts)]) for i in range(40)] + [(None, texts[2]), ("long.ts", "g(1)\n" * 900)]
    want = sorted((str(file), *map(str, f[:4])) for file, text in rows if text for f in facts_of(text))
    files = spark.createDataFrame(rows, "file string, text string").coalesce(1)
    for batch in (1, 7, 4096):
        monkeypatch.setattr(dataflow, "BATCH", batch)
        got = dataflow.facts(files).collect()
        assert sorted((str(r.file), r.kind, str(r.line), str(r.column), r.name) for r in got) == want
    assert {c.label for r in got if r.kind == "arg" and r.name == "out" for c in r.carried} == {"inject"}
    assert facts_of(texts[0]) is facts_of("out(location" + ".hash)")


def test_every_sink_is_known_by_its_last_name(spark):
    """Facts without such a name are passed over; what is left has the sinks that it had."""
    files = spark.createDataFrame([("a.ts", "eval(x)\nmy.thing(x)\nel.outerHTML = x\nres.redirect(x)\nfs.writeFile(x)\nposthog.capture(x)\nfork(x)\ndb.$queryRawUnsafe(x)\nsetTimeout(x)\nhttp.get(x)\nother(x)")], "file string, text string")
    got = sorted((r.line, r.rule_id) for r in dataflow.sinks(dataflow.facts(files)).collect())
    assert [line for line, _ in got] == [1, 1, 3, 4, 5, 6, 7, 8, 8, 9, 10, 10]


def test_paths_are_put_together_when_asked_for(spark, monkeypatch):
    """The findings of a scan don't wait for its paths; texts are gone through once for entries and imports."""
    from riskweave.plans import scan as module

    written = []
    monkeypatch.setattr(module, "staged", lambda df, tag, real=module.staged: written.append(tag) or real(df, tag))
    files = spark.createDataFrame([("app/api/x/route.ts", "ts", "import { go } from '@/lib/k'\neval(req.query.x)"), ("lib/k.ts", "ts", "export const go = 1")], "file string, ext string, text string")
    result = scan(files, Config(detectors=("taint",)))
    assert [(r.rule_id, r.reach_kind) for r in result.findings.collect()] == [("injection.eval", "server")] and written == ["outline", "findings"]
    assert result.paths.count() == 1 and result.steps.count() == 2 and written[2:] == ["paths"]


def test_copies_of_a_program_are_worked_out_once(spark):
    """Files alike in text and imports are a class; each has its findings with its own places."""
    helper, user = "export function go(z) { eval(z) }", "import { go } from './h'\ngo(location.hash)"
    files = [(f"d{i}/{n}.ts", t) for i in range(3) for n, t in (("h", helper), ("a", user))]
    files += [("d3/h.ts", "export function go(z) { show(z) }"), ("d3/a.ts", user), ("alone/a.ts", user), ("m.ts", "import { go } from './d0/h'\nexport function mid(y) { go(y) }"), ("top.ts", "import { mid } from './m'\nmid(location.hash)")]
    files += [("x.ts", "import { q } from './y'\nexport function p(v) { q(v) }\np(location.hash)"), ("y.ts", "import { p } from './x'\nexport function q(v) { p(v); eval(v) }"), ("e.ts", None)]
    files += [("r.ts", "function f(x) { eval(x) }"), ("r.ts", "\nf(location.hash)"), (None, "eval(location.hash)"), (None, "eval(location.hash)")]
    p = dataflow.Program(spark.createDataFrame(files, "file string, text string"))
    got = sorted((str(r.file), r.line, r.hops, [(s.file, s.line) for s in r.taint_flow if s.kind == "propagation"]) for r in dataflow.flow_findings(p).collect())
    want = [(f"d{i}/a.ts", 2, 1, [(f"d{i}/h.ts", 2)]) for i in range(3)] + [("None", 1, 0, []), ("r.ts", 2, 1, [("r.ts", 2)]), ("top.ts", 2, 2, [("m.ts", 2)]), ("x.ts", 3, 2, [("x.ts", 3)])]
    assert got == sorted(want)
    assert p.facts.count() == sum(len(facts_of(t)) for t in {t for _, t in files if t})
    kinds = {r.file: r["class"][:2] for r in p.members.filter("file IS NOT NULL").collect()}
    assert {f for f, k in kinds.items() if k == "f "} == {"top.ts", "x.ts", "y.ts", "r.ts"} and {f for f, k in kinds.items() if k == "c "} == {*(f"d{i}/a.ts" for i in range(4)), "m.ts"}


def test_arguments_of_copies_are_judged_once(spark):
    """Each file of a text has the text's findings; a file that comes twice and files without a name have one of each."""
    from riskweave.operators.arguments import argument_findings

    files = [(f"{i}.ts", "eval(a)\nrun()\n" + "x" * 401 + "; eval(b)") for i in range(5)] + [("0.ts", "eval(a)"), (None, "eval(a)"), (None, "eval(a) ")]
    p = dataflow.Program(spark.createDataFrame(files, "file string, text string"))
    assert sorted((str(r.file), r.line) for r in argument_findings(p).collect()) == [*((f"{i}.ts", 1) for i in range(5)), ("None", 1)]
    assert p.facts.count() == sum(len(facts_of(t)) for t in {t for _, t in files})


def test_a_name_that_all_dependencies_share_is_not_one_task(spark):
    """What a scan finds of them is found by the tasks that have them, also where the plan shows the name."""
    from pyspark.sql import functions as F

    needed = spark.range(400, numPartitions=4).select(F.lit("lib").alias("name"), F.when(F.col("id") % 4 == 0, "2.0.0").otherwise("1.0.0").alias("declared"), F.concat("id", F.lit("/package.json")).alias("file"))
    advisories = spark.createDataFrame([("lib", "A-1", "CVE-1", "<2.0.0", "high", ["f"])], "package string, id string, cve string, vulnerable_range string, severity string, symbols array<string>")
    files = spark.createDataFrame([("a.ts", "ts", "a")], "file string, ext string, text string")
    found = found_by(Inputs(files, dependencies=needed, advisories=advisories, kev=spark.createDataFrame([("cve-1",), ("CVE-1",)], "cve string")), only=("dependencies",))
    rows = found.select("severity", "kev", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == 300 and {(r.severity, r.kev) for r in rows} == {("critical", True)} and len({r.task for r in rows}) > 1
