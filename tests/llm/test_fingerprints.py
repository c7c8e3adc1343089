import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import fingerprints as fp


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def edited_rows(docs):
    """What the query must say of each row of docs apart from its sketches."""
    order = sorted(((i, t or "") for i, t in docs), key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        yield i, t, t[: len(t) - half] + following[:half], following


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_on_the_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in fp.op13_document_fingerprints(spark, sf).collect()}
    assert len(got) == len(docs)
    errors, by_text = [], {}
    for i, text, edited, following in edited_rows(docs):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), digest(edited))
        a, b, c = shingles(text), shingles(edited), shingles(following)
        errors += [abs(r.near_edited - len(a & b) / len(a | b)), abs(r.near_next - len(a & c) / len(a | c))]
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
    assert np.mean(errors) < 0.04 and np.max(errors) < 0.4


@pytest.mark.parametrize("range_rows", [1, 3, 1000])
def test_odd_rows(spark, odd_docs, range_rows):
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    docs += [(None, "without an id"), (None, None), (14, "twice"), (14, "twice"), (14, "thrice"), (-5, "\U0001f389" * 7), ((1 << 62), "far away"), (-(1 << 63), "lowest")]
    df = spark.createDataFrame([(*d, "clash", [1]) for d in docs], "doc_id long, text string, next_text string, sketch array<int>").repartition(5)
    rows = fp.edited_fingerprints(df, range_rows=range_rows).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in rows) == sorted((str(i), len(t), digest(e)) for i, t, e, _ in edited_rows(docs))
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next, r.held_edited, r.held_next))
    assert all(r.near_edited == 1 for r in rows if r.fingerprint == r.edited_fingerprint)
    assert fp.edited_fingerprints(df.filter("false")).collect() == []
    only = fp.edited_fingerprints(df.filter("doc_id is null"), range_rows=range_rows).collect()
    assert sorted((r.n_chars, r.edited_sha256) for r in only) == sorted((len(t), digest(e)) for _, t, e, _ in edited_rows([(None, "without an id"), (None, None)]))


def test_sketches_hold_what_lies_below_the_ceiling_and_merge(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [" ".join(word() for _ in range(n)) for n in (0, 1, 3, 5, 30, 37, 200, 900, 5000)]
    rows = [(a, b) for a in texts for b in texts]
    df = spark.createDataFrame(rows, "a string, b string")
    s = lambda c: fp.sketch(F.col(c))
    # No word run of a closed pair of texts spans both: a union of shingle sets is what a merged sketch stands for.
    df = df.select("a", "b", s("a").alias("sa"), s("b").alias("sb"), fp.shingle_hashes(F.col("a")).alias("ha"), fp.shingle_hashes(F.col("b")).alias("hb"))
    df = df.select("*", fp.merged(F.col("sa"), F.col("sb")).alias("m"), fp.compared(F.col("sa"), F.col("sb")).alias("c"), fp.from_text(fp.as_text(F.col("sa"))).alias("back"))
    ceiling = -(1 << 63) + (1 << 64) // 16
    for r in df.collect():
        assert len(r.ha) == len(shingles(r.a)) and r.back == r.sa
        below = sorted(h for h in r.ha if h < ceiling)
        assert r.sa == sorted(r.ha)[: max(32, len(below))] and r.sa[: len(below)] == below
        union = sorted(set(r.ha) | set(r.hb))
        assert r.m[:32] == union[:32] and set(r.m) >= {h for h in union if h < ceiling} and set(r.m) <= set(union)
        if max(len(r.ha), len(r.hb)) <= 31:
            assert r.c.likeness == (1.0 if r.sa == r.sb else len(set(r.ha) & set(r.hb)) / len(union))


def test_share_of_a_short_text_in_a_long_one(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(40_000)]
    long, part = " ".join(words), " ".join(words[1000:3000])
    r = spark.createDataFrame([(long, part)], "a string, b string").select(fp.compared(fp.sketch(F.col("a")), fp.sketch(F.col("b"))).alias("c")).first().c
    assert r.share_of_second == 1 and abs(r.share_of_first - 0.05) < 0.02 and abs(r.likeness - 0.05) < 0.02


def test_sketch_of_a_group(spark):
    rng = random.Random(7)
    texts = [(i % 2, " ".join(f"w{rng.randrange(500)}" for _ in range(400))) for i in range(20)]
    df = spark.createDataFrame(texts, "k long, text string").select("k", fp.sketch(F.col("text")).alias("s"), fp.shingle_hashes(F.col("text")).alias("all"))
    got = {k: {r["hash"] for r in fp.group_sketches(df, "k", "s").collect() if r.k == k} for k in (0, 1)}
    want = {k: {h for r in df.collect() if r.k == k for h in r.all if h < fp.ceiling(fp.SCALE)} for k in (0, 1)}
    assert all(got[k] >= want[k] for k in got)


def test_no_python_in_the_plan(spark, sf):
    plan = fp.op13_document_fingerprints(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan and "NestedLoop" not in plan
