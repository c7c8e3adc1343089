import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import ngram_join
from riskweave.llm.components import components
from riskweave.llm.ngram_join import groups, join, op5_ngram_join
from riskweave.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_sets(texts, n):
    out = []
    for t in texts:
        ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set())
    return out


def brute(docs, n, percent):
    sets = brute_sets([t for _, t in docs], n)
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs))


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def near_copies(seed, count=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 90))] for _ in range(8)]
    docs = []
    for i in range(count):
        ws = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            at = rng.randrange(len(ws))
            ws[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary + [f"own{i}"])]
        if rng.random() < 0.2:
            ws += [f"own{i}x{j}" for j in range(rng.randint(1, 30))]
        docs.append((i * 7 % 1009, (" " if i % 2 else "\n").join(ws).upper() if i % 3 else " ".join(ws)))
    return docs


@pytest.mark.parametrize("seed,words,percent", [(0, 3, 90), (1, 3, 90), (2, 5, 80), (3, 3, 80), (4, 2, 60)])
def test_groups_equal_brute_force(spark, seed, words, percent):
    docs = near_copies(seed)
    assert got(groups(spark.createDataFrame(docs, "doc_id long, text string"), words, percent)) == brute(docs, words, percent)


def brute_links(docs, n, percent):
    sets = brute_sets([t for _, t in docs], n)
    links = [sum(i != j and bool(a and b) and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    return sorted(((d, k) for (d, _), k in zip(docs, links, strict=True)), key=str)


@pytest.mark.parametrize("seed,words,percent,sets", [(0, 3, 90, 512), (3, 3, 80, 4), (4, 2, 60, 3)])
def test_every_link_is_counted(spark, monkeypatch, seed, words, percent, sets):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", sets)
    monkeypatch.setattr(ngram_join, "DENSE", sets)
    docs = near_copies(seed)
    df = join(spark.createDataFrame(docs, "doc_id long, text string"), words, percent)
    assert sorted(((r.doc_id, r.n_links) for r in df.collect()), key=str) == brute_links(docs, words, percent)
    assert got(df) == brute(docs, words, percent)


@pytest.mark.parametrize("seed,words,percent,hot", [(0, 3, 90, 2), (3, 3, 80, 5), (4, 2, 60, 8)])
def test_hot_ngrams_lose_no_link(spark, monkeypatch, seed, words, percent, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    docs = near_copies(seed)
    df = join(spark.createDataFrame(docs, "doc_id long, text string"), words, percent)
    assert sorted(((r.doc_id, r.n_links) for r in df.collect()), key=str) == brute_links(docs, words, percent)
    assert got(df) == brute(docs, words, percent)


@pytest.mark.parametrize("dense,lookup", [(1, 8), (4, 100), (1000, 7)])
def test_matches_of_two_blocks(monkeypatch, dense, lookup):
    monkeypatch.setattr(ngram_join, "DENSE", dense)
    monkeypatch.setattr(ngram_join, "DENSE_GRAMS", 5)
    monkeypatch.setattr(ngram_join, "LOOKUP", lookup)
    rng = np.random.default_rng(dense)
    own = [np.unique(rng.integers(0, 30, rng.integers(1, 25))).astype(np.uint64) for _ in range(40)]
    n = np.array([len(x) for x in own])
    for rows, columns in ((np.arange(40), np.arange(40)), (np.arange(0, 40, 2), np.arange(1, 40, 2)), (np.array([3]), np.array([7, 9]))):
        got = ngram_join._matches(own, n, rows, columns, 40)
        assert got.tolist() == [[100 * len(np.intersect1d(own[i], own[j])) >= 40 * len(np.union1d(own[i], own[j])) for j in columns] for i in rows]


def test_long_words_of_one_polynomial_differ():
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    for n in (1024, 2048):
        a, b, c = shingle_sets([word[:n], other[:n], word[:n].upper()], 3)
        assert a[0] != b[0] and a[0] == c[0]


def test_links_of_odd_rows_and_of_the_query(spark, sf, odd_docs, no_docs):
    rows = lambda df: sorted(((r.doc_id, r.n_links) for r in df.collect()), key=str)
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert rows(join(odd_docs)) == brute_links(docs, 3, 90)
    assert join(no_docs).collect() == []
    words = [f"w{i}" for i in range(60)]
    chain = [(1, " ".join(words)), (None, " ".join(["x", *words[1:]])), (None, " ".join(["x", *words[1:]])), (2, " ".join(["x", *words[1:-1], "y"])), (None, None)]
    df = spark.createDataFrame(chain, "doc_id long, text string")
    assert rows(join(df)) == brute_links(chain, 3, 90)
    assert {r.doc_id: r.component_id for r in join(df, percent=96).collect() if r.doc_id} == {1: 1, 2: 1}
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(op5_ngram_join(spark, sf)) == brute_links(docs, 3, 90)


def test_query_over_documents(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op5_ngram_join(spark, sf)) == brute(docs, 3, 90)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert got(groups(odd_docs)) == brute(docs, 3, 90)
    assert groups(no_docs).collect() == []
    nulls = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (3, "x y z"), (None, "x y z"), (3, "x y z")], "doc_id long, text string")
    rows = groups(nulls).collect()
    assert sorted(str((r.doc_id, r.component_id)) for r in rows) == sorted(["(None, None)", "(None, None)", "(3, 3)", "(None, 3)", "(3, 3)"])


@pytest.mark.parametrize("n", [1, 3, 5])
def test_shingle_sets_equal_brute_force(n):
    rng = random.Random(n)
    texts = ["".join(rng.choices("aAbB é\t\n\x0b\x85\xa0", k=rng.randint(0, 60))) for _ in range(400)] + [None, "", "a", " a ", "A a"]
    hashes, words = shingle_sets(texts, n), brute_sets(texts, n)
    assert [len(h) for h in hashes] == [len(w) for w in words]
    for i in range(0, 400, 7):
        for j in range(0, 400, 11):
            assert len(np.intersect1d(hashes[i], hashes[j])) == len(words[i] & words[j])


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {i: find(i) for i in list(root)}
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_one_row_of_each_group_stays(spark):
    words = [f"w{i}" for i in range(60)]
    a, near, far = " ".join(words), " ".join([*words[:-1], "x"]), "something else altogether here now"
    rows = [(5, a), (5, a), (5, far), (7, near), (3, near), (3, far), (None, near), (None, "alone one two three four five"), (None, None), (9, None), (9, ""), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = df.join(ngram_join.representatives(df).withColumnRenamed("doc_id", "d"), (F.col("d").eqNullSafe(F.col("doc_id"))) & (F.col("key") == ngram_join.text_key(F.col("text"))), "left_semi").distinct()
    want = {(3, near), (3, far), (None, "alone one two three four five"), (None, None), (9, None), (9, "")}
    assert {(r.doc_id, r.text) for r in kept.collect()} == want
    assert ngram_join.representatives(df.filter("false")).collect() == []


def test_colliding_hashes_are_told_apart(spark):
    """A hash of eight values for the first seed, and one of a few more for the next: every set id gets a number of its own."""
    from riskweave.llm.ngram_join import _node

    own = spark.createDataFrame([(bytes([i, i + 1]),) for i in range(40)] * 2, "sid binary")
    weak = lambda sid, seed: F.pmod(F.xxhash64(sid, F.lit(seed)), F.lit(8 if not seed else 1 << (4 + 4 * seed)))
    numbers = own.select("sid", _node(own, weak).alias("node")).distinct()
    assert numbers.count() == 40 and numbers.select("node").distinct().count() == 40
    assert own.select(_node(own).alias("node")).distinct().count() == 40


def test_join_over_colliding_hashes_equals_the_plain_one(spark, monkeypatch):
    from riskweave.llm import ngram_join

    rows = [(i, f"text number {i // 2} of these many words that are all alike but {'one' if i % 2 else 'some'}") for i in range(12)] + [(20, None), (21, "word"), (22, "word")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, ngram_join.join(docs, words=3, percent=60).collect()))
    real = ngram_join._node
    weak = lambda sid, seed: F.pmod(F.xxhash64(sid, F.lit(seed)), F.lit(3 if not seed else 1 << (8 * seed)))
    monkeypatch.setattr(ngram_join, "_node", lambda own: real(own, weak))
    assert sorted(map(tuple, ngram_join.join(docs, words=3, percent=60).collect())) == plain
