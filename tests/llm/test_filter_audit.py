import re
from itertools import permutations

from riskweave.llm.filter_audit import filter_audit, op12_filter_audit


def brute(docs, labels):
    """Every filter order run over every document by itself."""
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": any(i is not None and j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        rows.append((lang or "", fails, any(d is not None and d == i and q == 1 for d, q, _ in labels), any(d is not None and d == i and t == 1 for d, _, t in labels)))
    out, shares = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone, stay = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                redundant = sum(r[1][f] for r in own) - len(gone)
                unique = sum(r[1][f] and sum(r[1].values()) == 1 for r in own)
                out[part, "".join(order), k] = [len(stay), len(gone), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shares[part, f] = shares.get((part, f), 0) + len(gone)
                left = stay
    return {(p, o, k): (*v, shares[p, o[k - 1]]) for (p, o, k), v in out.items()}


def audited(df):
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}
    assert df.count() == len(got)
    return got


def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert audited(op12_filter_audit(spark, sf)) == brute(docs, labels)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(120))
    docs = [
        (1, long, "en"), (1, long, "en"), (2, long, "en"), (3, long, None), (None, long, "en"), (4, None, "de"), (5, "", "de"), (6, "same " * 150, "en"), (7, "SHOUT " * 3, ""), (8, long + " 5 %", "en"),
        (9, "\x0b\x0c \t\r\n", "fr"), (10, "é" * 9 + "A", "fr"), (11, long.upper(), "fr"), (8, long + " 5 %", "en"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (3, None, None), (8, 1, 1), (None, 1, 1), (6, 0, 1), (99, 1, 1)]
    df = spark.createDataFrame([(*d, "clash", 3, True) for d in docs], "doc_id long, text string, lang string, part string, n int, fails_A boolean")
    said = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, text string")
    assert audited(filter_audit(df, said)) == brute(docs, labels)
    assert filter_audit(df.filter("false"), said).collect() == []
    assert {k: v[:4] for k, v in audited(filter_audit(df, said.filter("false"))).items()} == {k: v[:4] for k, v in brute(docs, []).items()}


def test_a_text_of_many_copies(spark):
    docs = [(i, "copy of a text", "en" if i % 2 else "de") for i in range(400)] + [(1000 + i, f"own text {i}", "en") for i in range(40)]
    assert audited(filter_audit(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(8), spark.createDataFrame([(0, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int"))) == brute(docs, [(0, 1, 1), (5, 1, 0)])
