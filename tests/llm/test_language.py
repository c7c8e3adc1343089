import zlib

import numpy as np

from riskweave.llm.language import Filters, filters_of, grams, identify, op10_language_id


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op10_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_grams_of_words():
    h, own, some = grams(["ab", "", None, "12 !", "abc"])
    # " ab", "ab " and " ab " of the first; " ab", "abc", "bc ", " abc" and "abc " of the last.
    assert sorted(own.tolist()) == [0] * 3 + [4] * 5 and len(set(h[own == 0]) & set(h[own == 4])) == 1
    assert some.tolist() == [True, False, False, False, True]
    assert len(grams([])[0]) == 0 and len(np.unique(grams(["Ab ab"])[0])) == len(np.unique(grams(["ab"])[0]))


def test_filters_correct_false_positives():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(0, 1 << 63, 50).astype(np.uint64)
    f = Filters.of({"aa": a, "bb": b})
    x, y = f._slots(a)
    assert ((f.masks[x] & f.masks[y] & np.uint64(1)) > 0).all()
    assert f.masks.shape[1] == 1
    x, y = f._slots(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    assert abs(((f.masks[x] & f.masks[y] & np.uint64(1)) > 0).mean() - f.false[0]) < 0.01


def test_odd_rows(spark, odd_docs, no_docs):
    filters = filters_of(odd_docs)
    rows = {r.doc_id: r for r in identify(odd_docs, filters).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == rows[2].lang_pred == rows[12].lang_pred == "und"
    assert rows[4].lang_pred == "en" and rows[4].length == "clash" and rows[4].text == "Hello, world! 12345"
    assert identify(no_docs, filters).collect() == []
    unlearnt = identify(odd_docs, filters_of(no_docs)).collect()
    assert {r.lang_pred for r in unlearnt} == {"und"} and {r.score for r in unlearnt} == {0.0}


def test_more_languages_than_a_word_has_bits(spark):
    """130 invented languages, each with words of its own: all are learnt and told apart."""
    names = [f"l{i:03d}" for i in range(130)]
    letter = lambda i: "".join(chr(97 + (i * k + k) % 26) for k in range(3, 7)) + chr(97 + i % 26) + chr(97 + i // 26)
    rows = [(100 * i + j, f"{letter(i)} {letter(i)}x {letter(i)}{'yz'[j % 2]}", name) for i, name in enumerate(names) for j in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = filters_of(docs)
    assert filters.masks.shape[1] == 3 and len(filters.languages) == 130
    got = identify(docs, filters).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
