import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from riskweave.llm.secrets import MARK, detector_of

from .slow_secrets import slow_scan
from .test_ngram_join import brute


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    df = corpus_pipeline.language_id(spark, docs, sf)
    assert df.columns == docs.columns
    kept = {r.doc_id: r for r in df.collect()}
    assert len(kept) >= 0.99 * len(before) and all(before[i] == r for i, r in kept.items())
    df = corpus_pipeline.ngram_join(spark, df, sf)
    assert df.columns == docs.columns
    alone = {d for d, _, least in brute([(i, r.text) for i, r in kept.items()], 5, 80) if d == least}
    assert {r.doc_id for r in df.collect()} == alone
    detector = detector_of(df)
    df = corpus_pipeline.secret_scans(spark, df, sf)
    assert df.columns == docs.columns
    clean = {r.doc_id: r for r in df.collect()}
    for i, r in clean.items():
        want, text = [f for f in slow_scan(before[i].text, detector) if f[3] >= 0.5], before[i].text
        for _, a, b, _ in reversed(want):
            text = text[:a] + MARK + text[b:]
        assert r.text == text and (r.n_chars == len(text) or not want)
    tok, got = Tokenizer.from_file(P.path("word_bpe_49k.json")), {}
    for r in corpus_pipeline.packing(spark, df, sf).collect():
        got.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert got.keys() == clean.keys()
    for i, r in clean.items():
        ids = b"".join(x.to_bytes(4, "little") for x in [*tok.encode(r.text, add_special_tokens=False).ids, 2])
        assert b"".join(x for _, x in sorted(got[i])) == ids


def test_run_and_odd_rows(spark, sf, odd_docs, no_docs):
    assert corpus_pipeline.run(spark, sf).count() > 0
    df, seen = odd_docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, sf)
        assert df.columns == odd_docs.columns, name
        seen[name] = {r.doc_id: r.text for r in df.collect()}
    texts = seen["language_id"]
    assert {4, 10} <= texts.keys() and all(any(c.isalpha() for c in t) for t in texts.values())
    # Of equal texts the first stays.
    want = sorted(i for i, t in texts.items() if not any(j < i and u == t for j, u in texts.items()))
    got = sorted(seen["secret_scans"])
    assert got == want
    assert {r.doc_id for r in corpus_pipeline.packing(spark, df, sf).collect()} == set(want)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf).collect() == []


def test_rows_of_one_id_are_judged_by_their_texts(spark, sf):
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, words, "en", "a", 1), (2, words, "en", "a", 1), (2, "another text of its own", "en", "a", 1), (None, words, "en", "a", 1), (None, "no id and no copy of this one", "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.doc_id, r.text) for r in corpus_pipeline.ngram_join(spark, df, sf).collect()}
    assert got == {(1, words), (2, "another text of its own"), (None, "no id and no copy of this one")}
