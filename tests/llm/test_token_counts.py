import random

import public_tokenizers as P
from tokenizers import Tokenizer

from riskweave.llm.token_counts import Counter, count_tokens, op9_token_counts

PATH = P.path("byte_bpe_50k.json")


def test_spliced_counts_equal_whole_ones():
    tok, own, rng = Tokenizer.from_file(PATH), Counter(PATH), random.Random(3)
    parts = ["the ", " ", "\n", "  \n ", "'s", "don't", "12345", "é", "日本", "🎉", "<|endoftext|>", "<|endof", "x" * 40, "!!", "\t", "word"]
    for _ in range(150):
        text = "".join(rng.choices(parts, weights=[rng.random() for _ in parts], k=rng.randint(0, 120)))
        for chunk, overlap in ((16, 2), (40, 8), (64, 30)):
            assert own.long(text, chunk, overlap) == len(tok.encode(text, add_special_tokens=False).ids), repr(text)


def test_one_piece_longer_than_chunks():
    tok, own = Tokenizer.from_file(PATH), Counter(PATH)
    for text in ("a" * 3000, " " * 2000 + "b", "-" * 999 + "\n" * 999):
        assert own.long(text, 32, 4) == len(tok.encode(text, add_special_tokens=False).ids)


def want(docs):
    tok = Tokenizer.from_file(PATH)
    return {i: (len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in docs}


def test_query_and_odd_rows(spark, sf, odd_docs, no_docs):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op9_token_counts(spark, sf).collect()} == want(docs)
    odd = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    for chunk in (16_384, 100):
        assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(odd_docs, PATH, chunk=chunk, overlap=16).collect()} == want(odd)
    assert count_tokens(no_docs, PATH).collect() == []
