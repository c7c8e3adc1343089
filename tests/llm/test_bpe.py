import hashlib
import random

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskweave.llm.bpe import BytePairCoder, coder, decode, encode, op2_bpe, round_trip_digest

PATH = P.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


def want(text):
    return TOK.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    (ids,) = coder(PATH).encode([text])
    assert ids == want(text)
    assert coder(PATH).decode(ids) == TOK.decode(ids, skip_special_tokens=False) == text


def test_every_first_plane_character():
    for start in range(0, 0x3000, 64):
        text = "".join(c + "a" for c in map(chr, range(start, start + 64)))
        assert coder(PATH).encode([text])[0] == want(text), hex(start)


def test_single_trees_equal_matrices():
    own, rng = BytePairCoder(PATH), random.Random(1)
    words = ["".join(rng.choices("etaoin shrdlué", k=rng.randint(2, 30))).encode()[:33] for _ in range(500)]
    for w in words:
        width = 1 << (len(w) - 2).bit_length()
        assert own._merge_rows([w], width)[0] == own._merge_one(w)


def test_long_pieces():
    rng = random.Random(2)
    for text in ("a" * 20_000, "".join(rng.choices("abcdefgh", k=5000)), "-" * 3001, " " * 500 + "x", "é" * 999):
        assert coder(PATH).encode([text])[0] == want(text)


def test_bytes_that_are_not_utf8():
    ids = [coder(PATH).first[0xE3].item(), coder(PATH).first[0x41].item()]
    assert coder(PATH).decode(ids) == TOK.decode(ids, skip_special_tokens=False)


def digest(text):
    ids = want(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(TOK.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query_and_odd_rows(spark, sf, odd_docs, no_docs):
    for df, source in ((op2_bpe(spark, sf), spark.read.parquet(f"{sf}/documents.parquet")), (round_trip_digest(odd_docs, PATH), odd_docs)):
        docs = {i: digest(t or "") for i, t in source.select("doc_id", "text").collect()}
        assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()} == docs
    assert round_trip_digest(no_docs, PATH).collect() == []
    back = decode(encode(odd_docs, PATH), PATH)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in odd_docs.select("doc_id", "text").collect()}
