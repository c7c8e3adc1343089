import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from riskweave.llm import packing
from riskweave.llm.packing import best_fit, op1_packing, pack, pack_digest, sequences, trimmed

PATH = P.path("word_bpe_49k.json")


def brute_best_fit(lengths, window):
    rest = sorted(((n % window, d) for d, n in enumerate(lengths) if n % window), key=lambda x: (-x[0], x[1]))
    rooms = []
    for n, _ in rest:
        fits = [r for r in rooms if r >= n]
        if fits:
            r = min(fits)
            rooms.remove(r)
        else:
            r = window
        rooms.append(r - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_equals_brute_force(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(0, 150) for _ in range(rng.randint(0, 80))]
    pieces, fill = best_fit(lengths, 64)
    whole = sum(n // 64 for n in lengths)
    assert sorted(64 - n for n in fill.values())[whole:] == brute_best_fit(lengths, 64) or sorted(64 - n for n in fill.values()) == sorted([0] * whole + brute_best_fit(lengths, 64))
    check(trimmed(pieces, fill, 64, 4), lengths, 64, 4)


def check(pieces, lengths, window, most):
    by_doc, by_window = {}, {}
    for doc, start, n, w, offset in pieces:
        by_doc.setdefault(doc, []).append((start, n))
        by_window.setdefault(w, []).append((offset, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, k in sorted(by_doc.get(doc, [])):
            assert start == at and k > 0
            at += k
        assert at == n
    for own in by_window.values():
        at = 0
        for offset, k in sorted(own):
            assert offset == at
            at += k
        assert at <= window and (window - at <= most or not at & (at - 1))


def verify(rows, docs):
    tok = Tokenizer.from_file(PATH)
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in docs}
    by_doc, by_seq = {}, {}
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, ids in want.items():
        assert sum(n for _, n in by_doc[i]) == len(ids) and len({s for s, _ in by_doc[i]}) == len(by_doc[i])
    padding = 0
    for own in by_seq.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 4096
        padding += 4096 - at if at & (at - 1) else 0
    return padding / sum(len(x) for x in want.values())


def test_query_over_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert verify(op1_packing(spark, sf).collect(), docs) < 0.02


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text").collect()
    verify(pack_digest(odd_docs, PATH).collect(), docs)
    verify(pack_digest(odd_docs, PATH, batch_tokens=100).collect(), docs)
    assert pack_digest(no_docs, PATH).collect() == []


def test_sequences_are_padded(odd_docs):
    out = sequences(pack(odd_docs, PATH), pad=9).collect()
    for r in out:
        assert len(r.tokens) == (r.n_tokens if not r.n_tokens & (r.n_tokens - 1) else 4096)
        assert set(r.tokens[r.n_tokens :]) <= {9}


def test_constants():
    assert packing.WINDOW == 4096
