import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from riskweave.llm.token_files import op3_token_files, read_tokens, token_digests, write_tokens

PATH = P.path("word_bpe_49k.json")


def expected(docs):
    tok, at, out = Tokenizer.from_file(PATH), 0, {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        out[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def got(df):
    return {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in df.collect()}


def test_query_over_documents(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op3_token_files(spark, sf)) == expected(docs)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_odd_rows_and_encodings(spark, odd_docs, tmp_path, encoding):
    write_tokens(odd_docs, f"{tmp_path}/x", PATH, encoding=encoding, row_group_bytes=4096, page_bytes=512)
    assert got(token_digests(spark, f"{tmp_path}/x")) == expected([tuple(r) for r in odd_docs.select("doc_id", "text").collect()])
    few = read_tokens(spark, f"{tmp_path}/x", ["doc_id", "n_tokens"], 3, 5)
    assert sorted(r.doc_id for r in few.collect()) == [3, 4, 5]
    plan = few._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,3), LessThanOrEqual(doc_id,5)]" in plan
    assert "tokens" not in plan[plan.rindex("ReadSchema") :].replace("n_tokens", "")


def test_files_have_the_encoding_and_page_indexes(spark, odd_docs, tmp_path):
    import pyarrow.parquet as pq

    for encoding, name in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        write_tokens(odd_docs, f"{tmp_path}/{encoding}", PATH, encoding=encoding)
        files = [pq.ParquetFile(f).metadata for f in (tmp_path / encoding).glob("*.parquet")]
        chunks = [m.row_group(g).column(m.row_group(0).num_columns - 1) for m in files for g in range(m.num_row_groups)]
        assert any(name in c.encodings for c in chunks)
        assert all(m.row_group(g).column(1).has_offset_index for m in files for g in range(m.num_row_groups))


def test_empty_and_wrong(spark, no_docs, tmp_path):
    write_tokens(no_docs, f"{tmp_path}/none", PATH)
    assert token_digests(spark, f"{tmp_path}/none").collect() == []
    with pytest.raises(ValueError):
        write_tokens(no_docs, f"{tmp_path}/bad", PATH, encoding="plain")


def test_repeated_ids(spark, tmp_path):
    df = spark.createDataFrame([(1, "b c"), (1, "b c"), (None, "a"), (0, None)], "doc_id long, text string")
    write_tokens(df, f"{tmp_path}/x", PATH)
    rows = sorted(token_digests(spark, f"{tmp_path}/x").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 0, 1, 1] and [r.start for r in rows] == [0, 2, 3, 6]
