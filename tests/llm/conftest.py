import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, length string, ids int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, special strings, a clashing column."""
    texts = [
        None, "", " ", "a", "Hello, world! 12345", "it's we'll <|endoftext|> x<|startoftext|>y", "é́ ΣΑΣ \x1c\x85 mixed 日本語 🎉🎉", "x" * 5000, "ab " * 9000, "-" * 3000 + "\n\n\n   \t end",
        "Hello, world! 12345", "<|im_end|> tail  ", "\r\n\r\n", "word word   wide", "same", "same",
    ]
    rows = [(i, t, "en", None, None, "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
