"""Cleans a document table for training: language ID, near-duplicate removal, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; between stages the rows are
written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import staged, table
from riskweave.llm.language import UNKNOWN, filters_of, identify
from riskweave.llm.ngram_join import representatives, text_key
from riskweave.llm.packing import pack
from riskweave.llm.secrets import redact

#: A document stays if its language's filter holds at least this share of its n-grams.
LEAST_LANGUAGE = 0.3
#: Near duplicates: five words, similarity of 0.8 or more.
WORDS, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that docs are labelled with; others go, and so do those without a letter.

    Where nothing is labelled, nothing can be told, and all with a letter stay.
    """
    filters = filters_of(docs)
    found = identify(docs, filters, names=("__lang_pred", "__score"))
    if filters.languages:
        found = found.filter((F.col("__lang_pred") != UNKNOWN) & (F.col("__score") >= LEAST_LANGUAGE))
    else:
        found = found.filter(F.col("text").rlike(r"\p{L}"))
    return found.select(docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one of smallest doc_id; a group in which all ids are null keeps one of its rows.

    Rows that share an id are told apart by their texts, and a repeated row stays once. A text without words, or a null
    one, is no one's copy.
    """
    kept = representatives(docs, WORDS, PERCENT).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    keyed = docs.withColumn("__own", text_key(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__own"]).select(docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark, and n_chars counted anew where that changed a text.

    Null and empty texts stay as they are, repeated rows are treated alike, texts of any length are treated whole, and
    an empty table stays empty.
    """
    return redact(docs, path="source")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of at most 4096 tokens.

    A null text counts as empty, and each document ends with its id, so it has a piece; rows that share an id are
    packed each; long documents are cut into full windows first; an empty table gives no rows.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("ngram_join", ngram_join), ("secret_scans", secret_scans), ("packing", packing)]

#: SQL can express none of the stages; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
