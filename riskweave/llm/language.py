"""Language ID by language-bitmask n-gram filters.

Each language has a Bloom filter of the n-grams that are typical of it; the filters are bit-sliced, so one lookup in
an array of masks (as many 64-bit words a slot as the languages need) tells for all languages at once which may hold an n-gram. A text's hits are counted for each
language, corrected for that filter's false positives, and the language with most wins.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_fold, mapped, picked, rare_gc, slices, table

#: Labelled rows of each language that the filters are learnt from, about: the bound of the sample.
SAMPLE_ROWS = 3000
#: An n-gram is learnt if this share of a language's sampled texts hold it, and ...
LEAST_SHARE = 0.005
#: ... at least this part of the share in the language where it is most common.
LEAST_OF_TOP = 0.25
#: Slots of the filters for each n-gram of the largest language.
SLOTS_EACH = 12
UNKNOWN = "und"

_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))
_MIX = np.uint64(0xFF51AFD7ED558CCD)

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all 3- and 4-grams inside words (with at most a boundary on either side), each one's text, and whether each text has a letter."""
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer("\0".join([*low, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    own = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    is_letter = letters()[code]
    some = np.zeros(len(low), dtype=bool)
    some[own[is_letter]] = True
    c = np.where(is_letter, code, 0).astype(np.uint64)
    hashes, owners = [], []
    for n in (3, 4):
        size = max(0, len(c) + 2 - n)  # from the boundary before the first character to the one after the last
        padded = np.concatenate([[np.uint64(0)], c])
        ok = padded[1 : 1 + size] != 0
        if n == 4:
            ok &= padded[2 : 2 + size] != 0
        at = np.flatnonzero(ok)
        h = np.full(len(at), np.uint64(n), dtype=np.uint64)
        for k in range(n):
            h += padded[at + k] * _SEEDS[k]
        h ^= h >> np.uint64(31)
        h *= _MIX
        hashes.append(h ^ (h >> np.uint64(29)))
        owners.append(own[at])
    return np.concatenate(hashes), np.concatenate(owners), some


@dataclass
class Filters:
    """languages by bit; masks by slot and word of 64 languages; each filter's share of set slots, squared: its false-positive rate."""

    languages: list[str]
    masks: np.ndarray
    false: np.ndarray

    @classmethod
    def of(cls, sets: dict[str, np.ndarray]) -> "Filters":
        names = sorted(sets)
        largest = max([1, *(len(sets[x]) for x in names)])
        masks = np.zeros((1 << (SLOTS_EACH * largest - 1).bit_length(), max(1, -(-len(names) // 64))), dtype=np.uint64)
        out = cls(names, masks, np.zeros(len(names)))
        for bit, name in enumerate(names):
            word, one = masks[:, bit // 64], np.uint64(1) << np.uint64(bit % 64)
            for slot in out._slots(sets[name]):
                word[slot] |= one
            out.false[bit] = ((word & one) > 0).mean() ** 2
        return out

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = np.uint64(len(self.masks) - 1)
        return (h & last).astype(np.int64), (h >> np.uint64(32) & last).astype(np.int64)

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corrected hits of each text and language; n-grams of each text; whether it has a letter."""
        h, own, some = grams(texts)
        a, b = self._slots(h)
        mask = self.masks[a] & self.masks[b]
        n, hits = len(texts), []
        for k in range(0, max(1, len(self.languages)), 8):
            part = (mask[:, k // 64] >> np.uint64(k % 64) & np.uint64(255)).astype(np.int64)
            by = np.bincount(own * 256 + part, minlength=256 * n).reshape(n, 256)
            hits.append(by @ np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"))
        total = np.bincount(own, minlength=n)
        found = np.concatenate(hits, axis=1)[:, : len(self.languages)]
        return ((found - total[:, None] * self.false) / (1 - self.false)).clip(min=0), total, some

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and the corrected share of the text's n-grams that it holds (ties: the first by name)."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        hits, total, some = self.counts(texts)
        best = hits.argmax(1)
        score = np.where(some & (total > 0), hits.max(1) / np.maximum(total, 1), 0.0).clip(0, 1)
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), some.tolist(), strict=True)], score


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each language and n-gram, the texts of this task that hold it."""
    found: dict[str, list[np.ndarray]] = {}

    def out(lang: str, parts: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    for batch in batches:
        for part in slices(batch, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                own = found.setdefault(lang, [])
                own.append(np.unique(grams([text])[0]))
                if len(own) >= 256:
                    yield out(lang, own)
                    own.clear()
    for lang, own in found.items():
        if own:
            yield out(lang, own)


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Filters:
    """Filters from rows of doc_id, text, lang (not null).

    About sample_rows texts of each language are read, whole, chosen by a hash of doc_id; n-grams are counted on the
    executors, and only those common enough reach the driver: at most 1 / LEAST_SHARE times the n-grams of a text.
    """
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Filters.of({})
    part = F.create_map(*[x for lang, n in totals.items() for x in (F.lit(lang), F.lit(min(1.0, sample_rows / n)))])[F.col("lang")]
    drawn = labelled.filter((F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)) < part)
    counted = mapped(drawn.select("lang", "text"), _shares, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    texts = {lang: min(n, sample_rows) for lang, n in totals.items()}
    least = F.create_map(*[x for lang, n in texts.items() for x in (F.lit(lang), F.lit(max(1.0, LEAST_SHARE * n)))])[F.col("lang")]
    common = counted.filter(F.col("n") >= least).toPandas()
    share = common["n"] / common["lang"].map(texts)
    top = share.groupby(common["gram"]).transform("max")
    kept = common[share >= LEAST_OF_TOP * top]
    return Filters.of({lang: kept.loc[kept["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64) for lang in totals})


def identify(docs: DataFrame, filters: Filters, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs, then lang_pred and score (0 to 1) under the given names, which replace columns of these names.

    A null text, or one without a letter, is `und` with score 0, and so is every text if nothing was learnt; an empty
    table gives no rows; repeated rows are predicted each. Only the text counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # bounded by the sample: see fit()
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    fields = schema.fieldNames()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare_gc()
        for batch in batches:
            for part in slices(batch, text):
                langs, score = shared.value.predict(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score)], names=fields)

    return mapped(docs, rows, schema)


def training_fold() -> Column:
    """Rows whose lang may be learnt from: crc32(doc_id as text) mod 4 is not 2."""
    return crc_fold() != 2


def filters_of(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Filters:
    """Filters learnt from the rows of docs outside the held-out fold."""
    return fit(picked(docs, doc_id="doc_id", text="text", lang="lang").filter(training_fold() & F.col("lang").isNotNull()), sample_rows)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select(F.col("doc_id"), F.coalesce(crc_fold() == 2, F.lit(False)).alias("held_out"), F.col("text")), filters_of(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score")
