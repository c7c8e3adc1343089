"""Token counts: huge documents are encoded in overlapping chunks that are spliced where both provably agree.

A byte-level pre-tokenizer reads left to right, and from a boundary between two of its pieces it reads on without
regard to what came before. So a boundary that is right in the chunk before (it lies clear of that chunk's end) and
that the next chunk has too is a place from which the next chunk's pieces are right. If the overlap holds no such
place, it is widened, at worst to the whole chunk before.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import PLAIN, cut
from .common import mapped, picked, serial_tokenizers, slices, table
from .pieces import PieceTable

#: Texts of more characters are encoded in chunks.
CHUNK = 16_384
#: Characters that a chunk shares with the one before, at first.
OVERLAP = 256

_counters: dict[str, "Counter"] = {}


class Counter:
    def __init__(self, path: str):
        serial_tokenizers()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(self.tokenizer.to_str())
        kind = spec.get("pre_tokenizer") or {}
        own_pattern = spec.get("normalizer") is None and (kind.get("type"), kind.get("use_regex"), kind.get("add_prefix_space")) == ("ByteLevel", True, False)
        self.merges = Tokenizer.from_file(path)
        self.merges.no_padding()
        self.merges.no_truncation()
        self.merges.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)").search
        #: Plain texts are cut by the file's own pattern here, so that the library merges each distinct piece once.
        self.table = PieceTable(self._learn) if own_pattern else None
        #: A chunk's end may cut a special string or the last piece in two.
        self.guard = max([1, *(len(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())])

    def _boundaries(self, text: str, at: int) -> tuple[dict[int, int], int, int]:
        """Places (in the document) where a piece starts, with the tokens before it in this chunk; all tokens; last start."""
        x = self.tokenizer.encode(text, add_special_tokens=False)
        starts, before, last = {}, None, at
        for i, (word, (a, _)) in enumerate(zip(x.word_ids, x.offsets, strict=True)):
            if word is None or word != before:
                starts[at + a] = i
                last = at + a
            before = word
        return starts, len(x.ids), last

    def long(self, text: str, chunk: int, overlap: int) -> int:
        """Tokens of a text of any length; equal to encoding it whole."""
        total, start, size = 0, 0, chunk
        mine, n, last = self._boundaries(text[:size], 0)
        end = min(size, len(text))
        while end < len(text):
            wide = overlap
            while True:
                begin = max(start, end - wide)
                theirs, m, final = self._boundaries(text[begin : begin + chunk + wide], begin)
                common = [p for p in mine.keys() & theirs.keys() if start <= p < min(last, end - self.guard)]
                if common:
                    break
                if begin == start:  # one piece fills the chunk: encode a longer one
                    begin, chunk = start, 2 * chunk
                    theirs, m, final = self._boundaries(text[begin : begin + chunk + wide], begin)
                    common = [start]
                    break
                wide *= 4
            p = max(common)
            total += mine[p] - mine.get(start, 0)
            mine, n, last = theirs, m, final
            start, end = p, min(begin + chunk + wide, len(text))
        return total + n - mine.get(start, 0)

    def _learn(self, pieces: list[bytes]) -> list[list[int]]:
        real = [p.decode() for p in pieces if p != b"\0"]
        coded = iter(self.merges.encode_batch_fast(real, add_special_tokens=False) if real else [])
        return [[] if p == b"\0" else next(coded).ids for p in pieces]

    def _plain(self, texts: list[str]) -> list[int]:
        data = np.frombuffer("\0".join([*texts, ""]).encode(), dtype=np.uint8)
        at = cut(data)
        _, ends = self.table.encode(data, at)
        return np.diff(np.append(0, ends)[np.searchsorted(at, np.flatnonzero(data == 0))], prepend=0).tolist()

    def count(self, texts: list[str | None], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        """Tokens of each text; null counts as empty."""
        out = [0] * len(texts)
        plain, other = [], []
        for i, t in enumerate(texts):
            if t and len(t) > chunk:
                out[i] = self.long(t, chunk, overlap)
            elif t:
                (plain if self.table and PLAIN(t) and not self.special(t) else other).append(i)
        if plain:
            for i, n in zip(plain, self._plain([texts[i] for i in plain]), strict=True):
                out[i] = n
        if other:
            for i, x in zip(other, self.tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False), strict=True):
                out[i] = len(x)
        return out


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), one row a document.

    A null or empty text has 0 of both; a null doc_id stays null; repeated rows are counted each; an empty table
    gives no rows; other columns are ignored. tokenizer: a byte-level file of the tokenizers library.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", 1024):
                texts = part.column("text").to_pylist()
                n = own.count(texts, chunk, overlap)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], schema=_COUNTS)

    return mapped(picked(docs, doc_id=doc_id, text=text), rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
