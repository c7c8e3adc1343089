"""Token ids from the tokenizers library, with one library call per distinct piece.

A pre-tokenizer that drops white space makes each blank-separated word's ids independent of its neighbours:
normalisation, special strings, the split pattern and the merges never see across a blank. Plain stretches of text
(printable ASCII and Latin-1) are lower-cased and cut into the pattern's pieces here, as arrays of bytes, and each
distinct piece's merges are left to the library; any other word goes through the whole library by itself.
"""

from __future__ import annotations

import json
import re

import numpy as np

from .common import serial_tokenizers
from .pieces import DIGIT, LETTER, OTHER, PieceTable, kinds_of

#: Characters of text that are cut into pieces at once.
AT_ONCE = 1 << 20

_PLAIN = re.compile(r"[\t\n\r -~¡-ÿ]*").fullmatch
_BLANK = re.compile(r"[\t\n\r ]+")
#: The pattern of word_bpe files, which _cut() follows.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def _cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of plain text, and where pieces and runs of white space begin."""
    kinds, lead = kinds_of(data)
    low = _LOW[data]
    starts_char = np.ones(len(data), dtype=bool)
    if len(lead):
        second = data[lead + 1]
        starts_char[lead + 1] = False
        capital = (data[lead] == 0xC3) & (second <= 0x9E) & (second != 0x97)
        low[lead[capital] + 1] += 0x20
    begin = np.ones(len(data), dtype=bool)
    begin[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT) & starts_char[1:]
    mark = np.flatnonzero(low[:-1] == 39)
    if len(mark):
        mark = mark[(kinds[mark + 1] == LETTER) & ((mark == 0) | (kinds[np.maximum(mark - 1, 0)] != OTHER))]
        a, b = low[mark + 1], low[np.minimum(mark + 2, len(low) - 1)]
        short = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        pair = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        begin[mark[short | pair] + 1] = False
        begin[mark[short] + 2] = True
        begin[mark[pair] + 3] = True
    return low, np.flatnonzero(begin)


class WordEncoder:
    """encode(texts): each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        serial_tokenizers()
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.merges = Tokenizer.from_file(path)
        self.merges.no_padding()
        self.merges.no_truncation()
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spec = json.loads(self.whole.to_str())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        #: Only this file layout may be cut into pieces here.
        self.cut_here = (steps[0].get("pattern"), steps[0].get("behavior"), steps[0].get("invert")) == ({"Regex": _PATTERN}, "Removed", True)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)").search
        self.table = PieceTable(self._learn)

    def _learn(self, pieces: list[bytes]) -> list[list[int]]:
        words = [p.decode() for p in pieces]
        real = [w for w in words if not w.isspace()]
        coded = iter(self.merges.encode_batch_fast(real, add_special_tokens=False) if real else [])
        return [[] if w.isspace() else next(coded).ids for w in words]

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        coded = "\n".join([*texts, ""]).encode()
        low, at = _cut(np.frombuffer(coded, dtype=np.uint8))
        tokens, ends = self.table.encode(low, at)
        # The first piece that begins at or after a text's end; white space alone may reach over it, and has no ids.
        lengths = [len(t) if t.isascii() else len(t.encode()) for t in texts]
        cuts = np.append(0, ends)[np.searchsorted(at, np.cumsum(np.array(lengths, dtype=np.int64) + 1), side="left")]
        view = memoryview(np.ascontiguousarray(tokens)).cast("B")
        return [bytes(view[4 * a : 4 * b]) for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]

    def _plain(self, text: str) -> bool:
        return bool(self.cut_here and _PLAIN(text) and not self.special(text))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        few: list[str | None] = []
        size = 0
        for t in texts:
            few.append(t)
            size += len(t or "")
            if size > AT_ONCE:
                out += self._encode(few)
                few, size = [], 0
        return out + (self._encode(few) if few else [])

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        plain: list[str] = []
        odd: dict[str, bytes] = {}
        made: list[list[int | str]] = []  # each text's parts: a number of plain, or an odd word
        for t in texts:
            parts: list[int | str] = []
            if t and self._plain(t):
                parts.append(len(plain))
                plain.append(t)
            elif t:
                run: list[str] = []
                for w in [*_BLANK.split(t), ""]:
                    if w and self._plain(w):
                        run.append(w)
                        continue
                    if run and (w or len(run)):
                        parts.append(len(plain))
                        plain.append(" ".join(run))
                        run = []
                    if w:
                        odd[w] = b""
                        parts.append(w)
            made.append(parts)
        done = self._encode_plain(plain) if plain else []
        if odd:
            for w, x in zip(odd, self.whole.encode_batch_fast(list(odd), add_special_tokens=False), strict=True):
                odd[w] = np.array(x.ids, dtype="<u4").tobytes()
        return [done[p[0]] if len(p) == 1 and isinstance(p[0], int) else b"".join([done[x] if isinstance(x, int) else odd[x] for x in p]) for p in made]


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """This worker's encoder for a file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
