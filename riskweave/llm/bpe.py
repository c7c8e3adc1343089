"""Byte-level BPE, encoding and decoding, by segment trees over the ranks of adjacent pairs.

A word's tree has a leaf for each symbol that holds the rank of the pair it begins, joined with its place, and each
inner node the least of its two; so the root is the leftmost pair of lowest rank. A merge changes three leaves and
their paths to the root, and merging ends when the root says that no pair can merge. Distinct short words go through
together: trees of the same size are rows of one matrix, and each step merges once in every row that still can.
Longer words have a tree of their own, so a piece of a million characters takes n log n steps.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import mapped, picked, rare_gc, slices, table
from .pieces import END, LETTER, OTHER, REMEMBERED, SPACE, PieceTable, kinds_of

#: Longer pieces of texts that aren't plain are forgotten at once.
LONGEST_REMEMBERED = 64
#: Pieces of more bytes get a tree of their own.
TOGETHER = 33
#: Rows of a matrix of trees.
ROWS = 4096

#: The pattern that splits text into pieces before any merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = np.iinfo(np.int64).max


PLAIN = re.compile(r"[\t\n\r -~¡-ÿ]*").fullmatch


def cut(data: np.ndarray) -> np.ndarray:
    """Where PATTERN's pieces begin in plain texts (printable ASCII and Latin-1), each ended by a byte 0, which is a piece too."""
    kinds, _ = kinds_of(data)
    begin = np.ones(len(data), dtype=bool)
    begin[1:] = kinds[1:] != kinds[:-1]
    begin[data == 0] = True
    # White space before another piece: all but its last character is a piece; a last blank belongs to what follows.
    last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & (kinds[1:] != END))
    begin[last] = True
    blank = data[last] == 32
    begin[last[blank] + 1] = False
    mark = np.flatnonzero(data[:-1] == 39)
    if len(mark):
        prior = np.maximum(mark - 1, 0)
        mark = mark[(kinds[mark + 1] == LETTER) & ((mark == 0) | (data[prior] != 32) & (kinds[prior] != OTHER))]
        a, b = data[mark + 1], data[np.minimum(mark + 2, len(data) - 1)]
        short = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        pair = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        begin[mark[short | pair] + 1] = False
        begin[mark[short] + 2] = True
        begin[mark[pair] + 3] = True
    return np.flatnonzero(begin)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: itself, or the next one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class BytePairCoder:
    """encode(texts) and decode(ids) by a tokenizer.json of a byte-level BPE."""

    def __init__(self, path: str):
        import regex

        rare_gc()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.first = np.array([vocab[x] for x in letters], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        self.result = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], _NONE), np.append(order, 0)
        self.rank = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        back = {c: b for b, c in enumerate(letters)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in special.items():
            self.bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.special = special
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces = regex.compile(PATTERN).findall
        self.table = PieceTable(self.merge)
        self.known: dict[str, tuple[int, ...]] = {t: (i,) for t, i in special.items()}

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or _NONE; a symbol of -1 is no symbol."""
        key = left << 32 | right
        at = np.searchsorted(self.keys[:-1], key)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.ranks[at], _NONE)

    def _merge_rows(self, words: list[bytes], width: int) -> list[tuple[int, ...]]:
        """Words of 2 to width + 1 bytes; width, a power of two, is the count of leaves."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        symbols = np.full((n, width + 2), -1, dtype=np.int64)
        symbols[np.arange(width + 2) < sizes[:, None]] = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        following = np.tile(np.arange(1, width + 3), (n, 1)).clip(max=width + 1)
        before = np.tile(np.arange(-1, width + 1), (n, 1))

        def leaf(ranks: np.ndarray, place: np.ndarray) -> np.ndarray:
            return np.where(ranks == _NONE, _NONE, ranks * width + place)

        tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
        tree[:, width:] = leaf(self._pair_ranks(symbols[:, :width], symbols[:, 1 : width + 1]), np.arange(width))
        for i in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            root = tree[rows, 1]
            place = root % width
            right = following[rows, place]
            after = following[rows, right]
            merged = self.result[root // width]
            symbols[rows, place] = merged
            symbols[rows, right] = -1
            following[rows, place] = after
            before[rows, after] = place
            prior = before[rows, place]
            has = prior >= 0
            near = np.where(has, prior, place)
            changed = [(place, leaf(self._pair_ranks(merged, symbols[rows, after]), place)), (right.clip(max=width - 1), None)]
            tree[rows, width + place] = changed[0][1]
            inside = right < width
            tree[rows[inside], width + right[inside]] = _NONE
            left = leaf(self._pair_ranks(symbols[rows, near], merged), near)
            tree[rows[has], width + near[has]] = left[has]
            for node in (place + width, right.clip(max=width - 1) + width, near + width):
                node = node >> 1
                while node[0]:  # all nodes of a step are on one level
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
            rows = rows[tree[rows, 1] != _NONE]
        kept = symbols >= 0
        ids, ends = symbols[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _merge_one(self, word: bytes) -> tuple[int, ...]:
        """A long word, with a tree of its own."""
        symbols = self.first[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(symbols)
        width = 1 << (n - 1).bit_length()
        none = 1 << 62
        rank, result = self.rank.get, self.result.tolist()
        following, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (r := rank(symbols[i] << 32 | symbols[i + 1])) is not None:
                tree[width + i] = r * width + i
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(place: int, value: int) -> None:
            i = width + place
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                least = a if a < b else b
                if tree[i] == least:
                    break
                tree[i] = least
                i >>= 1

        while tree[1] != none:
            r, place = divmod(tree[1], width)
            right = following[place]
            after = following[right]
            symbols[place], symbols[right] = result[r], -1
            following[place] = after
            put(right, none)
            if after < n:
                before[after] = place
                r = rank(symbols[place] << 32 | symbols[after])
                put(place, none if r is None else r * width + place)
            else:
                put(place, none)
            if (prior := before[place]) >= 0:
                r = rank(symbols[prior] << 32 | symbols[place])
                put(prior, none if r is None else r * width + prior)
        return tuple(s for s in symbols if s >= 0)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece."""
        found: dict[bytes, tuple[int, ...]] = {b"\0": ()}
        groups: dict[int, list[bytes]] = {}
        for b in pieces:
            if len(b) == 1 and b != b"\0":
                found[b] = (int(self.first[b[0]]),)
            elif len(b) > TOGETHER:
                found[b] = self._merge_one(b)
            elif len(b) > 1:
                groups.setdefault(1 << (len(b) - 2).bit_length(), []).append(b)
        for width, words in groups.items():
            for i in range(0, len(words), ROWS):
                found.update(zip(words[i : i + ROWS], self._merge_rows(words[i : i + ROWS], width), strict=True))
        return [found[b] for b in pieces]

    def split(self, text: str) -> list[str]:
        """Pieces in order; special strings are pieces of their own."""
        if not self.at_special or not (at := self.at_special.search(text)):
            return self.pieces(text)
        out, start = [], 0
        while at:
            out += self.pieces(text[start : at.start()])
            out.append(at[0])
            start = at.end()
            at = self.at_special.search(text, start)
        return out + self.pieces(text[start:])

    def _encode_plain(self, texts: list[str]) -> list[list[int]]:
        data = np.frombuffer("\0".join([*texts, ""]).encode(), dtype=np.uint8)
        at = cut(data)
        tokens, ends = self.table.encode(data, at)
        stops = np.append(0, ends)[np.searchsorted(at, np.flatnonzero(data == 0))].tolist()
        ids = tokens.tolist()
        return [ids[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def _encode_other(self, texts: list[str]) -> list[list[int]]:
        """Texts with other characters or special strings, cut by the pattern itself."""
        split = [self.split(t) for t in texts]
        known = self.known
        missing = [p for p in set().union(*split) if p not in known]
        if len(known) + len(missing) > REMEMBERED // 4:
            self.known = known = {t: (i,) for t, i in self.special.items()}
            missing = [p for p in set().union(*split) if p not in known]
        zero = (int(self.first[0]),)  # plain text keeps the byte 0 for its ends
        known.update(zip(missing, [zero if p == "\0" else ids for p, ids in zip(missing, self.merge([p.encode() for p in missing]), strict=True)], strict=True))
        out = [list(chain.from_iterable(map(known.__getitem__, ps))) for ps in split]
        if missing and max(map(len, missing)) > LONGEST_REMEMBERED:
            for p in missing:
                if len(p) > LONGEST_REMEMBERED:
                    del known[p]
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in texts]
        plain: list[int] = []
        other: list[int] = []
        for i, t in enumerate(texts):
            if t:
                (plain if PLAIN(t) and not (self.at_special and self.at_special.search(t)) else other).append(i)
        for own, encoded in ((plain, self._encode_plain), (other, self._encode_other)):
            if own:
                for i, ids in zip(own, encoded([texts[i] for i in own]), strict=True):
                    out[i] = ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode(errors="replace")


_coders: dict[str, BytePairCoder] = {}


def coder(path: str) -> BytePairCoder:
    if path not in _coders:
        _coders[path] = BytePairCoder(path)
    return _coders[path]


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_TEXTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids array<int>: every text's ids, special strings inside texts as their own ids.

    A null or empty text has no ids; a null doc_id stays null; repeated rows are encoded each; an empty table gives
    no rows; other columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", 1024):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.encode(part.column("text").to_pylist()), pa.list_(pa.int32()))], schema=_IDS)

    return mapped(picked(docs, doc_id=doc_id, text=text), rows, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, tokenizer: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text from encode()'s rows; bytes that aren't UTF-8 become U+FFFD; null ids give an empty text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([own.decode(x or []) for x in part.column("ids").to_pylist()], pa.string())], schema=_TEXTS)

    return mapped(picked(tokens, doc_id=doc_id, ids=ids), rows, "doc_id long, text string")


def round_trip_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each text, decodes its ids, and keeps digests of both."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", 1024):
                ids = own.encode(part.column("text").to_pylist())
                said = [hashlib.sha256(",".join(map(own.decimal.__getitem__, x)).encode()).hexdigest() for x in ids]
                back = [hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(said), pa.array(back)], schema=_DIGEST)

    return mapped(picked(docs, doc_id="doc_id", text="text"), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
