"""Packing: best-fit decreasing into fixed windows.

Each task packs its own documents, in batches of a bounded number of tokens, so nothing is shuffled, no state grows
with the corpus, and a lost task is simply run again (a partition's rows, and so its sequences, are the same each
time). A batch of some million tokens leaves at most a few windows that aren't full, so packing it apart from the
others costs next to nothing. sequence_id is the partition's number times 2**40 plus a count within it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import mapped, picked, slices, table
from .words import word_encoder

WINDOW = 4096
#: Tokens that a task packs at once (4 bytes each).
BATCH_TOKENS = 2 << 20
#: A window with more padding than this is cut into parts of a power of two, which need none.
MOST_PADDING = 64

PIECE_COLUMNS = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Windows:
    """Open windows under a segment tree indexed by remaining capacity: tightest(n) finds the smallest capacity >= n."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)  # windows open below each node
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.tree[i] += n
            i >>= 1

    def put(self, capacity: int, window: int) -> None:
        if capacity:
            self.open[capacity].append(window)
            self._add(capacity, 1)

    def tightest(self, least: int) -> int:
        """The smallest open capacity of at least this, or -1."""
        tree, i = self.tree, least + self.leaves
        if tree[i]:
            return least
        while i > 1:  # up until a right-hand sibling has something, then down its left side
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1

    def take(self, capacity: int) -> int:
        self._add(capacity, -1)
        return self.open[capacity].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int]]:
    """Pieces (document, start, length, window, offset) and each window's fill.

    Documents longer than a window are first cut into full windows; what remains goes, longest first (ties: earlier
    document), to the open window with the least room that holds it, or else to a new one.
    """
    pieces, fill, rest = [], {}, []
    for doc, n in enumerate(lengths):
        for k in range(n // window):
            pieces.append((doc, k * window, window, len(fill), 0))
            fill[len(fill)] = window
        if n % window:
            rest.append((doc, n - n % window, n % window))
    windows = Windows(window)
    for doc, start, n in sorted(rest, key=lambda x: (-x[2], x[0])):
        room = windows.tightest(n)
        if room < 0:
            w, room = len(fill), window
            fill[w] = 0
        else:
            w = windows.take(room)
        pieces.append((doc, start, n, w, fill[w]))
        fill[w] += n
        windows.put(room - n, w)
    return pieces, fill


def trimmed(pieces: list[tuple[int, int, int, int, int]], fill: dict[int, int], window: int, most: int) -> list[tuple[int, int, int, int, int]]:
    """Cuts windows with too much padding into parts of a power of two, the largest first, until little is left."""
    parts: dict[int, list[tuple[int, int, int]]] = {}
    names = len(fill)
    for w, n in fill.items():
        if window - n > most and n & (n - 1):
            at, own = 0, []
            while at < n:
                size = 1 << ((n - at).bit_length() - 1)
                own.append((at, at + size, w if not at else names))
                names += at > 0
                at += size
            parts[w] = own
    out = []
    for doc, start, n, w, offset in pieces:
        if w not in parts:
            out.append((doc, start, n, w, offset))
            continue
        for a, b, name in parts[w]:
            lo, hi = max(a, offset), min(b, offset + n)
            if lo < hi:
                out.append((doc, start + lo - offset, hi - lo, name, lo - a))
    return out


def _pack_batch(ids: list, docs: list[bytes], base: int, window: int, most: int) -> tuple[dict, int]:
    sizes = [len(b) // 4 for b in docs]
    pieces, fill = best_fit(sizes, window)
    pieces = trimmed(pieces, fill, window, most)
    names = {w: base + i for i, w in enumerate(sorted({p[3] for p in pieces}))}
    return {
        "doc_id": [ids[d] for d, *_ in pieces], "start": [p[1] for p in pieces], "length": [p[2] for p in pieces],
        "ids": [docs[d][4 * s : 4 * (s + n)] for d, s, n, *_ in pieces], "doc_tokens": [sizes[p[0]] for p in pieces],
        "sequence_id": [names[p[3]] for p in pieces], "offset": [p[4] for p in pieces],
    }, base + len(names)


def packer(tokenizer: str, end: int, window: int, batch_tokens: int, most: int, finish: Callable[[dict], dict], schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = word_encoder(tokenizer), end.to_bytes(4, "little")
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        ids, docs, held = [], [], 0
        for batch in batches:
            for part in slices(batch, "text", 1024):
                docs += [b + tail for b in encoder.encode(part.column("text").to_pylist())]
                ids += part.column("doc_id").to_pylist()
                held += sum(len(b) // 4 for b in docs[-part.num_rows :])
                if held >= batch_tokens:
                    got, base = _pack_batch(ids, docs, base, window, most)
                    ids, docs, held = [], [], 0
                    yield from pa.Table.from_pydict(finish(got), schema=schema).to_batches(max_chunksize=2000)
        if docs:
            got, base = _pack_batch(ids, docs, base, window, most)
            yield from pa.Table.from_pydict(finish(got), schema=schema).to_batches(max_chunksize=2000)

    return rows


_PIECES = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")])


def _same(got: dict) -> dict:
    return got


def pack(docs: DataFrame, tokenizer: str, end: int = 2, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, batch_tokens: int = BATCH_TOKENS, most_padding: int = MOST_PADDING) -> DataFrame:
    """Pieces of documents in sequences of at most `window` tokens: PIECE_COLUMNS, ids as little-endian unsigned 32-bit.

    A null or empty text is the end id alone; a null doc_id stays null; rows with equal ids or texts are separate
    documents; an empty table gives no rows; other columns are ignored. Every id lies in exactly one piece. `start` is
    the count of the document's ids before the piece, `offset` its place in the sequence, gapless from 0.
    A writer pads each sequence to `window` unless its length is a power of two.
    """
    df = picked(docs, doc_id=doc_id, text=text)
    return mapped(df, packer(tokenizer, end, window, batch_tokens, most_padding, _same, _PIECES), PIECE_COLUMNS)


_DIGEST = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _digest(got: dict) -> dict:
    ids = got.pop("ids")
    return got | {"ids_crc32": [zlib.crc32(b) for b in ids]}


def pack_digest(docs: DataFrame, tokenizer: str, end: int = 2, window: int = WINDOW, batch_tokens: int = BATCH_TOKENS, most_padding: int = MOST_PADDING) -> DataFrame:
    """pack() with each piece's ids as their crc32, taken in the task that packs them."""
    rows = packer(tokenizer, end, window, batch_tokens, most_padding, _digest, _DIGEST)
    return mapped(picked(docs, doc_id="doc_id", text="text"), rows, ", ".join(f"{n} long" for n in _DIGEST.names))


def sequences(pieces: DataFrame, pad: int = 0, window: int = WINDOW) -> DataFrame:
    """Whole padded sequences (sequence_id, n_tokens, tokens array<int>) from pack()'s pieces; a group is one window."""

    def build(key, t):
        t = t.sort_by("offset")
        ids = np.frombuffer(b"".join(t.column("ids").to_pylist()), dtype="<u4").astype(np.int32)
        n = len(ids)
        if n < window and n & (n - 1):
            ids = np.concatenate([ids, np.full(window - n, pad, np.int32)])
        return pa.table({"sequence_id": pa.array([key[0].as_py()], pa.int64()), "n_tokens": pa.array([n], pa.int64()), "tokens": pa.array([ids], pa.list_(pa.int32()))})

    return pieces.groupBy("sequence_id").applyInArrow(build, "sequence_id long, n_tokens long, tokens array<int>")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
