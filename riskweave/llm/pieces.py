"""Ids of pieces of text, remembered: bytes cut at given places, each distinct piece looked up once a lot."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Distinct pieces, and bytes of them, whose ids a worker remembers before it starts afresh.
REMEMBERED, REMEMBERED_BYTES = 400_000, 32 << 20
#: Pieces that are learnt at once: the library's results are large objects.
LEARNT_AT_ONCE = 4096

SPACE, LETTER, DIGIT, OTHER, END = 0, 1, 2, 3, 4


def classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each ASCII byte, and of each second byte after C2 and C3 (U+0080 to U+00FF)."""
    kind = lambda c: LETTER if c.isalpha() else DIGIT if c.isnumeric() else SPACE if c in "\t\n\r " else OTHER
    one = np.array([kind(chr(b)) if b < 128 else OTHER for b in range(256)], dtype=np.uint8)
    one[0] = END
    two = np.full((2, 256), OTHER, dtype=np.uint8)
    for c in range(0x80, 0x100):
        two[(c >> 6) - 2, 0x80 | c & 0x3F] = kind(chr(c))
    return one, two


_ONE, _TWO = classes()


def kinds_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte of plain text (a character's for both its bytes), and places of first bytes of two."""
    kinds = _ONE[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        kinds[lead] = kinds[lead + 1] = _TWO[data[lead] - 0xC2, data[lead + 1]]
    return kinds, lead


class PieceTable:
    """learn: ids of pieces that aren't known."""

    def __init__(self, learn: Callable[[list[bytes]], list]):
        self.learn = learn
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.ids = np.zeros(1 << 16, dtype="<u4")
        self.used = 0
        self.starts, self.sizes = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)

    def _add(self, pieces: list[bytes]) -> None:
        flat: list[int] = []
        sizes = []
        for i in range(0, len(pieces), LEARNT_AT_ONCE):
            for ids in self.learn(pieces[i : i + LEARNT_AT_ONCE]):
                flat += ids
                sizes.append(len(ids))
        n, m = len(self.known), len(pieces)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), dtype="<u4")])
        if n + m > len(self.starts):
            more = np.zeros(max(len(self.starts), m), dtype=np.int64)
            self.starts, self.sizes = np.concatenate([self.starts, more]), np.concatenate([self.sizes, more])
        self.ids[self.used : self.used + len(flat)] = flat
        self.sizes[n : n + m] = sizes
        self.starts[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.held += sum(map(len, pieces))
        self.known.update(zip(pieces, range(n, n + m), strict=True))

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces that begin at the given places, in order, and the count of ids up to each piece's end."""
        offsets = np.append(at, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(names) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self._forget()
        slots = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._add([names[i] for i in new.tolist()])
        slots = slots[pieces.indices.to_numpy()]
        sizes = self.sizes[slots]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[slots] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], ends
