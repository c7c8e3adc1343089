"""Word n-gram hashes of many texts at once, over the bytes of their UTF-8.

A word is a run of bytes other than blank and \\t to \\r, with A-Z lower-cased. Its hash is a polynomial over random
values of its bytes, taken from running sums, then mixed; that of a word over LONG_WORD bytes, since a polynomial
can't tell some long words apart whatever its values, is a keyed digest. An n-gram's hash mixes those of its words. All
are 64 bits.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

#: Bytes from which on a word is hashed by a digest.
LONG_WORD = 64
_KEY = b"riskweave shingles"

_RNG = np.random.default_rng(20240229)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_PLACES = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each output bit depends on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for i, base in enumerate((_BASE, _BACK)):
            step = np.full(n, np.uint64(base & (1 << 64) - 1), dtype=np.uint64)
            step[0] = 1
            _powers[i] = np.cumprod(step)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each text's count of words."""
    coded = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join([*coded, b""]), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts = edge[~space[edge]]
    if not space[0]:
        starts = np.concatenate([[0], starts])
    ends = edge[space[edge]]  # the last byte is a line feed, so each word ends
    power, back = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    h = mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        h[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes().lower(), digest_size=8, key=_KEY).digest(), "little")  # lower() of bytes changes A-Z only
    last = np.cumsum([len(c) + 1 for c in coded])
    return h, np.diff(np.searchsorted(starts, last), prepend=0)


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Each text's sorted distinct n-gram hashes; fewer than n words make one n-gram; no words make none."""
    h, counts = word_hashes(texts)
    whole = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for k in range(n):
        whole += h[k : k + len(whole)] * _PLACES[k]
    whole = mixed(whole)
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            own = np.sort(whole[at : at + c - n + 1])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif c:
            own = mixed(np.array([(h[at : at + c] * _PLACES[:c]).sum(dtype=np.uint64) + np.uint64(c)], dtype=np.uint64))
        else:
            own = np.zeros(0, dtype=np.uint64)
        out.append(own)
        at += c
    return out


def set_id(hashes: np.ndarray) -> bytes:
    """16 bytes that stand for a set of hashes."""
    a = mixed(hashes + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
    b = mixed(hashes ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
    return np.array([a, b], dtype=">u8").tobytes()
