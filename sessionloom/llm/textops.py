"""Vectorised word work on Arrow text columns, shared by the operators.

A word is a maximal run of bytes other than space and 0x09-0x0D. Those six
bytes never occur inside a multi-byte UTF-8 character, so words are cut on the
raw column buffer. Hashes are polynomial (Rabin-Karp) modulo 2**64 over fixed
random letter values, finished by a 64-bit mixer; they are the same in every
process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD_SPACE = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 2_000_000

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(WORD_SPACE)] = True
_LETTER = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = {"letter": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept between calls."""
    have = _POWERS.get(kind)
    if have is None or len(have[0]) < n:
        m = max(n, 1 << 16)
        out = []
        for b in (_BASE[kind], pow(_BASE[kind], -1, 2**64)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[kind] = (out[0], out[1])
    return have


class Rolling:
    """Hashes of any spans of a value sequence from one pass of prefix sums."""

    def __init__(self, values: np.ndarray, kind: str):
        up, down = _powers(kind, len(values) + 1)
        self.down = down
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def windows(self, n: int) -> np.ndarray:
        """Hash of each run of n values, by start."""
        k = len(self.sums) - n
        if k <= 0:
            return np.zeros(0, np.uint64)
        return mix64((self.sums[n:] - self.sums[:k]) * self.down[:k] + np.uint64(n))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and len+1 offsets into them; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset: col.offset + n + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def chunks(col: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive whole texts, about ``most`` bytes at a time; a longer text stands alone."""
    raw, off = buffers(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, raw[off[i]: off[j]], off[i: j + 1] - off[i]
        i = j


def cut_words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and len+1 offsets of each text's words."""
    letter = ~_IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before = np.zeros(len(raw), bool)
    before[1:] = letter[:-1]
    after = np.zeros(len(raw), bool)
    after[:-1] = letter[1:]
    starts = np.flatnonzero(letter & (~before | edge[:-1]))
    ends = np.flatnonzero(letter & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Rolling(_LETTER[raw], "letter").spans(starts, ends)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values (block prefix and suffix minima, linear time)."""
    n = len(values)
    if n < w:
        return values[:0]
    pad = -n % w
    v = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, w)
    pre = np.minimum.accumulate(v, axis=1).ravel()
    suf = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[: n - w + 1], pre[w - 1: n])
