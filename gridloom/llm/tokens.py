"""Words and word windows of Arrow text batches as hash arrays, computed on UTF-8 bytes with numpy.

A batch is cut into pieces of about half a megabyte, so the arrays stay in the processor's cache and memory
does not grow with the batch; one text longer than that is a piece of its own.  A word's hash is a
polynomial over its bytes and a window's hash one over its words' hashes, each from prefix sums, so all
windows of a piece cost a few passes.  Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19
U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE_KEYS = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BYTE_KEYS[65:91] = _BYTE_KEYS[97:123]  # A-Z hash like a-z
_BASES = {"byte": 0x9E3779B97F4A7C15 | 3, "word": 0xC2B2AE3D27D4EB4F | 3}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes that separate words, by rule.  Every byte above 127 belongs to a word.
SEPARATORS = {"spaces": np.zeros(256, bool), "alnum": np.zeros(256, bool)}
SEPARATORS["spaces"][[32, 9, 10, 11, 12, 13]] = True
SEPARATORS["alnum"][:128] = True
for _low, _high in ((48, 58), (65, 91), (97, 123)):
    SEPARATORS["alnum"][_low:_high] = False


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all output bits."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(kind)
    if have is None or len(have[0]) < n:
        size = 1 << max(20, n.bit_length())
        base = _BASES[kind]
        both = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)])
                     for b in (base, pow(base, -1, 2**64)))
        if size <= 1 << 22:
            _POWERS[kind] = both
        return both
    return have


def spans(values: np.ndarray, kind: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for each pair."""
    up, down = _powers(kind, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], dtype=np.uint64, out=total[1:])
    return mix((total[end] - total[start]) * down[start])


@dataclass
class Words:
    """Words of some rows: byte bounds in ``data``, row number, hash; ``first[r]:first[r + 1]`` are those of row r."""

    data: np.ndarray
    row_bytes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``n`` words within one row."""
        at = np.arange(max(0, len(self.hash) - n + 1))
        at = at[self.row[at] == self.row[at + n - 1]] if len(at) else at
        return at, spans(self.hash, "word", at, at + n) * U(2 * n + 1)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, lower-cased in A-Z and joined by one space."""
        return b" ".join(self.data[self.start[i]:self.end[i]].tobytes() for i in range(a, b)).lower()


def pieces(texts: pa.Array | pa.ChunkedArray, rule: str) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, words) of each piece of a text column."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1 + texts.offset)[texts.offset:]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + PIECE_BYTES, "right")) - 1)
        yield a, b, _words(data[off[a]:off[b]], off[a:b + 1] - off[a], SEPARATORS[rule])
        a = b


def _words(data: np.ndarray, row_bytes: np.ndarray, separators: np.ndarray) -> Words:
    rows = len(row_bytes) - 1
    inside = ~separators[data]
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    if len(data):
        before[row_bytes[:-1][row_bytes[:-1] < len(data)]] = False
        after[row_bytes[1:][row_bytes[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, row_bytes)
    row = np.repeat(np.arange(rows), np.diff(first))
    return Words(data, row_bytes, start, end, row, spans(_BYTE_KEYS[data], "byte", start, end), first)
