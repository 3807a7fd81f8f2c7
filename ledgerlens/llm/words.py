"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow column.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``.  Hashes are polynomials modulo 2**64 (Rabin-Karp),
taken from prefix sums, so a window of any length costs the same.  All functions treat null as empty.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTERS = np.zeros(256, bool)  # letters, digits and all that isn't ASCII
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd, so that they have inverses modulo 2**64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        factors = [np.full(size, b, np.uint64) for b in (base, pow(base, -1, 2**64))]
        for x in factors:
            x[0] = 1
        have = tuple(np.cumprod(x) for x in factors)
        if size <= 1 << 23:  # powers for a longer text aren't kept
            _POWERS[base] = have
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each value starts, with the end."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


@dataclass
class Words:
    """Words of the texts of a column: ``first[d]:first[d + 1]`` are those of text d."""

    hashes: np.ndarray
    first: np.ndarray

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within a text, and the first of each text."""
        n = np.maximum(np.diff(self.first) - k + 1, 0)
        first = np.concatenate(([0], np.cumsum(n)))
        total = len(self.hashes)
        if not first[-1]:
            return np.zeros(0, np.uint64), first
        up, down = _powers(_WORD, total)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hashes * up[:total])))
        start = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], n)
        return mix64((sums[start + k] - sums[start]) * down[start] + np.uint64(k)), first


def words_of(column: pa.Array, lower: bool = False, inside: np.ndarray | None = None) -> Words:
    """lower: A-Z become a-z.  inside: which bytes make words, if not all but white space."""
    raw, at = column_bytes(column)
    if lower:
        raw = _LOWER[raw]
    inside = ~_SPACE[raw] if inside is None else inside[raw]
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = at[(at > 0) & (at < len(raw))]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _powers(_BYTE, max(1, len(raw)))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)])))
    hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(hashes, np.searchsorted(starts, at).astype(np.int64))
