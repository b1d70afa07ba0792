"""64-bit hashes of a text's words, all of them in a few array operations."""

from __future__ import annotations

import numpy as np

#: The base of the polynomial in a word's bytes: odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: A longer text is hashed in blocks of about so many bytes, cut at white space, so memory is bounded.
BLOCK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each byte; and whether it is white space of the contracts.
BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_upto(n: int) -> list[np.ndarray]:
    """Powers 0..n-1 at least of BASE and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers


def _block_hashes(raw: bytes) -> np.ndarray:
    a = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], ~IS_SPACE[a], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers_upto(len(a) + 1)
    # sums of byte number times power up to each place: a word's own sum is a difference, moved back to power 0
    sums = np.zeros(len(a) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE[a] * up[: len(a)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * down[starts])


def word_hashes(raw: bytes) -> np.ndarray:
    """The hash of every word [^\\x20\\x09-\\x0D]+ of a text in UTF-8, in order; A-Z count as a-z."""
    raw = raw.lower()  # of bytes, so only A-Z change
    if len(raw) <= BLOCK_BYTES:
        return _block_hashes(raw)
    parts, at = [], 0
    while at < len(raw):
        end = min(at + BLOCK_BYTES, len(raw))
        while end < len(raw) and not IS_SPACE[raw[end]]:
            end += 1
        parts.append(_block_hashes(raw[at:end]))
        at = end
    return np.concatenate(parts)
