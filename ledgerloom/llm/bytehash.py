"""Hashes of words, lines and n-grams, by numpy on the UTF-8 bytes of many texts at once.

A slice is hashed by a polynomial over the ring of 64-bit integers with a random value
for each byte, then mixed with its length. Prefix sums are made block by block, so a very
long text needs no more working memory than its own bytes and a few numbers a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 17
_BITS = 1 << 64
_BASE = 0x9E3779B97F4A7C15
_ROLL = np.uint64(0xD6E8FEB86659FD93)


def _one(value: int) -> np.ndarray:
    return np.array([value % _BITS], np.uint64)


def _powers(base: int) -> np.ndarray:
    steps = np.full(BLOCK, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


_POW, _INV = _powers(_BASE), _powers(pow(_BASE, -1, _BITS))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _prefix_at(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The polynomial's value before each of the ascending positions."""
    out = np.empty(len(at), np.uint64)
    carry, scale, step, done = _one(0), _one(1), _one(pow(_BASE, BLOCK, _BITS)), 0
    for low in range(0, len(data) + 1, BLOCK):
        part = table[data[low : low + BLOCK]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _POW[: len(part)], out=sums[1:])
        sums = sums * scale + carry
        upto = np.searchsorted(at, low + BLOCK)
        out[done:upto] = sums[at[done:upto] - low]
        carry, scale, done = sums[-1:], scale * step, upto
    return out


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each slice; starts and ends ascend. fold: A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    table = _FOLDED if fold else _BYTES
    high = starts // BLOCK
    far = np.array([pow(pow(_BASE, BLOCK, _BITS), -int(k), _BITS) for k in range(int(high[-1]) + 1)], np.uint64)
    raw = (_prefix_at(data, ends, table) - _prefix_at(data, starts, table)) * _INV[starts % BLOCK] * far[high]
    return mix(raw + (ends - starts).astype(np.uint64) * _ROLL)


def parts(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: first row, end row, bytes, and each text's start and end in them.

    A null text is empty. A single longer text is a run of its own.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(texts))
        low, high = offsets[row], offsets[end]
        yield row, end, data[low:high], offsets[row:end] - low, offsets[row + 1 : end + 1] - low
        row = end


def code_points_before(data: np.ndarray) -> np.ndarray:
    """How many code points start before each byte position, and in all."""
    out = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def runs(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true values that no text's start interrupts."""
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[starts] = True
    cut[n] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    first = inside & (~before | cut[:n])
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = inside & (~after | cut[1:])
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of the words: runs of bytes other than space and 0x09-0x0D."""
    return runs((data != 32) & ((data < 9) | (data > 13)), starts)


def owner(ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that holds each byte position."""
    return np.searchsorted(ends, at, "right")


def grams(hashes: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of n words that stay in one text, and the first word of each."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rolled = hashes[:count].copy()
    for k in range(1, n):
        rolled *= _ROLL
        rolled += hashes[k : k + count]
    at = np.flatnonzero(docs[:count] == docs[n - 1 :])
    return mix(rolled[at]), at


def in_text(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Keys that are equal only where the key and the text are."""
    return mix(keys + (docs.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
