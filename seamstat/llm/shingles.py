"""Word shingles of whole texts as 64-bit hashes, computed for many texts at once.

Words are the maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return, after lower-casing A-Z. A shingle is a run of ``SIZE`` words; a text with fewer
words has its whole sequence as one, and a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SIZE = 5
BYTES_AT_ONCE = 1 << 20

_random = np.random.default_rng(5)
_BYTE = _random.integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _random.integers(0, 2**63, SIZE, np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing step of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


def word_hashes(data: bytes, between: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word; ``between`` marks the bytes between words, and the data must end with one."""
    codes = np.frombuffer(data, np.uint8)
    blank = between[codes]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTE[codes] * _powers(_BASE, len(codes)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(codes))[starts]
    return starts, mixed(hashes + (ends - starts).astype(np.uint64))


def _sets_of(block: list[bytes]) -> Iterator[np.ndarray]:
    starts, words = word_hashes(b"".join(text + b" " for text in block))
    text_ends = np.cumsum([len(text) + 1 for text in block])
    bounds = np.concatenate([[0], np.searchsorted(starts, text_ends)])
    inner = max(len(words) - SIZE + 1, 0)
    shingles = np.zeros(inner, np.uint64)
    for place in range(SIZE):
        shingles += words[place : place + inner] * _PLACE[place]
    shingles = mixed(shingles)
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        if last - first >= SIZE:
            yield np.unique(shingles[first : last - SIZE + 1])
        elif last > first:
            few = (words[first:last] * _PLACE[: last - first]).sum(dtype=np.uint64)
            yield mixed(np.array([few + np.uint64(last - first)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    block, size = [], 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if block and size + len(data) > BYTES_AT_ONCE:
            yield from _sets_of(block)
            block, size = [], 0
        block.append(data)
        size += len(data)
    if block:
        yield from _sets_of(block)
