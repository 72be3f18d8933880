"""Words of a column of texts and fingerprints of their n-grams, by prefix polynomials over bytes and words."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .tokens import mixed

#: Odd bases of the polynomials over bytes and over words, modulo 2^64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
#: Others, for second hashes.
BYTE_BASE_2, WORD_BASE_2 = 0xA24BAED4963EE407, 0x9FB21C651E98DF25
#: Bytes of text that are worked on at once.
BLOCK = 1 << 19
#: Words that a block takes over from the one before, so that n-grams across the cut are whole.
CARRY = 3


class Block(NamedTuple):
    """Words in order; the first `carried` stood in the block before. text is lower-cased, starts and ends point into it.

    pieces tells which words may stand in one n-gram. Rows first to last - 1 end in this block. checks are second hashes, where asked for.
    """

    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    pieces: np.ndarray
    hashes: np.ndarray
    carried: int
    first: int
    last: int
    checks: np.ndarray = np.zeros(0, np.uint64)

    def word(self, k: int) -> bytes:
        return self.text[self.starts[k] : self.ends[k]].tobytes()


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of base and of its inverse modulo 2^64, size or more."""
    if base not in _powers or len(_powers[base][0]) < size:
        size = -(-size // 65536) * 65536
        grown = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]), dtype=np.uint64)
        _powers[base] = grown(base), grown(pow(base, -1, 1 << 64))
    return _powers[base]


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return lower, mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(WORD_BASE))


U_CHECK = np.uint64(0x5851F42D4C957F2D)


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The hash of each stretch of values: a difference of two prefix sums of the polynomial, moved to the power 0."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def mask(chars: bytes) -> np.ndarray:
    """A table of 256 flags, set at these bytes."""
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def blocks(column: pa.Array, blanks: np.ndarray, breaks: np.ndarray | None = None, block: int = BLOCK, checked: bool = False) -> Iterator[Block]:
    """The words of a column of texts, block by block. blanks part words; breaks also part pieces.

    A long text is cut between words, so memory follows the block's size and the longest word. Every row ends in one block.
    """
    data, offsets = buffers(column)
    apart = blanks if breaks is None else blanks | breaks
    lower, values = _tables()
    at, end, row, piece = int(offsets[0]), int(offsets[-1]), 0, 0
    held = [np.zeros(0, np.uint8), *(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))]
    while True:
        cut = min(at + block, end)
        while cut < end and not apart[data[cut - 1]]:
            here = np.flatnonzero(apart[data[cut : cut + 4096]])
            past = np.searchsorted(offsets, cut, "left")
            ends = int(offsets[past]) if past < len(offsets) else end
            cut = min(ends, cut + int(here[0]) + 1 if len(here) else min(cut + 4096, end))
            if cut == ends:
                break
        text = lower[data[at:cut]]
        last = int(np.searchsorted(offsets[1:], cut, "right")) if cut < end else len(offsets) - 1
        fresh = offsets[np.searchsorted(offsets, at, "left") : np.searchsorted(offsets, cut, "left")] - at
        inside = ~apart[text]
        before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
        before[fresh], after[fresh[fresh > 0] - 1] = False, False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        rows = np.searchsorted(offsets, starts + at, "right") - 1
        parted = np.searchsorted(np.flatnonzero(breaks[text]), starts) if breaks is not None else np.zeros(len(starts), np.int64)
        pieces = piece + parted + rows
        hashes = _spans(values[text], starts, ends, BYTE_BASE)
        checks = _spans(values[text] ^ U_CHECK, starts, ends, BYTE_BASE_2) if checked else np.zeros(0, np.uint64)
        piece += int(breaks[text].sum()) if breaks is not None else 0
        carried, shift = len(held[1]), len(held[0])
        made = Block(
            np.concatenate([held[0], text]), np.concatenate([held[1], starts + shift]), np.concatenate([held[2], ends + shift]), np.concatenate([held[3], rows]),
            np.concatenate([held[4], pieces]), np.concatenate([held[5], hashes]), carried, row, last, np.concatenate([held[6], checks]),
        )
        yield made
        if cut >= end:
            return
        k = max(0, len(made.starts) - CARRY)
        keep = [made.text[s:e] for s, e in zip(made.starts[k:], made.ends[k:], strict=True)]
        sizes = np.array([0, *(len(x) for x in keep)], np.int64).cumsum()
        held = [np.concatenate([np.zeros(0, np.uint8), *keep]), sizes[:-1], sizes[1:], made.rows[k:], made.pieces[k:], made.hashes[k:], made.checks[k:]]
        at, row = cut, last


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether a and b have the same bytes at these places, each so many."""
    same = np.ones(len(sizes), bool)
    order = np.argsort(sizes, kind="stable")
    lengths, firsts = np.unique(sizes[order], return_index=True)
    for n, part in zip(lengths.tolist(), np.split(order, firsts[1:]), strict=False):  # without words there is no length
        for some in np.array_split(part, max(1, len(part) * n >> 24)) if n else ():
            if n < 4096:
                step = np.arange(n)
                same[some] = (a[a_starts[some, None] + step] == b[b_starts[some, None] + step]).all(axis=1)
            else:
                same[some] = [np.array_equal(a[x : x + n], b[y : y + n]) for x, y in zip(a_starts[some], b_starts[some], strict=True)]
    return same


def identify(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(an occurrence of each different word, the number of each occurrence's word), told by the bytes.

    Occurrences are gathered by their hash and compared with the first byte by byte; those of another word with the same hash get numbers of their own.
    """
    _, firsts, numbers = np.unique(block.hashes, return_index=True, return_inverse=True)
    sizes, rep = block.ends - block.starts, firsts[numbers]
    other = (sizes != sizes[rep]) | ~same_bytes(block.text, block.starts, block.text, block.starts[rep], np.minimum(sizes, sizes[rep]))
    if other.any():
        more: dict[bytes, int] = {}
        for k in np.flatnonzero(other).tolist():
            if (number := more.setdefault(block.word(k), len(firsts))) == len(firsts):
                firsts = np.append(firsts, k)
            numbers[k] = number
    return firsts, numbers


def fingerprints(hashes: np.ndarray, n: int, base: int = WORD_BASE) -> np.ndarray:
    """For each position the fingerprint of the n words from there, as far as they fit: a difference of two prefix sums."""
    starts = np.arange(max(0, len(hashes) - n + 1))
    return mixed(_spans(hashes, starts, starts + n, base) + np.uint64(n))
