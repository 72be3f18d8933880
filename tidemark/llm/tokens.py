"""Words of a batch of texts as one array of hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words(text: str | None) -> list[bytes]:
    """Blank-separated words with A-Z in lower case."""
    return (text or "").encode().lower().split()


def hash_words(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))


def hashed(texts: Iterable[str | None], strip: bool = False, most: int = 400_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about most words: the number of the first text, the word hashes of all on end, and where each starts.

    The starts have the end as last. With strip, punctuation at both ends of a word doesn't
    count, unless there is nothing else. So arrays stay small however large a batch is; one long text is a run of its own.
    """
    first, row, parts, starts = 0, 0, [], [0]
    for row, text in enumerate(texts, 1):
        found = words(text)
        if strip:
            found = [w.strip(PUNCTUATION) or w for w in found]
        parts.append(hash_words(found))
        starts.append(starts[-1] + len(found))
        if starts[-1] >= most:
            yield first, np.concatenate(parts), np.array(starts, dtype=np.int64)
            first, parts, starts = row, [], [0]
    if parts:
        yield first, np.concatenate(parts), np.array(starts, dtype=np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def combined(h: np.ndarray, offsets: tuple[int, ...], salt: int) -> np.ndarray:
    """For each position the hash of the words at these offsets from it, as far as the last fits."""
    n = max(0, len(h) - offsets[-1])
    out = np.full(n, salt, dtype=np.uint64)
    for k in offsets:
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return mixed(out)
