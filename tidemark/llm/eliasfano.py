"""Elias-Fano sequences over numpy arrays that can be mapped from a file, and the file's layout."""

from __future__ import annotations

import json

import numpy as np

U = np.uint64


#: The place of set bit number k of a byte, at 8 * byte + k.
_IN_BYTE = np.array([([p for p in range(8) if byte >> p & 1] + [0] * 8)[k] for byte in range(256) for k in range(8)], np.uint64)
_ONES, _TOPS = U(0x0101010101010101), U(0x8080808080808080)


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the set bit number k (from 0) in each 64-bit word: bytes' counts are added up side by side, and a table has the rest."""
    sums = words - (words >> U(1) & U(0x5555555555555555))
    sums = (sums & U(0x3333333333333333)) + (sums >> U(2) & U(0x3333333333333333))
    sums = (sums + (sums >> U(4)) & U(0x0F0F0F0F0F0F0F0F)) * _ONES  # in each byte the ones up to its end
    place = (((k * _ONES | _TOPS) - sums & _TOPS) >> U(7)) * _ONES >> U(56) << U(3)
    rest = k - (sums << U(8) >> place & U(255))
    return place + _IN_BYTE[(words >> place & U(255)) << U(3) | rest]


#: Values whose low bits are laid out at once, a byte each; a multiple of 8, so that pieces end with a byte.
PIECE = 1 << 15


def _low_bits(values: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits(np.stack([(values >> U(k) & U(1)).astype(np.uint8) for k in range(bits)], axis=1).ravel(), bitorder="little")


class EliasFano:
    """A non-decreasing sequence of integers below 2^64: low bits as they are, high bits in unary, and ones counted up to each word."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, U(bits), low, high, ones
        self.zeros = 64 * np.arange(len(ones), dtype=np.int64) - ones.astype(np.int64)
        self.mask = U((1 << bits) - 1)
        self.most = n and int((self._place(np.array([n - 1]))[0]) - (n - 1))

    @staticmethod
    def arrays(values: np.ndarray) -> dict[str, np.ndarray]:
        """The arrays of a sequence, as numbers and little-endian words."""
        values = np.asarray(values).astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = np.concatenate([np.zeros(0, np.uint8), *(_low_bits(values[k : k + PIECE], bits) for k in range(0, n if bits else 0, PIECE))])
        places = (values >> U(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((n + (top >> bits) + 1 + 63) // 64 * 64, np.uint8)
        unary[places] = 1
        unary[n + (top >> bits) + 1 :] = 1  # so that only real zeros are counted
        high = np.packbits(unary, bitorder="little").view(np.uint64)
        ones = np.concatenate([np.zeros(1, np.int64), np.bitwise_count(high).astype(np.int64).cumsum()]).astype(np.uint32 if len(unary) < 1 << 32 else np.uint64)
        return {"": np.array([n, bits], np.int64), "low": np.concatenate([low, np.zeros(-len(low) % 8 + 8, np.uint8)]).view(np.uint64), "high": high, "ones": ones}

    def _place(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i.astype(self.ones.dtype), "right") - 1
        return word * 64 + _select(self.high[word], (i - self.ones[word].astype(np.int64)).astype(np.uint64)).astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * self.bits
        word, off = (at >> U(6)).astype(np.int64), at & U(63)
        return (self.low[word] >> off | self.low[word + 1] << U(1) << (U(63) - off)) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at these places."""
        return (self._place(i) - i).astype(np.uint64) << self.bits | self._low(i)

    def _upto(self, high: np.ndarray) -> np.ndarray:
        """How many values have high bits of less than this."""
        k = np.maximum(high - 1, 0)
        word = np.searchsorted(self.zeros, k, "right") - 1
        place = word * 64 + _select(~self.high[word], (k - self.zeros[word]).astype(np.uint64)).astype(np.int64)
        return np.where(high > 0, place + 1 - high, 0)

    def _bucket(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the first value that isn't less among those that share x's high bits, end of those, x's low bits).

        The unary part leads to these few values; among them the low bits decide.
        """
        high = (x >> self.bits).astype(np.int64)
        beyond = high > self.most
        high = np.minimum(high, self.most)
        both = self._upto(np.concatenate([high, high + 1]))
        left, right = both[: len(x)], both[len(x) :]
        left[beyond] = right[beyond] = self.n
        want, ends = x & self.mask, right.copy()
        live = np.flatnonzero(left < right)
        while len(live):
            a, b = left[live], right[live]
            middle = (a + b) >> 1
            less = self._low(middle) < want[live]
            a, b = np.where(less, middle + 1, a), np.where(less, b, middle)
            left[live], right[live] = a, b
            live = live[a < b]
        return left, ends, want

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value that isn't less than x, n if there is none."""
        return self._bucket(x.astype(np.uint64))[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """The first place of each value, -1 where it doesn't stand in the sequence."""
        if not self.n:
            return np.full(len(x), -1, np.int64)
        at, ends, want = self._bucket(x.astype(np.uint64))
        return np.where((at < ends) & (self._low(np.minimum(at, self.n - 1)) == want), at, -1)


class Lists:
    """Sorted lists on end: monotone pointers to each, and their values, chained so that all are one rising sequence."""

    def __init__(self, pointers: EliasFano, values: EliasFano):
        self.pointers, self.values = pointers, values

    @staticmethod
    def arrays(sizes: np.ndarray, values: np.ndarray) -> dict[str, dict[str, np.ndarray]]:
        """values strictly rise within each list; no list is empty."""
        ends = np.cumsum(sizes)
        tops = values[ends - 1] + 1 if len(ends) else np.zeros(0, np.int64)
        base = np.concatenate([[0], np.cumsum(tops)])[:-1] if len(ends) else np.zeros(0, np.int64)
        return {"pointers": EliasFano.arrays(np.concatenate([[0], ends])), "values": EliasFano.arrays(np.repeat(base, sizes) + values)}

    def find(self, which: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among all values or -1, place in its list) of a value in each of the named lists."""
        both = self.pointers.get(np.concatenate([which, which + 1])).astype(np.int64)
        start, end = both[: len(which)], both[len(which) :]
        base = np.where(start > 0, self.values.get(np.maximum(start - 1, 0)).astype(np.int64) + 1, 0)
        at = self.values.find(base + value)
        return np.where((at >= start) & (at < end), at, -1), at - start


def flat(tree: dict, prefix: str = "") -> dict[str, np.ndarray]:
    out: dict[str, np.ndarray] = {}
    for k, v in tree.items():
        out |= flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def packed(tree: dict) -> bytes:
    """The arrays of a tree as one file: the length of the index, the index, and arrays at multiples of 64 bytes."""
    arrays, index, at = flat(tree), {}, 0
    for name, a in arrays.items():
        index[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(index).encode()
    head = len(head).to_bytes(8, "little") + head
    return b"".join([head, bytes(-len(head) % 64), *(x for a in arrays.values() for x in (a.tobytes(), bytes(-a.nbytes % 64)))])


class Mapped:
    """The arrays of such a file, mapped into memory: what isn't looked at isn't read."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        size = int.from_bytes(raw[:8].tobytes(), "little")
        start = -(-(size + 8) // 64) * 64
        self.found = {k: np.asarray(raw[start + at : start + at + n * np.dtype(kind).itemsize]).view(kind) for k, (kind, n, at) in json.loads(raw[8 : 8 + size].tobytes()).items()}

    def __getitem__(self, name: str) -> np.ndarray:
        return self.found[name]

    def sequence(self, name: str) -> EliasFano:
        n, bits = self.found[f"{name}."].tolist()
        return EliasFano(n, bits, *(self.found[f"{name}.{k}"] for k in ("low", "high", "ones")))

    def lists(self, name: str) -> Lists:
        return Lists(self.sequence(f"{name}.pointers"), self.sequence(f"{name}.values"))
