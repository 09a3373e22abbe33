"""An n-gram trie of Elias-Fano levels that is queried where it lies in a file."""

from __future__ import annotations

import mmap
import struct
from dataclasses import dataclass, field

import numpy as np

#: Steps in which logarithms of shares are kept, and the least one; the greatest is 0.
STEP, FLOOR = 1 / 4096, -65_535 / 4096


def quantised(x: np.ndarray) -> np.ndarray:
    return np.clip(np.round((x - FLOOR) / STEP), 0, 65_535).astype("<u2")


def restored(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) * STEP + FLOOR


#: Of each byte: how many zeros and how many ones it has, and where they stand.
_COUNT = [np.array([sum(b >> k & 1 == bit for k in range(8)) for b in range(256)], dtype=np.uint8) for bit in (0, 1)]
_PLACE = [np.array([([k for k in range(8) if b >> k & 1 == bit] + [0] * 8)[:8] for b in range(256)]) for bit in (0, 1)]


@dataclass
class EliasFano:
    """A rising sequence of 64-bit numbers: the lower ``low_bits`` of each lie packed, the upper ones in unary."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    last: int = 0
    ranks: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 2, dtype=np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, _bits(values, low_bits), np.packbits(bits, bitorder="little"), int(values[-1]))

    def values(self) -> np.ndarray:
        """All of them, by one pass over the bits."""
        if not self.n:
            return np.zeros(0, np.uint64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(np.arange(self.n))

    def _select(self, bit: int, rank: np.ndarray) -> np.ndarray:
        """Places of ones or zeros among the upper bits, by their ranks: 8 bytes by what stands before them, then the byte,
        then the bit."""
        if bit not in self.ranks:  # how many stand before each 8 bytes: half as large as the upper bits, made once
            per_byte = np.zeros(-(-len(self.high) // 8) * 8, dtype=np.int64)
            per_byte[: len(self.high)] = _COUNT[bit][self.high]
            self.ranks[bit] = np.cumsum(per_byte.reshape(-1, 8).sum(1)).astype("<u4" if 8 * len(self.high) < 1 << 32 else "<u8")
        ends = self.ranks[bit]
        block = np.searchsorted(ends, rank.astype(ends.dtype), side="right")
        left = rank - np.where(block > 0, ends[np.maximum(block - 1, 0)], 0).astype(np.int64)
        at = np.minimum(block[:, None] * 8 + np.arange(8), len(self.high) - 1)
        through = np.cumsum(_COUNT[bit][self.high[at]], axis=1, dtype=np.uint8)
        byte = (through <= left[:, None]).sum(1)
        row = np.arange(len(rank))
        left -= np.where(byte > 0, through[row, np.maximum(byte - 1, 0)], 0)
        return (block * 8 + byte) * 8 + _PLACE[bit][self.high[block * 8 + byte], left]

    def _before(self, upper: np.ndarray) -> np.ndarray:
        """How many numbers have upper bits less than these: the ones before the zero that ends what stands before."""
        out, inside = np.zeros(len(upper), dtype=np.int64), np.flatnonzero(upper > 0)
        out[inside] = self._select(0, upper[inside] - 1) - (upper[inside] - 1)
        return out

    def _low(self, at: np.ndarray) -> np.ndarray:
        """The lower bits of the numbers at some places, from the 8 bytes that they begin in (or twice, if they are many)."""
        out, begin, done = np.zeros(len(at), dtype=np.uint64), at.astype(np.int64) * self.low_bits, 0
        eights = np.ndarray((len(self.low) - 7,), dtype="<u8", buffer=self.low, strides=(1,)) if self.low_bits else None
        while done < self.low_bits:
            some, bit = min(32, self.low_bits - done), begin + done
            out |= (eights[bit >> 3] >> (bit & 7).astype(np.uint64) & np.uint64((1 << some) - 1)) << np.uint64(done)
            done += some
        return out

    def find(self, wanted: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """Where each of the wanted numbers stands, or -1; read from the packed bits.  The upper bits tell the few that may
        be it; among these the successor is sought by halves.  ``low`` and ``high``: to look from and up to which place."""
        out = np.full(len(wanted), -1)
        if not self.n:
            return out
        wanted = np.asarray(wanted, dtype=np.uint64)
        upper, lower = (wanted >> np.uint64(self.low_bits)).astype(np.int64), wanted & np.uint64((1 << self.low_bits) - 1)
        on = np.flatnonzero((wanted <= np.uint64(self.last)))
        a, b = self._before(upper[on]), self._before(upper[on] + 1)
        if low is not None:
            a, b = np.maximum(a, low[on]), np.minimum(b, high[on])
        end, left = b.copy(), np.flatnonzero(a < b)
        while len(left):
            middle = (a[left] + b[left]) // 2
            less = self._low(middle) < lower[on[left]]
            a[left[less]] = middle[less] + 1
            b[left[~less]] = middle[~less]
            left = left[a[left] < b[left]]
        at = np.flatnonzero(a < end)
        hit = at[self._low(a[at]) == lower[on[at]]]
        out[on[hit]] = a[hit]
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        """The numbers at some places."""
        at = np.asarray(at, dtype=np.int64)
        return ((self._select(1, at) - at).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(at)

    def parts(self) -> list[bytes]:
        return [struct.pack("<QQQ", self.n, self.low_bits, self.last), self.low.tobytes(), self.high.tobytes()]


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """The lower ``width`` bits of each number, one after the other, and 8 bytes more."""
    some = 1 << 16  # so many at a time; a multiple of 8 ends with a byte
    parts = [np.packbits((values[k : k + some, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for k in range(0, len(values), some)]
    return np.concatenate([*parts, np.zeros(8, np.uint8)])


class Trie:
    """Two levels over words: each word with its count and its value as a context, and under it the contexts that it
    followed, with the smoothed value of the pair.

    The second level is one rising sequence: a word's contexts rise from its pointer on, each shifted by what the words
    before it take, so that a level's numbers are relative to where their word begins.  A pair is sought between its
    word's pointer and the next one's only.  An opened trie answers from the packed bits of the mapped file.
    """

    def __init__(self, words: EliasFano, counts: np.ndarray, pointers: EliasFano, level: EliasFano, contexts: EliasFano, as_context: np.ndarray, value: np.ndarray):
        self.words, self.counts, self.pointers, self.level, self.contexts, self.as_context, self.value = words, counts, pointers, level, contexts, as_context, value

    @classmethod
    def build(cls, word: np.ndarray, context: np.ndarray, count: np.ndarray, word_count, pair_value, context_value) -> Trie:
        """From distinct pairs sorted by word and context.  ``word_count(words, sums)`` gives the words' whole counts;
        ``pair_value(pair counts, their words' counts)`` and ``context_value(counts)`` are logarithms to keep, of shares:
        at most 0, however large the counts are."""
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
        words = word[first]
        sums = np.add.reduceat(count, first) if len(first) else np.zeros(0, np.int64)
        counts = word_count(words, sums)
        contexts = np.unique(context)
        place = np.searchsorted(contexts, context).astype(np.uint64)
        under = np.repeat(np.arange(len(words)), np.diff(np.r_[first, len(word)]))
        level = place + under.astype(np.uint64) * np.uint64(max(1, len(contexts)))
        rising = [EliasFano.of(x) for x in (words, np.r_[first, len(word)], level, contexts)]
        return cls(rising[0], counts, *rising[1:], quantised(context_value(counts)), quantised(pair_value(count, counts[under])))

    def tobytes(self) -> bytes:
        """The file: for each level a length and its bytes."""
        parts = [x for rising in (self.words, self.pointers, self.level, self.contexts) for x in rising.parts()]
        parts += [self.counts.astype("<i8").tobytes(), self.as_context.tobytes(), self.value.tobytes()]
        return b"".join(struct.pack("<Q", len(x)) + x for x in parts)

    @classmethod
    def open(cls, path: str) -> Trie:
        """Maps a file.  Nothing is decoded: all arrays are views of the map."""
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        parts, at = [], 0
        while at < len(data):
            (size,) = struct.unpack_from("<Q", data, at)
            parts.append(np.frombuffer(data, dtype=np.uint8, count=size, offset=at + 8))
            at += 8 + size
        rising = []
        for k in range(0, 12, 3):
            n, low_bits, last = struct.unpack("<QQQ", parts[k].tobytes())
            rising.append(EliasFano(n, low_bits, parts[k + 1], parts[k + 2], last))
        words, pointers, level, contexts = rising
        return cls(words, parts[12].view("<i8"), pointers, level, contexts, parts[13].view("<u2"), parts[14].view("<u2"))

    def find(self, word: np.ndarray) -> np.ndarray:
        """Places of words; -1 where a word is not there."""
        return self.words.find(word)

    def pairs(self, at: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Places in the second level of the pairs (word at a place, context); -1 where there is none."""
        out = np.full(len(at), -1)
        once, back = np.unique(context, return_inverse=True)
        place = self.contexts.find(once)[back]
        known = np.flatnonzero((at >= 0) & (place >= 0))
        if len(known):
            words, under = np.unique(at[known], return_inverse=True)
            low, high = self.pointers.get(words)[under].astype(np.int64), self.pointers.get(words + 1)[under].astype(np.int64)
            wanted = place[known].astype(np.uint64) + at[known].astype(np.uint64) * np.uint64(self.contexts.n)
            out[known] = self.level.find(wanted, low, high)
        return out
