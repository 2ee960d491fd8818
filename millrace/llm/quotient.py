"""Counting quotient filters: sorted, lossless and compact counters of fixed-width keys.

A key of `bits` bits is permuted invertibly, so that its first bits are spread evenly and the key
can be had back. They name the bucket, the next ones - the quotient - are stored as run lengths in
unary, and what remains is stored in full: no two keys are ever confused. Filters of one bucket are
merged as sorted runs, whichever shard they come from.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from millrace.llm.text import mix

_HEAD = struct.Struct("<QQB")
_U = np.uint64
#: Counters of one byte; larger counts follow in full.
_LARGE = 255

Run = tuple[np.ndarray, np.ndarray, np.ndarray]


def _mask(bits: int) -> np.uint64:
    return _U((1 << bits) - 1)


@dataclass(frozen=True)
class Keys:
    """`words` ids of `width` bits (at most 32), packed into an upper and a lower half."""

    words: int
    width: int

    @property
    def bits(self) -> int:
        return self.words * self.width

    @property
    def low(self) -> int:
        return self.bits // 2

    @property
    def high(self) -> int:
        return self.bits - self.low

    def pack(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Permuted halves of the keys of the given ids, first word first."""
        last = (ids[-2] << _U(self.width)) | ids[-1]
        up = 2 * self.width - self.low
        high = last >> _U(self.low)
        if self.words == 3:
            high = high | (ids[0] << _U(up))
        return self._permuted(high, last & _mask(self.low))

    def unpack(self, high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        high, low = self._restored(high, low)
        up = 2 * self.width - self.low
        last = ((high & _mask(up)) << _U(self.low)) | low
        ids = [last >> _U(self.width), last & _mask(self.width)]
        return [high >> _U(up), *ids] if self.words == 3 else ids

    def _rounds(self):
        return [(_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)), (_U(0x165667B19E3779F9), _U(0x27D4EB2F165667C5))]

    def _permuted(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for a, b in self._rounds():
            high = high ^ (mix(low + a) >> _U(64 - self.high))
            low = low ^ (mix(high + b) >> _U(64 - self.low))
        return high, low

    def _restored(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for a, b in reversed(self._rounds()):
            low = low ^ (mix(high + b) >> _U(64 - self.low))
            high = high ^ (mix(low + a) >> _U(64 - self.high))
        return high, low

    def summed(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray | None = None) -> Run:
        """Sorted distinct keys with their summed counts; without counts every key counts one."""
        if self.bits <= 64:
            key = (high << _U(self.low)) | low
            if counts is None:
                key = np.sort(key)
            else:
                at = np.argsort(key, kind="stable")
                key, counts = key[at], counts[at]
            high, low = key >> _U(self.low), key & _mask(self.low)
            new = key[1:] != key[:-1]
        else:
            at = np.lexsort((low, high))
            high, low = high[at], low[at]
            counts = None if counts is None else counts[at]
            new = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        first = np.flatnonzero(np.concatenate([[len(high) > 0], new])) if len(high) else np.zeros(0, dtype=np.int64)
        if counts is None:
            total = np.diff(np.append(first, len(high))).astype(np.uint64)
        else:
            total = np.add.reduceat(counts, first) if len(first) else counts[:0]
        return high[first], low[first], total

    def encode(self, run: Run, bucket_bits: int) -> bytes:
        """One bucket's filter; all keys share their first `bucket_bits` bits."""
        high, low, counts = run
        n = len(high)
        q = min(self.high - bucket_bits, max(n.bit_length() - 1, 0))
        rest = self.high - bucket_bits - q
        quotient = ((high >> _U(rest)) & _mask(q)).astype(np.int64)
        unary = np.zeros(n + (1 << q), dtype=bool)
        unary[quotient + np.arange(n)] = True
        large = counts >= _LARGE
        return b"".join(
            [
                _HEAD.pack(n, int(np.count_nonzero(large)), q),
                np.packbits(unary).tobytes(),
                _narrow(high & _mask(rest), rest),
                _narrow(low, self.low),
                np.where(large, _U(_LARGE), counts).astype(np.uint8).tobytes(),
                counts[large].astype("<u8").tobytes(),
            ]
        )

    def decode(self, data: bytes, bucket: int, bucket_bits: int) -> Run:
        n, n_large, q = _HEAD.unpack_from(data)
        rest = self.high - bucket_bits - q
        raw = np.frombuffer(data, dtype=np.uint8)
        at = _HEAD.size
        size = (n + (1 << q) + 7) // 8
        ones = np.flatnonzero(np.unpackbits(raw[at : at + size]))
        quotient = (ones - np.arange(n)).astype(np.uint64)
        at += size
        upper, at = _wide(raw, at, n, rest)
        low, at = _wide(raw, at, n, self.low)
        counts = raw[at : at + n].astype(np.uint64)
        at += n
        counts[counts == _LARGE] = np.frombuffer(data, dtype="<u8", count=n_large, offset=at)
        high = upper | (quotient << _U(rest)) | (_U(bucket) << _U(self.high - bucket_bits))
        return high, low, counts

    def split(self, run: Run, bucket_bits: int):
        """(bucket, its part of the run) in bucket order."""
        bucket = run[0] >> _U(self.high - bucket_bits)
        if not len(bucket):
            return
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for lo, hi in zip(first, [*first[1:], len(bucket)], strict=True):
            yield int(bucket[lo]), tuple(x[lo:hi] for x in run)


def _narrow(x: np.ndarray, bits: int) -> bytes:
    size = (bits + 7) // 8
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _wide(raw: np.ndarray, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    size = (bits + 7) // 8
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :size] = raw[at : at + n * size].reshape(n, size)
    return out.view("<u8").reshape(n), at + n * size


@dataclass
class Merger:
    """Sums sorted runs; at any time few runs are held, each at least twice as long as the next."""

    keys: Keys
    runs: list[Run] = field(default_factory=list)

    def add(self, run: Run) -> None:
        if len(run[0]):
            self.runs.append(run)
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            self._join()

    def _join(self) -> None:
        b, a = self.runs.pop(), self.runs.pop()
        self.runs.append(self.keys.summed(*(np.concatenate(x) for x in zip(a, b, strict=True))))

    def __len__(self) -> int:
        return sum(len(r[0]) for r in self.runs)

    def take(self) -> Run:
        """All counts as one run; the merger is empty afterwards."""
        while len(self.runs) > 1:
            self._join()
        empty = np.zeros(0, dtype=np.uint64)
        run = self.runs.pop() if self.runs else (empty, empty, empty)
        return run
