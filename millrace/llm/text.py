"""Word and shingle hashes of whole texts, vectorised over the bytes of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (multiply and shift)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 64)
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, _INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up), np.cumprod(down)
    return _powers["up"][:n], _powers["down"][:n]


def byte_codes(fold_case: bool) -> np.ndarray:
    """A random 64-bit code for each byte; with fold_case A-Z share the codes of a-z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


def prefix_hashes(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes: n + 1 values."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(codes[data] * up[: len(data)], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] that do not depend on where the range lies."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def separator_table(kept: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(kept, dtype=np.uint8)] = False
    return table


#: Words of the near-duplicate contract: everything but space, tab and the line breaks.
NOT_SPACE = separator_table(bytes(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D))
#: Words of the decontamination contract: digits, letters and everything beyond ASCII.
ALNUM = separator_table(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of runs of rows of about `limit` bytes.

    Rows are never cut; a row above the limit is a run of its own. A null row is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    n = len(column)
    if n == 0:
        return
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word starts, word ends, and each row's first word (rows + 1 values)."""
    gap = np.ones(len(data) + 1, dtype=bool)
    gap[:-1] = separators[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.ones(len(data) + 1, dtype=bool)
    before[1:] = gap[:-1]
    inside = ~gap[:-1]
    starts = np.flatnonzero(inside & (before[:-1] | edge[:-1]))
    ends = np.flatnonzero(inside & (gap[1:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, ...]:
    """Case-folded word hashes, word starts, word ends and each row's first word."""
    starts, ends, first = word_bounds(data, offsets, separators)
    prefix = prefix_hashes(data, byte_codes(True))
    return range_hashes(prefix, starts, ends), starts, ends, first


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of words[i:i+width] for every i; fewer words than width give none."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * _BASE + words[k : k + n]
    return mix(out + np.uint64(width))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter sequence is one shingle, none is empty."""
    if len(words) == 0:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(shingle_hashes(words, min(width, len(words))))


def shared_count(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 0:
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Indexes of the pairs that form a spanning forest of nodes 0..n-1."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return np.array(kept, dtype=np.int64)
