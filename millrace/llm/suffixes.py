"""Removal of byte strings that an earlier document already has, by hash-compared suffixes.

A document's 50-byte windows are grouped in runs that share the least hash of the k-grams inside
(their anchor). Equal windows have equal anchors, so all occurrences of a window meet in the
anchor's bucket. Documents are packed in parts, and parts talk to buckets twice:

1. which of my anchors occur in more than one document?
2. for the runs of those anchors: what is the least document that has each window?

Messages are one row for a part and a bucket with packed arrays, pre-aggregated in the part, so a
string that every document has costs one entry for each part. In a bucket, suffixes are put in
order by mergesort, whose comparisons find the common extension of two suffixes by binary search
on prefix polynomial hashes; equal neighbours collapse after their bytes are compared. First the
runs are sorted, then the windows of the distinct runs, cut to 50 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import text as tx
from millrace.llm.runs import gathered, key_runs
from millrace.session import materialized

LENGTH = 50
GRAM = 20
PART_BYTES = 1 << 20
#: Bytes of documents for each bucket, and the least number of buckets.
BUCKET_BYTES = 2 << 20
MIN_BUCKETS = 256
#: Bytes of a bucket's strings that are sorted at once.
SORTED_BYTES = 4 << 20
#: Longer runs (periodic texts) are cut; windows are compared one by one, so any cut is right.
RUN_WINDOWS = 64
NO_DOC = np.iinfo(np.int64).min


def expand(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start[i] + 0..count[i]-1 for all i in order, and the i of each."""
    owner = np.repeat(np.arange(len(count)), count)
    return np.arange(count.sum()) - (np.cumsum(count) - count)[owner] + start[owner], owner


def window_runs(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first window, windows, anchor hash, row."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64), none
    _, down = tx.powers(len(prefix))
    least = tx.mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: len(prefix) - GRAM])
    width, target = 1, LENGTH - GRAM + 1
    while 2 * width <= target:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if target > width:
        least = np.minimum(least[: -(target - width)], least[target - width :])
    room = np.zeros(n + 1, dtype=bool)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    room[:n] = np.arange(n) + LENGTH <= offsets[row + 1]
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (room[1:n] != room[: n - 1])
    edges = np.flatnonzero(edge)
    start, count = edges[:-1], np.diff(edges)
    start, count = start[room[start]], count[room[start]]
    pieces = -(-count // RUN_WINDOWS)
    at, owner = expand(np.zeros(len(count), dtype=np.int64), pieces)
    start = start[owner] + at * RUN_WINDOWS
    count = np.minimum(count[owner] - at * RUN_WINDOWS, RUN_WINDOWS)
    return start, count, least[start], row[start]


def string_prefixes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, where a byte's power counts from its own string. Ranges
    inside strings can be compared, and no table of powers grows with the data."""
    codes = tx.byte_codes(False)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    step = 1 << 14
    for k in range(0, len(offsets) - 1, step):
        cut = offsets[k : k + step + 1]
        local, _ = expand(np.zeros(len(cut) - 1, dtype=np.int64), np.diff(cut))
        up, _ = tx.powers(int(np.diff(cut).max(initial=0)) + 1)
        out[cut[0] + 1 : cut[-1] + 1] = codes[data[cut[0] : cut[-1]]] * up[local]
    return np.cumsum(out, out=out)


def common_extension(
    prefix: np.ndarray, a: np.ndarray, b: np.ndarray, da: np.ndarray, db: np.ndarray, limit: np.ndarray
) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and at b, at most `limit`; da and db are the
    inverse powers of their places."""
    low, high = np.zeros(len(a), dtype=np.int64), limit.copy()
    pa_, pb = prefix[a], prefix[b]
    for _ in range(int(limit.max(initial=0)).bit_length()):
        middle = (low + high + 1) >> 1
        same = (prefix[a + middle] - pa_) * da == (prefix[b + middle] - pb) * db
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def leading_bytes(data: np.ndarray) -> np.ndarray:
    """Eight bytes from every position as a number that orders like the bytes (a view)."""
    return np.ndarray((len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))


def suffix_order(
    data: np.ndarray, prefix: np.ndarray, start: np.ndarray, length: np.ndarray, down: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings data[start:start+length] of at least 8 bytes, and for each place in it
    whether the string equals the one before.

    Leading bytes sort the suffixes into short runs of ties. Each run is sorted by a bottom-up
    mergesort, all runs of a level at once: an element finds its place in the sibling by binary
    search, and a comparison is a logarithmic number of hash probes. Equality is verified on bytes.
    `down` are the inverse powers of the starts, by default those of hashes over the whole data.
    """
    if down is None:
        down = tx.powers(len(prefix))[1][start]
    n = len(start)
    lead = leading_bytes(data)[start].astype(np.uint64)
    order = np.argsort(lead, kind="stable")
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = lead[order][1:] != lead[order][:-1]
    tie = np.cumsum(fresh) - 1
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], n)
    last = len(data) - 1

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        lx, ly = length[x], length[y]
        shared = common_extension(prefix, start[x], start[y], down[x], down[y], np.minimum(lx, ly))
        bx = np.where(shared == lx, -1, data[np.minimum(start[x] + shared, last)].astype(np.int64))
        by = np.where(shared == ly, -1, data[np.minimum(start[y] + shared, last)].astype(np.int64))
        return (bx < by) | ((bx == by) & ties)

    width = 1
    while width < n:
        cut = np.arange(width, n, 2 * width)
        cut = cut[tie[cut] == tie[cut - 1]]
        low, high = np.maximum(begin[tie[cut]], cut - width), np.minimum(end[tie[cut]], cut + width)
        place, owner = expand(low, high - low)
        if len(place):
            left = place < cut[owner]
            lo = np.where(left, cut[owner], low[owner])
            hi = np.where(left, high[owner], cut[owner])
            base = lo.copy()
            own = order[place]
            active = np.arange(len(place))
            while len(active):
                middle = (lo[active] + hi[active]) >> 1
                # An element of the right side comes after equal ones of the left side.
                less = before(order[middle], own[active], ~left[active])
                lo[active] = np.where(less, middle + 1, lo[active])
                hi[active] = np.where(less, hi[active], middle)
                active = active[lo[active] < hi[active]]
            offset = np.where(left, place, place - cut[owner] + low[owner])
            order[offset + lo - base] = own
        width *= 2
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(~fresh[1:] & (length[a] == length[b]))
    a, b = a[near], b[near]
    same = common_extension(prefix, start[a], start[b], down[a], down[b], length[a]) == length[a]
    near, a, b = near[same], a[same], b[same]
    equal = np.zeros(n, dtype=bool)
    equal[near[same_bytes(data, start[a], start[b], length[a])] + 1] = True
    return order, equal


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether data[a:a+length] equals data[b:b+length], eight bytes at a time."""
    eights = leading_bytes(data)
    same = np.ones(len(a), dtype=bool)
    for at in range(0, int(length.max(initial=8)), 8):
        step = np.minimum(at, length - 8)
        same &= eights[a + step] == eights[b + step]
    return same


def least_docs(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For strings of one bucket: group of each string, first window of each group, and the least
    document of every window of the groups' strings."""
    length = np.diff(offsets)
    lead = leading_bytes(data)
    # Equal strings and equal windows have equal leading bytes, so both are sorted in parts of bounded
    # size, each on a copy of its own bytes; nothing but the answer grows with a hot bucket.
    parts = max(1, -(-len(data) // SORTED_BYTES))
    part = lead_class(lead, offsets[:-1], parts)
    group = np.empty(len(length), dtype=np.int64)
    first_doc, begin, windows, n = [], [], [], 0
    for k in range(parts):
        own = np.flatnonzero(part == k)
        if len(own):
            order, equal = sorted_strings(data, offsets[own], length[own])
            group[own[order]] = n + np.cumsum(~equal) - 1
            heads = np.flatnonzero(~equal)
            first_doc.append(np.minimum.reduceat(docs[own[order]], heads))
            begin.append(offsets[own[order[heads]]])
            windows.append(length[own[order[heads]]] - LENGTH + 1)
            n += len(heads)
    first_doc, begin, windows = (np.concatenate(x) for x in (first_doc, begin, windows))
    first = np.cumsum(windows) - windows
    out = np.repeat(first_doc, windows)
    # A window whose hash no other window has equals none; the others are sorted.
    twins = with_twins(window_hashes(data, begin, windows))
    owner = np.searchsorted(first, twins, side="right") - 1
    at = begin[owner] + twins - first[owner]
    parts = max(1, -(-len(twins) * LENGTH // SORTED_BYTES))
    part = lead_class(lead, at, parts)
    for k in range(parts):
        own = np.flatnonzero(part == k)
        if len(own):
            order, equal = sorted_strings(data, at[own], np.full(len(own), LENGTH))
            least = np.minimum.reduceat(first_doc[owner[own[order]]], np.flatnonzero(~equal))
            out[twins[own[order]]] = least[np.cumsum(~equal) - 1]
    return group, first, out


def window_hashes(data: np.ndarray, begin: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Hash of every window of the strings at `begin`, from prefix hashes of each string."""
    out, done = np.empty(int(windows.sum()), dtype=np.uint64), 0
    _, down = tx.powers(int(windows.max(initial=0)) + 1)
    for k in range(0, len(begin), 1 << 14):
        count = windows[k : k + (1 << 14)]
        at, _ = expand(begin[k : k + (1 << 14)], count + LENGTH - 1)
        offsets = np.concatenate([[0], np.cumsum(count + LENGTH - 1)])
        prefix = string_prefixes(data[at], offsets)
        start, _ = expand(offsets[:-1], count)
        local, _ = expand(np.zeros(len(count), dtype=np.int64), count)
        out[done : done + len(start)] = (prefix[start + LENGTH] - prefix[start]) * down[local]
        done += len(start)
    return out


def with_twins(hashes: np.ndarray) -> np.ndarray:
    """Places of the values that occur more than once, ascending."""
    ranked = np.sort(hashes)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(twice):
        return np.zeros(0, dtype=np.int64)
    at = np.searchsorted(twice, hashes)
    at[at == len(twice)] = 0
    return np.flatnonzero(twice[at] == hashes)


def lead_class(lead: np.ndarray, at: np.ndarray, parts: int) -> np.ndarray:
    return (lead[at].astype(np.uint64) * tx._BASE >> np.uint64(32)) % np.uint64(parts)


def sorted_strings(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings in an order in which equal ones are neighbours, and whether each equals the one before:
    suffix_order on a copy of the bytes of those that may equal another."""
    at, _ = expand(start, length)
    own = data[at]
    del at
    offsets = np.concatenate([[0], np.cumsum(length)])
    prefix = string_prefixes(own, offsets)
    # A string whose hash no other has equals none: it goes to the end, unsorted.
    twins = with_twins(prefix[offsets[1:]] - prefix[offsets[:-1]])
    order, equal = suffix_order(own, prefix, offsets[twins], length[twins], np.ones(len(twins), dtype=np.uint64))
    single = np.ones(len(length), dtype=bool)
    single[twins] = False
    single = np.flatnonzero(single)
    return np.concatenate([twins[order], single]), np.concatenate([equal, np.zeros(len(single), dtype=bool)])


# Parts: documents packed for repeated reading


def _pack(keep: list[str]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for lo, hi, data, offsets in tx.chunks(batch.column(1), PART_BYTES):
                own = batch.slice(lo, hi - lo)
                sink = pa.BufferOutputStream()
                rest = own.select(keep)
                with pa.ipc.new_stream(sink, rest.schema) as stream:
                    stream.write_batch(rest)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part], pa.int64()),
                        pa.array([own.column(0).to_pylist()], pa.list_(pa.int64())),
                        pa.array([np.diff(offsets)], pa.list_(pa.int64())),
                        pa.array([packer.compress(data.tobytes())], pa.binary()),
                        pa.array([packer.compress(sink.getvalue().to_pybytes()) if keep else None], pa.binary()),
                    ],
                    ["part", "docs", "lengths", "bytes", "rest"],
                )
                part += 1

    return pack


class Part:
    """A packed part, its runs, and the order in which it writes to the buckets."""

    def __init__(self, row: dict, shift: int):
        self.part = row["part"]
        self.names = row["docs"]
        self.docs = np.array([NO_DOC if d is None else d for d in row["docs"]], dtype=np.int64)
        self.data = np.frombuffer(zstandard.decompress(row["bytes"]), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(np.array(row["lengths"], dtype=np.int64))])
        self.prefix = tx.prefix_hashes(self.data, tx.byte_codes(False))
        start, count, value, owner = window_runs(self.data, self.offsets, self.prefix)
        known = self.docs[owner] != NO_DOC
        self.start, self.count, self.value, self.owner = start[known], count[known], value[known], owner[known]
        self.shift = np.uint64(shift)

    def anchors(self) -> np.ndarray:
        """Distinct anchors in ascending order, twice if several documents of the part have it."""
        doc = self.docs[self.owner]
        order = np.lexsort((doc, self.value))
        value, doc = self.value[order], doc[order]
        first = np.ones(len(value), dtype=bool)
        first[1:] = value[1:] != value[:-1]
        other = np.zeros(len(value), dtype=bool)
        other[1:] = ~first[1:] & (doc[1:] != doc[:-1])
        heads = np.flatnonzero(first)
        several = np.add.reduceat(other, heads) > 0 if len(heads) else np.zeros(0, dtype=bool)
        return np.repeat(value[heads], 1 + several)

    def by_bucket(self, values: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(bucket, from, to) of ascending values."""
        bucket = (values >> self.shift).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(bucket)).tolist(), strict=True):
            if a < b:
                yield int(bucket[a]), a, b

    def select(self, answers: list[dict]) -> None:
        """Keep the runs whose anchor several documents have, and find their distinct strings."""
        values = self.anchors()
        shared = np.zeros(len(values), dtype=bool)
        bits = {r["bucket"]: r["payload"] for r in answers}
        for bucket, a, b in self.by_bucket(values):
            shared[a:b] = np.unpackbits(np.frombuffer(bits[bucket], dtype=np.uint8), count=b - a).astype(bool)
        wanted = np.unique(values[shared])
        at = np.searchsorted(wanted, self.value)
        at[at == len(wanted)] = 0
        own = wanted[at] == self.value if len(wanted) else np.zeros(len(self.value), dtype=bool)
        self.start, self.count, self.value, self.owner = (
            x[own] for x in (self.start, self.count, self.value, self.owner)
        )
        length = self.count + LENGTH - 1
        key = tx.range_hashes(self.prefix, self.start, self.start + length)
        while True:
            order = np.lexsort((key, self.value))
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = (key[order][1:] != key[order][:-1]) | (self.value[order][1:] != self.value[order][:-1])
            heads = np.flatnonzero(fresh)
            # Runs are one string if their bytes are equal, not just their hashes.
            head = order[heads][np.cumsum(fresh) - 1]
            other = order != head
            one, two = order[other], head[other]
            same = length[one] == length[two]
            same[same] = same_bytes(self.data, self.start[one[same]], self.start[two[same]], length[one[same]])
            if same.all():
                break
            apart = np.isin(self.value, self.value[one[~same]])
            key[apart] = np.flatnonzero(apart)
        self.string = np.empty(len(order), dtype=np.int64)
        self.string[order] = np.cumsum(fresh) - 1
        self.sample = order[heads]  # a run of each string, strings ascending by anchor
        docs = self.docs[self.owner]
        self.least = np.minimum.reduceat(docs[order], heads) if len(heads) else docs[:0]


def _message(rows: list[tuple]) -> pa.RecordBatch:
    part, bucket, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int64()), pa.array(bucket, pa.int64()), pa.array(payload, pa.binary())],
        ["part", "bucket", "payload"],
    )


_MESSAGE = "part long, bucket long, payload binary"


def _ask_anchors(shift: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = Part(batch.slice(k, 1).to_pylist()[0], shift)
                values = part.anchors()
                low = (values & np.uint64(0xFFFFFFFF)).astype("<u4")
                yield _message([(part.part, w, low[a:b].tobytes()) for w, a, b in part.by_bucket(values)])

    return ask


def _answer_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of the entries that occur twice; half a hash is enough for a filter."""
    for batch, starts in key_runs(batches, ["bucket"]):
        rows = batch.to_pylist()
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            asked = [np.frombuffer(r["payload"], dtype="<u4") for r in rows[lo:hi]]
            _, where, count = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
            twice = np.split(count[where] > 1, np.cumsum([len(x) for x in asked])[:-1])
            yield _message(
                [(r["part"], r["bucket"], np.packbits(t).tobytes()) for r, t in zip(rows[lo:hi], twice, strict=True)]
            )


def _ask_windows(shift: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                part = Part(row, shift)
                part.select(row["shared"] or [])
                out = []
                for bucket, a, b in part.by_bucket(part.value[part.sample]):
                    own = part.sample[a:b]
                    length = part.count[own] + LENGTH - 1
                    at, _ = expand(part.start[own], length)
                    head = np.array([b - a], dtype="<i8").tobytes() + length.astype("<u1").tobytes()
                    body = part.least[a:b].astype("<i8").tobytes() + part.data[at].tobytes()
                    out.append((part.part, bucket, packer.compress(head + body)))
                yield _message(out)

    return ask


def _answer_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for batch, starts in key_runs(batches, ["bucket"]):
        parts, buckets, payload = (batch.column(c) for c in ("part", "bucket", "payload"))
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            length, docs, body = [], [], []
            for k in range(lo, hi):
                raw = zstandard.decompress(payload[k].as_buffer())
                n = int(np.frombuffer(raw, dtype="<i8", count=1)[0])
                length.append(np.frombuffer(raw, dtype="<u1", count=n, offset=8).astype(np.int64))
                docs.append(np.frombuffer(raw, dtype="<i8", count=n, offset=8 + n))
                body.append(np.frombuffer(raw, dtype=np.uint8, offset=8 + 9 * n))
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(length))])
            data, docs = np.concatenate(body), np.concatenate(docs)
            del body, raw
            group, first, least = least_docs(data, offsets, docs)
            del data, docs
            out, at = [], 0
            for k, own in enumerate(length, lo):
                where, _ = expand(first[group[at : at + len(own)]], own - LENGTH + 1)
                answer = packer.compress(least[where].astype("<i8").tobytes())
                out.append((parts[k].as_py(), buckets[k].as_py(), answer))
                at += len(own)
            yield _message(out)


RESULT = T.StructType(
    [
        T.StructField("n_bytes", T.LongType(), False),
        T.StructField("n_removed", T.LongType(), False),
        T.StructField("removed_spans", T.ArrayType(T.ArrayType(T.LongType(), False), False), False),
        T.StructField("kept_bytes", T.BinaryType(), False),
    ]
)


def _remove(shift: int, keep: list[str]):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                part = Part(row, shift)
                part.select(row["shared"] or [])
                payload = {r["bucket"]: r["payload"] for r in row["least"] or []}
                least = [
                    np.frombuffer(zstandard.decompress(payload[w]), dtype="<i8")
                    for w, _, _ in part.by_bucket(part.value[part.sample])
                ]
                least = np.concatenate(least) if least else np.zeros(0, dtype=np.int64)
                windows = part.count[part.sample]
                first = np.cumsum(windows) - windows
                at, owner = expand(part.start, part.count)
                where, _ = expand(first[part.string], part.count)
                at = at[least[where] < part.docs[part.owner[owner]]]
                depth = np.zeros(len(part.data) + 1, dtype=np.int32)
                depth[at] += 1  # starts are distinct
                depth[at + LENGTH] -= 1
                gone = np.cumsum(depth[:-1]) > 0
                sizes, removed, spans, kept = [], [], [], []
                for lo, hi in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist(), strict=True):
                    flags = gone[lo:hi]
                    steps = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                    sizes.append(hi - lo)
                    removed.append(int(flags.sum()))
                    spans.append(steps.reshape(-1, 2).tolist())
                    kept.append(part.data[lo:hi][~flags].tobytes())
                rest = []
                if keep:
                    stored = pa.ipc.open_stream(zstandard.decompress(row["rest"])).read_all().combine_chunks()
                    rest = [stored.column(c).combine_chunks() for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        *rest,
                        pa.array(sizes, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                        pa.array(kept, pa.binary()),
                    ],
                    [*keep, *RESULT.names],
                )

    return remove


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` without `text` (or the columns `keep`) plus n_bytes, n_removed, removed_spans, kept_bytes.

    Every byte covered by a LENGTH-byte string that also starts in a row with a smaller doc_id is
    removed. Texts are UTF-8 bytes, strings never cross rows, overlaps count, and strings are judged
    on the input. `removed_spans` are maximal [from, to) byte ranges; `kept_bytes` may cut inside a
    character.

    Null or short text: nothing removed. Rows of equal doc_id do not remove from each other. A null
    doc_id: nothing is removed from the row or because of it. No rows: no rows. A name in
    `keep` equal to a result column raises; a row's text is held in one task.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else list(keep)
    if {c.lower() for c in keep} & set(RESULT.names):
        raise ValueError("columns clash with results")
    source = docs.select(
        F.col(doc_id).cast("long").alias("__doc"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"),
        *[F.col(f"`{c}`") for c in keep],
    )
    packed = materialized(
        source.mapInArrow(
            _pack(keep), "part long, docs array<bigint>, lengths array<bigint>, bytes binary, rest binary"
        ),
        "parts",
    )
    total = packed.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(MIN_BUCKETS, 1 << max(0, int(total // BUCKET_BYTES)).bit_length())
    shift = 64 - (buckets.bit_length() - 1)
    texts = packed.select("part", "docs", "lengths", "bytes")
    asked = texts.mapInArrow(_ask_anchors(shift), _MESSAGE)
    shared = gathered(asked, ["bucket"]).mapInArrow(_answer_anchors, _MESSAGE)
    by_part = lambda df, name: df.groupBy("part").agg(
        F.collect_list(F.struct("bucket", "payload")).alias(name)
    )
    shared = by_part(materialized(shared, "anchors"), "shared")
    wanted = texts.join(shared, "part", "left").mapInArrow(_ask_windows(shift), _MESSAGE)
    least = gathered(wanted, ["bucket"]).mapInArrow(_answer_windows, _MESSAGE)
    least = by_part(materialized(least, "windows"), "least")
    whole = packed.join(shared, "part", "left").join(least, "part", "left")
    shown = source.select(*keep).schema
    return whole.mapInArrow(_remove(shift, keep), T.StructType([*shown, *RESULT]))
