"""Benchmark decontamination: a prefix-filtered set join of item windows with documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import text as tx

WINDOW_WORDS = 13
SHINGLE_WORDS = 4
#: Benchmark words held by a task at once; a larger benchmark is joined slice by slice.
SLICE_WORDS = 1_000_000
_SEGMENT = 50_000

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("n_hit", T.LongType(), False),
        T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType(), False), False), False),
        T.StructField("items", T.ArrayType(T.StringType(), False), False),
        T.StructField("contaminated", T.BooleanType(), False),
    ]
)


@dataclass(frozen=True)
class Windows:
    """Distinct windows of one slice: their words, length, items and, once known, prefix."""

    words: np.ndarray  # windows x WINDOW_WORDS, zero beyond the length
    length: np.ndarray
    item_start: np.ndarray
    items: np.ndarray
    names: list[str]

    def elements(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every shingle of every window: value, width, window, offset."""
        parts = []
        for n in np.unique(self.length):
            rows = np.flatnonzero(self.length == n)
            width = min(SHINGLE_WORDS, int(n))
            for at in range(int(n) - width + 1):
                block = self.words[rows, at : at + width]
                value = np.zeros(len(rows), dtype=np.uint64)
                for k in range(width):
                    value = value * tx._BASE + block[:, k]
                value = tx.mix(value + np.uint64(width))
                parts.append((value, np.full(len(rows), width), rows, np.full(len(rows), at)))
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, text = batch.column(0), batch.column(1)
        out_name, out_words = [], []
        for lo, hi, data, offsets in tx.chunks(text):
            words, _, _, first = tx.word_hashes(data, offsets, tx.ALNUM)
            for row in range(hi - lo):
                own = words[first[row] : first[row + 1]]
                name = names[lo + row].as_py() or ""
                for at in range(0, max(1, len(own) - WINDOW_WORDS + 1), _SEGMENT):
                    part = own[at : at + _SEGMENT + WINDOW_WORDS - 1]
                    if len(part):
                        out_name.append(name)
                        out_words.append(part.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(out_name, pa.string()), pa.array(out_words, pa.list_(pa.int64()))], ["item", "words"]
        )


def _slice_windows(rows: list) -> Windows:
    names = sorted({r["item"] for r in rows})
    index = {n: k for k, n in enumerate(names)}
    words, length, owner = [], [], []
    for r in rows:
        own = np.array(r["words"], dtype=np.int64).view(np.uint64)
        n = min(len(own), WINDOW_WORDS)
        view = np.lib.stride_tricks.sliding_window_view(own, n)
        block = np.zeros((len(view), WINDOW_WORDS), dtype=np.uint64)
        block[:, :n] = view
        words.append(block)
        length.append(np.full(len(view), n))
        owner.append(np.full(len(view), index[r["item"]]))
    words, length, owner = np.concatenate(words), np.concatenate(length), np.concatenate(owner)
    keyed = np.column_stack([words, length.astype(np.uint64)])
    distinct, inverse = np.unique(keyed, axis=0, return_inverse=True)
    pairs = np.unique(np.column_stack([inverse.reshape(-1), owner]), axis=0)
    start = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
    return Windows(
        np.ascontiguousarray(distinct[:, :-1]), distinct[:, -1].astype(np.int64), start, pairs[:, 1], names
    )


class _Probe:
    """Finds which of many values occur in a sorted table: a bitmap first, then a search."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        bits = max(16, min(24, int(len(self.values)).bit_length() + 4))
        self.mask = np.uint64((1 << bits) - 1)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[(self.values & self.mask).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in x that occur, and their index in the table."""
        at = np.flatnonzero(self.seen[(x & self.mask).astype(np.int64)])
        where = np.searchsorted(self.values, x[at])
        where[where == len(self.values)] = 0
        hit = self.values[where] == x[at]
        return at[hit], where[hit]


def _widths(words: np.ndarray, first: np.ndarray, widths: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, shingles at every word, row of every word); shingles may run over a row's end."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for width in widths:
        yield int(width), tx.shingle_hashes(words, int(width)), row


def _rarity(docs: DataFrame, text: str, windows: Windows) -> np.ndarray:
    """Occurrences in all documents of every benchmark shingle, aligned with the sorted values."""
    value, width, _, _ = windows.elements()
    probes = {int(w): _Probe(value[width == w]) for w in np.unique(width)}
    sent = docs.sparkSession.sparkContext.broadcast(probes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        totals = {w: np.zeros(len(p.values), dtype=np.int64) for w, p in table.items()}
        for batch in batches:
            for _, _, data, offsets in tx.chunks(batch.column(0)):
                words, _, _, first = tx.word_hashes(data, offsets, tx.ALNUM)
                for w, shingles, row in _widths(words, first, np.array(list(table))):
                    at, where = table[w].find(shingles)
                    inside = row[at] == row[at + w - 1]
                    totals[w] += np.bincount(where[inside], minlength=len(totals[w]))
        for w, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), w), pa.int32()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())],
                ["width", "at", "n"],
            )

    counts = (
        docs.select(text)
        .mapInArrow(count, "width int, at int, n long")
        .groupBy("width", "at")
        .agg(F.sum("n").alias("n"))
        .collect()  # at most one row for each shingle of the slice
    )
    out = {w: np.zeros(len(p.values), dtype=np.int64) for w, p in probes.items()}
    for r in counts:
        out[r["width"]][r["at"]] = r["n"]
    sent.unpersist()
    result = np.zeros(len(value), dtype=np.int64)
    for w, p in probes.items():
        own = width == w
        result[own] = out[w][np.searchsorted(p.values, value[own])]
    return result


def _prefixes(windows: Windows, counts: np.ndarray) -> dict[int, tuple]:
    """For each width: prefix values, and for each the windows with that prefix and its offset.

    A window must be contained whole, so of its shingles in order of rarity (count, then value)
    a prefix of one is enough: a document without the rarest shingle cannot contain the window.
    """
    value, width, window, offset = windows.elements()
    order = np.lexsort((offset, value, counts, window))
    first = order[np.unique(window[order], return_index=True)[1]]
    out = {}
    for w in np.unique(width[first]):
        own = first[width[first] == w]
        own = own[np.argsort(value[own], kind="stable")]
        probe = _Probe(value[own])
        start = np.searchsorted(value[own], probe.values)
        out[int(w)] = (probe, np.append(start, len(own)), window[own], offset[own])
    return out


def _expand(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated ranges start[i]:end[i], and the i of every element."""
    n = end - start
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n), owner


def _hits(words: np.ndarray, first: np.ndarray, windows: Windows, prefixes: dict) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window in the rows of a chunk."""
    found_at, found_window = [], []
    for w, shingles, row in _widths(words, first, np.array(list(prefixes))):
        probe, start, window, offset = prefixes[w]
        at, where = probe.find(shingles)
        entry, owner = _expand(start[where], start[where + 1])
        at, window_of = at[owner], window[entry]
        begin = at - offset[entry]
        length = windows.length[window_of]
        # Positional and length bounds: the window lies inside the row that holds the shingle.
        ok = (begin >= first[row[at]]) & (begin + length <= first[row[at] + 1])
        begin, window_of, length = begin[ok], window_of[ok], length[ok]
        for k in range(WINDOW_WORDS):
            if len(begin) == 0:
                break
            same = k >= length
            inside = np.minimum(begin + k, len(words) - 1)
            ok = same | (words[inside] == windows.words[window_of, k])
            begin, window_of, length = begin[ok], window_of[ok], length[ok]
        found_at.append(begin)
        found_window.append(window_of)
    if not found_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_at), np.concatenate(found_window)


def _matcher(sent, text_at: int, known: bool):
    """Marks the windows of one slice; with known, on top of the results of earlier slices."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, prefixes = sent.value
        for batch in batches:
            earlier = batch.num_columns - len(RESULT) if known else batch.num_columns
            for lo, hi, data, offsets in tx.chunks(batch.column(text_at)):
                n_words, n_hit, spans, items, bad = [], [], [], [], []
                words, _, _, first = tx.word_hashes(data, offsets, tx.ALNUM)
                begin, window = _hits(words, first, windows, prefixes)
                row = np.searchsorted(first, begin, side="right") - 1
                depth = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(depth, begin, 1)
                np.add.at(depth, begin + windows.length[window], -1)
                entry, owner = _expand(windows.item_start[window], windows.item_start[window + 1])
                pairs = np.unique(np.column_stack([row[owner], windows.items[entry]]), axis=0)
                marked = np.cumsum(depth[:-1]) > 0
                sums = np.concatenate([[0], np.cumsum(marked)])
                hit = sums[first[1:]] - sums[first[:-1]]
                own_items: dict[int, list[str]] = {}
                for r, k in pairs.tolist():
                    own_items.setdefault(r, []).append(windows.names[k])
                for r in range(hi - lo):
                    flags, names = marked[first[r] : first[r + 1]], own_items.get(r, [])
                    if known:
                        flags, names = flags.copy(), set(names)
                        for s, e in batch.column(earlier + 2)[lo + r].as_py():
                            flags[s:e] = True
                        names |= set(batch.column(earlier + 3)[lo + r].as_py())
                    n = int(flags.sum()) if known else int(hit[r])
                    if n:
                        steps = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                        spans.append(steps.reshape(-1, 2).tolist())
                    else:
                        spans.append([])
                    n_words.append(int(len(flags)))
                    n_hit.append(n)
                    items.append(sorted(names))
                    bad.append(n > 0 and 20 * n >= len(flags))
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(lo, hi - lo).columns[:earlier],
                        pa.array(n_words, pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                        pa.array(items, pa.list_(pa.string())),
                        pa.array(bad, pa.bool_()),
                    ],
                    [*batch.schema.names[:earlier], *RESULT.names],
                )

    return match


def mark_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    slice_words: int = SLICE_WORDS,
) -> DataFrame:
    """`docs` (or its columns `keep`) with n_words, n_hit, hit_spans, items and contaminated.

    Words are runs of ASCII digits and letters (case-folded) and of any character beyond ASCII.
    A window is 13 consecutive words of an item, or all words of a shorter item. A document word
    inside an occurrence of a window is hit; `hit_spans` are maximal [from, to) word ranges, `items`
    the ids (as text, sorted) whose windows occur; contaminated: at least one word in 20 is hit.

    The benchmark is the query set: its windows are hashed on the executors, and slices of at most
    about `slice_words` words are sent to the tasks one after the other, so what a task holds is
    bounded whatever the benchmark's size. Documents never leave their partition; texts are read
    whole. Rarity counts of the windows' shingles come from all documents.

    Null or empty text: no words, not contaminated. Null or empty item text: no windows. A null
    item id is listed as an empty name; rows of one id are one item. Repeated rows are judged
    alike. An empty benchmark marks nothing. A name in `keep` equal to a result column raises.
    """
    keep = list(docs.columns if keep is None else keep)
    clash = {c.lower() for c in keep} & set(RESULT.names)
    if clash:
        raise ValueError(f"columns clash with results: {sorted(clash)}")
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("t"))
    hashed = items.mapInArrow(_item_words, "item string, words array<bigint>").withColumn("n", F.size("words"))
    total = hashed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slices = max(1, -(-total // slice_words))
    numbered = hashed.withColumn("slice", F.pmod(F.xxhash64("item", "words"), F.lit(slices)))
    carried = [c for c in keep if c != text]
    now = docs.select(F.col(text).cast("string").alias(text), *[F.col(f"`{c}`") for c in carried])
    plain = now.schema
    known = False
    for k in range(slices):
        rows = numbered.filter(F.col("slice") == k).select("item", "words").collect()  # bounded by slice_words
        if not rows and (known or k < slices - 1):
            continue
        if rows:
            windows = _slice_windows(rows)
            prefixes = _prefixes(windows, _rarity(docs, text, windows))
        else:
            none = np.zeros(0, np.int64)
            windows = Windows(np.zeros((0, WINDOW_WORDS), np.uint64), none, np.zeros(1, np.int64), none, [])
            prefixes = {}
        sent = spark.sparkContext.broadcast((windows, prefixes))
        now = now.mapInArrow(_matcher(sent, 0, known), T.StructType([*plain, *RESULT]))
        known = True
    return now.select(*keep, *RESULT.names)
