"""Near-duplicate vectors by an inverted multi-index with an exact stopping rule.

Unit vectors are cut in two halves, each half has its own codebook, and a vector lies in the cell
(nearest code of the first half, nearest code of the second). A query walks the cells in order of a
lower bound of its distance to anything inside them: a point nearer to code c than to the query's
code a is at least (|x - c|^2 - |x - a|^2) / (2 |a - c|) away from the query's half x. The walk ends when the
bounds of both halves together exceed the wanted radius, so recall is 1 by construction; every
candidate is verified by its cosine in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.graph import components
from millrace.llm.runs import gathered, key_runs
from millrace.session import materialized

THRESHOLD = 0.98
#: Vectors the codebooks are fitted on; the index holds every vector.
SAMPLE = 20_000
CELL_ROWS = 512
MAX_CODES = 512
LIST_BLOCK = 1024
QUERY_BLOCK = 2048


@dataclass(frozen=True)
class Index:
    books: tuple[np.ndarray, np.ndarray]
    gaps: tuple[np.ndarray, np.ndarray]  # distances between codes
    limit: float  # squared radius

    @property
    def codes(self) -> int:
        return len(self.books[0])

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.books[0].shape[1]
        halves = unit[:, :cut], unit[:, cut:]
        return tuple(
            (h**2).sum(1)[:, None] - 2 * h @ book.T + (book**2).sum(1)[None, :]
            for h, book in zip(halves, self.books, strict=True)
        )

    def walk(self, d1: np.ndarray, d2: np.ndarray) -> list[int]:
        """Cells of one query in multi-sequence order, up to the bound."""
        bounds, orders = [], []
        for d, gap in zip((d1, d2), self.gaps, strict=True):
            own = int(d.argmin())
            bound = np.maximum(0, (d - d[own]) / np.maximum(2 * gap[own], 1e-12)) ** 2
            bound[own] = 0
            order = np.argsort(bound, kind="stable")
            order = order[bound[order] <= self.limit]
            orders.append(order.tolist())
            bounds.append(bound[order].tolist())
        heap, out = [(0.0, 0, 0)], []
        while heap and heap[0][0] <= self.limit:
            _, i, j = heapq.heappop(heap)
            out.append(orders[0][i] * self.codes + orders[1][j])
            if j + 1 < len(orders[1]):
                heapq.heappush(heap, (bounds[0][i] + bounds[1][j + 1], i, j + 1))
            if j == 0 and i + 1 < len(orders[0]):
                heapq.heappush(heap, (bounds[0][i + 1] + bounds[1][0], i + 1, 0))
        return out


def _codebook(points: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's iterations from evenly spaced distinct points."""
    points = np.unique(points, axis=0)
    codes = min(codes, len(points))
    book = points[np.linspace(0, len(points) - 1, codes).astype(int)].copy()
    for _ in range(rounds):
        near = ((book**2).sum(1)[None, :] - 2 * points @ book.T).argmin(1)
        sums = np.zeros_like(book)
        np.add.at(sums, near, points)
        count = np.bincount(near, minlength=codes)
        book[count > 0] = sums[count > 0] / count[count > 0, None]
    return book


def _fit(sample: np.ndarray, codes: int, threshold: float) -> Index:
    cut = (sample.shape[1] + 1) // 2
    books = [_codebook(h, codes) if h.shape[1] else np.zeros((1, 0)) for h in (sample[:, :cut], sample[:, cut:])]
    size = max(map(len, books))
    # Unequal books are filled up with copies of the last code, which never win.
    books = [np.vstack([b, np.repeat(b[-1:], size - len(b), axis=0)]) for b in books]
    gaps = [np.sqrt(np.maximum(0, ((b[:, None, :] - b[None, :, :]) ** 2).sum(2))) for b in books]
    # A little slack, so that rounding in the bounds cannot lose a pair at the threshold.
    return Index(tuple(books), tuple(gaps), max(0.0, 2 - 2 * threshold) + 1e-6)


def _units(column: pa.Array) -> np.ndarray:
    """Rows of float64 from a binary column, each divided by its length."""
    raw = np.frombuffer(b"".join(x.as_py() for x in column), dtype="<f8").reshape(len(column), -1)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw**2).sum(axis=1, keepdims=True))


def _clean(dimension: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                values = x.as_py()
                if not values or None in values:
                    out.append(None)
                    continue
                v = np.zeros(dimension, dtype="<f8")
                v[: len(values)] = values
                out.append(v.tobytes() if np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.binary()), batch.column(2)], ["id", "v", "label"]
            )

    return clean


def _places(sent):
    """List row of every vector (side 0) and a query row for every cell it visits (side 1)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                d1, d2 = index.distances(_units(part.column(2)))
                own = d1.argmin(1) * index.codes + d2.argmin(1)
                walks = [index.walk(a, b) for a, b in zip(d1, d2, strict=True)]
                take = np.repeat(np.arange(len(walks)), [len(w) for w in walks])
                rows = pa.array(np.concatenate([np.arange(len(walks)), take]))
                out = part.take(rows)
                cells = np.concatenate([own, np.array([c for w in walks for c in w], dtype=np.int64)])
                side = np.concatenate([np.zeros(len(walks), np.int32), np.ones(len(take), np.int32)])
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array(cells, pa.int64()), pa.array(side, pa.int32())],
                    [*part.schema.names, "cell", "side"],
                )

    return place


def _verifier(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in key_runs(batches, ["label", "cell", "lb", "qb"]):
            side = batch.column("side").to_numpy()
            ids, sizes = batch.column("id").to_numpy(), batch.column("size").to_numpy()
            out = [[], [], []]
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                lists = lo + np.flatnonzero(side[lo:hi] == 0)
                asked = lo + np.flatnonzero(side[lo:hi] == 1)
                if not len(lists) or not len(asked):
                    continue
                unit = _units(batch.column("v").slice(lo, hi - lo))
                a, b = unit[asked - lo], unit[lists - lo]
                link = (a @ b.T >= threshold) & (ids[asked][:, None] != ids[lists][None, :])
                n = link @ sizes[lists]
                # Labels spread over the block's links until they settle; a star for each label
                # keeps every connection of the block with one row for each vector.
                label = np.arange(len(lists))
                none = len(lists)
                while True:
                    of_query = np.where(link, label[None, :], none).min(1)
                    now = np.minimum(label, np.where(link, of_query[:, None], none).min(0))
                    now = now[now]
                    if (now == label).all():
                        break
                    label = now
                hit = of_query < none
                out[0] += ids[asked][hit].tolist()
                out[1] += n[hit].tolist()
                out[2] += ids[lists][of_query[hit]].tolist()
                far = link.any(0) & (label != np.arange(len(lists)))
                out[0] += ids[lists][far].tolist()
                out[1] += [0] * int(far.sum())
                out[2] += ids[lists][label[far]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "n", "b"])

    return verify


def near_vectors(
    df: DataFrame,
    threshold: float = THRESHOLD,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    sample: int = SAMPLE,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each input row.

    Rows of equal label link when the cosine of their vectors is at least `threshold`. Equal vectors
    of one label are one class: compared once, counted each. n_links counts other vectors linked
    directly, component_id is the least id reachable.

    A null label, a null, empty or zero vector, and null or non-finite components: no links. Shorter
    vectors are read as followed by zeros. Repeated ids count as one node. A null id: no links,
    component_id null, kept. No rows: no rows. Other columns are ignored.

    Codebooks are fitted on about `sample` vectors chosen by hash; their size follows the largest
    label, so that a cell keeps about CELL_ROWS rows. Dense cells are split in blocks of rows and of
    queries, so no task's share depends on how many rows a cell holds.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(vec_id).cast("long").alias("id"),
        F.col(vector).cast("array<double>").alias("v"),
        F.col(label).cast("string").alias("label"),
    )
    dimension = rows.agg(F.max(F.size("v"))).first()[0]
    dimension = max(1, dimension or 1)
    clean = materialized(rows.mapInArrow(_clean(dimension), "id long, v binary, label string"), "vectors")
    usable = clean.filter("id is not null and v is not null and label is not null")
    classes = materialized(
        usable.groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size")), "vector-classes"
    ).select("id", "label", "v", "size")
    sizes = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("top"), F.sum("n").alias("n")).first()
    if sizes["n"]:
        share = min(1.0, sample / sizes["n"])
        chosen = classes.filter(F.pmod(F.xxhash64("id", "label"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        picked = chosen.select("v").limit(2 * sample).collect()
        codes = int(min(MAX_CODES, max(1, np.ceil(np.sqrt(sizes["top"] / CELL_ROWS)))))
        index = _fit(_units(pa.array([bytes(r["v"]) for r in picked], pa.binary())), codes, threshold)
    else:
        index = _fit(np.eye(1, dimension), 1, threshold)
    sent = spark.sparkContext.broadcast(index)
    placed = materialized(
        classes.mapInArrow(_places(sent), "id long, label string, v binary, size long, cell long, side int"), "cells"
    )
    counts = placed.groupBy("label", "cell").agg(
        F.sum((F.col("side") == 0).cast("int")).alias("n_list"), F.sum("side").alias("n_query")
    )
    blocks = counts.filter("n_list > 0").select(
        "label",
        "cell",
        F.ceil(F.col("n_list") / LIST_BLOCK).cast("int").alias("lbs"),
        F.ceil(F.col("n_query") / QUERY_BLOCK).cast("int").alias("qbs"),
    )
    ranged = lambda n: F.sequence(F.lit(0), n - 1)
    own_list, own_query = F.pmod(F.hash("id"), F.col("lbs")), F.pmod(F.hash("id", F.lit(1)), F.col("qbs"))
    spread = F.explode(
        F.when(
            F.col("side") == 0,
            F.transform(ranged(F.col("qbs")), lambda q: F.struct(own_list.alias("lb"), q.cast("int").alias("qb"))),
        ).otherwise(
            F.transform(ranged(F.col("lbs")), lambda b: F.struct(b.cast("int").alias("lb"), own_query.alias("qb")))
        )
    )
    tasks = placed.join(blocks, ["label", "cell"]).withColumn("p", spread).select(
        "label", "cell", "p.lb", "p.qb", "side", "id", "size", "v"
    )
    found = materialized(
        gathered(tasks, ["label", "cell", "lb", "qb"]).mapInArrow(_verifier(threshold), "a long, n long, b long"),
        "vector-links",
    )
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    groups = components(found.select("a", "b")).withColumnRenamed("node", "rep")
    members = usable.join(
        classes.select("label", "v", F.col("id").alias("rep"), "size"), ["label", "v"]
    ).select("id", "rep", "size")
    linked = (
        members.join(links, "rep", "left")
        .join(groups, "rep", "left")
        .select(
            F.col("id").alias("vec_id"),
            (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    alone = clean.filter("id is null or v is null or label is null").select(
        F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )
