"""Near-duplicate documents: an inverted join over signature coordinates, exact confirmation.

1. Every text becomes its set of word shingles; equal sets are one class, represented by its
   least id. Only classes are compared, so exact copies cost one row each.
2. A class is posted under its `coordinates` (coordinate, value) pairs. Two classes that agree in
   at least `matches` coordinates must share one of their `coordinates - matches + 1` rarest
   pairs: pairs that occur once and the most frequent `matches - 1` of a class are skipped.
3. In a posting list the class with the most shared signature is the centre. Every class meets the
   heaviest centre of its lists; then, in lists that still hold several components, the others meet
   the list's own. Collisions are counted on the signatures, survivors confirmed on the full sets,
   links contracted to components.
4. Lists that still hold several components are merged exhaustively between components, in
   blocks: candidates are found on signatures, their groups are confirmed on full sets, and only
   a spanning forest leaves a task. Hot groups thus give few rows and lose no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import text as tx
from millrace.llm.graph import components
from millrace.llm.runs import gathered, key_runs
from millrace.session import materialized

LIST_BLOCK = 256
GROUP_BLOCK = 256


@dataclass(frozen=True)
class NearDup:
    """A pair with similarity 0.8 agrees in 25.6 of 32 coordinates on average with a deviation
    of 2.3, so 15 matches miss it with a chance below 1e-5."""

    width: int = 5
    percent: int = 80
    coordinates: int = 32
    matches: int = 15

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        low, high = sorted((len(a), len(b)))
        if 100 * low < self.percent * high:
            return False
        shared = tx.shared_count(a, b)
        return 100 * shared >= self.percent * (low + high - shared)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = tx.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return raw[:n], raw[n:] | np.uint64(1)


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """The least 32-bit value of n hash functions over a set that is not empty."""
    flip, factor = _seeds(n)
    least = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        block = (shingles[at : at + 2048, None] ^ flip) * factor
        least = np.minimum(least, block.min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for lo, hi, data, offsets in tx.chunks(column):
        words, _, _, first = tx.word_hashes(data, offsets, tx.NOT_SPACE)
        for row in range(hi - lo):
            yield tx.shingle_set(words[first[row] : first[row + 1]], width)


def _signer(rule: NearDup):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, one, two, sig = [], [], [], []
            for shingles in _sets(batch.column(1), rule.width):
                size.append(len(shingles))
                one.append(int(tx.mix(shingles).sum(dtype=np.uint64).view(np.int64)))
                two.append(int(tx.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                sig.append(signature(shingles, rule.coordinates) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(size, pa.int64()),
                    pa.array(one, pa.int64()),
                    pa.array(two, pa.int64()),
                    pa.array(sig, pa.list_(pa.int32())),
                ],
                ["doc", "n_shingles", "one", "two", "sig"],
            )

    return sign


def _agreeing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def _prefixes(reps: DataFrame, rule: NearDup) -> DataFrame:
    """(token, doc, weight): the rarest shared tokens of every class that can have a partner."""
    postings = reps.select("doc", F.posexplode("sig").alias("at", "value")).select(
        "doc",
        (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long") - F.lit(-(1 << 31))).alias("token"),
    )
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    lists = (
        postings.join(shared, "token")
        .groupBy("doc")
        .agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("own"))
        .filter(F.size("own") >= rule.matches)
    )
    return lists.select(
        "doc",
        F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("weight"),
        F.explode(F.slice("own", F.lit(1), F.size("own") - rule.matches + 1)).alias("x"),
    ).select("x.token", "doc", "weight")


def _confirmer(rule: NearDup):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _sets(batch.column(2), rule.width), _sets(batch.column(3), rule.width)
            ok = pa.array([rule.similar(a, b) for a, b in zip(left, right, strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(ok)

    return confirm


def _list_merger(rule: NearDup):
    """Groups of candidates in (token, i, j) blocks, as (member, least member)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in key_runs(batches, ["token", "i", "j"]):
            doc, comp, block = (batch.column(c).to_numpy() for c in ("doc", "comp", "block"))
            cross = batch.column("i").to_numpy() != batch.column("j").to_numpy()
            sig = batch.column("sig").flatten().to_numpy().reshape(-1, rule.coordinates)
            pairs: set[tuple[int, int]] = set()
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                left, right = [], []
                for r in range(lo, hi - 1):
                    test = np.flatnonzero(comp[r + 1 : hi] != comp[r]) + r + 1
                    if cross[lo]:
                        test = test[block[test] != block[r]]
                    if len(test):
                        test = test[(sig[test] == sig[r]).sum(axis=1) >= rule.matches]
                        left += [r - lo] * len(test)
                        right += (test - lo).tolist()
                for member, least in _local_groups(doc[lo:hi], left, right):
                    pairs.add((member, least))
            a, b = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return merge


def _local_groups(docs: np.ndarray, left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """(member, least member) of the components of candidate pairs: the same star from every list
    that holds the group, so that lists repeat each other's rows."""
    if not left:
        return []
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    names = docs.tolist()
    for x, y in zip(left, right, strict=True):
        x, y = find(names[x]), find(names[y])
        root[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in list(root) if find(x) != x]


def _group_confirmer(rule: NearDup):
    """Confirmed forests of (g, kind, i, j) blocks between components."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in key_runs(batches, ["g", "kind", "i", "j"]):
            doc, comp, side = (batch.column(c).to_numpy() for c in ("doc", "comp", "side"))
            apart = batch.column("apart").to_numpy(zero_copy_only=False)
            sig = batch.column("sig").flatten().to_numpy().reshape(-1, rule.coordinates)
            sets = list(_sets(batch.column("text"), rule.width))
            out_a, out_b = [], []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                root = {int(c): int(c) for c in comp[lo:hi]}

                def find(x: int, root: dict[int, int] = root) -> int:
                    while root[x] != x:
                        x = root[x]
                    return x

                for r in range(lo, hi - 1):
                    test = np.flatnonzero(comp[r + 1 : hi] != comp[r]) + r + 1
                    if apart[lo]:
                        test = test[side[test] != side[r]]
                    if len(test):
                        test = test[(sig[test] == sig[r]).sum(axis=1) >= rule.matches]
                    for t in test.tolist():
                        x, y = find(int(comp[r])), find(int(comp[t]))
                        if x != y and rule.similar(sets[r], sets[t]):
                            root[max(x, y)] = min(x, y)
                            out_a.append(doc[r])
                            out_b.append(doc[t])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"]
            )

    return confirm


def _pairs_of_blocks(own: Column, n: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j")),
    )


def _blocks(count: Column, size: int) -> Column:
    return F.ceil(count / F.lit(size)).cast("int")


def near_duplicates(docs: DataFrame, rule: NearDup = NearDup(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each input row.

    Words are runs of bytes other than space, tab and line breaks, A-Z folded. The set is the
    distinct shingles of `width` words; a shorter text is one shingle. Rows link when
    100 * |intersection| >= percent * |union|; component_id is the least id reachable.

    Null, empty or blank text: an empty set, linked with nothing. Repeated ids count as one node.
    A null id: never linked, component_id null, kept. No rows: no rows. Texts of any
    length are read whole. Other columns are ignored.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    signed = materialized(
        source.mapInArrow(_signer(rule), "doc long, n_shingles long, one long, two long, sig array<int>"), "signed"
    )
    key = ["n_shingles", "one", "two"]
    classes = signed.filter("doc is not null and n_shingles > 0").groupBy(*key).agg(F.min("doc").alias("rep"))
    members = materialized(
        signed.join(classes, key, "left").select(
            "doc",
            "n_shingles",
            F.when(F.col("doc").isNotNull(), F.coalesce("rep", "doc")).alias("rep"),
            F.when(F.col("doc") == F.col("rep"), F.col("sig")).alias("sig"),
        ),
        "classes",
    )
    # A repeated row is one row here: else n copies of two near texts would meet n * n times.
    reps = members.filter("sig is not null").select("doc", "sig").distinct()
    prefixes = materialized(_prefixes(reps, rule), "prefixes")
    texts = materialized(
        source.join(prefixes.select("doc").distinct(), "doc", "left_semi")
        .withColumn("same", F.xxhash64("text"))
        .dropDuplicates(["doc", "same"])
        .drop("same"),
        "candidate-texts",
    )
    sigs = reps.join(prefixes.select("doc").distinct(), "doc", "left_semi")

    def confirmed(pairs: DataFrame) -> DataFrame:
        near = (
            pairs.join(sigs.select(F.col("doc").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sigs.select(F.col("doc").alias("b"), F.col("sig").alias("sb")), "b")
            .filter(_agreeing(F.col("sa"), F.col("sb")) >= rule.matches)
            .select("a", "b")
        )
        return (
            near.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b")
            .select("a", "b", "ta", "tb")
            .mapInArrow(_confirmer(rule), "a long, b long")
        )

    def centre_of(lists: DataFrame, *more: Column) -> DataFrame:
        heaviest = F.max(F.struct("weight", (-F.col("doc")).alias("doc"), *more)).alias("m")
        return lists.groupBy("token").agg(heaviest, F.count(F.lit(1)).alias("n")).filter("n > 1")

    # First every class meets one centre, the heaviest of its lists ...
    centres = centre_of(prefixes).select("token", F.col("m.weight").alias("w"), F.col("m.doc").alias("a"))
    met = (
        prefixes.join(centres, "token")
        .groupBy("doc")
        .agg(F.max(F.struct("w", "a")).alias("m"))
        .select((-F.col("m.a")).alias("a"), F.col("doc").alias("b"))
        .filter("a <> b")
    )
    links = materialized(confirmed(met), "links")
    comp = F.coalesce("component", "doc").alias("comp")

    def placed_by(parts: DataFrame) -> DataFrame:
        return prefixes.join(parts.withColumnRenamed("node", "doc"), "doc", "left").select("token", "doc", "weight", comp)

    # ... then, in lists that still hold several groups, the others meet the list's centre ...
    placed = placed_by(
        links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
            links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
        ).groupBy("node").agg(F.min("component").alias("component"))
    )
    centres = centre_of(placed, F.col("comp")).select(
        "token", (-F.col("m.doc")).alias("a"), F.col("m.comp").alias("centre_comp")
    )
    starred = (
        placed.join(centres, "token")
        .filter("comp <> centre_comp")
        .select("a", F.col("doc").alias("b"))
        .distinct()
    )
    links = materialized(links.unionByName(confirmed(starred)), "links")
    first = components(links)

    # ... and what remains is compared between components in blocks.
    placed = placed_by(first)
    open_lists = (
        placed.groupBy("token")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"))
        .filter("lo < hi")
        .select("token", _blocks(F.col("n"), LIST_BLOCK).alias("nb"))
    )
    blocked = (
        placed.join(open_lists, "token")
        .join(sigs, "doc")
        .withColumn("block", F.pmod(F.hash("doc"), F.col("nb")))
        .withColumn("p", F.explode(_pairs_of_blocks(F.col("block"), F.col("nb"))))
        .select("token", "p.i", "p.j", "doc", "comp", "block", "sig")
    )
    candidates = gathered(blocked, ["token", "i", "j"]).mapInArrow(_list_merger(rule), "a long, b long").distinct()
    groups = components(candidates).select(F.col("node").alias("doc"), F.col("component").alias("g"))
    grouped = groups.join(first.withColumnRenamed("node", "doc"), "doc", "left").select("g", "doc", comp)
    sizes = grouped.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("n"))
    mains = sizes.groupBy("g").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("total")).select(
        "g",
        F.col("m.comp").alias("main"),
        _blocks(F.col("m.n"), GROUP_BLOCK).alias("n_main"),
        _blocks(F.col("total") - F.col("m.n"), GROUP_BLOCK).alias("n_other"),
    )
    own = F.pmod(F.hash("doc"), F.when(F.col("comp") == F.col("main"), F.col("n_main")).otherwise(F.col("n_other")))
    within = F.transform(
        _pairs_of_blocks(F.col("side"), F.col("n_other")),
        lambda p: F.struct(F.lit(0).alias("kind"), p["i"].alias("i"), p["j"].alias("j")),
    )
    to_main = F.transform(
        F.sequence(F.lit(0), F.col("n_main") - 1),
        lambda x: F.struct(F.lit(1).alias("kind"), F.col("side").alias("i"), x.alias("j")),
    )
    from_main = F.transform(
        F.sequence(F.lit(0), F.col("n_other") - 1),
        lambda x: F.struct(F.lit(1).alias("kind"), x.alias("i"), F.col("side").alias("j")),
    )
    tasks = (
        grouped.join(mains, "g")
        .withColumn("side", own)
        .withColumn(
            "p",
            F.explode(F.when(F.col("comp") == F.col("main"), from_main).otherwise(F.concat(within, to_main))),
        )
        .join(sigs, "doc")
        .join(texts, "doc")
        .select(
            "g",
            "p.*",
            "doc",
            "comp",
            # In a block against the main component the sides are its members and the others.
            F.when(F.col("p.kind") == 1, (F.col("comp") == F.col("main")).cast("int"))
            .otherwise(F.col("side"))
            .alias("side"),
            ((F.col("p.kind") == 1) | (F.col("p.i") != F.col("p.j"))).alias("apart"),
            "sig",
            "text",
        )
    )
    late = gathered(tasks, ["g", "kind", "i", "j"]).mapInArrow(_group_confirmer(rule), "a long, b long")
    links = first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(late)
    final = components(links).withColumnRenamed("node", "rep")
    component = F.coalesce("component", "rep")
    return members.join(final, "rep", "left").select(
        F.col("doc").alias("doc_id"),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"),
    )
