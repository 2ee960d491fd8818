"""Mixing sources to target weights by systematic sampling, as DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.order import in_order

WORD = r"[^\x20\x09-\x0D]+"
#: Offsets are multiples of 1 / OFFSETS.
OFFSETS = 1 << 20


@dataclass(frozen=True)
class Mix:
    """`weights` are dealt to the sources in turn; the sources share `share` of all sizes by weight,
    and none is given more than `most` times its own size."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: Fraction = Fraction(3, 2)
    most: int = 2
    seed: int = 42


def _whole(x: int) -> Column:
    return F.lit(Decimal(x)).cast("decimal(38,0)")


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(19,0)")


def source_targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """Rows (source, source_size, ...) plus `target`, also as an exact fraction `__num` / `__den`.

    Weights go round the sources in code point order, null last. The targets are those of
    resharing until none is above its stop: in the order of stop / weight, a source is stopped
    while its part of what is left by its weight reaches its stop; the others share the rest.
    Both orders are range partitioned with running sums; the driver sees two rows of totals.
    """
    p, q = mix.share.numerator, mix.share.denominator
    unit = lcm(*mix.weights)
    weights = F.array(*[F.lit(w).cast("long") for w in mix.weights])
    turn = ((F.col("__turn") - 1) % len(mix.weights) + 1).cast("int")
    dealt = in_order(sources, [F.col("source").asc_nulls_last()], "__turn").select(
        *sources.columns,
        F.element_at(weights, turn).alias("__weight"),
        (F.col("source_size") * mix.most).alias("__stop"),
        (F.col("source_size") * mix.most * (F.lit(unit) / F.element_at(weights, turn)).cast("long")).alias("__ratio"),
    )
    order = [F.col("__ratio").asc(), F.col("source").asc_nulls_last()]
    ranked = in_order(dealt, order, "__rank", {"__stops": "__stop", "__weights": "__weight"})
    total = ranked.agg(F.sum("source_size").alias("size"), F.sum("__weight").alias("weight")).first()
    size, weight = int(total["size"] or 0), int(total["weight"] or 0)
    left = _whole(p * size) - _whole(q) * (_exact("__stops") - _exact("__stop"))
    weight_left = F.lit(weight) - F.col("__weights") + F.col("__weight")
    stopped = ranked.withColumn(
        "__stopped", _exact("__stop") * q * weight_left.cast("decimal(19,0)") <= _exact("__weight") * left
    )
    rest = stopped.agg(
        F.sum(F.when(F.col("__stopped"), F.col("__stop"))).alias("stops"),
        F.sum(F.when(~F.col("__stopped"), F.col("__weight"))).alias("weights"),
    ).first()
    free = p * size - q * int(rest["stops"] or 0)
    by_weight = q * int(rest["weights"] or 0)
    return stopped.select(
        *sources.columns,
        F.when(F.col("__stopped"), _exact("__stop")).otherwise(_exact("__weight") * _whole(free)).cast("decimal(38,0)").alias("__num"),
        F.when(F.col("__stopped"), _whole(1)).otherwise(_whole(max(by_weight, 1))).alias("__den"),
    ).withColumn("target", F.col("__num").cast("double") / F.col("__den").cast("double"))


def mix_sources(docs: DataFrame, mix: Mix = Mix(), keep: Sequence[str] | None = None) -> DataFrame:
    """Rows of `docs` (doc_id, source, text) with size, source_size, target, copies and taken.

    `size` is the number of words; a null text has none. Every document of a source is expected
    target / source_size times. The prefix sum of that within the source, in the order of falling
    size (then id and text), plus one offset hashed from the seed and the source, gives `copies`:
    the integer boundaries that the document crosses, reckoned in whole numbers. As sizes fall
    along the order, the words a source takes differ from its target by no more than its largest
    document. `taken` is copies times size; no document is taken more than `most` times. Reruns agree.

    A null source is a source of its own, after all others. A source without any word has target 0
    and takes nothing. Repeated rows count as rows. An empty input gives an empty result. Columns
    of `keep` (all by default) that clash with the new names raise.

    A source's rows are spread by their range, so a source with most rows is many tasks: positions
    come from one range partition, and a position within a source from the source's first one.
    """
    keep = list(docs.columns if keep is None else keep)
    new = {"size", "source_size", "target", "copies", "taken"}
    if clash := new & {c.lower() for c in keep}:
        raise ValueError(f"the input already has columns {sorted(clash)}")
    sized = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col("source").alias("__source"),
        F.col("doc_id").alias("__id"),
        F.xxhash64("text").alias("__text"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    order = [F.col("__source").asc_nulls_last(), F.col("size").desc(), F.col("__id"), F.col("__text")]
    placed = in_order(sized, order, "__position")
    sources = placed.groupBy(F.col("__source").alias("source")).agg(
        F.sum("size").alias("source_size"), (F.min("__position") - 1).alias("__before")
    )
    targets = source_targets(sources, mix)
    name = F.concat(F.lit(f"{mix.seed}|"), F.coalesce(F.col("source"), F.lit("\\N")))
    told = targets.select(
        F.col("source").alias("__of"),
        "source_size",
        "target",
        "__before",
        F.conv(F.substring(F.md5(name.cast("binary")), 1, 5), 16, 10).cast("decimal(19,0)").alias("__offset"),
        "__num",
        (F.col("__den") * _exact("source_size")).cast("decimal(38,0)").alias("__den"),
    )

    def crossed(position: Column) -> Column:
        """floor(offset + position * target / source_size)."""
        passed = F.col("__offset") * F.col("__den") + position.cast("decimal(19,0)") * F.col("__num") * OFFSETS
        return F.call_function("div", passed.cast("decimal(38,0)"), (F.col("__den") * OFFSETS).cast("decimal(38,0)"))

    at = F.col("__position") - F.col("__before")
    copies = F.when(F.col("source_size") > 0, crossed(at) - crossed(at - 1)).otherwise(F.lit(0)).cast("long")
    return (
        placed.join(told, F.col("__source").eqNullSafe(F.col("__of")))
        .withColumn("copies", copies)
        .select(
            *[F.col(f"`{c}`") for c in keep],
            "size",
            "source_size",
            "target",
            "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Every row of a mix as often as it is taken, with `copy` from 1; rows taken 0 times go."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


#: The mix of `documents` with the settings of Mix().
MIX_SQL = f"""
WITH sized AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::HUGEINT AS s, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, sum(2 * s) OVER o AS stops, sum(w) OVER o AS weights, sum(s) OVER () AS total, sum(w) OVER () AS all_weights
  FROM sources WINDOW o AS (ORDER BY 2 * s * (6 // w), source NULLS LAST ROWS UNBOUNDED PRECEDING)
), stopped AS (
  SELECT *, 2 * s * 2 * (all_weights - weights + w) <= w * (3 * total - 2 * (stops - 2 * s)) AS full_ FROM ranked
), fractions AS (
  SELECT source, s,
    CASE WHEN full_ THEN 2 * s ELSE w * (3 * total - 2 * coalesce(sum(2 * s) FILTER (full_) OVER (), 0)) END::HUGEINT AS num,
    CASE WHEN full_ THEN 1 ELSE 2 * sum(w) FILTER (NOT full_) OVER () END::HUGEINT AS den,
    ('0x' || substr(md5('42|' || coalesce(source, '\\N')), 1, 5))::HUGEINT AS h
  FROM stopped
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id)::HUGEINT AS i FROM sized
)
SELECT p.doc_id, p.size, f.s::BIGINT AS source_size, f.num::DOUBLE / f.den::DOUBLE AS target,
  (p.size * CASE WHEN f.s = 0 THEN 0 ELSE
    (h * den * s + i * num * {OFFSETS}) // (den * s * {OFFSETS}) - (h * den * s + (i - 1) * num * {OFFSETS}) // (den * s * {OFFSETS})
  END)::BIGINT AS taken
FROM placed p JOIN fractions f ON p.source IS NOT DISTINCT FROM f.source
"""
