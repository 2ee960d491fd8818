"""Positions and running sums in a global order, by range partition.

`row_number()` over an unpartitioned window pulls every row into one task. Here the rows are
range partitioned by the full order, each partition is sorted and numbers its own rows, and the
partitions' offsets - one row for each partition - are added. The order must be total up to rows
that are equal in every column that matters: then a retried task numbers its rows the same way.
Partition numbers are used only after they have been written, so a later loss cannot change them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.session import materialized

#: monotonically_increasing_id() holds the partition above this many bits, the row's number below.
_ROW_BITS = 33
_AT, _PART = "__at", "__part"


def in_order(
    df: DataFrame, order: Sequence[Column], name: str = "rank", totals: Mapping[str, str] | None = None
) -> DataFrame:
    """df plus its 1-based dense position in `order`, and for every output in `totals` the running
    sum of the named column up to and with the row (null counts as 0).

    One exchange for positions; running sums add one, by partition number. The result is read from
    a table in the shared folder. Columns that would clash raise.
    """
    totals = dict(totals or {})
    taken = {c.lower() for c in df.columns}
    if clash := taken & {name.lower(), _AT, _PART, *(c.lower() for c in totals)}:
        raise ValueError(f"the input already has columns {sorted(clash)}")
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = materialized(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn(_AT, F.monotonically_increasing_id()),
        "order",
    ).withColumn(_PART, F.shiftright(_AT, _ROW_BITS))
    sizes = placed.groupBy(_PART).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(src).alias(f"__sum_{out}") for out, src in totals.items()]
    )
    # One row for each partition: as long as the number of partitions, never as the data.
    before = W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        _PART,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"),
        *[F.coalesce(F.sum(f"__sum_{out}").over(before), F.lit(0)).alias(f"__from_{out}") for out in totals],
    )
    upto = W.partitionBy(_PART).orderBy(_AT).rowsBetween(W.unboundedPreceding, 0)
    local = placed.withColumns({f"__upto_{out}": F.coalesce(F.sum(src).over(upto), F.lit(0)) for out, src in totals.items()})
    row = F.col(_AT).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return local.join(F.broadcast(offsets), _PART).select(
        *df.columns,
        (F.col("__first") + row + 1).alias(name),
        *[(F.col(f"__from_{out}") + F.col(f"__upto_{out}")).alias(out) for out in totals],
    )
