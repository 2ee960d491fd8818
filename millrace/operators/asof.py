"""The strict as-of join, the only one in the package.

Each query gets, from every state group of a key, the latest row of its key strictly before its
instant. The queries and the states of all groups go through one exchange as tagged rows, dealt
by ranges of (key, instant), and one sorted sweep of each range carries every group's last row on
to the queries after it. A range that begins inside a key's history takes over what the ranges
before it have left: one row for each range, so that table is as small as the number of tasks.
Ranges have about equal numbers of rows whatever the keys, so no key is treated apart.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from millrace.operators.popularity import instant
from millrace.session import materialized

# Workers get the sweep by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TAG, _RANGE, _FIRST, _LEFT = "__tag", "__range", "__first", "__left"


def _changes(columns: list[pa.Array], before: list[pa.Scalar] | None) -> np.ndarray:
    """Whether each row has another key than the row before it (or, for the first, than `before`)."""
    n = len(columns[0])
    out = np.zeros(n, dtype=bool)
    for k, column in enumerate(columns):
        differs = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, n - 1)), True)  # a NULL key has no state
        out[1:] |= differs.to_numpy(zero_copy_only=False)
        out[0] |= before is None or before[k].as_py() != column[0].as_py()
    return out


def _sweep(keys: int, groups: int):
    """Rows (keys, ts, tag, groups..., rest...) sorted by key, ts and tag; tag 0 is a query, k the
    k-th group's state. Queries come out with the groups' last rows; the last row of the output
    is what the range leaves to the next one: its last key, its first key and the last rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        at = keys + 2  # where the groups begin
        kept: list[pa.Array | None] = [None] * groups
        first = last = schema = None
        in_first = True
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            key_columns = [batch.column(k) for k in range(keys)]
            new = _changes(key_columns, last)
            later = np.flatnonzero(new)
            if first is None:
                first, schema = [c[0] for c in key_columns], batch.schema
                later = later[1:]
            row = np.arange(n)
            start = np.maximum.accumulate(np.where(new, row, 0))
            going_on = (start == 0) & (not new[0])  # rows of the key that the last batch ended with
            first_rows = np.zeros(n, dtype=bool)
            if in_first:
                end = int(later[0]) if len(later) else n
                first_rows[:end] = True
                in_first = end == n
            tag = batch.column(keys + 1).to_numpy(zero_copy_only=False)
            asked = np.flatnonzero(tag == 0)
            found = []
            for g in range(groups):
                column = batch.column(at + g)
                seen = np.maximum.accumulate(np.where(tag == g + 1, row, -1))
                known = seen >= start
                if kept[g] is None:
                    source, index = column, np.where(known, seen, -1)
                else:
                    source = pa.concat_arrays([kept[g], column])
                    index = np.where(known, seen + 1, np.where(going_on, 0, -1))
                picked = index[asked]
                found.append(source.take(pa.array(picked, mask=picked < 0)))
                if known[-1]:
                    kept[g] = column.slice(int(seen[-1]), 1)
                elif not going_on[-1]:
                    kept[g] = None
            last = [c[n - 1] for c in key_columns]
            if len(asked):
                rows = batch.take(pa.array(asked))
                yield _out(rows, keys, groups, found, number, first_rows[asked], False)
        if first is not None:
            blank = [pa.nulls(1, f.type) for f in schema]
            for k in range(keys):
                blank[k] = pa.array([last[k].as_py()], schema.field(k).type)
            row = pa.RecordBatch.from_arrays(blank, schema=pa.schema([f.with_nullable(True) for f in schema]))
            left = [pa.nulls(1, schema.field(at + g).type) if kept[g] is None else kept[g] for g in range(groups)]
            begins = [pa.array([first[k].as_py()], schema.field(k).type) for k in range(keys)]
            yield _out(row, keys, groups, left, number, np.zeros(1, dtype=bool), True, begins)

    return task


def _out(rows, keys, groups, found, number, first, left, begins=None) -> pa.RecordBatch:
    n = rows.num_rows
    columns = [rows.column(k) for k in range(keys + 1)] + found + rows.columns[keys + 2 + groups :]
    columns += [pa.array(np.full(n, number, dtype=np.int32)), pa.array(first), pa.array(np.full(n, left))]
    columns += begins or [pa.nulls(n, rows.schema.field(k).type) for k in range(keys)]
    fields = rows.schema
    names = [fields.field(k).name for k in range(keys + 1)]
    names += [fields.field(keys + 2 + g).name for g in range(groups)]
    names += [fields.field(k).name for k in range(keys + 2 + groups, len(fields))]
    names += [_RANGE, _FIRST, _LEFT, *[f"__first_{k}" for k in range(keys)]]
    return pa.RecordBatch.from_arrays(columns, names=names)


def asof_sweep(queries: DataFrame, keys: Sequence[str], groups: Mapping[str, DataFrame]) -> DataFrame:
    """queries (keys, ts, ...) plus one column for each group (keys, ts, values...): a struct
    (ts, values...) of the key's last state before the query's instant, NULL without one.

    A NULL key or instant has no state. The result is read from a table in the shared folder.
    """
    keys = list(keys)
    rest = [c for c in queries.columns if c not in (*keys, "ts")]
    if clash := set(groups) & set(queries.columns):
        raise ValueError(f"the queries already have columns {sorted(clash)}")
    tagged = queries.withColumn(_TAG, F.lit(0))
    for tag, (name, state) in enumerate(groups.items(), 1):
        values = [c for c in state.columns if c not in keys]
        tagged = tagged.unionByName(
            state.filter(" and ".join(f"`{k}` is not null" for k in [*keys, "ts"])).select(
                *keys, "ts", F.struct(*values).alias(name), F.lit(tag).alias(_TAG)
            ),
            allowMissingColumns=True,
        )
    tagged = tagged.select(*keys, "ts", _TAG, *groups, *rest)
    # At one instant the query sorts before the states: the bound is strict. Equal queries are
    # told apart by a hash, so that a range may end between them.
    tie = F.xxhash64(*[F.col(c) for c in rest if not _nested(tagged, c)]) if rest else F.lit(0)
    order = [*keys, "ts", _TAG]
    width = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = tagged.repartitionByRange(width, *order, tie).sortWithinPartitions(*order)
    fields = {f.name: StructField(f.name, f.dataType, True) for f in tagged.schema.fields}
    schema = StructType(
        [fields[c] for c in (*keys, "ts", *groups, *rest)]
        + [StructField(_RANGE, IntegerType()), StructField(_FIRST, BooleanType()), StructField(_LEFT, BooleanType())]
        + [StructField(f"__first_{k}", fields[key].dataType) for k, key in enumerate(keys)]
    )
    swept = materialized(ranges.mapInArrow(_sweep(len(keys), len(groups)), schema), "asof")

    # What a range's first key inherits: the last rows that earlier ranges left for that key.
    left = swept.filter(_LEFT)
    gives = left.select(*keys, _RANGE, F.lit(True).alias("__gives"), *groups)
    takes = left.select(
        *[F.col(f"__first_{k}").alias(key) for k, key in enumerate(keys)], _RANGE, F.lit(False).alias("__gives")
    )
    earlier = W.partitionBy(*keys).orderBy(_RANGE, "__gives").rowsBetween(W.unboundedPreceding, -1)
    inherited = (
        gives.unionByName(takes, allowMissingColumns=True)
        .withColumns({g: F.last(g, ignorenulls=True).over(earlier) for g in groups})
        .filter("not __gives")
        .select(_RANGE, *[F.col(g).alias(f"__from_{g}") for g in groups])
    )
    valid = F.lit(True)
    for c in (*keys, "ts"):
        valid = valid & F.col(c).isNotNull()
    return (
        swept.filter(f"not {_LEFT}")
        .join(F.broadcast(inherited), _RANGE, "left")  # one row for each range
        .select(
            *queries.columns,
            *[
                F.when(valid, F.coalesce(g, F.when(F.col(_FIRST), F.col(f"__from_{g}")))).alias(g)
                for g in groups
            ],
        )
    )


def _nested(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("map", "variant")


def asof_times(probes: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ts, state_ts) for every distinct probe; state_ts is NULL without history."""
    keys = list(keys)
    found = asof_sweep(probes.select(*keys, "ts").distinct(), keys, {"__state": state.select(*keys, "ts")})
    return found.select(*keys, "ts", F.col("__state.ts").alias("state_ts"))


def asof_join(
    queries: DataFrame, state: DataFrame, keys: Sequence[str], values: Sequence[str], how: str = "left"
) -> DataFrame:
    """queries plus state_ts and the values of their as-of state; `inner` drops those without."""
    keys = list(keys)
    found = asof_sweep(queries, keys, {"__state": state.select(*keys, "ts", *values)})
    if how == "inner":
        found = found.filter(F.col("__state").isNotNull())
    return found.select(
        *queries.columns, F.col("__state.ts").alias("state_ts"), *[F.col(f"__state.{v}").alias(v) for v in values]
    )


def latest_state(
    state: DataFrame, keys: Sequence[str], at: datetime | None = None
) -> DataFrame:
    """The last row per key, strictly before `at` when given.

    One instant shared by all probes needs no as-of join. The row-number bound is pushed
    below the exchange, so each task sends at most one row per key.
    """
    if at is not None:
        state = state.filter(F.col("ts") < instant(at))
    newest = W.partitionBy(*keys).orderBy(F.desc("ts"))
    return (
        state.withColumn("_n", F.row_number().over(newest))
        .filter(F.col("_n") == 1)
        .drop("_n")
    )
