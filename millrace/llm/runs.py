"""Groups of a sorted partition inside mapInArrow, without one Python call's overhead per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(batch, run starts with the end appended): every run of equal keys lies in one batch.

    The partition must be sorted by the keys (not null) and groups must be bounded.
    """
    carried = None
    for batch in batches:
        if carried is not None and carried.num_rows:
            batch = pa.concat_batches([carried, batch])
        if batch.num_rows == 0:
            continue
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for name in keys:
            column = batch.column(name)
            change |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        last = int(starts[-1])
        carried = batch.slice(last)
        if last:
            yield batch.slice(0, last), starts
    if carried is not None and carried.num_rows:
        yield carried, np.array([0, carried.num_rows])


def gathered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one key in one partition and next to each other."""
    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
