"""Shard placement by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARDS = 64
#: A prime above 100 slots a shard keeps the shards' shares within one percent of each other.
TABLE_SIZE = 6553


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], table_size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index in `shards`.

    Each shard prefers slots in the order offset, offset + skip, ... modulo the prime size,
    both hashed from its name. Shards take turns; each claims its first slot still free.
    Adding or losing a shard moves few slots besides that shard's own.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct and not empty")
    if table_size < len(shards) or any(table_size % d == 0 for d in range(2, int(table_size**0.5) + 1)):
        raise ValueError("table_size must be a prime of at least the number of shards")
    at = [_number(f"{name}|offset") % table_size for name in shards]
    skip = [_number(f"{name}|skip") % (table_size - 1) + 1 for name in shards]
    owner = [-1] * table_size
    for turn in range(table_size):
        k = turn % len(shards)
        while owner[at[k]] >= 0:
            at[k] = (at[k] + skip[k]) % table_size
        owner[at[k]] = k
    return owner


def place(
    df: DataFrame, key: list[str], shards: list[str] | None = None, table_size: int = TABLE_SIZE
) -> DataFrame:
    """Adds `slot` and `shard` (a name) to every row, by the md5 of its key columns.

    The table has `table_size` rows whatever the input, so it is broadcast and placement is
    one hash and one probe without any shuffle. A null key part counts as the text '\\N'; an
    empty text is a key of its own; equal keys share a shard. Columns named slot or shard
    raise. An empty input gives an empty result.
    """
    shards = shards or [f"shard-{k:05d}" for k in range(SHARDS)]
    if {"slot", "shard"} & {c.lower() for c in df.columns}:
        raise ValueError("the input already has a column slot or shard")
    owners = ",".join(shards[k].replace(",", "") for k in lookup_table(shards, table_size))
    table = df.sparkSession.range(1).select(
        F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "shard")
    )
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c in key]
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")
    placed = df.withColumn("slot", (digest % table_size).cast("int"))
    return placed.join(F.broadcast(table), "slot", "left").select(*df.columns, "slot", "shard")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder for each shard, written by several tasks each so that no shard is one task."""
    spread = F.pmod(F.xxhash64(*[c for c in placed.columns if c != "shard"]), F.lit(8))
    placed.repartition(F.col("shard"), spread).write.partitionBy("shard").parquet(path)


def placement_sql(shards: int = SHARDS, table_size: int = TABLE_SIZE) -> str:
    """The placement of `documents` in DuckDB: the table is filled by a recursive query in
    which a shard's rank for a slot is (slot - offset) / skip modulo the prime."""
    return f"""
WITH RECURSIVE names AS (
  SELECT k, 'shard-' || lpad(k::VARCHAR, 5, '0') AS shard FROM range({shards}) t(k)
), prefs AS (
  SELECT k, shard, ('0x' || substr(md5(shard || '|offset'), 1, 15))::UBIGINT % {table_size} AS o,
         ('0x' || substr(md5(shard || '|skip'), 1, 15))::UBIGINT % {table_size - 1} + 1 AS s FROM names
), orders AS MATERIALIZED (
  SELECT k, list(((o + j * s) % {table_size})::INTEGER ORDER BY j) AS slots
  FROM prefs, range({table_size}) r(j) GROUP BY k
), filled AS (
  SELECT 0 AS turn, -1 AS slot, list_resize([]::BOOLEAN[], {table_size}, true) AS free
  UNION ALL
  SELECT turn + 1, c, list_transform(free, lambda v, i: v AND i <> c + 1) FROM (
    SELECT turn, free, list_filter(slots, lambda x: free[x + 1])[1] AS c
    FROM filled JOIN orders ON orders.k = turn % {shards}
    WHERE turn < {table_size}
  )
), owners AS (SELECT slot, (turn - 1) % {shards} AS k FROM filled WHERE slot >= 0)
SELECT doc_id, o.slot::INTEGER AS slot, n.shard
FROM documents d
JOIN owners o ON o.slot = ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '\\N')), 1, 15))::UBIGINT % {table_size}
JOIN names n ON n.k = o.k
"""
