"""The distance against the SQL answers' own, bit by bit: scores that are nearly equal are ordered
by the last bits."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from millrace.functions import registry
from millrace.plans.oracle_base import _chord_km


def test_distance_has_the_bits_of_the_sql(spark, tmp_path):
    n = 1 + F.col("id") % 37
    places = spark.range(4000).select(
        n.alias("u_cum_geo_n"),
        (n * 398000000 + (F.col("id") % 997 * 40000 * n / 99).cast("long")).alias("u_cum_lat_e7"),
        (n * -753000000 + (F.col("id") % 991 * 3571 * n / 13).cast("long")).alias("u_cum_lng_e7"),
        (39.8 + (F.col("id") * 7 % 97) * 0.004).alias("b_latitude"),
        (-75.3 + (F.col("id") * 3 % 89) * 0.004).alias("b_longitude"),
    )
    path = str(tmp_path / "places")
    places.withColumn("km", registry.get("ui_distance_km").build()).write.parquet(path)
    mean = [f"u_cum_{axis}_e7 / u_cum_geo_n / 10000000.0::DOUBLE" for axis in ("lat", "lng")]
    expected = _chord_km(*mean, "b_latitude", "b_longitude")
    ((rows, same, gap),) = duckdb.sql(
        f"SELECT count(*), count(*) FILTER (km = k), max(abs(km - k)) "
        f"FROM (SELECT km, {expected} AS k FROM '{path}/*.parquet')"
    ).fetchall()
    # Sines of the two engines differ in the last bit now and then.
    assert rows == 4000 and same > 0.9 * rows and gap < 1e-11


def test_distance_of_one_place_of_opposite_ones_and_of_none(spark):
    row = "u_cum_lat_e7 long, u_cum_lng_e7 long, u_cum_geo_n long, b_latitude double, b_longitude double"
    asked = [(400000000, -750000000, 1, 40.0, -75.0), (411111111, 123456789, 1, -41.1111111, -167.6543211), (None, None, 0, 1.0, 2.0)]
    same, opposite, none = (
        r[0] for r in spark.createDataFrame(asked, row).select(registry.get("ui_distance_km").build()).collect()
    )
    assert same == 0 and abs(opposite - 20015.086796) < 1e-3 and none is None
