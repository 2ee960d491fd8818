"""Ingest, dimension, popularity, timelines and global positions."""

from __future__ import annotations

import json
import random
from datetime import datetime
from itertools import accumulate

import pytest
from conftest import make_dim, make_events, rows
from pyspark.sql import functions as F

from millrace.functions import order
from millrace.functions.order import in_order
from millrace.operators import ingest, popularity, state
from millrace.operators.asof import latest_state
from millrace.schema import DIM_COLUMNS
from millrace.session import materialized
from millrace.sources import raw


def write_lines(path, records):
    path.write_text("\n".join(json.dumps(r) for r in records))
    return str(path)


# One review in the wanted metro in each of two years, one elsewhere, one of an unknown place.
REVIEWS = [
    {"user_id": "kim", "business_id": "lake", "stars": 2.0, "date": "2014-11-30 23:59:59", "text": "x"},
    {"user_id": "lou", "business_id": "hill", "stars": 5.0, "date": "2016-02-29 00:00:00"},
    {"user_id": "kim", "business_id": "port", "stars": 1.0, "date": "2015-07-07 07:07:07"},
    {"user_id": "lou", "business_id": "lost", "stars": 3.0, "date": "2015-08-08 08:08:08"},
]


def place(i, city="Tampa", state="FL", **extra):
    base = {"business_id": i, "name": i.title(), "city": city, "state": state}
    return {**base, "latitude": 27.9, "longitude": -82.5, "is_open": 1, **extra}


def test_ingest_keeps_the_metro_and_is_idempotent(spark, tmp_path):
    reviews = raw.read_reviews(spark, write_lines(tmp_path / "r.json", REVIEWS))
    places = [place("lake"), place("hill", " Tampa "), place("port", "Portland", "OR")]
    businesses = raw.read_businesses(spark, write_lines(tmp_path / "b.json", places))
    events = ingest.ingest_events(reviews, businesses, "Tampa", "FL")
    target = str(tmp_path / "events")
    ingest.write_events(events, target)
    first = rows(spark.read.parquet(target))
    ingest.write_events(events, target)
    assert rows(spark.read.parquet(target)) == first
    assert [(r[0], r[1]) for r in first] == [("kim", "lake"), ("lou", "hill")]
    assert sorted(p.name for p in (tmp_path / "events").glob("year=*")) == ["year=2014", "year=2016"]
    past = raw.read_events(spark, target, datetime(2016, 1, 1))
    assert past.count() == 1
    assert "PartitionFilters: [isnotnull(year" in past._jdf.queryExecution().toString()


def test_dimension_parses_every_variant(spark, tmp_path):
    price = "RestaurantsPriceRange2"  # fixed value: the attribute's name in the raw records
    places = [
        place("p1", categories=" Bakery,Cafe ,  Brunch", attributes={price: "1"}),
        place("p2", categories="Gym", attributes={price: "None"}, is_open=0),
        place("p3", categories="Books & Maps", attributes=None),
        place("p4", categories="Florist", attributes={price: "5"}),
        place("p5", categories=None, attributes={price: "3"}),
        place("p6", city="Orlando", attributes={price: "2"}),
        place("p7", categories="Jazz", attributes={"Parking": "u'street'", price: "4"}),
        place("p8", categories=" , ", attributes={price: "0"}),
    ]
    source = raw.read_businesses(spark, write_lines(tmp_path / "b.json", places))
    dim = ingest.build_dim(source, "Tampa", "FL")
    assert tuple(dim.columns) == DIM_COLUMNS
    got = {r.business_id: (r.categories, r.price_tier, r.is_open) for r in dim.collect()}
    assert got == {
        "p1": (["Bakery", "Cafe", "Brunch"], 1, True),
        "p2": (["Gym"], None, False),
        "p3": (["Books & Maps"], None, True),
        "p4": (["Florist"], None, True),
        "p5": ([], 3, True),
        "p7": (["Jazz"], 4, True),
        "p8": ([], None, True),
    }


def test_popularity_is_right_exclusive_and_covers_the_catalog(spark):
    events = make_events(
        spark,
        [("u1", "b2", "2018-05-01", 5), ("u2", "b2", "2018-06-01", 5), ("u1", "b9", "2018-06-01", 5),
         ("u1", "b1", "2019-01-01", 5), ("u1", "b3", "2018-12-31 23:59:59", 5)],
    )
    dim = make_dim(spark, [(b, 1.0, 1.0, None, []) for b in ("b1", "b2", "b3")])
    ranked = popularity.popularity_rank(events, dim, datetime(2019, 1, 1))
    assert rows(ranked, "rank", "business_id", "pre_t_reviews") == [
        (1, "b2", 2), (2, "b3", 1), (3, "b1", 0)]
    pool = popularity.popularity_pool(events, datetime(2019, 1, 1), 2)
    assert rows(pool, "pool_rank", "business_id") == [(1, "b2"), (2, "b3")]


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_positions_equal_a_full_sort(spark, ranges):
    """With 60 ranges some are empty; ties in all but the last key are many."""
    rng = random.Random(3)
    data = [(f"u{rng.randrange(40)}" if i % 9 else None, rng.randrange(4) if i % 5 else None, i) for i in range(600)]
    df = spark.createDataFrame(data, "id string, n int, x int").repartition(5)
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = in_order(df, [F.desc("n"), F.asc("id"), F.asc("x")], "rank", {"so_far": "n"}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    wanted = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0] is not None, r[0] or "", r[2]))
    assert {r.x: r["rank"] for r in got} == {r[2]: i for i, r in enumerate(wanted, 1)}
    totals = {r[2]: t for r, t in zip(wanted, accumulate(r[1] or 0 for r in wanted))}
    assert {r.x: r.so_far for r in got} == totals


def test_positions_of_ids_with_a_common_prefix_are_spread(spark, monkeypatch):
    written = []
    monkeypatch.setattr(order, "materialized", lambda df, name: written.append(materialized(df, name)) or written[-1])
    ids = spark.range(100_000).select(F.concat(F.lit("x" * 20), F.col("id").cast("string")).alias("id"))
    ranked = in_order(ids, [F.asc("id")])
    held = written[0].groupBy("_metadata.file_path").count().collect()  # a file for each range
    assert len(held) == 4 and max(r["count"] for r in held) < 40_000
    assert ranked.agg(F.count_distinct("rank"), F.min("rank"), F.max("rank")).first()[:] == (100_000, 1, 100_000)
    assert in_order(ids.filter("false"), [F.asc("id")]).count() == 0
    with pytest.raises(ValueError):
        in_order(ids, [F.asc("id")], "ID")


def random_events(spark, n=800, users=12, items=15, seed=5):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        # One user and one item hold about a third of all rows.
        user = "u0" if rng.random() < 0.34 else f"u{rng.randrange(users)}"
        item = "b0" if rng.random() < 0.34 else f"b{rng.randrange(items)}"
        day = f"20{rng.randrange(15, 19)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"
        out.append((user, item, f"{day} {rng.randrange(24):02d}:00:00", rng.randrange(1, 6)))
    return make_events(spark, out)


def random_dim(spark, items=15):
    return make_dim(
        spark,
        [(f"b{i}", 39.0 + i / 10, -75.0 - i / 10, (i % 4 + 1) if i % 5 else None,
          [["Food", "Bars", "Art"][i % 3], f"c{i % 2}"] if i else []) for i in range(items)],
    )


@pytest.mark.parametrize("grain", ["month", "day"])
def test_hot_timelines_equal_plain_ones(spark, grain):
    events, dim = random_events(spark), random_dim(spark)
    for build in (
        lambda **kw: state.user_state(events, dim, **kw),
        lambda **kw: state.item_state(events, **kw),
        lambda **kw: state.user_category_state(events, dim, **kw),
    ):
        plain = build()
        for limit in (0, 150):  # every entity hot, and only the heavy ones
            split = build(grain=grain, hot_rows=limit)
            assert rows(split.select(*plain.columns)) == rows(plain)


def test_totals_equal_the_last_state_row(spark):
    events, dim = random_events(spark), random_dim(spark)
    at = datetime(2017, 6, 15, 12)
    past = popularity.before(events, at)
    for keys, timeline, totals in (
        (["user_id"], state.user_state(events, dim), state.user_totals(past, dim)),
        (["business_id"], state.item_state(events), state.item_totals(past)),
        (["user_id", "category"], state.user_category_state(events, dim),
         state.user_category_totals(past, dim)),
    ):
        last = latest_state(timeline, keys, at)
        assert rows(totals.select(*last.columns)) == rows(last)


def test_materialised_state_is_reproducible(spark, tmp_path):
    events, dim = random_events(spark), random_dim(spark)
    states = {"user": state.user_state(events, dim), "item": state.item_state(events)}
    first = rows(state.write_states(states, str(tmp_path / "a")))
    events = events.repartition(5)
    again = {"user": state.user_state(events, dim), "item": state.item_state(events)}
    assert rows(state.write_states(again, str(tmp_path / "b"))) == first
    for group in states:
        left, right = (rows(spark.read.parquet(str(tmp_path / d / group))) for d in "ab")
        assert left == right
