"""Column sets and the fixed settings every job shares."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import types as T

REVIEW = "review"

# They decide the results and must not drift.
POOL_SIZE = 500  # candidates retrieval hands to the ranker
NEGATIVES = 4  # sampled negatives per positive
ATTEMPTS_PER_NEGATIVE = 20
SAMPLING_SEED = 20260722
CATEGORY_CAP = 2
GEO_SCALE = 10_000_000
EARTH_RADIUS_KM = 6371.0
VECTOR_WIDTH = 64
TOP_K = 10

# The driver's tables run 1995-2001; the frozen split sits in their last quarter and
# validation is the year before it.
SPLIT_T = datetime(2000, 1, 1)
VALIDATION_START = datetime(1999, 1, 1)
SLICE_YEARS = (1996, 1997, 1998, 1999, 2000, 2001)

RAW_BUSINESS = T.StructType(
    [
        T.StructField("business_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("is_open", T.LongType()),
        T.StructField("categories", T.StringType()),
        # Declared as text, a nested JSON object arrives verbatim; one key is plucked.
        T.StructField("attributes", T.StringType()),
    ]
)

RAW_REVIEW = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("business_id", T.StringType()),
        T.StructField("stars", T.DoubleType()),
        T.StructField("date", T.StringType()),
    ]
)

EVENT_COLUMNS = ("user_id", "business_id", "event_type", "ts", "stars", "year")
DIM_COLUMNS = (
    "business_id",
    "name",
    "latitude",
    "longitude",
    "categories",
    "price_tier",
    "is_open",
)
USER_TOTALS = (
    "cum_count",
    "cum_sum",
    "cum_lat_e7",
    "cum_lng_e7",
    "cum_geo_n",
    "cum_price",
    "cum_price_n",
)
ITEM_TOTALS = ("cum_count", "cum_sum")
