"""Averaged rating table and city selection.

``build_ratings`` is the central contract of the library: every model reads
``(user_id, item_id, city, rating)`` with one row per (user, item, city).
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The city terms the rating table is fanned out over.
DEFAULT_CITY_TERMS = ("Vegas", "Phoenix", "Toronto", "Charlotte", "Scottsdale",
                      "Pittsbur", "Montr", "Mesa", "Henderson", "Tempe")


def build_ratings(reviews: DataFrame, users: DataFrame, business: DataFrame,
                  skew_chunk: int | None = None) -> DataFrame:
    """Average the rate of every (user, item, city).

    reviews  (user_key, item_key, rate)   one row per review, repeats allowed
    users    (user_key, user_id)          dimension with the integer user id
    business (item_key, item_id[, city])  dimension with integer id and city

    Inner joins drop reviews whose user or item is unknown.  A NULL city is its
    own group.  Without a ``city`` column in ``business`` the output city is NULL.
    The plan is join-then-aggregate: the aggregate is split into a map-side
    partial sum/count and a final merge, so repeated reviews are combined
    before the shuffle.  Dimension joins are left to Catalyst's size check and
    AQE's skew-join splitting; ``skew_chunk`` salts them explicitly instead
    (hot users / businesses spread over buckets of about ``skew_chunk``
    reviews) at the cost of one key-count pass over the reviews per join.
    """
    from prefmine.operators.skew import salted_join
    if "city" not in business.columns:
        business = business.withColumn("city", F.lit(None).cast("string"))
    if skew_chunk:
        joined = salted_join(salted_join(reviews, users, "user_key", skew_chunk),
                             business, "item_key", skew_chunk)
    else:
        joined = reviews.join(users, "user_key").join(business, "item_key")
    joined = joined.select("user_id", "item_id", "city",
                           F.col("rate").cast("double").alias("rate"))
    return (joined.groupBy("user_id", "item_id", "city")
            .agg(F.avg("rate").alias("rating")))


def city_match(city: Column | str, term: str) -> Column:
    """Case-insensitive substring test used to pick a city's rows."""
    c = F.col(city) if isinstance(city, str) else city
    return F.lower(c).contains(term.lower())


def matching_cities(cities: DataFrame, term: str) -> DataFrame:
    """Distinct city names of a city dimension (``city`` column) that contain ``term``."""
    return cities.select("city").where(city_match("city", term)).distinct()


def city_filter(ratings: DataFrame, term: str, cities: DataFrame | None = None) -> DataFrame:
    """Rows whose city contains ``term`` (any case).  NULL cities never match.

    Given the city dimension (``cities``, e.g. the business table), the substring
    test runs on the dimension alone and the rating table is semi-joined with the
    matching names: Catalyst broadcasts them by their size, and a table stored by
    city (``write_ratings_by_city``) is pruned to their folders at run time.
    """
    if cities is not None:
        return ratings.join(matching_cities(cities, term), "city", "left_semi").select(*ratings.columns)
    return ratings.where(city_match("city", term))


def write_by(df: DataFrame, path: str, key: str, fmt: str = "parquet") -> None:
    """One folder per ``key`` value.  Rows are rebalanced by the key first: adaptive
    execution gives small folders one file and splits large ones by size, instead of
    a file per task and folder."""
    df.hint("rebalance", key).write.mode("overwrite").partitionBy(key).format(fmt).save(path)


def write_ratings_by_city(ratings: DataFrame, path: str) -> None:
    """The rating table stored one folder per city, so city selections read
    only their folders."""
    write_by(ratings, path, "city")


def city_fanout(ratings: DataFrame, terms: Sequence[str] = DEFAULT_CITY_TERMS) -> DataFrame:
    """All city selections in one pass: adds ``city_term``.

    A row appears once per term its city contains, so overlapping terms give
    several rows, exactly as running ``city_filter`` per term and stacking the
    results.  The terms are a short literal array: the fan-out per row is at
    most ``len(terms)`` and no shuffle is needed.
    """
    arr = F.array(*[F.lit(t) for t in terms])
    matched = F.filter(arr, lambda t: F.lower(F.col("city")).contains(F.lower(t)))
    return (ratings.where(F.col("city").isNotNull())
            .select("*", F.explode(matched).alias("city_term")))


def city_counts(ratings: DataFrame, terms: Sequence[str] = DEFAULT_CITY_TERMS) -> DataFrame:
    """Rows per city term (the per-city data size), terms with no rows included."""
    counts = city_fanout(ratings, terms).groupBy("city_term").agg(F.count("*").alias("n_rows"))
    spark = ratings.sparkSession
    all_terms = spark.createDataFrame([(t,) for t in terms], "city_term string")
    return (all_terms.join(counts, "city_term", "left")
            .select("city_term", F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows")))


def write_city_files(ratings: DataFrame, path: str, terms: Sequence[str] = DEFAULT_CITY_TERMS,
                     fmt: str = "parquet") -> None:
    """Write every city selection in one job, one folder per term
    (``path/city_term=<term>``), so readers prune to a city by folder."""
    write_by(city_fanout(ratings, terms), path, "city_term", fmt)


def city_codes(cities: DataFrame) -> DataFrame:
    """(city, city_code): the distinct non-null city names, coded once in name order."""
    from prefmine.operators.indexing import dense_index
    from prefmine.session import materialize
    codes = dense_index(cities.where(F.col("city").isNotNull()), ["city"], "city_code")
    # An int, as folder names are read back: an equal type lets Catalyst prune the folders.
    return materialize(codes.select("city", F.col("city_code").cast("int").alias("city_code")), "city-codes")


def coded_ratings(ratings: DataFrame, codes: DataFrame) -> DataFrame:
    """``ratings`` with the integer ``city_code`` in place of the name (null for a null city or one
    without a code)."""
    return ratings.join(codes, "city", "left").drop("city")


def matching_codes(codes: DataFrame, terms: Sequence[str] = DEFAULT_CITY_TERMS) -> DataFrame:
    """(city_code, city, city_term): all terms matched against the dictionary in one pass."""
    some = functools.reduce(lambda a, b: a | b, [city_match("city", t) for t in terms])
    return city_fanout(codes.where(some), terms)


def fanout_by_code(coded: DataFrame, matches: DataFrame) -> DataFrame:
    """:func:`city_fanout` on coded ratings: an equi-join on the code, no text is searched.
    Stored by code (``write_by(coded, path, "city_code")``), only the folders of matching
    cities are read."""
    return coded.join(matches, "city_code").drop("city_code")
