"""Views over the driver's TPC-H-like parquet tables.

The tables stand in for the review data the library is built for:

* ``reviews``  lineitem joined to orders: the customer reviews the supplier
  (or part) of each line with its quantity as the rate.
* ``users``    customers; the integer key is the user id.
* ``business`` suppliers with their nation name as the city.
* ``events``   click events whose JSON ``props`` carry the item key ``k``.

Everything is lazy; column pruning and filters reach the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefmine.operators.ratings import build_ratings

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str, item: str = "supp") -> DataFrame:
    """(user_key, item_key, rate): one row per line item."""
    key = {"supp": "l_suppkey", "part": "l_partkey"}[item]
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", key, "l_quantity")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (li.join(od, li.l_orderkey == od.o_orderkey)
            .select(F.col("o_custkey").alias("user_key"), F.col(key).alias("item_key"),
                    F.col("l_quantity").alias("rate")))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_key, user_id)."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_key"), F.col("c_custkey").alias("user_id"))


def business(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_key, item_id, city, is_open): suppliers, city = nation name."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (s.join(n, s.s_nationkey == n.n_nationkey)
            .select(F.col("s_suppkey").alias("item_key"), F.col("s_suppkey").alias("item_id"),
                    F.col("n_name").alias("city"),
                    (F.col("s_acctbal") > 0).cast("int").alias("is_open")))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_key, item_id): parts carry no city."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_key"), F.col("p_partkey").alias("item_id"))


def ratings_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averaged quantity per (customer, supplier), city = supplier nation."""
    return build_ratings(reviews(spark, sf_dir, "supp"), users(spark, sf_dir),
                         business(spark, sf_dir).drop("is_open"))


def ratings_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averaged quantity per (customer, part); city NULL."""
    return build_ratings(reviews(spark, sf_dir, "part"), users(spark, sf_dir),
                         parts(spark, sf_dir))


def ratings_part_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averaged quantity per (customer, part, city of the supplying supplier).

    The item is the part as offered in a city; selecting one city gives the
    sparse per-city rating files the CF experiments run on.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sb = business(spark, sf_dir)
    return (li.join(od, li.l_orderkey == od.o_orderkey)
            .join(users(spark, sf_dir), F.col("o_custkey") == F.col("user_key"))
            .join(sb, F.col("l_suppkey") == sb.item_key)
            .groupBy("user_id", F.col("l_partkey").alias("item_id"), "city")
            .agg(F.avg(F.col("l_quantity").cast("double")).alias("rating")))


def ratings_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averaged event value per (user_id, props.k); item parsed from JSON text."""
    ev = table(spark, sf_dir, "events").select("user_id", "value", "props")
    return (ev.select(F.col("user_id").cast("bigint").alias("user_id"),
                      F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
                      F.col("value").alias("rate"))
            .where(F.col("item_id").isNotNull())
            .groupBy("user_id", "item_id").agg(F.avg("rate").alias("rating"))
            .withColumn("city", F.lit(None).cast("string"))
            .select("user_id", "item_id", "city", "rating"))


def brand_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (user_id = order, item = brand) pairs: the basket source."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (li.join(p, li.l_partkey == p.p_partkey)
            .select(F.col("l_orderkey").alias("user_id"), F.col("p_brand").alias("item"))
            .distinct())
