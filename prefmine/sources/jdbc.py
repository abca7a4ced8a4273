"""Relational source: the review and business tables through Spark's JDBC reader.

Each table is read in parallel ranges of a numeric column, in ``fetchsize``
batches; column selection and the filters of the pair job (city, open flag) are
DataFrame expressions, which Spark pushes into the database's scan.  City text is
a literal of the expression, never pasted into SQL.  Credentials are options.
No database is reachable in the test environment, so only the option building and
the job on equal DataFrames are tested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefmine.operators.patterns import distinct_pairs


def table_options(url: str, table: str, fetchsize: int = 1000, column: str | None = None,
                  lower: int | None = None, upper: int | None = None, num_partitions: int | None = None,
                  **creds: str) -> dict[str, str]:
    """Reader options; give ``column``, its bounds and ``num_partitions`` for
    parallel range scans (rows outside the bounds go to the first and last)."""
    opts = {"url": url, "dbtable": table, "fetchsize": str(fetchsize), **creds}
    if column is not None:
        if lower is None or upper is None or num_partitions is None:
            raise ValueError("a partition column needs its bounds and a number of partitions")
        opts |= {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper),
                 "numPartitions": str(num_partitions)}
    return opts


def read_table(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**table_options(url, table, **options)).load()


def pairs_of(review: DataFrame, business: DataFrame, city: str, accent_insensitive: bool = False) -> DataFrame:
    """``(item_id, user_id)`` distinct pairs from tables with the columns
    ``business_id, user_id`` and ``id, city, is_open``."""
    return distinct_pairs(review.select(F.col("business_id").alias("item_id"), "user_id"),
                          business.select(F.col("id").alias("item_id"), "city", "is_open"),
                          city, accent_insensitive=accent_insensitive)


def read_pairs(spark: SparkSession, url: str, city: str, review: dict | None = None,
               business: dict | None = None, **creds: str) -> DataFrame:
    """The pair job on a database; ``review`` and ``business`` hold the options of
    :func:`table_options` for each table (default names ``review``, ``business``)."""
    tables = [read_table(spark, url, **{"table": name, **(opts or {}), **creds})
              for name, opts in (("review", review), ("business", business))]
    return pairs_of(*tables, city)
