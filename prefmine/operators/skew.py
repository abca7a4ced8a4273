"""Hot-key salting.

Hot keys (one key may hold a third of all rows) are split into salt buckets so
no single task owns the whole key.  The list of hot keys is a written table (at
most rows / chunk keys): Catalyst sees its true size and broadcasts it or not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_key_salts(df: DataFrame, key, chunk: int) -> DataFrame:
    """``(*key, n_salt)`` for keys (a column or list of columns) with more
    than ``chunk`` rows.

    ``n_salt = ceil(rows / chunk)`` so each salt bucket holds about ``chunk``
    rows.  The count is a map-side-combined aggregate: no key reaches a single
    task whole.  At most ``rows / chunk`` keys qualify.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
            .where(F.col("_rows") > chunk)
            .select(*keys, F.ceil(F.col("_rows") / F.lit(chunk)).cast("int").alias("n_salt")))


def hot_keys(df: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """:func:`hot_key_salts`, written (usually empty or a handful of rows)."""
    from prefmine.session import materialize
    return materialize(hot_key_salts(df, keys, chunk), "hot-keys")


def salts_of(counts: DataFrame, rows: str, chunk: int) -> DataFrame:
    """:func:`hot_keys` from a written table of counts: its keys with more than ``chunk`` ``rows``."""
    from prefmine.session import materialize
    return materialize(counts.where(F.col(rows) > chunk).withColumn("n_salt", F.ceil(F.col(rows) / F.lit(chunk)).cast("int"))
                       .drop(rows), "hot-keys")


def salted_join(fact: DataFrame, dim: DataFrame, keys, chunk: int, hot: DataFrame | None = None) -> DataFrame:
    """Inner equi-join of a large ``fact`` with ``dim`` on ``keys`` where a
    few keys may hold a large share of the fact rows.

    Fact rows of a hot key are spread over ``n_salt`` buckets by a hash of the
    whole row; the key's dimension rows are copied once per bucket.  Every
    fact row meets each of its dimension rows exactly once, whatever bucket it
    lands in, so the result equals the plain join while no task receives more
    than about ``chunk`` fact rows of one key.  ``hot`` (``*keys, n_salt``) spares the count
    of the fact rows where the caller has it.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    hot = hot_keys(fact, keys, chunk) if hot is None else hot
    n = F.coalesce(F.col("n_salt"), F.lit(1))
    f = (fact.join(hot, keys, "left")
         .withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in fact.columns]), n).cast("int"))
         .drop("n_salt"))
    d = (dim.join(hot, keys, "left")
         .withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1)))
         .drop("n_salt"))
    return f.join(d, keys + ["_salt"]).drop("_salt")
