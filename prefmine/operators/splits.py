"""Seeded train/test splits.

Both splits are functions of the row key and a seed, so a task re-run after an
executor loss puts every row on the same side again, and DuckDB can recompute
them from the same md5 text.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefmine.functions.columns import hash_key, hash_unit, hex_threshold


def mark_split(df: DataFrame, keys: Sequence[str], test_fraction: float = 0.2,
               seed: int = 0, name: str = "is_test") -> DataFrame:
    """``df`` with the boolean ``name`` column of :func:`hash_split`.

    Write the marked table once (``session.materialize``) when train and test
    are scanned many times: the md5 is then computed once per row instead of
    once per scan.
    """
    return df.withColumn(name, hash_unit(*keys, seed=seed) < F.lit(hex_threshold(test_fraction)))


def split_marked(df: DataFrame, name: str = "is_test") -> tuple[DataFrame, DataFrame]:
    """(train, test) of a table marked by :func:`mark_split`."""
    return df.where(~F.col(name)).drop(name), df.where(F.col(name)).drop(name)


def hash_split(df: DataFrame, keys: Sequence[str], test_fraction: float = 0.2,
               seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test): a row is test when its seeded key hash falls under the
    fraction.  Narrow (no shuffle); sizes are random around the fraction."""
    is_test = hash_unit(*keys, seed=seed) < F.lit(hex_threshold(test_fraction))
    return df.where(~is_test), df.where(is_test)


def random_split(df: DataFrame, weights: Sequence[float] = (0.8, 0.2),
                 seed: int = 0) -> list[DataFrame]:
    """Spark's Bernoulli split, as the original trainers used it."""
    return df.randomSplit(list(weights), seed=seed)


# Hex digits of the order key that one narrowing step looks at (4,096 counts).
_STEP = 3


def exact_split(df: DataFrame, keys: Sequence[str], test_fraction: float = 0.1,
                seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test) with exactly ``floor(test_fraction * n)`` test rows: the
    rows first in (seeded md5 of the key, key) order.

    Repeated keys and null key columns are ordered further by the row's place in
    a written table, so every row is on exactly one side and the size is exact
    whatever repeats.  The marked table is written once (``session.materialize``):
    the md5 is computed once, both sides are filters on a stored flag, and a task
    re-run after an executor loss makes the same decision.
    """
    marked = mark_exact_split(df, keys, test_fraction, seed)
    return split_marked(marked)


def mark_exact_split(df: DataFrame, keys: Sequence[str], test_fraction: float = 0.1,
                     seed: int = 0, name: str = "is_test") -> DataFrame:
    """``df`` with the boolean ``name`` of :func:`exact_split`, written once.

    Only the cut-off is needed, so it is found by narrowing prefixes of one hex
    order key instead of sorting: count rows for each value of the next three
    digits (one row of at most 4,096 to pick from, chosen by a window), step into
    the prefix that holds the cut-off, and repeat until a prefix ends exactly at
    it.  The order key is the md5 (32 digits), then 16 digits of a second hash of
    the typed key, then 16 digits of the row's place: it is unique, so the search
    ends, and no bucket of rows is ever brought to the driver.
    """
    from prefmine.session import materialize, release
    placed = materialize(df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"),
                                   F.unhex(hash_key(*keys, seed=seed)).alias("h"),
                                   F.monotonically_increasing_id().alias("place")), "split", n=F.count(F.lit(1)))
    k = math.floor(Decimal(placed.metrics["n"] or 0) * Decimal(str(test_fraction)))

    def digits(n: int):
        """The first ``n`` digits of the order key, from the stored bytes of the md5 as far as these go."""
        md5 = F.lower(F.hex(F.substring("h", 1, (n + 1) // 2)))
        if n <= 32:
            return F.substring(md5, 1, n)
        second = F.lpad(F.hex(F.xxhash64(*[F.col("row")[c] for c in keys])), 16, "0")
        return F.substring(F.concat(md5, second, F.lpad(F.lower(F.hex("place")), 16, "0")), 1, n)

    prefix, rest = "", max(0, min(k, placed.metrics["n"] or 0))
    while rest:  # rows of `prefix` that are still to be taken
        counts = (placed.where(digits(len(prefix)) == prefix).groupBy(digits(len(prefix) + _STEP).alias("d"))
                  .agg(F.count(F.lit(1)).alias("c")))
        upto = F.sum("c").over(Window.orderBy("d"))
        hit = (counts.withColumn("upto", upto).where(F.col("upto") >= rest)
               .agg(F.min(F.struct("upto", "d", "c")).alias("m")).first().m)
        prefix = hit.d
        rest -= hit.upto - hit.c
        if rest == hit.c:  # the cut-off is the end of this prefix
            break
    is_test = (digits(len(prefix)) <= F.lit(prefix)) if k > 0 else F.lit(False)
    marked = materialize(placed.select("row.*", is_test.alias(name)), "marked")
    release(placed)
    return marked
