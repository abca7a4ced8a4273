"""Column expressions shared by the operators.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_ratio(num, den) -> Column:
    """num / den as double, NULL when den is 0 or NULL (ANSI ``/`` raises)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def cosine(dot, norm_a, norm_b) -> Column:
    """dot / sqrt(norm_a * norm_b); 0 when either norm is 0 (all-zero ratings)."""
    return F.coalesce(F.try_divide(_c(dot), F.sqrt(_c(norm_a) * _c(norm_b))), F.lit(0.0))


def weighted_mean(weighted_sum, weight_sum) -> Column:
    """sum(w*x) / sum(w); 0 when the weights add up to 0."""
    return (F.when(_c(weight_sum) != 0, F.try_divide(_c(weighted_sum), _c(weight_sum)))
            .otherwise(F.lit(0.0)))


def rmse(actual, predicted) -> Column:
    """Aggregate: sqrt(mean((actual - predicted)^2)); NULL over no rows."""
    return F.sqrt(F.avg(F.pow(_c(actual) - _c(predicted), 2)))


def hash_key(*cols, seed: int = 0) -> Column:
    """Seeded md5 hex of the key columns joined by '|'.

    ``md5(concat_ws('|', ...))`` gives the same string in Spark and DuckDB, so
    a split defined on it can be checked by SQL.
    """
    return F.md5(F.concat_ws("|", *[_c(c).cast("string") for c in cols], F.lit(str(seed))))


def hash_unit(*cols, seed: int = 0) -> Column:
    """First 8 hex digits of :func:`hash_key` (a uniform 32-bit bucket as text).

    Compare against a hex threshold string: ``hash_unit(...) < '33333333'``
    keeps 0x33333333 / 2^32 = 20 % of keys.
    """
    return F.substring(hash_key(*cols, seed=seed), 1, 8)


def hex_threshold(fraction: float) -> str:
    """Hex prefix that ``hash_unit`` rows fall below with probability ``fraction``."""
    v = int(round(fraction * 0x100000000))
    v = max(0, min(v, 0xFFFFFFFF))
    return f"{v:08x}"
