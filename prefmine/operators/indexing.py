"""Global positions and dense integer ids without a single-task window.

``global_position`` is the DataFrame form of zip-with-index: range-partition on
the order, sort inside each partition, take the in-partition position from
``monotonically_increasing_id`` and add the row count of all earlier
partitions.  The offsets are a small written table (one row per partition) that is
joined by partition number.  The tagged rows are checkpointed to the shared
checkpoint folder, which pins the partition contents (a re-run task
after an executor loss reads the same rows) and cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefmine.session import ensure_checkpoint_dir, materialize


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def global_position(df: DataFrame, order: Sequence, name: str = "pos",
                    num_partitions: int | None = None) -> DataFrame:
    """Add ``name``: the 0-based position of each row in ``order``.

    ``order`` must be a total order (unique over the rows) for the numbering to
    be reproducible.  Columns may carry ``.desc()``.
    """
    return positions_and_total(df, order, name, num_partitions)[0]


def positions_and_total(df: DataFrame, order: Sequence, name: str = "pos",
                        num_partitions: int | None = None) -> tuple[DataFrame, int]:
    """:func:`global_position` plus the row count (known from the partition
    counts, no extra job)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ocols = _cols(order)
    tagged = (df.repartitionByRange(n, *ocols).sortWithinPartitions(*ocols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
                          .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))), "offsets")
    total = offsets.agg(F.sum("_n")).first()[0] or 0
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (tagged.join(offsets.drop("_n"), "_pid").withColumn(name, (F.col("_off") + local).cast("bigint"))
            .drop("_pid", "_mid", "_off"), total)


def dense_index(df: DataFrame, keys: Sequence[str], name: str = "index",
                order: str = "key") -> DataFrame:
    """Dense 0-based integer ids.

    ``order="key"``: one id per distinct key, in key order.
    ``order="file"``: one id per row, in file order (duplicates get separate
    numbers), from the file path, block start and in-block row order.
    """
    if order == "key":
        return global_position(df.select(*keys).distinct(), list(keys), name)
    if order == "file":
        tagged = df.select("*", F.col("_metadata.file_path").alias("_fp"),
                           F.col("_metadata.file_block_start").alias("_fb"),
                           F.monotonically_increasing_id().alias("_row"))
        return global_position(tagged, ["_fp", "_fb", "_row"], name).drop("_fp", "_fb", "_row")
    raise ValueError(f"unknown order {order!r}")


def first_seen_index(df: DataFrame, key: str, order: Sequence[str], name: str = "index") -> DataFrame:
    """Dense ids in order of first appearance of ``key`` when ``df`` is read in
    ``order``: a key's first row is its minimum ``order`` tuple, so keys are
    numbered by (that minimum, key).  ``(key, name)`` per distinct key."""
    first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    return global_position(first, ["_first", key], name).select(key, name)
