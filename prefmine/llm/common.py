"""Pieces shared by the operators: word pattern, scratch tables, prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefmine.session import checkpoint_dir

# A word: anything but space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"

# Hash buckets per group of a distributed prefix sum.  Rows of one group are
# spread evenly over this many window partitions by a hash of the row.
PREFIX_BUCKETS = 1 << 12


class Scratch:
    """Tables written in the cluster's shared folder (``spark.checkpoint.dir``).

    Writing cuts lineage: a lost executor re-reads files instead of repeating
    what made them.  ``drop`` frees a table as soon as nothing reads it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def file_place(table: DataFrame) -> tuple[Column, Column] | None:
    """(file path, row in the file) of a table that was read from Parquet files; None for any other."""
    try:
        meta = table.metadataColumn("_metadata")
        table.select(meta["row_index"]).schema
    except AnalysisException:
        return None
    return meta["file_path"], meta["row_index"]


def free_name(df_columns: Sequence[str], name: str) -> str:
    """``name``, or ``name`` with underscores in front until no column has it."""
    taken = {c.lower() for c in df_columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def prefix_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str,
                name: str, bucket: Column, buckets: int = PREFIX_BUCKETS) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of its group that
    come before it, in the order (``bucket``, ``order``).

    ``bucket`` is an int in [0, buckets) that must not decrease along the wanted
    order (the top bits of the hash that leads it); ``group`` columns are not
    null.  One window partition holds one bucket of one group, so a group with a
    third of all rows is spread over ``buckets`` partitions; only one total per
    (group, bucket) is scanned group by group.
    """
    b = free_name(df.columns, "bucket_")
    off = free_name(df.columns, "offset_")
    d = df.withColumn(b, bucket)
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    totals = (d.groupBy(*group, b).agg(F.sum(value).alias(off))
              .withColumn(off, F.coalesce(F.sum(off).over(before), F.lit(0))))
    inside = (Window.partitionBy(*group, b).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (d.join(totals, [*group, b])
            .withColumn(name, F.col(off) + F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .drop(off, b))


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str, scratch: Scratch) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of its group (columns that are
    not null) before it in ``order``, whose columns are unique together.

    Rows are sorted in range partitions and written; a window holds the rows of one group
    in one such partition, and one total per (group, partition) is scanned group by group.
    So neither a large group nor a key that very many rows share is one task's work.
    """
    at, part, off = (free_name(df.columns, n) for n in ("at_", "part_", "offset_"))
    keys = [*group, *order]
    d = scratch.write(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()))
    d = d.withColumn(part, F.shiftright(at, 33))  # as monotonically_increasing_id makes it
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = scratch.write(d.groupBy(*group, part).agg(F.sum(value).alias(off)).withColumn(off, F.coalesce(F.sum(off).over(before), F.lit(0))))
    inside = Window.partitionBy(*group, part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return (d.join(totals, [*group, part])
            .withColumn(name, F.col(off) + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop(at, part, off))


def places(df: DataFrame, order: Sequence[str], name: str, scratch: Scratch) -> DataFrame:
    """``df`` with ``name``: the place (from 0) of each row in the order of the columns
    ``order``, which are unique together.  Range partitions are sorted and written;
    the rows of the partitions before are one number per partition.  No task holds
    more than its range, whatever repeats among the leading columns.
    """
    at, part, off = (free_name(df.columns, n) for n in ("at_", "part_", "offset_"))
    d = scratch.write(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    d = d.withColumn(part, F.shiftright(at, 33))  # as monotonically_increasing_id makes it
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.write(d.groupBy(part).agg(F.count(F.lit(1)).alias(off))
                            .withColumn(off, F.coalesce(F.sum(off).over(before), F.lit(0))))
    return d.join(offsets, part).withColumn(name, F.col(off) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at, part, off)


def pieces(text: str, size: int = 1 << 18) -> Iterator[str]:
    """``text`` in slices of about ``size`` characters, cut only in front of
    ASCII white space, so no word is cut however long the text is."""
    start, n = 0, len(text)
    while n - start > size:
        cut = start + size
        while cut < n and text[cut] not in " \t\n\r\x0b\x0c":
            cut += 1
        yield text[start:cut]
        start = cut
    yield text[start:]


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes as the largest needs, bytes of equal weight
    side by side (which compresses well)."""
    size = next(s for s in (1, 2, 4, 8) if s == 8 or int(values.max(initial=0)) < 1 << 8 * s)
    return bytes([size]) + np.ascontiguousarray(values.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    size = data[0]
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=1).reshape(size, -1).T).view(f"<u{size}").ravel().astype(np.uint64)


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Driver rows as a local relation, whose true size Catalyst knows: small ones
    are broadcast by its own size check, larger ones are shuffled."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))
    cols = list(zip(*rows)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(cols, kinds)], schema=kinds))
