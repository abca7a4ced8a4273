"""JSON lines with a quarantine: one pass, two tables.

Every line is parsed once and written once, good rows and bad lines apart; blank lines
are neither.  A bad line keeps its text, its file, its line number and the reason:
``malformed`` (no JSON, or a value of another type than the schema's) or ``missing <field>``.
More bad lines than a given share fail the job, with the quarantine left for inspection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from prefmine.session import checkpoint_dir

_CORRUPT = "_corrupt_record"


class TooManyBadLines(ValueError):
    pass


def placed(text: DataFrame) -> DataFrame:
    """(value, file, block) of a text table, batch or stream."""
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def tagged(lines: DataFrame, schema: T.StructType, required: Sequence[str]) -> DataFrame:
    """(kind, reason, line, file, block, row, *schema) of the lines (:func:`placed`) as they are
    scanned: kind is good, bad or blank; ``line`` is kept for bad ones."""
    full = T.StructType(schema.fields + [T.StructField(_CORRUPT, T.StringType())])
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "allowUnquotedControlChars": "true"})
    rows = lines.select("value", parsed.alias("p"), "file", "block", F.monotonically_increasing_id().alias("row"))
    reason = F.when(F.col("p").isNull() | F.col(f"p.{_CORRUPT}").isNotNull(), "malformed")
    for c in required:
        reason = reason.when(F.col(f"p.{c}").isNull(), f"missing {c}")
    blank: Column = F.trim(F.regexp_replace("value", r"[\t\r]", " ")) == ""
    kind = F.when(blank, "blank").when(F.col("reason").isNotNull(), "bad").otherwise("good")
    rows = rows.withColumn("reason", reason).withColumn("kind", kind)
    bad = F.col("kind") == "bad"
    return rows.select("kind", F.when(bad, F.col("reason")).alias("reason"), F.when(bad, F.col("value")).alias("line"), "file", "block", "row",
                       *[F.col(f"p.{f.name}").alias(f.name) for f in schema.fields])


def good_rows(table: DataFrame, schema: T.StructType) -> DataFrame:
    return table.where("kind = 'good'").select(*[f.name for f in schema.fields])


def bad_lines(table: DataFrame) -> DataFrame:
    """(file, line_number, reason, line); numbers from 1 in each file.

    A file may be read in several blocks: the lines of a block are numbered by their order in
    the scan, those of the blocks before it are counted (one row a block)."""
    one = ["batch_id"] if "batch_id" in table.columns else []
    blocks = table.groupBy(*one, "file", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*one, "file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return (table.where("kind = 'bad'").join(blocks, [*one, "file", "block"])
            .select("file", (F.col("before") + F.col("row") - F.col("first") + 1).alias("line_number"), "reason", "line"))


def _check(bad: int, lines: int, max_bad_share: float | None, where: str) -> None:
    if max_bad_share is not None and bad > max_bad_share * lines:
        raise TooManyBadLines(f"{bad} of {lines} lines are bad (more than {max_bad_share:.3%}); they are in {where}")


def read_json(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str], out: str,
              max_bad_share: float | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(good rows, bad lines, counts) of the JSON lines at ``path``, written below ``out``.  The counts (lines,
    bad) are observed in that write; blank lines are not counted."""
    from pyspark.sql import Observation
    seen = Observation()
    rows = tagged(placed(spark.read.text(path)), schema, required).observe(
        seen, F.count_if(F.col("kind") != "blank").alias("lines"), F.count_if(F.col("kind") == "bad").alias("bad"))
    rows.write.mode("overwrite").partitionBy("kind").parquet(out)
    counts = seen.get
    _check(counts["bad"], counts["lines"], max_bad_share, out)
    table = spark.read.schema(rows.schema).parquet(out)
    return good_rows(table, schema), bad_lines(table), counts


def start_stream(spark: SparkSession, folder: str, schema: T.StructType, required: Sequence[str], out: str, name: str,
                 max_bad_share: float | None = None, max_files_per_trigger: int = 100, checkpoint_location: str | None = None,
                 available_now: bool = False) -> StreamingQuery:
    """The same for files landing in ``folder``: every micro-batch writes its own folder
    ``out/batch_id=<n>`` in one pass, a repeated one overwrites it.  A micro-batch with too
    large a share of bad lines fails the query."""
    from pyspark.sql import Observation

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        where = f"{out.rstrip('/')}/batch_id={batch_id}"
        (tagged(batch, schema, required).observe(seen, F.count_if(F.col("kind") != "blank").alias("lines"), F.count_if(F.col("kind") == "bad").alias("bad"))
         .write.mode("overwrite").partitionBy("kind").parquet(where))
        counts = seen.get
        _check(counts["bad"], counts["lines"], max_bad_share, where)

    lines = placed(spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(folder))
    w = lines.writeStream.queryName(name).option(
        "checkpointLocation", checkpoint_location or f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}")
    if available_now:
        w = w.trigger(availableNow=True)
    return w.foreachBatch(write_batch).start()
