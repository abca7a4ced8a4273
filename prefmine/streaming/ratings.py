"""Incremental rating table from a stream of review JSON files.

New review files landing in a folder are parsed with the fixed review schema,
joined to the static user and business dimensions (stream-static inner
joins) and folded into running ``(sum, count)`` state per
(user_id, item_id, city).  The averaged rating is ``sum / count``, identical
to the batch ``build_ratings`` over all files seen so far.  State and
progress live under the query's checkpoint location, in the shared
checkpoint folder, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prefmine.session import checkpoint_dir
from prefmine.sources.files import REVIEW_JSON, json_lines


def review_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 100,
                  on_error: str = "fail") -> DataFrame:
    """Streaming ``(user_key, item_key, rate)``; malformed lines and lines that lack a
    field fail the query or are dropped, as in the batch reader."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = json_lines(reader, folder, REVIEW_JSON, ["user_id", "business_id", "stars"], on_error)
    return raw.select(F.col("user_id").alias("user_key"), F.col("business_id").alias("item_key"),
                      F.col("stars").cast("double").alias("rate"))


def running_ratings(reviews: DataFrame, users: DataFrame, business: DataFrame) -> DataFrame:
    """Streaming aggregate ``(user_id, item_id, city, rate_sum, n_reviews, rating)``."""
    joined = reviews.join(users, "user_key").join(business, "item_key")
    return (joined.groupBy("user_id", "item_id", "city")
            .agg(F.sum("rate").alias("rate_sum"), F.count("rate").alias("n_reviews"))
            .withColumn("rating", F.col("rate_sum") / F.col("n_reviews")))


def start(ratings: DataFrame, name: str, path: str | None = None, trigger_once: bool = False,
          checkpoint_location: str | None = None, sink: str = "parquet") -> StreamingQuery:
    """Run the aggregate in update mode.

    ``sink="parquet"`` (the default) writes every micro-batch's changed rows to its
    own folder ``path/batch_id=<n>`` (the newest batch holding a key has its current
    value) through ``foreachBatch``; a re-run batch overwrites its folder, so the
    sink is exactly-once.  ``sink="memory"`` keeps the whole table in the driver
    under ``name``: for small tests only.  Progress and state are kept under
    ``checkpoint_location`` (default: ``streams/<name>`` in the shared checkpoint
    folder), so restarting a query of the same name resumes it.
    """
    spark = ratings.sparkSession
    ckpt = checkpoint_location or f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    w = ratings.writeStream.queryName(name).option("checkpointLocation", ckpt)
    if trigger_once:
        w = w.trigger(availableNow=True)
    if sink == "memory":
        return w.outputMode("complete").format("memory").start()
    if sink != "parquet":
        raise ValueError(f"unknown sink {sink!r}")
    if path is None:
        raise ValueError("parquet sink needs a path")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # A micro-batch re-run after a failure overwrites its own folder:
        # the sink is idempotent, so no row is written twice.
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")

    return w.outputMode("update").foreachBatch(write_batch).start()


KEYS = ("user_id", "item_id", "city")


def latest(snapshot_path: str, spark: SparkSession) -> DataFrame:
    """Current rating table from the parquet sink: per key, the row of the newest
    batch, by a map-side combined maximum."""
    df = spark.read.parquet(snapshot_path)
    rest = [c for c in df.columns if c not in (*KEYS, "batch_id")]
    newest = df.groupBy(*KEYS).agg(F.max(F.struct("batch_id", *rest)).alias("m"))
    return newest.select(*KEYS, *[F.col(f"m.{c}").alias(c) for c in rest], "m.batch_id")


def compact(spark: SparkSession, snapshot_path: str, compacted_path: str) -> int:
    """Fold all batches up to the newest into one batch folder of the table at
    ``compacted_path`` (``batch_id`` of that newest batch); returns that batch id.
    Run it between queries and go on writing there: the table then holds one row per
    key and the batches since, instead of every change ever made."""
    cur = latest(snapshot_path, spark)
    last = cur.agg(F.max("batch_id")).first()[0]
    if last is None:
        raise ValueError("nothing to compact")
    cur.drop("batch_id").write.mode("overwrite").parquet(f"{compacted_path.rstrip('/')}/batch_id={last}")
    return last
