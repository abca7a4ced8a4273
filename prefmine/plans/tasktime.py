"""Task time by job tag, from Spark's event log.

Wall-clock seconds of a fit depend on what else runs; the time its tasks spent does not.
Jobs are tagged (``SparkContext.addJobTag``); the log names the stages of each tagged
job and the run time of each task.  The log is read as a table: two selections of its
lines, joined by stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def task_seconds(spark: SparkSession, log: str) -> DataFrame:
    """(tag, n_tasks, task_s, cpu_s) of the event log at ``log`` (a file, a folder of a rolling
    log, or a folder of logs); tasks of a job with several tags count for each, failed
    tasks count too."""
    lines = spark.read.option("recursiveFileLookup", True).text(log).select("value", F.col("_metadata.file_path").alias("file"))
    at = lambda path: F.get_json_object("value", path)
    event = at("$.Event")
    jobs = lines.where(event == "SparkListenerJobStart").select(
        _app(F.col("file")).alias("app"), F.explode(F.from_json(at("$['Stage IDs']"), "array<int>")).alias("stage"),
        at("$.Properties['spark.job.tags']").alias("tags"))
    # Spark puts tags of its own, of the session and the query, beside those of the user.
    stages = jobs.where("tags IS NOT NULL").select("app", "stage", F.explode(F.split("tags", ",")).alias("tag")).distinct()
    tasks = lines.where(event == "SparkListenerTaskEnd").select(
        _app(F.col("file")).alias("app"), at("$['Stage ID']").cast("int").alias("stage"),
        at("$['Task Metrics']['Executor Run Time']").cast("long").alias("ms"), at("$['Task Metrics']['Executor CPU Time']").cast("long").alias("ns"))
    return tasks.join(stages, ["app", "stage"]).groupBy("tag").agg(
        F.count(F.lit(1)).alias("n_tasks"), (F.coalesce(F.sum("ms"), F.lit(0)) / 1e3).alias("task_s"),
        (F.coalesce(F.sum("ns"), F.lit(0)) / 1e9).alias("cpu_s"))


def _app(file):
    """The application of a log file: a rolling log's folder, else the file itself."""
    return F.coalesce(F.nullif(F.regexp_extract(file, r"(eventlog_v2_[^/]+)/", 1), F.lit("")), F.regexp_extract(file, r"([^/]+?)(?:\.inprogress)?$", 1))
