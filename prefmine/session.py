"""Session helpers: defaults for local runs and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import warnings
from contextlib import contextmanager

from pyspark.sql import Column, Observation, SparkSession

# Settings every prefmine job wants.  AQE re-plans joins from runtime sizes,
# splits skewed join partitions and coalesces small shuffle partitions.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def cluster_conf(peak_shuffle_bytes: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a large cluster run, sized from the largest expected
    shuffle (for item CF, the pair rows: about 48 bytes x sum of deg^2).

    Shuffle partitions start at ``peak / partition_bytes`` so every reduce
    task fits in executor memory; AQE then coalesces small ones and splits
    skewed join partitions above the advisory size.
    """
    n = max(200, -(-peak_shuffle_bytes // partition_bytes))
    return {
        **_DEFAULTS,
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.files.maxPartitionBytes": str(min(partition_bytes, 256 << 20)),
    }


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  driver_memory: str = "16g", app: str = "prefmine") -> SparkSession:
    """A local session for tests and the bench (cluster jobs bring their own)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    n = shuffle_partitions or (os.cpu_count() if cores == "*" else int(cores) * 2)
    builder = (builder.config("spark.sql.shuffle.partitions", str(n))
               .config("spark.driver.memory", driver_memory)
               # Small local shuffles: let AQE keep one partition per core
               # instead of merging to 1 MB partitions.
               .config("spark.sql.adaptive.coalescePartitions.minPartitionSize",
                       os.environ.get("PREFMINE_MIN_PARTITION", "256k")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_OWN_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when the setting is missing do we use the context's checkpoint
    folder, or, in a local-mode session (tests), make one of our own per
    application; a cluster session without a shared folder is an error.  The
    core setting itself cannot be changed at runtime, so it is left alone.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if not spark.sparkContext.master.startswith("local") and (":" not in d or d.startswith("file:")):
            # May be a mount that the driver and all executors share; only the cluster can know.
            warnings.warn(f"spark.checkpoint.dir is {d}: on a cluster this must be a mount that the driver and "
                          "all executors share", stacklevel=2)
        return d
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        # Executors on other machines cannot see a local folder.
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = sc.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="prefmine-ckpt-")
    return _OWN_DIRS[app]


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point ``SparkContext`` checkpoints (used by ``DataFrame.checkpoint`` and
    ALS) at the shared folder."""
    d = checkpoint_dir(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FREEING, _ONE = {"writes": 0, "before": None}, threading.Lock()


@contextmanager
def shuffles_freed(spark: SparkSession):
    """What is written in this block leaves no shuffle files behind.

    Spark keeps a query's shuffle files until the driver happens to collect its garbage.  A write
    plans its query anew and nothing else can read these files, so they go when it ends.  The
    setting is the session's: writes of several threads share it, the last one puts it back.
    """
    with _ONE:
        if not _FREEING["writes"]:
            _FREEING["before"] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _FREEING["writes"] += 1
    try:
        yield
    finally:
        with _ONE:
            _FREEING["writes"] -= 1
            if not _FREEING["writes"]:
                if _FREEING["before"] is None:
                    spark.conf.unset(CLEANUP)
                else:
                    spark.conf.set(CLEANUP, _FREEING["before"])


def materialize(df, name: str = "table", **metrics: Column):
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Use when a derived table feeds several consumers (the rating table feeds
    the degree count, both sides of the pair join, the predictions and the
    evaluation): it is computed once, its lineage is cut (a lost executor
    re-reads files instead of recomputing the joins), and the read-back plan
    carries real file sizes for Catalyst's broadcast decisions.  Its shuffle files are freed.

    ``metrics`` are aggregates (``rows=F.count(F.lit(1))``) observed while the rows are
    written; ``.metrics`` of the returned table has their values, so no job of its own
    counts what was just written.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    if metrics:
        df = df.observe(seen, *[c.alias(k) for k, c in metrics.items()])
    with shuffles_freed(spark):
        df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out._table_path = path
    out.metrics = seen.get if metrics else {}
    return out


def release(*tables) -> None:
    """Delete tables that :func:`materialize` wrote, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._table_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
