"""Session helpers: cluster sizing and the checkpoint folder."""

from prefmine.session import checkpoint_dir, cluster_conf


def test_cluster_conf_sizes_partitions_from_peak_shuffle():
    c = cluster_conf(100 * (1 << 40))          # 100 TiB peak shuffle, 256 MiB partitions
    assert int(c["spark.sql.shuffle.partitions"]) == 409_600
    assert c["spark.sql.adaptive.enabled"] == "true"
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert int(cluster_conf(1 << 20)["spark.sql.shuffle.partitions"]) == 200   # floor


def test_checkpoint_dir_reads_session_setting(spark):
    d = checkpoint_dir(spark)
    assert d and spark.sparkContext.getCheckpointDir() is not None


def test_release_deletes_a_written_table(spark):
    import os

    from prefmine.session import materialize, release
    df = materialize(spark.range(5), "t")
    path = df._table_path.removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(path)
    release(df)
    assert not os.path.exists(path)


def _shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_dir):
    import time

    from pyspark.sql import functions as F

    from prefmine.operators import colocated
    from prefmine.session import CLEANUP, materialize
    from prefmine.sources.versions import Versions
    before, setting = _shuffle_files(spark), spark.conf.get(CLEANUP, None)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    for write in (lambda: materialize(counts, "t"), lambda: Versions(spark, tmp_dir).commit(append={"t": counts}),
                  lambda: colocated.write_bucketed(counts, "k", 3, "t")):
        write()
        for _ in range(50):  # files go in the background
            if not _shuffle_files(spark) - before:
                break
            time.sleep(0.1)
        assert not _shuffle_files(spark) - before
    assert spark.conf.get(CLEANUP, None) == setting
    assert sorted(r["count"] for r in counts.collect()) == [142] + [143] * 6
