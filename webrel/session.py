"""Session helpers.

Library functions never create sessions; they take DataFrames.  ``get_spark``
exists for tests, the bench and scripts.  ``checkpoint_dir`` reads the
cluster-wide ``spark.checkpoint.dir``; only a one-process session without it (local
tests) gets a scratch folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "webrel") -> SparkSession:
    master = master or os.environ.get("WEBREL_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # DOM relations are all hash-partitioned by page_id; joins on
        # (page_id, start) may reuse that partitioning instead of re-shuffling
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        # DOM plans chain many sorts (windows, in-stage sort-merge joins) inside
        # one stage; small memory pages keep each sorter's reservation low
        .config("spark.buffer.pageSize", os.environ.get("WEBREL_PAGE_SIZE", "4m"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("WEBREL_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and written tables: the session's
    ``spark.checkpoint.dir``.

    Where it is unset, a session that runs in one process (``local[...]``, as in
    tests) gets a scratch folder of its own; on a cluster that is an error, since
    executors do not see each other's folders.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="webrel-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` evaluated once into the shared folder and read back: no lineage, and
    nothing to recompute when an executor is lost."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/webrel-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
