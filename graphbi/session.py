"""Spark session and shared-storage helpers.

Iterative operators cut their lineage by writing each round as a table under
the shared folder named by ``spark.checkpoint.dir``.  That setting is read
from the session; only a local test session without it gets a private folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, cpus: int | None = None,
                  shuffle_partitions: int | None = None,
                  app: str = "graphbi") -> SparkSession:
    """A session configured for the BI workload (UTC, AQE, no UI)."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    elif not os.environ.get("SPARK_MASTER"):
        builder = builder.master(f"local[{cpus}]")
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.driver.memory", os.environ.get("GRAPHBI_DRIVER_MEMORY", "8g")))
    local = (master or "local").startswith("local") and not os.environ.get("SPARK_MASTER")
    parts = shuffle_partitions or (max(cpus, 8) if local else None)  # a cluster's own setting stays
    if parts:
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of a hash table of rows for each byte of the stored files, about: sorted ids and dates compress well.
FILE_COMPRESSION = "32"

#: Folders of a table that the driver lists by itself.
LISTED_FOLDERS = "512"


def configure(spark: SparkSession) -> SparkSession:
    """Settings every graphbi job relies on (idempotent)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    # plans compare sizes of rows, not of compressed files, with the broadcast threshold: a broadcast passes through the driver
    spark.conf.set("spark.sql.sources.fileCompressionFactor", FILE_COMPRESSION)
    # a table of some hundred months is listed by the driver: a job with a task for each folder takes longer
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.threshold", LISTED_FOLDERS)
    shared_root(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


_LOCAL_ROOTS: dict[int, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables (``spark.checkpoint.dir``).

    On a cluster the setting must be present.  A local session without it
    (unit tests) gets one private folder per SparkContext, registered as the
    context's checkpoint directory (core configs cannot be changed at runtime).
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_ROOTS.get(id(sc))
    if not root:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="graphbi-ckpt-")
        _LOCAL_ROOTS[id(sc)] = root
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new, unique folder below the shared root for one job's tables."""
    return f"{shared_root(spark)}/graphbi/{kind}-{uuid.uuid4().hex[:12]}"
