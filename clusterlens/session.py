"""Session construction and shared-storage locations."""

from __future__ import annotations

import hashlib
import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session of ours wants, unless the launcher has set them.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    # Whole-stage code above HotSpot's JIT limit (8000 bytecodes) would run
    # interpreted; above this size Spark uses its own (compiled) evaluators.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "clusterlens") -> SparkSession:
    """Build (or reuse) a session with our defaults.

    ``master`` and ``shuffle_partitions`` are left to the launcher
    (spark-submit, its configuration files) unless given; ``local_session`` is
    the form for tests and the benchmark.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if (master or "").startswith("local"):  # one JVM: the driver's heap is all there is
        builder = builder.config("spark.driver.memory", os.environ.get("CLUSTERLENS_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def local_session(cpus: int | str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session in this JVM, on ``cpus`` threads ($BENCH_CPUS, else 8)."""
    return get_session(f"local[{cpus or os.environ.get('BENCH_CPUS', '8')}]", shuffle_partitions)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    go without: it gets a fresh folder. On a cluster a machine-local folder
    would lose data, so there an unset folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="clusterlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder, for written tables."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([root, "clusterlens", *parts])


def source_key(path: str) -> str:
    """Short stable key of an input location, for per-input derived tables."""
    return hashlib.sha1(path.rstrip("/").encode()).hexdigest()[:12]
