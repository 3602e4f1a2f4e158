"""Session helpers: a local session for tests and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "stratus") -> SparkSession:
    """Session for tests and local runs; on a cluster use the session the platform provides."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # profiles aggregate many columns in one pass; keep those stages in generated code
        .config("spark.sql.codegen.maxFields", "4000")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the platform sets it to storage every executor can reach.  Only a local
    session without it gets a temporary folder, which goes when the process ends.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError(f"{CHECKPOINT_CONF} is not set: intermediate tables need a folder that all executors share")
        path = tempfile.mkdtemp(prefix="stratus-ckpt-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        try:
            spark.conf.set(CHECKPOINT_CONF, path)
        except Exception:  # noqa: BLE001 - some deployments lock core configs at runtime
            pass
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def storage_bytes(spark: SparkSession) -> int:
    """Memory that the executors keep for cached rows (the driver's where it runs the tasks itself)."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().values().iterator()
    sizes = []
    while status.hasNext():
        sizes.append(int(status.next()._1()))
    # the driver is listed beside the executors; these are alike
    return sorted(sizes)[len(sizes) // 2] * max(1, len(sizes) - 1)


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written intermediate tables.

    The process that asks for it owns it: :func:`clear_scratch` removes what it has written.
    """
    base = checkpoint_dir(spark)
    _SCRATCH.append(os.path.join(base, f"stratus-{name}-{uuid.uuid4().hex[:12]}"))
    return _SCRATCH[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Remove every folder that :func:`scratch_path` gave out in this process; DataFrames that still
    read them fail afterwards.  Returns the number of folders removed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends there, and
    Spark knows its size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def wide_plans(spark: SparkSession) -> Iterator[None]:
    """Turns constraint propagation off while the block runs: it grows combinatorially over
    projections of dozens of derived columns that are joined with encoder tables.  Plans that run
    later are not touched."""
    conf = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        yield
    finally:
        spark.conf.set(conf, before)


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` into the shared ``spark.checkpoint.dir`` (registered first if the
    session has not done so); survives executor loss, unlike a local checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
