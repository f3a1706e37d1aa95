"""Session settings for local runs and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

_LOCAL_SCRATCH: dict[str, str] = {}


def local_session(app: str, cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and the local bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Small local inputs should still use every core.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_base(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Every executor must see it, so a machine-local folder is only ever used when the
    whole session is one machine.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        app = context.applicationId
        if app not in _LOCAL_SCRATCH:
            _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="fiscus-")
        base = _LOCAL_SCRATCH[app]
    return base.rstrip("/")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_base(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, divided by the values of ``by``, and read it back.

    Cuts the lineage in a way that survives losing executors, keeps columns prunable, and
    gives the planner the true size of the result, so whether a later join broadcasts it
    is decided by Spark's own threshold.
    """
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)
