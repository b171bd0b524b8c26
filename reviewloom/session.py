"""Session helpers: session factory, the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size is below this many bytes.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def build_session(app: str = "reviewloom", cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the operators expect (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is read from ``spark.checkpoint.dir``; only where that is unset in a local
    session (a test) is a folder of our own made and set. On a cluster that
    setting must be there: a folder of the driver's machine would be no shared one.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if known:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(known)
        return known.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="reviewloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder for an intermediate; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/reviewloom/{label}-{uuid.uuid4().hex[:12]}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(place.getParent())
    fs.deleteOnExit(place)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (survives the loss of executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    """The shuffle parallelism that the session is sized for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """The rows over at least as many partitions as there are cores.

    For operators whose work is in Python: an input of fewer splits than cores is
    dealt out evenly first; any larger input is left as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_or_none(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT_BYTES) -> int | None:
    """Row count of ``df`` if ``count * row_bytes`` is below ``limit``, else None.

    Counts at most one row more than the limit allows, so the check itself is
    cheap on a side that has grown too large.
    """
    most = max(1, limit // max(1, row_bytes))
    n = df.limit(most + 1).count()
    return n if n <= most else None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data folder, read in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc_date(column) -> F.Column:
    """Calendar day in UTC (the session is pinned to UTC by ``table``)."""
    return F.to_date(column)
