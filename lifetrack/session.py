"""Session settings the operators rely on, and the one way lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Hot keys in joins are split at run time, even where the split costs the
    # next operator one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; safe to call any number of times."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_local_folders: list[tempfile.TemporaryDirectory] = []
#: Folders of settled tables by application, until they are released.
_settled: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for settled tables: the one the session names, else a temporary one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not _local_folders:
        _local_folders.append(tempfile.TemporaryDirectory(prefix="lifetrack-"))
    return _local_folders[0].name


def new_folder(spark: SparkSession) -> str:
    """A path for files of its own in the shared folder; ``release`` deletes it with the settled tables."""
    path = f"{shared_folder(spark)}/lifetrack-{uuid.uuid4().hex}"
    _settled.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the session's shared folder and read it back.

    For tables with several consumers, and for small tables derived from large
    ones: read back, they are scanned by column and Spark knows their true size,
    so it broadcasts those that fit its threshold without a hint.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_by(df: DataFrame, *columns: str) -> DataFrame:
    """Settle ``df`` bucketed by ``columns``: grouping, windows and joins by them then need no exchange.

    There are as many buckets as shuffle partitions. Deal the rows by the columns first, or each task writes a file
    for every bucket it meets.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    name = "lifetrack_" + path[-32:]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, *columns).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def together(*builds: Callable[[], DataFrame]) -> list[DataFrame]:
    """The tables that the functions build, which run side by side.

    For tables that do not depend on one another and are settled while they are built: their jobs share the cluster
    instead of waiting in line.
    """
    with ThreadPoolExecutor(len(builds)) as pool:
        return [done.result() for done in [pool.submit(build) for build in builds]]


def release(spark: SparkSession) -> int:
    """Delete all tables this session has settled and say how many: for when their results are written or done with."""
    mine = _settled.pop(spark.sparkContext.applicationId, [])
    for path in mine:
        spark.sql(f"DROP TABLE IF EXISTS lifetrack_{path[-32:]}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(mine)
