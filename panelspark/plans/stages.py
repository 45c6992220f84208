"""Stage boundaries: a panel is written once a session to the shared folder, and later stages read the table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir: a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def state_of(spark: SparkSession, table: str) -> tuple:
    """Names, sizes and times of a table's files: another state makes its stages anew."""
    where = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def stage(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame], write: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
    """The table `name` made from the table `source`: written by the first caller of this application, then read.

    The tables of one application stay until the shared folder is cleared, as later queries of it may read them.
    """
    key = (spark.sparkContext.applicationId, source, name, state_of(spark, source))
    if key not in _WRITTEN or not _there(spark, _WRITTEN[key]):
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        (write or (lambda df, to: df.write.parquet(to)))(build(), path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def bucketed_stage(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame], key: str, order: str) -> DataFrame:
    """The same as a table bucketed by `key` and sorted by `key` and `order` in each bucket.

    Windows and joins by the key read it without a shuffle. As many buckets as shuffle partitions, one file each.
    """
    made = (spark.sparkContext.applicationId, source, f"{name} by {key}", state_of(spark, source))
    if made not in _WRITTEN or not spark.catalog.tableExists(_WRITTEN[made]):
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        known = f"{name}_{uuid.uuid4().hex}"
        rows = build().repartition(buckets, key)
        rows.write.format("parquet").bucketBy(buckets, key).sortBy(key, order).option("path", f"{shared_dir(spark)}/{known}").saveAsTable(known)
        _WRITTEN[made] = known
    return spark.table(_WRITTEN[made])


def release(spark: SparkSession) -> None:
    """Delete what this application has written as stages; a later query makes its stages anew."""
    for key in [k for k in _WRITTEN if k[0] == spark.sparkContext.applicationId]:
        where = _WRITTEN.pop(key)
        if "/" not in where:  # a table of the catalog
            spark.sql(f"DROP TABLE IF EXISTS `{where}`")
            where = f"{shared_dir(spark)}/{where}"
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
