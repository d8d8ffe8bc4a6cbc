"""Session settings and tables shared between stages of one application."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Settings a deployment should start from. Sizes are per task, so the same values
#: hold on a laptop and on a large cluster; AQE merges or splits to match them.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # splits the partition of a hot trace, thread or address at run time
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    # a group key must be hashed in full: an aggregation by (trace, name) never
    # reuses a layout by trace alone, which would put a hot trace into one task
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    "spark.sql.session.timeZone": "UTC",
}

_CHECKPOINT_CONF = "spark.checkpoint.dir"
_local_roots: dict[str, str] = {}


#: Bytes of input for each partition that a shuffle starts with.
PARTITION_BYTES = 128 * 1024 * 1024


def configure(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Apply the recommended run-time settings to an existing session.

    ``input_bytes``, the size of the tables to be read, sets the number of partitions that
    shuffles start with. Adaptive execution only lowers that number, so for large inputs
    it must be given.
    """
    for key, value in RECOMMENDED_CONF.items():
        spark.conf.set(key, value)
    if input_bytes is not None:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        wanted = max(least, -(-input_bytes // PARTITION_BYTES))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    Only a ``local`` master without the setting gets a temporary folder of its own.
    """
    app = spark.sparkContext.applicationId
    configured = spark.conf.get(_CHECKPOINT_CONF, "") or spark.sparkContext.getConf().get(
        _CHECKPOINT_CONF, ""
    )
    if configured:
        return f"{configured.rstrip('/')}/traceprofile/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{_CHECKPOINT_CONF} must name a folder shared by all executors")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="traceprofile-")
    return _local_roots[app]


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing is ever overwritten there."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_staged: list[list[str]] = []
#: Folders of the tables that are still in use.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Delete, on leaving, the tables that were staged inside; write results before."""
    _staged.append([])
    try:
        yield
    finally:
        for path in _staged.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    It stays there until the folder is removed or the enclosing :func:`staging` ends.

    Cuts lineage with a table that outlives lost executors, keeps column pruning
    and filter push-down for each reader, and gives the planner true file sizes.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, name)
    for paths in _staged[-1:]:
        paths.append(path)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete staged tables once everything made of them is written."""
    for table in tables:
        path = _paths.pop(table, None)
        if path is not None:
            folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
