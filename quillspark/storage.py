"""Where intermediate results go: the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where unset, on one machine, a temporary one of this application.

    On a cluster executors don't see each other's temporary folders, so there the setting must be made: RuntimeError.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        path = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own[app] = "file://" + path
    return _own[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: With this setting the shuffles of a write leave the disk when it has ended: nothing reads them again.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: With this setting a task writes to so many partitions at a time, instead of sorting its rows by them.
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None, level: int = 3) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again: cuts the lineage and survives lost executors.
    ``level`` is that of the compression."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level)
    wanted = {_CLEAN: "true"} | ({_WRITERS: "8"} if partition_by else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, value in wanted.items():
        spark.conf.set(k, value)
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame, folder: str = "") -> None:
    """Delete the files of a materialized table that no later plan reads; of a partitioned one, those in ``folder``."""
    spark = df.sparkSession
    for f in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if not f.endswith(folder):
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
