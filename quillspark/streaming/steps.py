"""Incremental step collection: append what is new, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..storage import new_path


def step_stream(spark: SparkSession, path: str, schema: str, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """A stream of step rows from Parquet files, with a watermark; times without zone count as UTC."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def collect_once(steps: DataFrame, key: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends each key's first row to Parquet under ``target``; what came in an earlier batch or run isn't taken again.

    Keys are compared with those of the target, so no state is kept. A batch that is tried again replaces its own rows: the
    checkpoint goes with its target.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            known = collected(spark, target, batch.schema).where(F.col("_batch") != number).select(F.col(key).alias("_known"))
            fresh = fresh.join(known, fresh[key].eqNullSafe(known["_known"]), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/_batch={number}")

    return steps.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collected(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """What ``collect_once`` wrote, with the number of its batch."""
    return spark.read.schema(StructType([*schema.fields, StructField("_batch", IntegerType())])).option("basePath", target).parquet(f"{target}/_batch=*")


def windowed_counts(steps: DataFrame, by: str, width: str = "1 hour", time: str = "ts") -> DataFrame:
    return steps.groupBy(F.window(time, width), by).count()


def count_windows(steps: DataFrame, by: str, target: str, checkpoint: str, width: str = "1 hour", time: str = "ts") -> StreamingQuery:
    """Keeps the counts of all windows so far in the Parquet table ``target``."""

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    return windowed_counts(steps, by, width, time).writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(spark: SparkSession, path: str, schema: str, key: str, by: str, time: str = "ts") -> DataFrame:
    """All files there are, collected once each through a stream, and counted by window through another: the counts."""
    once, counts = new_path(spark, "stream"), new_path(spark, "stream-counts")
    steps = step_stream(spark, path, schema, time)
    collect_once(steps, key, once, new_path(spark, "stream-state")).awaitTermination()
    rows = spark.readStream.schema(steps.schema).parquet(f"{once}/_batch=*").withWatermark(time, "1 hour")
    count_windows(rows, by, counts, new_path(spark, "stream-state"), time=time).awaitTermination()
    return spark.read.parquet(counts)
