"""JSON lines: one object a line, UTF-8, blank lines skipped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a file or folder (gzip too, one task a file). Without a value a column is null; broken lines fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> int:
    """Writes or appends and returns the number of rows written, counted on the way."""
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append" if append else "overwrite").json(path)
    return seen.get["n"]


def replace_jsonl(df: DataFrame, path: str) -> int:
    """Replaces a folder that ``df`` may itself read: writes beside it, then swaps; a failure leaves the old one whole."""
    spark = df.sparkSession
    fresh = f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex}"
    n = write_jsonl(df, fresh)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, made = hadoop(path), hadoop(fresh)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    old = hadoop(f"{fresh}.old")
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(made, target)
    fs.delete(old, True)
    return n
