"""Encoded units as a table that later runs reuse: built again only when the corpus changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(corpus: DataFrame) -> str:
    """Changes with any document's id, title, text, image or entity, and with their number; not with the order of rows."""
    cols = [c for c in ("doc_id", "title", "text", "image_path", "entity_id") if c in corpus.columns]
    row = corpus.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return f"{row['n']}:{row['s']}"


def save_units(units: DataFrame, path: str, mark: str) -> None:
    """Writes units with their embedding, and the fingerprint they belong to."""
    units.write.mode("overwrite").parquet(f"{path}/units")
    units.sparkSession.createDataFrame([(mark,)], "mark string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_units(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    return spark.read.parquet(f"{path}/units"), spark.read.schema("mark string").json(f"{path}/meta").first()["mark"]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_or_build(corpus: DataFrame, path: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stored units if they belong to this corpus, else built, stored and read again."""
    spark = corpus.sparkSession
    mark = fingerprint(corpus)
    if not (_exists(spark, f"{path}/meta") and load_units(spark, path)[1] == mark):
        save_units(build(corpus), path, mark)
    return load_units(spark, path)[0]


def invalidate(spark: SparkSession, *paths: str) -> int:
    """Deletes stored indexes; returns how many there were."""
    n = 0
    for path in paths:
        if _exists(spark, path):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            n += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    return n
