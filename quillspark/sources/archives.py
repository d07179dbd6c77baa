"""Zip archives of JSON maps, id lists and csv mappings, reports."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def zipped_maps(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """key and value (JSON text) of all maps in the .json members of zip files; damaged or empty files give nothing.

    ``wanted`` (a column key) keeps some keys. Files are read by executors, one at a time.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in z.namelist():
                            if name.endswith(".json"):
                                found = json.loads(z.read(name).decode("utf-8"))
                                if isinstance(found, dict):
                                    rows += [(str(k), json.dumps(v, ensure_ascii=False)) for k, v in found.items()]
                except (zipfile.BadZipFile, ValueError):
                    rows = []
                yield pd.DataFrame(rows, columns=["key", "value"])

    out = spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "key string, value string")
    return out if wanted is None else out.join(wanted.select(F.col("key").cast("string")).distinct(), "key", "left_semi")


def tar_members(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """stem, name and content of the files in tar archives (plain or compressed); a damaged archive gives what precedes the damage.

    ``wanted`` (a column stem) keeps some. An archive is read by one task.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                try:
                    with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as bundle:
                        for member in bundle:
                            if member.isfile():
                                name = member.name.rsplit("/", 1)[-1]
                                yield pd.DataFrame([(name.rsplit(".", 1)[0], member.name, bundle.extractfile(member).read())], columns=["stem", "name", "content"])
                except (tarfile.TarError, EOFError, OSError):
                    continue

    out = spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "stem string, name string, content binary")
    return out if wanted is None else out.join(wanted.select("stem").distinct(), "stem", "left_semi")


def wanted_targets(spark: SparkSession, ids_path: str, csv_path: str) -> DataFrame:
    """image_id, source_path of all ids of a text list, from a csv mapping without header; ids without one are an error."""
    ids = spark.read.text(ids_path).select(F.trim("value").alias("image_id")).where("image_id <> ''").distinct()
    pairs = spark.read.schema("image_id string, source_path string").csv(csv_path)
    missing = ids.join(pairs, "image_id", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} image ids are absent from the mapping")
    return pairs.join(ids, "image_id", "left_semi")


def write_report(summary: DataFrame, records: DataFrame, path: str) -> None:
    """The one-row summary as a JSON line under ``summary``, its records as JSON lines under ``records``."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    records.write.mode("overwrite").json(f"{path}/records")
