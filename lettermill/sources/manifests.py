"""Manifests as CSV files and as tables."""

from __future__ import annotations

import csv
import os
import shutil
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions import text as TX
from lettermill.schema import MANIFEST, MANIFEST_FIELDS, STORED_MANIFEST


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A manifest file as (seq, columns): '' for absent values, unknown columns dropped, missing ones ''.

    A missing file is an empty manifest. Quoted line ends need whole files, so each file is one task, which
    also keeps its row order for ``seq``.
    """
    if not os.path.exists(path):
        return spark.createDataFrame([], STORED_MANIFEST)
    raw = spark.read.options(header=True, multiLine=True, quote='"', escape='"', inferSchema=False).csv(path)
    have = {c.lower(): c for c in raw.columns}
    columns = [TX.blank_if_null(F.col(f"`{have[f]}`")).alias(f) if f in have else F.lit("").alias(f) for f in MANIFEST_FIELDS]
    return raw.withColumn("seq", F.monotonically_increasing_id()).select("seq", *columns)


def write_csv(rows: DataFrame, path: str, order: str | None = "seq") -> int:
    """One CSV file of the manifest's columns, in order; rows are streamed through the driver, not gathered."""
    temp = f"{path}.tmp"
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    n = 0
    with open(temp, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f)
        writer.writerow(MANIFEST_FIELDS)
        ordered = rows.orderBy(order) if order else rows
        for row in ordered.select(*[f"`{c}`" for c in MANIFEST_FIELDS]).toLocalIterator():
            writer.writerow(["" if v is None else v for v in row])
            n += 1
    os.replace(temp, path)
    return n


def append_table(rows: DataFrame, path: str) -> None:
    """Append rows to the stored manifest; Spark commits a batch as a whole."""
    rows.write.mode("append").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    if not os.path.exists(path):
        return spark.createDataFrame([], STORED_MANIFEST)
    return spark.read.parquet(path)


def backup(path: str) -> str | None:
    """A copy beside the file, stamped with the time."""
    if not os.path.exists(path):
        return None
    target = f"{path}.bak_{datetime.now():%Y%m%d_%H%M%S}"
    shutil.copy2(path, target)
    return target


__all__ = ["MANIFEST", "append_table", "backup", "read_csv", "read_table", "write_csv"]
