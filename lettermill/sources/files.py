"""Listings of file trees and small input files."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.session import parallelism, ship

LISTING = "path string, size_bytes bigint, modified_at timestamp"


def read_bytes(path: str) -> bytes:
    """The contents of a file, local or named by the URI of a file system that Arrow knows."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    system, place = pafs.FileSystem.from_uri(quote(path, safe="/:@?&=+,;~%"))
    with system.open_input_stream(place) as f:
        return f.read()


def _walk(root: str, suffix: str, recursive: bool) -> Iterator[tuple[str, int, float]]:
    stack = [root]
    while stack:
        with os.scandir(stack.pop()) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    if recursive:
                        stack.append(e.path)
                elif os.path.splitext(e.name)[1].lower() == suffix and e.is_file():
                    s = e.stat()
                    yield e.path, s.st_size, s.st_mtime


def list_files(spark: SparkSession, root: str, suffix: str, recursive: bool = True) -> DataFrame:
    """(path, size_bytes, modified_at) of the files with a suffix in any case, hidden ones included.

    The folders right below ``root`` are walked in parallel by the tasks, which must see the file system. A
    missing root has no files. Spark's own file sources skip names with a leading dot or underscore; this
    doesn't.
    """
    ship(spark)
    folders, here = [], []
    if os.path.isdir(root):
        with os.scandir(root) as entries:
            for e in entries:
                (folders if e.is_dir(follow_symlinks=False) else here).append(e.path)
    start = [(root, False)] if here else []
    start += [(f, True) for f in sorted(folders)] if recursive else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, deep in zip(batch.column("folder").to_pylist(), batch.column("deep").to_pylist(), strict=True):
                rows, walker = [], _walk(folder, suffix, deep)
                for row in walker:
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield _listing(rows)
                        rows = []
                yield _listing(rows)

    frame = spark.createDataFrame(start, "folder string, deep boolean")
    return frame.repartition(max(1, min(len(start), parallelism(spark) * 4)), "folder").mapInArrow(run, LISTING)


def _listing(rows: list[tuple[str, int, float]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([int(r[2] * 1e6) for r in rows], pa.timestamp("us", "UTC"))],
        names=["path", "size_bytes", "modified_at"],
    )


def count_files(spark: SparkSession, root: str, suffix: str) -> int:
    return list_files(spark, root, suffix).count()


def has_files(spark: SparkSession, root: str, suffix: str) -> bool:
    return next(iter(_walk(root, suffix, True)), None) is not None if os.path.isdir(root) else False


def filter_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a text file."""
    with open(path, encoding="utf-8") as f:
        lines = [(k, line.rstrip("\r\n")) for k, line in enumerate(f, 1)]
    return spark.createDataFrame(lines, "line_no bigint, line string")


def discover_archives(raw: str) -> list[str]:
    """Archive paths of a folder, or of a comma-separated list."""
    raw = os.path.abspath(os.path.expanduser(raw.strip())) if "," not in raw else raw
    if os.path.isdir(raw):
        return sorted(os.path.join(raw, n) for n in os.listdir(raw) if n.lower().endswith(".pst"))
    return [os.path.abspath(os.path.expanduser(p.strip())) for p in raw.split(",") if p.strip()]


def sha256_file(path: str, chunk: int = 1 << 20) -> str:
    """Digest of a file of any size, read in chunks."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(chunk):
            digest.update(block)
    return digest.hexdigest()


def binary_digests(files: DataFrame) -> DataFrame:
    """Digest per file of a ``binaryFile`` relation."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))
