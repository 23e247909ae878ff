"""Listing and opening files of any store that driver and executors reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def opened(path: str):
    """A seekable stream of a file as it is; nothing is read ahead."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return where.open_input_file(name)


def listed(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path and length of the files, without their content, dealt out to as many tasks as there are files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", "length")
    return files.repartition(max(1, min(files.count(), 10_000)), "path")
