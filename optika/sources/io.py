"""Scans and sinks."""

from __future__ import annotations

import ast
import gzip
import io
import re
import tarfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optika.functions import text as T
from optika.sources.files import listed, opened
from optika.sources.lines import bad_lines, file_contents, file_ledger, scan_jsonl  # noqa: F401


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or .gz; a malformed line fails the job, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def require_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, checked: malformed lines are an error that names the first one's file and number."""
    if bad := bad_lines(spark, path, schema).orderBy("file", "line_no").limit(1).collect():
        raise ValueError(f"{bad[0]['file']}:{bad[0]['line_no']}: not a JSON object: {bad[0]['value'][:200]}")
    return read_jsonl(spark, path, schema)


def read_csv(spark: SparkSession, path: str, sep: str | None = None, **options) -> DataFrame:
    """CSV with a header, quoted line breaks allowed; a byte order mark is dropped.  .tsv files are split at tabs."""
    sep = sep or ("\t" if path.endswith(".tsv") else ",")
    df = spark.read.options(header=True, multiLine=True, escape='"', sep=sep, **options).csv(path)
    return df.toDF(*(c.removeprefix("﻿") for c in df.columns))


def read_parquet(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def read_splits(spark: SparkSession, paths: dict[str, str], reader: Callable[[str], DataFrame], optional: bool = False) -> DataFrame:
    """The union of a source's splits with a split column; with ``optional`` a split that is not there is left out."""
    jvm, out = spark._jvm, None
    for split, path in paths.items():
        if optional:
            p = jvm.org.apache.hadoop.fs.Path(path)
            if not p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p):
                continue
        df = reader(path).withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(str(paths))
    return out


def _members(kind: str, pattern: str):
    want = re.compile(pattern)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                rows: list[tuple] = []
                for name, stream in _open(kind, path):
                    if want.search(name):
                        for i, line in enumerate(io.TextIOWrapper(stream, "utf-8-sig", errors="replace")):
                            rows.append((path, name, i, line.rstrip("\r\n")))
                            if len(rows) == 4096:
                                yield pd.DataFrame(rows, columns=["path", "member", "line_no", "value"])
                                rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "member", "line_no", "value"])

    return run


def _open(kind: str, path: str) -> Iterator[tuple[str, object]]:
    """Members of an archive as streams, one at a time."""
    with opened(path) as f:
        if kind == "zip":
            with zipfile.ZipFile(f) as z:
                for name in sorted(z.namelist()):
                    if not name.startswith("__MACOSX/") and not name.endswith("/"):
                        with z.open(name) as m:
                            yield name, m
        else:
            with tarfile.open(fileobj=f, mode="r:*") as t:
                for m in t:
                    if m.isfile():
                        yield m.name, t.extractfile(m)


def read_archive_lines(spark: SparkSession, path: str, kind: str = "zip", member_pattern: str = ".") -> DataFrame:
    """Lines of the members of zip or tar archives: path, member, line_no, value.  One task streams one archive."""
    return listed(spark, path).mapInPandas(_members(kind, member_pattern), "path string, member string, line_no long, value string")


def archive_members(lines: DataFrame) -> DataFrame:
    """Whole members put together again: path, member, text."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "value")))
    return lines.groupBy("path", "member").agg(F.array_join(rows["value"], "\n").alias("text"))


def imdb_fields(member: str = "member") -> list:
    """Split, polarity, id and rating from a member's path."""
    pattern = r"(train|test)/(pos|neg)/([0-9]+)_([0-9]+)\.txt$"
    return [F.regexp_extract(member, pattern, i).alias(n) for i, n in enumerate(("split", "polarity", "number", "rating"), 1)]


def read_python_literals(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are Python dictionary literals, as a map of strings."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [{str(k): None if v is None else str(v) for k, v in ast.literal_eval(x).items()} for x in f["value"] if x.strip()]
            yield pd.DataFrame({"fields": rows})

    return spark.read.text(path).mapInPandas(run, "fields map<string,string>")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Canonical JSON lines: keys sorted at every depth, compact, nulls kept.  Returns the number of rows."""
    df.select(T.canonical_json(df).alias("value")).write.mode(mode).text(path)
    return df.sparkSession.read.text(path).count()


def write_json_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON records with NaN as null."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    write_jsonl(df.select(*clean), path, mode)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def replace_table(df: DataFrame, path: str, keep: int = 1) -> None:
    """Writes a new version beside the others, then switches the pointer file ``_current`` to it in one rename: readers
    (``read_table``) see the old or the new rows, and a crash leaves the old ones.  ``keep`` older versions stay."""
    spark = df.sparkSession
    version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path}/{version}")
    pointer, fs = _hadoop(spark, f"{path}/_current")
    staged, _ = _hadoop(spark, f"{path}/_current.{version}")
    out = fs.create(staged, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(staged, pointer, overwrite)
    old = sorted(s.getPath().getName() for s in fs.listStatus(pointer.getParent()) if s.getPath().getName().startswith("v-"))
    for name in old[: -1 - keep]:
        fs.delete(_hadoop(spark, f"{path}/{name}")[0], True)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table of ``replace_table``."""
    pointer, fs = _hadoop(spark, f"{path}/_current")
    stream = fs.open(pointer)
    version = bytes(stream.readAllBytes()).decode()
    stream.close()
    return spark.read.parquet(f"{path}/{version}")


def append_journal(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def gzip_bytes(data: bytes) -> bytes:
    """gzip whose bytes depend on the data only: no name, no time."""
    out = io.BytesIO()
    with gzip.GzipFile(filename="", fileobj=out, mode="wb", mtime=0) as f:
        f.write(data)
    return out.getvalue()


def summary_document(df: DataFrame, keys: list[str]) -> DataFrame:
    """A table of nested aggregates as one JSON document: objects by key, with the other columns as their fields.  For
    reports; the table has a row for each group, not for each item."""
    body = F.struct(*(c for c in df.columns if c not in keys))
    out = df.select(*keys, body.alias("_b"))
    for k in reversed(keys):
        rest = [c for c in out.columns if c not in (k, "_b")]
        out = out.groupBy(*rest).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(k).cast("string").alias("key"), F.col("_b").alias("value"))), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))).alias("_b"))
    return out.select(F.to_json("_b", {"ignoreNullFields": "false"}).alias("document"))
