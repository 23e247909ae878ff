"""JSONL files: numbered lines, and a ledger of several files in one pass over their rows."""

from __future__ import annotations

import gzip
import hashlib
import heapq
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from optika.functions import text as T
from optika.sources.files import listed, opened


def _file(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files with their numbers: file, line_no (from 1, blank lines count), value.

    A split's lines are numbered where they are read and shifted by the lines of the splits before it, which a first scan
    counts, a row for each split; no text is shuffled or written, and nothing passes the driver.  A .gz file is one split.
    The job fails if the files were split in another way between the two scans."""
    lines = spark.read.text(path).select(_file(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("_block"), "value")
    lines = lines.withColumn("_at", F.monotonically_increasing_id())  # rises with the lines of a split
    sizes = lines.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("file").alias("_f"), F.col("_block").alias("_b"), "_first", "_n", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = lines.join(sizes, (F.col("file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    inside = F.col("_at") - F.col("_first")
    same = F.when(inside.between(0, F.col("_n") - 1), True).otherwise(F.raise_error(F.lit("files were split anew between two scans")).cast("boolean"))
    return joined.where(same).select("file", (inside + F.col("_before") + 1).alias("line_no"), "value")


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Malformed lines of JSONL files (plain or .gz): file, line_no, value."""
    lines = numbered(spark, path)
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.where(T.trim_blanks(F.col("value")) != "").withColumn("_p", parsed).where("_p._bad IS NOT NULL").select("file", "line_no", "value")


def _contents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path in frame["path"]:
            digest, size = hashlib.sha256(), 0
            with opened(path) as f:
                while block := f.read(1 << 20):
                    digest.update(block)
                    size += len(block)
            inner, plain = digest, size
            if path.endswith(".gz"):
                inner, plain = hashlib.sha256(), 0
                with opened(path) as f, gzip.GzipFile(fileobj=f) as z:
                    while block := z.read(1 << 20):
                        inner.update(block)
                        plain += len(block)
            yield pd.DataFrame([(path, size, digest.hexdigest(), plain, inner.hexdigest())], columns=["path", "archive_bytes", "archive_sha256", "bytes", "content_sha256"])


def file_contents(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, archive_bytes, archive_sha256, and bytes and content_sha256 of what a .gz file holds (else the same)."""
    return listed(spark, path, recursive).mapInPandas(_contents, "path string, archive_bytes long, archive_sha256 string, bytes long, content_sha256 string")


def file_ledger(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, bytes, sha256 of each file below a folder, read as a stream."""
    return file_contents(spark, path, recursive).select("path", F.col("archive_bytes").alias("bytes"), F.col("archive_sha256").alias("sha256"))


#: What a fold reads its rows for: the order of lines; ids with their lines; ids with record hashes; with decision hashes.
_ORDER, _IDS, _RECORDS, _DECISIONS = range(4)
#: Repeated ids that a ledger names.
FIRST_REPEATS = 10


class _Fold:
    """One reading of one file, row by row; it holds a digest or two and, of ids, the one before."""

    def __init__(self, file: str, kind: int):
        self.file, self.kind, self.digest, self.second = file, kind, hashlib.sha256(), hashlib.sha256()
        self.rows = self.unique = 0
        self.before, self.again, self.statuses = None, [], Counter()

    def row(self, at: int, key: str, body: str | None) -> None:
        if self.kind == _ORDER:
            self.digest.update(f"{key}\n".encode())
            if body is not None:
                self.second.update(f"{body}\n".encode())
        elif self.kind == _IDS:
            self.digest.update(f"{key}\n".encode())
            self.rows += 1
            if body is not None:
                self.statuses[body] += 1
            if key != self.before:
                self.before, self.unique = key, self.unique + 1
            elif len(self.again) < FIRST_REPEATS:
                heapq.heappush(self.again, (-at, key))
            else:
                heapq.heappushpop(self.again, (-at, key))
        else:
            self.digest.update(f"{key}\0{body}\n".encode())

    def told(self) -> dict:
        out = {"file": self.file, "kind": self.kind, "digest": self.digest.hexdigest()}
        if self.kind == _ORDER:
            out["second"] = self.second.hexdigest()
        if self.kind == _IDS:
            out |= {"rows": self.rows, "unique_ids": self.unique, "duplicate_ids": [k for _, k in sorted(self.again, reverse=True)], "statuses": sorted(self.statuses.items())}
        return out


_TOLD = pa.schema([("file", pa.string()), ("kind", pa.int32()), ("digest", pa.string()), ("second", pa.string()), ("rows", pa.int64()), ("unique_ids", pa.int64()), ("duplicate_ids", pa.list_(pa.string())), ("statuses", pa.map_(pa.string(), pa.int64()))])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fold, out = None, []
    for b in batches:
        for file, kind, at, key, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if fold is None or (file, kind) != (fold.file, fold.kind):
                if fold:
                    out.append(fold.told())
                fold = _Fold(file, kind)
            fold.row(at, key, body)
    if fold:
        out.append(fold.told())
    yield pa.RecordBatch.from_pylist(out, _TOLD)


def scan_jsonl(spark: SparkSession, path: str, schema: str, predictions: bool = False) -> DataFrame:
    """A ledger of the JSONL files (plain or .gz) below a path, a row for each file, whatever ids they share: file,
    archive_bytes, archive_sha256, bytes, content_sha256 (exact bytes, packed and not), rows, unique_ids,
    duplicate_ids (the first ten occurrences of ids seen earlier in the file), selection_sha256 (sorted ids) and
    ordered_ids_sha256 (in file order); with ``predictions`` also statuses, prediction_digest_sha256,
    decision_digest_sha256 (sorted by id and hash) and ordered_prediction_digest_sha256.

    The id is sample_id, or row_uid where that is missing or empty; a row without one, or a malformed line, fails the job
    and names its file and line.  Rows are parsed once; each gives a light row for every reading (line order, ids,
    records, decisions), all readings are sorted in one shuffle by (file, reading), and each is folded as a stream in
    constant memory."""
    from optika.operators import results

    lines = numbered(spark, path).where(T.trim_blanks(F.col("value")) != "").select(F.col("file").alias("_file"), F.col("line_no").alias("_line"), "value")
    parsed = lines.withColumn("_p", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    names = parsed.select("_p.*").columns
    have = lambda c: F.nullif(F.col(f"_p.{c}").cast("string"), F.lit("")) if c in names else F.lit(None).cast("string")
    key = F.coalesce(have("sample_id"), have("row_uid"))
    where = F.concat(F.col("_file"), F.lit(":"), F.col("_line").cast("string"))
    fault = F.when(F.col("_p._bad").isNotNull(), "not a JSON object").when(key.isNull(), "no sample_id")
    sound = F.when(fault.isNull(), True).otherwise(F.raise_error(F.concat(where, F.lit(": "), fault)).cast("boolean"))
    rows = parsed.where(sound).select("_file", "_line", key.alias("_key"), "_p.*").drop("_bad", "sample_id").withColumnRenamed("_key", "sample_id")
    none = F.lit(None).cast("string")
    reading = lambda kind, body: F.struct(F.lit(kind).alias("kind"), body.alias("body"))
    if predictions:
        told = results.unify(rows, ["_file", "_line"])
        whole, decision = results.stable_record(told), results.stable_record(told, False)
        whole = results.stable_record(told, keep=["_file", "_line"])
        record, plain = T.canonical_json(whole, *(c for c in whole.columns if c not in ("_file", "_line"))), T.canonical_json(whole, *decision.columns)
        parts = whole.select("_file", "_line", "sample_id", record.alias("_record"), F.sha2(plain, 256).alias("_decision"), F.coalesce("status", F.lit("missing")).alias("_status"))
        readings = F.array(reading(_ORDER, F.col("_record")), reading(_IDS, F.col("_status")), reading(_RECORDS, F.sha2("_record", 256)), reading(_DECISIONS, F.col("_decision")))
    else:
        parts = rows.select("_file", "_line", "sample_id")
        readings = F.array(reading(_ORDER, none), reading(_IDS, none))
    light = parts.select(F.col("_file").alias("file"), "_line", "sample_id", F.explode(readings).alias("r")).select("file", "r.kind", F.when(F.col("r.kind") <= _IDS, F.col("_line")).alias("at"), F.col("sample_id").alias("key"), "r.body")
    # line order sorts by place alone; the others by id, then by place or hash
    first = F.when(F.col("kind") == _ORDER, F.col("at"))
    second = F.when(F.col("kind") != _ORDER, F.col("key"))
    last = F.when(F.col("kind") == _IDS, F.col("at"))
    sorted_ = light.repartition("file", "kind").sortWithinPartitions("file", "kind", first, second, last, "body")
    folded = sorted_.select("file", "kind", "at", "key", "body").mapInArrow(_fold, "file string, kind int, digest string, second string, rows long, unique_ids long, duplicate_ids array<string>, statuses map<string,long>")
    of = lambda kind, c: F.max_by(c, F.when(F.col("kind") == kind, 1))
    columns = [of(_IDS, "rows").alias("rows"), of(_IDS, "unique_ids").alias("unique_ids"), of(_IDS, "duplicate_ids").alias("duplicate_ids"), of(_IDS, "digest").alias("selection_sha256"), of(_ORDER, "digest").alias("ordered_ids_sha256")]
    if predictions:
        columns += [of(_IDS, "statuses").alias("statuses"), of(_RECORDS, "digest").alias("prediction_digest_sha256"), of(_DECISIONS, "digest").alias("decision_digest_sha256"), of(_ORDER, "second").alias("ordered_prediction_digest_sha256")]
    out = folded.groupBy("file").agg(*columns)
    contents = file_contents(spark, path).withColumn("file", _file(F.col("path"))).drop("path")
    return contents.join(out, "file", "left")
