"""Archives and literal lines as data sources: ``register(spark)``, then ``spark.read.format("zip_lines").load(path)``.

Partitions are planned from what a file's directory or size says, without its content: a zip archive by its members, a
tar archive whole (it has no directory), a file of Python literals by byte ranges.  Filters on path and member are
pushed into the plan, so that members that can't match are never opened.
"""

from __future__ import annotations

import ast
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from optika.sources.files import opened

#: Members of about so many bytes are one task; a larger one stands alone.  Byte ranges have this size.
PART_BYTES = 64 << 20
_BATCH = 4096


def _paths(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """Files at or below a path, with their sizes."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")
    scheme = "" if ":" not in path.split("/")[0] else path[: path.index(name)] if name in path else ""
    info = where.get_file_info(name)
    found = [info] if info.is_file else where.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted((scheme + f.path, f.size) for f in found if f.is_file and (info.is_file or f.path.endswith(suffixes)))


def _test(f: Filter):
    """A pushed filter as a test of one column's value; None if it is not one of those."""
    column, v = getattr(f, "attribute", ()), getattr(f, "value", None)
    if column not in (("path",), ("member",)):
        return None
    kinds = {EqualTo: lambda x: x == v, In: lambda x: x in v, StringContains: lambda x: v in x, StringEndsWith: lambda x: x.endswith(v), StringStartsWith: lambda x: x.startswith(v)}
    return (column[0], kinds[type(f)]) if type(f) in kinds else None


@dataclass
class Members(InputPartition):
    path: str
    members: tuple[str, ...]

    def __init__(self, path, members):
        super().__init__(None)
        self.path, self.members = path, members


@dataclass
class Span(InputPartition):
    path: str
    start: int
    stop: int

    def __init__(self, path, start, stop):
        super().__init__(None)
        self.path, self.start, self.stop = path, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict, suffixes: tuple[str, ...]):
        self.path, self.wanted, self.suffixes, self.tests = options["path"], re.compile(options.get("members", ".")), suffixes, []
        self.part_bytes = int(options.get("partbytes", PART_BYTES))

    def pushFilters(self, filters: list[Filter]):
        """Takes the filters on path and member; Spark keeps the others."""
        for f in filters:
            if test := _test(f):
                self.tests.append(test)
            else:
                yield f

    def keeps(self, column: str, value: str) -> bool:
        return all(test(value) for c, test in self.tests if c == column)

    def member(self, name: str) -> bool:
        return not name.startswith("__MACOSX/") and not name.endswith("/") and bool(self.wanted.search(name)) and self.keeps("member", name)

    def files(self) -> list[tuple[str, int]]:
        return [(p, n) for p, n in _paths(self.path, self.suffixes) if self.keeps("path", p)]


_LINES = pa.schema([("path", pa.string()), ("member", pa.string()), ("line_no", pa.int64()), ("value", pa.string())])


def _lines(path: str, name: str, stream) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for i, line in enumerate(io.TextIOWrapper(stream, "utf-8-sig", errors="replace")):
        rows.append((path, name, i, line.rstrip("\r\n")))
        if len(rows) == _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=_LINES)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=_LINES)


class _ZipReader(_Reader):
    def partitions(self):
        out = []
        for path, _ in self.files():
            with opened(path) as f, zipfile.ZipFile(f) as z:
                names, size = [], 0
                for m in sorted(z.infolist(), key=lambda m: m.filename):
                    if self.member(m.filename):
                        if names and size + m.file_size > self.part_bytes:
                            out.append(Members(path, tuple(names)))
                            names, size = [], 0
                        names.append(m.filename)
                        size += m.file_size
                if names:
                    out.append(Members(path, tuple(names)))
        return out or [Members("", ())]

    def read(self, partition):
        if partition.members:
            with opened(partition.path) as f, zipfile.ZipFile(f) as z:
                for name in partition.members:
                    with z.open(name) as m:
                        yield from _lines(partition.path, name, m)


class _TarReader(_Reader):
    def partitions(self):
        return [Members(path, ()) for path, _ in self.files()] or [Members("", ())]

    def read(self, partition):
        if partition.path:
            with opened(partition.path) as f, tarfile.open(fileobj=f, mode="r:*") as t:
                for m in t:
                    if m.isfile() and self.member(m.name):
                        yield from _lines(partition.path, m.name, t.extractfile(m))


class _LiteralReader(_Reader):
    def partitions(self):
        return [Span(p, at, min(n, at + self.part_bytes)) for p, n in self.files() for at in range(0, n, self.part_bytes)] or [Span("", 0, 0)]

    def read(self, partition):
        """Lines that begin inside the span; the last may end beyond it."""
        if not partition.path:
            return
        fields = pa.map_(pa.string(), pa.string())
        with opened(partition.path) as f:
            at = max(0, partition.start - 1)
            f.seek(at)
            buffered = io.BufferedReader(f, 1 << 20)
            if partition.start:
                at += len(buffered.readline())  # what the span before reads
            rows = []
            while at < partition.stop and (line := buffered.readline()):
                if line.strip():
                    value = ast.literal_eval(line.decode("utf-8-sig" if at == 0 else "utf-8"))
                    rows.append((partition.path, at, [(str(k), None if v is None else str(v)) for k, v in value.items()]))
                at += len(line)
                if len(rows) == _BATCH:
                    yield self._batch(rows, fields)
                    rows = []
            if rows:
                yield self._batch(rows, fields)

    @staticmethod
    def _batch(rows, fields):
        p, o, m = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(p), pa.array(o, pa.int64()), pa.array(m, fields)], names=["path", "offset", "fields"])


class ZipLines(DataSource):
    """Lines of the members of zip archives.  Options: members (a pattern that names must hold), partBytes."""

    @classmethod
    def name(cls):
        return "zip_lines"

    def schema(self):
        return "path string, member string, line_no long, value string"

    def reader(self, schema):
        return _ZipReader(self.options, (".zip",))


class TarLines(ZipLines):
    """Lines of the files in tar archives, packed or not; an archive is one task's, as a stream."""

    @classmethod
    def name(cls):
        return "tar_lines"

    def reader(self, schema):
        return _TarReader(self.options, (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz"))


class PythonLiterals(DataSource):
    """Lines that are Python dictionaries: path, offset (first byte of the line), fields."""

    @classmethod
    def name(cls):
        return "python_literals"

    def schema(self):
        return "path string, offset long, fields map<string,string>"

    def reader(self, schema):
        return _LiteralReader(self.options, ("",))


def register(spark: SparkSession) -> None:
    for source in (ZipLines, TarLines, PythonLiterals):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
