"""WARC archives in Zstandard frames: a writer and a validating reader.

An archive begins with a skippable frame that holds the dictionary of its records; then each record is a frame of its
own, so that a reader decodes one record at a time and finds the next without an index.  Each task writes its own
archives with a dictionary trained on their first records, and each archive is read by one task as a stream: neither holds
more than a record, a read buffer and, when it trains, SAMPLE_BYTES of records.

Archives lie in the shared folder under names that no other attempt of a task uses; the table that the writer returns
names those of attempts that ended well, so that what lost or repeated attempts left is never read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from optika.llm.common import discard, materialize, scratch_root, small_batches

#: Payloads from this many bytes on are stored once.
LEAST_BYTES = 100
#: An archive of more is closed and the next begun; a dictionary has DICTIONARY_BYTES at most.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 64 << 20, 1 << 20, 32 << 10, 3
READ_BYTES = 1 << 16
#: Magic numbers of the formats: a dictionary's skippable frame, any skippable frame (its last four bits vary), a frame.
DICTIONARY_MAGIC, SKIPPABLE_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
#: Fields that every record must have.
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(uri: str):
    """The file system of a uri, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


# -- writing ----------------------------------------------------------------------------------------------------


def _urn(key: str) -> str:
    return f"<urn:uuid:{uuid.UUID(key[:32])}>"


def record_bytes(kind: str, record_id: str, date: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *fields, ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def _uri(url: str) -> str:
    """A uri for a header line: blanks and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def http_record(row: dict, date: str) -> bytes:
    """A response with its payload, or a revisit without."""
    fields = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"), ("WARC-Target-URI", _uri(row["url"] or f"urn:page:{row['page_id']}"))]
    if row["page_id"] is not None:
        fields.append(("X-Page-ID", str(row["page_id"])))
    payload = row["payload"]
    if row["refers_to_key"] is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(row["refers_to_key"]))]
        payload = b""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    return record_bytes("revisit" if row["refers_to_key"] is not None else "response", _urn(row["record_key"]), date, fields, head.encode() + payload)


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of at most DICTIONARY_BYTES; none where the samples are too few or too much alike."""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8) if size >= 512 and len(samples) >= 8 else None
    except zstandard.ZstdError:
        return None


class Archive:
    """An archive being written: its first records wait for the dictionary."""

    def __init__(self, path: str, date: str, sample: int):
        self.path, self.date, self.sample, self.waiting, self.held, self.records, self.bytes = path, date, sample, [], 0, 0, 0
        self.frames = None
        store, at = open_store(path)
        self.file = store.open_output_stream(at, compression=None)

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.bytes += len(data)

    def _begin(self) -> None:
        words = train(self.waiting)
        if words:
            raw = words.as_bytes()
            self._put(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
            words.precompute_compress(level=LEVEL)
        self.frames = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=True, write_checksum=True)
        info = record_bytes("warcinfo", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, self.path)}>", self.date, [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        self._put(self.frames.compress(info))
        for r in self.waiting:
            self._put(self.frames.compress(r))
        self.waiting = []

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.frames:
            self._put(self.frames.compress(record))
            return
        self.waiting.append(record)
        self.held += len(record)
        if self.held >= self.sample:
            self._begin()

    def close(self) -> tuple[str, int, int]:
        if not self.frames:
            self._begin()
        self.file.close()
        return self.path, self.records, self.bytes


def _writer(folder: str, date: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name, done, archive = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}", [], None
        for b in batches:
            for row in b.to_pylist():
                archive = archive or Archive(f"{name}-{len(done):04d}.warc.zst", date, min(SAMPLE_BYTES, most))
                archive.add(http_record(row, date))
                if archive.bytes >= most:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "records", "bytes"])

    return run


def archive_records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The records of pages (page_id, url, html): record_key, refers_to_key, page_id, url, payload, payload_bytes,
    payload_digest.

    Of payloads that are equal and have at least ``least_bytes`` that of the smallest page_id (nulls last, then by url)
    is stored, and the others refer to it; of rows that repeat as a whole one is the first.  A null html is an empty
    payload.  Payloads are shuffled once, by row; what is shuffled by payload are digests, added up before."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x1e"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    rows = rows.withColumn("row_key", F.sha2(F.concat_ws("\x1f", text("page_id"), text("url"), "payload_digest"), 256))
    light = rows.where(F.col("payload_bytes") >= least_bytes).select("row_key", "page_id", "url", "payload_digest")
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url", "row_key")
    firsts = light.groupBy("payload_digest").agg(F.min(order)["row_key"].alias("first"), F.count("*").alias("n")).where("n > 1")
    known = light.select(F.col("row_key").alias("_key"), "payload_digest").distinct().join(firsts, "payload_digest").select("_key", "first")
    joined = rows.join(known, F.col("row_key") == F.col("_key"), "left")
    copy = F.row_number().over(Window.partitionBy("row_key").orderBy("row_key"))  # the rows of a key are equal
    record = lambda key, n: F.sha2(F.concat_ws(":", key, n.cast("string")), 256)
    joined = joined.withColumn("copy", copy)
    again = F.col("first").isNotNull() & ((F.col("first") != F.col("row_key")) | (F.col("copy") > 1))
    return joined.select(
        record(F.col("row_key"), F.col("copy")).alias("record_key"), F.when(again, record(F.col("first"), F.lit(1))).alias("refers_to_key"), "page_id", "url",
        F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
    )


def write_archives(records: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes records of ``archive_records`` into archives under ``folder`` (a new one in the shared folder if none is
    given) and returns path, records and bytes of each.  No records: no archives."""
    spark = records.sparkSession
    small_batches(spark)
    folder = folder or f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    out = materialize(records.mapInArrow(_writer(folder, date, archive_bytes), "path string, records long, bytes long"), "archives")
    out._optika_archives = folder
    return out


# -- reading ----------------------------------------------------------------------------------------------------


class Damaged(ValueError):
    """What is wrong with a record, or with the rest of an archive."""


def frames(file, read_bytes: int = READ_BYTES) -> Iterator[tuple[int, bytes]]:
    """Offset and contents of each frame of a stream.  The dictionary comes from a leading skippable frame, itself
    compressed or not; other skippable frames are passed over.  Raises Damaged where the stream is no frame or is cut."""
    held, at, words = b"", 0, None

    def need(n: int) -> bool:
        nonlocal held
        while len(held) < n:
            more = file.read(max(read_bytes, n - len(held)))
            if not more:
                return False
            held += more
        return True

    decoder = zstandard.ZstdDecompressor()
    while need(1):
        start = at
        if not need(4):
            raise Damaged(f"cut off at {at}")
        (magic,) = struct.unpack("<I", held[:4])
        if magic & ~0xF == SKIPPABLE_MAGIC:
            if not need(8):
                raise Damaged(f"cut off at {at}")
            size = 8 + struct.unpack("<I", held[4:8])[0]
            if not need(size):
                raise Damaged(f"cut off in the skippable frame at {at}")
            if magic == DICTIONARY_MAGIC and at == 0:
                raw = held[8:size]
                if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                    raw = decoder.decompressobj().decompress(raw)
                words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT)
                decoder = zstandard.ZstdDecompressor(dict_data=words)
            held, at = held[size:], at + size
            continue
        if magic != FRAME_MAGIC:
            raise Damaged(f"no frame at {at}")
        need(18)  # the longest frame header
        try:
            size = zstandard.frame_content_size(held)
            one, parts = decoder.decompressobj(), []
            while not one.eof:
                if not held and not need(1):
                    raise Damaged(f"cut off in the frame at {start}")
                parts.append(one.decompress(held))
                at += len(held)
                held = one.unused_data if one.eof else b""
                at -= len(held)
        except zstandard.ZstdError as e:
            raise Damaged(f"frame at {start}: {e}") from None
        content = b"".join(parts)
        if size >= 0 and size != len(content):
            raise Damaged(f"frame at {start}: {len(content)} bytes, {size} declared")
        yield start, content


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (by lower-case name) and block of one record; raises Damaged where a rule of the format is broken."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise Damaged("header without an end")
    try:
        version, *lines = head.decode().split("\r\n")
    except UnicodeDecodeError:
        raise Damaged("header is not UTF-8") from None
    if not re.fullmatch(r"WARC/1\.[01]", version):
        raise Damaged(f"version {version[:20]!r}")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise Damaged(f"header line {line[:40]!r}")
        fields.setdefault(name.lower(), value.strip(" \t"))
    if gone := [f for f in REQUIRED if not fields.get(f.lower())]:
        raise Damaged(f"no {gone[0]}")
    if not re.fullmatch("[0-9]+", fields["content-length"]):
        raise Damaged(f"Content-Length {fields['content-length'][:20]!r}")
    n = int(fields["content-length"])
    if len(rest) != n + 4:
        raise Damaged(f"block of {len(rest) - 4} bytes, Content-Length {n}")
    if rest[n:] != b"\r\n\r\n":
        raise Damaged("no end after the block")
    return fields, rest[:n]


def http_payload(block: bytes) -> tuple[bytes, int | None]:
    """Payload of an HTTP message, and the length that its header declares."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        raise Damaged("no HTTP message")
    told = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", head)
    return payload, int(told[1]) if told else None


_RECORD = "archive string, offset long, record_id string, record_type string, page_id long, url string, refers_to_id string, payload binary, payload_bytes long, payload_digest string, fault string"
_FIELDS = [x.split()[0] for x in _RECORD.split(", ")]
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_SCHEMA = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in _RECORD.split(", ")])


def _record(data: bytes, payload: bool) -> dict:
    fields, block = parse_record(data)
    kind = fields["warc-type"]
    out = {"record_id": fields["warc-record-id"], "record_type": kind, "url": fields.get("warc-target-uri"), "refers_to_id": fields.get("warc-refers-to")}
    if fields.get("x-page-id"):
        out["page_id"] = int(fields["x-page-id"])
    declared = re.match("sha256:([0-9a-f]{64})$", fields.get("warc-payload-digest", ""))
    if kind == "response":
        body, told = http_payload(block)
        digest = hashlib.sha256(body).hexdigest()
        if told is not None and told != len(body):
            raise Damaged(f"payload of {len(body)} bytes, {told} declared")
        if declared and declared[1] != digest:
            raise Damaged("payload digest differs")
        out |= {"payload_bytes": len(body), "payload_digest": digest} | ({"payload": body} if payload else {})
    elif kind == "revisit":
        if not out["refers_to_id"]:
            raise Damaged("revisit without WARC-Refers-To")
        out |= {"payload_bytes": http_payload(block)[1], "payload_digest": declared and declared[1]}
    return out


def _reader(payload: bool, batch_bytes: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = open_store(path)
                with store.open_input_stream(at, compression=None) as file:
                    try:
                        for offset, data in frames(file):
                            row = {"archive": path, "offset": offset}
                            try:
                                row |= _record(data, payload)
                            except Damaged as e:
                                row["fault"] = str(e)
                            rows.append(row)
                            held += 500 + len(row.get("payload") or b"")
                            if held >= batch_bytes:
                                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                                rows, held = [], 0
                    except Damaged as e:  # where the next record begins is not known
                        rows.append({"archive": path, "fault": str(e)})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return run


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """The records of archives (path), each archive as a stream in one task: archive, offset, record_id, record_type,
    page_id, url, refers_to_id, payload (null without ``payload``), payload_bytes, payload_digest, fault.

    A record that breaks the format is a row with its fault; an archive that can't be decoded further ends with such a
    row.  Other record types keep their row.  Archives of other writers need no page ids and no declared digest."""
    paths = archives.select("path")
    return paths.repartition(max(1, archives.count())).mapInArrow(_reader(payload), _RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Responses and revisits of ``read_archives`` (payloads aside) with the full payload's length and digest and
    refers_to, the page_id of the response that a revisit stands for.  Fails at a fault, at a revisit whose response is
    not there, and where the two disagree."""
    stop = lambda what, where: F.raise_error(F.concat(F.lit(what), F.coalesce(where, F.lit("")))).cast("boolean")
    sound = records.where(F.when(F.col("fault").isNotNull(), stop("fault in an archive: ", F.concat_ws(": ", "archive", "fault"))).otherwise(True))
    responses = sound.where("record_type = 'response'")
    target = responses.select(F.col("record_id").alias("_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    again = sound.where("record_type = 'revisit'").join(target, F.col("refers_to_id") == F.col("_id"), "left")
    fits = F.col("_id").isNotNull() & F.coalesce(F.col("payload_digest") == F.col("_digest"), F.lit(True)) & F.coalesce(F.col("payload_bytes") == F.col("_bytes"), F.lit(True))
    again = again.where(F.when(fits, True).otherwise(stop("revisit without its response: ", F.col("record_id"))))
    columns = ["page_id", "url", "record_id", "record_type"]
    first = responses.select(*columns, "payload_bytes", "payload_digest", F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(again.select(*columns, F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "refers_to"))


def drop_archives(spark: SparkSession, archives: DataFrame) -> None:
    """Deletes the archives of ``write_archives`` and their table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(archives._optika_archives)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    discard(archives)


def op13_warc(spark, sf_dir: str) -> DataFrame:
    """Writes all pages into archives, reads them back and gives what was read: one row a page.  A null page_id stays
    null; rows that repeat stay apart; an empty table gives no rows."""
    archives = write_archives(archive_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    records = materialize(read_archives(archives, payload=False).drop("payload"), "records")
    drop_archives(spark, archives)
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN strlen(html) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= 100 AND page_id > first THEN first END AS refers_to
FROM (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first
      FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))
"""
