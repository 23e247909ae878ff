import hashlib
import io
import struct

import pytest
import zstandard

from optika.llm import warc
from optika.llm.queries import ORACLES, QUERIES

SCHEMA = "page_id long, url string, html string"


def told(rows):
    """Expected (page_id, payload_bytes, payload_digest, record_type, refers_to), sorted."""
    first, out, seen = {}, [], set()
    rows = [(i, u, (h or "").encode()) for i, u, h in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    for r in sorted(rows, key=key):
        first.setdefault(r[2], r[0])
    for i, _, p in sorted(rows, key=key):
        again = len(p) >= 100 and p in seen
        seen.add(p)
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=str)


def hard_pages():
    long = "<p>" + "ä 文 \x00\r\n\r\n" * 400_000
    return [
        (5, "http://a/", "x" * 100), (2, "http://b/ \r\nX: y", "x" * 100), (9, None, "x" * 100), (None, "http://c/", "x" * 100), (1, "http://d/", "x" * 99), (3, "http://e/", "x" * 99), (4, "", None), (6, None, ""), (7, "u", long), (8, "u", long),
        (2, "http://b/ \r\nX: y", "x" * 100), (None, "http://c/", "x" * 100), (10, "é", "HTTP/1.1 200 OK\r\n\r\n" * 9), (11, "z", "WARC/1.1\r\n\r\n" * 30), (None, None, None), (12, "q", "y" * 200), (12, "p", "y" * 200),
    ] + [(100 + i, f"http://h/{i}", f"<html><body><p>Page {i % 37} of many pages</p>" + "<div class='menu'>item</div>" * (i % 11)) for i in range(400)]


def pages(spark, rows):
    extra = ("k", 1, "r", b"p", 2, "f", True)
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA + ", row_key string, copy long, first string, payload binary, n long, refers_to string, no_id boolean")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    import duckdb

    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    got = QUERIES["op13_warc"](spark, d)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['op13_warc']})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and want


@pytest.mark.parametrize("most", [64 << 20, 3000])
def test_round_trip_of_hard_rows(spark, most):
    rows = hard_pages()
    archives = warc.write_archives(warc.archive_records(pages(spark, rows)), archive_bytes=most)
    read = warc.read_archives(archives).cache()
    assert read.where("fault IS NOT NULL").count() == 0 and archives.agg({"records": "sum"}).first()[0] == len(rows)
    assert (archives.count() > 20) == (most == 3000)
    got = warc.resolved(read).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == told(rows)
    bodies = {(h or "").encode() for _, _, h in rows}
    assert {bytes(r["payload"]) for r in read.where("record_type = 'response'").collect()} == bodies
    assert read.where("record_type = 'warcinfo'").count() == archives.count()
    assert read.select("record_id").distinct().count() == read.count()
    warc.drop_archives(spark, archives)


def test_empty_table(spark):
    archives = warc.write_archives(warc.archive_records(pages(spark, hard_pages()).limit(0)))
    assert archives.count() == 0 and warc.resolved(warc.read_archives(archives)).count() == 0


def record(body=b"hello", kind="response", **change):
    fields = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:1>", "WARC-Date": "2020-01-01T00:00:00Z"} | change
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    fields.setdefault("Content-Length", str(len(block)))
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def words():
    return zstandard.train_dictionary(1024, [record(b"some html of page %d" % i * 9) for i in range(200)], k=64, d=8)


@pytest.mark.parametrize("packed", [False, True])
def test_dictionary_frame(packed):
    """The dictionary of a leading skippable frame is used, compressed or not; another skippable frame is passed over."""
    d = words()
    raw = zstandard.compress(d.as_bytes()) if packed else d.as_bytes()
    c = zstandard.ZstdCompressor(dict_data=d)
    skip = struct.pack("<II", 0x184D2A50, 5) + b"other"
    data = struct.pack("<II", warc.DICTIONARY_MAGIC, len(raw)) + raw + c.compress(record(b"a")) + skip + c.compress(record(b"b" * 300_000)) + c.compress(record(b""))
    for size in (1, 7, 1 << 16):
        assert [warc._record(x, True)["payload"] for _, x in warc.frames(io.BytesIO(data), size)] == [b"a", b"b" * 300_000, b""]
    assert len(list(warc.frames(io.BytesIO(zstandard.compress(b"x") * 3)))) == 3
    assert list(warc.frames(io.BytesIO(b""))) == []
    for n in (3, 6, 100, len(data) - 1):
        with pytest.raises(warc.Damaged):
            list(warc.frames(io.BytesIO(data[:n])))
    with pytest.raises(warc.Damaged):  # the dictionary is gone
        list(warc.frames(io.BytesIO(data[8 + len(raw) :])))


@pytest.mark.parametrize(
    "data, what",
    [
        (b"WARC/9.9" + record()[8:], "version"), (record(**{"WARC-Date": None}), "no WARC-Date"), (record(**{"Content-Length": "4"}), "Content-Length 4"), (record(**{"Content-Length": "-4"}), "Content-Length"), (record(**{"Content-Length": "400"}), "Content-Length 400"),
        (record()[:-4] + b"....", "no end"), (record()[:-2], "block of"), (b"WARC/1.0\r\nno colon\r\n\r\n", "header line"), (b"WARC/1.0\r\nA: b", "header without"), (b"WARC/1.0\r\nA: \xff\r\n\r\n", "UTF-8"), (b"", "header without"),
        (record(**{"WARC-Payload-Digest": "sha256:" + "0" * 64}), "digest"), (record(kind="revisit"), "WARC-Refers-To"), (record().replace(b"Content-Length: 5", b"Content-Length: 6"), "declared"), (record().replace(b"HTTP/1.1", b"FTP /1.1"), "no HTTP"),
    ],
)
def test_broken_records(data, what):
    with pytest.raises(warc.Damaged, match=what):
        warc._record(data, True)


def test_faults_are_rows(spark, tmp_path):
    """A broken record does not end an archive; a broken frame does, and other archives go on."""
    z = zstandard.compress
    (tmp_path / "a.warc.zst").write_bytes(z(record(b"1")) + z(record()[:-1]) + z(record(b"2")) + b"junk")
    (tmp_path / "b.warc.zst").write_bytes(z(record(b"3")) + z(b"x" * 1000 + bytes(range(256)) * 9)[:-3])
    (tmp_path / "c.warc.zst").write_bytes(z(record(b"4", kind="metadata")))
    read = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/{c}.warc.zst",) for c in "abc"], "path string"))
    got = {(r["archive"][-10], r["payload"] and bytes(r["payload"]), r["record_type"], r["fault"] is not None) for r in read.collect()}
    assert got == {("a", b"1", "response", False), ("a", None, None, True), ("a", b"2", "response", False), ("b", b"3", "response", False), ("b", None, None, True), ("c", None, "metadata", False)}
    with pytest.raises(Exception, match="fault in an archive"):
        warc.resolved(read).collect()


def test_revisit_without_its_response(spark, tmp_path):
    (tmp_path / "a.warc.zst").write_bytes(zstandard.compress(record(b"", "revisit", **{"WARC-Refers-To": "<urn:uuid:2>"})))
    with pytest.raises(Exception, match="revisit without its response"):
        warc.resolved(warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/a.warc.zst",)], "path string"))).collect()
