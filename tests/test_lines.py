"""Numbered lines and ledgers of several JSONL files."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from optika.sources import io, lines

SCHEMA = "sample_id string, row_uid string, status string, predicted_position int, gold_position int, option_count int, probabilities array<double>, file string, latency double"


def ledger(rows, predictions=True):
    """What a ledger holds of one file, row by row."""
    text = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    ids = [str(r.get("sample_id") or r.get("row_uid")) for r in rows]
    seen, again = set(), []
    for i in ids:
        if i in seen and len(again) < 10:
            again.append(i)
        seen.add(i)
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    out = {"rows": len(rows), "unique_ids": len(seen), "duplicate_ids": again, "selection_sha256": sha(f"{i}\n" for i in sorted(ids)), "ordered_ids_sha256": sha(f"{i}\n" for i in ids)}
    empty = dict.fromkeys(["sample_id", "source", "status", "requested_model", "returned_model", "predicted_position", "gold_position", "option_count", "predicted_text", "gold_text", "probabilities", "correct", "error_type", "error"])
    records, decisions = [], []
    for i, r in zip(ids, rows, strict=True):
        k = r["option_count"]
        p = r.get("probabilities")
        whole = empty | {"sample_id": i, **{c: r.get(c) for c in ("status", "predicted_position", "gold_position", "option_count")}, "probabilities": [round(x, 4) for x in p[:k]] if p else None}
        records.append(text(whole))
        decisions.append(text({c: v for c, v in whole.items() if c != "probabilities"}))
    statuses = {}
    for r in rows:
        statuses[r.get("status", "missing")] = statuses.get(r.get("status", "missing"), 0) + 1
    pairs = lambda xs: sha(f"{i}\0{h}\n" for i, h in sorted((i, sha(x)) for i, x in zip(ids, xs, strict=True)))
    return out | {"statuses": statuses, "prediction_digest_sha256": pairs(records), "decision_digest_sha256": pairs(decisions), "ordered_prediction_digest_sha256": sha(f"{x}\n" for x in records)}


def panel(seed, n=400):
    """Answers to one panel; ids occur again, two fields vary from run to run."""
    out = []
    for i in range(n):
        r = {"sample_id": f"ü{(i * 7 + seed) % (n - 30)}", "predicted_position": (i * seed) % 3, "gold_position": i % 3, "option_count": 3, "probabilities": [0.12345 + i % 7 / 100, 0.3, [0.25, 0.0001, 0.00005, 1e-9][i % 4]], "latency": i * seed / 7, "file": "x"}
        if i % 5:
            r["status"] = "ok" if i % 3 else "error"
        if i % 11 == 0:
            r["row_uid"] = r.pop("sample_id")
        out.append(r)
    return out


def test_ledgers_of_several_files_with_the_same_ids(spark, tmp_path):
    files = {"a.jsonl": panel(1), "b.jsonl": panel(2), "c.jsonl.gz": panel(1), "deep/d.jsonl.gz": panel(3, 60)}
    raw = {}
    for name, rows in files.items():
        data = "".join(("\n" if i % 50 == 7 else "") + json.dumps(r, ensure_ascii=i % 2 == 0) + "\n" for i, r in enumerate(rows)).encode()
        path = tmp_path / "r" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
        raw[str(path)] = (path.read_bytes(), data, rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")  # several splits of a file
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {r["file"]: r.asDict() for where in ("r", "r/deep") for r in io.scan_jsonl(spark, f"file://{tmp_path}/{where}", SCHEMA, predictions=True).collect() if r["rows"]}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert set(got) == set(raw)
    for path, (packed, data, rows) in raw.items():
        want = ledger(rows) | {"file": path, "archive_bytes": len(packed), "archive_sha256": hashlib.sha256(packed).hexdigest(), "bytes": len(data), "content_sha256": hashlib.sha256(data).hexdigest()}
        assert got[path] == want
    a, c = (got[f"{tmp_path}/r/{n}"] for n in ("a.jsonl", "c.jsonl.gz"))
    assert a["prediction_digest_sha256"] == c["prediction_digest_sha256"] and a["content_sha256"] == c["content_sha256"] and a["archive_sha256"] != c["archive_sha256"]


def test_ledgers_without_predictions(spark, tmp_path):
    rows = panel(4, 50)
    (tmp_path / "x.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "empty.jsonl").write_text("\n")
    got = {r["file"].rsplit("/")[-1]: r.asDict() for r in io.scan_jsonl(spark, f"file://{tmp_path}", SCHEMA).collect()}
    assert {c: got["x.jsonl"][c] for c in ("rows", "unique_ids", "duplicate_ids", "selection_sha256", "ordered_ids_sha256")} == {c: ledger(rows)[c] for c in ("rows", "unique_ids", "duplicate_ids", "selection_sha256", "ordered_ids_sha256")}
    assert got["empty.jsonl"]["rows"] is None and got["empty.jsonl"]["bytes"] == 1


@pytest.mark.parametrize("line, what", [('{"sample_id": ""}', "no sample_id"), ("{broken", "not a JSON object"), ("[1]", "not a JSON object"), ('{"status": "ok"}', "no sample_id")])
def test_ledgers_name_what_they_refuse(spark, tmp_path, line, what):
    (tmp_path / "x.jsonl").write_text('{"sample_id": "a"}\n\n{"sample_id": 5}\n' + line + "\n")
    with pytest.raises(Exception, match=f"x.jsonl:4: {what}"):
        io.scan_jsonl(spark, f"file://{tmp_path}", SCHEMA).collect()


def test_numbers_of_lines_in_several_splits(spark, tmp_path):
    texts = {"a.txt": [f"line {i} " + "x" * (i % 90) for i in range(3000)], "b.txt": ["", "one", "", "two"], "c.txt.gz": [str(i) for i in range(500)]}
    for name, rows in texts.items():
        data = "".join(f"{r}\n" for r in rows).encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = lines.numbered(spark, f"file://{tmp_path}")
        assert df.select(F.count_distinct("file")).first()[0] == 3 and df.rdd.getNumPartitions() > 3
        got = sorted((r["file"].rsplit("/")[-1], r["line_no"], r["value"]) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((name, i, r) for name, rows in texts.items() for i, r in enumerate(rows, 1))


def test_bad_lines_of_two_files(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_text('{"a": 1}\n\n' + '{"a": 2}\n' * 5 + ("oops\n" if name == "b" else "{\n") + '{"a": 3}\n"text"\n')
    got = sorted((r["file"][-7:], r["line_no"], r["value"]) for r in lines.bad_lines(spark, f"file://{tmp_path}", "a int").collect())
    assert got == [("a.jsonl", 8, "{"), ("a.jsonl", 10, '"text"'), ("b.jsonl", 8, "oops"), ("b.jsonl", 10, '"text"')]
    with pytest.raises(ValueError, match="a.jsonl:8: not a JSON object"):
        io.require_jsonl(spark, f"file://{tmp_path}", "a int")
