"""Early-stopping scans, rules as data, archives as data sources, and keyed state in a stream."""

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from optika.operators import results, rules
from optika.operators.rules import Rule
from optika.sources import formats, restore
from optika.streaming import keyed


def raw_files(spark, folder, files=20):
    """Rows in files by key range; key 7 is in two files, and one key is null."""
    rows = spark.range(4000).selectExpr("id as k", "concat('text ', id) t").unionByName(spark.createDataFrame([(7, "again"), (None, "null")], "k long, t string"))
    for i in range(files):
        low = i * 4000 // files
        part = rows.where((F.col("k") >= low) & (F.col("k") < low + 4000 // files) & (F.col("t") != "again") | F.lit(i == 3) & ((F.col("t") == "again") | F.col("k").isNull()))
        part.coalesce(1).write.parquet(f"{folder}/{i:03}")
    return [f"{folder}/{i:03}" for i in range(files)]


def test_a_scan_stops_when_all_is_found(spark, tmp_path):
    files, seen = raw_files(spark, tmp_path), []

    def read(some):
        seen.append(list(some))
        return spark.read.parquet(*some)

    wanted = spark.createDataFrame([(3,), (7,), (850,), (7,), (None,)], "k long")
    got = restore.restore(spark, files, read, wanted, "k", first_wave=1)
    assert sorted(map(tuple, got.rows.collect())) == [(3, "text 3"), (7, "text 7"), (850, "text 850")]  # the first file's row of 7
    assert got.read == files[:7] and got.unread == files[7:] and got.missing.count() == 0  # waves of 1, 2 and 4
    assert [len(s) for s in seen if s != files[:1]] == [2, 4]
    full = spark.read.parquet(*files).join(wanted.where("k <> 7"), "k", "left_semi")
    assert sorted(map(tuple, got.rows.where("k <> 7").collect())) == sorted(map(tuple, full.collect()))


def test_a_scan_reads_all_for_a_key_that_is_nowhere(spark, tmp_path):
    files = raw_files(spark, tmp_path, 5)
    got = restore.restore(spark, files, lambda some: spark.read.parquet(*some), spark.createDataFrame([(1,), (9999,)], "k long"), "k", first_wave=2)
    assert [r.k for r in got.rows.collect()] == [1] and [r.k for r in got.missing.collect()] == [9999] and not got.unread
    none = restore.restore(spark, files, lambda some: spark.read.parquet(*some), spark.createDataFrame([(None,)], "k long"), "k")
    assert none.rows.count() == 0 and none.unread == files


@pytest.mark.parametrize("most_bits", [64, 1 << 27])
def test_membership_holds_every_key_and_few_others(spark, most_bits):
    ids = spark.range(0, 6000, 3).withColumnRenamed("id", "k")
    test = restore.membership(ids, "k", 2000, most_bits)
    passed = spark.range(6000).where(test(F.col("id")))
    assert passed.where("id % 3 = 0").count() == 2000
    others = passed.where("id % 3 <> 0").count()
    assert others < 100 if most_bits > 64 else others > 3000  # a full filter lets all through
    plan = passed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_rules(spark):
    df = spark.createDataFrame([(1, "a", "a", 5, None), (2, "b", "a", None, "x"), (3, None, None, 50, None)], "k int, x string, y string, n int, z string")
    said = [Rule("xy", "x", "same", "y"), Rule("x_is_a", "x", "equals", "a"), Rule("known", "x", "one_of", ["a", "c"]), Rule("n", "n", "between", (1, 9)), Rule("none", "z", "absent"), Rule("there", "n", "present"), Rule("scoped", "n", "equals", 0, "z = 'x'")]
    got = sorted(map(tuple, rules.breaches(df, said, ["k"]).collect()))
    assert [(k, r) for k, r, _, _ in got] == [(2, "known"), (2, "n"), (2, "none"), (2, "scoped"), (2, "there"), (2, "x_is_a"), (2, "xy"), (3, "known"), (3, "n"), (3, "x_is_a")]
    assert {(r, f, w) for k, r, f, w in got if k == 2} == {("known", "b", "a,c"), ("n", None, "1,9"), ("none", "x", None), ("scoped", None, "0"), ("there", None, None), ("x_is_a", "b", "a"), ("xy", "b", "a")}
    plan = rules.breaches(df, said, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Exchange" not in plan
    assert rules.breaches(df.limit(0), said, ["k"]).count() == 0
    assert sorted(r.rule for r in rules.total_breaches(df, {"n": ("count(*)", 3), "x": ("count(DISTINCT x)", 3)}).collect()) == ["x"]
    with pytest.raises(ValueError):
        Rule("a", "x", "odd").holds()


def test_supplement_gate(spark):
    kind = "file string, archive_sha256 string, rows long, unique_ids long, ordered_ids_sha256 string"
    rows = [(f"f{i:02}", f"h{i}", 10, 9, "o") for i in range(24)]
    manifest = spark.createDataFrame(rows, kind).withColumn("schema_version", F.lit("v1"))
    gate = lambda m, seen: sorted((r.file or "", r.rule) for r in rules.supplement_gate(m, spark.createDataFrame(seen, kind), "v1", 24).collect())
    assert gate(manifest, rows) == []
    odd = [(*rows[0][:1], "other", *rows[0][2:]), (*rows[1][:2], 11, 8, None), *rows[3:], ("more", "h", 1, 1, "o")]
    assert gate(manifest, odd) == [("f00", "archive_sha256"), ("f01", "ordered_ids_sha256"), ("f01", "rows"), ("f01", "unique_ids"), ("f02", "missing"), ("more", "unexpected")]
    assert gate(manifest.where("file <> 'f05'").withColumn("schema_version", F.lit("v2")), rows) == [("", "files"), ("", "schema_version"), ("f05", "unexpected")]
    mixed = manifest.withColumn("schema_version", F.when(F.col("file") != "f00", "v1"))
    assert gate(mixed, rows) == [("", "schema_version")]


def test_resume_gate(spark):
    items = spark.createDataFrame([("a", "ha"), ("b", "hb")], "sample_id string, item_sha256 string")
    kind = "sample_id string, status string, item_sha256 string, input_sha256 string, requested_model string, returned_model string"
    good = [("a", "ok", "ha", "in", "m", "m-1"), ("b", "error", "hb", "in", "m", None)]
    gate = lambda rows, **more: sorted((r.sample_id, r.rule) for r in rules.resume_gate(spark.createDataFrame(rows, kind), items, "sample_id", {"input_sha256": "in", "requested_model": "m"}, **more).collect())
    assert gate(good, returned_model="m-1") == [] == gate([])
    bad = [("c", "ok", "x", "in", "m", "m-1"), ("a", "ok", "hb", "other", None, "m-2")]
    assert gate(bad, returned_model="m-1") == [("a", "input_sha256"), ("a", "item_sha256"), ("a", "requested_model"), ("a", "returned_model"), ("c", "outside_input")]
    assert ("a", "returned_model") not in gate(bad)


def test_paired_gate(spark):
    kind = "ordinal long, sample_id string, source string, status string, gold int, k int"
    rows = [(i, f"i{i}", "s", "ok", i % 3, 3) for i in range(6)]
    gold = spark.createDataFrame([(r[1], r[2], r[4], r[5]) for r in rows], "sample_id string, source string, gold int, k int")

    def gate(before, after, **more):
        return sorted((-1 if r.ordinal is None else r.ordinal, r.rule) for r in rules.paired_gate(spark.createDataFrame(before, kind), spark.createDataFrame(after, kind), gold, "sample_id", "ordinal", **more).collect())

    assert gate(rows, rows, rows=6) == []
    after = [rows[0], (1, "i2", "s", "ok", 2, 3), (2, "i2", "t", "error", 0, 4), (3, "i3", "s", "error", 0, 3), *rows[4:5]]
    before = [*rows[:3], (3, "i3", "s", "ok", 2, 3), (4, "i4", "s", "ok", 1, 9), (5, "gone", "s", "ok", 0, 3), (6, "gone", "s", "ok", 0, 3)]
    got = gate(before, [*after, (6, "gone", "s", "ok", 0, 3)], rows=6)
    assert got == [(-1, "rows"), (1, "after_gold"), (1, "order"), (2, "after_gold"), (2, "after_k"), (2, "source"), (4, "before_k"), (5, "row_count"), (6, "not_in_index")]


def test_checkpoint_gate(spark):
    kind = "model string, role string, repo_id string, resolved_revision string, tree_sha256 string"
    config = spark.createDataFrame([(m, "r", v) for m, v in zip("abcde", ["1", None, "1", "", "1"], strict=True)], "model string, repo_id string, revision string")
    rows = [("a", "weights", "r", "1", "t"), ("a", "tokenizer", "q", "0", "z"), ("b", "weights", "r", "9", "t"), ("c", "weights", "r", "2", "t"), ("d", "weights", "q", "3", "u"), ("e", "weights", "r", "1", "t"), ("e", "weights", "r", "1", "t")]
    trees = spark.createDataFrame([(m, "t") for m in "abcd"], "model string, tree_sha256 string")
    got = sorted((r.model, r.rule) for r in rules.checkpoint_gate(spark.createDataFrame(rows, kind), config, trees).collect())
    assert got == [("c", "revision"), ("d", "repo_id"), ("d", "tree_sha256"), ("e", "entries")]


def test_stamps_with_the_time(spark):
    import datetime

    at = results.stamped(spark.range(1).selectExpr("id as a"), {"run": "x"}, ["a"], "created_at").first().created_at
    assert abs((datetime.datetime.now(datetime.UTC) - datetime.datetime.fromisoformat(at)).total_seconds()) < 600


def lines(df):
    return sorted((r["path"].rsplit("/")[-1], r["member"], r["line_no"], r["value"]) for r in df.collect())


def test_archives_as_data_sources(spark, tmp_path):
    formats.register(spark)
    files = {f"set/{kind}/{i}_{i % 10}.txt": "".join(f"{kind} {i} line {j} é\r\n" for j in range(i % 4)) + "end" for i in range(30) for kind in ("pos", "neg")}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z, tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        for name, text in files.items():
            z.writestr(name, text)
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            t.addfile(info, io.BytesIO(text.encode()))
        z.writestr("__MACOSX/x", "no")
        z.writestr("empty/", "")
    want = [(n, i, v) for n, text in files.items() for i, v in enumerate(text.replace("\r\n", "\n").split("\n"))]
    for source, name in (("zip_lines", "a.zip"), ("tar_lines", "b.tar.gz")):
        df = spark.read.format(source).option("partBytes", 300).load(str(tmp_path))
        assert lines(df) == sorted((name, *x) for x in want)
        assert (df.rdd.getNumPartitions() > 5) == (source == "zip_lines")
        some = df.where("member = 'set/pos/7_7.txt' AND line_no > 0")
        assert lines(some) == sorted((name, *x) for x in want if x[0] == "set/pos/7_7.txt" and x[1] > 0)
        few = spark.read.format(source).option("members", r"neg/1\d_").load(str(tmp_path / name))
        assert {r.member for r in few.select("member").distinct().collect()} == {n for n in files if "neg/1" in n and n[9:10].isdigit() and n[9] != "_"}
    pruned = spark.read.format("zip_lines").option("partBytes", 300).load(str(tmp_path)).where("member = 'set/pos/7_7.txt'")
    assert pruned.rdd.getNumPartitions() == 1
    assert spark.read.format("zip_lines").load(str(tmp_path)).where("path = 'elsewhere'").count() == 0
    (tmp_path / "none").mkdir()
    assert spark.read.format("tar_lines").load(str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("size", [1, 50, 333, 1 << 20])
def test_literal_lines_in_byte_ranges(spark, tmp_path, size):
    formats.register(spark)
    rows = [{"review/text": f"it's é {i}", "n": i, "none": None} for i in range(40)]
    text = "﻿" + "".join(repr(r) + "\n" + "\n" * (i % 3) for i, r in enumerate(rows))
    (tmp_path / "a.json").write_text(text.rstrip("\n"))
    size = size if size > 1 else len(repr(rows[0]).encode()) + 4  # a span that ends with a line
    got = spark.read.format("python_literals").option("partBytes", size).load(str(tmp_path / "a.json")).orderBy("offset").collect()
    assert [r.fields for r in got] == [{k: None if v is None else str(v) for k, v in r.items()} for r in rows]


STREAM = "sample_id string, line_no long, status string, score double, run string"


def begin(spark, folder, **more):
    stream = spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = keyed.reduce_stream(stream, f"{folder}/out", f"{folder}/state", "sample_id", "line_no", provenance=["run"], **more)
    q.awaitTermination()
    return q


def test_keyed_state_goes_on_after_a_restart(spark, tmp_path):
    rows = [(None if i % 50 == 3 else f"k{i * 7 % 30}", i, ["ok", "error", "rejected"][i * 5 % 3] if i % 4 else "error", i / 8, "r") for i in range(300)]
    for low, high in ((0, 120), (120, 121), (121, 300)):
        spark.createDataFrame(rows[low:high], STREAM).coalesce(2 if high - low > 1 else 1).write.mode("append").parquet(f"{tmp_path}/in")
        begin(spark, tmp_path, expected={"run": "r"})
        journal = spark.createDataFrame(rows[:high], STREAM)
        want = {r.sample_id: (r.line_no, r.status) for r in results.ok_wins(journal, "sample_id", "line_no").collect()}
        assert {r.key: (r["at"], r.status) for r in keyed.latest(spark, f"{tmp_path}/out").collect()} == want
    written = spark.read.parquet(f"{tmp_path}/out")
    assert written.where("version > 1").count() and written.groupBy("key", "version").count().where("count > 1").count() == 0
    before = written.count()
    begin(spark, tmp_path, expected={"run": "r"})  # nothing new: nothing is written
    assert spark.read.parquet(f"{tmp_path}/out").count() == before


@pytest.mark.parametrize("row, more, what", [(("k", 2, "ok", 1.0, "other"), {"expected": {"run": "r"}}, "another run configuration"), (("k", 2, "ok", 2.0, "r"), {"once": True}, "several ok answers")])
def test_keyed_state_refuses(spark, tmp_path, row, more, what):
    spark.createDataFrame([("k", 1, "ok", 1.0, "r")], STREAM).write.parquet(f"{tmp_path}/in")
    begin(spark, tmp_path, **more)
    spark.createDataFrame([row], STREAM).write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match=what):
        begin(spark, tmp_path, **more)
