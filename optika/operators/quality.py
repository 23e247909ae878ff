"""Digests, manifests and gates.  A gate returns the rows that break a rule; none means that it holds."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optika.functions import arrays as A


def digests(df: DataFrame, keys: list[str], line: Column | Callable[..., Column], order: list[Column], name: str = "digest", more: tuple[Column, ...] = ()) -> DataFrame:
    """SHA-256 of the lines of each group in an order, streamed: a group's lines are sorted (Spark spills) and go through
    one hash, whatever their number; nothing is collected.  A null line has no bytes.  One task hashes a group, as the
    definition of the digest demands.

    ``line`` is a column, or makes a line of the order's columns and ``more``; that is done behind the sort, which so holds
    no line beside the columns that it consists of."""
    k = len(keys)
    if isinstance(line, Column):
        line, more = lambda *x: x[-1], (*more, line)
    rows = df.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), *(o.alias(f"_o{i}") for i, o in enumerate([*order, *more])))
    groups = [f"_k{i}" for i in range(k)]
    sort = [*groups, *(f"_o{i}" for i in range(len(order)))]
    kinds = [df.schema[c].dataType.simpleString() for c in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []
        for b in batches:
            names = list(zip(*(b.column(i).to_pylist() for i in range(k)), strict=True)) if k else [()] * b.num_rows
            lines = b.column(b.num_columns - 1).to_pylist()
            at = 0
            while at < len(lines):
                end = at + 1
                while end < len(lines) and names[end] == names[at]:
                    end += 1
                if digest is None or names[at] != key:
                    if digest is not None:
                        out.append((key, digest.hexdigest()))
                    key, digest = names[at], hashlib.sha256()
                digest.update(b"".join(x or b"" for x in lines[at:end]))
                at = end
        if digest is not None:
            out.append((key, digest.hexdigest()))
        if out:
            schema = pa.schema([*((n, b.schema.field(i).type) for i, n in enumerate(groups)), (name, pa.string())])
            yield pa.RecordBatch.from_arrays([*(pa.array([o[0][i] for o in out], schema.field(i).type) for i in range(k)), pa.array([o[1] for o in out], pa.string())], schema=schema)

    dealt = (rows.repartition(*groups) if k else rows.coalesce(1)).sortWithinPartitions(*sort)
    dealt = dealt.select(*groups, line(*(F.col(f"_o{i}") for i in range(len(order) + len(more)))).cast("binary").alias("_line"))
    got = dealt.mapInArrow(run, ", ".join([*(f"`{g}` {t}" for g, t in zip(groups, kinds, strict=True)), f"`{name}` string"]))
    return got.toDF(*keys, name)


def _lined(x: Column) -> Column:
    return F.concat(x, F.lit("\n"))


def _written_out(sha: Column) -> Column:
    return F.lower(F.hex(sha))


def selection_digest(df: DataFrame, keys: list[str], key: Column, name: str = "digest") -> DataFrame:
    """SHA-256 of the sorted keys, each followed by a line feed; independent of row order."""
    return digests(df, keys, lambda x: x, [_lined(key)], name)


def ordered_digest(df: DataFrame, keys: list[str], key: Column, ordinal: Column, name: str = "digest") -> DataFrame:
    """The same in the order of an ordinal."""
    return digests(df, keys, lambda _, x: _lined(x), [ordinal], name, (key,))


def record_digest(df: DataFrame, keys: list[str], key: Column, sha: Column, name: str = "digest", packed: bool = False) -> DataFrame:
    """SHA-256 over sorted (key, record hash): key, a zero byte, the hash, a line feed.  packed: all hashes are lower-case
    hexadecimal, and are sorted as the bytes that they stand for, in the same order."""
    shown = _written_out if packed else lambda x: x
    return digests(df, keys, lambda k, s: _lined(F.concat(k, F.lit("\0"), shown(s))), [key, F.unhex(sha) if packed else sha], name)


def pool_digest(df: DataFrame, keys: list[str], sha: Column, name: str = "digest", packed: bool = False) -> DataFrame:
    """Content digest of a pool: SHA-256 of its sorted row hashes, each followed by a line feed; packed as above."""
    if packed:
        return digests(df, keys, lambda x: _lined(_written_out(x)), [F.unhex(sha)], name)
    return selection_digest(df, keys, sha, name)


def tree_digest(df: DataFrame, keys: list[str], path: Column, size: Column, sha: Column, name: str = "digest") -> DataFrame:
    """SHA-256 of ``sha  bytes  path`` lines in path order."""
    return digests(df, keys, lambda p, n, s: _lined(F.concat_ws("  ", s, n.cast("string"), p)), [path], name, (size, sha))


def id_report(df: DataFrame, keys: list[str], key: str, order: str) -> DataFrame:
    """Rows, unique ids, and the first ten ids that occur again, in the order of their second occurrence."""
    turn = F.row_number().over(Window.partitionBy(*keys, key).orderBy(order))
    again = df.withColumn("_turn", turn).where("_turn = 2").withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_place <= 10")
    again = again.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", key))), lambda x: x[key]).alias("duplicate_ids"))
    out = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_distinct(key).alias("unique_ids"))
    return out.join(again, keys, "left").withColumn("duplicate_ids", F.coalesce("duplicate_ids", F.array().cast(f"array<{df.schema[key].dataType.simpleString()}>")))


def missing_and_unexpected(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys of either side without a partner, with the side's name."""
    a, b = expected.select(key).distinct(), actual.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("problem", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("problem", F.lit("unexpected")))


def item_gate(items: DataFrame, low: int = 2, high: int = 26) -> DataFrame:
    """Items with the wrong number of choices, a gold position outside them, or a label text that is not theirs."""
    n = F.size("choices")
    bad = F.when(~n.between(low, high), "choices").when((F.col("gold_position") < 0) | (F.col("gold_position") >= n), "gold").when(~F.get("choices", F.col("gold_position")).eqNullSafe(F.col("gold_label_text")), "label")
    return items.withColumn("problem", bad).where("problem IS NOT NULL")


def frozen_gate(items: DataFrame, per_source: dict[str, int], low: int = 3, high: int = 10) -> DataFrame:
    """What is wrong with a frozen input: problem, subject, found, wanted.  Exact total, unique ids, rows of each source,
    number of choices, gold inside them and its text."""
    spark = items.sparkSession
    total = items.agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("ids")).select(F.explode(F.array(F.struct(F.lit("total").alias("problem"), F.col("n").alias("found")), F.struct(F.lit("unique").alias("problem"), F.col("ids").alias("found")))).alias("x")).select("x.*")
    total = total.select("problem", F.lit("all").alias("subject"), "found", F.lit(sum(per_source.values())).cast("long").alias("wanted"))
    wanted = spark.createDataFrame(list(per_source.items()), "subject string, wanted long")
    counts = items.groupBy(F.col("source").alias("subject")).agg(F.count("*").alias("found"))
    counts = counts.join(wanted, "subject", "full").select(F.lit("source").alias("problem"), "subject", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("wanted", F.lit(0)).alias("wanted"))
    rows = item_gate(items, low, high).groupBy("problem").agg(F.count("*").alias("found")).select("problem", F.lit("rows").alias("subject"), "found", F.lit(0).cast("long").alias("wanted"))
    return total.unionByName(counts).unionByName(rows).where("found <> wanted")


def level_choices_gate(items: DataFrame) -> DataFrame:
    """Items whose choices are not exactly Level 01, Level 02, ..."""
    from optika.functions.text import level_name

    want = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("choices"))), level_name)
    return items.where(~F.coalesce(F.col("choices") == want, F.lit(False)))


def finite(x: Column) -> Column:
    """Whether a number is there and finite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def uniform_size_gate(items: DataFrame, source: str, size: Column) -> DataFrame:
    """Sources whose items have scales of different sizes."""
    return items.groupBy(source).agg(F.min(size).alias("low"), F.max(size).alias("high")).where("low <> high")


def level_coverage_gate(items: DataFrame, source: str, level: str, size: Column) -> DataFrame:
    """Sources in which a level of the scale never is the gold one."""
    return items.groupBy(source).agg(F.count_distinct(level).alias("have"), F.max(size).alias("want")).where("have <> want")


def versions_gate(df: DataFrame, pair: str, versions: int) -> DataFrame:
    """Pairs that do not have exactly so many versions."""
    return df.groupBy(pair).agg(F.count("*").alias("versions")).where(F.col("versions") != versions)


def gold_balance(df: DataFrame, choices: str, gold: str, ordered: bool = False) -> DataFrame:
    """Per set of candidates (or, ``ordered``, per list): the golds that occur, and the least and greatest count of one.
    A set leaks the gold where golds are not all its candidates, and is unequal where the counts differ."""
    group = F.col(choices) if ordered else F.sort_array(choices)
    counts = df.groupBy(group.alias("candidates"), F.col(gold).alias("_gold")).agg(F.count("*").alias("_n"))
    out = counts.groupBy("candidates").agg(F.array_sort(F.collect_set("_gold")).alias("golds"), F.min("_n").alias("low"), F.max("_n").alias("high"))
    return out.withColumn("leaks", F.col("golds") != F.array_sort(F.array_distinct("candidates"))).withColumn("unequal", F.col("low") != F.col("high"))


def manifest_gate(expected: DataFrame, observed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Differences between a manifest and what was scanned: key, problem (missing, unexpected or the field's name)."""
    e = expected.select(key, F.lit(True).alias("_e"), *(F.col(f).alias(f"_e_{f}") for f in fields))
    o = observed.select(key, F.lit(True).alias("_o"), *(F.col(f).alias(f"_o_{f}") for f in fields))
    j = e.join(o, key, "full")
    differ = F.filter(F.array(*(F.when(~F.col(f"_e_{f}").eqNullSafe(F.col(f"_o_{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    problems = F.when(F.col("_o").isNull(), F.array(F.lit("missing"))).when(F.col("_e").isNull(), F.array(F.lit("unexpected"))).otherwise(differ)
    return j.select(key, F.explode(problems).alias("problem"))


def release_gate(files: DataFrame, file: str, key: str, ordinal: str, status: str, rows: int) -> DataFrame:
    """Files of a release that do not have so many rows, unique keys and ok answers, or not the same keys in the same order
    as the first file: file, problem."""
    counts = files.groupBy(file).agg(F.count("*").alias("n"), F.count_distinct(key).alias("ids"), F.count_if(F.col(status) == "ok").alias("ok"))
    order = ordered_digest(files, [file], F.col(key).cast("string"), F.col(ordinal), "order")
    both = counts.join(order, file).crossJoin(F.broadcast(order.agg(F.min_by("order", file).alias("first_order"))))
    problems = F.array(F.when(F.col("n") != rows, "rows"), F.when(F.col("ids") != F.col("n"), "unique"), F.when(F.col("ok") != F.col("n"), "status"), F.when(F.col("order") != F.col("first_order"), "order"))
    return both.select(file, F.explode(F.filter(problems, lambda x: x.isNotNull())).alias("problem"))


def index_gate(results: DataFrame, index: DataFrame, source: str, key: str) -> DataFrame:
    """Sources whose results are not about exactly the indexed items: both selection digests and unique counts."""
    side = lambda df, tag: selection_digest(df.select(source, key).distinct(), [source], F.col(key).cast("string"), f"{tag}_digest").join(df.groupBy(source).agg(F.count_distinct(key).alias(f"{tag}_ids")), source)
    both = side(results, "result").join(side(index, "index"), source, "full")
    return both.where(~F.col("result_digest").eqNullSafe(F.col("index_digest")) | ~F.col("result_ids").eqNullSafe(F.col("index_ids")))


def forbidden_lines(lines: DataFrame, value: str, tokens: list[str]) -> DataFrame:
    """Raw lines that hold a forbidden token in any case, with the first such token."""
    low = F.lower(value)
    first = F.coalesce(*(F.when(low.contains(t.lower()), F.lit(t)) for t in tokens))
    return lines.withColumn("token", first).where("token IS NOT NULL")


def included_path(path: Column, directories: list[str], suffixes: list[str]) -> Column:
    """Whether a file counts: no part of its path is an excluded directory, and its suffix is not that of a generated file."""
    parts = F.split(path, "/")
    return A.disjoint(parts, F.array(*map(F.lit, directories))) & ~path.rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$")


def totals(df: DataFrame, size: str) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def panel_gate(df: DataFrame, source: str, rows: int) -> DataFrame:
    """Sources that do not have exactly ``rows`` rows."""
    return df.groupBy(source).agg(F.count("*").alias("n")).where(F.col("n") != rows)


def constant_within(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys within which a control field varies; nulls count as a value."""
    return df.groupBy(key).agg(F.count_distinct(F.struct(*fields)).alias("versions")).where("versions > 1")


def equal_counts(df: DataFrame, group: list[str], label: str) -> DataFrame:
    """Groups whose labels do not occur equally often."""
    return df.groupBy(*group, label).count().groupBy(*group).agg(F.min("count").alias("low"), F.max("count").alias("high")).where("low <> high")


def rising_means(df: DataFrame, level: str, value: str) -> DataFrame:
    """Levels whose mean is not above that of the level before; one row per level is compared."""
    means = df.groupBy(level).agg(F.avg(value).alias("mean"))
    return means.withColumn("before", F.lag("mean").over(Window.orderBy(level))).where("mean <= before")


def unsafe_members(names: DataFrame, name: str = "name") -> DataFrame:
    """Archive member names that are absolute, climb, or hold a backslash or colon."""
    return names.where(F.col(name).rlike(r"^/|(^|/)\.\.(/|$)|\\|:"))


def member_problems(names: DataFrame, expected: DataFrame, name: str = "name") -> DataFrame:
    """What is wrong with an archive's members: unsafe, duplicate, missing or unexpected names."""
    unsafe = unsafe_members(names, name).select(name, F.lit("unsafe").alias("problem")).distinct()
    twice = names.groupBy(name).count().where("count > 1").select(name, F.lit("duplicate").alias("problem"))
    return unsafe.unionByName(twice).unionByName(missing_and_unexpected(expected, names, name))


def require_empty(df: DataFrame, rule: str) -> None:
    if rows := df.limit(5).collect():
        raise ValueError(f"{rule}: {rows}")
