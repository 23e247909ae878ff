"""Finding wanted rows in large raw sources without reading more of them than needed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from optika.sources.scratch import dropped, written

#: Bits for each wanted key, hashes of a key, and most bits of a filter (16 MB); beyond, it lets more rows through.
BITS_PER_KEY, HASHES, MOST_BITS = 12, 4, 1 << 27


def membership(ids: DataFrame, key: str, n: int, most_bits: int = MOST_BITS) -> Callable[[Column], Column]:
    """A Bloom filter of the n keys of ids, as a condition on a column: true for every key, and for few others.

    Its words are built by an aggregation and reach the scan's filter as one value, of a size that ``most_bits`` bounds;
    both sides are expressions, so that a scan stays in generated code."""
    bits = min(most_bits, max(64, 1 << (BITS_PER_KEY * max(1, n) - 1).bit_length()))
    places = lambda x: [F.xxhash64(x.cast("string"), F.lit(i)).bitwiseAND(F.lit(bits - 1)) for i in range(HASHES)]
    spots = ids.select(F.explode(F.array(*places(F.col(key)))).alias("p"))
    words = spots.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    every = ids.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("word"), "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    whole = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("words"))

    def test(x: Column) -> Column:
        found = F.lit(True)
        for p in places(x):
            word = F.get(whole.scalar(), F.shiftright(p, 6).cast("int"))
            found = found & (F.bit_get(word, p.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return found

    return test


@dataclass
class Restored:
    """Wanted rows that were found, keys that no file had, and which files were read and which not."""

    rows: DataFrame
    missing: DataFrame
    read: list[str]
    unread: list[str]


def restore(spark: SparkSession, files: list[str], reader: Callable[[list[str]], DataFrame], wanted: DataFrame, key: str, first_wave: int | None = None, growth: int = 2) -> Restored:
    """Scans files (names, in order) for the rows whose key is wanted, until all are found.

    Files are read in waves, each ``growth`` times as large as the one before, beginning with one file for each core; a
    wave's scan has a filter on the keys still wanted (their range, which Parquet files skip blocks by, and a Bloom
    filter), and what passes is joined with them exactly.  When no key is left, the files left are not read.  Of rows
    that share a key the first file's counts, in it the one of the smallest hash; null keys are never wanted."""
    files = list(files)
    left = written(wanted.select(key).where(F.col(key).isNotNull()).distinct(), "wanted")
    n, at, size, parts = left.count(), 0, first_wave or max(1, spark.sparkContext.defaultParallelism), []
    while n and at < len(files):
        rows = reader(files[at : at + size])
        low, high = left.agg(F.min(key), F.max(key)).first()
        some = rows.where(F.col(key).between(F.lit(low), F.lit(high)) & membership(left, key, n)(F.col(key))).withColumn("_file", F.input_file_name())
        hits = some.join(left, key, "left_semi")
        columns = [c for c in rows.columns if c != key]
        one = hits.groupBy(key).agg(F.min_by(F.struct(*columns) if columns else F.lit(1), F.struct("_file", F.xxhash64(*rows.columns))).alias("_r"))
        parts.append(written(one.select(*(F.col(key) if c == key else F.col(f"_r.{c}") for c in rows.columns)), "found"))
        rest = written(left.join(parts[-1].select(key), key, "left_anti"), "wanted")
        dropped(left)
        left, n, at, size = rest, rest.count(), at + size, size * growth
    found = reader(files[:1]).limit(0) if files else wanted.select(key).limit(0)
    for p in parts:
        found = found.unionByName(p)
    return Restored(found, left, files[:at], files[at:])
