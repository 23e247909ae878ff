"""Ranks, ordinals and order statistics of large groups; what they cost."""

import random
import time

import pytest
from pyspark.sql import functions as F

from optika.functions import text as T
from optika.operators import indexes, ranking


def jobs(spark, run):
    """What run gives, and how many Spark jobs it took."""
    sc, tag = spark.sparkContext, f"t{random.random()}"
    sc.setJobGroup(tag, tag)
    try:
        out = run()
    finally:
        sc.setJobGroup("other", "other")
    return out, len(sc.statusTracker().getJobIdsForGroup(tag))


@pytest.mark.parametrize("part_rows", [1_000_000, 100, 3])
def test_places_do_not_depend_on_parts(spark, part_rows):
    df = spark.range(2000).selectExpr("id", "if(id % 10 < 7, 'big', if(id % 100 = 8, null, cast(id % 3 as string))) g")
    rank = T.hash_rank(1, F.col("id"))
    want = df.withColumn("h", rank).selectExpr("id", "cast(row_number() over (partition by g order by h, id) as bigint) r")
    got = ranking.place_by_hash(df, ["g"], rank, "id", part_rows=part_rows).select("id", F.col("_r").alias("r"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    some = ranking.place_by_hash(df, ["g"], rank, "id", 5, part_rows=part_rows).where("_r <= 5").groupBy("g").count().collect()
    assert len(some) == 5 and {r["count"] for r in some} == {5}
    assert ranking.place_by_hash(df.limit(0), ["g"], rank, "id", part_rows=part_rows).count() == 0


def test_parts_of_a_very_large_group(spark):
    """No task ranks more than about part_rows rows of a group; small groups are one part each."""
    df = spark.range(3_000_000).selectExpr("id", "if(id % 300 > 0, 0, id % 50) g")
    # without the window's own sort: sizes of the parts that it is given
    placed = ranking.place_by_hash(df, ["g"], F.md5(F.col("id").cast("string")), "id", part_rows=50_000)
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "_kp" in plan
    top = placed.groupBy("g", F.floor((F.col("_r") - 1) / 50_000).alias("b")).count()
    assert placed.where("_r = 1").count() == df.select("g").distinct().count() and top.agg(F.max("count")).first()[0] == 50_000


def test_order_statistics(spark):
    df = spark.range(2000).selectExpr("id", "cast((id * 7919) % 641 as double) x", "if(id % 3 = 0, null, cast(id % 5 as int)) few", "date_add(date'2020-01-01', cast(id % 77 as int)) d")
    for c in ("x", "few", "d", "id"):
        values = sorted(r[0] for r in df.select(c).collect() if r[0] is not None)
        ranks = [1, 2, len(values) // 2, len(values) - 1, len(values), 7, 7, len(values) + 1, 0]
        assert ranking.order_statistics(df, c, ranks) == [values[i - 1] if 0 < i <= len(values) else None for i in ranks]
    assert ranking.order_statistics(df.limit(0), "x", [1]) == [None]


@pytest.mark.parametrize("ranks", [1, 13, 5000])
def test_order_statistics_of_many_ranks_take_few_jobs(spark, ranks):
    df = spark.range(300_000).selectExpr("if(id % 3 = 0, 0.5D, rand(7) * rand(8)) x")
    values = sorted(r[0] for r in df.collect())
    asked = sorted({1 + i * 299_999 // max(1, ranks - 1) for i in range(ranks)})
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # with it each exchange counts as a job
    try:
        got, n = jobs(spark, lambda: ranking.order_statistics(df, "x", asked))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == [values[r - 1] for r in asked] and n <= 6  # three, and the broadcasts of two small tables


def test_brackets():
    assert ranking._brackets([1, 2, 9], [3, 4, 9]) == [(1, 4), (9, 9)]
    many = ranking._brackets(list(range(0, 4000, 2)), [x + 0.5 for x in range(0, 4000, 2)])
    assert len(many) <= ranking.MOST_INTERVALS and many[0][0] == 0 and many[-1][1] == 3998.5


def test_ordinals_of_ten_million_rows(spark):
    df = spark.range(10_000_000).selectExpr("pmod(id * 7919, 10000019) a", "id % 3 b")
    out = indexes.with_ordinal(df, ["a", "b"])
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 5000
    got = out.select(F.count("*"), F.count_distinct("ordinal"), F.min("ordinal"), F.max("ordinal")).first()
    assert tuple(got) == (10_000_000, 10_000_000, 0, 9_999_999)
    assert out.orderBy("ordinal").limit(1000).select("a").collect() == df.orderBy("a").limit(1000).select("a").collect()


def test_ordinals_of_odd_rows(spark):
    df = spark.createDataFrame([(None, 1), (2, None), (2, 5), (1, 1), (1, 1)], "a int, _n int")
    assert [(r.ordinal, r.a) for r in indexes.with_ordinal(df, ["a", "_n"]).orderBy("ordinal").collect()] == [(0, None), (1, 1), (2, 1), (3, 2), (4, 2)]
    assert indexes.with_ordinal(df.limit(0), ["a"]).count() == 0


def test_casefold_costs_little_more_than_lower(spark):
    texts = spark.createDataFrame([("Die Straße über den FLUSS, größer als ΣΑΣ " * 20,), ("The Quick Brown Fox Jumps " * 30,)], "t string")
    many = texts.crossJoin(spark.range(30_000)).select("t").repartition(4).cache()
    many.count()

    def seconds(x):
        best = 9e9
        for _ in range(3):
            began = time.perf_counter()
            many.select(F.max(F.xxhash64(x))).collect()
            best = min(best, time.perf_counter() - began)
        return best

    low, fold = seconds(F.lower("t")), seconds(T.casefold(F.col("t")))
    print("lower", low, "casefold", fold)
    assert fold < 4 * low + 0.2  # about twice, with room for a busy machine
    many.unpersist()
