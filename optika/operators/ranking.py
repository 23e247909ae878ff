"""Ranks inside large groups and exact order statistics, without one task for each group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: About how many rows of a group one task ranks.
PART_ROWS = 1_000_000


def place_by_hash(df: DataFrame, keys: list[str], rank: Column, tie: str, most: Column | int | None = None, out: str = "_r", part_rows: int = PART_ROWS) -> DataFrame:
    """Adds the place (from 1) of each row inside its group, ordered by (rank, tie); rank is a hexadecimal hash.

    A group of more than ``part_rows`` rows is split by as many leading digits of the rank as give parts of about that
    size; a smaller one is one part.  Sizes come from one histogram over leading digits, added up before it is shuffled.
    A part's rows are numbered on their own and shifted by the rows before it.  With ``most``, parts that begin beyond
    it are not sorted."""
    digits = max(0, math.ceil(math.log(max(1, df.count() / part_rows), 16)))
    ranked = df.withColumn("_h", rank).withColumn("_digits", F.substring("_h", 1, digits))
    names = [f"_k{i}" for i in range(len(keys))]
    sizes = ranked.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("_digits").alias("_kd")).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*names)
    split = F.greatest(F.lit(0.0), F.ceil(F.log(16.0, F.sum("_n").over(group) / F.lit(float(part_rows))) - 1e-9)).cast("int")
    sizes = sizes.withColumn("_kp", F.substring(F.col("_kd"), F.lit(1), split))
    before = F.sum("_n").over(group.orderBy("_kp").rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("_n").over(Window.partitionBy(*names, "_kp"))
    sizes = sizes.withColumn("_before", before).drop("_n")
    meet = F.col("_digits") == F.col("_kd")
    for k, name in zip(keys, names, strict=True):
        meet = meet & F.col(k).eqNullSafe(F.col(name))
    ranked = ranked.join(sizes, meet)
    if most is not None:
        ranked = ranked.where(F.col("_before") < most)
    place = F.row_number().over(Window.partitionBy(*keys, "_kp").orderBy("_h", tie))
    return ranked.withColumn(out, (place + F.col("_before")).cast("long")).drop("_h", "_digits", "_kd", "_kp", "_before", *names)


#: Of percentile_approx: a quantile's rank is off by at most 1 / ACCURACY of the rows.
ACCURACY = 10_000
#: Most intervals that ranks are bracketed in; more are joined with their neighbours.
MOST_INTERVALS = 200


def _brackets(low: list, high: list) -> list[tuple]:
    """Intervals that overlap joined, then neighbours until there are MOST_INTERVALS at most."""
    out: list[list] = []
    for a, b in sorted(zip(low, high, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    step = -(-len(out) // MOST_INTERVALS)
    return [(out[i][0], out[min(i + step, len(out)) - 1][1]) for i in range(0, len(out), max(1, step))]


def _bucket(x: Column, edges: list[tuple], low: int = 0) -> Column:
    """The bucket of x among sorted intervals: 2 i + 1 in interval i, 2 i below it and above the one before; a tree of
    comparisons."""
    if not edges:
        return F.lit(2 * low)
    i = len(edges) // 2
    a, b = edges[i]
    return F.when(x < F.lit(a), _bucket(x, edges[:i], low)).when(x <= F.lit(b), F.lit(2 * (low + i) + 1)).otherwise(_bucket(x, edges[i + 1 :], low + i + 1))


def order_statistics(df: DataFrame, x: str, ranks: list[int]) -> list:
    """The values at the given ranks (from 1) of the sorted non-null values of x, exactly; None for a rank beyond them.

    Three jobs whatever the number of ranks: one counts; one brackets every rank between approximate quantiles; one
    counts the rows below each bracket and, of the few rows inside, the copies of each value.  What reaches the driver is a
    row for each bracket and each rank."""
    values = df.select(F.col(x).alias("x")).where("x IS NOT NULL")
    n = values.count()
    wanted = sorted({r for r in ranks if 1 <= r <= n})
    if not wanted:
        return [None] * len(ranks)
    slack = 2.0 / ACCURACY
    grid = sorted({0.0, 1.0, *(min(1.0, max(0.0, r / n + e)) for r in wanted for e in (-slack, slack))})
    at = dict(zip(grid, values.agg(F.percentile_approx("x", grid, ACCURACY)).first()[0], strict=True))
    low = [at[min(1.0, max(0.0, r / n - slack))] for r in wanted]
    high = [at[min(1.0, max(0.0, r / n + slack))] for r in wanted]
    found: dict[int, object] = {}
    for edges in (_brackets(low, high), [(at[0.0], at[1.0])]):  # the whole range only if a bracket missed its rank
        found = _inside(values, edges, wanted)
        if len(found) == len(wanted):
            break
    return [found.get(r) for r in ranks]


def _inside(values: DataFrame, edges: list[tuple], wanted: list[int]) -> dict[int, object]:
    counts = values.groupBy("x").agg(F.count("*").alias("n")).withColumn("b", _bucket(F.col("x"), edges))
    below = values.groupBy(_bucket(F.col("x"), edges).alias("b")).agg(F.count("*").alias("n"))
    below = below.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))  # a row for each bracket
    inside = counts.where("b % 2 = 1").join(F.broadcast(below), "b")
    upto = F.col("below") + F.sum("n").over(Window.partitionBy("b").orderBy("x"))
    inside = inside.select("x", upto.alias("upto"), (upto - F.col("n")).alias("before"))
    asked = values.sparkSession.createDataFrame([(r,) for r in wanted], "rank long")
    hits = inside.join(F.broadcast(asked), (F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("upto")))
    return {r["rank"]: r["x"] for r in hits.select("rank", "x").collect()}
