"""Before and after: paired answers of two models to the same items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair(before: DataFrame, after: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Both answers (status, pred) and the gold label of each indexed item, with the reason for exclusion if one
    answer is missing or not ok."""
    b = before.select(key, F.col("status").alias("status_before"), F.col("pred").alias("pred_before"))
    a = after.select(key, F.col("status").alias("status_after"), F.col("pred").alias("pred_after"))
    out = index.join(b, key, "left").join(a, key, "left")
    reason = F.when(F.col("status_before").isNull() | F.col("status_after").isNull(), "missing").when(F.col("status_before") != "ok", "before_not_ok").when(F.col("status_after") != "ok", "after_not_ok")
    return out.withColumn("excluded", reason)


def changes(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy before and after over complete cases, the difference, and how many answers changed and how."""
    ok = pairs.where("excluded IS NULL")
    b, a = (F.col("pred_before") == F.col("gold")), (F.col("pred_after") == F.col("gold"))
    out = ok.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(b.cast("double")).alias("before"), F.avg(a.cast("double")).alias("after"), F.count_if(F.col("pred_before") != F.col("pred_after")).alias("changed"), F.count_if(~b & a).alias("gained"), F.count_if(b & ~a).alias("lost")
    )
    return out.select(*keys, "n", F.round("before", 6).alias("accuracy_before"), F.round("after", 6).alias("accuracy_after"), F.round(F.col("after") - F.col("before"), 6).alias("accuracy_delta"), "changed", "gained", "lost")


def exclusions(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.where("excluded IS NOT NULL").groupBy(*keys, "excluded").agg(F.count("*").alias("n"))


def zip_mismatches(left: DataFrame, right: DataFrame, ordinal: str, key: str) -> DataFrame:
    """Positions at which two ordered tables differ in key or length."""
    a, b = left.select(ordinal, F.col(key).alias("left_key")), right.select(ordinal, F.col(key).alias("right_key"))
    return a.join(b, ordinal, "full").where(~F.col("left_key").eqNullSafe(F.col("right_key")))


def metric_changes(pairs: DataFrame, keys: list[str], k: int) -> DataFrame:
    """All metrics of the complete cases before and after, and their differences; null where either is null."""
    from optika.operators import metrics

    ok = pairs.where("excluded IS NULL")
    sides = ok.select(*keys, "gold", F.explode(F.array(F.struct(F.lit("before").alias("phase"), F.col("pred_before").alias("pred")), F.struct(F.lit("after").alias("phase"), F.col("pred_after").alias("pred")))).alias("x")).select(*keys, "gold", "x.*")
    detail = metrics.by_group(sides, [*keys, "phase"], k)
    names = [c for c in detail.columns if c not in (*keys, "phase", "n")]
    pick = lambda c, phase: F.max(F.when(F.col("phase") == phase, F.col(c)))
    out = detail.groupBy(*keys).agg(F.max("n").alias("n"), *(pick(c, p).alias(f"{c}_{p}") for c in names for p in ("before", "after")))
    return out.select(*keys, "n", *(x for c in names for x in (f"{c}_before", f"{c}_after", F.round(F.col(f"{c}_after") - F.col(f"{c}_before"), 6).alias(f"{c}_delta"))))


def inconsistent(before: DataFrame, after: DataFrame, index: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Items whose answers disagree with the index, or with each other, in a field that all three hold."""
    a, b, i = (df.select(key, *(F.col(f).alias(f"_{t}_{f}") for f in fields)) for df, t in ((before, "b"), (after, "a"), (index, "i")))
    j = i.join(a, key).join(b, key)
    bad = F.filter(F.array(*(F.when(~F.col(f"_b_{f}").eqNullSafe(F.col(f"_i_{f}")) | ~F.col(f"_a_{f}").eqNullSafe(F.col(f"_i_{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    return j.select(key, F.explode(bad).alias("field"))
