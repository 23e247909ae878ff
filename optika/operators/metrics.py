"""Distributional metrics of predictions against gold labels.

Every function aggregates in one pass with map-side partial sums: a group's distributions are arrays of k counters,
so labels that never occur are present as zeros and no label grid has to be joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from optika.functions import arrays as A


def _counts(col: str, k: int) -> Column:
    return F.array(*(F.count_if(F.col(col) == j) for j in range(k)))


def _shares(counts: Column) -> Column:
    return F.transform(counts, lambda c: F.coalesce(F.try_divide(c.cast("double"), F.col("n").cast("double")), F.lit(0.0)))


def qwk(n: str, sg: str, sp: str, sgg: str, spp: str, sdd: str) -> Column:
    """Quadratic weighted kappa from integer sums: the weights' common factor cancels.  Null for a zero denominator."""
    expected = F.col(n) * F.col(sgg) + F.col(n) * F.col(spp) - 2 * F.col(sg) * F.col(sp)
    return F.when(expected != 0, 1 - F.try_divide((F.col(n) * F.col(sdd)).cast("double"), expected.cast("double")))


def _sums() -> list[Column]:
    g, p = F.col("gold").cast("long"), F.col("pred").cast("long")
    return [F.count("*").alias("n"), F.sum(g).alias("sg"), F.sum(p).alias("sp"), F.sum(g * g).alias("sgg"), F.sum(p * p).alias("spp"), F.sum((g - p) * (g - p)).alias("sdd"), F.sum(F.abs(g - p)).alias("sad"), F.count_if(g == p).alias("hits")]


def by_group(df: DataFrame, keys: list[str], k: int, ordinal: bool = True) -> DataFrame:
    """Hard metrics of (gold, pred) per group."""
    return finish(two_phase_sums(df, keys, k), keys, k, ordinal)


def finish(agg: DataFrame, keys: list[str], k: int, ordinal: bool = True) -> DataFrame:
    """Metrics from the state."""
    agg = agg.withColumn("p", _shares(F.col("pc"))).withColumn("q", _shares(F.col("gc")))
    agg = agg.withColumn("hp", A.entropy(F.col("p"))).withColumn("hq", A.entropy(F.col("q")))
    r = F.exp("hp") / F.exp("hq")
    cols = {
        "accuracy": F.col("hits").cast("double") / F.col("n"), "u_arg": F.exp("hp") / k, "gold_coverage": F.exp("hq") / k, "relative_utilization": r, "support_deviation": F.abs(r - 1),
        "tvd": A.half_l1(F.col("p"), F.col("q")), "prediction_entropy": F.col("hp") / F.ln(F.lit(float(k))),
    }
    if ordinal:
        cols |= {"nmae": F.try_divide(F.col("sad").cast("double"), (F.col("n") * (k - 1)).cast("double")), "qwk": qwk("n", "sg", "sp", "sgg", "spp", "sdd")}
    return agg.select(*keys, "n", *(F.round(c, 6).alias(name) for name, c in cols.items()))


def chance(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Chance accuracy, chance-corrected accuracy, active labels (at least 1 % of rows), label-space utilisation."""
    agg = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("hits"), _counts("gold", k).alias("gc"), _counts("pred", k).alias("pc"))
    c = F.aggregate(F.zip_with("gc", "pc", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x) / (F.col("n").cast("double") * F.col("n"))
    agg = agg.withColumn("c", c).withColumn("a", F.col("hits").cast("double") / F.col("n"))
    active = F.size(F.filter("pc", lambda x: x >= 0.01 * F.col("n")))
    corrected = F.when(F.col("c") == 1, F.lit(0.0)).otherwise(F.try_divide(F.col("a") - F.col("c"), 1 - F.col("c")))
    return agg.select(*keys, F.round("c", 6).alias("chance_accuracy"), F.round(corrected, 6).alias("corrected_accuracy"), active.cast("long").alias("active_labels"), F.round(active / F.lit(float(k)), 6).alias("label_utilization"))


def soft(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Metrics of probability vectors; null in a group with a row that has none."""
    unit = df.withColumn("u", F.transform(A.unit_sum(F.col("probs")), lambda x: F.coalesce(x, F.lit(0.0))))
    row = unit.withColumn("h", A.entropy(F.col("u")) / F.ln(F.lit(float(k)))).withColumn("m", A.top_two_margin(F.col("u")))
    agg = row.groupBy(*keys).agg(F.count("*").alias("n"), F.count("probs").alias("have"), F.array(*(F.avg(F.get("u", F.lit(j))) for j in range(k))).alias("mean"), F.avg("h").alias("h"), F.avg("m").alias("m"))
    every = F.col("have") == F.col("n")
    cols = {"u_soft": F.exp(A.entropy(F.col("mean"))) / k, "normalized_entropy": F.col("h"), "margin": F.col("m")}
    return agg.select(*keys, "n", *(F.round(F.when(every, c), 6).alias(name) for name, c in cols.items()))


def label_distribution(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Long form of both distributions over all k labels, zeros included."""
    agg = df.groupBy(*keys).agg(F.count("*").alias("n"), _counts("gold", k).alias("gc"), _counts("pred", k).alias("pc"))
    out = agg.select(*keys, "n", F.posexplode(F.arrays_zip("gc", "pc")).alias("label", "c"))
    share = lambda c: F.round(c.cast("double") / F.col("n"), 6)
    return out.select(*keys, "label", share(F.col("c.gc")).alias("gold_share"), share(F.col("c.pc")).alias("pred_share"))


def confusion(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, "gold", "pred").agg(F.count("*").alias("n"))


def confusion_with_sums(df: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with the sums of their row (gold) and column (pred)."""
    cells = confusion(df, keys)
    rows = cells.groupBy(*keys, "gold").agg(F.sum("n").alias("row_sum"))
    columns = cells.groupBy(*keys, "pred").agg(F.sum("n").alias("column_sum"))
    return cells.join(rows, [*keys, "gold"]).join(columns, [*keys, "pred"])


def two_phase_sums(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The mergeable state of hard metrics: counts and integer sums.  States of parts are merged by ``merge_sums``."""
    return df.groupBy(*keys).agg(*_sums(), _counts("gold", k).alias("gc"), _counts("pred", k).alias("pc"))


def merge_sums(states: DataFrame, keys: list[str], k: int) -> DataFrame:
    """States of parts of the data added up, group by group."""
    plain = [c for c in states.columns if c not in (*keys, "gc", "pc")]
    arrays = [F.array(*(F.sum(F.get(c, F.lit(j))) for j in range(k))).alias(c) for c in ("gc", "pc")]
    return states.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in plain), *arrays)


def qwk_variants(df: DataFrame, keys: list[str]) -> DataFrame:
    """Three published conventions: null, or 1, for a zero denominator; and labels compacted to the observed ones."""
    cells = confusion(df, keys)
    labels = cells.select(*keys, F.explode(F.array("gold", "pred")).alias("label")).distinct()
    ranks = labels.withColumn("r", F.dense_rank().over(Window.partitionBy(*keys).orderBy("label")) - 1)
    both = cells.join(ranks.withColumnsRenamed({"label": "gold", "r": "gr"}), [*keys, "gold"]).join(ranks.withColumnsRenamed({"label": "pred", "r": "pr"}), [*keys, "pred"])

    def sums(g: str, p: str, tag: str) -> list[Column]:
        w, a, b = F.col("n").cast("long"), F.col(g).cast("long"), F.col(p).cast("long")
        return [F.sum(w * x).alias(f"{name}{tag}") for name, x in (("sg", a), ("sp", b), ("sgg", a * a), ("spp", b * b), ("sdd", (a - b) * (a - b)))]

    agg = both.groupBy(*keys).agg(F.sum("n").alias("n"), *sums("gold", "pred", ""), *sums("gr", "pr", "r"))
    v1, v3 = qwk("n", "sg", "sp", "sgg", "spp", "sdd"), qwk("n", "sgr", "spr", "sggr", "sppr", "sddr")
    return agg.select(*keys, F.round(v1, 6).alias("qwk_null"), F.round(F.coalesce(v1, F.lit(1.0)), 6).alias("qwk_one"), F.round(v3, 6).alias("qwk_compact"))


def macro(detail: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean over groups of each metric, nulls skipped."""
    return detail.groupBy(*keys).agg(*(F.round(F.avg(m), 6).alias(m) for m in metrics))


def split_accuracy(df: DataFrame, keys: list[str], ordinal: Column) -> DataFrame:
    """Accuracy of all, ordinal and nominal rows, and the mean position error of ordinal rows."""
    hit = (F.col("gold") == F.col("pred")).cast("double")
    return df.groupBy(*keys).agg(F.round(F.avg(hit), 6).alias("accuracy"), F.round(F.avg(F.when(ordinal, hit)), 6).alias("ordinal_accuracy"), F.round(F.avg(F.when(~ordinal, hit)), 6).alias("nominal_accuracy"), F.round(F.avg(F.when(ordinal, F.abs(F.col("gold") - F.col("pred")).cast("double"))), 6).alias("position_error"))
