"""Frozen indexes: projections of items that leave the text out, and joins in which a missing row is an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optika.functions import text as T
from optika.sources.scratch import written


def with_ordinal(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ordinal, the place from 0 in a total order.

    Rows are range-partitioned by bounds that Spark samples, sorted, and written once with their partition and place in it;
    the sizes of partitions, a row for each, are summed up and added.  The plan does not grow with the rows, no range goes
    through the driver, and what is read afterwards can't fall into other ranges."""
    place = F.monotonically_increasing_id()  # partition number and, below it, place in the partition
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", place)
    ranged = written(ranged, "ordinal")
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.alias("_g")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    sizes = F.broadcast(sizes.select("_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))  # a row for each partition
    joined = ranged.join(sizes, part == F.col("_g"))
    return joined.withColumn("ordinal", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).drop("_at", "_g", "_before")


def _without(df: DataFrame, *gone: str) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in gone)).alias("row_without_context")


def _pick(df: DataFrame, name: str, kind: str = "string") -> Column:
    return (F.col(name) if name in df.columns else F.lit(None).cast(kind)).alias(name)


def _hashes(df: DataFrame) -> list[Column]:
    rows = [c for c in df.columns if c != "ordinal"]
    return [T.canonical_sha(df, *rows).alias("row_sha256"), T.sha(F.col("context")).alias("context_sha256")]


def main_index(df: DataFrame) -> DataFrame:
    """Items (with ordinal) as index records: ids, stratum, provenance, hashes, and the row without its context."""
    names = ["ordinal", "sample_id", "source", "original_id", "split", "sampling_stratum", "sampling_seed", "source_repo", "source_revision", "task_type"]
    return df.select(*(_pick(df, c) for c in names), F.size("choices").alias("option_count"), _pick(df, "gold_position", "int"), *_hashes(df), _without(df, "context", "ordinal"))


def position_index(df: DataFrame) -> DataFrame:
    """Order variants as index records."""
    return df.select(
        "ordinal", "sample_id", "base_sample_id", "source", "order_variant", F.size("choices").alias("option_count"), "gold_position", "original_gold_position",
        F.col("choice_permutation_new_to_original").alias("permutation_new_to_canonical"), *_hashes(df), _without(df, "context", "ordinal"),
    )


def kcurve_index(df: DataFrame, nominal: str = "dbpedia14") -> DataFrame:
    """Option-count variants as index records.  Rows of the nominal source name classes; the others name levels, which
    count from 1 in the rows and from 0 in the index."""
    is_nominal = F.col("source") == nominal
    branch = lambda yes, no: F.when(is_nominal, yes).otherwise(no)
    none = F.lit(None)
    return df.select(
        "ordinal", "sample_id", "base_sample_id", "source", "task_type", "option_count", "gold_position", _pick(df, "binning_method"), _pick(df, "candidate_set_id"),
        branch(F.col("gold_source_class_index"), F.col("gold_canonical_level").cast("int") - 1).alias("gold_canonical_level"),
        branch(F.col("choice_permutation_new_to_source_class"), F.col("choice_permutation_new_to_canonical")).alias("permutation_new_to_canonical"),
        branch(F.col("candidate_source_class_indices"), none).alias("candidate_set_canonical"), branch(none, F.col("bin_edges")).alias("bin_edges"), *_hashes(df), _without(df, "context", "ordinal"),
    )


def restored(index: DataFrame, contexts: DataFrame, key: str = "sample_id") -> DataFrame:
    """Index records with their rows put together again from the context (key, context)."""
    rows = index.select(key, "ordinal", "row_without_context.*") if key not in index.schema["row_without_context"].dataType.names else index.select("ordinal", "row_without_context.*")
    return require_partners(rows, contexts.select(key, "context"), [key], "contexts")


def drifted(rows: DataFrame, index: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows (key, row_sha256) whose hash is not the frozen one; there must be none."""
    frozen = index.select(F.col(key).alias("_k"), F.col("row_sha256").alias("frozen_sha256"))
    return rows.join(frozen, F.col(key) == F.col("_k")).where(~F.col("row_sha256").eqNullSafe(F.col("frozen_sha256"))).drop("_k")


def require_partners(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The join of left with right, in which every row of left must have a partner: a row without one fails the job
    where it is met, so that no second pass is needed."""
    there = right.withColumn("_there", F.lit(True))
    joined = left.join(there, keys, "left")
    told = F.concat(F.lit(f"{what}: no row for "), F.to_json(F.struct(*keys)))
    return joined.where(F.when(F.col("_there"), True).otherwise(F.raise_error(told).cast("boolean"))).drop("_there")


def first_match(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Left with the first row of right (by ``order``) for its keys, null where there is none."""
    row = F.struct(*(c for c in right.columns if c not in keys))
    return left.join(right.groupBy(*keys).agg(F.min_by(row, F.col(order)).alias("_first")), keys, "left").select(*left.columns, "_first.*")


def constant_attribute(df: DataFrame, key: str, value: str) -> DataFrame:
    """The one value of an attribute inside each group; a group with several fails the job."""
    agg = df.groupBy(key).agg(F.min(value).alias(value), F.count_distinct(F.struct(value)).alias("_n"))
    return agg.select(key, F.when(F.col("_n") == 1, F.col(value)).otherwise(F.raise_error(F.concat(F.lit(f"{value} varies in "), F.col(key).cast("string")))).alias(value))


def hash_recovered(candidates: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted rows (source, sample_id, context_sha256) found again by content: candidates (source, row, variants: array of
    texts) are matched by the hash of a variant.

    Of a candidate the first variant that matches counts; a wanted hash is used up by the first candidate (by row), and of
    wanted rows with equal hashes the last stands for it.  source, sample_id, context_sha256, row, variant, context."""
    hashes = candidates.select("source", "row", F.posexplode("variants").alias("variant", "context")).withColumn("context_sha256", T.sha(F.col("context")))
    open_ = wanted.groupBy("source", "context_sha256").agg(F.max("sample_id").alias("sample_id"))
    hits = hashes.join(open_, ["source", "context_sha256"])
    first_variant = hits.groupBy("source", "row").agg(F.min_by(F.struct("variant", "context", "context_sha256", "sample_id"), "variant").alias("h")).select("source", "row", "h.*")
    won = first_variant.groupBy("source", "sample_id").agg(F.min_by(F.struct("context_sha256", "row", "variant", "context"), "row").alias("h"))
    return won.select("source", "sample_id", "h.*")


def unrecovered(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Wanted rows that were not found again; there must be none."""
    return wanted.join(found.select("source", "sample_id"), ["source", "sample_id"], "left_anti")


def overwrite_merge(parts: list[DataFrame], key: str) -> DataFrame:
    """Tables merged by key, where a later table's row replaces an earlier one's."""
    rows = None
    for i, p in enumerate(parts):
        p = p.withColumn("_turn", F.lit(i))
        rows = p if rows is None else rows.unionByName(p, allowMissingColumns=True)
    row = F.struct(*(c for c in rows.columns if c not in (key, "_turn")))
    return rows.groupBy(key).agg(F.max_by(row, "_turn").alias("r")).select(key, "r.*")
