"""Shared helpers: durable intermediates, connected components, Arrow utilities."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.  Where it is unset a local master gets a temporary folder; on a
    cluster no executor could read what another wrote there, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="optika-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Rows and bytes of an Arrow batch that goes to a Python worker: texts are long, and a batch is held twice.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches; plans read the setting when they run, so it stays set.  A lower bound that
    the session has already is kept."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        have = re.match(r"\s*(\d+)b?\s*$", spark.conf.get(key, None) or "")
        if not have or not 0 < int(have[1]) <= most:
            spark.conf.set(key, str(most))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and returns the table: its lineage is cut and
    a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._optika_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of ``materialize`` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_optika_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release_shuffles(spark: SparkSession, rounds: int = 1) -> None:
    """Lets the driver drop the shuffle files of finished jobs now, not at its next garbage collection.  What Python has
    let go reaches the JVM a little later; further ``rounds`` wait for it."""
    import gc

    for k in range(rounds):
        if k:
            time.sleep(1)
        gc.collect()
        spark._jvm.System.gc()


def hash_sample(df: DataFrame, columns: list[str], rows: int, total: int) -> list:
    """About ``rows`` of the ``total`` rows of df, chosen by a hash of columns: for range cuts and fits, which shape a
    plan but not its result.  Rows are filtered where they are, so that what reaches the driver does not grow with the
    number of tasks; rows that repeat are bounded by the final limit."""
    if total > rows:
        share = int(rows / total * (1 << 62))
        some = df.where(F.shiftrightunsigned(F.xxhash64(*columns), 2) < max(1, share)).limit(4 * rows).collect()
        if some:
            return some
    return df.limit(rows).collect()


def connect(i: int, near: np.ndarray, group: np.ndarray, ids: np.ndarray, u: list, v: list) -> None:
    """One edge from row i to each other group among the rows ``near``; the groups become one."""
    others, first = np.unique(group[near], return_index=True)
    found = {int(g): near[k] for g, k in zip(others, first, strict=True) if g != group[i]}
    low = min([*found, int(group[i])])
    for g, j in found.items():
        u.append(ids[i])
        v.append(ids[j])
    for g in {*found, int(group[i])} - {low}:
        group[group == g] = low


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def _stars(edges: DataFrame) -> bool:
    """Whether edges (u > v) are stars around their smallest nodes: every u has one edge, and no v is a u."""
    ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("k"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up + down > 1").isEmpty()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star steps.

    ``edges`` holds node ids (long) in columns u and v; self loops and nulls are ignored and repeated
    edges do no harm.  Returns ``node, component`` for every node that has an edge to another node; the
    component is its smallest node.  ``discard`` of the result deletes the table that it reads.  Each step is a
    pre-aggregated minimum, written as a table so that the equi-join with it deals the edges anew and Spark can split a
    node that holds most of them; each round is written to the shared folder, and the number of rounds grows with the
    logarithm of the longest path.  It ends when all edges are stars around smallest nodes.
    """
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    now = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialize(now, "cc")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "cc")
        large = both.join(lowest, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc")
        discard(lowest)
        lowest = materialize(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"), "cc")
        small = large.join(lowest, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lowest.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        after = materialize(small, "cc")
        discard(now, large, lowest)
        now = after
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._optika_path = now._optika_path
    return out
