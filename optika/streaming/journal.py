"""Resumable scoring journals with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from optika.operators import results

def score_stream(items: DataFrame, journal: str, checkpoint: str, scorer: Callable[[DataFrame], DataFrame], key: str, provenance: dict[str, str], terminal=("ok",), once: bool = False) -> StreamingQuery:
    """Scores a stream of items into an append-only Parquet journal.

    Each micro-batch leaves out items that the journal has finished, refuses to go on if the journal holds rows of
    another provenance (input, item, model and configuration hashes, or any other columns) or, with ``once``, two ok rows
    of one item, and appends.  A batch that runs again after a failure finds its own rows and adds nothing,
    so the journal is exactly-once per finished key.
    """

    provenance_columns = {k: F.lit(v) for k, v in provenance.items()}

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        # of repeated rows of a key the one with the smallest hash: the same on every run of a batch
        row = F.struct(*df.columns)
        todo = df.groupBy(key).agg(F.min_by(row, F.xxhash64(*df.columns)).alias("_r")).select("_r.*")
        done = read_journal(spark, journal)
        if done is not None:
            # only the journal's rows about this batch are looked at, by key
            own = done.join(todo.select(key), key, "left_semi")
            if own.where(~_same(provenance)).limit(1).count():
                raise ValueError("the journal holds answers of another run configuration")
            if once and results.repeated(own, key).limit(1).count():
                raise ValueError("the journal holds several ok answers to one item")
            todo = results.pending(todo, own, key, terminal)
        scorer(todo).withColumns(provenance_columns).write.mode("append").parquet(journal)

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _same(provenance: dict[str, str]):
    same = F.lit(True)
    for k, v in provenance.items():
        same = same & F.col(k).eqNullSafe(F.lit(v))
    return same


def read_journal(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.parquet(path)


def canonicalize(journal: DataFrame, index: DataFrame, key: str, order: str) -> DataFrame:
    """One row per indexed item, ok answers first, in index order; raises while an item has no ok answer."""
    out = index.select(key, "ordinal").join(results.ok_wins(journal, key, order), key, "left")
    if left := out.where("status IS NULL OR status <> 'ok'").count():
        raise ValueError(f"{left} items are unresolved")
    return out.orderBy("ordinal")


def latest_by_key(events: DataFrame, key: str, order: str) -> DataFrame:
    """A running last-wins reduction of a stream (update or complete output mode)."""
    row = F.struct(*(c for c in events.columns if c != key))
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row, F.col(order)).alias("r")).select(key, "r.*")


def progress(query: StreamingQuery) -> dict:
    """Running totals of a stream: batches, rows read, rows a second over the last batch."""
    last = query.lastProgress
    return {"batches": 0 if last is None else last["batchId"] + 1, "rows": sum(p["numInputRows"] for p in query.recentProgress), "rows_per_second": 0.0 if last is None else last["processedRowsPerSecond"]}
