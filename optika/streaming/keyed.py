"""Answers of a stream reduced by key in state, so that no batch reads what earlier ones wrote.

The state of a key is its latest row, its latest ok row and the provenance of its rows.  Each batch emits the canonical
row of the keys that it touched (the latest ok one, else the latest), with a version that rises with every change, and
appends it to the sink under the batch's own folder: a batch that runs again after a failure overwrites what it wrote.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state needs; it lives in the query's checkpoint, which names the shared folder.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTING = "spark.sql.streaming.stateStore.providerClass"
_ROW = "at long, status string, payload string"
_OUT = "key string, at long, status string, payload string, version long"


class CanonicalRow(StatefulProcessor):
    """Rows of a key (at, status, payload, provenance) in any order and any batches."""

    def __init__(self, provenance: str | None = None, once: bool = False):
        self.provenance, self.once = provenance, once

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _ROW)
        self.ok = handle.getValueState("ok", _ROW)
        self.version = handle.getValueState("version", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        ok = self.ok.get() if self.ok.exists() else None
        before = ok or last
        for frame in rows:
            for at, status, payload, provenance in zip(frame["at"], frame["status"], frame["payload"], frame["provenance"], strict=True):
                if self.provenance is not None and provenance != self.provenance:
                    raise ValueError(f"{key[0]}: an answer of another run configuration")
                row = (int(at), status, payload)
                # of equal places the larger row, so that the result does not depend on the order of arrival
                if last is None or (row[0], row[1] or "", row[2] or "") > (last[0], last[1] or "", last[2] or ""):
                    last = row
                if status == "ok":
                    if self.once and ok is not None and row != tuple(ok):
                        raise ValueError(f"{key[0]}: several ok answers")
                    if ok is None or (row[0], row[2] or "") > (ok[0], ok[2] or ""):
                        ok = row
        now = ok or last
        if last is not None:
            self.last.update(tuple(last))
        if ok is not None:
            self.ok.update(tuple(ok))
        if now is not None and (before is None or tuple(now) != tuple(before)):
            n = (self.version.get()[0] if self.version.exists() else 0) + 1
            self.version.update((n,))
            yield pd.DataFrame({"key": [key[0]], "at": [now[0]], "status": [now[1]], "payload": [now[2]], "version": [n]})

    def close(self) -> None:
        pass


def reduce_stream(answers: DataFrame, out: str, checkpoint: str, key: str, order: str, status: str = "status", provenance: list[str] | None = None, expected: dict[str, object] | None = None, once: bool = False) -> StreamingQuery:
    """Reduces a stream of answers to one row for each key, latest ok first, until its input is used up; begun again with
    the same checkpoint it goes on where it ended.  Rows without a key are left out.

    ``expected`` gives the value of each provenance column that all rows must carry, ``once`` refuses a second, different ok
    row of a key; either ends the stream with an error.  ``latest`` reads the result."""
    columns = [c for c in answers.columns if c not in (key, order, status)]
    payload = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}) if columns else F.lit(None).cast("string")
    told = F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in provenance)), {"ignoreNullFields": "false"}) if provenance else F.lit("")
    rows = answers.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("at"), F.col(status).alias("status"), payload.alias("payload"), told.alias("provenance"))
    want = json.dumps({c: None if expected[c] is None else str(expected[c]) for c in provenance}, ensure_ascii=False, separators=(",", ":")) if provenance and expected else None
    reduced = rows.groupBy("key").transformWithStateInPandas(CanonicalRow(want, once), _OUT, "Update", "None")

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    session = answers.sparkSession
    before = session.conf.get(_SETTING, None)
    session.conf.set(_SETTING, PROVIDER)  # the query keeps the settings that it began with
    try:
        return reduced.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        session.conf.set(_SETTING, before) if before else session.conf.unset(_SETTING)


def latest(spark: SparkSession, out: str) -> DataFrame:
    """key, at, status, payload of each key's latest version."""
    rows = spark.read.schema(_OUT + ", batch long").parquet(out)
    return rows.groupBy("key").agg(F.max_by(F.struct("at", "status", "payload"), "version").alias("r")).select("key", "r.*")
