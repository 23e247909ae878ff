"""Exact substring deduplication over a log-structured fingerprint index.

A window is ``window`` consecutive words.  Windows are stored by segments: a segment is a maximal run of
windows of one document that share their minimizer, the smallest hash of the ``gram``-word sequences inside a
window.  Equal windows have equal minimizers, so

* a segment whose whole word sequence occurred earlier is a repeat as a unit, and the first occurrence of any
  window lies in a segment that is itself a first occurrence;
* windows of two different first segments can be equal only if the segments share their minimizer.  Such
  segments (the rims of repeated passages) are contested and are verified window by window.

The index is a set of immutable runs: tables of first segments, bucketed and sorted by minimizer.  A batch of documents
is fingerprinted and dealt out by minimizer into as many buckets; runs are read bucket by bucket where they are, so
that history is never shuffled, and one ordered pass over each bucket yields the batch's repeats, the contested segments
and the batch's own run.  With more than ``fan_in`` runs they are compacted into one.  Runs and their manifest are files, so
an index can be opened again in another session.  Batches must come in ascending doc_id order.

Segments and windows are compared by two independent 64-bit polynomial hashes of their words.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from optika.llm import textkit as tk
from optika.llm.common import discard, materialize, release_shuffles, scratch_root, shuffle_partitions, small_batches

WINDOW, GRAM = 20, 5
#: Batches of the query and runs that make it compact: the fourth batch's run is merged with the three before it.
BATCHES, FAN_IN = 5, 3
_U = np.uint64
_SECOND = _U(0x3C79AC492BA7B653)
_SEGMENT = "minimizer long, segment long, proof long, doc_id long, part int, start int, windows int, state int"
#: state of a segment row: of the batch; of the batch and always contested (its minimizer repeats inside it); of the batch and
#: surely a repeat (an equal segment comes earlier in the same chunk of texts); of a run.
_NEW, _REPEATS, _SURE, _OLD = 0, 1, 2, 3
#: kind of a merged row: a repeat; a first segment, which the run consists of; a segment of an older run, now contested.
_REPEAT, _FIRST, _OLD_CONTESTED = 0, 1, 2


def _window_minima(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k consecutive values."""
    width = 1
    while width * 2 <= k:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (k - width)], x[k - width :]) if k > width else x


def _second(h: np.ndarray) -> np.ndarray:
    """Word hashes for the second polynomial."""
    return tk.mix(h ^ _SECOND)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of texts in document order: (doc_id, part, text, ...)."""
    for c in tk.chunks(batches, "text"):
        yield c.take(pa.array(np.lexsort((c.column(1).to_numpy(), c.column(0).to_numpy()))))


def _segments(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            docs, part = c.column(0).to_numpy(), c.column(1).to_numpy()
            w = tk.words(c.column(2))
            h = w.hashes()
            at = tk.valid_runs(w.bounds, window)
            if not len(at):
                continue
            grams = tk.sequence_hashes(h, gram)
            low = _window_minima(grams, window - gram + 1)[at]
            first = np.ones(len(at), bool)
            first[1:] = (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)
            s = np.flatnonzero(first)
            n = np.diff(np.append(s, len(at)))
            begin = at[s]
            # hashes of the segment's words: prefix sums of a polynomial, shifted back to power 0
            both = []
            for x, base in ((h, tk.SEQUENCE_BASE), (_second(h), tk.SECOND_BASE)):
                up, down = _polynomial(len(h), base)
                sums = np.zeros(len(x) + 1, np.uint64)
                np.cumsum(x * up[: len(x)], out=sums[1:])
                both.append(tk.mix((sums[begin + n + window - 1] - sums[begin]) * down[begin] + n.astype(np.uint64)))
            seg, proof = both
            low = low[s]
            hits = np.zeros(len(grams) + 1, np.int64)
            # a minimizer that occurs twice in a segment's span may repeat a window inside the segment
            order = np.argsort(low, kind="stable")
            pos = np.searchsorted(low[order], grams)
            pos[pos == len(low)] = 0
            np.cumsum(low[order][pos] == grams, out=hits[1:])
            span = hits[begin + n + window - gram] - hits[begin]
            twice = (span > 1) & (n > 1)
            for i in np.flatnonzero(twice):
                twice[i] = np.count_nonzero(grams[begin[i] : begin[i] + n[i] + window - gram] == low[i]) > 1
            owner = np.searchsorted(w.bounds, begin, "right") - 1
            doc, part_of, start = docs[owner], part[owner], begin - w.bounds[owner]
            state = np.where(twice, _REPEATS, _NEW)
            # of equal segments of a chunk only the first can be the first of all; the others are repeats for sure and get
            # a key of their own, so that a passage of very many documents does not meet in one task
            by = np.lexsort((start, part_of, doc, proof, seg))
            head = _heads(seg[by], proof[by])
            same = (doc[by] == doc[by][head]) & (part_of[by] == part_of[by][head]) & (start[by] == start[by][head])
            sure = by[~same]
            state[sure] = _SURE
            low = low.copy()
            low[sure] = tk.mix(seg[sure] + tk.mix(doc[sure].view(np.uint64) + part_of[sure].astype(np.uint64)) + start[sure].astype(np.uint64))
            cols = [low.view(np.int64), seg.view(np.int64), proof.view(np.int64), doc, part_of.astype(np.int32), start.astype(np.int32), n.astype(np.int32), state.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["minimizer", "segment", "proof", "doc_id", "part", "start", "windows", "state"])

    return run


def _heads(*keys: np.ndarray) -> np.ndarray:
    """For sorted rows, the first row with the same keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)


_POLY: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _polynomial(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse."""
    key = int(base)
    if key not in _POLY or len(_POLY[key][0]) < n + 1:
        _POLY[key] = tk._powers(base, n + 1), tk._powers(_U(pow(key, -1, 2**64)), n + 1)
    return _POLY[key]


_PLACE = ["doc_id", "part", "start"]
_RUN = ["minimizer", "segment", "proof", *_PLACE, "windows"]


def merged(rows: DataFrame) -> DataFrame:
    """Batch and runs (minimizer, segment, proof, doc_id, part, start, windows, state), clustered by minimizer, to the
    batch's rows and newly contested old ones, with their kind and whether they are contested.

    All windows are over orders that begin with the minimizer, so one sort serves them and they spill: no minimizer
    has to fit in memory."""
    segment = Window.partitionBy("minimizer", "segment", "proof").orderBy(*_PLACE, "state")
    place = F.struct(*_PLACE)
    rows = rows.withColumn("head", F.first(F.struct(*_PLACE, "state")).over(segment)).withColumn("turn", F.row_number().over(segment))
    every = Window.partitionBy("minimizer")
    first = (F.col("turn") == 1) & (F.col("state") != _SURE)
    rows = rows.withColumn("different", F.count_if(first).over(every)).withColumn("fresh", F.count_if(first & (F.col("state") != _OLD)).over(every))
    old = F.col("state") == _OLD
    # a row at its segment's first place is a repeated row of the table, not a repeat
    at_head = place == F.struct(*(F.col(f"head.{c}").alias(c) for c in _PLACE))
    kind = (
        F.when(F.col("state") == _SURE, _REPEAT).when(old & (F.col("fresh") > 0) & (F.col("different") - F.col("fresh") == 1), _OLD_CONTESTED).when(old, None)
        .when(F.col("turn") == 1, _FIRST).when(~at_head, _REPEAT)
    )
    contested = (F.col("state") != _SURE) & (old | ((F.col("turn") == 1) & ((F.col("different") > 1) | (F.col("state") == _REPEATS))))
    return rows.select(*_RUN, contested.alias("contested"), kind.alias("kind")).where("kind IS NOT NULL")


class FingerprintIndex:
    """Sorted immutable runs of first segments, grown batch by batch in ascending doc_id order.

    ``folder`` holds the runs and a manifest that names them; an index whose manifest exists is opened."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, fan_in: int = FAN_IN, folder: str | None = None):
        self.spark, self.window, self.gram, self.fan_in = spark, window, gram, fan_in
        self.folder = folder or f"{scratch_root(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.buckets = shuffle_partitions(spark)
        self.runs: list[str] = []
        self._tables: dict[str, str] = {}
        if self._exists(f"{self.folder}/manifest"):
            m = json.loads(spark.read.text(f"{self.folder}/manifest").first()["value"])
            if (m["window"], m["gram"]) != (window, gram):
                raise ValueError(f"the index holds windows of {m['window']} words and grams of {m['gram']}")
            self.runs, self.buckets = m["runs"], m["buckets"]

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _commit(self) -> None:
        """A run counts once the manifest names it."""
        text = json.dumps({"window": self.window, "gram": self.gram, "buckets": self.buckets, "runs": self.runs})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest")

    def _write(self, rows: DataFrame, name: str) -> None:
        """A table below the folder, in one file per kind and bucket, sorted by minimizer."""
        table = f"optika_{uuid.uuid4().hex}"
        writer = rows.write.partitionBy("kind").bucketBy(self.buckets, "minimizer").sortBy("minimizer", "segment")
        writer.option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(table)
        self._tables[name] = table

    def table(self, name: str) -> DataFrame:
        """A table of the index; its buckets are known to the planner."""
        if name not in self._tables:
            table = f"optika_{uuid.uuid4().hex}"
            columns = "minimizer BIGINT, segment BIGINT, proof BIGINT, doc_id BIGINT, part INT, start INT, windows INT, contested BOOLEAN, kind INT"
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY (kind) CLUSTERED BY (minimizer) SORTED BY (minimizer, segment) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
            self.spark.sql(f"MSCK REPAIR TABLE {table}")
            self._tables[name] = table
        return self.spark.table(self._tables[name])

    def run(self, name: str) -> DataFrame:
        return self.table(name).where(F.col("kind") == _FIRST)

    def merge_plan(self, docs: DataFrame) -> DataFrame:
        """The merge of a batch (doc_id not null, part, text) with all runs."""
        rows = docs.select("doc_id", "part", "text").mapInArrow(_segments(self.window, self.gram), _SEGMENT).repartition(self.buckets, "minimizer")
        for name in self.runs:
            rows = rows.unionByName(self.run(name).select(*_RUN, F.lit(_OLD).alias("state")))
        return merged(rows)

    def add(self, docs: DataFrame) -> DataFrame:
        """Merges a batch into the index.  Returns doc_id, part, start, windows, contested: the batch's repeated
        segments, and the segments of batch and history that must be verified window by window."""
        name = f"run-{uuid.uuid4().hex}"
        self._write(self.merge_plan(docs), name)
        found = self.table(name).where((F.col("kind") != _FIRST) | F.col("contested")).select(*_PLACE, "windows", "contested")
        self.runs.append(name)
        if len(self.runs) > self.fan_in:
            self.compact()
        self._commit()
        return found

    def compact(self) -> None:
        """Merges the runs into one, bucket by bucket; the tables of the old runs stay for who reads their repeats."""
        rows = None
        for name in self.runs:
            part = self.run(name)
            rows = part if rows is None else rows.unionByName(part)
        # a window over the minimizer keeps the buckets together without a shuffle
        rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("minimizer").orderBy("segment"))).drop("turn")
        name = f"run-{uuid.uuid4().hex}"
        self._write(rows, name)
        self.runs = [name]

    def drop(self) -> None:
        """Deletes the index."""
        for t in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self._tables, self.runs = {}, []
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def _flat(part: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    col = part.column(part.schema.get_field_index(name))
    offs = np.concatenate(([0], np.cumsum(np.nan_to_num(pa.compute.list_value_length(col).to_numpy(zero_copy_only=False), nan=0).astype(np.int64))))
    return col.flatten().to_numpy(zero_copy_only=False), offs


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = int(n.sum())
    return np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)


def _contested_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            w = tk.words(c.column(2))
            h = w.hashes()
            start, offs = _flat(c, "starts")
            n, _ = _flat(c, "counts")
            owner = np.repeat(np.arange(c.num_rows), np.diff(offs))
            at = _ranges(start.astype(np.int64), n.astype(np.int64))
            who = np.repeat(owner, n)
            doc, part = c.column(0).to_numpy()[who], c.column(1).to_numpy()[who]
            spot = at + w.bounds[who]
            first, second = tk.sequence_hashes(h, window)[spot], tk.sequence_hashes(_second(h), window, tk.SECOND_BASE)[spot]
            # as with segments, what a chunk knows to be repeats is dealt out by keys of its own
            by = np.lexsort((at, part, doc, second, first))
            first, second, doc, part, at = (x[by] for x in (first, second, doc, part, at))
            head = _heads(first, second)
            sure = (doc != doc[head]) | (part != part[head]) | (at != at[head])
            first = np.where(sure, tk.mix(first + tk.mix(doc.view(np.uint64) + part.astype(np.uint64)) * _U(0x9E3779B97F4A7C15) + at.astype(np.uint64)), first)
            cols = [first.view(np.int64), second.view(np.int64), doc, part.astype(np.int32), at.astype(np.int32), sure]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["hash", "proof", *_PLACE, "sure"])

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (hash, proof, place): all but the first of each hash, and those that are repeats for sure."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        h, proof, sure = cols[0], cols[1], cols[5]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (proof[1:] != proof[:-1])
        new[0] = last is None or (h[0], proof[0]) != last[:2]
        at, heads = np.cumsum(new) - 1, np.flatnonzero(new)
        firsts = [np.where(at < 0, last[k] if last else 0, x[heads[at]] if len(heads) else 0) for k, x in enumerate(cols[2:5], 2)]
        last = (h[-1], proof[-1], *(f[-1] for f in firsts))
        away = sure.astype(bool)
        for x, f in zip(cols[2:5], firsts, strict=True):
            away = away | (x != f)
        yield batch.select([2, 3, 4]).filter(pa.array(away))


def _apply(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in tk.chunks(batches, "text"):
            col = c.column(c.schema.get_field_index("text"))
            w = tk.words(col)
            start, offs = _flat(c, "starts")
            n, _ = _flat(c, "counts")
            owner = np.repeat(np.arange(c.num_rows), np.diff(offs))
            a = start.astype(np.int64) + w.bounds[owner]
            step = np.zeros(len(w.starts) + 1, np.int64)
            np.add.at(step, a, 1)
            np.add.at(step, a + n.astype(np.int64) + window - 1, -1)
            gone = np.cumsum(step[:-1]) > 0
            total = np.concatenate(([0], np.cumsum(gone)))
            removed = total[w.bounds[1:]] - total[w.bounds[:-1]]
            # kept words joined by one space: copy each kept word's bytes and a space
            keep = ~gone
            length = (w.ends - w.starts)[keep] + 1
            at = _ranges(w.starts[keep], length)
            ends = np.cumsum(length)
            data = w.data[np.minimum(at, len(w.data) - 1)] if len(at) else np.zeros(0, np.uint8)
            data[ends - 1] = 0x20
            upto = np.concatenate(([0], ends))
            kept = np.concatenate(([0], np.cumsum(keep)))[w.bounds]
            blob = data.tobytes()
            parts = [blob[upto[i] : max(upto[i], upto[j] - 1)] for i, j in zip(kept[:-1], kept[1:], strict=True)]
            got = [c.column(0), pa.array(w.counts()), pa.array(removed), pa.array(parts, pa.binary()).cast(pa.string())]
            carried = range(4, c.num_columns)
            yield pa.RecordBatch.from_arrays([*got, *(c.column(k) for k in carried)], names=["doc_id", "n_words", "n_removed", "kept_text", *(c.schema.names[k] for k in carried)])

    return run


#: Rows without a doc_id get ids from here on, by a hash of their text.
_NULL_ID = 1 << 62


def with_parts(docs: DataFrame) -> DataFrame:
    """Adds part: 0, but where rows share a doc_id and not the text the place of the text's hash among them, so that
    (doc_id, part) names one text.  The rows of such ids are found from (doc_id, hash) alone."""
    tid = F.xxhash64(F.coalesce("text", F.lit("")))
    shared = docs.groupBy(F.col("doc_id").alias("_d")).agg(F.min(tid).alias("low"), F.max(tid).alias("high")).where("low <> high").select("_d")
    shared = materialize(shared, "shared-ids")
    if shared.isEmpty():
        discard(shared)
        return docs.withColumn("part", F.lit(0))
    texts = docs.select(F.col("doc_id").alias("_d"), tid.alias("_t")).join(shared, "_d", "left_semi").distinct()
    place = F.row_number().over(Window.partitionBy("_d").orderBy("_t")) - 1
    texts = materialize(texts.withColumn("part", place), "shared-parts")
    out = docs.join(texts, (F.col("doc_id") == F.col("_d")) & (tid == F.col("_t")), "left")
    return out.select(*docs.columns, F.coalesce("part", F.lit(0)).alias("part"))


def repeated_ranges(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, gram: int = GRAM, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, part, start, windows: ranges of windows that occur earlier, found by merging ``batches`` batches of
    ascending doc_id into a FingerprintIndex and verifying the contested segments window by window."""
    spark = docs.sparkSession
    index = FingerprintIndex(spark, window, gram, fan_in)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    bounds = [None, *sorted(set(cuts or [])), None]
    found = None
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        part = docs
        if lo is not None:
            part = part.where(F.col("doc_id") > lo)
        if hi is not None:
            part = part.where(F.col("doc_id") <= hi)
        got = index.add(part)
        found = got if found is None else found.unionByName(got)
        release_shuffles(spark)
    rims = found.where("contested").select(*_PLACE, "windows").distinct()
    rims = rims.groupBy(F.col("doc_id").alias("_d"), F.col("part").alias("_p")).agg(F.collect_list(F.struct("start", "windows")).alias("r")).select("_d", "_p", F.col("r.start").alias("starts"), F.col("r.windows").alias("counts"))
    windows = docs.join(rims.hint("shuffle_hash"), (F.col("doc_id") == F.col("_d")) & (F.col("part") == F.col("_p"))).select("doc_id", "part", "text", "starts", "counts")
    windows = windows.mapInArrow(_contested_windows(window), "hash long, proof long, doc_id long, part int, start int, sure boolean")
    later = windows.repartition(shuffle_partitions(spark), "hash").sortWithinPartitions("hash", "proof", *_PLACE).mapInArrow(_later, "doc_id long, part int, start int")
    out = found.where("NOT contested").select(*_PLACE, "windows").unionByName(later.select(*_PLACE, F.lit(1).alias("windows")))
    out = materialize(out, "ranges")
    index.drop()
    release_shuffles(spark)
    return out


def remove_repeats(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, gram: int = GRAM, carry: list[str] | None = None) -> DataFrame:
    """Removes each word covered by a window of ``window`` words whose word sequence also starts earlier
    (smaller doc_id, or the same document at an earlier word).  docs: doc_id, text.

    Returns doc_id, n_words, n_removed, kept_text (the kept words joined by one space), one row per row of docs, and
    the columns of docs named in ``carry``.
    Null and empty texts have no words.  doc_id is below 2**62; rows with a null doc_id come after all others, in
    the order of a hash of their text.  Rows that repeat a doc_id and text are one document and get the same result;
    rows that repeat a doc_id with another text are documents of their own, in the order of a hash of their text.
    An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    carry = carry or []
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID) + F.shiftrightunsigned(F.xxhash64("text"), 3)).alias("doc_id")
    extra = [f"_{c}" for c in carry]
    own = with_parts(docs.select(key, F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"_{c}") for c in carry)))
    spans = repeated_ranges(own.select("doc_id", "part", "text"), batches, window, gram)
    spans = spans.groupBy(F.col("doc_id").alias("_d"), F.col("part").alias("_p")).agg(F.collect_list(F.struct("start", "windows")).alias("r")).select("_d", "_p", F.col("r.start").alias("starts"), F.col("r.windows").alias("counts"))
    out = own.join(spans.hint("shuffle_hash"), (F.col("doc_id") == F.col("_d")) & (F.col("part") == F.col("_p")), "left").select("doc_id", "text", "starts", "counts", *extra)
    kinds = {f"_{c}": docs.schema[c].dataType.simpleString() for c in carry}
    out = out.mapInArrow(_apply(window), "doc_id long, n_words long, n_removed long, kept_text string" + "".join(f", `{c}` {kinds[c]}" for c in extra))
    return out.select(F.when(F.col("doc_id") < _NULL_ID, F.col("doc_id")).alias("doc_id"), "n_words", "n_removed", "kept_text", *(F.col(f"`_{c}`").alias(c) for c in carry))


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
