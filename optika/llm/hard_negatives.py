"""Hard-negative mining by one-dimensional distance keys.

Vectors of whole numbers are augmented by one coordinate to the length of the longest, so that a larger inner product with
an anchor is a smaller distance to it.  Each is keyed by its nearest pivot and the distance to it, and stored sorted by
(pivot, distance) in blocks.  A row at distance r or less of an anchor has, at every pivot, a key within r of the
anchor's own distance: a search scans the key intervals that hold the anchor itself, learns from what it found how near the
rest must be, and widens the intervals to that; inside a scan blocks come by their distance and are passed over once the
bound excludes them.  What is left unscanned is provably too far, so results are exact.

Anchors are searched in groups of neighbours.  A pair of group and block is a row, dealt by group and slice of the
blocks, and a task streams them: it holds one group and one block.  A slice's best rows are merged by anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from optika.llm.common import discard, hash_sample, materialize, shuffle_partitions, small_batches

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative's score lies between these percents of the positive's.
LOWEST, HIGHEST = 50, 95
#: Pivots are fitted on about FIT_ROWS vectors chosen by hash (4 times as many at most); any pivots give the same result.
PIVOTS, FIT_ROWS, MOST_DIMS = 64, 4096, 16
#: Vectors of a block, anchors of a group, and blocks that a task scans for a group.
BLOCK_ROWS, GROUP_ROWS, SLICE = 4096, 256, 16
#: Components are held within these limits, so that an inner product of 2,047 of them fits a long.
MOST = 1 << 26
#: Added to distances in comparisons, in proportion: rounding must not exclude a row.
ROUNDING = 1e-9
_NONE = -(1 << 62)


def _whole(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """vec_id, label, dim, norm and 32-bit components of the rows that take part."""
        for b in batches:
            vec = b.column(2)
            n = np.nan_to_num(pa.compute.list_value_length(vec).to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
            flat = vec.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
            good = np.isfinite(x)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(np.where(good, x, 0) * scale), -MOST, MOST).astype(np.int32)
            at = np.concatenate(([0], np.cumsum(n)))
            keep = [i for i in range(b.num_rows) if n[i] and good[at[i] : at[i + 1]].all()]
            rows = [x[at[i] : at[i + 1]] for i in keep]
            norm = [float((r.astype(np.float64) ** 2).sum()) for r in rows]
            some = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(n[keep].astype(np.int32)), pa.array(norm, pa.float64()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["vec_id", "label", "dim", "norm", "vec"])

    return run


class Pivots:
    """Pivots by dimension, of augmented vectors; a dimension without has the origin alone."""

    def __init__(self, longest: float):
        self.longest, self.own = longest, {}

    def of(self, dim: int) -> np.ndarray:
        return self.own.get(dim, np.zeros((1, dim + 1)))

    def augmented(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(0, self.longest - (x * x).sum(1))
        return np.concatenate([x, np.sqrt(rest)[:, None]], 1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of augmented vectors to the pivots of their dimension."""
        p = self.of(x.shape[1] - 1)
        return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * (x @ p.T)))

    def fit(self, dim: int, x: np.ndarray, rounds: int = 6) -> None:
        """A few rounds of k-means over a sample, from rows spread evenly over it."""
        x = self.augmented(x)
        p = np.unique(x[:: max(1, len(x) // PIVOTS)][:PIVOTS], axis=0)
        for _ in range(rounds):
            self.own[dim] = p
            near = self.distances(x).argmin(1)
            p = np.array([x[near == k].mean(0) if (near == k).any() else p[k] for k in range(len(p))])
        self.own[dim] = p


def _matrix(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32).reshape(-1, dim).astype(np.float64)


def _placed(pivots: Pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            raw = b.column(3).to_pylist()
            pivot, dist = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                d = pivots.distances(pivots.augmented(_matrix(b"".join(raw[i] for i in at), int(dim))))
                pivot[at] = d.argmin(1)
                dist[at] = d.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot), pa.array(dist)], names=[*b.schema.names, "pivot", "dist"])

    return run


_BLOCK = "block long, dim int, pivot int, low double, high double, ids array<long>, names array<string>, labels array<int>, vectors binary"
_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("ids", pa.list_(pa.int64())), ("names", pa.list_(pa.string())), ("labels", pa.list_(pa.int32())), ("vectors", pa.binary())])


def _blocks(most: int, by_pivot: bool):
    """Sorted rows to blocks of one dimension, and of one pivot where asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, key, rows = TaskContext.get().partitionId(), 0, None, []

        def done() -> pa.RecordBatch:
            nonlocal made, rows
            names = sorted({r[1] for r in rows})
            code = {x: i for i, x in enumerate(names)}
            out = {"block": part << 32 | made, "dim": key[0], "pivot": key[1], "low": rows[0][3], "high": rows[-1][3], "ids": [r[0] for r in rows], "names": names, "labels": [code[r[1]] for r in rows], "vectors": b"".join(r[2] for r in rows)}
            made, rows = made + 1, []
            return pa.RecordBatch.from_pylist([out], _BLOCK_SCHEMA)

        for b in batches:
            for i, label, dim, vec, pivot, dist in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("vec_id", "label", "dim", "vec", "pivot", "dist")), strict=True):
                if rows and ((dim, pivot if by_pivot else 0) != key or len(rows) == most or len(rows) * dim * 4 >= 4 << 20):
                    yield done()
                key = (dim, pivot if by_pivot else 0)
                rows.append((i, label, vec, dist))
        if rows:
            yield done()

    return run


def _radius(norm: np.ndarray, longest: float, score: np.ndarray) -> np.ndarray:
    """How far at most a row of that score is from an anchor; without a score, any distance."""
    far = np.sqrt(np.maximum(0, norm + longest - 2.0 * np.where(score == _NONE, 0, score)))
    return np.where(score == _NONE, np.inf, far * (1 + ROUNDING) + ROUNDING)


class Group:
    """Anchors with their requests: each asks, for one anchor, for the first k rows of its own label or of others with a
    score between two limits."""

    def __init__(self, row: dict, pivots: Pivots):
        self.q = _matrix(row["vectors"], row["dim"])
        self.names, self.labels, self.ids = row["names"], np.array(row["labels"]), np.array(row["ids"], np.int64)
        self.norm, self.longest = (self.q * self.q).sum(1), pivots.longest
        self.far = pivots.distances(np.concatenate([self.q, np.zeros((len(self.q), 1))], 1))
        limit = lambda name, none: np.array([none if s[name] is None else s[name] for s in row["slots"]], np.int64)
        self.slot, self.at = limit("slot", 0), limit("pos", 0)
        self.lower, self.upper, self.bound = limit("lower", _NONE), limit("upper", -_NONE), limit("bound", _NONE)

    def radius(self) -> np.ndarray:
        """Of each request."""
        return _radius(self.norm[self.at], self.longest, np.maximum(self.lower, self.bound))


def _intervals(pivots: Pivots, wide: bool):
    """Key intervals of each group at each pivot, without the radius (near, far) and with it (start, stop).  A search
    that is not wide looks where its anchors' own keys are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                g = Group(row, pivots)
                own, r = g.far.argmin(1)[g.at], g.radius()
                for k in range(g.far.shape[1]):
                    d, at = g.far[g.at, k], r if wide else np.where(own == k, 0, -1)
                    if (some := at >= 0).any():
                        out.append({"group": row["block"], "dim": row["dim"], "pivot": k, "near": float(d.min()), "far": float(d.max()), "start": float((d - at)[some].min()), "stop": float((d + at)[some].max())})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("group", pa.int64()), ("dim", pa.int32()), ("pivot", pa.int32()), *((c, pa.float64()) for c in ("near", "far", "start", "stop"))]))

    return run


_INTERVAL = "group long, dim int, pivot int, near double, far double, start double, stop double"


def _best(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each slot by score, of equal ones by id."""
    order = np.lexsort((ids, -score, slot))
    s = slot[order]
    first = np.searchsorted(s, s)
    return order[np.arange(len(s)) - first < k]


def _scan(pivots: Pivots, k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by (group, slice): the group first, then blocks by their gap.  The first k of each request in the slice."""
        g, held, key, scanned = None, None, None, 0
        schema = pa.schema([("group", pa.int64()), ("slot", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("blocks", pa.int64())])

        def told():
            slot, score, ids = held
            n = len(slot)
            # a row without a slot tells how many blocks were compared
            return pa.RecordBatch.from_arrays([pa.array(np.full(n + 1, key)), pa.array([*g.slot[slot].tolist(), None], pa.int64()), pa.array([*ids.tolist(), None], pa.int64()), pa.array([*score.tolist(), None], pa.int64()), pa.array([*[None] * n, scanned], pa.int64())], schema=schema)

        for b in batches:
            for row in b.to_pylist():
                if row["side"] == 0:
                    if g:
                        yield told()
                    g, key, scanned = Group(row, pivots), row["group"], 0
                    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
                    continue
                d = g.far[g.at, row["pivot"]]
                gap = np.maximum(0, np.maximum(d - row["high"], row["low"] - d)) * (1 - ROUNDING)
                open_ = np.flatnonzero(gap <= g.radius())
                if not len(open_):
                    continue
                scanned += 1
                x = _matrix(row["vectors"], row["dim"])
                ids = np.array(row["ids"], np.int64)
                code = {n: i for i, n in enumerate(g.names)}
                labels = np.array([code.get(n, -1) for n in row["names"]])[row["labels"]]
                anchors, back = np.unique(g.at[open_], return_inverse=True)
                q = g.q[anchors]
                if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1] < 1 << 53:
                    scores = q @ x.T  # whole numbers below 2^53: exact
                else:
                    scores = q.astype(np.int64) @ x.T.astype(np.int64)
                lines = 1 + (1 << 22) // max(1, len(ids))
                for i in range(0, len(open_), lines):
                    at, of = open_[i : i + lines], back[i : i + lines]
                    s = scores[of].astype(np.int64)
                    fits = (g.labels[g.at[at]][:, None] == labels) == same
                    fits &= g.ids[g.at[at]][:, None] != ids
                    fits &= (s >= np.maximum(g.lower, g.bound)[at][:, None]) & (s <= g.upper[at][:, None])
                    if len(ids) > k:  # what is below a line's own k-th can't be among the first k
                        some = np.where(fits, s, _NONE)
                        fits &= s >= np.partition(some, len(ids) - k, 1)[:, len(ids) - k][:, None]
                    u, v = np.nonzero(fits)
                    if not len(u):
                        continue
                    slot, score, who = np.concatenate([held[0], at[u]]), np.concatenate([held[1], s[u, v]]), np.concatenate([held[2], ids[v]])
                    keep = _best(slot, score, who, k)
                    held = slot[keep], score[keep], who[keep]
                    counts = np.bincount(held[0], minlength=len(g.slot))
                    last = np.full(len(g.slot), -_NONE)
                    np.minimum.at(last, held[0], held[1])
                    g.bound = np.where(counts == k, np.maximum(g.bound, last), g.bound)
        if g:
            yield told()

    return run


_SLOT = "array<struct<slot:long,pos:int,lower:long,upper:long,bound:long>>"


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("group", "slot").orderBy(F.desc("score"), "vec_id")
    return found.where("slot IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(groups: DataFrame, slots: DataFrame, blocks: DataFrame, pivots: Pivots, k: int, same: bool) -> tuple[DataFrame, list[DataFrame]]:
    """The first k rows of every request: group, slot, vec_id, score, rank; and the tables that it reads.

    slots: group, slot, pos, lower, upper (limits may be null)."""
    boxes = blocks.select("block", "dim", "pivot", "low", "high")
    tables: list[DataFrame] = []
    bounds, before = None, None
    for wide in (False, True):
        open_ = slots.withColumn("bound", F.lit(None).cast("long")) if bounds is None else slots.join(bounds, ["group", "slot"], "left")
        asked = open_.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("slot", "pos", "lower", "upper", "bound"))).cast(_SLOT).alias("slots"))
        state = materialize(groups.join(asked, groups["block"] == asked["group"]).drop("group"), "anchor-groups")
        at = materialize(state.mapInArrow(_intervals(pivots, wide), _INTERVAL), "intervals")
        meet = (F.col("i.dim") == F.col("b.dim")) & (F.col("i.pivot") == F.col("b.pivot")) & (F.col("start") <= F.col("high")) & (F.col("low") <= F.col("stop"))
        pairs = at.alias("i").join(boxes.alias("b"), meet)
        gap = F.greatest(F.lit(0.0), F.col("low") - F.col("far"), F.col("near") - F.col("high"))
        pairs = pairs.select("group", "block", gap.alias("gap"))
        if before is not None:
            pairs = pairs.join(before.select("group", "block"), ["group", "block"], "left_anti")
        pairs = materialize(pairs.withColumn("slice", F.floor(F.pmod(F.xxhash64("block"), F.lit(1 << 40)) % F.greatest(F.lit(1), F.lit(-(-boxes.count() // SLICE))))), "scans")
        data = pairs.join(blocks, "block").select("group", "slice", F.lit(1).alias("side"), "gap", "dim", "pivot", "low", "high", "ids", "names", "labels", "vectors", F.lit(None).cast(_SLOT).alias("slots"))
        none = F.lit(None).cast("double")
        lead = pairs.select("group", "slice").distinct().join(state.withColumnRenamed("block", "group"), "group").select("group", "slice", F.lit(0).alias("side"), none.alias("gap"), "dim", "pivot", none.alias("low"), none.alias("high"), "ids", "names", "labels", "vectors", "slots")
        dealt = data.unionByName(lead).repartition(shuffle_partitions(groups.sparkSession), "group", "slice").sortWithinPartitions("group", "slice", "side", "gap")
        found = materialize(dealt.mapInArrow(_scan(pivots, k, same), "group long, slot long, vec_id long, score long, blocks long"), "found")
        discard(at, state)
        if before is None:
            top = _first(found, k)
            bounds = materialize(top.where(F.col("rank") == k).select("group", "slot", F.col("score").alias("bound")), "bounds")
            tables += [bounds]
        tables += [found, pairs]
        before = pairs
    both = tables[1].unionByName(tables[3])
    return _first(both, k), tables


def mine_negatives(
    vectors: DataFrame, anchors: str = "vec_id % 50 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST, scale: int = SCALE,
    block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS, work: list | None = None,
) -> DataFrame:
    """Hard negatives of vectors (vec_id, embedding, label): for each anchor (rows of the SQL condition ``anchors`` on
    vec_id) and each of its first ``positives`` other rows of equal label, the first ``negatives`` rows of other labels
    whose score lies between ``lowest`` and ``highest`` percent of the positive's.

    A score is the inner product of components floor(scale * x), held within 2^26; higher ones come first, ties by
    smaller vec_id.  Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.  Rows with a null
    id, label or vector, an empty vector, or a null or non-finite component take no part; vectors of different
    dimensions are never compared; of rows that share a vec_id the one of the smallest label (as text) and vector stands
    for it.  An empty table gives an empty result.  ``work`` gets the tables of what was scanned.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.mapInArrow(_whole(scale), "vec_id long, label string, dim int, norm double, vec binary")
    rows = materialize(rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec", "dim", "norm")).alias("r")).select("vec_id", "r.label", "r.dim", "r.vec", "r.norm"), "vectors")
    total = rows.agg(F.count("*").alias("n"), F.max("norm").alias("longest")).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not total["n"]:
        return spark.createDataFrame([], out)
    pivots = Pivots(total["longest"])
    sample: dict[int, list] = {}
    for dim, vec in sorted((r["dim"], bytes(r["vec"])) for r in hash_sample(rows.select("dim", "vec", "vec_id"), ["vec_id"], FIT_ROWS, total["n"])):
        sample.setdefault(dim, []).append(vec)
    for dim in sorted(sample, key=lambda d: (-len(sample[d]), d))[:MOST_DIMS]:
        pivots.fit(dim, _matrix(b"".join(sample[dim]), dim))
    order = ["dim", "pivot", "dist", "vec_id"]
    placed = rows.select("vec_id", "label", "dim", "vec").mapInArrow(_placed(pivots), "vec_id long, label string, dim int, vec binary, pivot int, dist double")
    parts = max(1, min(shuffle_partitions(spark), -(-total["n"] // (4 * block_rows))))
    blocks = materialize(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_blocks(block_rows, True), _BLOCK), "blocks")
    groups = materialize(placed.where(anchors).repartitionByRange(max(1, parts // 8), *order).sortWithinPartitions(*order).mapInArrow(_blocks(group_rows, False), _BLOCK), "anchors")
    names = materialize(groups.select(F.col("block").alias("group"), F.posexplode("ids").alias("pos", "anchor_id")), "anchor-ids")
    none = F.lit(None).cast("long")
    first, read = _search(groups, names.select("group", F.col("pos").cast("long").alias("slot"), "pos", none.alias("lower"), none.alias("upper")), blocks, pivots, positives, True)
    first = materialize(first.select("group", F.col("slot").cast("int").alias("pos"), F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    exact = F.col("positive_score").cast("decimal(20,0)")
    limits = first.select("group", (F.col("pos").cast("long") * positives + F.col("place") - 1).alias("slot"), "pos", F.ceil(exact * lowest / 100).cast("long").alias("lower"), F.floor(exact * highest / 100).cast("long").alias("upper"))
    chosen, more = _search(groups, limits.where("lower <= upper"), blocks, pivots, negatives, False)
    pairs = first.withColumn("slot", F.col("pos").cast("long") * positives + F.col("place") - 1).join(names, ["group", "pos"])
    result = materialize(pairs.join(chosen, ["group", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    if work is not None:
        work += [t for t in (*read, *more) if "blocks" in t.columns]
    else:
        discard(*read, *more)
    discard(rows, blocks, groups, names, first)
    return result


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Mines negatives from all embeddings; labels of every seventh vec_id are first moved on by one, modulo 10."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine_negatives(rows.withColumn("label", label))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
         s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT * FROM n WHERE rank <= 3
"""
