"""Embedding near-duplicates by an epsilon grid order join.

Vectors of one label and dimension are scaled to unit length; a cosine of at least c is then a distance of at most
eps = sqrt(2 - 2c).  They are projected on the leading principal directions of their label (an orthonormal basis, so
projected distances never exceed true ones), put in eps-wide grid cells and sorted by cell.  The sorted sequence is cut
into intervals (a range partition's part of a label) and these into blocks; pairs of intervals and of blocks whose
projected boxes are more than eps apart are skipped.  Inside a pair of blocks the join goes on recursively: both
sequences are halved, down to leaves, and at every level halves that are provably distant are skipped.  Only what is
left of the leaves is compared, in double precision.

Blocks are bounded in bytes and large, because each is sent once for every block it is compared with.  Equal vectors
form one class beforehand, so a vector that a third of all rows share costs one comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optika.llm.common import connect, connected_components, discard, hash_sample, materialize, shuffle_partitions

COSINE, DIRECTIONS, BLOCK_BYTES, LEAF = 0.98, 12, 4 << 20, 32
#: Directions whose cells order the vectors; the boxes of blocks use all directions.
ORDERED = 4
#: The principal directions are fitted on about this many vectors (4 times as many at most), chosen by hash; any orthonormal basis is exact.
FIT_ROWS = 4096
#: Labels with a basis of their own: those with most vectors in the sample, which need this many each.  Others share one.
MOST_BASES, BASIS_ROWS = 64, 64
#: Intervals of a label that are paired in one task; a label of more is dealt out.
FEW_INTERVALS = 64


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, dimension and bytes of each vector; null bytes where it can't link."""
    for b in batches:
        vec = b.column(2)
        flat = vec.flatten()
        n = np.nan_to_num(pa.compute.list_value_length(vec).to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
        holes = flat.is_null().to_numpy(zero_copy_only=False)
        x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        at = np.concatenate(([0], np.cumsum(n)))
        fine = np.isfinite(x) & ~holes
        out = []
        for i in range(b.num_rows):
            v = x[at[i] : at[i + 1]]
            out.append(v.tobytes() if len(v) and fine[at[i] : at[i + 1]].all() and v.any() else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n.astype(np.int32)), pa.array(out, pa.binary())], names=["vec_id", "label", "dim", "vec"])


def _unit(raw: list[bytes]) -> np.ndarray:
    return _scaled(np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Unit vectors; the first division keeps very large and very small vectors in range."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Bases:
    """Orthonormal directions (rows) by label and dimension, and by dimension alone for labels without their own."""

    def __init__(self, directions: int):
        self.directions, self.own, self.shared = directions, {}, {}

    def project(self, unit: np.ndarray, label: str) -> np.ndarray:
        """A dimension without a basis uses its first coordinates."""
        dim = unit.shape[1]
        axes = self.own.get((label, dim), self.shared.get(dim))
        p = unit @ axes.T if axes is not None else unit[:, : self.directions]
        return np.pad(p, ((0, 0), (0, self.directions - p.shape[1])))


def principal_directions(classes: DataFrame, total: int, directions: int = DIRECTIONS) -> Bases | None:
    """Leading principal directions of a sample of vectors, per label where the sample holds enough of it."""
    rows = sorted((r["dim"], r["label"], bytes(r["vec"])) for r in hash_sample(classes.select("dim", "label", "vec"), ["vec"], FIT_ROWS, total))
    if not rows:
        return None
    out = Bases(directions)

    def axes(raw: list[bytes]) -> np.ndarray:
        x = _unit(raw)
        x = x - x.mean(0)
        return np.linalg.eigh(x.T @ x)[1][:, ::-1].T[:directions].copy()

    by_dim: dict = {}
    by_label: dict = {}
    for dim, label, vec in rows:
        by_dim.setdefault(dim, []).append(vec)
        by_label.setdefault((label, dim), []).append(vec)
    for dim in sorted(by_dim, key=lambda d: (-len(by_dim[d]), d))[:MOST_BASES]:
        out.shared[dim] = axes(by_dim[dim])
    for k in sorted(by_label, key=lambda k: (-len(by_label[k]), k))[:MOST_BASES]:
        if len(by_label[k]) >= BASIS_ROWS:
            out.own[k] = axes(by_label[k])
    return out


def _cells(bases: Bases, eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups: dict = {}
            for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                groups.setdefault(key, []).append(i)
            cells = np.zeros((b.num_rows, ORDERED), np.int32)
            raw = b.column(2).to_pylist()
            for (label, _), at in groups.items():
                p = bases.project(_unit([raw[i] for i in at]), label)[:, :ORDERED]
                cells[at, : p.shape[1]] = np.floor(p / eps)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c.copy()) for c in cells.T)], names=[*b.schema.names, *(f"c{i}" for i in range(ORDERED))])

    return run


_BLOCK = "interval long, block long, label string, dim int, low array<double>, high array<double>, ids binary, copies binary, vectors binary"


def _blocks(bases: Bases, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        state = {"n": 0, "interval": -1, "key": None, "size": 0}
        rows: list[tuple] = []

        def done() -> pa.RecordBatch:
            p = bases.project(_unit([r[1] for r in rows]), state["key"][0])
            out = {
                "interval": [part << 32 | state["interval"]], "block": [part << 32 | state["n"]], "label": [state["key"][0]], "dim": [state["key"][1]],
                "low": [p.min(0).tolist()], "high": [p.max(0).tolist()], "ids": [np.array([r[0] for r in rows], np.int64).tobytes()],
                "copies": [np.array([r[2] for r in rows], np.int64).tobytes()], "vectors": [b"".join(r[1] for r in rows)],
            }
            state["n"] += 1
            rows.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_pydict(out, pa.schema(list(zip(out, kinds, strict=True))))

        for b in batches:
            for label, dim, vec, i, n in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("label", "dim", "vec", "id", "n")), strict=True):
                if (label, dim) != state["key"]:
                    if rows:
                        yield done()
                    state["key"], state["size"] = (label, dim), max(2, block_bytes // (8 * dim))
                    state["interval"] += 1
                rows.append((i, vec, n))
                if len(rows) == state["size"]:
                    yield done()
        if rows:
            yield done()

    return run


class Sequence:
    """A block's vectors in grid order, with the boxes of its leaves and of all runs of 2, 4, ... leaves."""

    def __init__(self, ids: bytes, copies: bytes, vectors: bytes, dim: int, label: str, bases: Bases, leaf: int):
        self.ids, self.copies = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64)
        self.unit = _scaled(np.frombuffer(vectors, np.float64).reshape(-1, dim))
        p = bases.project(self.unit, label)
        starts = np.arange(0, len(p), leaf)
        self.boxes = [(np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts))]
        while len(self.boxes[-1][0]) > 1:
            low, high = self.boxes[-1]
            pairs = np.arange(0, len(low), 2)
            self.boxes.append((np.minimum.reduceat(low, pairs), np.maximum.reduceat(high, pairs)))


def close_leaves(a: Sequence, b: Sequence, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that the recursion leaves over: it starts with the two whole sequences, drops a pair whose boxes
    are too far apart and goes on with the pairs of their halves.  All pairs of a level are looked at together."""
    level = max(len(a.boxes), len(b.boxes)) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        (low_a, high_a), (low_b, high_b) = a.boxes[min(level, len(a.boxes) - 1)], b.boxes[min(level, len(b.boxes) - 1)]
        near = []
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            gap = np.maximum(0, np.maximum(low_a[x] - high_b[y], low_b[y] - high_a[x]))
            near.append(np.einsum("ij,ij->i", gap, gap) <= limit)
        near = np.concatenate(near)
        i, j = i[near], j[near]
        if level == 0 or not len(i):
            return i, j
        level -= 1
        # a shorter sequence is halved only once the longer one's halves are of its size
        halves = [(x[:, None] * 2 + (0, 1) if level < len(s.boxes) - 1 else x[:, None], len(s.boxes[min(level, len(s.boxes) - 1)][0])) for x, s in ((i, a), (j, b))]
        (x, n), (y, m) = halves
        i, j = np.repeat(x, y.shape[1], 1).reshape(-1), np.tile(y, (1, x.shape[1])).reshape(-1)
        keep = (i < n) & (j < m)
        if a is b:
            keep &= i <= j
        i, j = i[keep], j[keep]


def _compare(bases: Bases, cosine: float, eps: float, leaf: int):
    limit = (eps * (1 + 1e-9)) ** 2

    def run(table: pa.Table) -> pa.Table:
        """A pair of blocks, or one with itself: kind 0 the copies that each class is linked with, kind 1 a spanning
        forest of the links, kind 2 the pairs of leaves compared and possible."""
        rows = table.sort_by("side").to_pylist()
        seqs = [Sequence(r["ids"], r["copies"], r["vectors"], r["dim"], r["label"], bases, leaf) for r in rows]
        a, b = seqs[0], seqs[-1]
        same = len(seqs) == 1
        i, j = close_leaves(a, b, limit)
        n, m = len(a.boxes[0][0]), len(b.boxes[0][0])
        count = [np.zeros(len(s.ids), np.int64) for s in seqs]
        ids = np.concatenate([s.ids for s in seqs])
        shift = 0 if same else len(a.ids)
        group, u, v = np.arange(len(ids)), [], []
        for x in np.unique(i):
            left = slice(x * leaf, (x + 1) * leaf)
            right = ((j[i == x] * leaf)[:, None] + np.arange(leaf)).reshape(-1)
            right = right[right < len(b.ids)]
            near = a.unit[left] @ b.unit[right].T >= cosine
            if same:
                near &= np.arange(len(a.ids))[left][:, None] < right
            if not near.any():
                continue
            count[0][left] += near @ b.copies[right]
            count[-1][right] += a.copies[left] @ near
            for k in np.flatnonzero(near.any(1)):
                connect(x * leaf + k, right[near[k]] + shift, group, ids, u, v)
        found = [(s.ids[k], c[k]) for s, c in zip(seqs, count, strict=True) for k in np.flatnonzero(c)]
        one, two = [x for x, _ in found], [x for _, x in found]
        possible = n * (n + 1) // 2 if same else n * m
        kind = [0] * len(found) + [1] * len(u) + [2]
        return pa.table({"kind": pa.array(kind, pa.int32()), "u": pa.array([*one, *u, len(i)], pa.int64()), "v": pa.array([*two, *v, possible], pa.int64())})

    return run


def _close(a: str, b: str, n: int, limit: float):
    gaps = [F.greatest(F.lit(0.0), F.greatest(F.col(f"{a}.low")[i] - F.col(f"{b}.high")[i], F.col(f"{b}.low")[i] - F.col(f"{a}.high")[i])) for i in range(n)]
    total = gaps[0] * gaps[0]
    for g in gaps[1:]:
        total = total + g * g
    return total <= limit


def links(classes: DataFrame, total: int, cosine: float, directions: int, block_bytes: int, leaf: int) -> DataFrame | None:
    """The join of classes (label, dim, vec, id, n): kind, u, v as in ``_compare``; None where there are no vectors."""
    eps = float(np.sqrt(2 - 2 * cosine))
    bases = principal_directions(classes, total, directions)
    if bases is None:
        return None
    cells = [f"c{i}" for i in range(ORDERED)]
    placed = classes.select("label", "dim", "vec", "id", "n").mapInArrow(_cells(bases, eps), "label string, dim int, vec binary, id long, n long, " + ", ".join(f"{c} int" for c in cells))
    order = ["label", "dim", *cells, "id"]
    size = classes.agg(F.sum(F.octet_length("vec")).alias("b")).first()["b"]
    parts = max(1, min(shuffle_partitions(classes.sparkSession), -(-size // (2 * block_bytes))))
    blocks = materialize(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_blocks(bases, block_bytes), _BLOCK), "blocks")
    boxes = blocks.select("interval", "block", "label", "dim", "low", "high")
    limit = (eps * (1 + 1e-9)) ** 2
    lows = F.array(*(F.min(F.col("low")[i]) for i in range(directions))).alias("low")
    highs = F.array(*(F.max(F.col("high")[i]) for i in range(directions))).alias("high")
    whole = boxes.groupBy("interval", "label", "dim").agg(lows, highs)
    # a label of many intervals is dealt out: its left sides by hash, its right sides to all
    deals = whole.groupBy("label", "dim").agg(F.ceil(F.count("*") / FEW_INTERVALS).cast("int").alias("deals"))
    whole = materialize(whole.join(deals, ["label", "dim"]), "intervals")
    a = whole.withColumn("deal", F.pmod(F.xxhash64("interval"), F.col("deals")).cast("int")).alias("a")
    b = whole.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).alias("b")
    meet = (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim")) & (F.col("a.deal") == F.col("b.deal")) & (F.col("a.interval") <= F.col("b.interval"))
    pairs = a.join(b, meet).where(_close("a", "b", directions, limit)).select(F.col("a.interval").alias("ia"), F.col("b.interval").alias("ib"))
    a, b = boxes.alias("a"), boxes.alias("b")
    pairs = pairs.join(a, F.col("ia") == F.col("a.interval")).join(b, (F.col("ib") == F.col("b.interval")) & (F.col("a.block") <= F.col("b.block"))).where(_close("a", "b", directions, limit))
    pairs = materialize(pairs.select(F.col("a.block").alias("x"), F.col("b.block").alias("y")), "block-pairs")
    sides = pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("side"))
    dealt = sides.join(blocks.select("block", "label", "dim", "ids", "copies", "vectors"), F.col("side") == F.col("block")).select("x", "y", "side", "label", "dim", "ids", "copies", "vectors")
    found = materialize(dealt.groupBy("x", "y").applyInArrow(_compare(bases, cosine, eps, leaf), "kind int, u long, v long"), "links")
    discard(blocks, whole, pairs)
    return found


def near_vectors(vectors: DataFrame, cosine: float = COSINE, directions: int = DIRECTIONS, block_bytes: int = BLOCK_BYTES, leaf: int = LEAF) -> DataFrame:
    """Links vectors (vec_id, embedding, label) of equal label by a cosine of at least ``cosine``.

    Returns vec_id, n_links, component_id, kept, one row per row of vectors.  A null label, a vector that is null,
    empty, zero or holds a null or non-finite component, and a null vec_id link with nothing (component_id is the
    vec_id, kept true).  Vectors of different dimensions link with nothing.  Rows that repeat a vec_id count as
    vectors of their own in n_links.  An empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = materialize(rows.mapInArrow(_valid, "vec_id long, label string, dim int, vec binary"), "vectors")
    good = rows.where("vec IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL").withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec"))
    classes = materialize(good.groupBy("label", "dim", "h1", "h2").agg(F.min("vec").alias("vec"), F.min("vec_id").alias("id"), F.count("*").alias("n")), "vector-classes")
    found = links(classes, classes.count(), cosine, directions, block_bytes, leaf)
    if found is None:  # nothing can link
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts = found.where("kind = 0").groupBy("u").agg(F.sum("v").alias("others"))
    comps = connected_components(found.where("kind = 1").select("u", "v"))
    top = classes.join(counts, F.col("id") == F.col("u"), "left").join(comps, F.col("id") == F.col("node"), "left")
    top = materialize(top.select("label", "dim", "h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "vector-result")
    discard(found, comps, classes)
    out = good.select("vec_id", "label", "dim", "h1", "h2").join(top, ["label", "dim", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("vec IS NULL OR label IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op5_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
