"""MinHash near-duplicate detection with tensored banding and exact verification.

Two small collections of half keys (``half_keys`` each, a half key being ``rows`` minhashes) are computed
per document; a table key is a pair (i-th half key of the first collection, j-th of the second), so
``half_keys``**2 tables cost only 2 * half_keys * rows minhash functions.  A pair of resemblance s meets in
some table with probability (1 - (1 - s**rows)**half_keys)**2: 0.9995 at 0.75 for the defaults, 0.99999 at 0.85.

1. One pass over the texts gives each document's shingle count, a 128-bit digest of its shingle set, its
   minhashes and a 128-bit sketch (four bits of each of 32 minhashes).  Equal sets collapse to one class.
2. The classes' table keys are dealt out by key and sorted.  A sweep over each bucket emits a spanning forest
   of the pairs whose sketches agree enough (a pair of resemblance 0.75 fails that with probability 2e-5):
   never more edges than members.  A bucket of more than ``hot`` members is counted beforehand and split: each part
   holds the bucket's first member too, and members that no part connects to it are compared with every part, so that
   what a bucket connects does not depend on its size.  Components of those edges are the candidate groups.
3. Each candidate group is verified exactly on its documents' full shingle sets, which are written once.  Blocks are
   bounded in documents and in shingles.  First each block is compared within itself and with the group's pivot,
   the member with most candidate edges, which is dealt to every block: this is linear in the group and gives each
   document a label, the pivot's where it is connected to it.  Then only documents with other labels are compared
   with all others of the group, again in blocks.
4. Components of the true links give the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optika.llm import textkit as tk
from optika.llm.common import connect, connected_components, discard, materialize, shuffle_partitions, small_batches

SHINGLE = 5
_U = np.uint64
_FEATURES = "doc_id long, n_shingles long, set_hi long, set_lo long, keys binary, sketch_hi long, sketch_lo long"


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7919))
    return rng.integers(1, 2**63, n, dtype=np.uint64) | _U(1), rng.integers(1, 2**63, n, dtype=np.uint64)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word shingles of each text, and the bounds of each text's part (sorted within it)."""
    w = tk.words(column, lower=True)
    h = w.hashes()
    counts = w.counts()
    runs = tk.sequence_hashes(h, SHINGLE)
    flat = runs[tk.valid_runs(w.bounds, SHINGLE)]
    n = np.maximum(counts - SHINGLE + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    parts, at, sizes = [], 0, np.zeros(len(counts), np.int64)
    tails = {}
    for i in short:
        x = _U(0)
        with np.errstate(over="ignore"):
            for y in h[w.bounds[i] : w.bounds[i + 1]]:
                x = x * tk.SEQUENCE_BASE + y
        tails[i] = tk.mix(np.array([x + _U(counts[i])], np.uint64))
    for i, k in enumerate(n):
        own = tails.get(i)
        if own is None:
            own = flat[at : at + k]
            own.sort()
            if k > 1:
                keep = np.empty(k, bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                own = own[keep]
            at += k
        sizes[i] = len(own)
        parts.append(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def minhashes(flat: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """n minhashes of each set (rows: sets); all ones for an empty set."""
    out = np.full((len(bounds) - 1, n), ~_U(0), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        a, b = _functions(n)
        for i in range(n):
            out[full, i] = np.minimum.reduceat(flat * a[i] + b[i], bounds[:-1][full])
    return out


def _features(half_keys: int, rows: int):
    n = 2 * half_keys * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in tk.chunks(batches, "text"):
            flat, bounds = shingle_sets(c.column(1))
            m = tk.mix(minhashes(flat, bounds, n))
            full = np.flatnonzero(np.diff(bounds))
            digest = np.zeros((2, c.num_rows), np.uint64)
            if len(full):
                for k, y in enumerate((flat, tk.mix(flat ^ _U(0x5851F42D4C957F2D)))):
                    digest[k, full] = tk.mix(np.add.reduceat(y * (y | _U(1)), bounds[:-1][full]) + np.diff(bounds)[full].astype(np.uint64))
            half = np.zeros((c.num_rows, 2 * half_keys), np.uint64)
            for r in range(rows):
                half = tk.mix(half + m[:, r::rows])
            sketch = np.zeros((2, c.num_rows), np.uint64)
            for i in range(32):
                sketch[i // 16] |= (m[:, i % n] >> _U(60)) << _U(4 * (i % 16))
            yield pa.RecordBatch.from_arrays(
                [c.column(0), pa.array(np.diff(bounds)), *(pa.array(x.view(np.int64)) for x in digest), pa.array([x.tobytes() for x in half], pa.binary()), *(pa.array(x.view(np.int64)) for x in sketch)],
                names=["doc_id", "n_shingles", "set_hi", "set_lo", "keys", "sketch_hi", "sketch_lo"],
            )

    return run


def _table_rows(half_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = tk.mix(np.arange(half_keys * half_keys, dtype=np.uint64) + _U(17))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                half = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64).reshape(-1, 2 * half_keys)
                a, b = half[:, :half_keys], half[:, half_keys:]
                keys = tk.mix(a[:, :, None] * _U(0x9E3779B97F4A7C15) + b[:, None, :]).reshape(len(half), -1) ^ tables
                again = np.repeat(np.arange(len(half)), half_keys * half_keys)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), *(pa.array(part.column(k).to_numpy()[again]) for k in (0, 2, 3))], names=["key", "id", "s0", "s1"])

    return run


_LOW = _U(0x1111111111111111)


def _agree(s0: np.ndarray, s1: np.ndarray, t0, t1) -> np.ndarray:
    """How many of the 32 four-bit minhashes agree."""
    out = 32
    for x in (s0 ^ t0, s1 ^ t1):
        out = out - np.bitwise_count((x | x >> _U(1) | x >> _U(2) | x >> _U(3)) & _LOW).astype(np.int64)
    return out


#: Sketches of a pair of resemblance 0.75 agree on 24.5 of 32 on average (sd 2.4).
_MAYBE = 14


def _forest(ids: np.ndarray, s0: np.ndarray, s1: np.ndarray) -> tuple[list, list, np.ndarray]:
    """Edges that connect what the pairs of a bucket with agreeing sketches connect, and each row's group: 0 is the
    first row's."""
    group = np.where(_agree(s0, s1, s0[0], s1[0]) >= _MAYBE, 0, -1)
    group[0] = 0
    u = list(ids[group == 0][1:])
    v = [ids[0]] * len(u)
    for i in np.flatnonzero(group < 0):
        group[i] = i
        near = np.flatnonzero((_agree(s0, s1, s0[i], s1[i]) >= _MAYBE) & (group >= 0) & (group != i))
        connect(i, near, group, ids, u, v)
    return u, v, group


def _part_forest(table: pa.Table) -> pa.Table:
    """A part of a split bucket (key, id, s0, s1, lead: the bucket's first row): kind 0 edges u, v; kind 1 the rows
    that are not connected to the first."""
    order = np.lexsort((table["id"].to_numpy(), ~table["lead"].to_numpy(zero_copy_only=False)))
    ids, s0, s1 = table["id"].to_numpy()[order], table["s0"].to_numpy().view(np.uint64)[order], table["s1"].to_numpy().view(np.uint64)[order]
    u, v, group = _forest(ids, s0, s1)
    rest = np.flatnonzero(group != 0)
    n, m = len(u), len(rest)
    return pa.table({
        "kind": pa.array([0] * n + [1] * m, pa.int32()), "key": pa.array([table["key"][0].as_py()] * (n + m), pa.int64()), "u": pa.array([*u, *ids[rest]], pa.int64()),
        "v": pa.array([*v, *[None] * m], pa.int64()), "s0": pa.array([*[0] * n, *s0[rest].view(np.int64)], pa.int64()), "s1": pa.array([*[0] * n, *s1[rest].view(np.int64)], pa.int64()),
    })


def _cross_forest(table: pa.Table) -> pa.Table:
    """Edges between the rows of side 0 and those of side 1 that agree enough, as a spanning forest."""
    ids, s0, s1, side = table["id"].to_numpy(), table["s0"].to_numpy().view(np.uint64), table["s1"].to_numpy().view(np.uint64), table["side"].to_numpy()
    group, u, v = np.arange(len(ids)), [], []
    for i in np.flatnonzero(side == 0):
        connect(i, np.flatnonzero((_agree(s0, s1, s0[i], s1[i]) >= _MAYBE) & (side == 1) & (ids != ids[i])), group, ids, u, v)
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def candidates(classes: DataFrame, half_keys: int, hot: int) -> DataFrame:
    """Edges u, v between classes (id, keys, s0, s1) that connect what agreeing pairs of the tables' buckets connect."""
    parts = shuffle_partitions(classes.sparkSession)
    rows = classes.select("id", "keys", "s0", "s1").mapInArrow(_table_rows(half_keys), "key long, id long, s0 long, s1 long")
    split = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    split = materialize(split.select(F.col("key").alias("k"), F.ceil(F.col("n") / hot).cast("int").alias("parts")), "hot-buckets")
    swept = lambda df: df.repartition(parts, "key").sortWithinPartitions("key", "id").mapInArrow(_sweep, "u long, v long").distinct()
    if split.isEmpty():
        return materialize(swept(rows), "candidates")
    marked = rows.join(split, F.col("key") == F.col("k"), "left")
    edges = swept(marked.where("parts IS NULL").select("key", "id", "s0", "s1"))
    hot_rows = materialize(marked.where("parts IS NOT NULL").select("key", "id", "s0", "s1", "parts", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int").alias("part")), "hot-rows")
    lead = hot_rows.groupBy("key", "parts").agg(F.min_by(F.struct("id", "s0", "s1"), "id").alias("l"))
    leads = lead.select("key", "l.id", "l.s0", "l.s1", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("lead"))
    own = hot_rows.join(lead.select(F.col("key").alias("k"), F.col("l.id").alias("first")), (F.col("key") == F.col("k")) & (F.col("id") == F.col("first")), "left_anti")
    found = own.select("key", "id", "s0", "s1", "part", F.lit(False).alias("lead")).unionByName(leads).groupBy("key", "part").applyInArrow(_part_forest, "kind int, key long, u long, v long, s0 long, s1 long")
    found = materialize(found, "hot-forest")
    edges = edges.unionByName(found.where("kind = 0").select("u", "v"))
    rest = found.where("kind = 1")
    few = materialize(rest.groupBy(F.col("key").alias("k")).agg(F.ceil(F.count("*") / hot).cast("int").alias("few")), "hot-rest")
    if not few.isEmpty():
        every = hot_rows.join(few, F.col("key") == F.col("k")).select("key", "id", "s0", "s1", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("lo"), F.col("part").alias("hi"))
        sizes = hot_rows.select(F.col("key").alias("k2"), "parts").distinct()
        left = rest.join(few, F.col("key") == F.col("k")).join(sizes, F.col("key") == F.col("k2"))
        left = left.select("key", F.col("u").alias("id"), "s0", "s1", F.lit(0).alias("side"), F.pmod(F.xxhash64("u", F.lit(9)), F.col("few")).cast("int").alias("lo"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("hi"))
        edges = edges.unionByName(left.unionByName(every).groupBy("key", "lo", "hi").applyInArrow(_cross_forest, "u long, v long"))
    edges = materialize(edges.distinct(), "candidates")
    discard(split, hot_rows, found, few)
    return edges


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by key and emits each bucket's forest."""
    rest: list[np.ndarray] = []
    sent: set[int] = set()

    def emit(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        key, ids, s0, s1 = cols
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        us, vs = [], []
        two = start[size == 2]
        ok = _agree(s0[two], s1[two], s0[two + 1], s1[two + 1]) >= _MAYBE
        us.append(ids[two + 1][ok])
        vs.append(ids[two][ok])
        for a, n in zip(start[size > 2], size[size > 2], strict=True):
            u, v, _ = _forest(ids[a : a + n], s0[a : a + n], s1[a : a + n])
            us.append(np.array(u, np.int64))
            vs.append(np.array(v, np.int64))
        u, v = np.concatenate(us), np.concatenate(vs)
        keep = u != v
        u, v = u[keep], v[keep]
        if not len(u):
            return None
        pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])

    def split(cols: list[np.ndarray]) -> tuple[list, list]:
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        return [x[:cut] for x in cols], [x[cut:] for x in cols]

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy().view(np.uint64)]
        held.append(cols)
        if cols[0][-1] == held[0][0][0] or sum(len(x[0]) for x in held) < 60_000:
            continue
        done, rest = split([np.concatenate(x) for x in zip(*held, strict=True)])
        held = [rest]
        if len(done[0]) and (out := emit(done)):
            yield out
    if held and (out := emit([np.concatenate(x) for x in zip(*held, strict=True)])):
        yield out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c in tk.chunks(batches, "text"):
        flat, bounds = shingle_sets(c.column(c.schema.get_field_index("text")))
        parts = pa.array([flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([*(c.column(x) for x in ("id", "grp", "pivot", "blocks")), parts], names=["id", "grp", "pivot", "blocks", "shingles"])


#: Shingle occurrences that a comparison of one document looks at together.
_LOOK = 1 << 20


def _linked(ids: np.ndarray, side: np.ndarray, label: np.ndarray, raw: list[bytes], percent: int) -> tuple[list, list, np.ndarray, np.ndarray]:
    """True links of a block as a spanning forest, the component of each row and its set's size.  Rows of equal labels
    are known to be connected; where there are two sides only rows of different sides are compared."""
    sizes = np.array([len(x) // 8 for x in raw])
    flat = np.frombuffer(b"".join(raw), np.uint64)
    codes = np.unique(flat, return_inverse=True)[1].astype(np.int32)
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    posting, at = owner[np.argsort(codes, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(codes))))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    _, head, known = np.unique(label, return_index=True, return_inverse=True)
    group = head[known]
    u, v = [], []
    cross = side[0] != side[-1]
    for i in range(1, len(ids)):
        mine = codes[bounds[i] : bounds[i + 1]]
        lengths = at[mine + 1] - at[mine]
        ends = np.cumsum(lengths)
        common, begin = np.zeros(len(ids), np.int64), 0
        while begin < len(mine):
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - lengths[begin] + _LOOK, "right")))
            some = lengths[begin:end]
            first = np.repeat(at[mine[begin:end]] - (ends[begin:end] - some) + (ends[begin] - lengths[begin]), some)
            common += np.bincount(posting[first + np.arange(len(first))], minlength=len(ids))
            begin = end
        common = common[:i]
        linked = (100 * common >= percent * (sizes[:i] + sizes[i] - common)) & (group[:i] != group[i])
        if cross:
            linked &= side[:i] != side[i]
        found = np.flatnonzero(linked)
        others, first = np.unique(group[found], return_index=True)
        for g, j in zip(others, found[first], strict=True):
            u.append(ids[i])
            v.append(ids[j])
            group[group == g] = group[i]
    return u, v, group, sizes


def _ordered(table: pa.Table, *keys: str) -> tuple[pa.Table, list[bytes]]:
    order = np.lexsort([table[k].to_numpy() for k in keys])
    table = table.take(pa.array(order))
    return table.drop_columns("shingles"), table["shingles"].to_pylist()


def _labels(percent: int):
    """The label of each row of a block (id, grp, pivot, blocks, shingles): the pivot where links of the block connect
    it to the pivot, else the smallest document that they connect it to.  The pivot itself has no row."""

    def run(table: pa.Table) -> pa.Table:
        table, raw = _ordered(table, "id")
        ids, pivot = table["id"].to_numpy(), table["pivot"].to_numpy()
        _, _, group, sizes = _linked(ids, np.zeros(len(ids), np.int8), ids, raw, percent)
        _, first, own = np.unique(group, return_index=True, return_inverse=True)
        label = ids[first][own]
        label[group == group[np.searchsorted(ids, pivot[0])]] = pivot[0]
        out = pa.table({"id": ids, "grp": table["grp"], "pivot": pivot, "blocks": table["blocks"], "label": label, "n": sizes})
        return out.filter(pa.array(ids != pivot))

    return run


def _links(percent: int):
    """True links between the sides of a block of rows id, side, label, shingles, as a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        table, raw = _ordered(table, "id", "side")
        u, v, _, _ = _linked(*(table[c].to_numpy() for c in ("id", "side", "label")), raw, percent)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, percent: int = 75, half_keys: int = 10, rows: int = 2, block: int = 128, block_shingles: int = 1 << 19, hot: int = 4096) -> DataFrame:
    """Near-duplicate groups of ``docs`` (columns doc_id, text; others are ignored).

    Returns one row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable over links of
    resemblance >= percent / 100), kept (doc_id = component_id).  A document's set holds its distinct 5-word
    shingles with A-Z lower-cased (fewer words: the whole sequence).  Null or empty texts have an empty set and
    link with nothing.  Rows that share a doc_id are one document.  A null doc_id links with nothing: its
    component_id is null and kept is true.  An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    feats = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_features(half_keys, rows), _FEATURES)
    feats = materialize(feats, "minhash")
    alive = feats.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(
        alive.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), F.min("keys").alias("keys"), F.min("sketch_hi").alias("s0"), F.min("sketch_lo").alias("s1")),
        "classes",
    )
    maybe = candidates(classes, half_keys, hot)
    joined = connected_components(maybe)
    groups = materialize(joined, "groups")
    discard(joined)
    # the pivot: the member with most candidate edges, of equals the smallest
    edges = maybe.select(F.explode(F.array("u", "v")).alias("k")).groupBy("k").agg(F.count("*").alias("edges"))
    known = groups.join(edges, F.col("node") == F.col("k")).join(classes.select("id", "n"), F.col("node") == F.col("id"))
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("n") / block_shingles)).cast("int")
    size = known.groupBy("component").agg(F.max_by("node", F.struct("edges", -F.col("node"))).alias("pivot"), blocks.alias("blocks"))
    member = groups.join(size.withColumnRenamed("component", "grp"), F.col("component") == F.col("grp")).select("node", "grp", "pivot", "blocks")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sets = texts.join(member.hint("shuffle_hash"), F.col("id") == F.col("node")).select("id", "grp", "pivot", "blocks", "text")
    sets = materialize(sets.mapInArrow(_sets, "id long, grp long, pivot long, blocks int, shingles binary"), "sets")
    # every block holds its own documents and the pivot
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.array(F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    dealt = sets.withColumn("block", F.explode(F.when(F.col("id") == F.col("pivot"), everywhere).otherwise(own)))
    labels = dealt.groupBy("grp", "block").applyInArrow(_labels(percent), "id long, grp long, pivot long, blocks int, label long, n long")
    labels = materialize(labels, "labels")
    links = labels.select(F.col("id").alias("u"), F.col("label").alias("v"))
    # in groups of several blocks: what is not connected to the pivot so far against all of the group
    few = F.ceil(F.greatest(F.count("*") / block, F.sum("n") / block_shingles)).cast("int")
    rest = labels.where("blocks > 1 AND label <> pivot").groupBy("grp").agg(few.alias("few"))
    rest = materialize(rest.withColumnRenamed("grp", "g"), "rest")
    if not rest.isEmpty():
        told = sets.where("blocks > 1").join(rest, F.col("grp") == F.col("g"))
        told = told.join(labels.where("blocks > 1").select(F.col("id").alias("k"), "label").hint("shuffle_hash"), F.col("id") == F.col("k"), "left")
        told = told.withColumn("label", F.coalesce("label", "pivot"))
        low = F.pmod(F.xxhash64("id", F.lit(7)), F.col("few")).cast("int")
        high = F.pmod(F.xxhash64("id", F.lit(11)), F.col("blocks")).cast("int")
        right = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda x: F.struct(F.lit(1).alias("side"), x.alias("lo"), high.alias("hi")))
        left = F.transform(everywhere, lambda x: F.struct(F.lit(0).alias("side"), low.alias("lo"), x.alias("hi")))
        at = F.explode(F.when(F.col("label") == F.col("pivot"), right).otherwise(F.concat(left, right)))
        told = told.withColumn("at", at).select("id", "at.side", "label", "shingles", "grp", "at.lo", "at.hi")
        links = links.unionByName(told.groupBy("grp", "lo", "hi").applyInArrow(_links(percent), "u long, v long"))
    joined = connected_components(links)
    comps = materialize(joined, "components")
    discard(joined, maybe, groups, sets, labels, rest)
    whole = alive.select("doc_id", "set_hi", "set_lo").join(classes.select("set_hi", "set_lo", "id"), ["set_hi", "set_lo"])
    # rows that share a doc_id join their classes too
    top = whole.join(comps.withColumnRenamed("node", "id"), "id", "left").select("doc_id", F.coalesce("component", "id").alias("component"))
    top = top.groupBy("doc_id").agg(F.min("component").alias("component_id"))
    out = feats.select("doc_id", "n_shingles").join(top, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def op9_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
