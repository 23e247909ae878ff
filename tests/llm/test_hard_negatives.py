import math

import numpy as np
import pytest

from optika.llm import hard_negatives as hn
from optika.llm.queries import ORACLES, QUERIES


def brute(rows, step=50, scale=256):
    """Rows (vec_id, embedding, label) to the expected result, pair by pair in whole numbers."""
    one = {}
    for i, e, label in rows:
        if i is not None and e and label is not None and all(x is not None and math.isfinite(x) for x in e):
            v = [max(-hn.MOST, min(hn.MOST, math.floor(x * scale))) for x in e]
            key = (str(label), np.array(v, np.int32).tobytes())
            one[i] = min(one.get(i, (key, v)), (key, v))
    out = set()
    for a, (ka, va) in one.items():
        if a % step:
            continue
        scores = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, k[0]) for i, (k, v) in one.items() if i != a and len(v) == len(va))
        for s, p, _ in [x for x in scores if x[2] == ka[0]][:5]:
            fit = [(-t, n) for t, n, k in scores if k != ka[0] and 50 * -s <= 100 * -t <= 95 * -s]
            out |= {(a, p, i + 1, n, -s, t) for i, (t, n) in enumerate(fit[:3])}
    return out


def mined(df, **more):
    got = [tuple(r) for r in hn.mine_negatives(df, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    import duckdb

    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    got = QUERIES["op12_hard_negatives"](spark, d)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['op12_hard_negatives']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def clustered(n=3000, dim=16, seed=1):
    """Clusters far apart, with labels across them, ties and equal vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dim)) * 3
    x = centres[rng.integers(0, 30, n)] + rng.normal(size=(n, dim)) * 0.02
    x[::9] = x[0]  # a ninth of all rows are equal
    return [(i, x[i].tolist(), int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("block, group", [(16, 4), (300, 256), (4096, 64)])
def test_against_brute_force(spark, block, group):
    rows = clustered(900)
    assert mined(spark.createDataFrame(rows, SCHEMA), block_rows=block, group_rows=group) == brute(rows)


def test_far_blocks_are_not_scanned(spark):
    """Work on clustered vectors is a small part of all pairs of group and block."""
    rows, work = clustered(), []
    got = {tuple(r) for r in hn.mine_negatives(spark.createDataFrame(rows, SCHEMA), block_rows=32, group_rows=8, work=work).collect()}
    assert got == brute(rows)
    scanned = sum(t.agg({"blocks": "sum"}).first()[0] or 0 for t in work) / 2
    assert scanned < 0.6 * (len(rows) / 32) * (len(rows) / 50 / 8)


def test_hard_rows(spark):
    rng = np.random.default_rng(2)
    v = lambda n=3: rng.normal(size=n).tolist()
    rows = [
        (0, v(), 1), (50, v(), 2), (100, v(), None), (150, None, 1), (200, [], 1), (250, [1.0, None, 2.0], 1), (300, [1.0, math.nan, 2.0], 1), (350, [math.inf, 0.0, 1.0], 2), (400, [0.0, 0.0, 0.0], 1), (None, v(), 1),
        (450, [1e300, -1e300, 1.0], 1), (451, [1e300, 1e300, 1.0], 2), (452, [1e300, -1e300, 1.0], 1), (453, [9e299, -2.0, 1.0], 2), (500, v(5), 1), (501, v(5), 1), (502, v(5), 2), (50, v(), 2), (50, v(), 3), (0, None, 4),
    ]
    rows += [(i, v(), int(rng.integers(0, 3))) for i in range(1000, 1060)] + [(i, [0.5, 0.5, 0.5], i % 3) for i in range(1100, 1140)]
    extra = (1, 2, "p", 0.5, 3, True, 4, 5, "x")
    schema = SCHEMA + ", dim int, pivot int, vec string, dist double, slot long, side boolean, `group` long, score long, name string"
    df = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    want = brute(rows)
    assert mined(df) == want == mined(df, block_rows=3, group_rows=2) and len(want) > 20
    assert hn.mine_negatives(df.limit(0)).count() == 0
    assert hn.mine_negatives(df.where("vec_id = 1000")).count() == 0


def test_very_long_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=20_000) * 1000).tolist(), i % 2) for i in range(0, 500, 25)]
    assert mined(spark.createDataFrame(rows, SCHEMA), block_rows=4) == brute(rows)
