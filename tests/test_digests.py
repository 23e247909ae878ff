from pyspark.sql import functions as F

from optika.operators import quality


def test_a_sort_for_a_digest_holds_no_lines(spark):
    import hashlib

    df = spark.range(2_000).selectExpr("cast(id % 3 as string) source", "cast(id as string) k", "sha2(cast(id as string), 256) h", "id n")
    k, h = F.col("k"), F.col("h")
    rows = {s: [r for r in df.collect() if r.source == s] for s in "012"}
    record, pool = quality.record_digest(df, ["source"], k, h, packed=True), quality.pool_digest(df, ["source"], h, packed=True)
    sha = lambda lines: hashlib.sha256("".join(f"{x}\n" for x in lines).encode()).hexdigest()
    for got, want in ((record, lambda r: sorted(f"{x.k}\0{x.h}" for x in r)), (pool, lambda r: sorted(x.h for x in r)), (quality.record_digest(df, ["source"], k, h), lambda r: sorted(f"{x.k}\0{x.h}" for x in r)),
                      (quality.tree_digest(df, ["source"], k, F.col("n"), h), lambda r: [f"{x.h}  {x.n}  {x.k}" for x in sorted(r, key=lambda x: x.k)]), (quality.ordered_digest(df, ["source"], k, F.col("n")), lambda r: [x.k for x in r])):
        assert {r.source: r.digest for r in got.collect()} == {s: sha(want(r)) for s, r in rows.items()}
    for got in (record, pool):
        above, below = got._jdf.queryExecution().optimizedPlan().toString().split("Sort", 1)
        assert "_line" in above and "_line" not in below and "unhex" in below
