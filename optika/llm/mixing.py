"""Mixing sources to target weights by a time-varying curriculum.

Targets: each source gets a share of all words by its weight, at most ``most`` times its own size; what that
leaves is shared again by weight until no source is above.  Schedules: a source's weight moves linearly over the
training time t in [0, 1] from (1 + tilt) to (1 - tilt) times its mean (tilt > 0: early, < 0: late), so its
integrated demand is D(t) = target * ((1 + tilt) t - tilt t^2).  A document holds an interval of its source's
token line (a fixed pseudo-random order, repeated as often as the target asks); its training position is D
inverted at the interval's start, and the mix is range-sorted by position.

The token line is a prefix sum over the documents of a source.  It is computed in two levels (sums of hash
buckets, then inside a bucket), so a source that holds a third of all rows is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optika.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Hash buckets of a source's token line hold about this many documents; the number of buckets grows with the table.
BUCKET_ROWS = 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def sharing(sources: DataFrame, most: float) -> tuple[float, float]:
    """What is left to share and the weights that share it, once the sources (n, weight) whose share is above
    most * n keep that limit; (infinite, 1) where all sources together stop short of the sum of all sizes.

    Sources are taken out of the sharing round by round, until none is above.  Shares only grow from round to round, so
    a source's part in a round follows from the two numbers, and a round is one aggregate over the table of sources.
    """
    total = float(sources.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
    limit, left, weight = F.lit(float(most)) * F.col("n"), 0.0, 1.0
    while True:
        over = F.lit(left) * F.col("weight") / F.lit(weight) > limit
        kept, free = sources.where("n > 0").agg(F.coalesce(F.sum(F.when(over, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if not free:
            return float("inf"), 1.0
        if (total - kept, free) == (left, weight):
            return left, weight
        left, weight = total - kept, free


def _numbered(sources: DataFrame) -> DataFrame:
    """Adds i, the place in the order of code points, null last: ranges of sources are numbered on their own and
    shifted by the ranges before them."""
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "sources")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy("range").agg(F.count("*").alias("c")).select(F.col("range").alias("r"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("shift"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    return ranged.withColumn("place", place).join(shift, F.col("range") == F.col("r")).select("source", "n", "rows", (F.col("shift") + F.col("place") - 1).alias("i"))


def source_table(sized: DataFrame, weights=(1, 2, 3), most: float = 3.0, tilts=(0.5, 0.0, -0.5)) -> DataFrame:
    """Sources by code point, null last: source, source_size, rows, target, tilt.  Weights and tilts repeat along that
    order.  The table has a row for each source; it is written, and its size decides how it is joined."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
    pick = lambda values: F.element_at(F.array(*(F.lit(float(x)) for x in values)), (F.col("i") % len(values) + 1).cast("int"))
    sources = materialize(_numbered(sums).withColumn("weight", pick(weights)).withColumn("tilt", pick(tilts)), "weights")
    left, weight = sharing(sources, most)
    target = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.least(F.lit(float(most)) * F.col("n"), F.lit(left) * F.col("weight") / F.lit(weight)))
    return materialize(sources.select("source", F.col("n").alias("source_size"), "rows", target.alias("target"), "tilt"), "targets")


def _position(share: Column) -> Column:
    """The training time at which a source's integrated demand reaches a share of its target."""
    a = F.col("tilt")
    # abs: the inverse at 0 is -0.0 for a negative tilt
    return F.when(a == 0, share).otherwise(F.abs((1 + a) - F.sqrt(F.greatest(F.lit(0.0), (1 + a) * (1 + a) - 4 * a * share))) / F.abs(2 * a))


def mix(docs: DataFrame, weights=(1, 2, 3), most: float = 3.0, tilts=(0.5, 0.0, -0.5), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The mix of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, taken, position.

    taken counts the words the mix takes of a document: whole passes over its source's token line, and what a last
    partial pass reaches; the one document at that pass's end is cut there.  position is the training time of the
    document's first word, null if nothing is taken.  Null and empty texts have size 0 and are not taken; a null
    source is a source of its own (last); rows that repeat a document each hold their own interval; an empty table
    gives an empty result.  Reruns agree: the order is the MD5 of the doc_id, then doc_id and size.

    Words are counted once, in one pass over the texts; all else works on (doc_id, source, size).
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"))
    sized = materialize(sized, "sizes")
    sources = source_table(sized, weights, most, tilts)
    # the buckets are the leading hexadecimal digits of the hash that orders the line, so their number changes no result
    largest = sources.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("rows")).first()["rows"]
    digits = 1
    while digits < 8 and largest > bucket_rows * 16**digits:
        digits += 1
    keyed = sized.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("bucket", F.substring("h", 1, digits))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    line = keyed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    line = line.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("at", F.col("base") + F.col("inner"))
    line = line.drop("s", "b").join(sources.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")))
    # demand in whole words, so that every engine finds the same cut
    demand = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(F.try_divide(demand, F.col("source_size")))).otherwise(F.lit(0)).cast("long")
    line = line.withColumn("demand", demand).withColumn("passes", passes).withColumn("partial", F.col("demand") - F.col("passes") * F.col("source_size"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("partial") - F.col("at")))
    line = line.withColumn("taken", (F.col("passes") * F.col("size") + last).cast("long"))
    position = _position(F.try_divide(F.col("at").cast("double"), F.col("demand").cast("double")))
    return line.select("doc_id", "source", "size", "source_size", "target", "taken", F.when(F.col("taken") > 0, position).alias("position"), "at", "demand", "tilt")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of documents: one row for each pass, the last pass's cut document shortened, range-sorted
    by training position.  Columns of docs; n_chars, where present, is recomputed.  A row without a doc_id is told
    apart by a hash of its text.  Rows that repeat a doc_id in a source with as many words each keep the interval that
    is theirs: the rows in the order of a hash of the whole row, the intervals in the order of their place."""
    columns = docs.columns
    text = F.col("text").cast("string")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 3))
    # the row travels as one struct, so that its columns cannot clash with the plan's
    own = docs.select(key.alias("key"), F.col("source").cast("string").alias("own_source"), n_words(text).alias("own_size"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc"))
    own = own.withColumn("copy", F.row_number().over(Window.partitionBy("key", "own_source", "own_size").orderBy(F.xxhash64("doc"))))
    plan = mix(docs.select(key.alias("doc_id"), text.alias("text"), "source"), **options).where("taken > 0")
    plan = plan.withColumn("plan_copy", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("at")))
    rows = own.join(plan, (F.col("key") == F.col("doc_id")) & F.col("own_source").eqNullSafe(F.col("source")) & (F.col("own_size") == F.col("size")) & (F.col("copy") == F.col("plan_copy")))
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    left = F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size")).cast("int")
    words = F.slice(F.regexp_extract_all(F.col("doc.text").cast("string"), F.lit(f"({WORD})"), F.lit(1)), F.lit(1), left)
    cut = left < F.col("size")
    rows = rows.withColumn("new_text", F.when(cut, F.array_join(words, " ")).otherwise(F.col("doc.text").cast("string")))
    spot = F.try_divide((F.col("at") + F.col("pass") * F.col("source_size")).cast("double"), F.col("demand").cast("double"))
    rows = rows.withColumn("position", _position(spot))
    out = {"text": F.col("new_text")}
    if "n_chars" in columns:
        out["n_chars"] = F.when(cut, F.length("new_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    rows = rows.repartitionByRange("position", "key", "copy", "pass").sortWithinPartitions("position", "key", "copy", "pass")
    return rows.select(*(out.get(c, F.col(f"doc.`{c}`")).alias(c) for c in columns))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = out.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


#: The same in DuckDB.  Resharing stops after at most one round for each source; 8 rounds are written out below and
#: the tests check the operator against more.
_ROUND = """r{i} AS (SELECT source, n, i, w, coalesce(fixed, CASE WHEN (SELECT total FROM t) IS NOT NULL AND
  ((SELECT total FROM t) - (SELECT coalesce(sum(fixed), 0) FROM r{j})) * w / (SELECT sum(w) FROM r{j} WHERE fixed IS NULL) > 3 * n
  THEN 3.0::DOUBLE * n END) AS fixed FROM r{j})"""
OP2_SQL = (
    """WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
  md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
t AS (SELECT sum(n)::DOUBLE AS total FROM s),
r0 AS (SELECT source, n, i, (i % 3 + 1)::DOUBLE AS w, CASE WHEN n = 0 THEN 0.0::DOUBLE END AS fixed FROM s),
"""
    + ",\n".join(_ROUND.format(i=i, j=i - 1) for i in range(1, 9))
    + """,
g AS (SELECT source, n, CASE i % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.0 ELSE -0.5 END::DOUBLE AS a, coalesce(fixed, ((SELECT total FROM t) - (SELECT coalesce(sum(fixed), 0) FROM r8)) * w
  / (SELECT sum(w) FROM r8 WHERE fixed IS NULL)) AS target FROM r8),
l AS (SELECT d.doc_id, d.size, g.n AS source_size, g.target, g.a, round(g.target)::BIGINT AS demand,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
k AS (SELECT *, CASE WHEN source_size > 0 THEN demand // source_size ELSE 0 END AS passes FROM l),
f AS (SELECT *, (passes * size + greatest(0, least(size, demand - passes * source_size - pos)))::BIGINT AS taken,
  pos::DOUBLE / nullif(demand, 0)::DOUBLE AS share FROM k)
SELECT doc_id, size, source_size, target, taken, round(CASE WHEN taken > 0 THEN CASE WHEN a = 0 THEN share
  ELSE abs((1 + a) - sqrt(greatest(0.0, (1 + a) * (1 + a) - 4 * a * share))) / abs(2 * a) END END, 6) AS position FROM f"""
)
