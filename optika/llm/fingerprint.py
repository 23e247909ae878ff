"""Document fingerprints: bottom-k sketches of word shingle hashes, in DataFrame functions only.

A text's shingles are its runs of 5 words (fewer words: all of them as one); a sketch is the k smallest distinct
48-bit shingle hashes, ascending.  Sketches of parts merge into the sketch of their union, and estimate
resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optika.llm.common import shuffle_partitions

SHINGLE, K, HASH_BITS = 5, 128, 48
_BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of a text: runs of characters other than 0x20 and 0x09-0x0D."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def sketch(text: Column, k: int = K) -> Column:
    """The bottom-k sketch of a text: array<long>, empty for a null text or one without words."""
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h) - (SHINGLE - 1)
        at = lambda i, j: F.get(h, i + j)
        runs = F.transform(F.slice(h, F.lit(1), F.greatest(n, F.lit(0))), lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *(at(i, j) for j in range(1, SHINGLE))), 64 - HASH_BITS))
        whole = F.when(F.size(h) > 0, F.array(F.shiftrightunsigned(F.xxhash64(h), 64 - HASH_BITS))).otherwise(F.array().cast("array<bigint>"))
        return F.when(n > 0, runs).otherwise(whole)

    # one-element transforms bind a value once; a plain reference would repeat its whole expression
    bound = F.transform(F.array(hashes), shingles)
    return F.slice(F.sort_array(F.array_distinct(F.get(bound, F.lit(0)))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets; 1 for two empty sets."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.try_divide(both.cast("double"), F.size(union).cast("double")))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) / (the k-th hash as a fraction)."""
    top = (F.element_at(a, k).cast("double") + 1.0) / F.lit(float(1 << HASH_BITS))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    union = distinct_shingles(merge(a, b, k), k)
    both = resemblance(a, b, k) * union
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as lowercase hexadecimal, 12 digits for each hash."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), HASH_BITS // 4, "0")), ""))


def with_next(docs: DataFrame, columns: list[str], tie: str = "text") -> DataFrame:
    """Adds next_<column> of the document that follows in ascending doc_id order (after the last: the first).

    Documents are dealt out to ranges of doc_id; the first document of a range also goes, as a guest, behind the
    range before it, so no range waits for another and none holds the whole order.  Ids are below 2**62; rows without
    one come last, in the order of a hash of the column ``tie``, as do rows that share an id.
    """
    spark = docs.sparkSession
    n = 4 * shuffle_partitions(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(tie), 2))
    keyed = docs.withColumn("_key", key)
    # the cuts may be any values; what each range begins with is looked up
    cuts = keyed.agg(F.percentile_approx("_key", [i / n for i in range(1, n)], 50 * n).alias("cuts")).first()["cuts"]
    cuts = sorted({int(x) for x in cuts or []})
    split = F.array(*(F.lit(x).cast("long") for x in cuts)) if cuts else F.array().cast("array<bigint>")
    keyed = keyed.withColumn("_bucket", F.size(F.filter(split, lambda s: s <= F.col("_key"))))
    lows = sorted((r["_bucket"], r["low"]) for r in keyed.groupBy("_bucket").agg(F.min("_key").alias("low")).collect())
    first, before = [None] * (len(cuts) + 1), [None] * (len(cuts) + 1)
    for k, (bucket, low) in enumerate(lows):
        first[bucket], before[bucket] = low, lows[k - 1][0]
    at = lambda values, kind: F.get(F.array(*(F.lit(x).cast(kind) for x in values)), F.col("_bucket"))
    smallest = F.lit(lows[0][0] if lows else 0) == F.col("_bucket")
    place = lambda b, g, w: F.struct(b.cast("int").alias("b"), F.lit(g).alias("g"), w.cast("int").alias("w"))
    home = place(F.col("_bucket"), False, F.lit(0))
    guest = place(at(before, "int"), True, F.when(smallest, 1).otherwise(0))
    dealt = keyed.withColumn("_p", F.explode(F.when(F.col("_key") == at(first, "long"), F.array(home, guest)).otherwise(F.array(home))))
    order = Window.partitionBy("_p.b").orderBy("_p.w", "_p.g", "_key", F.xxhash64(tie))
    dealt = dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return dealt.where("NOT _p.g").drop("_key", "_bucket", "_p")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints every text of docs (doc_id, text; null: empty) and its edited text, whose last half's code
    points are replaced by the first as many of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next (resemblance),
    contained_edited and contained_next (share of the text's shingles that the edited text, the next document has) and
    n_shingles (number of distinct shingles), all estimated from the sketches.  A text without
    words has an empty fingerprint; rows that repeat a doc_id are documents that follow each other; a single document
    is followed by itself; an empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("sketch", sketch(F.col("text"), k))
    pair = with_next(own, ["text", "sketch"]).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    pair = pair.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    pair = pair.select("doc_id", "n_chars", "sketch", "next_sketch", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("edited"), k).alias("edited_sketch"))
    return pair.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("contained_edited"), containment(F.col("sketch"), F.col("next_sketch"), k).alias("contained_next"), distinct_shingles(F.col("sketch"), k).alias("n_shingles"),
    )


def op4_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
