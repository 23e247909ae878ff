"""URL rules by a sort-merge range join.

A host is keyed by its labels in reverse order, each followed by a dot: ``www.example.com`` is
``com.example.www.``.  The hosts that a rule's host covers (itself and its subdomains) are then the interval of
keys that begin with the rule's key, and intervals are nested or disjoint.  URLs and rules are dealt out to key
ranges and sorted together; one sweep per range keeps a stack of the nested rules whose interval holds the
current key.  The rules of a host that the stack holds are tried by the path's prefixes, longest first.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optika.llm.common import hash_sample, shuffle_partitions

#: (verdict, host, path), as the task gives them.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Key ranges are cut at about this many rows chosen by hash; the cuts shape partitions only, never results.
CUTS_SAMPLE = 4096


def _rest(url: Column) -> Column:
    """What follows the first ://; empty if there is none.  Cut first, so that no pattern can find a later one."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def _lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return _lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def key(h: Column) -> Column:
    return F.when(h == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(h, r"\.")), "."), F.lit(".")))


_OUT = "page_id long, host string, path string, rule string, verdict string"


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []
        part = None
        for batch in batches:
            rows = batch.to_pydict()
            out: dict[str, list] = {"page_id": [], "host": [], "path": [], "rule": [], "verdict": []}
            for p, k, is_url, page, h, q, verdict in zip(*(rows[c] for c in ("part", "key", "is_url", "page_id", "host", "path", "verdict")), strict=True):
                if p != part:
                    stack, part = [], p
                while stack and not k.startswith(stack[-1][0]):
                    stack.pop()
                if not is_url:
                    if not stack or stack[-1][0] != k:
                        stack.append((k, {}, []))
                    _, rules, lengths = stack[-1]
                    # of two rules for the same host and path a block wins
                    if q not in rules or verdict == "block":
                        rules[q] = (h + q, verdict)
                    if len(q) not in lengths:
                        lengths.append(len(q))
                        lengths.sort(reverse=True)
                    continue
                best = None
                for _, rules, lengths in stack:
                    for n in lengths:
                        if n <= len(q) and (hit := rules.get(q[:n])) is not None:
                            if best is None or len(hit[0]) > len(best[0]):
                                best = hit
                            break
                for c, x in zip(out, (page, h, q, best and best[0], best[1] if best else default), strict=True):
                    out[c].append(x)
            if out["page_id"]:
                yield pa.RecordBatch.from_pydict(out, pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("host", "path", "rule", "verdict"))]))

    return run


def judge(pages: DataFrame, rules: DataFrame | tuple = RULES, default: str = "allow") -> DataFrame:
    """The longest rule that fits each url of ``pages`` (page_id, url).

    rules: verdict, host, path, as tuples or a DataFrame of any size.  Returns page_id, host, path, rule (host and
    path of the rule, null if none fits), verdict (the rule's, else ``default``).  A null url, or one without ://,
    has an empty host and path and fits no rule.  Of rules for the same host and path a block wins; a null page_id
    stays null; repeated rows are judged each; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    url = F.col("url").cast("string")
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path")).withColumn("key", key(F.col("host")))
    n = shuffle_partitions(spark)
    # a range's bound is (key, path, page_id), so that one host can fill several ranges
    lead = hash_sample(urls.select("key", "path", F.coalesce("page_id", F.lit(0)).alias("page_id")), ["page_id", "path"], CUTS_SAMPLE, pages.count())
    lead = sorted((r["key"], r["path"], r["page_id"]) for r in lead)
    cuts = sorted({lead[len(lead) * i // n] for i in range(1, n)}) if lead else []
    # ranges get numbers that hash to partitions of their own
    numbers = spark.range(64 * n).select(F.col("id").cast("int").alias("id")).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id"))
    number = [r["id"] for r in numbers.orderBy("p").collect()]
    number += range(64 * n, 64 * n + len(cuts) + 1 - len(number))

    def part_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.to_pydict()
            parts = [number[bisect_right(cuts, (k, q, i or 0))] for k, q, i in zip(cols["key"], cols["path"], cols["page_id"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *b.columns], names=["part", *b.schema.names])

    dealt = urls.mapInArrow(part_of, "part int, page_id long, host string, path string, key string")
    # a rule goes to every range that its interval meets: keys from its own on that begin with it
    keyed = rules.select(F.col("verdict"), _lower(F.col("host")).alias("host"), "path").withColumn("key", key(F.col("host")))

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.to_pydict()
            out: dict[str, list] = {"part": [], "verdict": [], "host": [], "path": [], "key": []}
            for v, h, q, k in zip(cols["verdict"], cols["host"], cols["path"], cols["key"], strict=True):
                lo, hi = bisect_right(cuts, (k, "", -(2**63))), bisect_right(cuts, (k + "\U0010ffff", "", 0))
                for p in range(lo, hi + 1):
                    for c, x in zip(out, (number[p], v, h, q, k), strict=True):
                        out[c].append(x)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("part", pa.int32()), *((c, pa.string()) for c in ("verdict", "host", "path", "key"))]))

    spread = keyed.mapInArrow(parts_of, "part int, verdict string, host string, path string, key string")
    both = dealt.select("part", "key", F.lit(True).alias("is_url"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    both = both.unionByName(spread.select("part", "key", F.lit(False).alias("is_url"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict"))
    return both.repartition(n, "part").sortWithinPartitions("part", "key", "is_url", "path", "page_id").mapInArrow(_sweep(default), _OUT)


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP6_SQL = r"""WITH p AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u FROM pages),
q AS (SELECT page_id, translate(regexp_extract(u, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(verdict, h, pre) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, host, path, h || pre AS rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || pre) DESC) AS k
  FROM q JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre))
SELECT q.page_id, q.host, q.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM q LEFT JOIN m
  ON q.page_id IS NOT DISTINCT FROM m.page_id AND q.host = m.host AND q.path = m.path AND m.k = 1"""
