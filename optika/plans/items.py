"""Views over the test tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal predictions: four models, three sources, five labels."""
    gold = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    pred = F.least(F.lit(4), F.floor(F.col("o_totalprice") / 180000)).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("source"), F.concat(F.lit("m"), (F.col("o_custkey") % 4).cast("string")).alias("model"), gold.alias("gold"), pred.alias("pred"), F.col("o_custkey").alias("cust")
    )


def orders_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders_items with a probability vector that leans to the prediction."""
    weight = lambda i: 1.0 / (1 + F.abs(F.lit(i) - F.col("pred")) + (F.col("sample_id") * (i + 3)) % 7)
    weights = F.array(*(weight(i) for i in range(K)))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return orders_items(spark, sf_dir).withColumn("probs", F.transform(weights, lambda x: x / total))


def embedding_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nominal predictions: the softmax of the first ten components against the label."""
    from optika.functions import arrays as A

    e = table(spark, sf_dir, "embeddings").withColumn("probs", A.softmax(F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))))
    return e.select(F.col("vec_id").alias("sample_id"), F.lit("embedding").alias("source"), F.col("label").alias("gold"), A.first_max(F.col("probs")).alias("pred"), "probs")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "rejected").otherwise("ok")
    return e.select(F.col("user_id").alias("sample_id"), F.col("event_id").alias("line_no"), status.alias("status"), F.col("value").alias("score"))


def doc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stratum = F.coalesce(F.concat_ws(":", F.col("quality").cast("string"), F.nullif(F.col("toxic").cast("string"), F.lit(None))), F.lit("unlabelled"))
    joined = d.join(lab, "doc_id", "left")
    return joined.select("doc_id", "text", "lang", "source", F.when(F.col("quality").isNull(), "unlabelled").otherwise(stratum).alias("stratum"), "quality", "toxic")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sample_id"), F.concat("l_returnflag", F.lit("|"), "l_linestatus").alias("source"), "l_quantity", "l_extendedprice", "l_orderkey", "l_linenumber")
