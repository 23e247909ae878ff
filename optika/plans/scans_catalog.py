"""Queries over scans, ledgers, streams and gates of rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from optika.operators import metrics, quality, rules
from optika.plans.items import journal, orders_items, table
from optika.plans.registry import query
from optika.sources import lines, scratch
from optika.sources.restore import restore
from optika.streaming import keyed

# -- scans -----------------------------------------------------------------------------------------------------

#: Raw files that the orders are dealt to, and rows of a source that an index wants.
FILES, WANTED = 24, 40


@query(f"""SELECT o_orderkey AS sample_id, o_orderstatus AS source, o_custkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= {WANTED}""")
def early_stop_restore(spark, d) -> DataFrame:
    """The rows that an index of the first items of each source names, from raw files in the order of their keys: the scan
    stops at the file that has the last of them."""
    raw = scratch.fresh(spark, "raw-items")
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("source"), "o_custkey", "o_totalprice")
    items.repartitionByRange(FILES, "sample_id").write.parquet(raw)
    # files in key order: Spark names them by partition
    files = sorted(r["f"] for r in spark.read.parquet(raw).select(F.col("_metadata.file_path").alias("f")).distinct().collect())
    place = F.row_number().over(Window.partitionBy("source").orderBy("sample_id"))
    wanted = items.withColumn("n", place).where(F.col("n") <= WANTED).select("sample_id")
    return restore(spark, files, lambda some: spark.read.parquet(*some), wanted, "sample_id", first_wave=2).rows


_EVENT = """e AS (SELECT event_id, event_type, user_id::VARCHAR AS id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS status, (user_id % 3)::VARCHAR AS p, (event_id % 3)::VARCHAR AS g,
  coalesce('[' || round(value / 300.0::DOUBLE, 4)::VARCHAR || ',' || round(1 - value / 300.0::DOUBLE, 4)::VARCHAR || ']', 'null') AS probs FROM events WHERE user_id IS NOT NULL)"""


@query(f"""WITH {_EVENT}, j AS (SELECT *, '{{"correct":null,"error":null,"error_type":null,"gold_position":' || g || ',"gold_text":null,"option_count":2,"predicted_position":' || p || ',"predicted_text":null,' AS head,
  '"requested_model":null,"returned_model":null,"sample_id":"' || id || '","source":null,"status":' || coalesce('"' || status || '"', 'null') || '}}' AS tail FROM e),
r AS (SELECT *, head || '"probabilities":' || probs || ',' || tail AS record, sha256(head || '"probabilities":' || probs || ',' || tail) AS rs, sha256(head || tail) AS ds, row_number() OVER (PARTITION BY event_type, id ORDER BY event_id) AS turn FROM j),
a AS (SELECT event_type, id, event_id FROM r WHERE turn > 1 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 10),
s AS (SELECT event_type, string_agg(status || '=' || n, ',' ORDER BY status) AS statuses FROM (SELECT event_type, coalesce(status, 'missing') AS status, count(*) AS n FROM r GROUP BY ALL) GROUP BY event_type)
SELECT event_type, count(*)::BIGINT AS rows, count(DISTINCT id)::BIGINT AS unique_ids, coalesce((SELECT string_agg(id, ',' ORDER BY event_id) FROM a WHERE a.event_type = r.event_type), '') AS duplicates,
  sha256(string_agg(id || chr(10), '' ORDER BY id)) AS selection_sha256, sha256(string_agg(id || chr(10), '' ORDER BY event_id)) AS ordered_ids_sha256, (SELECT statuses FROM s WHERE s.event_type = r.event_type) AS statuses,
  sha256(string_agg(id || chr(0) || rs || chr(10), '' ORDER BY id, rs)) AS prediction_digest_sha256, sha256(string_agg(id || chr(0) || ds || chr(10), '' ORDER BY id, ds)) AS decision_digest_sha256,
  sha256(string_agg(record || chr(10), '' ORDER BY event_id)) AS ordered_prediction_digest_sha256 FROM r GROUP BY event_type""")
def jsonl_ledger(spark, d) -> DataFrame:
    """Events as answer files, one for each type, whose ids repeat inside a file and from file to file; a ledger of all."""
    value = F.col("value") / 300.0
    rows = table(spark, d, "events").where("user_id IS NOT NULL").select(
        "event_id", "event_type", F.col("user_id").cast("string").alias("sample_id"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("status"), (F.col("user_id") % 3).cast("int").alias("predicted_position"),
        (F.col("event_id") % 3).cast("int").alias("gold_position"), F.lit(2).alias("option_count"), F.when(value.isNotNull(), F.array(value, 1 - value)).alias("probabilities"),
    )
    out = scratch.fresh(spark, "answers")
    rows.repartition("event_type").sortWithinPartitions("event_type", "event_id").drop("event_id").write.partitionBy("event_type").option("compression", "gzip").json(out)
    got = lines.scan_jsonl(spark, out, "sample_id string, status string, predicted_position int, gold_position int, option_count int, probabilities array<double>", predictions=True)
    statuses = F.array_join(F.transform(F.array_sort(F.map_entries("statuses")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return got.select(
        F.regexp_extract("file", "event_type=([^/]+)/", 1).alias("event_type"), "rows", "unique_ids", F.array_join("duplicate_ids", ",").alias("duplicates"), "selection_sha256", "ordered_ids_sha256", statuses.alias("statuses"),
        "prediction_digest_sha256", "decision_digest_sha256", "ordered_prediction_digest_sha256",
    )


@query("""WITH j AS (SELECT user_id AS sample_id, event_id AS line_no, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'rejected' ELSE 'ok' END AS status, value AS score FROM events WHERE user_id IS NOT NULL)
SELECT sample_id::VARCHAR AS sample_id, line_no, status, score FROM j QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY (status = 'ok')::INT DESC, line_no DESC) = 1""")
def stream_ok_wins(spark, d) -> DataFrame:
    """The journal as a stream of several batches, reduced in keyed state to each item's canonical row."""
    rows = journal(spark, d)
    source, out, state = (scratch.fresh(spark, n) for n in ("stream", "canonical", "state"))
    rows.repartitionByRange(4, "line_no").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    keyed.reduce_stream(stream, out, state, "sample_id", "line_no").awaitTermination()
    return keyed.latest(spark, out).select(F.col("key").alias("sample_id"), F.col("at").alias("line_no"), "status", F.get_json_object("payload", "$.score").cast("double").alias("score"))


# -- gates of rules ----------------------------------------------------------------------------------------------

_FILES = "SELECT o_orderstatus AS file, count(*)::VARCHAR AS rows, count(DISTINCT o_custkey)::VARCHAR AS unique_ids, sha256(string_agg(o_custkey || chr(10), '' ORDER BY o_orderkey)) AS ordered_ids_sha256 FROM orders"


def _release(orders: DataFrame) -> DataFrame:
    """What a ledger says of the answers of each order status."""
    counts = orders.groupBy(F.col("o_orderstatus").alias("file")).agg(F.count("*").alias("rows"), F.count_distinct("o_custkey").alias("unique_ids"))
    order = quality.ordered_digest(orders.withColumn("file", F.col("o_orderstatus")), ["file"], F.col("o_custkey").cast("string"), F.col("o_orderkey"), "ordered_ids_sha256")
    return counts.join(order, "file")


@query(f"""WITH m AS ({_FILES} GROUP BY ALL), l AS ({_FILES} WHERE o_totalprice > (SELECT avg(o_totalprice) / 20 FROM orders) AND o_orderstatus <> 'P' GROUP BY ALL),
v AS (SELECT count(*) AS n FROM m), j AS (SELECT m.file, m.rows AS mr, l.rows AS lr, m.unique_ids AS mu, l.unique_ids AS lu, m.ordered_ids_sha256 AS mo, l.ordered_ids_sha256 AS lo, l.file IS NOT NULL AS seen FROM m LEFT JOIN l USING (file))
SELECT NULL AS file, 'files' AS rule, n::VARCHAR AS found, '24' AS wanted FROM v WHERE n <> 24 UNION ALL SELECT file, 'missing', NULL, NULL FROM j WHERE NOT seen UNION ALL SELECT file, 'rows', lr, mr FROM j WHERE seen AND lr <> mr
UNION ALL SELECT file, 'unique_ids', lu, mu FROM j WHERE seen AND lu <> mu UNION ALL SELECT file, 'ordered_ids_sha256', lo, mo FROM j WHERE seen AND lo <> mo""")
def supplement_gate(spark, d) -> DataFrame:
    """A release's manifest (all orders by status) against files that lack cheap orders, and one file altogether."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    mean = o.agg(F.avg("o_totalprice").alias("m"))
    manifest = _release(o).withColumn("schema_version", F.lit("v1"))
    seen = _release(o.where((F.col("o_totalprice") > mean.scalar() / 20) & (F.col("o_orderstatus") != "P")))
    return rules.supplement_gate(manifest, seen, "v1", 24, ("rows", "unique_ids", "ordered_ids_sha256"))


@query("""WITH r AS (SELECT user_id, event_id, event_type, sha256(coalesce(c_name, user_id::VARCHAR)) AS item_sha256, c_custkey, c_name, sha256(c_name) AS have FROM events LEFT JOIN customer ON user_id = c_custkey AND c_acctbal > 0 WHERE user_id IS NOT NULL),
i AS (SELECT c_custkey, sha256(c_name) AS item_sha256 FROM customer), j AS (SELECT r.user_id, r.event_id, r.event_type, r.item_sha256 AS row_sha, i.item_sha256 AS item_sha, i.c_custkey IS NOT NULL AS there FROM r LEFT JOIN i ON user_id = i.c_custkey)
SELECT user_id, 'outside_input' AS rule, NULL AS found, NULL AS wanted, count(*)::BIGINT AS n FROM j WHERE NOT there GROUP BY ALL UNION ALL SELECT user_id, 'requested_model', event_type, 'view', count(*)::BIGINT FROM j WHERE event_type <> 'view' GROUP BY ALL
UNION ALL SELECT user_id, 'item_sha256', row_sha, item_sha, count(*)::BIGINT FROM j WHERE there AND row_sha <> item_sha GROUP BY ALL""")
def resume_gate(spark, d) -> DataFrame:
    """Events as a journal that a run over the customers would resume: ids that are no customer's, another model (every event
    type but view), and items that changed (customers whose account has fallen to nothing)."""
    c = table(spark, d, "customer")
    rich = c.where("c_acctbal > 0").select("c_custkey", "c_name")
    e = table(spark, d, "events").where("user_id IS NOT NULL").join(rich, F.col("user_id") == F.col("c_custkey"), "left")
    rows = e.select("user_id", F.col("event_type").alias("requested_model"), F.lit("ok").alias("status"), F.sha2(F.coalesce("c_name", F.col("user_id").cast("string")), 256).alias("item_sha256"))
    items = c.select(F.col("c_custkey").alias("user_id"), F.sha2("c_name", 256).alias("item_sha256"))
    return rules.resume_gate(rows, items, "user_id", {"requested_model": "view"}).groupBy("user_id", "rule", "found", "wanted").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS place, o_orderkey AS id, o_orderstatus AS source, left(o_orderpriority, 1) AS gold FROM orders),
a AS (SELECT row_number() OVER (ORDER BY l_orderkey) AS place, l_orderkey AS id, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END AS source, least(5, count(*))::VARCHAR AS gold, max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey),
i AS (SELECT o_orderkey AS id, o_orderstatus AS source, left(o_orderpriority, 1) AS gold FROM orders WHERE o_totalprice > 2000),
j AS (SELECT coalesce(a.place, b.place) AS place, a.id AS ai, b.id AS bi, a.source AS sa, b.source AS sb, a.gold AS ga, b.gold AS gb, a.q FROM b FULL JOIN a ON a.place = b.place), k AS (SELECT j.*, i.id IS NOT NULL AS known, i.source AS si, i.gold AS gi FROM j LEFT JOIN i ON coalesce(bi, ai) = i.id)
SELECT place, 'row_count' AS rule, NULL AS found, NULL AS wanted FROM k WHERE ai IS NULL OR bi IS NULL UNION ALL SELECT place, 'order', bi::VARCHAR, ai::VARCHAR FROM k WHERE ai <> bi UNION ALL SELECT place, 'not_in_index', NULL, NULL FROM k WHERE NOT known AND ai IS NOT NULL AND bi IS NOT NULL
UNION ALL SELECT place, 'source', sb, si FROM k WHERE known AND ai IS NOT NULL AND bi IS NOT NULL AND sb <> si UNION ALL SELECT place, 'source', sa, si FROM k WHERE known AND ai IS NOT NULL AND bi IS NOT NULL AND sa <> si UNION ALL SELECT place, 'after_gold', ga, gi FROM k WHERE known AND ai IS NOT NULL AND bi IS NOT NULL AND ga <> gi
UNION ALL SELECT place, 'before_gold', gb, gi FROM k WHERE known AND ai IS NOT NULL AND bi IS NOT NULL AND q >= 25 AND gb <> gi""")
def paired_gate(spark, d) -> DataFrame:
    """Orders and what their line items add up to, as the answers of two models to one panel: places, ids, sources and golds
    that differ."""
    from optika.operators.indexes import with_ordinal

    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    gold = F.substring("o_orderpriority", 1, 1)
    five = F.lit(5).alias("k")
    before = o.select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("source"), F.lit("ok").alias("status"), gold.alias("gold"), five)
    lines_ = li.groupBy(F.col("l_orderkey").alias("sample_id")).agg(
        F.when(F.min("l_linestatus") == F.max("l_linestatus"), F.min("l_linestatus")).otherwise("P").alias("source"), F.when(F.max("l_quantity") >= 25, "ok").otherwise("error").alias("status"), F.least(F.lit(5), F.count("*")).cast("string").alias("gold"), five,
    )
    place = lambda df: with_ordinal(df, ["sample_id"]).withColumn("ordinal", F.col("ordinal") + 1)
    index = o.where("o_totalprice > 2000").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("source"), gold.alias("gold"), five)
    return rules.paired_gate(place(before), place(lines_), index, "sample_id", "ordinal").select(F.col("ordinal").alias("place"), "rule", "found", "wanted")


@query("""WITH m AS (SELECT p_brand AS model, p_type, p_name FROM part WHERE p_size = 10), e AS (SELECT model, count(*) AS n, any_value(p_type) AS repo, any_value(p_name) AS revision FROM m GROUP BY model),
c AS (SELECT p_brand AS model, min(p_type) AS repo, CASE WHEN count(*) % 2 = 0 THEN min(p_name) END AS revision FROM part GROUP BY p_brand), j AS (SELECT c.model, coalesce(n, 0) AS n, e.repo AS er, c.repo AS cr, e.revision AS ev, c.revision AS cv FROM c LEFT JOIN e USING (model))
SELECT model, 'entries' AS rule, n::VARCHAR AS found, '1' AS wanted FROM j WHERE n <> 1 UNION ALL SELECT model, 'repo_id', er, cr FROM j WHERE n = 1 AND er <> cr UNION ALL SELECT model, 'revision', ev, cv FROM j WHERE n = 1 AND cv IS NOT NULL AND ev <> cv""")
def checkpoint_gate(spark, d) -> DataFrame:
    """Brands as models, parts as downloaded entries (size 10 is the role that counts): entries, repositories, revisions."""
    p = table(spark, d, "part")
    tree = F.sha2("p_type", 256).alias("tree_sha256")
    manifest = p.select(F.col("p_brand").alias("model"), F.col("p_size").cast("string").alias("role"), F.col("p_type").alias("repo_id"), F.col("p_name").alias("resolved_revision"), tree)
    config = p.groupBy(F.col("p_brand").alias("model")).agg(F.min("p_type").alias("repo_id"), F.when(F.count("*") % 2 == 0, F.min("p_name")).alias("revision"))
    trees = manifest.where("role = '10'").groupBy("model").agg(F.min("tree_sha256").alias("tree_sha256"))
    return rules.checkpoint_gate(manifest, config, trees, "10")


# -- macro means by task -----------------------------------------------------------------------------------------


@query("""WITH i AS (SELECT o_orderstatus AS source, 'm' || (o_custkey % 4) AS model, CASE WHEN o_orderstatus = 'P' THEN 'nominal' ELSE 'ordinal' END AS task, left(o_orderpriority, 1)::INT - 1 AS gold, least(4, floor(o_totalprice / 180000))::INT AS pred FROM orders),
s AS (SELECT model, task, source, avg((gold = pred)::INT::DOUBLE) AS accuracy, avg(CASE WHEN task = 'ordinal' THEN abs(gold - pred)::DOUBLE / 4 END) AS nmae FROM i GROUP BY model, task, source)
SELECT model, task, count(*)::BIGINT AS datasets, round(avg(accuracy), 6) AS accuracy, round(avg(nmae), 6) AS nmae FROM s GROUP BY model, task""")
def macro_by_task(spark, d) -> DataFrame:
    """Means over datasets by model and task; a metric that no dataset of a task has (the error of nominal ones) is null."""
    items = orders_items(spark, d).withColumn("task", F.when(F.col("source") == "P", "nominal").otherwise("ordinal"))
    hit, off = (F.col("gold") == F.col("pred")).cast("double"), F.abs(F.col("gold") - F.col("pred")).cast("double") / 4
    detail = items.groupBy("model", "task", "source").agg(F.avg(hit).alias("accuracy"), F.avg(F.when(F.col("task") == "ordinal", off)).alias("nmae"))
    counts = detail.groupBy("model", "task").agg(F.count("*").alias("datasets"))
    return counts.join(metrics.macro(detail, ["model", "task"], ["accuracy", "nmae"]), ["model", "task"]).select("model", "task", "datasets", "accuracy", "nmae")
