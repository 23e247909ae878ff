"""Queries over records, indexes, joins in which rows must meet, gates and merges, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optika.functions import arrays as A
from optika.functions import text as T
from optika.operators import indexes, metrics, paired, quality, results, sampling
from optika.plans.items import K, journal, orders_items, orders_probs, table
from optika.plans.registry import query

# -- items as records ----------------------------------------------------------------------------------------------

#: Orders as items with five options.
ITEM_SQL = """it AS (SELECT o_orderkey::VARCHAR AS sample_id, o_orderstatus AS source, 'o-' || o_orderkey AS original_id, CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'test' END AS split, 'p=' || o_orderpriority AS sampling_stratum,
  42 AS sampling_seed, 'ordinal_choice' AS task_type, 'order ' || o_orderkey || ' of ' || o_custkey AS context, 'Which priority?' AS question, ['urgent', 'high', 'medium', 'none', 'low'] AS choices, left(o_orderpriority, 1)::INT - 1 AS gold_position FROM orders)"""


def item_rows(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    return o.select(
        key.alias("sample_id"), F.col("o_orderstatus").alias("source"), F.concat(F.lit("o-"), key).alias("original_id"), F.when(F.col("o_orderkey") % 2 == 0, "train").otherwise("test").alias("split"),
        F.concat(F.lit("p="), "o_orderpriority").alias("sampling_stratum"), F.lit(42).alias("sampling_seed"), F.lit("ordinal_choice").alias("task_type"), F.concat(F.lit("order "), key, F.lit(" of "), F.col("o_custkey").cast("string")).alias("context"),
        F.lit("Which priority?").alias("question"), F.array(*map(F.lit, ["urgent", "high", "medium", "none", "low"])).alias("choices"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("gold_position"),
    )


_ROW = "{'choices': choices, 'context': context, 'gold_position': gold_position, 'original_id': original_id, 'question': question, 'sample_id': sample_id, 'sampling_seed': sampling_seed, 'sampling_stratum': sampling_stratum, 'source': source, 'split': split, 'task_type': task_type}"


@query(
    "WITH " + ITEM_SQL + f""" SELECT row_number() OVER (ORDER BY source, sample_id) - 1 AS ordinal, sample_id, source, original_id, split, sampling_stratum, sampling_seed, NULL::VARCHAR AS source_repo, NULL::VARCHAR AS source_revision, task_type,
len(choices)::INT AS option_count, gold_position, sha256(to_json({_ROW})::VARCHAR) AS row_sha256, sha256(context) AS context_sha256, question AS kept_question FROM it"""
)
def main_index(spark, d) -> DataFrame:
    rows = indexes.with_ordinal(item_rows(spark, d), ["source", "sample_id"])
    return indexes.main_index(rows).withColumn("kept_question", F.col("row_without_context.question")).drop("row_without_context")


_VAR = """v AS (SELECT *, sample_id AS base_sample_id, CASE WHEN gold_position % 2 = 0 THEN 'reversed' ELSE 'rotated' END AS order_variant, CASE WHEN gold_position % 2 = 0 THEN [4, 3, 2, 1, 0] ELSE [1, 2, 3, 4, 0] END AS perm FROM it)"""


@query(
    "WITH " + ITEM_SQL + ", " + _VAR + """ SELECT row_number() OVER (ORDER BY sample_id) - 1 AS ordinal, sample_id || ':' || order_variant AS sample_id, base_sample_id, source, order_variant, 5 AS option_count, list_position(perm, gold_position)::INT - 1 AS gold_position,
gold_position AS original_gold_position, to_json(perm)::VARCHAR AS perm, sha256(context) AS context_sha256 FROM v"""
)
def position_index(spark, d) -> DataFrame:
    rows = item_rows(spark, d).withColumn("original_gold_position", F.col("gold_position")).withColumn("base_sample_id", F.col("sample_id"))
    even = F.col("gold_position") % 2 == 0
    perm = F.when(even, F.array(*map(F.lit, [4, 3, 2, 1, 0]))).otherwise(F.array(*map(F.lit, [1, 2, 3, 4, 0])))
    rows = indexes.with_ordinal(rows, ["sample_id"]).withColumn("order_variant", F.when(even, "reversed").otherwise("rotated")).withColumn("choice_permutation_new_to_original", perm)
    rows = rows.withColumn("sample_id", F.concat_ws(":", "sample_id", "order_variant")).withColumn("gold_position", (F.array_position(perm, F.col("gold_position")) - 1).cast("int"))
    out = indexes.position_index(rows)
    return out.select("ordinal", "sample_id", "base_sample_id", "source", "order_variant", "option_count", "gold_position", "original_gold_position", F.to_json("permutation_new_to_canonical").alias("perm"), "context_sha256")


@query(
    """SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ordinal, p_partkey::VARCHAR AS sample_id, CASE WHEN p_partkey % 3 = 0 THEN 'dbpedia14' ELSE 'part' END AS source, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 14 ELSE p_partkey % 9 END::INT AS gold_canonical_level,
CASE WHEN p_partkey % 3 = 0 THEN '[1,0]' ELSE '[0,1]' END AS perm, CASE WHEN p_partkey % 3 = 0 THEN '[4,7]' END AS candidates, CASE WHEN p_partkey % 3 <> 0 THEN 2.5::DOUBLE END AS edge FROM part"""
)
def kcurve_index(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    nominal = F.col("p_partkey") % 3 == 0
    key = F.col("p_partkey").cast("string")
    rows = p.select(
        "p_partkey", key.alias("sample_id"), key.alias("base_sample_id"), F.when(nominal, "dbpedia14").otherwise("part").alias("source"), F.lit("choice").alias("task_type"), F.lit(2).alias("option_count"), F.lit(0).alias("gold_position"),
        F.col("p_name").alias("context"), (F.col("p_partkey") % 14).cast("int").alias("gold_source_class_index"), (F.col("p_partkey") % 9 + 1).cast("string").alias("gold_canonical_level"),
        F.array(F.lit(1), F.lit(0)).alias("choice_permutation_new_to_source_class"), F.array(F.lit(0), F.lit(1)).alias("choice_permutation_new_to_canonical"), F.array(F.lit(4), F.lit(7)).alias("candidate_source_class_indices"), F.array(F.lit(2.5)).alias("bin_edges"),
    )
    out = indexes.kcurve_index(indexes.with_ordinal(rows, ["p_partkey"]))
    return out.select("ordinal", "sample_id", "source", "gold_canonical_level", F.to_json("permutation_new_to_canonical").alias("perm"), F.to_json("candidate_set_canonical").alias("candidates"), F.get("bin_edges", F.lit(0)).alias("edge"))


@query("WITH " + ITEM_SQL + " SELECT sample_id, question, sha256(context) AS context_sha FROM it")
def rows_restored(spark, d) -> DataFrame:
    """Index records put together again with their contexts."""
    rows = indexes.with_ordinal(item_rows(spark, d), ["sample_id"])
    back = indexes.restored(indexes.main_index(rows), rows.select("sample_id", "context"))
    return back.select("sample_id", "question", T.sha(F.col("context")).alias("context_sha"))


@query("""WITH l AS (SELECT l_orderkey, max(l_linenumber) AS n, count(*) AS rows FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey::VARCHAR AS sample_id FROM orders JOIN l ON l_orderkey = o_orderkey WHERE n <> rows""")
def drift_gate(spark, d) -> DataFrame:
    """Rows whose content is not the frozen one: orders, frozen with the number of their last line, now with how many
    lines they have."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("key")).agg(F.max("l_linenumber").alias("last"), F.count("*").alias("lines"))
    rows = item_rows(spark, d).join(li, F.col("sample_id") == F.col("key"))
    content = lambda c: T.sha(F.concat_ws(" ", "context", F.col(c).cast("string"))).alias("row_sha256")
    return indexes.drifted(rows.select("sample_id", content("lines")), rows.select("sample_id", content("last"))).select("sample_id")


# -- predictions ---------------------------------------------------------------------------------------------------

PRED_SQL = """pr AS (SELECT o_orderkey::VARCHAR AS sample_id, o_orderstatus AS source, CASE WHEN o_orderkey % 11 = 0 THEN 'error' ELSE 'ok' END AS status, 'm' || (o_custkey % 4) AS requested_model, CASE WHEN o_orderkey % 3 = 0 THEN 'r' END AS returned_model,
  (o_custkey % 5)::INT AS predicted_position, left(o_orderpriority, 1)::INT - 1 AS gold_position, 5 AS option_count, 'L' || (o_custkey % 5) AS predicted_text, NULL::VARCHAR AS gold_text, [0.5::DOUBLE, round_even(o_custkey % 97 / 97.0::DOUBLE, 4)] AS probabilities,
  o_custkey % 5 = left(o_orderpriority, 1)::INT - 1 AS correct, NULL::VARCHAR AS error_type, CASE WHEN o_orderkey % 11 = 0 THEN 'timeout' END AS error FROM orders)"""
_REC = "'correct': correct, 'error': error, 'error_type': error_type, 'gold_position': gold_position, 'gold_text': gold_text, 'option_count': option_count, 'predicted_position': predicted_position, 'predicted_text': predicted_text, {p}'requested_model': requested_model, 'returned_model': returned_model, 'sample_id': sample_id, 'source': source, 'status': status"
RECORDED = f"WITH {PRED_SQL}, rec AS (SELECT *, sha256(to_json({{{_REC.format(p=chr(39) + 'probabilities' + chr(39) + ': probabilities, ')}}})::VARCHAR) AS record_sha256, sha256(to_json({{{_REC.format(p='')}}})::VARCHAR) AS decision_sha256 FROM pr)"


def prediction_rows(spark, d) -> DataFrame:
    """Half of the answers in the current schema, half in the historical one."""
    o = table(spark, d, "orders")
    pred, gold = (F.col("o_custkey") % 5).cast("int"), F.substring("o_orderpriority", 1, 1).cast("int") - 1
    common = [F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_orderstatus").alias("source"), F.when(F.col("o_orderkey") % 11 == 0, "error").otherwise("ok").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, "r").alias("returned_model"),
              (pred == gold).alias("correct"), F.when(F.col("o_orderkey") % 11 == 0, "timeout").alias("error")]
    p = [F.lit(0.5), F.col("o_custkey") % 97 / F.lit(97.0)]
    model, text = F.concat(F.lit("m"), (F.col("o_custkey") % 4).cast("string")), F.concat(F.lit("L"), pred.cast("string"))
    new = o.where("o_orderkey % 2 = 0").select(*common, model.alias("model"), pred.alias("predicted_position"), gold.alias("gold_position"), F.lit(5).alias("option_count"), text.alias("predicted_label_text"), F.array(*p).alias("probabilities"))
    old = o.where("o_orderkey % 2 = 1").select(*common, model.alias("requested_model"), pred.alias("prediction_position"), gold.alias("expected_position"), F.lit(5).alias("choice_count"), text.alias("prediction_text"), F.map_from_arrays(F.array(F.lit("b"), F.lit("A")), F.array(*p[::-1])).alias("keyed"))
    return results.unify(new.unionByName(old, allowMissingColumns=True))


@query(RECORDED + " SELECT sample_id, source, status, record_sha256, decision_sha256 FROM rec")
def stable_records(spark, d) -> DataFrame:
    return results.recorded(prediction_rows(spark, d))


@query(RECORDED + """ SELECT source, sha256(string_agg(sample_id || chr(0) || record_sha256 || chr(10), '' ORDER BY sample_id)) AS prediction_digest, sha256(string_agg(sample_id || chr(0) || decision_sha256 || chr(10), '' ORDER BY sample_id)) AS decision_digest,
sha256(string_agg(record_sha256 || chr(10), '' ORDER BY record_sha256)) AS pool_digest FROM rec GROUP BY source""")
def prediction_digests(spark, d) -> DataFrame:
    r = results.recorded(prediction_rows(spark, d))
    a = quality.record_digest(r, ["source"], F.col("sample_id"), F.col("record_sha256"), "prediction_digest", packed=True)
    b = quality.record_digest(r, ["source"], F.col("sample_id"), F.col("decision_sha256"), "decision_digest", packed=True)
    return a.join(b, "source").join(quality.pool_digest(r, ["source"], F.col("record_sha256"), "pool_digest", packed=True), "source")


@query("""WITH e AS (SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS turn FROM events), a AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place FROM e WHERE turn = 2),
g AS (SELECT event_type, string_agg(user_id::VARCHAR, ',' ORDER BY place) AS dup FROM a WHERE place <= 10 GROUP BY event_type) SELECT event_type, count(*)::BIGINT AS rows, count(DISTINCT user_id)::BIGINT AS unique_ids, coalesce(any_value(dup), '') AS dup FROM events LEFT JOIN g USING (event_type) GROUP BY event_type""")
def id_report(spark, d) -> DataFrame:
    """Rows, unique ids and the first ten repeated ones."""
    out = quality.id_report(table(spark, d, "events").select("event_type", "user_id", "event_id"), ["event_type"], "user_id", "event_id")
    return out.select("event_type", "rows", "unique_ids", F.array_join(F.col("duplicate_ids").cast("array<string>"), ",").alias("dup"))


#: Requests with two to six options, answered with letters; shares come from prices, and a third of the statuses adds an
#: envelope.  What makes an answer invalid (another letter, a share below 0 or above 1, a sum that is off, a letter that is
#: not there, another type) follows from the columns.
_ANSWER = """WITH l AS (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS last, min(l_discount) AS off, max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_orderkey AS id, n, CAST(substr(o_orderpriority, 1, 1) AS INT) AS p, o_orderstatus AS s, o_custkey AS c, off, CASE WHEN q > 49 THEN 'text' ELSE 'choice' END AS kind, CAST(last AS DOUBLE) / CAST(100 AS DOUBLE) AS big FROM orders JOIN l ON l_orderkey = o_orderkey),
a AS (SELECT *, substr('ABCDEFGH', p, 1) AS letter, CASE WHEN p <= 2 THEN 2 ELSE 3 END AS k FROM o)"""


@query("WITH" + _ANSWER.removeprefix("WITH") + """, f AS (SELECT *, CASE WHEN kind <> 'choice' OR p > k THEN 'malformed choice' WHEN n < k THEN 'incomplete probabilities' WHEN 1 - big + off > 1 THEN 'invalid probability'
  WHEN abs(big + (1 - big + off) - 1) > 0.02 THEN 'probabilities do not sum to one' END AS error FROM a)
SELECT id, CASE WHEN error IS NULL THEN letter END AS predicted_key, CASE WHEN error IS NULL THEN p - 1 ELSE -1 END AS predicted_position, CASE WHEN error IS NULL THEN ['yes', 'no', 'so'][p] END AS predicted_label_text,
  CASE WHEN error IS NULL THEN round(big, 4) END AS first, CASE WHEN error IS NULL THEN s END AS returned_model, error FROM f""")
def parsed_responses(spark, d) -> DataFrame:
    """Answers of a hosted model, from columns: valid ones with their position and shares, others with what is wrong."""
    table(spark, d, "orders").createOrReplaceTempView("_responses_orders")
    table(spark, d, "lineitem").createOrReplaceTempView("_responses_lines")
    sql = _ANSWER.replace("FROM lineitem", "FROM _responses_lines").replace("FROM orders", "FROM _responses_orders")
    a = spark.sql(sql + " SELECT * FROM a")
    big, rest = F.col("big"), 1 - F.col("big") + F.col("off")
    shares = F.when(F.col("n") < F.col("k"), F.create_map(F.lit("A"), big)).when(F.col("k") == 2, F.create_map(F.lit("A"), big, F.lit("B"), rest)).otherwise(F.create_map(F.lit("A"), big, F.lit("B"), rest, F.lit("C"), F.lit(0.0)))
    decision = F.struct(F.col("kind").alias("type"), F.col("letter").alias("choice"), shares.alias("probabilities"))
    body = F.struct(F.struct(decision.alias("decision")).alias("answers"), F.col("s").alias("model"))
    response = F.when(F.col("s") == "F", F.to_json(F.struct(body.alias("data")))).otherwise(F.to_json(body))
    rows = a.select("id", response.alias("response"), F.slice(F.array(F.lit("yes"), F.lit("no"), F.lit("so")), F.lit(1), F.col("k")).alias("choices"))
    out = results.parse_responses(rows)
    return out.select("id", "predicted_key", F.coalesce("predicted_position", F.lit(-1)).alias("predicted_position"), "predicted_label_text", F.round(F.get("probabilities", F.lit(0)), 4).alias("first"), "returned_model", "error")


@query("""WITH z AS (SELECT vec_id, label, [x::DOUBLE / 0.7 FOR x IN embedding] AS z FROM embeddings WHERE len(embedding) >= 4 AND NOT list_contains([isnan(x) OR isinf(x) OR x IS NULL FOR x IN embedding], true)), e AS (SELECT *, [exp(v - list_max(z)) FOR v IN z] AS e FROM z)
SELECT vec_id, list_position(e, list_max(e))::INT - 1 AS predicted_position, 'class ' || list_position(e, list_max(e)) AS predicted_label_text, list_position(e, list_max(e)) - 1 = label AS correct, round(e[1] / list_sum(e), 6) AS first, round(ln(e[2] / list_sum(e)), 6) AS log_second FROM e""")
def logits_to_results(spark, d) -> DataFrame:
    """Result records from logits at a temperature: softmax, first maximum, its text, whether it is right."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("gold"), F.transform("embedding", lambda x: x.cast("double")).alias("logits"), F.transform("embedding", lambda _, i: F.concat(F.lit("class "), (i + 1).cast("string"))).alias("choices"))
    e = e.where(F.coalesce((F.size("logits") >= 4) & F.forall("logits", quality.finite), F.lit(False))).withColumn("kept", F.col("logits"))
    r = results.from_logits(e, 0.7)
    return r.select("vec_id", "predicted_position", "predicted_label_text", "correct", F.round(F.element_at(A.keyed(F.slice("probabilities", 1, 26)), "A"), 6).alias("first"), F.round(F.get(A.log_softmax(F.col("kept"), 0.7), F.lit(1)), 6).alias("log_second"))


@query("""SELECT o_orderkey AS id, left(replace(replace('HTTPError: key ' || o_custkey || ' at ' || 'https://api.example.org/v1' || ' ' || repeat('x', (o_orderkey % 2000)::INT), '17', '[REDACTED]'), 'https://api.example.org/v1', '[ENDPOINT]'), 1600) AS error FROM orders""")
def redacted_errors(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    text = F.concat(F.lit("HTTPError: key "), F.col("o_custkey").cast("string"), F.lit(" at https://api.example.org/v1 "), F.repeat(F.lit("x"), (F.col("o_orderkey") % 2000).cast("int")))
    return o.select(F.col("o_orderkey").alias("id"), results.redacted(text, "17", "https://api.example.org/v1").alias("error"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'answer-v1' ELSE event_type END AS schema_version FROM events")
def sanitized_rows(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.upper("event_type").alias("schema_version"), "value", "props")
    out = results.sanitized(e, ["value", "props"], ["Click", "VIEW"], "answer-v1")
    return out.withColumn("schema_version", F.when(F.col("schema_version") == "answer-v1", F.col("schema_version")).otherwise(F.lower("schema_version")))


@query("WITH " + ITEM_SQL + " SELECT sample_id, 'run-1' AS run, sha256(to_json({'context': context, 'question': question})::VARCHAR) AS item_sha256, sha256(question || chr(0) || context) AS pair_sha, to_json([source, sampling_stratum])::VARCHAR AS cell FROM it")
def stamped_items(spark, d) -> DataFrame:
    rows = results.stamped(item_rows(spark, d), {"run": "run-1"}, ["context", "question"])
    return rows.select("sample_id", "run", "item_sha256", T.question_context_sha(F.col("question"), F.col("context")).alias("pair_sha"), T.cell_key(F.col("source"), F.col("sampling_stratum")).alias("cell"))


@query("WITH " + ITEM_SQL + """ SELECT sample_id, sha256('{"criteria":{"A":"urgent","B":"high","C":"medium","D":"none","E":"low"},"instructions":"' || question || '","state":"' || context || '"}') AS request_sha FROM it""")
def request_hashes(spark, d) -> DataFrame:
    rows = item_rows(spark, d).select("sample_id", F.col("context").alias("state"), F.col("question").alias("instructions"), A.request_options(F.col("choices")).alias("criteria"))
    return rows.select("sample_id", T.canonical_sha(rows, "state", "instructions", "criteria").alias("request_sha"))


# -- joins in which rows must meet ---------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def required_join(spark, d) -> DataFrame:
    """Line items with their order; one without an order would fail the job."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    got = indexes.require_partners(lines, table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], "orders")
    return got.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "o_orderstatus")


@query("WITH f AS (SELECT o_custkey, o_orderstatus, arg_min(o_totalprice, o_orderkey) AS first_price FROM orders GROUP BY ALL), b AS (SELECT c_custkey, unnest(['F', 'O']) AS o_orderstatus FROM customer) SELECT c_custkey, b.o_orderstatus, first_price FROM b LEFT JOIN f ON c_custkey = o_custkey AND b.o_orderstatus = f.o_orderstatus")
def first_match_lookup(spark, d) -> DataFrame:
    """The first order of each customer by status: a lookup by two keys."""
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.explode(F.array(F.lit("F"), F.lit("O"))).alias("o_orderstatus"))
    right = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")
    got = indexes.first_match(left, right, ["o_custkey", "o_orderstatus"], "o_orderkey")
    return got.select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", F.col("o_totalprice").alias("first_price"))


@query(
    """WITH c AS (SELECT source, row, pos, v, sha256(v) AS h FROM (SELECT 'b' AS source, item_id AS row, 0 AS pos, text AS v FROM benchmark WHERE text IS NOT NULL UNION ALL SELECT 'b', item_id, 1, upper(text) FROM benchmark WHERE text IS NOT NULL
  UNION ALL SELECT 'b', item_id + 1000000, 0, text FROM benchmark WHERE text IS NOT NULL)),
w AS (SELECT source, h, max(sample_id) AS sample_id FROM (SELECT 'b' AS source, 's' || item_id AS sample_id, sha256(CASE WHEN item_id % 2 = 0 THEN text ELSE upper(text) END) AS h FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
f AS (SELECT source, row, arg_min(pos, pos) AS pos, arg_min(h, pos) AS h, arg_min(sample_id, pos) AS sample_id FROM c JOIN w USING (source, h) GROUP BY source, row)
SELECT source, sample_id, arg_min(h, row) AS context_sha256, min(row)::BIGINT AS row, arg_min(pos, row)::INT AS variant FROM f GROUP BY source, sample_id"""
)
def content_hash_recovery(spark, d) -> DataFrame:
    """Frozen contexts found again among variants of the raw ones; each hash is used up once."""
    b = table(spark, d, "benchmark").where("text IS NOT NULL")
    one = b.select(F.lit("b").alias("source"), F.col("item_id").alias("row"), F.array("text", T.upper_each(F.col("text"))).alias("variants"))
    two = b.select(F.lit("b").alias("source"), (F.col("item_id") + 1000000).alias("row"), F.array("text").alias("variants"))
    wanted = b.select(F.lit("b").alias("source"), F.concat(F.lit("s"), F.col("item_id").cast("string")).alias("sample_id"), T.sha(F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(T.upper_each(F.col("text")))).alias("context_sha256"))
    return indexes.hash_recovered(one.unionByName(two), wanted).select("source", "sample_id", "context_sha256", F.col("row").cast("long").alias("row"), "variant")


@query("SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem JOIN (SELECT o_orderkey, o_orderkey % 4 + 1 AS n FROM orders) ON l_orderkey = o_orderkey AND l_linenumber = n GROUP BY ALL")
def composite_key_join(spark, d) -> DataFrame:
    index = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 4 + 1).alias("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(index, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))


@query("SELECT n_regionkey, min(r_name) AS region FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey")
def constant_attribute(spark, d) -> DataFrame:
    """An attribute that has to be constant inside its group."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return indexes.constant_attribute(n.select("n_regionkey", F.col("r_name").alias("region")), "n_regionkey", "region")


@query("SELECT key, arg_max(v, turn) AS v FROM (SELECT o_custkey AS key, 'o' AS v, 0 AS turn FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, 'c', 1 FROM customer WHERE c_custkey % 2 = 0) GROUP BY key")
def overwrite_merge(spark, d) -> DataFrame:
    first = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.lit("o").alias("v")).distinct()
    return indexes.overwrite_merge([first, table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.lit("c").alias("v"))], "key")


@query("WITH s AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderstatus))) AS st FROM orders GROUP BY o_custkey) SELECT o_custkey, len([x FOR x IN st IF NOT list_contains(['F', 'O'], x)]) = 0 AS only_f_o, NOT list_contains(st, 'P') AS no_p, st = ['F', 'O'] AS exactly_f_o FROM s")
def set_tests(spark, d) -> DataFrame:
    """Subset, disjointness and equality of sets."""
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("st"))
    fo = F.array(F.lit("F"), F.lit("O"))
    return s.select("o_custkey", A.subset(F.col("st"), fo).alias("only_f_o"), A.disjoint(F.col("st"), F.array(F.lit("P"))).alias("no_p"), (F.col("st") == fo).alias("exactly_f_o"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal FROM orders")
def file_ordinals(spark, d) -> DataFrame:
    return indexes.with_ordinal(table(spark, d, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "ordinal")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY sha256('9' || chr(31) || o_orderkey), o_orderkey) - 1 AS place FROM orders")
def seeded_shuffle(spark, d) -> DataFrame:
    """A global shuffle of all rows, with the place that each gets."""
    rows = sampling.seeded_shuffle(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 9)
    rank = rows.withColumn("rank", T.hash_rank(9, F.col("o_orderkey")))
    return indexes.with_ordinal(rank, ["rank", "o_orderkey"]).select("o_orderkey", F.col("ordinal").alias("place"))


@query("WITH " + ITEM_SQL + """, r AS (SELECT *, sha256('5' || chr(31) || source || chr(31) || sampling_stratum || chr(31) || sample_id) AS rank, 'part ' || (sample_id::BIGINT // 2) AS body FROM it),
k AS (SELECT *, row_number() OVER (PARTITION BY source, body ORDER BY rank, sample_id) AS n FROM r) SELECT sample_id, rank FROM k WHERE n = 1""")
def candidate_pool(spark, d) -> DataFrame:
    """One row of each content by the lowest hash rank; repeated ids or conflicting labels would fail the job."""
    rows = item_rows(spark, d).withColumn("stratum", F.col("sampling_stratum")).withColumn("context", F.concat(F.lit("part "), F.floor(F.col("sample_id").cast("long") / 2).cast("string"))).drop("gold_position")
    return sampling.candidate_pool(rows, 5).select("sample_id", "rank")


# -- metrics -------------------------------------------------------------------------------------------------------

_I = "items AS (SELECT o_orderkey AS sample_id, o_orderstatus AS source, left(o_orderpriority, 1)::INT - 1 AS gold, least(4, floor(o_totalprice / 180000))::INT AS pred FROM orders)"


@query(f"WITH {_I}, c AS (SELECT source, gold, pred, count(*)::BIGINT AS n FROM items GROUP BY ALL) SELECT *, (sum(n) OVER (PARTITION BY source, gold))::BIGINT AS row_sum, (sum(n) OVER (PARTITION BY source, pred))::BIGINT AS column_sum FROM c")
def confusion_with_sums(spark, d) -> DataFrame:
    return metrics.confusion_with_sums(orders_items(spark, d), ["source"])


@query(f"WITH {_I} SELECT source, count(*)::BIGINT AS n, round(avg((gold = pred)::INT::DOUBLE), 6) AS accuracy, round(sum(abs(gold - pred))::DOUBLE / (count(*) * 4), 6) AS nmae FROM items GROUP BY source")
def merged_states(spark, d) -> DataFrame:
    """Metrics from the merged states of two halves of the data: the accumulator's two phases."""
    items = orders_items(spark, d)
    halves = [metrics.two_phase_sums(items.where(f"sample_id % 2 = {h}"), ["source"], K) for h in (0, 1)]
    return metrics.finish(metrics.merge_sums(halves[0].unionByName(halves[1]), ["source"], K), ["source"], K).select("source", "n", "accuracy", "nmae")


@query(f"""WITH {_I}, p AS (SELECT sample_id, source, gold, pred AS before, CASE WHEN sample_id % 4 = 0 THEN gold ELSE pred END AS after FROM items),
l AS (SELECT source, phase, gold, unnest([before, after]) AS pred FROM (SELECT source, gold, before, after, unnest(['before', 'after']) AS phase FROM p) WHERE false UNION ALL SELECT source, 'before', gold, before FROM p UNION ALL SELECT source, 'after', gold, after FROM p),
m AS (SELECT source, phase, count(*)::BIGINT AS n, avg((gold = pred)::INT::DOUBLE) AS acc, sum(abs(gold - pred))::DOUBLE / (count(*) * 4) AS nmae FROM l GROUP BY ALL)
SELECT source, max(n) AS n, round(max(acc) FILTER (phase = 'before'), 6) AS accuracy_before, round(max(acc) FILTER (phase = 'after'), 6) AS accuracy_after, round(round(max(acc) FILTER (phase = 'after'), 6) - round(max(acc) FILTER (phase = 'before'), 6), 6) AS accuracy_delta,
round(max(nmae) FILTER (phase = 'before'), 6) AS nmae_before, round(max(nmae) FILTER (phase = 'after'), 6) AS nmae_after FROM m GROUP BY source""")
def metric_changes(spark, d) -> DataFrame:
    i = orders_items(spark, d)
    ok = F.lit("ok").alias("status")
    after = i.select("sample_id", ok, F.when(F.col("sample_id") % 4 == 0, F.col("gold")).otherwise(F.col("pred")).alias("pred"))
    pairs = paired.pair(i.select("sample_id", ok, "pred"), after, i.select("sample_id", "source", "gold"), "sample_id")
    return paired.metric_changes(pairs, ["source"], K).select("source", "n", "accuracy_before", "accuracy_after", "accuracy_delta", "nmae_before", "nmae_after")


@query("SELECT count(*)::BIGINT AS rows, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents WHERE text IS NOT NULL")
def totals(spark, d) -> DataFrame:
    return quality.totals(table(spark, d, "documents").where("text IS NOT NULL").select(F.octet_length("text").alias("b")), "b").select("rows", F.col("bytes").cast("long").alias("bytes"))


# -- gates ---------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey AS source, min(n)::INT AS low, max(n)::INT AS high FROM (SELECT o_custkey, o_orderkey % 3 + 2 AS n FROM orders) GROUP BY o_custkey HAVING min(n) <> max(n)")
def uniform_size_gate(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 3 + 2).cast("int").alias("n"))
    return quality.uniform_size_gate(o, "source", F.col("n"))


@query("SELECT o_custkey AS source, count(DISTINCT o_orderpriority)::BIGINT AS have, 5 AS want FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) <> 5")
def level_coverage_gate(spark, d) -> DataFrame:
    return quality.level_coverage_gate(table(spark, d, "orders").withColumnRenamed("o_custkey", "source"), "source", "o_orderpriority", F.lit(5))


@query("SELECT l_orderkey AS pair, count(*)::BIGINT AS versions FROM lineitem GROUP BY l_orderkey HAVING count(*) <> 7")
def versions_gate(spark, d) -> DataFrame:
    return quality.versions_gate(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "pair"), "pair", 7)


_CAND = """c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ['a', 'b'] ELSE ['b', 'c', 'a'] END AS choices, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'a' ELSE 'b' END ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'b' ELSE 'c' END END AS gold FROM orders)"""


@query(f"""WITH {_CAND}, n AS (SELECT list_sort(choices) AS k, gold, count(*)::BIGINT AS n FROM c GROUP BY ALL) SELECT array_to_string(k, ',') AS candidates, array_to_string(list_sort(list(gold)), ',') AS golds, min(n) AS low, max(n) AS high, list_sort(list(gold)) <> k AS leaks, min(n) <> max(n) AS unequal FROM n GROUP BY k""")
def gold_balance(spark, d) -> DataFrame:
    """Whether the options shown tell the gold label."""
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").select(F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("c"), F.lit("a"))).alias("choices"), F.when(k % 2 == 0, F.when(k % 4 == 0, "a").otherwise("b")).otherwise(F.when(k % 3 == 0, "b").otherwise("c")).alias("gold"))
    out = quality.gold_balance(c, "choices", "gold")
    return out.select(F.array_join("candidates", ",").alias("candidates"), F.array_join("golds", ",").alias("golds"), "low", "high", "leaks", "unequal")


@query("""WITH l AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_shipdate, l_partkey, l_linenumber) AS shown FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey FROM l WHERE shown <> [x FOR x IN range(1, len(shown) + 1)]""")
def level_choices_gate(spark, d) -> DataFrame:
    """Orders' lines as levels, shown in the order of shipping: those that are not exactly Level 01, Level 02, ..."""
    li = table(spark, d, "lineitem")
    shown = F.array_sort(F.collect_list(F.struct("l_shipdate", "l_partkey", "l_linenumber")))
    rows = li.groupBy("l_orderkey").agg(F.transform(shown, lambda x: T.level_name(x["l_linenumber"].cast("int"))).alias("choices"))
    return quality.level_choices_gate(rows).select("l_orderkey")


@query("""WITH t AS (SELECT count(*)::BIGINT AS n FROM nation), c AS (SELECT r_name AS subject, count(n_nationkey)::BIGINT AS found FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name),
w AS (SELECT r_name AS subject, CASE WHEN r_regionkey = 0 THEN 4 ELSE 5 END::BIGINT AS wanted FROM region UNION ALL SELECT 'NOWHERE', 2)
SELECT 'total' AS problem, 'all' AS subject, n AS found, 26::BIGINT AS wanted FROM t WHERE n <> 26 UNION ALL SELECT 'unique', 'all', count(DISTINCT n_nationkey % 20)::BIGINT, 26 FROM nation UNION ALL SELECT 'source', subject, coalesce(found, 0), wanted FROM w LEFT JOIN c USING (subject) WHERE coalesce(found, 0) <> wanted
UNION ALL SELECT 'choices', 'rows', count(*)::BIGINT, 0 FROM nation WHERE n_nationkey % 6 = 0 UNION ALL SELECT 'label', 'rows', count(*)::BIGINT, 0 FROM nation WHERE n_nationkey % 6 = 1""")
def frozen_input_gate(spark, d) -> DataFrame:
    """Totals, unique ids, rows of each source, options and label texts of a frozen input."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    k = F.col("n_nationkey")
    items = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        (k % 20).alias("sample_id"), F.col("r_name").alias("source"), F.when(k % 6 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("choices"),
        F.lit(1).alias("gold_position"), F.when(k % 6 == 1, "a").otherwise("b").alias("gold_label_text"),
    )
    wanted = {x["r_name"]: 4 if x["r_regionkey"] == 0 else 5 for x in r.collect()} | {"NOWHERE": 2}
    return quality.frozen_gate(items, wanted)


@query("""WITH e AS (SELECT s_suppkey AS k, s_suppkey % 10 AS rows, 'h' || (s_suppkey % 3) AS sha FROM supplier WHERE s_suppkey % 13 <> 0), o AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN -1 ELSE s_suppkey % 10 END AS rows, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'h' || (s_suppkey % 3) END AS sha FROM supplier WHERE s_suppkey % 11 <> 0)
SELECT coalesce(e.k, o.k) AS k, 'missing' AS problem FROM e FULL JOIN o ON e.k = o.k WHERE o.k IS NULL UNION ALL SELECT o.k, 'unexpected' FROM e FULL JOIN o ON e.k = o.k WHERE e.k IS NULL
UNION ALL SELECT e.k, 'rows' FROM e JOIN o ON e.k = o.k WHERE e.rows <> o.rows UNION ALL SELECT e.k, 'sha' FROM e JOIN o ON e.k = o.k WHERE e.sha IS DISTINCT FROM o.sha""")
def manifest_gate(spark, d) -> DataFrame:
    """A release's manifest against what a scan found."""
    s = F.col("s_suppkey")
    sup = table(spark, d, "supplier")
    sha = F.concat(F.lit("h"), (s % 3).cast("string"))
    expected = sup.where("s_suppkey % 13 <> 0").select(s.alias("k"), (s % 10).alias("rows"), sha.alias("sha"))
    observed = sup.where("s_suppkey % 11 <> 0").select(s.alias("k"), F.when(s % 7 == 0, -1).otherwise(s % 10).alias("rows"), F.when(s % 5 != 0, sha).alias("sha"))
    return quality.manifest_gate(expected, observed, "k", ["rows", "sha"])


@query("""WITH f AS (SELECT unnest(['a', 'b', 'c']) AS file), c AS (SELECT file, c_custkey FROM f, customer WHERE NOT (file = 'b' AND c_custkey = 3))
SELECT 'b' AS file, 'rows' AS problem UNION ALL SELECT 'b', 'order' UNION ALL SELECT 'c', 'status' UNION ALL SELECT 'c', 'order' WHERE (SELECT count(*) FROM customer) > 1""")
def release_gate(spark, d) -> DataFrame:
    """Three files of a release: one lacks a row, one has a failed answer and another order."""
    c = table(spark, d, "customer").select(F.explode(F.array(*map(F.lit, "abc"))).alias("file"), F.col("c_custkey").alias("key")).where("NOT (file = 'b' AND key = 3)")
    c = c.withColumn("ordinal", F.when(F.col("file") == "c", -F.col("key")).otherwise(F.col("key"))).withColumn("status", F.when((F.col("file") == "c") & (F.col("key") == 5), "error").otherwise("ok"))
    return quality.release_gate(c, "file", "key", "ordinal", "status", table(spark, d, "customer").count())


@query("""WITH r AS (SELECT o_orderstatus AS source, count(DISTINCT o_orderkey)::BIGINT AS n FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'F')) GROUP BY ALL), i AS (SELECT o_orderstatus AS source, count(DISTINCT o_orderkey)::BIGINT AS n FROM orders GROUP BY ALL)
SELECT source, r.n AS result_ids, i.n AS index_ids FROM r JOIN i USING (source) WHERE r.n <> i.n""")
def index_gate(spark, d) -> DataFrame:
    """Sources whose answers are not about exactly the indexed items."""
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("source"), "o_orderkey")
    least = o.where("source = 'F'").agg(F.min("o_orderkey").alias("m")).first()["m"]
    return quality.index_gate(o.where(F.col("o_orderkey") != least), o, "source", "o_orderkey").select("source", "result_ids", "index_ids")


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'the ') THEN 'the ' ELSE 'QUE' END AS token FROM documents WHERE contains(lower(text), 'the ') OR contains(lower(text), 'que')")
def forbidden_lines(spark, d) -> DataFrame:
    return quality.forbidden_lines(table(spark, d, "documents").select("doc_id", "text"), "text", ["the ", "QUE"]).select("doc_id", "token")


@query("""WITH u AS (SELECT page_id, split_part(split_part(url, '?', 1), '://', 2) AS path FROM pages WHERE url IS NOT NULL)
SELECT page_id, NOT list_has_any(string_split(path, '/'), ['en', 'es']) AND NOT regexp_matches(path, '(\\.html|\\.php)$') AS counts, regexp_extract(path, '[^/](\\.[^./]+)/*$', 1) AS suffix, CASE WHEN starts_with(path, 'www.example.com/') THEN substr(path, 17) END AS below FROM u""")
def path_parts(spark, d) -> DataFrame:
    u = table(spark, d, "pages").where("url IS NOT NULL").select("page_id", F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("://"), F.lit(2)).alias("path"))
    return u.select("page_id", quality.included_path(F.col("path"), ["en", "es"], [".html", ".php"]).alias("counts"), T.suffix(F.col("path")).alias("suffix"), T.relative_to(F.col("path"), "www.example.com").alias("below"))


@query("SELECT user_id AS sample_id, count(*)::BIGINT AS n FROM events WHERE event_type NOT IN ('error', 'click') AND user_id IS NOT NULL GROUP BY user_id HAVING count(*) > 1")
def repeated_success(spark, d) -> DataFrame:
    """Items with several ok answers."""
    return results.repeated(journal(spark, d).where("sample_id IS NOT NULL"), "sample_id")


@query("""WITH l AS (SELECT l_orderkey, [x / 100.0::DOUBLE FOR x IN list(l_quantity ORDER BY l_linenumber, l_partkey)] AS p, count(DISTINCT l_linenumber) = count(*) AND max(l_linenumber) = count(*) AS keyed FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, keyed AND abs(list_sum(p) - 1) <= 0.0001 AS teacher, keyed AND len(p) = 3 AND abs(list_sum(p) - 1) <= 0.02 AS complete FROM l WHERE keyed""")
def distribution_gates(spark, d) -> DataFrame:
    """Quantities of an order's lines in hundredths, keyed by line: teacher distributions, and complete ones over three
    options."""
    li = table(spark, d, "lineitem")
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("x"), ((F.count_distinct("l_linenumber") == F.count("*")) & (F.max("l_linenumber") == F.count("*"))).alias("keyed")).where("keyed")
    keys, values = F.transform("x", lambda v: T.letter(v["l_linenumber"].cast("int") - 1)), F.transform("x", lambda v: v["l_quantity"].cast("double") / 100)
    p = F.map_from_arrays(keys, values)
    return g.select("l_orderkey", A.valid_teacher(p).alias("teacher"), A.complete_probabilities(p, 3).alias("complete"))


@query("""WITH u AS (SELECT split_part(url, '://', 2) AS n, length(html) AS size FROM pages WHERE url IS NOT NULL), m AS (SELECT n AS name FROM u UNION ALL SELECT substr(n, strpos(n || '/', '/')) FROM u), e AS (SELECT DISTINCT n AS name FROM u WHERE size > 1500 UNION SELECT 'index/' || substr(n, strpos(n || '/', '/') + 1) FROM u)
SELECT DISTINCT name, 'unsafe' AS problem FROM m WHERE starts_with(name, '/') OR contains(name, ':') OR contains(name, '\\') OR list_contains(string_split(name, '/'), '..') UNION ALL SELECT name, 'duplicate' FROM m GROUP BY name HAVING count(*) > 1
UNION ALL SELECT name, 'missing' FROM e WHERE name NOT IN (SELECT name FROM m) UNION ALL SELECT DISTINCT name, 'unexpected' FROM m WHERE name NOT IN (SELECT name FROM e)""")
def archive_members_gate(spark, d) -> DataFrame:
    """Pages as members of an archive, with and without their host, against a list of the larger ones and of an index."""
    u = table(spark, d, "pages").where("url IS NOT NULL").select(F.split_part("url", F.lit("://"), F.lit(2)).alias("n"), F.length("html").alias("size"))
    below = F.expr("substr(n, instr(concat(n, '/'), '/'))")
    names = u.select(F.explode(F.array("n", below)).alias("name"))
    expected = u.where("size > 1500").select(F.col("n").alias("name")).union(u.select(F.expr("concat('index/', substr(n, instr(concat(n, '/'), '/') + 1))"))).distinct()
    return quality.member_problems(names, expected)


@query("SELECT conv_id, turn, sha256(trim(text)) AS text_sha FROM conversations WHERE trim(coalesce(text, '')) <> ''")
def utterances(spark, d) -> DataFrame:
    from optika.sources.fetch import utterances as read

    return read(table(spark, d, "conversations")).select("conv_id", "turn", T.sha(F.col("text")).alias("text_sha"))


@query("SELECT s_suppkey AS source FROM supplier WHERE s_suppkey % 3 = 0")
def source_selection(spark, d) -> DataFrame:
    from optika.sources.fetch import select_sources

    registry = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") % 3 == 0).alias("pinned"))
    return select_sources(registry, "pinned").select("source")


@query("""WITH s AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*)::BIGINT AS n, max(o_custkey)::BIGINT AS m FROM orders GROUP BY ALL), g AS (SELECT s, '{' || string_agg('"' || p || '":{"m":' || m || ',"n":' || n || '}', ',' ORDER BY p) || '}' AS b FROM s GROUP BY s)
SELECT '{' || string_agg('"' || s || '":' || b, ',' ORDER BY s) || '}' AS document FROM g""")
def summary_document(spark, d) -> DataFrame:
    from optika.sources.io import summary_document as document

    agg = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p")).agg(F.max("o_custkey").cast("long").alias("m"), F.count("*").alias("n"))
    return document(agg, ["s", "p"])


@query("SELECT model, count(*) FILTER (list_max(probs) >= 0.4)::BIGINT AS sure, round(avg(probs[1] / list_sum(probs)), 6) AS first FROM (SELECT 'm' || (o_custkey % 4) AS model, [1.0::DOUBLE / (1 + abs(i - least(4, floor(o_totalprice / 180000))) + (o_orderkey * (i + 3)) % 7) FOR i IN [0, 1, 2, 3, 4]] AS w, [x / list_sum(w) FOR x IN w] AS probs FROM orders) GROUP BY model")
def strict_distributions(spark, d) -> DataFrame:
    """Vectors scaled to sum 1, where one without mass would fail the job."""
    p = orders_probs(spark, d).withColumn("u", A.unit_sum_or_fail(F.col("probs")))
    return p.groupBy("model").agg(F.count_if(F.array_max("u") >= 0.4).alias("sure"), F.round(F.avg(F.get("u", F.lit(0))), 6).alias("first"))
