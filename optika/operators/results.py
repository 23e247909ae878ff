"""Answer journals and prediction records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optika.functions import arrays as A
from optika.functions import text as T


def last_wins(journal: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key, whatever its status; rows without a key go."""
    row = F.struct(*(c for c in journal.columns if c != key))
    return journal.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row, F.col(order)).alias("r")).select(key, "r.*")


def ok_wins(journal: DataFrame, key: str, order: str, status: str = "status") -> DataFrame:
    """The latest ok row of each key, or else the latest of any status."""
    row = F.struct(*(c for c in journal.columns if c != key))
    return journal.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row, F.struct(F.col(status) == "ok", F.col(order))).alias("r")).select(key, "r.*")


def first_per_key(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key in input order; the survivor is fixed, unlike dropDuplicates."""
    row = F.struct(*(c for c in df.columns if c not in key))
    return df.groupBy(*key).agg(F.min_by(row, F.col(order)).alias("r")).select(*key, "r.*")


def pending(index: DataFrame, journal: DataFrame, key: str, terminal=("ok",), status: str = "status") -> DataFrame:
    """Index rows that have no finished answer yet."""
    return index.join(journal.where(F.col(status).isin(*terminal)).select(key).distinct(), key, "left_anti")


def repeated(journal: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Keys with several ok rows."""
    return journal.where(F.col(status) == "ok").groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def unify(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One prediction schema from current and historical field names; absent columns count as null, and those of ``keep``
    stay as they are.

    sample_id, source, status, requested_model, returned_model, pred, gold, k, pred_text, gold_text, probs, correct,
    error_type, error."""
    have = set(df.columns)
    pick = lambda kind, *names: F.coalesce(*(F.col(n).cast(kind) for n in names if n in have), F.lit(None).cast(kind))
    k = F.coalesce(pick("int", "option_count", "choice_count"), *([F.size("choices")] if "choices" in have else []), *([F.size("probabilities")] if "probabilities" in have else []))
    out = df.select(
        *keep, F.col("sample_id").cast("string").alias("sample_id"), pick("string", "source").alias("source"), pick("string", "status").alias("status"),
        F.coalesce(F.nullif(pick("string", "requested_model"), F.lit("")), pick("string", "model")).alias("requested_model"), pick("string", "returned_model").alias("returned_model"),
        pick("int", "predicted_position", "prediction_position").alias("pred"), pick("int", "gold_position", "expected_position").alias("gold"), k.alias("k"),
        pick("string", "predicted_label_text", "prediction_text").alias("pred_text"), pick("string", "gold_label_text", "expected_text").alias("gold_text"),
        pick("boolean", "correct").alias("correct"), pick("string", "error_type").alias("error_type"), pick("string", "error").alias("error"),
        (F.col("probabilities") if "probabilities" in have else F.lit(None).cast("array<double>")).alias("raw"), (F.col("keyed") if "keyed" in have else F.lit(None).cast("map<string,double>")).alias("keyed"),
    )
    probs = F.coalesce(F.when(F.size("raw") > 0, F.slice("raw", F.lit(1), F.col("k"))), F.when(F.col("keyed").isNotNull(), A.keyed_probabilities(F.col("keyed"), F.col("k"))))
    return out.withColumn("probs", probs).drop("raw", "keyed")


def stable_record(df: DataFrame, probabilities: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """The 14 comparable fields of a unified prediction; probabilities to four places, or left out (the decision).
    Columns of ``keep`` come first."""
    names = {"pred": "predicted_position", "gold": "gold_position", "k": "option_count", "pred_text": "predicted_text", "gold_text": "gold_text"}
    order = ["sample_id", "source", "status", "requested_model", "returned_model", "pred", "gold", "k", "pred_text", "gold_text", "probs", "correct", "error_type", "error"]
    cols = [F.transform("probs", lambda x: A.rounded(x, 4)).alias("probabilities") if c == "probs" else F.col(c).alias(names.get(c, c)) for c in order if probabilities or c != "probs"]
    return df.select(*keep, *cols)


def recorded(df: DataFrame) -> DataFrame:
    """sample_id with the SHA-256 of its stable record and of its decision, each as canonical JSON."""
    whole, decision = stable_record(df), stable_record(df, False)
    return whole.select("sample_id", "source", "status", T.canonical_sha(whole).alias("record_sha256"), T.canonical_sha(whole, *decision.columns).alias("decision_sha256"))


def from_logits(df: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Result records from logits (sample_id, logits, choices, gold): probabilities, the first maximum, its text and
    whether it is right."""
    out = df.withColumn("probabilities", A.softmax(F.col("logits"), temperature)).withColumn("predicted_position", A.first_max(F.col("probabilities")))
    out = out.withColumn("predicted_label_text", F.get("choices", F.col("predicted_position")))
    return out.withColumn("correct", F.col("predicted_position") == F.col("gold")).withColumn("status", F.lit("ok")).drop("logits")


#: The part of a response that is read, with or without its envelope.
RESPONSE = (
    "struct<data:struct<answers:struct<decision:struct<type:string,choice:string,confidence:double,probabilities:map<string,double>>>,model:string,usage:map<string,bigint>>,"
    "answers:struct<decision:struct<type:string,choice:string,confidence:double,probabilities:map<string,double>>>,model:string,usage:map<string,bigint>>"
)


def parse_responses(df: DataFrame, tolerance: float = 0.02, lower: bool = False) -> DataFrame:
    """Answers of a hosted model (response: JSON text, choices) to positions and probabilities.

    Adds predicted_key, predicted_position, predicted_label_text, probabilities (in key order), confidence,
    returned_model, usage and error; error is null where the answer is a choice among the keys with a complete, valid
    distribution, and the other columns are null where it is not."""
    r = F.from_json("response", RESPONSE)
    out = df.withColumn("_r", r).withColumn("_answer", F.coalesce(F.col("_r.data.answers.decision"), F.when(F.col("_r.data").isNull(), F.col("_r.answers.decision"))))
    keys = A.letter_keys(F.size("choices"), lower)
    bad_choice = F.coalesce((F.col("_answer.type") != "choice") | ~F.array_contains(keys, F.col("_answer.choice")), F.lit(True))
    p = F.col("_answer.probabilities")
    missing = F.coalesce(F.array_sort(F.map_keys(p)) != keys, F.lit(True))
    invalid = ~F.coalesce(F.forall(F.map_values(p), lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1)), F.lit(False))
    error = F.when(bad_choice, "malformed choice").when(missing, "incomplete probabilities").when(invalid, "invalid probability").when(F.abs(A.total(F.map_values(p)) - 1) > tolerance, "probabilities do not sum to one")
    out = out.withColumn("error", error)
    position = (F.array_position(keys, F.col("_answer.choice")) - 1).cast("int")
    ok = lambda x: F.when(F.col("error").isNull(), x)
    return out.select(
        *df.columns, ok(F.col("_answer.choice")).alias("predicted_key"), ok(position).alias("predicted_position"), ok(F.get("choices", position)).alias("predicted_label_text"),
        ok(F.transform(keys, lambda k: F.try_element_at(p, k))).alias("probabilities"), ok(F.col("_answer.confidence")).alias("confidence"),
        ok(F.coalesce("_r.data.model", "_r.model")).alias("returned_model"), ok(F.coalesce("_r.data.usage", "_r.usage")).alias("usage"), "error",
    )


def redacted(error: Column, secret: str, endpoint: str, most: int = 1600) -> Column:
    """An error text without the secret, the endpoint and its authority, of at most ``most`` characters."""
    from urllib.parse import urlsplit

    for what, by in ((secret, "[REDACTED]"), (endpoint, "[ENDPOINT]"), (urlsplit(endpoint).netloc, "[ENDPOINT]")):
        if what:
            error = F.replace(error, F.lit(what), F.lit(by))
    return F.substring(error, 1, most)


def utc_now() -> Column:
    """The time at which a query began, in UTC and ISO format with its offset."""
    return F.concat(F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def stamped(df: DataFrame, provenance: dict[str, str], input_columns: list[str], at: str | None = None) -> DataFrame:
    """Results with their provenance: constants of the run, the SHA-256 of the item as it was asked, and the time in
    the column ``at`` if one is named."""
    df = df if at is None else df.withColumn(at, utc_now())
    return df.withColumns({k: F.lit(v) for k, v in provenance.items()}).withColumn("item_sha256", T.canonical_sha(df, *input_columns))


def sanitized(df: DataFrame, removed: list[str], markers: list[str], version: str) -> DataFrame:
    """Rows without the named fields; a schema_version that names one of the markers, in any case, becomes ``version``."""
    out = df.drop(*removed)
    if "schema_version" not in out.columns:
        return out
    low = T.casefold(F.coalesce("schema_version", F.lit("")))
    named = F.lit(False)
    for m in markers:
        named = named | low.contains(m.casefold())
    return out.withColumn("schema_version", F.when(named, F.lit(version)).otherwise(F.col("schema_version")))


def provenance_mismatch(journal: DataFrame, expected: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Journal rows whose provenance fields differ from what is expected; a resume must find none."""
    e = expected.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    return journal.join(e, key, "left").where(~same).select(*journal.columns)
