"""Rules over rows as data, judged in one pass, and the gates that are lists of rules.

A gate gives a row for each breach and none where all rules hold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """What must hold of a field.

    kind: ``equals`` (the value ``against``), ``same`` (the column ``against``), ``one_of`` (a list), ``present``, ``absent``,
    ``between`` (a pair).  Nulls are values: a null equals a null alone.  ``scope`` is an SQL condition on the row; where it
    is not true the rule does not apply.
    """

    name: str
    field: str
    kind: str = "equals"
    against: object = None
    scope: str | None = None

    def wanted(self) -> Column:
        if self.kind == "same":
            return F.col(str(self.against)).cast("string")
        return F.lit(None if self.kind in ("present", "absent") else ",".join(map(str, self.against)) if isinstance(self.against, (list, tuple)) else None if self.against is None else str(self.against))

    def holds(self) -> Column:
        x = F.col(self.field)
        if self.kind == "equals":
            return x.eqNullSafe(F.lit(self.against))
        if self.kind == "same":
            return x.eqNullSafe(F.col(str(self.against)))
        if self.kind == "one_of":
            return F.coalesce(x.isin(*self.against), F.lit(False))
        if self.kind == "present":
            return x.isNotNull()
        if self.kind == "absent":
            return x.isNull()
        if self.kind == "between":
            return F.coalesce(x.between(*self.against), F.lit(False))
        raise ValueError(self.kind)


def breaches(df: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """keys, rule, found, wanted for each rule that a row breaks; all rules are judged in one pass over df."""
    judged = []
    for r in rules:
        broken = ~r.holds() if r.scope is None else F.coalesce(F.expr(r.scope), F.lit(False)) & ~r.holds()
        judged.append(F.when(broken, F.struct(F.lit(r.name).alias("rule"), F.col(r.field).cast("string").alias("found"), r.wanted().alias("wanted"))))
    return df.select(*keys, F.explode(F.filter(F.array(*judged), lambda x: x.isNotNull())).alias("_b")).select(*keys, "_b.*")


def total_breaches(df: DataFrame, totals: dict[str, tuple[str, object]]) -> DataFrame:
    """rule, found, wanted for each total (an SQL aggregate and its value) that df as a whole does not have."""
    agg = df.agg(*(F.expr(sql).cast("string").alias(name) for name, (sql, _) in totals.items()))
    rows = [F.when(~F.col(name).eqNullSafe(F.lit(str(want))), F.struct(F.lit(name).alias("rule"), F.col(name).alias("found"), F.lit(str(want)).alias("wanted"))) for name, (_, want) in totals.items()]
    return agg.select(F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("_b")).select("_b.*")


def _sides(left: DataFrame, right: DataFrame, key: str, tags: tuple[str, str], how: str = "full") -> DataFrame:
    """Both tables by key: columns of each under its tag, with ``<tag>_there`` where the side has the key."""
    a, b = (df.select(F.col(key).alias(f"_{t}"), F.lit(True).alias(f"{t}_there"), *(F.col(c).alias(f"{t}_{c}") for c in df.columns if c != key)) for df, t in zip((left, right), tags, strict=True))
    joined = a.join(b, F.col(f"_{tags[0]}") == F.col(f"_{tags[1]}"), how)
    return joined.withColumn(key, F.coalesce(f"_{tags[0]}", f"_{tags[1]}")).drop(f"_{tags[0]}", f"_{tags[1]}")


#: What a release's manifest says of a file and a scan must find.
FILE_FIELDS = ("archive_sha256", "rows", "unique_ids", "ordered_ids_sha256")


def supplement_gate(manifest: DataFrame, ledger: DataFrame, schema_version: str, files: int, fields: tuple[str, ...] = FILE_FIELDS) -> DataFrame:
    """A supplementary release (manifest: file, schema_version and ``fields``; ledger: file and ``fields``, as
    ``scan_jsonl`` gives them): file, rule, found, wanted.

    The release as a whole has one schema version and so many files (file is null in these rows); every file of the
    manifest is there with its exact bytes, rows, unique ids and id order, and no other."""
    whole = total_breaches(manifest, {"schema_version": ("CASE WHEN count(DISTINCT schema_version) = 1 AND count(schema_version) = count(*) THEN max(schema_version) END", schema_version), "files": ("count(DISTINCT file)", files)})
    both = _sides(manifest.select("file", *fields), ledger.select("file", *fields), "file", ("told", "seen"))
    there = "told_there AND seen_there"
    rules = [Rule("missing", "seen_there", "present", scope="told_there"), Rule("unexpected", "told_there", "present", scope="seen_there"), *(Rule(f, f"seen_{f}", "same", f"told_{f}", there) for f in fields)]
    return whole.select(F.lit(None).cast("string").alias("file"), "rule", "found", "wanted").unionByName(breaches(both, rules, ["file"]))


def resume_gate(journal: DataFrame, items: DataFrame, key: str, run: dict[str, object], returned_model: str | None = None) -> DataFrame:
    """Rows of a journal that a resumed run must not find: key, rule, found, wanted.

    ``items`` (key, item_sha256) is the run's input, ``run`` what every row must carry (input hash, requested model,
    configuration hash, ...).  An id outside the input, another run's value, an item that has changed, and, if
    ``returned_model`` is given, an ok answer of another model are breaches."""
    both = _sides(journal, items.select(key, "item_sha256"), key, ("row", "item"), "left")
    rules = [Rule("outside_input", "item_there", "present"), *(Rule(name, f"row_{name}", "equals", value) for name, value in run.items()), Rule("item_sha256", "row_item_sha256", "same", "item_item_sha256", "item_there")]
    if returned_model is not None:
        rules.append(Rule("returned_model", "row_returned_model", "equals", returned_model, "row_status = 'ok'"))
    return breaches(both, rules, [key])


def paired_gate(before: DataFrame, after: DataFrame, gold: DataFrame, key: str, ordinal: str, rows: int | None = None) -> DataFrame:
    """Two released answer files of one panel against its index: ordinal, key, rule, found, wanted.

    before and after (ordinal, key, source, status, gold, k) are joined by their place in the file, then with gold (key, source,
    gold, k).  At every place both have a row with the same id, the index has it, all three agree on the source, the later
    file on gold and k, and where both answers are ok the earlier file too.  ``rows`` is the number of places wanted."""
    zipped = _sides(before, after, ordinal, ("b", "a"))
    index = gold.select(F.col(key).alias("_k"), F.lit(True).alias("i_there"), *(F.col(c).alias(f"i_{c}") for c in ("source", "gold", "k")))
    both = zipped.withColumn(key, F.coalesce(f"b_{key}", f"a_{key}")).join(index, F.col(key) == F.col("_k"), "left")
    there, known = "b_there AND a_there", "b_there AND a_there AND i_there"
    ok = f"{known} AND b_status = 'ok' AND a_status = 'ok'"
    rules = [
        Rule("row_count", "b_there", "present"), Rule("row_count", "a_there", "present"), Rule("order", f"b_{key}", "same", f"a_{key}", there), Rule("not_in_index", "i_there", "present", scope=there),
        *(Rule("source", f"{t}_source", "same", "i_source", known) for t in "ba"), *(Rule(f"after_{c}", f"a_{c}", "same", f"i_{c}", known) for c in ("gold", "k")), *(Rule(f"before_{c}", f"b_{c}", "same", f"i_{c}", ok) for c in ("gold", "k")),
    ]
    out = breaches(both, rules, [ordinal, key])
    if rows is None:
        return out
    whole = total_breaches(zipped, {"rows": ("count(*)", rows)})
    none = lambda c: F.lit(None).cast(dict(out.dtypes)[c]).alias(c)
    return whole.select(none(ordinal), none(key), "rule", "found", "wanted").unionByName(out)


def checkpoint_gate(manifest: DataFrame, config: DataFrame, trees: DataFrame, role: str = "weights") -> DataFrame:
    """Downloaded models against their configuration: model, rule, found, wanted.

    manifest: model, role, repo_id, resolved_revision, tree_sha256; config: model, repo_id, revision; trees: model,
    tree_sha256 as found.  Every configured model has exactly one entry of the role, of its repository, of its
    revision where one is pinned, and its files are what the manifest says.  Entries of other roles don't count."""
    entries = manifest.where(F.col("role") == role).groupBy("model").agg(F.count("*").alias("entries"), *(F.first(c).alias(c) for c in ("repo_id", "resolved_revision", "tree_sha256")))
    both = _sides(config, entries, "model", ("want", "have"), "left").withColumn("entries", F.coalesce("have_entries", F.lit(0)))
    seen = trees.select(F.col("model").alias("_m"), F.col("tree_sha256").alias("seen_tree"))
    both = both.join(seen, F.col("model") == F.col("_m"), "left")
    rules = [
        Rule("entries", "entries", "equals", 1), Rule("repo_id", "have_repo_id", "same", "want_repo_id", "entries = 1"), Rule("revision", "have_resolved_revision", "same", "want_revision", "entries = 1 AND want_revision IS NOT NULL AND want_revision <> ''"),
        Rule("tree_sha256", "seen_tree", "same", "have_tree_sha256", "entries = 1"),
    ]
    return breaches(both, rules, ["model"])
