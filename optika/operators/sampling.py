"""Deterministic stratified sampling by hash rank."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optika.functions import text as T
from optika.operators.ranking import place_by_hash
from optika.sources.scratch import written


def lowest_rank_copy(df: DataFrame, signature: str, rank: str, key: str) -> DataFrame:
    """One row of each content signature: that of the lowest (rank, key)."""
    row = F.struct(*(c for c in df.columns if c != signature))
    return df.groupBy(signature).agg(F.min_by(row, F.struct(F.col(rank), F.col(key))).alias("r")).select(signature, "r.*")


def conflicts(df: DataFrame, signature: str, label: str) -> DataFrame:
    """Signatures that carry more than one label; a sampler must find none.  A null label counts as a label."""
    return df.groupBy(signature).agg(F.count_distinct(F.struct(label)).alias("labels"), F.count("*").alias("n")).where("labels > 1")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def unique_contexts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur exactly once: every copy of a repeated context goes."""
    once = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return df.join(once, keys, "left_semi")


def label_of(df: DataFrame) -> Column:
    """What a conflict is judged by: the label's text, else its position, else a plain label."""
    have = [F.to_json(F.struct(F.col(c).alias("v"))) for c in ("gold_label_text", "gold_position", "label") if c in df.columns]
    present = [F.when(F.col(c).isNotNull(), j) for c, j in zip((c for c in ("gold_label_text", "gold_position", "label") if c in df.columns), have, strict=True)]
    return F.coalesce(*present, F.lit("null"))


def candidate_pool(df: DataFrame, seed: int) -> DataFrame:
    """The pool that a sample is drawn from (sample_id, source, question, context, choices, stratum, a label): one row of
    each content, that of the lowest hash rank, with its signature and rank.

    Fails where a sample_id repeats or rows of equal content carry different labels."""
    for name, bad in (("duplicate sample_id", duplicate_keys(df, "sample_id")),):
        if rows := bad.limit(1).collect():
            raise ValueError(f"{name}: {rows[0][0]}")
    signed = df.withColumn("signature", T.content_signature(F.col("source"), F.col("question"), F.col("context"), F.col("choices")))
    signed = signed.withColumn("rank", T.hash_rank(seed, F.col("source"), F.col("stratum"), F.col("sample_id")))
    clash = conflicts(signed.withColumn("_label", label_of(df)), "signature", "_label")
    if rows := clash.orderBy("signature").limit(1).collect():
        raise ValueError(f"conflicting labels in {clash.count()} groups of equal content, first {rows[0]['signature']}")
    return lowest_rank_copy(signed, "signature", "rank", "sample_id")


class _Circle:
    """Cells in a circle with what each has left, in blocks: the least of all, the first with it from a place on, and one
    less for a run of cells each cost about the square root of the number of cells."""

    GONE = 1 << 62

    def __init__(self, room: np.ndarray):
        self.size = max(16, int(len(room) ** 0.5))
        pad = -len(room) % self.size
        self.room = np.concatenate([room, np.full(pad, self.GONE)]).reshape(-1, self.size)
        self.shift = np.zeros(len(self.room), np.int64)
        self.least = self.room.min(1)
        self.count = (self.room < self.GONE).sum(1)

    def place(self, nth: int) -> int:
        """Where the nth cell left stands."""
        upto = np.cumsum(self.count)
        b = int(np.searchsorted(upto, nth, "right"))
        inside = nth - (int(upto[b - 1]) if b else 0)
        return b * self.size + int(np.flatnonzero(self.room[b] < self.GONE)[inside])

    def number(self, place: int) -> int:
        """How many cells left stand before a place."""
        b, i = divmod(place, self.size)
        return int(self.count[:b].sum()) + int((self.room[b, :i] < self.GONE).sum())

    def next_with(self, value: int, place: int) -> int:
        """The first cell with that much left, from a place on and around."""
        b, i = divmod(place, self.size)
        here = np.flatnonzero(self.room[b, i:] == value - self.shift[b])
        if len(here):
            return place + int(here[0])
        have = np.flatnonzero(self.least == value)
        b = int(have[have > b][0]) if (have > b).any() else int(have[0])
        return b * self.size + int(np.flatnonzero(self.room[b] == value - self.shift[b])[0])

    def one_less(self, start: int, stop: int) -> None:
        (a, i), (b, j) = divmod(start, self.size), divmod(stop, self.size)
        if a == b:
            self._part(a, i, j)
            return
        self._part(a, i, self.size)
        self.shift[a + 1 : b] -= 1
        self.least[a + 1 : b] -= 1
        if j:
            self._part(b, 0, j)

    def _part(self, b: int, i: int, j: int) -> None:
        run = self.room[b, i:j]
        run[run < self.GONE] -= 1
        self._settle(b)

    def _settle(self, b: int) -> None:
        low = self.room[b].min()
        self.least[b] = low + self.shift[b] if low < self.GONE else self.GONE

    def remove(self, place: int) -> None:
        b, i = divmod(place, self.size)
        self.room[b, i] = self.GONE
        self.count[b] -= 1
        self._settle(b)


def deal(room: np.ndarray, wanted: int) -> np.ndarray:
    """Deals ``wanted`` units to cells in turn, none beyond its room.

    A used-up cell leaves the circle only when its turn comes; the turn counter, which until then runs on without
    wrapping, is then reduced modulo the number of cells left.  This can pass over cells and is part of the definition, so
    that departures follow one from the other.

    Between two departures the circle turns evenly.  The next to leave is the first cell from the cursor on among those
    that have the least left, r: until its turn every cell is visited r times, those between the cursor and it once more.
    A departure costs the square root of the number of cells, whatever the number of units."""
    room = np.asarray(room, np.int64)
    if room.sum() < wanted:
        raise ValueError(f"{wanted} rows wanted, {int(room.sum())} available")
    cells = np.flatnonzero(room > 0)
    circle, given, rounds, cursor, left, m = _Circle(room[cells]), np.zeros_like(room), 0, 0, int(wanted), len(cells)
    while left:
        value = int(circle.least.min())
        start = circle.place(cursor)
        leaver = circle.next_with(value, start)
        ahead = (circle.number(leaver) - cursor) % m
        steps = ahead + m * (value - rounds)
        if steps >= left:
            break
        rounds = value
        if leaver >= start:
            circle.one_less(start, leaver)
        else:
            circle.one_less(start, circle.room.size)
            circle.one_less(0, leaver)
        circle.remove(leaver)
        m, left = m - 1, left - steps
        cursor = (cursor + steps) % m if m else 0
    still = (circle.room < circle.GONE).reshape(-1)[: len(cells)]
    now = (circle.room + circle.shift[:, None]).reshape(-1)[: len(cells)] - rounds
    given[cells] = room[cells]
    there = np.flatnonzero(still)
    more = np.full(m, left // max(1, m)) + ((np.arange(m) - cursor) % max(1, m) < left % max(1, m))
    given[cells[there]] -= now[there] - more
    return given


def _dealt(rows: pd.DataFrame, name: str, n: str, wanted: int) -> pd.DataFrame:
    rows = rows.sort_values(name, na_position="last", kind="stable")
    return rows.assign(given=deal(rows[n].to_numpy(), wanted))


def allocation(df: DataFrame, wanted: int, source: str = "source", stratum: str = "stratum") -> DataFrame:
    """How many rows of each cell a sample takes: source, stratum, available, given.  Sources first, then the strata inside
    each source, by the rule of ``deal``; null names come last.

    The driver sees no cell.  The rule is sequential over what it deals to, so that one task deals to all sources and
    then a task for each source to its strata; such a task holds a number for each of its cells."""
    cells = df.groupBy(F.col(source).cast("string").alias("source"), F.col(stratum).cast("string").alias("stratum")).agg(F.count("*").alias("available"))
    cells = written(cells, "cells")
    sources = cells.groupBy("source").agg(F.sum("available").alias("available")).withColumn("_all", F.lit(0))
    outer = sources.groupBy("_all").applyInPandas(lambda rows: _dealt(rows, "source", "available", wanted).drop(columns="_all"), "source string, available long, given long")
    share = outer.select(F.col("source").alias("_s"), F.col("given").alias("_share"))
    both = cells.join(share, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    schema = "source string, stratum string, available long, given long"
    return both.groupBy("source").applyInPandas(lambda rows: _dealt(rows, "stratum", "available", int(rows["_share"].iloc[0])).drop(columns="_share"), schema)


def hash_sample(df: DataFrame, wanted: int, seed: int, key: str = "sample_id", source: str = "source", stratum: str = "stratum") -> DataFrame:
    """A stratified sample of ``wanted`` rows: allocation over the cells, lowest hash ranks inside each.  A null source
    or stratum is a cell of its own.  Fails where a key repeats."""
    if rows := duplicate_keys(df, key).limit(1).collect():
        raise ValueError(f"duplicate {key}: {rows[0][0]}")
    plan = allocation(df, wanted, source, stratum).where("given > 0").select(F.col("source").alias("_s"), F.col("stratum").alias("_t"), F.col("given").alias("_given"))
    ranked = df.withColumn("rank", T.hash_rank(seed, F.col(source), F.col(stratum), F.col(key)))
    ranked = ranked.join(plan, F.col(source).eqNullSafe(F.col("_s")) & F.col(stratum).eqNullSafe(F.col("_t")))
    return place_by_hash(ranked, [source, stratum], F.col("rank"), key, F.col("_given")).where("_r <= _given").drop("_s", "_t", "_given", "_r")


def select_frozen(df: DataFrame, index: DataFrame, key: str = "sample_id") -> DataFrame:
    """The rows that an index names, with its ordinal and in its order.  A row that is not there is an error."""
    from optika.operators.indexes import require_partners

    return require_partners(index.select(key, "ordinal"), df, [key], "frozen rows").orderBy("ordinal")


def label_reservoir(df: DataFrame, label: str, key: str, cap: int, seed: int) -> DataFrame:
    """At most ``cap`` rows of each label, uniformly by hash rank."""
    return place_by_hash(df, [label], T.hash_rank(seed, F.col(key)), key, cap).where(F.col("_r") <= cap).drop("_r")


def balanced_take(df: DataFrame, label: str, key: str, wanted: int, seed: int) -> DataFrame:
    """Rows taken from the labels in turn, sorted by label, until ``wanted`` are taken."""
    ranked = place_by_hash(df, [label], T.hash_rank(seed, F.col(key)), key, wanted, "turn").where(F.col("turn") <= wanted)
    return ranked.withColumn("turn", F.col("turn").cast("int")).orderBy("turn", label).limit(wanted)


def stratified_split(df: DataFrame, label: str, key: str, share: float, seed: int) -> DataFrame:
    """Adds split: per label round(n * share) rows of validation, at least 1 from 10 rows on, none below."""
    n = F.col("_n")
    size = F.when(n >= 10, F.greatest(F.lit(1.0), F.bround(n * F.lit(share)))).otherwise(F.lit(0.0))
    sizes = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n")).withColumn("_size", size).drop("_n")
    ranked = place_by_hash(df, [label], T.hash_rank(seed, F.col(key)), key)
    ranked = ranked.join(sizes, F.col(label).eqNullSafe(F.col("_l")))
    return ranked.withColumn("split", F.when(F.col("_r") <= F.col("_size"), "validation").otherwise("train")).drop("_r", "_l", "_size")


def equal_labels(df: DataFrame, label: str, key: str, orderings: int, seed: int) -> DataFrame:
    """Every label kept to the same number of rows, a multiple of ``orderings``; ordering codes assigned in turn."""
    least = df.groupBy(label).count().agg(F.coalesce(F.min("count"), F.lit(0)).alias("n")).first()["n"]
    cap = least // orderings * orderings
    ranked = place_by_hash(df, [label], T.hash_rank(seed, F.col(key)), key, cap).where(F.col("_r") <= cap)
    return ranked.withColumn("ordering", ((F.col("_r") - 1) % orderings).cast("int")).drop("_r")


def seeded_shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    """All rows in the order of a hash of seed and key: the same on every run, a range sort on a cluster."""
    return df.orderBy(T.hash_rank(seed, F.col(key)), key)
