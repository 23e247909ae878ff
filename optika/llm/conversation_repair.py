"""Conversation structure repair by a dynamic program that signatures share along a prefix trie.

A conversation's signature has one symbol for each row: its role (s, u, a or o for another) in upper case where the text
is truncated, or x for a row that must go.  The cheapest edits depend on the signature alone, so that each distinct
signature is solved once.  Sorted signatures are a depth-first walk of their trie: a stack holds one layer of the
program for each symbol of the current path, a signature pops what it does not share with the one before and pushes the
rest, and its end is a terminal node whose answer is read from the stack.

A layer keeps for each state of the grammar ``(s?(ua)+)?`` the least cost, the place of its edits among those of the
other states in ASCII order, and a step back; edit strings themselves are never stored.  Layers stand for the rows read
and end with a row's edit, so that no edit string is the beginning of another and the places decide all ties.

Rows are shuffled by conversation, texts once.  A conversation's edits and its digest are sequential by definition and
pass one task as a stream; what is held of it is its signature and its edits, some dozen bytes a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from optika.llm.common import materialize, small_batches

BLANKS = " \t\n\x0b\x0c\r"
#: What edits cost; a truncated row that stays adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, after s, after u, after a.  An answer may end in the first and the last.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ENDS = (0, 3)
_NAMES = {"u": "user", "a": "assistant"}


def _insertions() -> list[dict[int, int]]:
    """For each state the states that insertions reach, with their least number."""
    out = []
    for p in range(4):
        reach, edge = {p: 0}, [p]
        while edge:
            edge = [q for e in edge for r in "ua" if (q := _NEXT.get((e, r))) is not None and q not in reach and not reach.update({q: reach[e] + 1})]
        out.append(reach)
    return out


_INSERTIONS = _insertions()


@lru_cache(maxsize=None)  # nine symbols
def _moves(symbol: str) -> list[tuple[int, int, int, str]]:
    """(state, state after, cost, edits) of a row: insertions before it, then its own edit."""
    role, more, out = symbol.lower(), TRUNCATED * symbol.isupper(), []
    for p in range(4):
        for q, k in _INSERTIONS[p].items():
            out.append((p, q, INSERT * k + DELETE, "I" * k + "D"))
            if symbol == "x":
                continue
            if (q, role) in _NEXT:
                out.append((p, _NEXT[q, role], INSERT * k + more, "I" * k + "K"))
            out += [(p, _NEXT[q, r], INSERT * k + REROLE + more, "I" * k + "R") for r in "ua" if r != role and (q, r) in _NEXT]
    return out


#: Costs over the least (None where a state can't be reached) and places of the edits.
_FIRST = ((0, 0), None, None, None)


@lru_cache(maxsize=1 << 16)
def _step(layer: tuple, symbol: str) -> tuple[int, tuple, tuple]:
    """The layer after one more row: by how much the least cost rises, the layer, and each state's (state before, edits)."""
    best: list = [None] * 4
    for p, q, cost, edits in _moves(symbol):
        if layer[p] is not None:
            found = (layer[p][0] + cost, layer[p][1], edits, p)
            if best[q] is None or found < best[q]:
                best[q] = found
    least = min(b[0] for b in best if b)
    places = {key: i for i, key in enumerate(sorted({b[1:3] for b in best if b}))}
    return least, tuple(b and (b[0] - least, places[b[1:3]]) for b in best), tuple(b and (b[3], b[2]) for b in best)


class Trie:
    """The path to the current node: signatures must come sorted."""

    def __init__(self):
        self.path, self.layers, self.costs, self.backs = "", [_FIRST], [0], []
        self.computed = 0

    def answer(self, signature: str) -> tuple[int, str]:
        shared = 0
        for x, y in zip(self.path, signature, strict=False):
            if x != y:
                break
            shared += 1
        del self.layers[shared + 1 :], self.costs[shared + 1 :], self.backs[shared:]
        for symbol in signature[shared:]:
            rise, layer, back = _step(self.layers[-1], symbol)
            self.layers.append(layer)
            self.costs.append(self.costs[-1] + rise)
            self.backs.append(back)
        self.path, self.computed = signature, len(signature) - shared
        ends = [(x[0] + INSERT * k, x[1], "I" * k, p) for p, x in enumerate(self.layers[-1]) if x for q, k in _INSERTIONS[p].items() if q in _ENDS]
        cost, _, last, state = min(ends)
        edits = [last]
        for back in reversed(self.backs):
            state, edit = back[state]
            edits.append(edit)
        return self.costs[-1] + cost, "".join(reversed(edits))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for b in batches:
        told, layers = [], []
        for s in b.column(0).to_pylist():
            told.append(trie.answer(s))
            layers.append(trie.computed)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in told], pa.int64()), pa.array([x for _, x in told], pa.string()), pa.array(layers, pa.int64())], names=["signature", "cost", "audit", "layers"])


def solve_signatures(signatures: DataFrame) -> DataFrame:
    """signature, cost, audit, layers of each distinct signature: cheapest edits, of equal ones the ASCII-least; layers
    is how many the signature did not share with the one before.  Ranges of sorted signatures are subtrees of the trie."""
    ranges = signatures.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    return ranges.mapInArrow(_solve, "signature string, cost long, audit string, layers long")


#: The order of rows (nulls come first in an ascending sort).
_PLACE = ["conv_id", "turn", "role", "_hash"]


def _prepared(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with a hash of role and text."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), known("role"), known("text"))
    return out.withColumn("_hash", F.substring(F.sha2(F.concat("role", F.lit("\0"), "text"), 256), 1, 32))


def _structure(rows: DataFrame) -> DataFrame:
    """Counts and signature of each conversation; rows go without their texts."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    light = rows.select("conv_id", "turn", "role", "_hash", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut")).repartition(F.col("conv_id"))
    light = light.withColumn("copy", F.row_number().over(Window.partitionBy("conv_id", "_hash").orderBy("turn")))
    fault = F.when(F.col("blank"), 1).when(F.col("copy") > 1, 2).when(F.col("cut"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    order = Window.partitionBy("conv_id").orderBy(*_PLACE[1:], "copy")
    light = light.withColumn("fault", fault).withColumn("initial", initial)
    symbol = F.when(F.col("fault").isin(1, 2), "x").when(F.col("fault") == 3, F.upper(letter)).otherwise(letter)
    before, turn_before = F.lag("initial").over(order), F.lag("turn").over(order)
    light = light.select(
        "conv_id", "turn", "fault", symbol.alias("symbol"), F.row_number().over(order).alias("n"),
        (before.isNotNull() & ~F.concat(before, "initial").isin("su", "ua", "au")).alias("illegal"), (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(turn_before)).alias("new"),
    )
    count = lambda c: F.count_if(c).cast("long")
    symbols = F.array_sort(F.collect_list(F.struct("n", "symbol")))
    return light.groupBy("conv_id").agg(
        F.coalesce(F.expr("try_subtract(try_add(try_subtract(max(turn), min(turn)), 1L), count_if(new))"), F.lit(0)).cast("long").alias("gaps"),
        count(F.col("fault") == 1).alias("blank"), count(F.col("fault") == 2).alias("duplicate"), count(F.col("fault") == 3).alias("truncated"), count(F.col("illegal")).alias("illegal"),
        F.array_join(F.transform(symbols, lambda x: x["symbol"]), "").alias("signature"),
    )


class _Stream:
    """Rows in the order of _PLACE, each conversation led by its audit, to the rows of the repaired conversation."""

    def __init__(self):
        self.audit, self.at, self.position, self.odd, self.out = "", 0, 0, False, []

    def open(self, audit: str) -> None:
        # what is left of n rows decides their roles: an odd number begins with s
        self.audit, self.at, self.position, self.odd = audit, 0, 0, (len(audit) - audit.count("D")) % 2

    def role(self) -> str:
        return _NAMES["ua"[(self.position - self.odd) % 2]]

    def put(self, conv, edit: str, role: str, text: str) -> None:
        self.out.append((conv, self.position, edit, role, text))
        self.position += 1

    def insertions(self, conv) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.put(conv, "I", self.role(), "")
            self.at += 1

    def row(self, conv, role: str, text: str) -> None:
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.put(conv, edit, role if edit == "K" else self.role(), text)
        self.insertions(conv)


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = _Stream()
    for b in batches:
        for conv, audit, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if audit is not None:
                s.open(audit)
                s.insertions(conv)
            else:
                s.row(conv, role, text)
        if s.out:
            kinds = [b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*s.out, strict=True), kinds, strict=True)], names=["conv_id", "position", "edit", "role", "text"])
            s.out = []


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Finds the cheapest edits that give each conversation (conv_id, turn, role, text) the role initials
    ``(s?(ua)+)?``.

    Returns two tables.  Verdicts, one row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit.  Rows of the repaired conversations: conv_id, position (from 0), edit (K, R or I), role, text; those of a
    conversation come together and in order.

    A row's first fault counts: blank text, duplicate (role and text seen earlier), truncated (the last character that
    is no blank is none of ``.!?``).  A null role or text is one space; null turns come first; rows of equal turn stand by
    role, then by a hash of the text; a null conv_id is a conversation of its own.  Roles are judged by their first
    character.  Rows that repeat are duplicates.  An empty table gives empty tables; other columns are ignored.
    """
    spark = rows.sparkSession
    small_batches(spark)
    rows = _prepared(rows)
    found = materialize(_structure(rows), "conversations")
    answers = solve_signatures(found)
    verdicts = materialize(found.join(answers, "signature").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), "verdicts")
    none = F.lit(None).cast
    lead = verdicts.select("conv_id", "audit", F.lit(0).alias("_side"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("_hash"), none("string").alias("text"))
    body = rows.select("conv_id", none("string").alias("audit"), F.lit(1).alias("_side"), "turn", "role", "_hash", "text")
    dealt = lead.unionByName(body).repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "_side", *_PLACE[1:])
    kind = rows.schema["conv_id"].dataType.simpleString()
    return verdicts, dealt.select("conv_id", "audit", "role", "text").mapInArrow(_rewrite, f"conv_id {kind}, position long, edit string, role string, text string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The query's damage: by crc32 of ``conv_id:turn`` modulo 20 a row is dropped, emptied, loses its sentence ends, is
    repeated, or becomes a user's.  Nulls are one space, in the key too."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    out = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    return out.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select("conv_id", "turn", "role", "text")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's ``role:text`` lines, hashed as they come."""
    conv, h = None, None
    for b in batches:
        done = []
        for k, at, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at == 0:
                if h:
                    done.append((conv, h.hexdigest()))
                conv, h = k, hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(f"{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], b.schema.field(0).type), pa.array([x for _, x in done])], names=["_conv", "repaired_sha256"])
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([conv], b.schema.field(0).type), pa.array([h.hexdigest()])], names=["_conv", "repaired_sha256"])


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Damages all conversations and repairs them: one row for each original conv_id, null among them.  Where no row is
    left, all counts and the cost are 0, the audit is empty and the digest that of the empty string."""
    source = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    verdicts, repaired = repair_conversations(damaged(source))
    kind = source.schema["conv_id"].dataType.simpleString()
    digests = repaired.select("conv_id", "position", "role", "text").mapInArrow(_digests, f"_conv {kind}, repaired_sha256 string")
    verdicts = verdicts.withColumnRenamed("conv_id", "_verdict")
    out = source.select("conv_id").distinct().join(verdicts, F.col("conv_id").eqNullSafe(F.col("_verdict")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
