"""Packing token sequences by Karmarkar-Karp multiway differencing.

Each document's ids (with the closing id 0) are cut into pieces: whole windows of ``capacity`` first, then its
tail, whole if it has at most ``piece`` tokens, else cut there (whole tails of up to 1023 tokens would leave 7 % of the
windows empty, halves leave 1 %).  Whole windows are sequences of their own.  Tail pieces are dealt out
by hash and packed in lots of ``lot`` pieces: with m windows, every piece is a partial partition (its length and
m - 1 zeros); the two partial partitions with the greatest imbalance are merged, the largest window of one with
the smallest of the other, until one is left.  Its m windows are nearly equal; m starts at the least number that
could hold the lot and rises by one as long as a window exceeds the capacity.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optika.llm import textkit as tk
from optika.llm.common import shuffle_partitions, small_batches

CAPACITY, PIECE, LOT, END = 1024, 512, 1024, 0
#: The vocabulary's added token, which the rank file lacks.
SPECIAL = {"<|endoftext|>": 50256}
#: Blanks in a row that the rank file's encoder may not survive (its regular expression runs out of stack between
#: 700,000 and 1,000,000); a text with as many goes to the tokenizers file, which gives the same ids.
BLANKS = 100_000
_BLANKS = re.compile(r"\s{%d}" % BLANKS)
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

_ENCODERS: dict[str, object] = {}


def encoder(path: str | None = None):
    """Texts to lists of ids in the vocabulary byte_bpe_50k, as ``Tokenizer.encode(text, add_special_tokens=False)``
    gives them: a literal <|endoftext|> is the id 50256.

    ``path`` may name a tokenizers JSON file.  By default the same vocabulary is read from its rank file, whose
    encoder gives the same ids several times faster (the tests compare the two).
    """
    key = path or ""
    if key not in _ENCODERS:
        if path:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            _ENCODERS[key] = lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
        else:
            import public_tokenizers as P
            import tiktoken

            with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            e = tiktoken.Encoding("byte_bpe_50k", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

            def ids(text: str) -> list[int]:
                if len(text) >= BLANKS and _BLANKS.search(text):
                    return encoder(P.path("byte_bpe_50k.json"))([text])[0]
                return e.encode(text, allowed_special="all")

            _ENCODERS[key] = lambda texts: [ids(x) for x in texts]
    return _ENCODERS[key]


def _cut(capacity: int, piece: int, tokenizer: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for c in tk.chunks(batches, "text", 1 << 20):
            cols: list[list] = [[], [], [], [], []]
            for doc, ids in zip(c.column(0).to_pylist(), encode([x or "" for x in c.column(1).to_pylist()]), strict=True):
                a = np.array([*ids, END], dtype="<u4")
                whole = len(a) // capacity * capacity
                at = [*range(0, whole, capacity), *range(whole, len(a), piece), len(a)]
                for s, e in zip(at[:-1], at[1:], strict=True):
                    for col, x in zip(cols, (doc, s, e - s, zlib.crc32(a[s:e].tobytes()), len(a)), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def differencing(sizes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp partition of ``sizes`` into m windows: the window of each item, and the windows' sums."""
    n = len(sizes)
    if m == 1 or n == 1:
        return np.zeros(n, np.int64), np.bincount(np.zeros(n, np.int64), sizes, m).astype(np.int64)
    # a partial partition keeps only its windows above the least one, largest first, as (excess, tag)
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    excess = {i: np.array([s], np.int64) for i, s in enumerate(sizes)}
    # slots: ids of the non-zero windows; a merge joins slots of its two parts
    merges: list[tuple] = []
    fresh = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = excess.pop(a), excess.pop(b)
        p, q = len(x), len(y)
        # window i of a (largest first) meets window m - 1 - i of b: overlap only where both are non-zero
        both = np.zeros(min(m, p + q), np.int64)
        pos_a = np.arange(p)
        both[:p] += x
        pos_b = (m - 1 - np.arange(q)) if p + q > m else (p + np.arange(q))
        np.add.at(both, pos_b, y)
        order = np.argsort(-both, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        new = both[order]
        if len(new) == m:
            new = new - new[-1]
        merges.append((fresh, a, b, rank[pos_a], rank[pos_b]))
        excess[fresh] = new
        heapq.heappush(heap, (-int(new[0] - (new[-1] if len(new) == m else 0)), fresh))
        fresh += 1
    labels = {heap[0][1]: np.arange(m)}
    window = np.zeros(n, np.int64)
    for node, a, b, ra, rb in reversed(merges):
        own = labels.pop(node)
        for child, r in ((a, ra), (b, rb)):
            if child < n:
                window[child] = own[r[0]]
                continue
            # the child's windows beyond its non-zero ones take the labels that are left
            lab = np.full(m, -1)
            lab[: len(r)] = own[r]
            free = np.ones(m, bool)
            free[own[r]] = False
            lab[len(r) :] = np.flatnonzero(free)[: m - len(r)]
            labels[child] = lab
    return window, np.bincount(window, sizes, m).astype(np.int64)


def pack_lot(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, no window above the capacity."""
    m = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, load = differencing(sizes, m)
        if load.max() <= capacity:
            return window
        m += 1


def _pack(capacity: int, lot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, used = TaskContext.get().partitionId() << 40, 0

        def done(rows: pa.Table, seq: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
            out = rows.append_column("sequence_id", pa.array(seq + base)).append_column("offset", pa.array(offset))
            return out.combine_chunks().to_batches()[0]

        def packed(rows: pa.Table) -> pa.RecordBatch:
            nonlocal used
            size = rows["length"].to_numpy()
            window = pack_lot(size, capacity)
            _, window = np.unique(window, return_inverse=True)
            order = np.argsort(window, kind="stable")
            before = np.cumsum(size[order]) - size[order]
            first = np.concatenate(([True], window[order][1:] != window[order][:-1]))
            offset = before - before[np.flatnonzero(first)[np.cumsum(first) - 1]]
            out = done(rows.take(pa.array(order)), window[order] + used, offset)
            used += int(window.max()) + 1
            return out

        held: list[pa.Table] = []
        for batch in batches:
            full = batch.column(2).to_numpy() == capacity
            if n := int(full.sum()):
                yield done(pa.Table.from_batches([batch.filter(pa.array(full))]), np.arange(n) + used, np.zeros(n, np.int64))
                used += n
            held.append(pa.Table.from_batches([batch.filter(pa.array(~full))]))
            while sum(t.num_rows for t in held) >= 2 * lot:
                rows = pa.concat_tables(held)
                yield packed(rows.slice(0, lot))
                held = [rows.slice(lot)]
        rest = pa.concat_tables(held) if held else None
        if rest is not None and rest.num_rows:
            yield packed(rest)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, piece: int = PIECE, lot: int = LOT, tokenizer: str | None = None) -> DataFrame:
    """Packs every document (doc_id, text; null text: empty) into sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  Every document
    has at least its closing id.  A null doc_id stays null; rows that repeat a document are packed again; an
    empty table gives an empty result.  Reruns over the same table agree.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(spark)
    # few documents in many parts would leave a part-filled window in each
    n = own.count()
    parts = max(1, min(shuffle_partitions(spark), n // 1000))
    pieces = own.mapInArrow(_cut(capacity, piece, tokenizer), _PIECES)
    dealt = pieces.repartition(parts, F.xxhash64("doc_id", "start", "ids_crc32")).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "start", "ids_crc32")
    return dealt.mapInArrow(_pack(capacity, lot), _PIECES + ", sequence_id long, offset long")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
