"""Language-model scoring with a weighted backoff automaton.

States are the contexts of up to ``order - 1`` tokens seen in training, and the empty one.  In state h a word w has an
arc if h w was seen; its weight is log10 P(w | h), smoothed by the state of h's suffix h':

    P(w | h) = (c(h w) + mu P(w | h')) / (c(h) + mu)

Otherwise the failure arc of h, of weight log10(mu / (c(h) + mu)), leads to h'.  In the empty state every word has an
arc; its distribution is absolutely discounted, the discounted mass being that of one unknown word.  A text is
traversed from left to right, from the start state through its words to the end token, each arc leading to the longest
suffix that is a state; weights are added up.

The automaton of a large corpus has no bounded size, so it is never in one place.  Each chunk of texts asks for the
states and arcs that it needs.  An n-gram that no other chunk holds has the chunk's own count; so chunks first send short
keys of their n-grams to shards by key, and a shard answers with a bit for each: whether another chunk sent the key too.
Only n-grams of such keys are then sent with their whole 64-bit hashes and training counts; a shard adds the counts up
and answers each chunk, and a chunk builds its part of the automaton and traverses its texts.  Keys decide what is sent,
never a count: where two n-grams share a key, both are sent.  What is sent grows with the corpus, and a frequent n-gram
costs a shard one entry per chunk.  The number of shards follows from the size of the texts, so that a shard fits in a
task whatever the session's partitions are.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optika.llm import textkit as tk
from optika.llm.common import materialize, release_shuffles, shuffle_partitions, small_batches

ORDER = 4
#: Dirichlet weights of the contexts of 1, 2, ... tokens.
MU = (100.0, 30.0, 10.0)
CHUNK_BYTES, SHARD_BYTES = 4 << 20, 16 << 20
#: Keys have this many bits more than the size of all texts, so that few n-grams of one chunk share theirs with another's.
KEY_BITS, LEAST_KEY_BITS = 4, 24
_U = np.uint64
END, START = _U(0x1D8E4E27C47D124F), _U(0x7A5F9B3C2E1D4C6B)
_REQUEST = "chunk long, shard int, check long, grams binary"
_SHARED = "chunk long, shard int, check long, shared binary"
_ANSWER = "chunk long, shard int, check long, counts binary, tokens long, types long, once long, twice long"


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of each text (its words, then the end) and the bounds."""
    w = tk.words(column, lower=True)
    bounds = np.concatenate(([0], np.cumsum(w.counts() + 1)))
    token = np.full(bounds[-1], END)
    inside = np.ones(bounds[-1], bool)
    inside[bounds[1:] - 1] = False
    token[inside] = w.hashes()
    return token, bounds


class Grams:
    """The n-grams of a chunk: for each length the distinct hashes, sorted, and which of them ends at each token (-1
    where the text's start is nearer).  The start counts as one token."""

    def __init__(self, token: np.ndarray, bounds: np.ndarray, order: int):
        place = self.place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))
        self.distinct, self.at = [], []
        h, before = token, token
        for k in range(1, order + 1):
            if k > 1:
                before = np.concatenate(([START], before[:-1]))
                before[place == k - 2] = START
                h = tk.mix(h * _U(0x9E3779B97F4A7C15) + before + _U(k))
            there = place >= k - 2
            distinct, at = np.unique(h[there], return_inverse=True)
            self.distinct.append(distinct)
            self.at.append(np.full(len(token), -1))
            self.at[-1][there] = at

    def keys(self, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each length from 2 the distinct keys (leading bits of hashes), sorted, and the key of each n-gram."""
        found = [np.unique(x >> _U(64 - bits), return_inverse=True) for x in self.distinct[1:]]
        return [x for x, _ in found], [at for _, at in found]

    def own(self, train: np.ndarray) -> list[np.ndarray]:
        """How often each n-gram ends at a token of a training text of the chunk."""
        return [np.bincount(at[train & (at >= 0)], minlength=len(x)) for x, at in zip(self.distinct, self.at, strict=True)]


def _pack(x: np.ndarray) -> bytes:
    """Unsigned numbers in as many bytes each as the largest needs, stored by byte planes."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return struct.pack("<IB", len(x), width) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpack(raw: bytes, at: int) -> tuple[np.ndarray, int]:
    n, width = struct.unpack_from("<IB", raw, at)
    at += 5
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return out.reshape(-1).view("<u8"), at + n * width


def _shard_bounds(x: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """Shards are equal ranges of the sorted hashes."""
    if shards == 1:
        return np.array([0, len(x)])
    lows = np.arange(1, shards, dtype=np.uint64) << _U(bits - (shards - 1).bit_length())
    return np.concatenate(([0], np.searchsorted(x, lows), [len(x)]))


def _check(parts: list[np.ndarray]) -> int:
    """A sum over a request by which the answer is matched to it."""
    total = _U(0)
    for x in parts:
        total ^= x.sum(dtype=np.uint64) + _U(len(x))
    return int(total.view(np.int64))


def _chunk_ids(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Chunks with an id that a second reading of the same input gives again."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 32
    for c in tk.chunks(batches, "text", most):
        yield at, c
        at += 1


def _sent(chunk: int, shards: int, lists: list[np.ndarray], bits: list[int], more: list[np.ndarray] | None = None) -> dict:
    """Rows of sorted numbers (and numbers that go with them), dealt to shards."""
    edges = [_shard_bounds(x, shards, n) for x, n in zip(lists, bits, strict=True)]
    out: dict[str, list] = {"chunk": [], "shard": [], "check": [], "grams": []}
    packer = zstandard.ZstdCompressor(level=1)
    for s in range(shards):
        parts = [x[e[s] : e[s + 1]] for x, e in zip(lists, edges, strict=True)]
        if any(map(len, parts)):
            blob = [_pack(np.diff(x, prepend=_U(0))) for x in parts]
            if more:
                blob = [y for x, n, e in zip(blob, more, edges, strict=True) for y in (x, _pack(n[e[s] : e[s + 1]].astype(np.uint64)))]
            # byte planes of differences are unevenly filled, which entropy coding uses and the shuffle's codec does not
            for col, x in zip(out.values(), (chunk, s, _check(parts), packer.compress(b"".join(blob))), strict=True):
                col.append(x)
    return out


def _opened(column: pa.ChunkedArray) -> list[bytes]:
    reader = zstandard.ZstdDecompressor()
    return [reader.decompress(x.as_py()) for x in column]


_SENT = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("check", pa.int64()), ("grams", pa.binary())])


def _ask_keys(shards: int, order: int, bits: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, c in _chunk_ids(batches, most):
            keys, _ = Grams(*_tokens(c.column(2)), order).keys(bits)
            yield pa.RecordBatch.from_pydict(_sent(chunk, shards, keys, [bits] * len(keys)), _SENT)

    return run


def _answer_keys(order: int):
    def run(table: pa.Table) -> pa.Table:
        """Which keys of a shard several chunks sent; a bit for each."""
        raw = _opened(table["grams"])
        spots, blobs = [0] * len(raw), [[] for _ in raw]
        for _ in range(order - 1):
            keys = []
            for i, x in enumerate(raw):
                d, spots[i] = _unpack(x, spots[i])
                keys.append(np.cumsum(d, dtype=np.uint64))
            _, at, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            several, end = n[at] > 1, 0
            for i, x in enumerate(keys):
                blobs[i].append(struct.pack("<I", len(x)) + np.packbits(several[end : end + len(x)]).tobytes())
                end += len(x)
        return pa.table({"chunk": table["chunk"], "shard": table["shard"], "check": table["check"], "shared": pa.array([b"".join(x) for x in blobs], pa.binary())})

    return run


def _shared(grams: Grams, table: pa.Table, bits: int) -> list[np.ndarray]:
    """The n-grams that are sent: all words, and of longer ones those whose key is another chunk's too."""
    keys, at = grams.keys(bits)
    found: list[list[np.ndarray]] = [[] for _ in keys]
    ends = [0] * len(keys)
    for raw, check in zip(table["shared"].to_pylist(), table["check"].to_pylist(), strict=True):
        spot, parts = 0, []
        for k, x in enumerate(keys):
            (n,) = struct.unpack_from("<I", raw, spot)
            size = (n + 7) // 8
            found[k].append(np.unpackbits(np.frombuffer(raw, np.uint8, size, spot + 4), count=n).astype(bool))
            parts.append(x[ends[k] : ends[k] + n])
            ends[k], spot = ends[k] + n, spot + 4 + size
        _same(check == _check(parts))
    _same(ends == [len(x) for x in keys])
    return [np.ones(len(grams.distinct[0]), bool), *(np.concatenate(x)[i] if x else np.zeros(0, bool) for x, i in zip(found, at, strict=True))]


def _same(ok: bool) -> None:
    if not ok:
        raise RuntimeError("the input's partitions changed between two readings")


def _chunk(docs: pa.Table, order: int) -> tuple[pa.Table, Grams, np.ndarray, np.ndarray]:
    """A chunk's rows in order, its n-grams, bounds of texts, and which tokens are of training texts."""
    docs = docs.sort_by("row").combine_chunks()
    token, bounds = _tokens(docs["text"])
    train = ~docs["held_out"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    return docs, Grams(token, bounds, order), bounds, np.repeat(train, np.diff(bounds))


def _ask(shards: int, order: int, bits: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _SENT.empty_table()
        _, grams, _, train = _chunk(docs, order)
        sent = _shared(grams, told.sort_by("shard"), bits)
        lists, counts = ([x[m] for x, m in zip(xs, sent, strict=True)] for xs in (grams.distinct, grams.own(train)))
        return pa.Table.from_pydict(_sent(docs["chunk"][0].as_py(), shards, lists, [64] * order, counts), _SENT)

    return run


def _answer(order: int):
    def run(table: pa.Table) -> pa.Table:
        """Adds the counts of a shard up and answers every chunk that asked."""
        raw = _opened(table["grams"])
        spots, blobs, stats = [0] * len(raw), [[] for _ in raw], np.zeros(4, np.int64)
        for k in range(order):
            hashes, counts = [], []
            for i, x in enumerate(raw):
                d, spots[i] = _unpack(x, spots[i])
                n, spots[i] = _unpack(x, spots[i])
                hashes.append(np.cumsum(d, dtype=np.uint64))
                counts.append(n)
            distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
            total = np.bincount(at, np.concatenate(counts).astype(np.float64), len(distinct)).astype(np.uint64)
            if k == 0:
                stats[:] = total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()
            own, end = total[at], 0
            for i, x in enumerate(hashes):
                blobs[i].append(_pack(own[end : end + len(x)]))
                end += len(x)
        first = np.zeros((4, len(raw)), np.int64)
        first[:, 0] = stats
        got = {"chunk": table["chunk"], "shard": table["shard"], "check": table["check"], "counts": pa.array([b"".join(x) for x in blobs], pa.binary())}
        return pa.table(got | dict(zip(("tokens", "types", "once", "twice"), map(pa.array, first), strict=True)))

    return run


class Weights:
    """The corpus constants of the automaton."""

    def __init__(self, tokens: int, types: int, once: int, twice: int, mu: tuple[float, ...] = MU):
        self.tokens, self.types, self.mu = tokens, types, mu
        self.discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + self.types + 1))

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """The distribution of the empty state."""
        if not self.tokens:
            return np.ones(len(c))
        return np.where(c > 0, c - self.discount, self.discount * self.types) / self.tokens


class Automaton:
    """The states and arcs of the backoff automaton that a chunk's texts can use.

    ``counts[k]`` counts the chunk's distinct n-grams of k + 1 tokens in training.  Seen n-grams are states, and arcs
    from the state of all their tokens but the last: ``arc[k]`` are the weights of the arcs from states of k tokens,
    ``seen[k]`` how often such a state occurs (0: it is none) and ``failure[k]`` the weight of its failure arc, each by
    the n-gram that is read in it.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], weights: Weights):
        self.grams, self.counts = grams, counts
        starts = counts[0][np.searchsorted(grams.distinct[0], END)]  # every training text has one end and one start
        p = weights.unigram(counts[0])
        self.arc, self.seen, self.failure = [np.log10(p)], [None], [None]
        for k in range(1, len(counts)):
            there = np.flatnonzero(grams.at[k] >= 0)
            gram, mu = grams.at[k][there], weights.mu[k - 1]
            suffix, seen = np.zeros(len(counts[k]), np.int64), np.zeros(len(counts[k]))
            suffix[gram] = grams.at[k - 1][there]
            # the state before a token is the n-gram that ends at the token before, or the start
            state = counts[k - 1][grams.at[k - 1][there - 1]].astype(np.float64)
            if k == 1:
                state[grams.place[there] == 0] = starts
            seen[gram] = state
            p = (counts[k] + mu * p[suffix]) / (seen + mu)
            self.arc.append(np.log10(p))
            self.seen.append(seen)
            self.failure.append(np.log10(mu / (seen + mu)))

    def traverse(self) -> np.ndarray:
        """The weight of each token's step: failure arcs from the state that the tokens before lead to, until a state
        has an arc for the token.  That state depends on the last tokens only, so all texts are traversed at once."""
        out = np.zeros(len(self.grams.place))
        going = np.ones(len(out), bool)
        for k in range(len(self.counts) - 1, 0, -1):
            rows = np.flatnonzero(going & (self.grams.at[k] >= 0))
            gram = self.grams.at[k][rows]
            state, arc = self.seen[k][gram] > 0, self.counts[k][gram] > 0
            out[rows[arc]] += self.arc[k][gram[arc]]
            going[rows[arc]] = False
            fails = state & ~arc
            out[rows[fails]] += self.failure[k][gram[fails]]
        out[going] += self.arc[0][self.grams.at[0][going]]
        return out


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _traverse(weights: Weights, order: int, bits: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _OUT.empty_table()
        docs, grams, bounds, train = _chunk(docs, order)
        told = told.sort_by("shard")
        sent = _shared(grams, told.filter(pa.compute.is_valid(told["shared"])), bits)
        lists, counts = [x[m] for x, m in zip(grams.distinct, sent, strict=True)], grams.own(train)
        answers = told.filter(pa.compute.is_valid(told["counts"]))
        found: list[list[np.ndarray]] = [[] for _ in range(order)]
        ends = [0] * order
        for raw, check in zip(answers["counts"].to_pylist(), answers["check"].to_pylist(), strict=True):
            spot, parts = 0, []
            for k in range(order):
                n, spot = _unpack(raw, spot)
                found[k].append(n)
                parts.append(lists[k][ends[k] : ends[k] + len(n)])
                ends[k] += len(n)
            _same(check == _check(parts))
        _same(ends == [len(x) for x in lists])
        for k in range(order):
            counts[k][sent[k]] = np.concatenate(found[k]).astype(np.int64)
        word = counts[0][grams.at[0]]
        steps = Automaton(grams, counts, weights).traverse()
        sums = [np.add.reduceat(x, bounds[:-1]) for x in (weights.base(word), steps, (word > 0).astype(np.int64))]
        cols = [docs["doc_id"], docs["held_out"], pa.array(np.diff(bounds)), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1])]
        return pa.table(cols, schema=_OUT)

    return run


def _tag(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, c in _chunk_ids(batches, most):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(c.num_rows, chunk)), pa.array(np.arange(c.num_rows)), *c.columns], names=["chunk", "row", *c.schema.names])

    return run


def score(docs: DataFrame, order: int = ORDER, mu: tuple[float, ...] = MU, stable: bool = False, chunk_bytes: int = CHUNK_BYTES, key_bits: int | None = None) -> DataFrame:
    """Scores all rows of docs (doc_id, text, held_out), learning from those that are not held out.

    The rows are read three times and must be the same in the same partitions each time; unless ``stable`` says that docs
    reads a table as it stands, they are written to one first.  A change is detected and fails the job.  ``chunk_bytes``
    and ``key_bits`` change what is sent, not the scores.  Returns doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score, score.  A null or empty text is the end token alone; repeated
    rows are scored each; with nothing to learn from, base_score is 0 and score 0 for each token; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("held_out"), F.lit(True)).alias("held_out"), F.col("text").cast("string").alias("text"))
    if not stable:
        own = materialize(own, "texts")
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    # a power of two, so that a shard is a range of leading bits
    shards = 1 << max(2, (2 * shuffle_partitions(spark) - 1).bit_length(), (size // SHARD_BYTES).bit_length())
    bits = key_bits or min(64, max(LEAST_KEY_BITS, int(size).bit_length() + KEY_BITS))
    shards = min(shards, 1 << bits)
    tagged = own.mapInArrow(_tag(chunk_bytes), "chunk long, row long, doc_id long, held_out boolean, text string")
    shared = materialize(own.mapInArrow(_ask_keys(shards, order, bits, chunk_bytes), _REQUEST).groupBy("shard").applyInArrow(_answer_keys(order), _SHARED), "shared")
    release_shuffles(spark, 2)
    asked = tagged.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_ask(shards, order, bits), _REQUEST)
    answers = materialize(asked.groupBy("shard").applyInArrow(_answer(order), _ANSWER), "answers")
    release_shuffles(spark, 2)
    n = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "once", "twice"))).first()
    weights = Weights(*n, mu)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    none = F.lit(None).cast("binary")
    told = answers.select("chunk", "shard", "check", "counts", none.alias("shared")).unionByName(shared.select("chunk", "shard", "check", none.alias("counts"), "shared"))
    scored = tagged.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_traverse(weights, order, bits), out)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n["tokens"])).cast("long").alias("train_tokens"), "base_score", "score")


def held_out():
    """Documents whose crc32 of the doc_id as text leaves 2 at division by 7; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(True))


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out()), stable=True)
