"""Language identification by multilingual mixture inference.

Training counts letter trigrams of every labelled text by language (hashed into ``2**BITS`` cells, so a language has a
fixed size: 256 KB).  The likelihood of a word in a language is the product of its smoothed trigram probabilities, a word
being a maximal run of letters with a space before and after it.  A document is a mixture: expectation
maximisation estimates each language's proportion from the words' likelihoods.  The set of languages is selected
by penalised likelihood: starting with the best single language, the language that raises the likelihood most is
added as long as the gain exceeds ``penalty`` * ln(words) for its free parameter.  The predicted language is the one
with the largest proportion; the score is that proportion.
"""

from __future__ import annotations

import os
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optika.llm import textkit as tk
from optika.llm.common import discard, materialize, small_batches

BITS = 16
#: A model of up to this many languages (64 MB) is broadcast; a larger one is a file that every executor maps into memory.
BROADCAST_LANGUAGES = 256
_CELLS = 1 << BITS
_MARK = 1 << 31


def _letter_table() -> np.ndarray:
    """Lower-case code point of each letter, and of each mark with the bit _MARK; 0 for anything else."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        kind = unicodedata.category(c)[0]
        if kind in "LM":
            table[i] = ord(c.lower()[0]) | (_MARK if kind == "M" else 0)
    return table


_TABLE: list[np.ndarray] = []


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of each text with 0 for all else, and each text's bounds; a 0 ends every text.

    A mark counts as a letter in a run that holds a letter; a run of marks alone is no word.
    """
    if not _TABLE:
        _TABLE.append(_letter_table())
    texts = column.to_pylist()
    joined = "\x00".join(x or "" for x in texts) + "\x00"
    letters = _TABLE[0][np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")]
    marks = letters >= _MARK
    if marks.any():
        letters[marks] ^= np.uint32(_MARK)
        run = np.cumsum(letters == 0)
        held = np.zeros(run[-1] + 1, bool)
        held[run[(letters > 0) & ~marks]] = True
        letters[~held[run]] = 0
    bounds = np.concatenate(([0], np.cumsum([len(x or "") + 1 for x in texts])))
    return letters.astype(np.uint64), bounds


def _cells(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The trigram cell ending at each position, and whether the position counts: a letter, or the 0 after one."""
    one, two = np.zeros_like(letters), np.zeros_like(letters)
    one[1:], two[2:] = letters[:-1], letters[:-2]
    two[one == 0] = 0
    cell = (letters * np.uint64(0x9E3779B1) + one * np.uint64(0x85EBCA77C2B2AE63) + two * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9FB21C651E98DF25)
    return (cell >> np.uint64(64 - BITS)).astype(np.int64), (letters > 0) | (one > 0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for c in tk.chunks(batches, "text", 1 << 20):
        letters, bounds = _letters(c.column(1))
        cell, counted = _cells(letters)
        for lang, rows in _by_value(c.column(0).to_pylist()).items():
            pick = np.zeros(c.num_rows, bool)
            pick[rows] = True
            got = np.bincount(cell[counted & np.repeat(pick, np.diff(bounds))], minlength=_CELLS)
            total[lang] = total.get(lang, 0) + got
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "cell", "n"])


def _by_value(values: list) -> dict:
    out: dict = {}
    for i, x in enumerate(values):
        out.setdefault(x, []).append(i)
    return out


class LanguageModel:
    """Languages and, per language, the log probability of each trigram cell: an array, or the name of a file that
    Spark has sent to the executors."""

    def __init__(self, langs: list[str], logs: np.ndarray | str):
        self.langs = langs
        if isinstance(logs, str):
            from pyspark import SparkFiles

            logs = np.load(SparkFiles.get(logs), mmap_mode="r")
        self.logs = logs


def _packed(table: pa.Table) -> pa.Table:
    """A language's counts as one binary array."""
    n = np.zeros(_CELLS, np.int64)
    n[table["cell"].to_numpy()] = table["n"].to_numpy()
    return pa.table({"lang": table["lang"][:1], "counts": pa.array([n.tobytes()], pa.binary())})


def learn(docs: DataFrame, smoothing: float = 0.5, broadcast: int = BROADCAST_LANGUAGES) -> tuple[list[str], np.ndarray | str]:
    """Learns from every row of docs (text, lang) whose text and lang are not null: the languages in order, and their
    table (see ``LanguageModel``).  A language costs the driver one row of 512 KB, read one at a time."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    table = rows.mapInArrow(_count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    table = materialize(table.groupBy("lang").applyInArrow(_packed, "lang string, counts binary"), "languages")
    langs = sorted(r["lang"] for r in table.select("lang").collect())
    shape = (len(langs), _CELLS)
    if len(langs) <= broadcast:
        logs = np.zeros(shape, np.float32)
    else:
        path = os.path.join(tempfile.mkdtemp(prefix="optika-"), f"languages-{uuid.uuid4().hex}.npy")
        logs = np.lib.format.open_memmap(path, "w+", np.float32, shape)
    at = {x: i for i, x in enumerate(langs)}
    for r in table.toLocalIterator():
        n = np.frombuffer(r["counts"], np.int64) + smoothing
        logs[at[r["lang"]]] = np.log(n / n.sum())
    discard(table)
    if len(langs) <= broadcast:
        return langs, logs
    logs.flush()
    spark.sparkContext.addFile(path)
    return langs, os.path.basename(path)


def _mixture(e: np.ndarray, top: np.ndarray, starts: np.ndarray, doc: np.ndarray, use: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for all documents at once.  e: word likelihoods (words x languages) over their maximum, whose logarithm
    is top; use: languages in each document's set.  Proportions and log-likelihoods."""
    n = np.diff(np.append(starts, len(e)))[:, None]
    pi = use / use.sum(1, keepdims=True)
    for _ in range(rounds):
        r = e * pi[doc]
        r /= np.maximum(r.sum(1, keepdims=True), 1e-30)
        pi = np.add.reduceat(r, starts, axis=0) / n
    like = np.log(np.maximum((e * pi[doc]).sum(1), 1e-30)) + top
    return pi, np.add.reduceat(like, starts)


def infer(column: pa.Array, model: LanguageModel, penalty: float = 3.0, rounds: int = 12) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and number of words of each text."""
    letters, bounds = _letters(column)
    cell, counted = _cells(letters)
    ends = np.flatnonzero((letters[1:] == 0) & (letters[:-1] > 0)) + 1 if len(letters) > 1 else np.zeros(0, np.int64)
    n_texts, k = len(bounds) - 1, len(model.langs)
    lang, score = ["und"] * n_texts, np.zeros(n_texts)
    doc_of = np.searchsorted(bounds, ends, "right") - 1
    words = np.bincount(doc_of, minlength=n_texts)
    full = np.flatnonzero(words)
    if not len(full) or not k:
        return lang, score, words
    # a word's likelihood: sum over its letters and its end
    first = np.concatenate(([0], ends[:-1] + 1))
    logs = np.stack([np.add.reduceat(np.where(counted, model.logs[i][cell], 0).astype(np.float64), first)[: len(ends)] for i in range(k)], 1)
    top = logs.max(1)
    e = np.exp(logs - top[:, None])
    starts = np.concatenate(([0], np.cumsum(words[full])[:-1]))
    doc = np.repeat(np.arange(len(full)), words[full])
    single = np.add.reduceat(logs, starts, axis=0)
    best = single.argmax(1)
    rows = np.arange(len(full))
    use = np.zeros((len(full), k))
    use[rows, best] = 1
    like, pi = single[rows, best], use.copy()
    cost = penalty * np.log(words[full])
    # forward selection: documents whose full mixture does not pay for one more language are settled at once
    _, upper = _mixture(e, top, starts, doc, np.ones((len(full), k)), rounds) if k > 1 else (use, like)
    open_ = np.flatnonzero(upper - like > cost)
    while len(open_):
        pick = np.isin(doc, open_)
        sub_doc = np.searchsorted(open_, doc[pick])
        sub_starts = np.flatnonzero(np.concatenate(([True], sub_doc[1:] != sub_doc[:-1])))
        # every language is tried beside those that a document has; the one that raises its likelihood most is added
        new, got, tried = like[open_].copy(), pi[open_].copy(), use[open_].copy()
        for i in range(k):
            more = use[open_].copy()
            more[:, i] = 1
            share, value = _mixture(e[pick], top[pick], sub_starts, sub_doc, more, rounds)
            higher = (value > new) & (use[open_, i] == 0)
            new[higher], got[higher], tried[higher] = value[higher], share[higher], more[higher]
        better = new - like[open_] > cost[open_]
        take = open_[better]
        use[take], pi[take], like[take] = tried[better], got[better], new[better]
        open_ = take[(use[take].sum(1) < k)]
    at = pi.argmax(1)
    for i, d in enumerate(full):
        lang[d] = model.langs[at[i]]
    score[full] = np.clip(pi[rows, at], 0, 1)
    return lang, score, words


def with_language(docs: DataFrame, model: tuple[list[str], np.ndarray | str], penalty: float = 3.0) -> DataFrame:
    """Adds lang_pred and score to the rows of docs (text and any other columns).

    A null text, or one without a letter, is ``und`` with score 0, as is every text if nothing was learned.  Ties go
    to the smaller language code.  Only the text is read.  An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    # the likelihoods of a chunk's words take memory for every language
    most = max(1 << 12, (1 << 20) * 32 // max(32, len(model[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        for c in tk.chunks(batches, "text", most):
            lang, score, _ = infer(c.column(names.index("text")), own, penalty)
            yield pa.RecordBatch.from_arrays([*c.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray | str], penalty: float = 3.0) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs (doc_id, text), as ``with_language`` gives them."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_language(own, model, penalty).drop("text")


def held_out():
    """Documents whose crc32 of the doc_id as text leaves 1 at division by 3; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
