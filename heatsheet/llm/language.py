"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every character that is no letter becomes a space, and 1-, 2- and 3-grams
that are not all spaces are hashed into ``SIZE`` bins. Counting covers all documents that may
teach; the matrix of log-probabilities has ``SIZE`` values for each language, which bounds
what is broadcast. A text's score is the sparse product of its counts with that matrix plus
the languages' share of documents.

``lang_pred`` is ``und`` with score 0 for a text that is NULL or has no letter, and when nothing
was learnt; else the likeliest language with its probability. Ties go to the language first in
order. Rows with a NULL language teach nothing.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatsheet.llm import common
from heatsheet.llm.quality import held_out

BITS = 16
SIZE = 1 << BITS
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
SLICE_CHARS = 1 << 20
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    low, held, size = 0, [], 0
    for i, text in enumerate(column.to_pylist()):
        held.append((text or "").lower())
        size += len(held[-1])
        if size >= SLICE_CHARS:
            yield low, held
            low, held, size = i + 1, [], 0
    if held:
        yield low, held


def grams(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For every order the bins of all n-grams and the offsets of every text's; which texts
    have a letter."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    code = np.frombuffer(
        "".join(f" {t} " for t in texts).encode("utf-32-le", "replace"), np.uint32
    )
    letter = _letters()[code]
    code = np.where(letter, code, 32).astype(np.uint64)
    ends = np.cumsum(sizes)
    lettered = np.add.reduceat(letter, ends - sizes) > 0 if len(texts) else np.empty(0, bool)
    out = []
    for order in ORDERS:
        n = max(len(code) - order + 1, 0)
        h, some = np.full(n, order, np.uint64), np.zeros(n, bool)
        for i in range(order):
            h = (h + code[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            some |= letter[i : i + n]
        for i in range(1, order):
            some[ends[:-1] - i] = False
        at = np.flatnonzero(some)
        out.append(((h[at] >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(at, np.append(0, ends))))
    return out, lettered


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict = defaultdict(lambda: np.zeros(SIZE + 1, np.int64))  # the last counts texts
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for low, texts in _slices(batch.column("text")):
            names, codes = np.unique(langs[low : low + len(texts)].astype(str), return_inverse=True)
            found, lettered = grams(texts)
            table = np.zeros((len(names), SIZE + 1), np.int64)
            for bins, at in found:
                row = np.repeat(codes, np.diff(at))
                table[:, :SIZE] += np.bincount(row * SIZE + bins, minlength=len(names) * SIZE).reshape(-1, SIZE)
            table[:, SIZE] = np.bincount(codes, lettered, minlength=len(names))
            for name, row in zip(names.tolist(), table):
                counts[name] += row
    for name, row in counts.items():
        at = np.flatnonzero(row)
        yield common.batch(lang=pa.array([name] * len(at)), bin=at.astype(np.int32), n=row[at])


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and for each the log-probability of every bin and, last, of the
    language itself."""
    teach = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col("lang").cast("string").alias("lang"),
    )
    found = (
        teach.mapInArrow(_count, "lang string, bin int, n long")
        .groupBy("lang", "bin")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    names = sorted(found["lang"].unique())
    table = np.zeros((len(names), SIZE + 1))
    table[np.searchsorted(names, found["lang"]), found["bin"]] = found["n"]
    bins, share = table[:, :SIZE] + SMOOTHING, table[:, SIZE:] + SMOOTHING
    bins, share = bins / bins.sum(axis=1, keepdims=True), share / share.sum() if len(names) else share
    return names, np.log(np.concatenate([bins, share], axis=1)).astype(np.float32)


def predict(docs: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        logs, pred, score = shared.value, [], []
        for low, texts in _slices(batch.column("text")):
            found, lettered = grams(texts)
            total = np.zeros((len(names), len(texts)))
            for k in range(len(names)):
                total[k] = logs[k, SIZE]
                for bins, at in found:
                    sums = np.concatenate([[0.0], np.cumsum(logs[k][bins], dtype=np.float64)])
                    total[k] += sums[at[1:]] - sums[at[:-1]]
            if len(names):
                best = total.argmax(axis=0)
                sure = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
            else:
                best, sure, lettered = lettered * 0, lettered * 0.0, lettered & False
            pred += [names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())]
            score.append(np.where(lettered, sure, 0.0))
        yield common.batch(
            doc_id=batch.column("doc_id"), lang_pred=pa.array(pred, pa.string()), score=np.concatenate(score)
        )

    return common.map_batches(common.texts(docs), "doc_id long, lang_pred string, score double", work)


def language(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score."""
    return predict(docs, *train(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
