"""Quality score: logistic regression on hashed word n-grams, trained by FTRL.

Features of a text are word 1- and 2-grams, and 1- to 3-grams of word shapes (letters in lower,
title or upper case, digits, symbols, and the length up to eight), hashed into ``SIZE``
weights. A word is a run of letters, digits and characters beyond ASCII; a run of other
printable characters is a word too. The value of a feature is the square root of its count,
and a text's vector has length one, so that long and short texts weigh alike.

Training takes at most ``TRAIN_ROWS`` labelled rows (a documented bound; those with the
smallest hash of ``doc_id``). They are dealt to ``SHARDS`` tasks, each runs FTRL-Proximal over
its share ``EPOCHS`` times, and the weights are averaged. Rows count alike, so the score is a
probability at the labels' own share of good texts.
Scoring is a sparse dot product and covers every row and whole text. A text without words
scores from the bias alone. Labels other than 0 and 1, NULL ones, and labels of unknown
documents teach nothing; without any label every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatsheet.llm import common, ragged

SIZE = 1 << 18
TRAIN_ROWS = 20_000
SHARDS = 6
EPOCHS = 10
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
THRESHOLD = 0.7
#: Text bytes turned into features at once; a worker takes some 100 bytes of memory for each.
SLICE_BYTES = 256 << 10

_CLASSES = np.full(256, 2, np.uint8)
_CLASSES[:33] = 0
_CLASSES[127] = 0
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _CLASSES[_low:_high] = 1

#: Bits of a shape: lower letter, upper letter, digit, beyond ASCII, symbol.
_BITS = np.zeros(256, np.uint8)
_BITS[97:123], _BITS[65:91], _BITS[48:58], _BITS[128:] = 1, 2, 4, 8
_BITS[_CLASSES == 2] = 16


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of every row, and the offsets of every row's."""
    starts, ends = ragged.runs(_CLASSES[data], offsets)
    rows = ragged.rows_of(starts, offsets)
    hashes = ragged.hash_runs(data, starts, ends)
    if len(starts):
        kinds = np.bitwise_or.reduceat(_BITS[data], starts).astype(np.uint64)
        title = (_BITS[data[starts]] == 2) & (ends - starts > 1)
    else:
        kinds, title = np.empty(0, np.uint64), np.empty(0, bool)
    length = np.minimum(ends - starts, 8).astype(np.uint64)
    shapes = ragged.mix(kinds * np.uint64(64) + length * np.uint64(2) + title + np.uint64(1 << 20))
    plain = ragged.mix(kinds * np.uint64(2) + title + np.uint64(1 << 21))
    doc, found = [], []
    for source, width in ((hashes, 1), (hashes, 2), (shapes, 1), (shapes, 2), (plain, 3)):
        h, at = ragged.grams(source, rows, width)
        found.append((h & np.uint64(SIZE - 1)).astype(np.int64))
        doc.append(np.repeat(np.arange(len(at) - 1), np.diff(at)))
    key = np.concatenate(doc) * SIZE + np.concatenate(found)
    key, count = np.unique(key, return_counts=True)
    row, value = key // SIZE, np.sqrt(count)
    norm = np.sqrt(np.bincount(row, value * value, minlength=len(offsets) - 1))
    return key % SIZE, (value / norm[row]).astype(np.float32), np.searchsorted(row, np.arange(len(offsets)))


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    small = np.abs(z) <= L1
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    w[small] = 0
    return w


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """FTRL-Proximal over ``rows`` of (feature numbers, values); the last weight is the bias."""
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    for epoch in range(EPOCHS):
        for r in np.random.Generator(np.random.PCG64(epoch)).permutation(len(rows)):
            at, x = rows[r]
            zi, ni = z[at], n[at]
            w = _weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - labels[r]) * x
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[at] = more
    return _weights(z, n)


def _train(shard: pd.DataFrame) -> pd.DataFrame:
    labels = shard["label"].to_numpy(np.float64)
    rows = []
    for _, _, data, offsets in ragged.slices(
        pa.array(shard["text"], pa.large_string()), SLICE_BYTES
    ):
        at, x, ends = features(data, offsets)
        for low, high in zip(ends[:-1], ends[1:]):
            rows.append((np.append(at[low:high], SIZE), np.append(x[low:high], 1.0)))
    return pd.DataFrame({"weights": [follow_leader(rows, labels).astype(np.float32).tobytes()]})


def held_out(doc_id) -> F.Column:
    """The quarter of documents that teaches nothing. A NULL id belongs to the rest."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> np.ndarray:
    """Weights and bias learnt from at most ``most`` labelled rows that are not held out."""
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
        .filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .filter("label = other")
        .select("doc_id", F.col("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"))
        .limit(most)
    )
    shards = (
        common.texts(docs)
        .join(F.broadcast(marked), "doc_id")
        .select("text", "label", F.pmod(F.xxhash64("text"), F.lit(SHARDS)).alias("shard"))
        .dropDuplicates()
        .groupBy("shard")
        .applyInPandas(lambda frame: _train(frame), "weights binary")
        .collect()
    )
    found = [np.frombuffer(r["weights"], np.float32) for r in shards]
    return np.mean(found, axis=0) if found else np.zeros(SIZE + 1, np.float32)


def _scored(texts: pa.Array, w: np.ndarray) -> np.ndarray:
    out = [np.empty(0)]
    for _, _, data, offsets in ragged.slices(texts, SLICE_BYTES):
        at, x, ends = features(data, offsets)
        sums = np.concatenate([[0.0], np.cumsum(w[at] * x, dtype=np.float64)])
        out.append(sums[ends[1:]] - sums[ends[:-1]] + w[-1])
    return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -30, 30)))


def scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    if "score" in docs.columns:
        docs = docs.drop("score")
    schema = docs.withColumn("score", F.lit(0.0)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(_scored(batch.column("text"), shared.value), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, score], names=[*batch.schema.names, "score"]
            )

    return docs.mapInArrow(common.released(score), schema)


def accepted(docs: DataFrame, weights: np.ndarray, least: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text (a string column) scores ``least`` or more, as they are. A
    row goes through Arrow once, and rows that are left out do not come back."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scored(batch.column(batch.schema.get_field_index("text")), shared.value)
            yield batch.filter(pa.array(score >= least))

    return docs.mapInArrow(common.released(accept), docs.schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    weights = train(docs, labels)
    return scores(common.texts(docs), weights).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
