"""Exact deduplication through an extendible-hash index in the shared folder.

Texts are equal when identical after lowering A-Z.

1. Directory: the distinct 64-bit keys are counted by prefix. A bucket with more than
   ``BUCKET_KEYS`` keys is split by one more bit, again and again, as doubling a directory
   does. Copies share one key, so a hot text never overfills a bucket.
2. Every row is written with its key, its bucket and its entry. Equal texts of one batch are
   chained at once: the first of them becomes the entry and carries the text, the number of
   copies and the largest row. A text of which there are a million copies thus enters the
   index once per batch.
3. Entries are dealt out by bucket and sorted by key. The owner task of a key range holds one
   chain of distinct texts with the same key at a time and finds a text in it by comparing bytes.
4. Chains are summed up (sizes, largest row) and joined back to their entries and rows.

The row with the largest ``doc_id`` stays. Among rows that repeat both text and ``doc_id``
exactly one stays. A NULL text counts as empty; a NULL ``doc_id`` is smaller than any other.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatsheet.llm import common

BUCKET_KEYS = 100_000
FIRST_BITS = 8
MOST_BITS = 48


def normalised(text) -> F.Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(text) -> F.Column:
    return F.xxhash64(normalised(text))


def directory(docs: DataFrame, most: int = BUCKET_KEYS) -> list[tuple[int, int]]:
    """The buckets as (bits, prefix) in key order. There are about two for ``most`` keys, so
    what the driver gathers is a 50 000th of the number of different texts."""
    keys = common.written(
        common.texts(docs).select(key_of(F.col("text")).alias("key")).distinct(), "index-keys"
    )

    def sizes(bits, within=None):
        some = keys if within is None else keys.filter(_prefix("key", bits - 1).isin(within))
        rows = some.groupBy(_prefix("key", bits).alias("prefix")).count().collect()
        return {r["prefix"]: r["count"] for r in rows}

    bits, size = FIRST_BITS, sizes(FIRST_BITS)
    buckets, level = [], range(1 << FIRST_BITS)
    while True:
        full = [p for p in level if size.get(p, 0) > most and bits < MOST_BITS]
        buckets += [(bits, p) for p in level if p not in set(full)]
        if not full:
            break
        bits += 1
        size, level = sizes(bits, full), [2 * p + b for p in full for b in (0, 1)]
    common.forget(keys)
    return sorted(buckets, key=lambda e: e[1] << (64 - e[0]))


def _prefix(column: str, bits: int) -> F.Column:
    return F.shiftrightunsigned(column, 64 - bits)


ROWS = (
    "row long, doc_id long, sha string, entry long, bucket int, key long, norm string, "
    "size long, top long, top_id long"
)


def _rows(bounds: np.ndarray):
    """Name for every row the first row of its batch with the same bytes as its entry."""

    def work(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, norm = b.column("key").to_numpy(), b.column("norm")
        ids, rows = b.column("doc_id").to_pylist(), b.column("row").to_numpy()
        entry, size, top, top_id = rows.copy(), np.ones(len(keys), np.int64), rows.copy(), list(ids)
        order = np.argsort(keys, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
            if len(group) == 1:
                continue
            chain: dict = {}
            for i in map(int, group):
                chain.setdefault(norm[i].as_py(), []).append(i)
            for same in chain.values():
                best = max(same, key=lambda i: (ids[i] is not None, ids[i] or 0, rows[i]))
                entry[same], size[same] = rows[same[0]], 0
                size[same[0]], top[same[0]], top_id[same[0]] = len(same), rows[best], ids[best]
        bucket = np.searchsorted(bounds, keys.view(np.uint64), side="right") - 1
        yield common.batch(
            row=rows,
            doc_id=pa.array(ids, pa.int64()),
            sha=b.column("sha"),
            entry=entry,
            bucket=bucket.astype(np.int32),
            key=keys,
            norm=pc.if_else(pa.array(size > 0), norm, pa.scalar(None, norm.type)),
            size=size,
            top=top,
            top_id=pa.array(top_id, pa.int64()),
        )

    return work


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries come in key order; each is named after the first entry with its bytes."""
    last, chain = None, {}
    for b in batches:
        if not b.num_rows:
            continue
        norm, entries, named = b.column("norm"), b.column("entry").to_pylist(), []
        for i, key in enumerate(b.column("key").to_pylist()):
            if key != last:
                last, chain = key, {}
            named.append(chain.setdefault(norm[i].as_py(), entries[i]))
        yield common.batch(
            entry=b.column("entry"),
            chain=pa.array(named, pa.int64()),
            size=b.column("size"),
            top=b.column("top"),
            top_id=b.column("top_id"),
        )


def exact_duplicates(docs: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    bounds = np.array([p << (64 - b) for b, p in directory(docs, bucket_keys)], dtype=np.uint64)
    norm = common.texts(docs).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        normalised(F.col("text")).alias("norm"),
    )
    index = common.written(
        common.map_batches(
            norm.select(
                "row", "doc_id", "norm",
                F.xxhash64("norm").alias("key"),
                F.sha2(F.col("norm").cast("binary"), 256).alias("sha"),
            ),
            ROWS,
            _rows(bounds),
        ),
        "index",
    )
    owned = (
        index.filter(F.col("size") > 0)
        .select("bucket", "key", "norm", "entry", "size", "top", "top_id")
        .repartition("bucket")
        .sortWithinPartitions("bucket", "key")
        .mapInArrow(common.released(_own), "entry long, chain long, size long, top long, top_id long")
    )
    chained = common.written(owned, "index-chains")
    groups = chained.groupBy("chain").agg(
        F.max(F.struct("top_id", "top")).alias("best"), F.sum("size").alias("group_size")
    )
    entries = chained.select("entry", "chain").join(groups, "chain")
    return (
        index.select("row", "doc_id", "sha", "entry")
        .join(entries, "entry")
        .select(
            "doc_id",
            F.col("best.top_id").alias("keep_id"),
            "group_size",
            (F.col("row") == F.col("best.top")).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


ORACLE = """
with d as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t
  from documents
), g as (select t, max(doc_id) keep_id, count(*) group_size from d group by t)
select doc_id, keep_id, group_size, doc_id = keep_id kept, sha256(t) text_sha256
from d join g using (t)
"""
