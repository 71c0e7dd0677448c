"""Corpus counts for slices of text that no task could count alone.

Texts are cut into slices of whole rows. A slice keeps the numbers of its own distinct words
(a stream) and sends what it must know about the whole corpus to owners, one packed row for
each owner with something to answer: every key once, with the slice's own count. Owners add up the
counts of all slices and answer in the order they were asked. So a key that a third of all
rows hold reaches its owner once a slice, counted before, and no corpus-wide table is broadcast or
collected.

Tables written between the steps hold one row a slice or one a slice and owner. Their columns:
``slice``, ``key`` (a group such as a language), ``part`` (the owner, -1 for a stream) and ``data``.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatsheet.llm import common, ragged

#: Text bytes of a slice. A worker takes some 30 bytes of memory for each.
SLICE_BYTES = 8 << 20
#: Text bytes for each owner, beside the least number that the shuffle parallelism asks for.
OWNER_BYTES = 16 << 20

ROWS = "slice long, key string, part int, data binary"
SENT = "kind int, " + ROWS
STREAM, REQUEST = 0, 1


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value. Bytes of one significance lie together, so that those
    that are zero throughout take no room."""
    head = [struct.pack("<q", len(arrays))]
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(struct.pack("<4sq", a.dtype.str.encode().ljust(4), len(a)))
        body.append(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (count,) = struct.unpack_from("<q", raw)
    at, arrays = 8 + 12 * count, []
    for i in range(count):
        kind, size = struct.unpack_from("<4sq", raw, 8 + 12 * i)
        dtype = np.dtype(kind.decode().strip())
        planes = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at)
        arrays.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, size).T).view(dtype)[:, 0])
        at += size * dtype.itemsize
    return arrays


def owners(docs: DataFrame) -> int:
    """How many owners the counts of these texts are dealt to."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(size / OWNER_BYTES))


def table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.table(
        {name: pa.array(values, kind) for (name, kind), values in zip(schema, columns)}
    )


_ROW = [
    ("slice", pa.int64()), ("key", pa.string()), ("part", pa.int32()), ("data", pa.binary()),
]


def sent(rows: list[tuple]) -> pa.Table:
    """Rows of (kind, slice, key, part, data)."""
    return table(rows, [("kind", pa.int32()), *_ROW])


def rows(found: list[tuple]) -> pa.Table:
    """Rows of (slice, key, part, data)."""
    return table(found, _ROW)


def slice_numbers():
    """Numbers for the slices of a task that no other task gives."""
    n = TaskContext.get().partitionId() << 33
    while True:
        yield n
        n += 1


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of every word among the distinct words, and these, by comparing bytes."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    column = pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(offsets), pa.py_buffer(data[ragged.spread(starts, size)])
    )
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def owner_of_words(dictionary: pa.Array, parts: int) -> np.ndarray:
    data, offsets = ragged.column(dictionary)
    hashes = ragged.hash_runs(data, offsets[:-1], offsets[1:])
    return (hashes % np.uint64(parts)).astype(np.int64)


def dealt(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The order of entries by owner, and every owner's range in that order."""
    order = np.argsort(part, kind="stable")
    present, first = np.unique(part[order], return_index=True)
    ends = [*first[1:].tolist(), len(part)]
    return order, [(p, slice(a, b)) for p, a, b in zip(present.tolist(), first.tolist(), ends)]


def pack_words(dictionary: pa.Array, at: np.ndarray, *values: np.ndarray) -> bytes:
    """The words at these places of a dictionary, with values of each."""
    data, offsets = ragged.column(dictionary)
    size = np.diff(offsets)[at]
    return pack(data[ragged.spread(offsets[:-1][at], size)], size, *values)


def word_array(data: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(size)])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data))


def group_numbers(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of non-negative whole numbers: a number that orders each distinct row, in order, where
    the first of each stands, and the place of every row among them."""
    key = columns[0].astype(np.uint64)
    for column in columns[1:]:
        column = column.astype(np.uint64)
        high, low = int(key.max(initial=0)), int(column.max(initial=0))
        if high.bit_length() + low.bit_length() > 64:
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
            column = np.unique(column, return_inverse=True)[1].astype(np.uint64)
            low = int(column.max(initial=0))
        key = (key << np.uint64(low.bit_length())) | column
    different, first, which = np.unique(key, return_index=True, return_inverse=True)
    return different, first, which


def answers(
    requests: DataFrame, answer: Callable[[str, int, list[list[np.ndarray]]], tuple], extra: str = ""
) -> DataFrame:
    """Replies to ``requests``, one row for each, and whatever an owner reports of itself.

    ``answer(key, part, payloads)`` gets the unpacked payloads of all slices and returns packed
    replies, one for each, and the values of the ``extra`` columns, which stand on a row of slice -1.
    """
    schema = ROWS + (", " + extra if extra else "")
    names = [c.split()[0] for c in extra.split(", ")] if extra else []
    kinds = [{"long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in extra.split(", ")] if extra else []

    def owned(group: pa.Table) -> pa.Table:
        key, part = group.column("key")[0].as_py(), group.column("part")[0].as_py()
        payloads = [unpack(d.as_buffer()) for d in group.column("data")]
        replies, report = answer(key, part, payloads)
        none = [None] * len(names)
        rows = [
            (s, key, part, r, *none) for s, r in zip(group.column("slice").to_pylist(), replies)
        ]
        if names:
            rows.append((-1, key, part, None, *report))
        return table(rows, [*_ROW, *zip(names, kinds)])

    return requests.groupBy("key", "part").applyInArrow(owned, schema)


def regrouped(streams: DataFrame, replies: DataFrame, work, schema: str) -> DataFrame:
    """``work(slice, stream, replies)`` for every slice: its unpacked stream and its replies as
    (key, part, arrays) in order of key and part."""

    def together(stream: pa.Table, answered: pa.Table) -> pa.Table:
        found = sorted(
            zip(
                answered.column("key").to_pylist(),
                answered.column("part").to_pylist(),
                [unpack(d.as_buffer()) for d in answered.column("data")],
            ),
            key=lambda r: r[:2],
        )
        number = stream.column("slice")[0].as_py()
        return work(number, unpack(stream.column("data")[0].as_buffer()), found)

    return (
        streams.groupBy("slice")
        .cogroup(replies.filter("slice >= 0").groupBy("slice"))
        .applyInArrow(together, schema)
    )


def joined(found: list, count: int) -> list[np.ndarray]:
    """The arrays of several replies of ``count`` arrays, one after another."""
    if not found:
        return [np.empty(0, np.int64)] * count
    return [np.concatenate(parts) for parts in zip(*[arrays for _, _, arrays in found])]


def written_by_kind(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Streams and requests, written in one pass and read apart."""
    table = common.written(df, name, partition_by="kind")
    return tuple(
        table.filter(F.col("kind") == k).select("slice", "key", "part", "data")
        for k in (STREAM, REQUEST)
    )


def forget_requests(requests: DataFrame) -> None:
    """Delete requests of ``written_by_kind`` once their replies are written; the streams stay."""
    common.forget(requests, f"/kind={REQUEST}")
