"""Repeated byte strings across documents, by sorting sampled suffixes one bucket at a time.

Every byte covered by a ``LENGTH``-byte string that also starts in a document with a smaller
doc_id is removed. Strings are judged on the input and never cross documents.

A cover sample stands for all suffixes: of the suffixes that start inside a ``LENGTH``-byte window
the one whose first ``SEED`` bytes have the smallest hash. Like a difference cover it gives any
two equal windows a sample at the same place in both, but it is chosen by content, so a
seventh as many suffixes have to be sorted. A sampled suffix owns the run of windows it was
chosen for; the bytes of that run are its extent.

1. Samples are dealt to suffix buckets by the hash of their seed. One bucket is sorted at a
   time, by seed and then by extent, which ranks the samples.
2. Samples of equal rank have equal extents: all their windows repeat, and in all documents
   but the smallest the whole extent goes. Ties of equal seed and different extent are the
   edges of repeats. These are resolved window by window: the windows they own are dealt to
   buckets of their own, sorted, and go in all documents but the smallest.
3. The removed runs of a document are merged and applied to its text.

Before anything is dealt out, equal suffixes of one slice of the input are reduced to the
smallest document, so a passage in a third of all documents costs each bucket a row a slice.
A bucket holds the samples of about ``BUCKET_BYTES`` of text, whatever the size of the input.

Rows travel in packs, one for each bucket of what a task has collected. The number of packs grows with the
square of the input, so a task collects ``DEAL_ROWS`` rows from many slices first, and a pack has some
hundred rows at 10 GB of text. Runs are gathered by document in the end and not dealt to buckets.

NULL texts count as empty and a NULL doc_id as smaller than any other. Of rows that share a doc_id none
is smaller, so they do not remove one another's strings.
"""

from __future__ import annotations

import gc
import hashlib
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatsheet.llm import common, ragged

LENGTH = 50
SEED = 25
SLICE_BYTES = 1 << 20
BUCKET_BYTES = 4 << 20
#: Rows that a task collects from its slices before it deals them to buckets, 37 bytes each at most.
DEAL_ROWS = 1 << 20
#: Bytes of packs that are opened at once to gather their rows by document.
OPEN_BYTES = 4 << 20

_U = np.uint64
_NONE = -(1 << 63)  # stands for a NULL doc_id

#: What a pack of the exchange holds: samples, windows, runs to remove, windows to list.
SAMPLES, WINDOWS, RUNS, WANTED = range(4)
PACK = "kind int, bucket long, rows binary"
_KINDS = {"a": np.uint64, "b": np.uint64, "doc": np.int64, "text": np.int64, "at": np.int32, "more": np.uint8}
_HELD = {
    SAMPLES: list(_KINDS),
    WINDOWS: ["a", "doc", "text", "at"],
    RUNS: ["doc", "text", "at", "more"],
    WANTED: ["doc", "text", "at", "more"],
}

_squeezed = zstandard.ZstdCompressor(level=1).compress
_opened = zstandard.ZstdDecompressor().decompress

#: Rows of one kind by column; hashes that deal them to buckets, or None for one pack of them all.
Part = tuple[int, np.ndarray | None, dict[str, np.ndarray]]


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive elements."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


class _Text:
    """Prefix sums of the hash over the bytes of a slice."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = ragged._POWERS.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return ragged.mix(h + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def samples(text: _Text, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every sample: seed hash, extent hash, first and last window it owns, its row."""
    n = int(offsets[-1])
    if n < LENGTH:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    at = np.arange(n - SEED + 1)
    seeds = text.hash(at, at + SEED)
    order = (seeds >> _U(31) << _U(31)) | at.astype(np.uint64)
    chosen = (_slide(order, LENGTH - SEED + 1) & _U((1 << 31) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - LENGTH + 1]
    whole = np.flatnonzero(np.arange(n - LENGTH + 1) + LENGTH <= offsets[row + 1])
    chosen, row = chosen[whole], row[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (whole[1:] != whole[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(whole)) - 1
    low, high, chosen = whole[first], whole[last], chosen[first]
    extent = text.hash(low, high + LENGTH) + (chosen - low).astype(np.uint64) * _U(0x9E3779B97F4A7C15)
    return seeds[chosen], ragged.mix(extent), low, high, row[first]


def _planes(kind: int, columns: dict[str, np.ndarray], starts: np.ndarray) -> np.ndarray:
    """Rows as bytes of equal weight side by side, documents as differences inside a pack."""
    n, planes = len(columns["doc"]), []
    for name in _HELD[kind]:
        x = columns[name].astype(_KINDS[name])
        if name == "doc":
            heads = x[starts]
            x = np.diff(x, prepend=x.dtype.type(0))
            x[starts] = heads
        planes.append(x.view(np.uint8).reshape(n, -1).T)
    return np.concatenate(planes)


def _packs(buckets: int, part: Part) -> Iterator[tuple[int, int, bytes]]:
    """Rows of the exchange, one for each bucket; the order inside a bucket is kept."""
    kind, by, columns = part
    n = len(columns["doc"])
    if not n:
        return
    if by is None:
        bucket = ragged.mix(columns["doc"][:1].view(np.uint64)) % _U(buckets)
        starts = np.zeros(1, np.int64)
    else:
        bucket = by % _U(buckets)
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        bucket, columns = bucket[order], {name: x[order] for name, x in columns.items()}
        starts = np.append(0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1)
    planes = _planes(kind, columns, starts)
    for low, high in zip(starts, np.append(starts[1:], n)):
        yield kind, kind * buckets + int(bucket[low]), _squeezed(planes[:, low:high].tobytes())


def _batch(buckets: int, parts: Iterable[Part]) -> pa.RecordBatch:
    rows = [row for part in parts for row in _packs(buckets, part)]
    types = {"kind": pa.int32(), "bucket": pa.int64(), "rows": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], names=list(types)
    )


def _dealt(
    buckets: int, work: Callable[[pa.RecordBatch], Iterator[list[Part]]]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What ``work`` makes of the slices of a partition, packed every ``DEAL_ROWS`` rows."""

    def flushed(held: dict[int, list[Part]]) -> pa.RecordBatch:
        def joined() -> Iterator[Part]:
            for kind in list(held):
                parts = held.pop(kind)
                by = None if parts[0][1] is None else np.concatenate([p[1] for p in parts])
                yield kind, by, {c: np.concatenate([p[2][c] for p in parts]) for c in _HELD[kind]}

        return _batch(buckets, joined())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = {}, 0
        for batch in batches:
            for parts in work(batch):
                for part in parts:
                    held.setdefault(part[0], []).append(part)
                    count += len(part[2]["doc"])
                if count >= DEAL_ROWS:
                    yield flushed(held)
                    held, count = {}, 0
        if count:
            yield flushed(held)

    return common.released(run)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Numbers of the runs of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.cumsum(new)


def _runs(doc, text, low, size) -> Part:
    """Runs to remove."""
    return RUNS, None, {"doc": doc, "text": text, "at": low, "more": size.astype(np.uint8)}


def _windows(hashes, doc, text, at) -> list[Part]:
    """Windows of one slice: repeats inside it are removed, the smallest documents dealt out."""
    order = np.lexsort((doc, hashes))
    hashes, doc, text, at = hashes[order], doc[order], text[order], at[order]
    group = _groups(hashes)
    least = doc[np.searchsorted(group, group)]
    more = doc > least
    keep = np.flatnonzero(~more)
    keep = keep[np.lexsort((at[keep], text[keep], doc[keep]))]
    return [
        _runs(doc[more], text[more], at[more], np.full(more.sum(), LENGTH)),
        (WINDOWS, hashes[keep], {"a": hashes[keep], "doc": doc[keep], "text": text[keep], "at": at[keep].astype(np.int32)}),
    ]


def _first_pass(buckets: int):
    def work(batch: pa.RecordBatch) -> Iterator[list[Part]]:
        ids, marks = batch.column("doc_id").to_numpy(), batch.column("row").to_numpy()
        for first, _, data, offsets in ragged.slices(batch.column("text"), SLICE_BYTES):
            text = _Text(data)
            seed, extent, low, high, row = samples(text, offsets)
            doc, mark = ids[first + row], marks[first + row]
            order = np.lexsort((doc, extent, seed))
            seed, extent, low, high, row, doc, mark = (
                x[order] for x in (seed, extent, low, high, row, doc, mark)
            )
            by_seed = _groups(seed) if len(seed) else np.empty(0, np.int64)
            head = np.searchsorted(by_seed, by_seed)
            tail = np.searchsorted(by_seed, by_seed, side="right") - 1
            mixed = extent[head] != extent[tail]  # more than one extent: an edge of a repeat
            least = doc[head]
            gone = ~mixed & (doc > least)
            start = low - offsets[row]
            parts = [_runs(doc[gone], mark[gone], start[gone], (high - low + LENGTH)[gone])]
            keep = np.flatnonzero((~mixed & ~gone) | (mixed & (head == np.arange(len(head)))))
            keep = keep[np.lexsort((low[keep],))]
            columns = {
                # Seeds that agree in 32 bits alone are compared by their windows like any tie.
                "a": seed[keep] >> _U(32),
                "b": np.where(mixed, _U(0), extent)[keep] >> _U(16),
                "doc": doc[keep],
                "text": mark[keep],
                "at": start[keep].astype(np.int32),
                "more": np.where(mixed, 255, high - low)[keep].astype(np.uint8),
            }
            parts.append((SAMPLES, seed[keep], columns))
            own = np.flatnonzero(mixed)
            count = (high - low + 1)[own]
            at = ragged.spread(low[own], count)
            which = np.repeat(own, count)
            parts += _windows(
                text.hash(at, at + LENGTH), doc[which], mark[which], at - offsets[row[which]]
            )
            yield parts

    return _dealt(buckets, work)


def _columns(kind: int, packs: list[bytes]) -> dict[str, np.ndarray]:
    types = {name: np.dtype(_KINDS[name]) for name in _HELD[kind]}
    width = sum(t.itemsize for t in types.values())
    parts = [np.frombuffer(_opened(raw), np.uint8).reshape(width, -1) for raw in packs]
    planes, sizes = np.concatenate(parts, axis=1), np.array([p.shape[1] for p in parts])
    columns, low = {}, 0
    for name, dtype in types.items():
        x = np.ascontiguousarray(planes[low : low + dtype.itemsize].T).view(dtype).ravel()
        low += dtype.itemsize
        if name == "doc":
            x = np.cumsum(x, dtype=dtype)
            ends = np.cumsum(sizes)
            x -= np.repeat(np.append(dtype.type(0), x[ends[:-1] - 1]), sizes)
        columns[name] = x
    return columns


def _rank(buckets: int):
    """One bucket of samples sorted by seed and extent. Rows of other kinds pass."""

    def work(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() != SAMPLES:
            return table
        c = _columns(SAMPLES, table.column("rows").to_pylist())
        order = np.lexsort((c["doc"], c["b"], c["a"]))
        seed, extent, doc, text, at, more = (c[k][order] for k in ("a", "b", "doc", "text", "at", "more"))
        by_seed = _groups(seed)
        head, tail = np.searchsorted(by_seed, by_seed), np.searchsorted(by_seed, by_seed, side="right") - 1
        marked = more == 255
        edge = (extent[head] != extent[tail]) | marked[head]
        gone = ~marked & (doc > doc[np.searchsorted(rank := _groups(seed, extent), rank)])
        want = edge & ~gone & ~marked
        columns = {"doc": doc[want], "text": text[want], "at": at[want], "more": more[want]}
        parts = [_runs(doc[gone], text[gone], at[gone], more[gone].astype(int) + LENGTH), (WANTED, None, columns)]
        return pa.Table.from_batches([_batch(buckets, parts)])

    return work


def _list_windows(buckets: int):
    """Texts with the samples whose windows are wanted."""

    def work(batch: pa.RecordBatch) -> Iterator[list[Part]]:
        ids, marks = batch.column("doc_id").to_numpy(), batch.column("row").to_numpy()
        wanted = batch.column("runs").to_pylist()
        for first, end, data, offsets in ragged.slices(batch.column("text"), SLICE_BYTES):
            text, low, row, count = _Text(data), [], [], []
            for i in range(first, end):
                pairs = np.frombuffer(b"".join(wanted[i]), np.int32).reshape(-1, 2).astype(np.int64)
                low.append(pairs[:, 0] + offsets[i - first])
                count.append(pairs[:, 1] + 1)
                row.append(np.full(len(pairs), i - first))
            count, row = np.concatenate(count), np.concatenate(row)
            at, row = ragged.spread(np.concatenate(low), count), np.repeat(row, count)
            yield _windows(
                text.hash(at, at + LENGTH), ids[first + row], marks[first + row], at - offsets[row]
            )

    return _dealt(buckets, work)


def _least_windows(buckets: int):
    """One bucket of windows sorted; they go in all documents but the smallest."""

    def work(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() != WINDOWS:
            return table
        c = _columns(WINDOWS, table.column("rows").to_pylist())
        order = np.lexsort((c["doc"], c["a"]))
        hashes, doc, text, at = (c[k][order] for k in ("a", "doc", "text", "at"))
        group = _groups(hashes)
        gone = doc > doc[np.searchsorted(group, group)]
        runs = _runs(doc[gone], text[gone], at[gone], np.full(gone.sum(), LENGTH))
        return pa.Table.from_batches([_batch(buckets, [runs])])

    return work


def _by_document(kind: int):
    """Packs of one kind as rows of doc_id, row, and (start, size) pairs; overlapping runs merged."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        packs = batch.column("rows")
        share = pc.binary_length(packs).to_numpy().astype(np.int64).cumsum() // OPEN_BYTES
        edges = np.flatnonzero(np.diff(share)) + 1
        for low, high in zip([0, *edges], [*edges, len(packs)]):
            yield gathered(packs[low:high].to_pylist())

    def gathered(packs: list[bytes]) -> pa.RecordBatch:
        c = _columns(kind, packs)
        order = np.lexsort((c["at"], c["text"], c["doc"]))
        doc, text, at, more = (c[k][order] for k in ("doc", "text", "at", "more"))
        group = _groups(doc, text)
        if kind == RUNS:
            # Documents lie too far apart to touch, so the runs of all are merged at once.
            apart = group << 33
            pairs = _merge(np.stack([apart + at, more], axis=1))
            heads = np.searchsorted(apart + at, pairs[:, 0])
            doc, text, group = doc[heads], text[heads], group[heads]
            pairs[:, 0] -= group << 33
        else:
            pairs = np.stack([at, more], axis=1)
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        ends = (np.append(heads, len(group)) * 8).astype(np.int32)
        raw = np.ascontiguousarray(pairs.astype(np.int32))
        runs = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
        return common.batch(doc_id=doc[heads], row=text[heads], runs=runs)

    return work


def _merge(pairs: np.ndarray) -> np.ndarray:
    """Runs as (start, size), those that touch or overlap made one. Starts must ascend."""
    start, end = pairs[:, 0], np.maximum.accumulate(pairs[:, 0] + pairs[:, 1])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return np.stack([start[first], end[last] - start[first]], axis=1)


def _apply(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
    for text, runs in zip(batch.column("text"), batch.column("runs").to_pylist()):
        raw = text.as_py().encode()
        pairs = np.frombuffer(b"".join(runs or []), np.int32).reshape(-1, 2)
        pairs = _merge(pairs[np.argsort(pairs[:, 0], kind="stable")]) if len(pairs) else pairs
        digest, at = hashlib.sha256(), 0
        for start, size in pairs.tolist():
            digest.update(raw[at:start])
            at = start + size
        digest.update(raw[at:])
        out["n_bytes"].append(len(raw))
        out["n_removed"].append(int(pairs[:, 1].sum()))
        out["n_spans"].append(len(pairs))
        out["kept_sha256"].append(digest.hexdigest())
    ids = batch.column("doc_id")
    ids = pc.if_else(pc.equal(ids, _NONE), pa.scalar(None, ids.type), ids)
    yield common.batch(doc_id=ids, **out)


def _release(spark) -> None:
    """Let Spark delete the shuffle files of finished steps; it does so when their frames are
    collected as garbage, which takes Python, the JVM and the cleaner a moment each."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    plain = _identified(docs)
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    ranked = _ranked(plain, buckets)
    _release(spark)
    found = _resolved(plain, ranked, buckets)
    _release(spark)
    runs = _collected(ranked.unionByName(found), RUNS)
    return common.map_batches(
        plain.join(runs, ["doc_id", "row"], "left"),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
        _apply,
    )


def _identified(docs: DataFrame) -> DataFrame:
    """Documents with ``row``, which is 0 where a doc_id is alone and tells the texts of a
    repeated one apart."""
    plain = common.texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(_NONE)))
    repeated = common.written(
        plain.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("twice")),
        "repeated",
    )
    row = F.when(F.col("twice").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0))
    return plain.join(repeated, F.col("doc_id") == F.col("twice"), "left").select(
        "doc_id", row.alias("row"), "text"
    )


def _ranked(plain: DataFrame, buckets: int) -> DataFrame:
    packs = plain.mapInArrow(_first_pass(buckets), PACK)
    return common.written(packs.groupBy("bucket").applyInArrow(_rank(buckets), PACK), "ranked")


def _collected(packs: DataFrame, kind: int) -> DataFrame:
    """doc_id, row and the packed (start, size) pairs of one kind."""
    return (
        common.map_batches(
            packs.filter(F.col("kind") == kind), "doc_id long, row long, runs binary", _by_document(kind)
        )
        .groupBy("doc_id", "row")
        .agg(F.collect_list("runs").alias("runs"))
    )


def _resolved(plain: DataFrame, ranked: DataFrame, buckets: int) -> DataFrame:
    wanted = _collected(ranked, WANTED)
    listed = plain.join(wanted, ["doc_id", "row"]).mapInArrow(_list_windows(buckets), PACK)
    windows = ranked.filter(F.col("kind") == WINDOWS).unionByName(listed)
    return common.written(
        windows.groupBy("bucket").applyInArrow(_least_windows(buckets), PACK), "windows"
    )
