"""Documents packed into sequences of a fixed number of tokens.

1. Every text is tokenised and ended by an end id. A longer document is cut into pieces of
   ``CAPACITY`` tokens, the first of which may be shorter.
2. Pieces are dealt to groups of about ``GROUP`` and packed there by best-fit decreasing.
3. Dual-feasible functions turn the lengths of a group into lower bounds on its bins. A group
   that meets its bound is certified: no better packing of these pieces exists alone. Every
   group gives up its emptiest bin, whose room is lost to rounding, and a fiftieth of its bins,
   the emptiest again; a group with a gap gives up four more for each bin of the gap.
4. Groups exchange what was given up: those pieces are dealt anew to as many groups as they
   need and packed again, round after round, until they fit one group or nothing more is saved.

Groups are bounded by ``GROUP`` in the mean, whatever the input. A NULL or empty text is one
piece that holds the end id alone. Repeated rows are packed as often as they occur. Rows are
sorted by length, ``doc_id`` (NULL first), piece and row before packing, so that a task that runs
again packs the same way. An empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatsheet.llm import common, ragged, token_ids

TOKENIZER = "byte_bpe_50k.json"
END = 0
CAPACITY = 2048
GROUP = 20_000
ROUNDS = 12

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
MARKED = PIECES + ", row long, again boolean"
PLACED = MARKED + ", sequence_id long, offset long, given_up boolean"


def pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    tokenizer: str = TOKENIZER,
    end: int = END,
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, row, again and, if asked for, the ids of every
    piece. ``row`` numbers the rows of ``docs``, so row and piece name a piece whatever its
    doc_id; two calls agree on it if ``docs`` is a stored table. ``again`` says what ``_mark``
    does; it is found here, as a step of its own would need a second worker for each task."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        docs_ids, rows = batch.column("doc_id"), batch.column("row")
        names = docs_ids.to_pandas(integer_object_nulls=True)
        repeated, most = names.duplicated(keep=False).to_numpy(), {}
        for low, high, ids, ends in token_ids.encoded(batch.column("text"), tokenizer):
            size = np.diff(ends) + 1
            ids = np.insert(ids.astype(np.uint32), ends[1:], np.uint32(end))
            begin = np.cumsum(size) - size
            count = -(-size // capacity)
            row = np.repeat(np.arange(high - low), count)
            piece = ragged.spread(np.zeros(len(count), np.int64), count)
            first = size - (count - 1) * capacity
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            before = np.zeros(high - low, np.int64)
            for i in np.flatnonzero(repeated[low:high]).tolist():
                before[i] = most.get(names[low + i], 0)
                most[names[low + i]] = max(int(before[i]), int(count[i]))
            at, raw = begin[row] + start, ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
            columns = {
                "doc_id": docs_ids.slice(low, high - low).take(pa.array(row)),
                "piece": piece.astype(np.int32),
                "start": start,
                "length": length,
                "ids_crc32": np.array(crc, np.int64),
                "row": rows.slice(low, high - low).take(pa.array(row)),
                "again": piece < before[row],
            }
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(
                    np.append(at, len(ids)).astype(np.int32), ids.astype(np.int32)
                )
            yield common.batch(**columns)

    numbered = common.texts(docs).withColumn("row", F.monotonically_increasing_id())
    return common.map_batches(numbered, MARKED + ", ids array<int>" * with_ids, cut)


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """The best lower bound that dual-feasible functions give on the number of bins.

    Such a function maps lengths to [0, 1] so that what fits one bin sums up to 1 at most.
    Two families are tried: for each t up to half a bin, lengths under t count nothing and
    those over capacity - t count as a bin; for each k, lengths are rounded down to k-ths.
    """
    if not len(lengths):
        return 0
    many = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    total = np.cumsum(many * size)
    over = len(lengths) - np.cumsum(many)
    t = np.arange(capacity // 2 + 1)
    small = np.where(t > 0, total[t - 1], 0)
    middle = total[capacity - t] - small
    best = int((-(-(middle + capacity * over[capacity - t]) // capacity)).max())
    for k in range(1, 33):
        whole = ((k + 1) * size) % capacity == 0
        worth = np.where(whole, size * k, (k + 1) * size // capacity * capacity)
        best = max(best, int(-(-int((worth * many).sum()) // (capacity * k))))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of every length, which come in decreasing order, and the room left in
    every bin. ``free`` has a bit for every amount of room that some bin has."""
    rooms: list[int] = []
    having: dict[int, list[int]] = {}
    free = 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fits = free >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = having[room].pop()
            if not having[room]:
                free ^= 1 << room
        else:
            room, b = capacity, len(rooms)
            rooms.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        rooms[b] = left = room - n
        if left:
            if not having.setdefault(left, []):
                free |= 1 << left
            having[left].append(b)
    return bins, offsets, rooms


def _pack(frame: pd.DataFrame, capacity: int, turn: int, last: bool) -> pd.DataFrame:
    frame = frame.sort_values(
        ["length", "doc_id", "piece", "row"],
        ascending=[False, True, True, True],
        na_position="first",
        kind="stable",
    )
    lengths = frame["length"].to_numpy(np.int64)
    bins, offsets, rooms = best_fit(lengths, capacity)
    room = np.array(rooms)
    loose = np.flatnonzero(room > 0)
    loose = loose[np.argsort(-room[loose], kind="stable")]
    gap = len(rooms) - least_bins(lengths, capacity)
    given = np.zeros(len(rooms), bool)
    if not last:
        given[loose[: 1 + 4 * gap + len(rooms) // 50]] = True
    group = int(frame["group"].iloc[0])
    out = frame[["doc_id", "piece", "start", "length", "ids_crc32", "row", "again"]].copy()
    out["sequence_id"] = (turn << 56) + (group << 24) + bins
    out["offset"] = offsets
    out["given_up"] = given[bins]
    return out


def _mark(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Whether a piece of the same doc_id and number stands before it in the batch. Such pieces
    are dealt by their row, so that of a hot or NULL id one piece a batch shares a group at most."""
    key = batch.select(["doc_id", "piece"]).to_pandas(integer_object_nulls=True)
    yield batch.append_column("again", pa.array(key.duplicated().to_numpy()))


def pack(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``rows`` of ``pieces`` with sequence_id and offset. Pieces without ``row`` count as one
    row each; those without ``again`` are marked first."""
    if "row" not in rows.columns:
        rows = rows.withColumn("row", F.monotonically_increasing_id())
    marked = ["doc_id", "piece", "start", "length", "ids_crc32", "row", "again"]
    if "again" in rows.columns:
        rows = rows.select(*marked)
    else:
        rows = common.map_batches(rows.select(*marked[:-1]), MARKED, _mark)
    pool = common.written(rows, "pieces")
    done = None
    for turn in range(ROUNDS):
        some = pool.agg(F.count("*").alias("n"), F.sum("length").alias("sum")).first()
        groups = max(1, -(-some["n"] // group))
        # One group is the end: its own best-fit decreasing is final.
        last = groups == 1 or turn == ROUNDS - 1
        placed = common.written(
            pool.select(
                "doc_id", "piece", "start", "length", "ids_crc32", "row", "again",
                # A NULL leaves the hash as it is.
                F.pmod(
                    F.xxhash64("doc_id", "piece", F.lit(turn), F.when(F.col("again"), F.col("row"))),
                    F.lit(groups),
                ).alias("group"),
            )
            .groupBy("group")
            .applyInPandas(_packer(capacity, turn, last), PLACED),
            "placed",
        )
        kept = placed.filter(~F.col("given_up")).drop("given_up", "again")
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        pool = placed.filter("given_up").drop("sequence_id", "offset", "given_up")
    return done


def _packer(capacity: int, turn: int, last: bool):
    def work(frame: pd.DataFrame) -> pd.DataFrame:
        return _pack(frame, capacity, turn, last)

    return work


def sequences(placed: DataFrame, ids: DataFrame) -> DataFrame:
    """sequence_id and its token ids, from placed pieces and pieces ``with_ids`` of the same
    stored table. A sequence has at most ``CAPACITY`` ids, so a group is bounded."""
    return (
        placed.select("row", "piece", "sequence_id", "offset")
        .join(ids.select("row", "piece", "ids"), ["row", "piece"])
        .groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select("sequence_id", F.flatten("parts.ids").alias("ids"))
    )


def packed(docs: DataFrame) -> DataFrame:
    """One row per piece of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset."""
    return pack(pieces(docs)).drop("row")
