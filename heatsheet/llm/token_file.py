"""Token ids in checksummed binary files.

A file holds documents of one range of ``doc_id`` in ascending order (NULL first): a header, the
ids and lengths of the documents, the lengths of what follows, a checksum of all that, and the
head and the blocks of ``id_coder``. Files are rows of a Parquet table in the shared folder, one file
a row, because only Spark's writers reach every store; ``content`` is the file's bytes.

A file is made of about ``FILE_BYTES`` of text, so a task holds one file at a time. A NULL or empty
text has the end id alone. Rows that share a ``doc_id`` follow one another in order of their
ids' checksum. An empty table gives no files or empty ones.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heatsheet.llm import common, id_coder, token_ids

TOKENIZER = "word_bpe_49k.json"
VOCABULARY = 49_408
END = 1
FILE_BYTES = 20_000_000
#: How texts are encoded: text bytes at once, pieces remembered, see ``token_ids.Encoder``.
ENCODING = {"text_bytes": 1 << 20, "remembered": 1_500_000, "words": True}

MAGIC = b"HSTK\x02"
_HEAD = struct.Struct("<5sIQQI")
FILES = "file int, n_ids long, content binary"


def pack_file(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    """The bytes of one file."""
    blocks = id_coder.encode(ids, vocabulary)
    empty = np.array([i is None for i in doc_ids], np.uint8)
    index = b"".join(
        [
            empty.tobytes(),
            np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
            lengths.astype("<u4").tobytes(),
            np.array(list(map(len, blocks)), "<u4").tobytes(),
        ]
    )
    index = zlib.compress(index)
    head = _HEAD.pack(MAGIC, vocabulary, len(doc_ids), len(ids), len(index))
    check = zlib.crc32(head + index).to_bytes(4, "little")
    return b"".join([head, check, index, *blocks])


def unpack_file(content: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Documents, lengths and ids of one file. Damage is an error."""
    head = content[: _HEAD.size]
    magic, vocabulary, docs, n_ids, size = _HEAD.unpack(head)
    at = _HEAD.size + 4
    index = content[at : at + size]
    if magic != MAGIC or zlib.crc32(head + index) != int.from_bytes(content[at - 4 : at], "little"):
        raise ValueError("not a token file, or its head is damaged")
    index, at = zlib.decompress(index), at + size
    empty = np.frombuffer(index, np.uint8, docs)
    doc_ids = np.frombuffer(index, "<i8", docs, docs)
    lengths = np.frombuffer(index, "<u4", docs, 9 * docs).astype(np.int64)
    sizes = np.frombuffer(index, "<u4", -1, 13 * docs).astype(np.int64) if len(index) > 13 * docs else []
    blocks = []
    for n in sizes:
        blocks.append(content[at : at + n])
        at += n
    ids = id_coder.decode(blocks, n_ids, vocabulary)
    return [None if e else int(i) for e, i in zip(empty, doc_ids)], lengths, ids


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    doc_ids, lengths, ids = [], [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        doc_ids += batch.column("doc_id").to_pylist()
        for _, _, found, ends in token_ids.encoded(batch.column("text"), TOKENIZER, **ENCODING):
            ids.append(np.insert(found, ends[1:], END))
            lengths.append(np.diff(ends) + 1)
    if not doc_ids:
        return
    ids = np.concatenate(ids)
    content = pack_file(doc_ids, np.concatenate(lengths), ids, VOCABULARY)
    yield common.batch(
        file=np.array([TaskContext.get().partitionId()], np.int32),
        n_ids=np.array([len(ids)], np.int64),
        content=pa.array([content], pa.binary()),
    )


def write(docs: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Files of all documents: file (their order), n_ids, content."""
    plain = common.texts(docs)
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return common.written(
        plain.repartitionByRange(-(-total // file_bytes) or 1, "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(_write, FILES),
        "token-files",
    )


def _read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
        doc_ids, lengths, ids = unpack_file(content.as_py())
        raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths)
        yield common.batch(
            file=np.full(len(doc_ids), file, np.int32),
            doc_id=pa.array(doc_ids, pa.int64()),
            begin=ends - lengths,
            n_tokens=lengths,
            ids_crc32=np.array(
                [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())],
                np.int64,
            ),
        )


def digests(files: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file meets here.
    before = files.select("file", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))
    read = common.map_batches(
        files.select("file", "content"),
        "file int, doc_id long, begin long, n_tokens long, ids_crc32 long",
        _read,
    )
    return read.join(F.broadcast(before), "file").select(
        "doc_id", (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame) -> DataFrame:
    return digests(write(docs))
