"""Spelling variants: words one letter apart, found in a trie of letter counts.

Words are maximal runs of ``[A-Za-z`` U+00C0 to U+00FF``]``, A-Z lowered. Where 31 divides the unsigned
crc32 of ``<doc_id>:<run>``, h, the run loses its code point h % length. Words of at least
``LETTERS`` code points that occur ``LEAST`` times stay.

A word's frequency vector has its number of code points of each letter group: one for each letter of
``ALONE``, four for the other letters from a to z, two for the rest. The trie arranges words by
the counts of one group after another, those that tell most apart first. One
changed letter moves two words' vectors apart by one more in at most one group (surplus) and one
less in at most one (deficit). So a search goes down the trie with a budget of one each; what it reaches
at the leaves is verified letter by letter.

On the cluster, the top ``COARSE`` levels are counts of letters of unions of groups, and their values
are the subtrees' keys. A word is sent to its own subtree and to those that its budget reaches. Of two
words the one asks whose first difference is a surplus, or without any the smaller one, so each pair is met
once. Words and searches of a large subtree are dealt to blocks of bounded size, every search to
every block of words. Inside a block the search is depth first over sets of searches, in pieces of at
most ``FRONTIER``.

A word's form is its near word that occurs most often (ties: the smallest), if that is ``TIMES`` as often
as the word itself. Forms are at least ten times as frequent at each step, so fewer than 19 steps lead to the root
and five doublings find it.

NULL text has no words; a NULL ``doc_id`` counts as an empty one in ``<doc_id>:<run>``. Repeated rows count as
often as they stand there. An empty table, or one without such words, gives no rows. Very long texts and runs
are taken whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatsheet.llm import common, ragged, streams

LETTERS = 7
LEAST = 2
TIMES = 10
DROPS = 31
ALONE = "etaoinsrhldc"
COARSE = 4
GROUPS = len(ALONE) + 4 + 2
#: Words, and searches, that one block of a subtree holds at most on average.
BLOCK = 100_000
#: Searches that go down one level of the trie at once.
FRONTIER = 1 << 18
DOUBLINGS = 5

WORDS = "word string, n long"
PAIRS = "word string, near string, near_n long"

# U+00C0 to U+00FF are 0xC3 and a byte from 0x80 on; 0xC3 has no other use.
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[65:91] = _CLASSES[97:123] = 1

#: The group of a letter; of a letter beyond ASCII, by its second byte.
_GROUP = len(ALONE) + 4 + np.arange(256) % 2
_GROUP[97:123] = len(ALONE) + np.arange(26) % 4
for _i, _letter in enumerate(ALONE):
    _GROUP[ord(_letter)] = _i


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


_CRC = _crc_table()


def crc_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of every run's bytes, following bytes whose crc32 is ``before``."""
    out = before ^ np.uint32(0xFFFFFFFF)
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, crc = starts[order], out[order]
    size = size[order]
    step = 0
    while len(size) and step < size[0]:
        m = int(np.searchsorted(-size, -step, side="left"))
        crc[:m] = _CRC[(crc[:m] ^ data[at[:m] + step]) & 255] ^ (crc[:m] >> 8)
        step += 1
    out[order] = crc
    return out ^ np.uint32(0xFFFFFFFF)


def _letters(data: np.ndarray) -> np.ndarray:
    letter = _CLASSES[data].astype(bool)
    lead = np.flatnonzero(data == 0xC3)
    letter[lead] = letter[lead + 1] = True
    return letter


def _counted(ids: list, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of a slice, after runs lost their letters, and how often they occur."""
    data = ragged.LOWER[data]
    starts, ends = ragged.runs(_letters(data).astype(np.uint8), offsets)
    # Runs that stay too short whatever happens need no checksum; a code point has two bytes at most.
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long = points[ends] - points[starts] >= LETTERS
    doc = np.repeat(np.arange(len(ids)), np.diff(ragged.rows_of(starts, offsets)))[long]
    starts, ends = starts[long], ends[long]
    heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    h = crc_runs(data, starts, ends, heads[doc]).astype(np.int64)
    length = points[ends] - points[starts]
    hit = np.flatnonzero(h % DROPS == 0)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    drop = lead[points[starts[hit]] + h[hit] % length[hit]]
    size = ends - starts
    taken = ragged.spread(starts, size)
    wide = (data[drop] == 0xC3).astype(np.int64)
    before = np.cumsum(size) - size
    place = before[hit] + drop - starts[hit]
    keep = np.ones(len(taken), bool)
    keep[place] = False
    keep[place[wide > 0] + 1] = False
    size[hit] -= 1 + wide
    length[hit] -= 1
    letters = data[taken[keep]]
    stays = length >= LETTERS
    if not stays.all():
        letters = letters[np.repeat(stays, size)]
        size = size[stays]
    coded = streams.word_array(letters, size).dictionary_encode()
    return coded.dictionary, np.bincount(
        coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary)
    )


def frequent_words(docs: DataFrame) -> DataFrame:
    """Words that occur at least ``LEAST`` times, with their number ``n``."""

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id").to_pylist()
        for low, high, data, offsets in ragged.slices(batch.column("text"), streams.SLICE_BYTES):
            words, counts = _counted(ids[low:high], data, offsets)
            yield common.batch(word=words.cast(pa.string()), n=counts.astype(np.int64))

    found = common.map_batches(common.texts(docs), WORDS, count)
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def vectors(words: pa.Array) -> np.ndarray:
    """One row of letter-group counts for each word."""
    data, offsets = ragged.column(words)
    row = np.repeat(np.arange(len(words)), np.diff(offsets))
    lead = (data & 0xC0) != 0x80
    group = _GROUP[data]
    second = np.flatnonzero(data == 0xC3) + 1
    group[second - 1] = group[second]
    key = row[lead] * GROUPS + group[lead]
    counts = np.bincount(key, minlength=len(words) * GROUPS)
    return counts.reshape(len(words), GROUPS)


def coarse(counts: np.ndarray) -> np.ndarray:
    """Counts of the unions of groups that the subtrees are told apart by."""
    return np.stack([counts[:, i::COARSE].sum(axis=1) for i in range(COARSE)], axis=1)


def _moves() -> list[tuple[np.ndarray, int, bool]]:
    """Steps between subtrees that start with a surplus, or none. With each, the deficit that is
    left for the groups, and whether a surplus must come first there too: a step tells who asks."""
    moves = [(np.zeros(COARSE, np.int64), 1, True)]
    for i in range(COARSE):
        step = np.zeros(COARSE, np.int64)
        step[i] = 1
        moves.append((step, 0, False))
        for j in range(i + 1, COARSE):
            both = step.copy()
            both[j] = -1
            moves.append((both, 1, False))
    return moves


def _key(counts: np.ndarray) -> list[bytes]:
    """A subtree's name: its counts in fixed width."""
    return [r.tobytes() for r in counts.astype(">u4")]


SENT = "key binary, word string, n long, deficit int, ordered boolean, asks boolean"


def _dealt(words: DataFrame) -> DataFrame:
    """Each word once as a member of its subtree, and once for every subtree it searches."""
    moves = _moves()

    def deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        word, n = batch.column("word"), batch.column("n")
        place = coarse(vectors(word))
        yield common.batch(
            key=pa.array(_key(place), pa.binary()), word=word, n=n,
            deficit=pa.nulls(len(word), pa.int32()), ordered=pa.nulls(len(word), pa.bool_()),
            asks=np.zeros(len(word), bool),
        )
        for step, deficit, ordered in moves:
            to = place + step
            at = np.flatnonzero((to >= 0).all(axis=1))
            there = pa.array(at)
            yield common.batch(
                key=pa.array(_key(to[at]), pa.binary()), word=word.take(there), n=n.take(there),
                deficit=np.full(len(at), deficit, np.int32), ordered=np.full(len(at), ordered),
                asks=np.ones(len(at), bool),
            )

    return common.map_batches(words, SENT, deal)


class Trie:
    """Words by their counts, one level for each group; a node is the number of its prefix."""

    def __init__(self, counts: np.ndarray):
        order = np.lexsort(counts.T[::-1])
        self.order = order
        node = np.zeros(len(counts), np.int64)
        self.children = []
        for level in range(GROUPS):
            key, node = np.unique(
                (node << 32) | counts[order, level], return_inverse=True
            )
            self.children.append(key)
        # Words of a leaf stand together.
        self.leaf = np.searchsorted(node, np.arange((node[-1] if len(node) else -1) + 2))

    def search(self, counts: np.ndarray, deficit: np.ndarray, ordered: np.ndarray):
        """Pairs of a search and a word whose counts differ by a surplus of one and this deficit at
        most, the surplus first if ``ordered``; and whether they do not differ."""
        one = np.ones(len(counts), np.int64)
        start = (np.arange(len(counts)), one - 1, one, deficit)
        stack = [(0, *start)]
        while stack:
            level, search, node, up, down = stack.pop()
            if not len(search):
                continue
            if len(search) > FRONTIER:
                half = len(search) // 2
                stack.append((level, search[half:], node[half:], up[half:], down[half:]))
                stack.append((level, search[:half], node[:half], up[:half], down[:half]))
                continue
            if level == GROUPS:
                low, size = self.leaf[node], self.leaf[node + 1] - self.leaf[node]
                there = self.order[ragged.spread(low, size)]
                yield np.repeat(search, size), there, np.repeat(up == 1, size)
                continue
            keys, want = self.children[level], counts[search, level]
            found = []
            for change in (0, 1, -1):
                may = {
                    0: up >= 0, 1: up == 1, -1: (down == 1) & ((up == 0) | ~ordered[search]),
                }[change]
                may &= want + change >= 0
                key = (node[may] << 32) | (want[may] + change)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                there = keys[at] == key
                found.append(
                    (
                        search[may][there], at[there],
                        up[may][there] - (change == 1), down[may][there] - (change == -1),
                    )
                )
            stack.append((level + 1, *[np.concatenate(parts) for parts in zip(*found)]))


def one_apart(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    i = 0
    while i < len(short) and short[i] == long[i]:
        i += 1
    return short[i + (len(short) == len(long)) :] == long[i + 1 :]


def _sides(words: pa.Array) -> np.ndarray:
    """The first and the last three bytes of every word as numbers."""
    data, offsets = ragged.column(words)
    data = data.astype(np.int64)
    first, last = offsets[:-1], offsets[1:]
    return np.stack(
        [
            data[first] << 16 | data[first + 1] << 8 | data[first + 2],
            data[last - 3] << 16 | data[last - 2] << 8 | data[last - 1],
        ]
    )


def _met(group: pa.Table) -> pa.Table:
    """The near pairs of one block, both ways round."""
    asks = group.column("asks").to_numpy()
    members, searches = group.filter(pa.array(~asks)), group.filter(pa.array(asks))
    out: tuple[list, list, list] = ([], [], [])
    if members.num_rows and searches.num_rows:
        word, near = (t.column("word").combine_chunks() for t in (members, searches))
        trie = Trie(vectors(word))
        down, ordered = (searches.column(c).to_numpy() for c in ("deficit", "ordered"))
        text, asked = word.to_pylist(), near.to_pylist()
        n, asked_n = members.column("n").to_pylist(), searches.column("n").to_pylist()
        # A changed letter leaves one half of a word as it was, which has three letters at least.
        sides, asked_sides = _sides(word), _sides(near)
        for search, member, same in trie.search(vectors(near), down.astype(np.int64), ordered.astype(bool)):
            half = (asked_sides[:, search] == sides[:, member]).any(axis=0)
            search, member, same = search[half], member[half], same[half]
            for s, m, equal in zip(search.tolist(), member.tolist(), same.tolist()):
                a, b = asked[s], text[m]
                if (not equal or a < b) and one_apart(a, b):
                    out[0].extend((a, b))
                    out[1].extend((b, a))
                    out[2].extend((n[m], asked_n[s]))
    return pa.table(
        {
            "word": pa.array(out[0], pa.string()),
            "near": pa.array(out[1], pa.string()),
            "near_n": pa.array(out[2], pa.int64()),
        }
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for all pairs of ``words`` (word, n) that are one letter apart, both ways."""
    sent = common.written(_dealt(words), "spelling-sent")
    sizes = sent.groupBy("key").agg(
        F.ceil(F.count_if(~F.col("asks")) / BLOCK).cast("int").alias("wide"),
        F.ceil(F.count_if("asks") / BLOCK).cast("int").alias("high"),
    ).filter("wide > 0 and high > 0")

    def share(count: str) -> F.Column:
        return F.pmod(F.xxhash64("word"), F.col(count)).cast("int")

    def every(count: str) -> F.Column:
        return F.sequence(F.lit(0), F.col(count) - 1)

    blocks = (
        sent.join(sizes, "key")
        .withColumn("column", F.explode(F.when(F.col("asks"), every("wide")).otherwise(F.array(share("wide")))))
        .withColumn("row", F.explode(F.when(F.col("asks"), F.array(share("high"))).otherwise(every("high"))))
    )
    return blocks.groupBy("key", "column", "row").applyInArrow(_met, PAIRS)


def variants(docs: DataFrame) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n."""
    words = common.written(frequent_words(docs), "spelling-words")
    near = (
        near_pairs(words)
        .groupBy("word")
        .agg(
            F.count("*").alias("n_near"),
            F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"),
        )
    )
    formed = common.written(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(-F.col("best.less") >= F.col("n") * TIMES, F.col("best.near")).alias("form"),
            F.when(-F.col("best.less") >= F.col("n") * TIMES, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    links = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = common.written(
            links.join(further, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root")
            ),
            "spelling-roots",
        )
    return formed.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
