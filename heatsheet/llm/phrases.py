"""Collocations from a weighted de Bruijn graph of words, one graph for each language.

A text, A-Z lowered, is cut into pieces at ``[.,;:!?`` and U+000A to U+000D``]`` and these into words at
spaces and tabs. Nodes are pairs of neighbouring words and edges are triples, the longest
phrases sought: a triple leads from its first pair to its last. An edge weighs as often as it
occurs. Only edges are counted over the corpus; how often a pair occurs follows from the flow out of its
node, the weights of its edges and the pieces that end with it. Those ends are counted as edges to
an end mark.

A phrase that occurs ``LEAST`` times has words that do, so rarer words are one mark, which no node
has, once all words are counted and numbered. This merges edges of a node to rare words and loses none of its
flow; no candidate is lost. Words are told apart by their bytes and phrases by the numbers of words.

A node is unary if one edge comes in and one leaves and both weigh as much as the node. Edges
joined by unary nodes are compacted to a path by pointer doubling; ``path_words`` tells
how many words a candidate's path has. A unary pair is always part of a triple as frequent as itself
and drops out.

Scores are exact: decimals of 38 digits, for counts up to 10^15. A candidate's cut into its
first k words (l occurrences) and the rest (r) gives floor(10^6 a^2 / (l r)); the lowest cut counts, the
smaller k at a tie. Pairs inside a triple with at least half their occurrences drop out. Ranking
takes the first ``TOP`` of each of ``SALTS`` shares of a language before the first of all.

NULL text has no words, NULL language is ``und``. Repeated rows count as often as they stand there;
``doc_id`` is not read. An empty table, or one without candidates, gives no rows. Very long texts and
words are taken whole. Ties in score and count go by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heatsheet.llm import common, ragged, streams

LEAST = 10
TOP = 2000
SALTS = 64
#: A pair drops out if a triple around it has this share of its occurrences, in percent.
INSIDE = 50

# Marks where numbers of words stand; words are numbered from 2.
RARE, END = 0, 1

_CLASSES = np.ones(256, np.uint8)
_CLASSES[[9, 32]] = 0
_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_CLASSES[_BREAKS] = 0

PHRASES = "lang string, w1 long, w2 long, w3 long, f long"
WORDS = "lang string, id long, word string, f long"


def _words(data: np.ndarray, offsets: np.ndarray):
    """Code of every word, the words of every row, which begin a piece, and the distinct words."""
    data = ragged.LOWER[data]
    starts, ends = ragged.runs(_CLASSES[data], offsets)
    rows = ragged.rows_of(starts, offsets)
    piece = np.cumsum(_BREAKS[data])[starts] if len(starts) else np.empty(0, np.int64)
    first = np.ones(len(starts) + 1, bool)
    first[1:-1] = piece[1:] != piece[:-1]
    first[rows] = True
    codes, words = streams.words(data, starts, ends)
    return codes.astype(np.int64), np.diff(rows), first[:-1], words


def _sliced(docs: DataFrame, parts: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = streams.slice_numbers()
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            names = langs.dictionary.to_pylist()
            rank = np.argsort(np.argsort(np.array(names, object)))
            lang = rank[langs.indices.to_numpy(zero_copy_only=False)]
            names.sort()
            slices = ragged.slices(batch.column("text"), streams.SLICE_BYTES)
            for (low, high, data, offsets), number in zip(slices, numbers):
                codes, size, first, words = _words(data, offsets)
                if not len(codes):
                    continue
                # A word of two languages is two entries.
                spoken = np.repeat(lang[low:high], size)
                _, one, entry = streams.group_numbers(spoken, codes)
                of, word = spoken[one], codes[one]
                part = streams.owner_of_words(words, parts)[word]
                counts = np.bincount(entry)
                order, ranges = streams.dealt(of * parts + part)
                stream = streams.pack(entry, first, of, part)
                rows = [(streams.STREAM, number, "", -1, stream)]
                for p, r in ranges:
                    asked = streams.pack_words(words, word[order[r]], counts[order[r]])
                    rows.append((streams.REQUEST, number, names[p // parts], p % parts, asked))
                yield from streams.sent(rows).to_batches()

    return docs.mapInArrow(cut, streams.SENT)


def _number_words(parts: int):
    """Owners of words: numbers of the frequent ones, which they also report, and all words."""

    def answer(key, part, payloads):
        words = pa.concat_arrays([streams.word_array(p[0], p[1]) for p in payloads])
        coded = words.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        counts = np.bincount(which, np.concatenate([p[2] for p in payloads])).astype(np.int64)
        frequent = np.flatnonzero(counts >= LEAST)
        ids = np.full(len(counts), RARE, np.int64)
        ids[frequent] = 2 + np.arange(len(frequent)) * parts + part
        replies, at = [], 0
        for p in payloads:
            replies.append(streams.pack(ids[which[at : at + len(p[1])]]))
            at += len(p[1])
        report = streams.pack_words(
            coded.dictionary, frequent, counts[frequent], ids[frequent]
        )
        return replies, (int(counts.sum()), report)

    return answer


def _reported(replies: DataFrame) -> DataFrame:
    """The frequent words with their numbers and counts."""

    def unpacked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for key, data in zip(batch.column("key").to_pylist(), batch.column("words")):
            text, size, counts, ids = streams.unpack(data.as_buffer())
            yield common.batch(
                lang=pa.array([key] * len(ids), pa.string()),
                id=ids,
                word=streams.word_array(text, size).cast(pa.string()),
                f=counts,
            )

    return common.map_batches(replies.filter("slice < 0").select("key", "words"), WORDS, unpacked)


def _edges(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of frequent words inside a piece, with the word or mark that follows."""
    last = np.append(first[1:], True)
    following = np.where(last, END, np.append(ids[1:], END))
    pair = np.flatnonzero(~last & (ids > END) & (following > END))
    return ids[pair], following[pair], following[pair + 1]


def _ask_edges(parts: int):
    """Slices: the distinct edges of every language with their weights, by the owner of the node."""

    def work(number, stream, found) -> pa.Table:
        entry, first, of, part = stream
        order, _ = streams.dealt(of * parts + part)
        ids = np.empty(len(of), np.int64)
        (ids[order],) = streams.joined(found, 1)
        names = sorted({key for key, _, _ in found})
        rows, ids, lang = [], ids[entry], of[entry]
        for i, code in enumerate(np.unique(of)):
            mine = lang == code
            a, b, c = _edges(ids[mine], first[mine])
            if not len(a):
                continue
            _, one, which = streams.group_numbers(a, b, c)
            a, b, c, weight = a[one], b[one], c[one], np.bincount(which)
            mixed = ragged.mix(ragged.mix(a.astype(np.uint64)) + b.astype(np.uint64))
            by_owner, ranges = streams.dealt((mixed % np.uint64(parts)).astype(np.int64))
            for p, r in ranges:
                at = by_owner[r]
                packed = streams.pack(np.diff(a[at], prepend=0), b[at], c[at], weight[at])
                rows.append((number, names[i], p, packed))
        return streams.rows(rows)

    return work


def _weighed(group: pa.Table) -> pa.Table:
    """Owners of nodes: frequent pairs, by the flow out of them, and frequent triples."""
    lang = group.column("key")[0].as_py()
    payloads = [streams.unpack(d.as_buffer()) for d in group.column("data")]
    a = np.concatenate([np.cumsum(p[0]) for p in payloads])
    b, c, weight = (np.concatenate([p[i] for p in payloads]) for i in (1, 2, 3))
    del payloads
    _, one, which = streams.group_numbers(a, b, c)
    weight = np.bincount(which, weight).astype(np.int64)
    a, b, c = a[one], b[one], c[one]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    node = np.flatnonzero(new)
    flow = np.add.reduceat(weight, node)
    pairs, triples = node[flow >= LEAST], np.flatnonzero((weight >= LEAST) & (c > END))
    at = np.concatenate([pairs, triples])
    return pa.table(
        {
            "lang": pa.array([lang] * len(at), pa.string()),
            "w1": a[at],
            "w2": b[at],
            "w3": np.concatenate([np.zeros(len(pairs), np.int64), c[triples]]),
            "f": np.concatenate([flow[flow >= LEAST], weight[triples]]),
        }
    )


def graph(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (lang, id, word, f), frequent phrases by their words' numbers (lang, w1, w2, w3, f;
    w3 is 0 for a pair), and the words of each language (lang, n), all written."""
    plain = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    parts = streams.owners(plain)
    texts, requests = streams.written_by_kind(_sliced(plain, parts), "phrase-texts")
    replies = common.written(
        streams.answers(requests, _number_words(parts), "n long, words binary"), "phrase-words"
    )
    words = common.written(_reported(replies), "phrase-frequent")
    totals = replies.filter("slice < 0").groupBy(F.col("key").alias("lang")).agg(F.sum("n").alias("n"))
    edges = streams.regrouped(texts, replies, _ask_edges(parts), streams.ROWS)
    phrases = edges.groupBy("key", "part").applyInArrow(_weighed, PHRASES)
    return words, common.written(phrases, "phrase-graph"), totals


def _node(name: str, *words: str) -> F.Column:
    return F.struct("lang", *[F.col(w).alias(f"n{i}") for i, w in enumerate(words)]).alias(name)


def path_lengths(pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """``triples`` with ``path_words``, the words of the compacted path of each.

    ``pairs`` have ``unary``. Every triple points to the next one of its path; pointers are
    doubled until all point to the last, so the rounds follow the logarithm of the longest path, which is
    no longer than a piece of text.
    """
    edge = F.struct("lang", "w1", "w2", "w3")
    start, end = _node("start", "w1", "w2"), _node("end", "w2", "w3")
    inner = pairs.filter("unary").select(_node("node", "w1", "w2"))
    following = (
        triples.select(start, edge.alias("next")).join(inner, F.col("start") == F.col("node"))
    ).select("start", "next")
    pointers = common.written(
        triples.select(edge.alias("edge"), end)
        .join(following, F.col("end") == F.col("start"), "left")
        .select("edge", F.coalesce("next", "edge").alias("last")),
        "path-pointers",
    )
    while True:
        step = pointers.select(F.col("edge").alias("last"), F.col("last").alias("further"))
        doubled = common.written(
            pointers.join(step, "last").select(
                "edge", F.col("further").alias("last"), (F.col("further") != F.col("last")).alias("moved")
            ),
            "path-pointers",
        )
        common.forget(pointers)
        pointers = doubled.select("edge", "last")
        if doubled.filter("moved").isEmpty():
            break
    sizes = pointers.groupBy("last").agg((F.count("*") + 2).alias("path_words"))
    found = pointers.join(sizes, "last").select("edge", "path_words")
    return triples.join(found, edge == F.col("edge")).drop("edge")


def _score(l: str, r: str) -> F.Column:
    def whole(c: str) -> str:
        return f"cast({c} as decimal(15,0))"

    return F.expr(
        f"(cast(1000000 as decimal(7,0)) * ({whole('f')} * {whole('f')}))"
        f" div ({whole(l)} * {whole(r)})"
    )


def _with_words(phrases: DataFrame, words: DataFrame, place: str, name: str, count: str) -> DataFrame:
    """``phrases`` with the word whose number is in ``place`` and its count."""
    found = words.select("lang", F.col("id").alias(place), F.col("word").alias(name), F.col("f").alias(count))
    return phrases.join(found, ["lang", place])


def candidates(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """All candidates that no longer one replaces, with their best cut."""
    pairs, triples = phrases.filter("w3 = 0").drop("w3"), phrases.filter("w3 > 0")
    incoming = triples.groupBy("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(
        F.max("f").alias("f_in")
    )
    outgoing = triples.groupBy("lang", "w1", "w2").agg(F.max("f").alias("f_out"))
    nodes = (
        pairs.join(incoming, ["lang", "w1", "w2"], "left")
        .join(outgoing, ["lang", "w1", "w2"], "left")
        .select(
            *pairs.columns,
            F.coalesce((F.col("f_in") == F.col("f")) & (F.col("f_out") == F.col("f")), F.lit(False)).alias("unary"),
            F.greatest(F.coalesce("f_in", F.lit(0)), F.coalesce("f_out", F.lit(0))).alias("longer"),
        )
    )
    named = _with_words(_with_words(nodes, words, "w1", "word1", "f1"), words, "w2", "word2", "f2")
    named = common.written(named, "phrase-pairs")
    alone = named.filter(F.col("longer") * 100 < F.col("f") * INSIDE).select(
        "lang",
        F.concat_ws(" ", "word1", "word2").alias("phrase"),
        F.col("f").alias("a"),
        F.col("f1").alias("l"),
        F.col("f2").alias("r"),
        _score("f1", "f2").alias("score"),
        F.lit(2).cast("long").alias("path_words"),
    )
    left = named.select(
        "lang", "w1", "w2", "word1", "word2", F.col("f1"), F.col("f").alias("f12")
    )
    right = named.select(
        "lang",
        F.col("w1").alias("w2"),
        F.col("w2").alias("w3"),
        F.col("word2").alias("word3"),
        F.col("f2").alias("f3"),
        F.col("f").alias("f23"),
    )
    cut = (
        path_lengths(named, triples)
        .join(left, ["lang", "w1", "w2"])
        .join(right, ["lang", "w2", "w3"])
        .withColumns({"s1": _score("f1", "f23"), "s2": _score("f12", "f3")})
    )
    early = F.col("s1") <= F.col("s2")
    return alone.unionByName(
        cut.select(
            "lang",
            F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"),
            F.col("f").alias("a"),
            F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
            F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"),
            F.least("s1", "s2").alias("score"),
            "path_words",
        )
    )


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score, path_words."""
    words, phrases, totals = graph(docs)
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = Window.partitionBy("lang", "salt").orderBy(*best)
    firsts = (
        candidates(words, phrases)
        .withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        .withColumn("rank", F.row_number().over(salted))
        .filter(F.col("rank") <= top)
    )
    ranked = firsts.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")
    ).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score", "path_words"
    )
