"""Log-probabilities of whole texts by a weighted backoff automaton over words.

Tokens are the words of a text, A-Z lowered and cut at blanks, and one end after the last. Learning
texts give the counts: ``c(w)`` of a token, ``c(hw)`` of a token after another (or after an end, for the
first of a text), ``N`` of all, ``V`` distinct. The root gives a token

    p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),

the base score. Bigrams are smoothed towards it by a Dirichlet prior of ``PRIOR`` tokens,

    p(w | h) = (c(hw) + PRIOR p(w)) / (c(h) + PRIOR),

which sums to one over all words. As an automaton: every learnt token is a state, and so is the root. A seen
bigram is an arc from ``h`` to ``w`` that weighs log p(w | h). Every state fails to the root at
log(PRIOR / (c(h) + PRIOR)), which is exactly what a pair that was never seen lacks. A
text is read from left to right, starting in the state of an end; every token takes an arc, or
the failure arc and then the root's, and its weights are added up.

The model grows with the corpus and is never gathered. A slice of texts asks the owners of words, then of
pairs, for the counts of those it holds (see ``streams``) and builds the part of the
automaton that its texts can reach. Words are told apart by their bytes and pairs by the numbers of
their words, not by hashes. Long texts are read in lanes of ``LANE`` tokens side by side; a lane
first reads the token before it, which alone decides its state.

NULL text is empty: one end. A NULL ``doc_id`` is not held out. Repeated rows are scored and
learnt one by one, whatever their ids. Without learning texts every score is
log10(0.5 / 0.5) = 0. An empty table gives none. Very long texts are read whole, one slice each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatsheet.llm import common, ragged, streams

#: Tokens that the prior weighs as much as.
PRIOR = 200.0
#: Tokens that are read one after another; longer texts are read in several lanes at once.
LANE = 256

RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
)


def held_out(doc_id) -> F.Column:
    """The fifth of documents that teaches nothing. A NULL id belongs to the rest."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all tokens, the tokens of every row, and the distinct words; an end is ''."""
    data = ragged.LOWER[data]
    starts, ends = ragged.runs(ragged.BLANK_SEPARATED[data], offsets)
    rows = ragged.rows_of(starts, offsets)
    codes, words = streams.words(data, starts, ends)
    words = pa.concat_arrays([words, pa.array([""], words.type)])
    codes = np.insert(codes.astype(np.int64), rows[1:], len(words) - 1)
    return codes, np.diff(rows) + 1, words


def _sliced(docs: DataFrame, parts: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = streams.slice_numbers()
        for batch in batches:
            held_out = batch.column("held_out").to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id")
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            slices = ragged.slices(batch.column("text"), streams.SLICE_BYTES)
            for (low, high, data, offsets), number in zip(slices, numbers):
                codes, size, words = _tokens(data, offsets)
                teaches = np.repeat(~held_out[low:high], size)
                counts = np.bincount(codes[teaches], minlength=len(words))
                part = streams.owner_of_words(words, parts)
                stream = streams.pack(
                    ids[low:high], missing[low:high], held_out[low:high], size, codes, part
                )
                order, ranges = streams.dealt(part)
                rows = [(streams.STREAM, number, "", -1, stream)]
                rows += [
                    (streams.REQUEST, number, "", p, streams.pack_words(words, order[r], counts[order[r]]))
                    for p, r in ranges
                ]
                yield from streams.sent(rows).to_batches()

    return docs.mapInArrow(cut, streams.SENT)


def _number_words(parts: int):
    """Owners of words: their numbers and counts; tokens and distinct words of learning texts."""

    def answer(key, part, payloads):
        words = pa.concat_arrays([streams.word_array(p[0], p[1]) for p in payloads])
        which = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        counts = np.bincount(which, np.concatenate([p[2] for p in payloads])).astype(np.int64)
        which, at = which.astype(np.int64), 0
        replies = []
        for p in payloads:
            mine = which[at : at + len(p[1])]
            replies.append(streams.pack(mine * parts + part, counts[mine]))
            at += len(p[1])
        return replies, (int(counts.sum()), int((counts > 0).sum()))

    return answer


def _pairs(codes: np.ndarray, size: np.ndarray, end: int, width: int):
    """Every token with the one before it in its text, as one number; the first follows an end."""
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[(np.cumsum(size) - size)] = end
    return before, before * width + codes


def _owner_of_pairs(ids: np.ndarray, pairs: np.ndarray, parts: int) -> np.ndarray:
    first, second = ids[pairs // len(ids)], ids[pairs % len(ids)]
    mixed = ragged.mix(ragged.mix(first.astype(np.uint64)) + second.astype(np.uint64))
    return (mixed % np.uint64(parts)).astype(np.int64)


def _ask_pairs(parts: int):
    """Slices: words by their numbers, and the distinct pairs of them with their own counts."""

    def work(number, stream, found) -> pa.Table:
        doc_ids, missing, held, size, codes, part = stream
        order, _ = streams.dealt(part)
        ids, counts = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
        ids[order], counts[order] = streams.joined(found, 2)
        # Local codes in the order of the numbers, so that pairs are sorted by them too.
        rank = np.argsort(ids)
        renamed = np.empty(len(ids), np.int64)
        renamed[rank] = np.arange(len(ids))
        end = int(renamed[-1])
        ids, counts, codes = ids[rank], counts[rank], renamed[codes]
        _, pairs = _pairs(codes, size, end, len(ids))
        different, which = np.unique(pairs, return_inverse=True)
        teaches = np.repeat(~held, size)
        own = np.bincount(which[teaches], minlength=len(different))
        owner = _owner_of_pairs(ids, different, parts)
        order, ranges = streams.dealt(owner)
        stream = streams.pack(
            doc_ids, missing, held, size, codes, np.diff(ids, prepend=0), counts, np.array([end])
        )
        rows = [(streams.STREAM, number, "", -1, stream)]
        first, second = ids[different // len(ids)], ids[different % len(ids)]
        for p, r in ranges:
            at = order[r]
            packed = streams.pack(np.diff(first[at], prepend=0), second[at], own[at])
            rows.append((streams.REQUEST, number, "", p, packed))
        return streams.sent(rows)

    return work


def _count_pairs(key, part, payloads):
    """Owners of pairs: how often learning texts have them."""
    first = np.concatenate([np.cumsum(p[0]) for p in payloads])
    second = np.concatenate([p[1] for p in payloads])
    _, _, which = streams.group_numbers(first, second)
    counts = np.bincount(which, np.concatenate([p[2] for p in payloads])).astype(np.int64)
    replies, at = [], 0
    for p in payloads:
        replies.append(streams.pack(counts[which[at : at + len(p[1])]]))
        at += len(p[1])
    return replies, ()


class Automaton:
    """States 0 to ``width`` - 1 are words, ``width`` is the root."""

    def __init__(self, counts, pairs, pair_counts, tokens: int, distinct: int, prior: float):
        self.width = len(counts)
        p = (counts + 0.5) / (tokens + 0.5 * (distinct + 1))
        seen = pair_counts > 0
        self.arcs = pairs[seen]
        from_, to = self.arcs // self.width, self.arcs % self.width
        self.arc_weight = np.log10(
            (pair_counts[seen] + prior * p[to]) / (counts[from_] + prior)
        )
        self.root_weight = np.log10(p)
        self.fail_weight = np.append(np.log10(prior / (counts + prior)), 0.0)
        # A word that was not learnt is no state: after it the automaton is at the root.
        self.after = np.where(counts > 0, np.arange(self.width), self.width)

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Weights of reading one word in each state, failing to the root where no arc is."""
        if not len(self.arcs):
            return self.fail_weight[state] + self.root_weight[word]
        key = state * self.width + word
        at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
        known = (self.arcs[at] == key) & (state < self.width)
        failed = self.fail_weight[state] + self.root_weight[word]
        return np.where(known, self.arc_weight[at], failed)

    def read(self, codes: np.ndarray, size: np.ndarray, end: int) -> np.ndarray:
        """The sum of weights along each text of ``size`` codes."""
        lanes = -(-size // LANE)
        text = np.repeat(np.arange(len(size)), lanes)
        within = ragged.spread(np.zeros(len(size), np.int64), lanes) * LANE
        start = (np.cumsum(size) - size)[text] + within
        length = np.minimum(size[text] - within, LANE)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        state = self.after[np.where(within[order] > 0, codes[np.maximum(start - 1, 0)], end)]
        total = np.zeros(len(start))
        active = np.searchsorted(-length, -np.arange(LANE), side="left")
        for t in range(LANE):
            m = int(active[t])
            if not m:
                break
            word = codes[start[:m] + t]
            total[:m] += self.step(state[:m], word)
            state[:m] = self.after[word]
        return np.bincount(text[order], total, minlength=len(size))


def _score(parts: int, tokens: int, distinct: int, prior: float):
    def work(number, stream, found) -> pa.Table:
        doc_ids, missing, held, size, codes, ids, counts, end = stream
        end, ids = int(end[0]), np.cumsum(ids)
        _, pairs = _pairs(codes, size, end, len(ids))
        different = np.unique(pairs)
        order, _ = streams.dealt(_owner_of_pairs(ids, different, parts))
        pair_counts = np.empty(len(different), np.int64)
        (pair_counts[order],) = streams.joined(found, 1)
        automaton = Automaton(counts, different, pair_counts, tokens, distinct, prior)
        text = np.repeat(np.arange(len(size)), size)
        base = np.bincount(text, automaton.root_weight[codes], minlength=len(size))
        known = np.bincount(text, counts[codes] > 0, minlength=len(size))
        return pa.table(
            {
                "doc_id": pa.array(doc_ids, mask=missing),
                "held_out": pa.array(held),
                "n_tokens": pa.array(size),
                "n_known": pa.array(known.astype(np.int64)),
                "base_score": pa.array(base),
                "score": pa.array(automaton.read(codes, size, end)),
            }
        )

    return work


def log_probabilities(docs: DataFrame, prior: float = PRIOR) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known (tokens that were learnt),
    train_tokens, base_score and score (log10)."""
    plain = common.texts(docs).withColumn("held_out", held_out(F.col("doc_id")))
    parts = streams.owners(plain)
    texts, requests = streams.written_by_kind(_sliced(plain, parts), "lm-texts")
    replies = common.written(
        streams.answers(requests, _number_words(parts), "tokens long, words long"), "lm-words"
    )
    streams.forget_requests(requests)
    totals = replies.agg(
        F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))
    ).first()
    numbered, pairs = streams.written_by_kind(
        streams.regrouped(texts, replies, _ask_pairs(parts), streams.SENT), "lm-numbered"
    )
    for done in (texts, replies):
        common.forget(done)
    counted = common.written(streams.answers(pairs, _count_pairs), "lm-counted")
    streams.forget_requests(pairs)
    scored = streams.regrouped(numbered, counted, _score(parts, *totals, prior), RESULT)
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(totals[0]).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
