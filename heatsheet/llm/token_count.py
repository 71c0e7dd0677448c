"""Number of tokens of a text under a unigram vocabulary, without making the tokens.

The best segmentation by Viterbi: an Aho-Corasick automaton lists the vocabulary pieces that end
at every character; for every position the best score of what stands before and its number
of pieces are carried along. The rules are those of the tokenizers library's unigram model:
of equal scores the earlier start wins, a character without a piece of its own costs ten below
the lowest score, and it counts one token for each of its bytes (byte fallback).

A text gets a space in front and spaces stand for the vocabulary's word mark. Where two bytes
follow one another that no piece holds side by side, no piece can lie across; texts are cut
there and each different part is segmented once by a worker. Scores are summed inside a part,
which changes nothing as long as they are whole numbers, as in this vocabulary.

A NULL or empty text has no tokens. Every row gives a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from heatsheet.llm import common, ragged

MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_COST = 10.0
REMEMBERED = 2_000_000


def vocabulary(model: str = MODEL) -> list[tuple[str, float]]:
    """The pieces of ordinary text and their scores."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    return [
        (m.id_to_piece(i), m.get_score(i))
        for i in range(m.get_piece_size())
        if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))
    ]


class Counter:
    """A vocabulary and the parts counted so far."""

    _made: dict = {}

    @classmethod
    def of(cls, model: str) -> Counter:
        if model not in cls._made:
            cls._made[model] = cls(vocabulary(model))
        return cls._made[model]

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        self.lone = min((s for _, s in pieces), default=0.0) - UNKNOWN_COST
        self.cut = np.ones((256, 256), bool)
        for piece, score in pieces:
            piece = piece.replace(MARK, " ")
            self.automaton.add_word(piece, (len(piece), score))
            raw = np.frombuffer(piece.encode(), np.uint8)
            self.cut[raw[:-1], raw[1:]] = False
        self.cut[:, 0x80:0xC0] = False  # inside a character
        self.automaton.make_automaton()
        self.hashes, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def segment(self, text: str) -> int:
        """The number of pieces of the best segmentation. Matches come in order of their
        ends; ``top`` and ``n`` belong to the best way to the end of character ``at``."""
        best, many, lone = [0.0], [0], self.lone
        at, top, n, origin, single = 0, None, 0, 0, False

        def close() -> None:
            nonlocal at, top, n, single
            if not single:
                score = best[at] + lone
                if top is None or score > top:
                    top, n = score, many[at] + len(text[at].encode())
            best.append(top)
            many.append(n)
            at, top, single = at + 1, None, False

        for end, (size, score) in self.automaton.iter(text):
            while at < end:
                close()
            start = end + 1 - size
            score += best[start]
            if top is None or score > top or score == top and start < origin:
                top, n, origin = score, many[start] + 1, start
            if size == 1:
                single = True
        while at < len(text):
            close()
        return many[-1]

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of every row."""
        if len(self.hashes) > REMEMBERED:
            self.hashes, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        filled = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][filled], 32)
        offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
        edge = np.zeros(len(data) + 1, bool)
        if len(data):
            edge[1:-1] = self.cut[data[:-1], data[1:]]
        edge[offsets] = True
        starts = np.flatnonzero(edge)
        rows = np.searchsorted(starts, offsets)
        starts, ends = starts[:-1], starts[1:]
        if not len(starts):
            return np.zeros(len(offsets) - 1, np.int64)
        hashes = ragged.hash_runs(data, starts, ends)
        different, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, different)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == different[known]
        if not known.all():
            new, raw = np.flatnonzero(~known), data.tobytes()
            counts = [
                self.segment(raw[starts[i] : ends[i]].decode("utf-8", "replace"))
                for i in first[new].tolist()
            ]
            self.hashes = np.insert(self.hashes, at[new], different[new])
            self.counts = np.insert(self.counts, at[new], counts)
            at = np.searchsorted(self.hashes, different)
        sums = np.concatenate([[0], np.cumsum(self.counts[at][which])])[rows]
        return np.diff(sums)


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counter, ids = Counter.of(model), batch.column("doc_id")
        for low, high, data, offsets in ragged.slices(batch.column("text"), 4 << 20):
            if MARK.encode() in data.tobytes():
                plain = [t.replace(MARK, " ") for t in batch.column("text").slice(low, high - low).to_pylist()]
                counts = counter.count(*ragged.column(pa.array(plain, pa.string())))
            else:
                counts = counter.count(data, offsets)
            yield common.batch(
                doc_id=ids.slice(low, high - low), n_bytes=np.diff(offsets), n_tokens=counts
            )

    return common.map_batches(common.texts(docs), "doc_id long, n_bytes long, n_tokens long", work)
