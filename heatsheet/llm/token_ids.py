"""Token ids of whole texts, looked up piece by piece.

Neither public tokenizer joins white space to what stands before it, a letter to punctuation
after it, or a lone line feed to what follows. Texts are cut there; each different piece is encoded once by the library and remembered under
its 64-bit hash, and a text's ids are those of its pieces, one after another.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa

from heatsheet.llm import ragged

#: Pieces that a worker remembers, about 40 bytes each. Beyond it the memory starts anew.
REMEMBERED = 500_000
#: Text bytes encoded at once; a worker takes some 90 bytes of memory for each.
TEXT_BYTES = 256 << 10
#: Words given to the library as one text. To a tokenizer of words these letters are one word,
#: in capitals or not, and spaces around it are nothing.
TOGETHER = 100
_WORD = re.compile(" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+").fullmatch

#: After these bytes a space may follow white space: blanks, and the last two bytes of the
#: characters of white space beyond ASCII.
_BLANK, _LAST, _BEFORE_LAST, _LETTER, _MARK, _LEAD, _TRAIL = (np.uint8(1 << i) for i in range(7))
_KIND = np.zeros(256, np.uint8)
_KIND[:33] |= _BLANK
_KIND[[0x85, 0xA0, 0xA8, 0xA9, 0xAF, 0x9F, *range(0x80, 0x8B)]] |= _LAST
_KIND[[0xC2, 0x9A, 0x80, 0x81]] |= _BEFORE_LAST
_KIND[65:91] |= _LETTER
_KIND[97:123] |= _LETTER
for _low, _high in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _KIND[_low:_high] |= _MARK
# The two-byte letters from U+00C0 on, without the signs of multiplication and division.
_KIND[0xC3] |= _LEAD
_KIND[0x80:] |= _TRAIL
_KIND[[0x97, 0xB7]] &= ~_TRAIL
_KINDS, _1 = _KIND.tobytes(), np.uint8(1)


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every piece (and the end of the last), and the offsets of every row's."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        kind = np.frombuffer(data.tobytes().translate(_KINDS), np.uint8)
        # _BEFORE_LAST is one bit above _LAST, _LEAD one below _TRAIL.
        before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
        filled = (kind & _BLANK | (kind & (before >> _1)) & _LAST) == 0
        letter = (kind & _LETTER | (kind & (before << _1)) & _TRAIL) != 0
        feed, mark = data == 10, (kind & _MARK) != 0
        cut[1:-1] = filled[:-1] & ((data[1:] == 32) | feed[1:]) | letter[:-1] & mark[1:]
        cut[2:-1] |= filled[:-2] & feed[1:-1] & ((kind[2:] & (_LETTER | _MARK)) != 0)
        cut[offsets] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, offsets)


def folded(data: np.ndarray) -> np.ndarray:
    """A-Z lowered, but not before a byte beyond ASCII, with which a letter may be one character."""
    upper = data - np.uint8(65) < 26
    upper[:-1] &= data[1:] < 128
    return data | upper.view(np.uint8) << np.uint8(5)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, where each stands first, and the place of every hash among
    them. Sorting hashes that carry their place in the low bits is faster than sorting places."""
    low = (1 << len(hashes).bit_length()) - 1
    places = np.arange(len(hashes), dtype=np.uint64)
    order = (np.sort(hashes & np.uint64(~low & (1 << 64) - 1) | places) & np.uint64(low)).view(np.int64)
    found = hashes[order]
    new = np.concatenate([np.ones(1, bool), found[1:] != found[:-1]])[: len(found)]
    different = found[new]
    if (different[1:] <= different[:-1]).any():  # hashes that differ in the low bits alone
        return np.unique(hashes, return_index=True, return_inverse=True)
    which = np.empty(len(hashes), np.int64)
    which[order] = np.cumsum(new) - 1
    return different, order[new], which


class Encoder:
    """One tokenizer with the pieces it has encoded so far."""

    _made: dict = {}

    @classmethod
    def of(cls, name: str, remembered: int = REMEMBERED, words: bool = False) -> Encoder:
        """The worker's encoder for a tokenizer file that remembers so many pieces. ``words`` says
        that the tokenizer lower-cases and marks the ids that end a word."""
        if (name, remembered, words) not in cls._made:
            cls._made[name, remembered, words] = cls(name, remembered, words)
        return cls._made[name, remembered, words]

    def __init__(self, name: str, remembered: int = REMEMBERED, words: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.library.encode_special_tokens = True
        self.kind = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.remembered, self.ends_word = remembered, None
        if words:
            self.ends_word = np.zeros(self.library.get_vocab_size(), bool)
            mark = self.library.model.end_of_word_suffix
            self.ends_word[[i for token, i in self.library.get_vocab().items() if token.endswith(mark)]] = True
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.empty(0, np.uint64)  # sorted
        self.begin = np.empty(0, np.int64)
        self.size = np.empty(0, np.int32)
        self.ids = np.empty(1 << 16, self.kind)
        self.used = 0

    def _found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of these texts and how many each has."""
        found = []
        for low in range(0, len(texts), 20_000):
            found += [
                e.ids
                for e in self.library.encode_batch_fast(
                    texts[low : low + 20_000], add_special_tokens=False
                )
            ]
        size = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter(chain.from_iterable(found), self.kind, int(size.sum())), size

    def _found_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words, many given to the library as one text."""
        joined = [" ".join(texts[low : low + TOGETHER]) for low in range(0, len(texts), TOGETHER)]
        ids, _ = self._found(joined)
        size = np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1).astype(np.int32)
        return (ids, size) if len(size) == len(texts) else self._found(texts)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        if self.ends_word is None:
            ids, size = self._found(texts)
        else:
            word = np.array([_WORD(t) is not None for t in texts])
            order = np.argsort(~word, kind="stable")
            hashes, n = hashes[order], int(word.sum())
            texts = [texts[i] for i in order.tolist()]
            ids, size = map(np.concatenate, zip(self._found_words(texts[:n]), self._found(texts[n:])))
        total = len(ids)
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(total, len(self.ids)), self.kind)])
        self.ids[self.used : self.used + total] = ids
        begin = self.used + np.cumsum(size) - size
        self.used += total
        if self.ends_word is not None:
            order = np.argsort(hashes)
            hashes, begin, size = hashes[order], begin[order], size[order]
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.begin = np.insert(self.begin, at, begin)
        self.size = np.insert(self.size, at, size)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and the offsets of every row's."""
        if len(self.hashes) > self.remembered:
            self._forget()
        if self.ends_word is not None:
            data = folded(data)
        starts, rows = pieces(data, offsets)
        starts, ends = starts[:-1], starts[1:]
        if not len(starts):
            return np.empty(0, self.kind), np.zeros(len(offsets), np.int64)
        hashes = ragged.hash_runs(data, starts, ends)
        different, first, which = distinct(hashes)
        at = np.searchsorted(self.hashes, different)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == different[known]
        if not known.all():
            new, raw = np.flatnonzero(~known), data.tobytes()
            self._learn(
                different[new],
                [raw[starts[i] : ends[i]].decode() for i in first[new].tolist()],
            )
            at = np.searchsorted(self.hashes, different)
        begin, size = self.begin[at][which], self.size[at][which].astype(np.int64)
        ids = self.ids[ragged.spread(begin, size)]
        return ids, np.concatenate([[0], np.cumsum(size)])[rows]


def encoded(
    column: pa.Array,
    name: str,
    text_bytes: int = TEXT_BYTES,
    remembered: int = REMEMBERED,
    words: bool = False,
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a column: first row, end row, ids, offsets of every row's ids."""
    encoder = Encoder.of(name, remembered, words)
    for low, high, data, offsets in ragged.slices(column, text_bytes):
        yield low, high, *encoder.encode(data, offsets)
