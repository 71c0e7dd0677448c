"""A context-mixing range coder for token ids.

A head numbers the ids that occur by falling frequency and holds their shares of all ids. The
numbers are cut into blocks of ``BLOCK``. Every block is coded from a fresh state and has its own
checksum, so with the head any of them can be read or found damaged alone. One step codes one
id in each block of a file at once, as vectors with one element for each block.

The chance of the next id mixes three predictions:

- order 2 and order 1: a table has, for the last two ids and for the last one, the id that
  followed last time and how often in a row it was right; an adaptive hit rate for each such
  confidence says how much of the interval the predicted id gets. Where both predict the same
  id, order 1 gets nothing;
- order 0: the shares of the head divide what the two predictions leave.

The interval is dealt out in this order: the id that order 2 predicts, the one order 1
predicts, all ids by order 0.

The mixed chances drive an arithmetic coder of 64 bits that puts out 32 at a time.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 4096
_SLOTS = 12
#: Bits of the whole interval, of a hit rate, and of order 0 at most: the rates leave it so many.
_TOTAL, _RATE, _MOST = 28, 16, 20
_SURE = 7
#: Steps whose slots and intervals the encoder works out together.
_STEPS = 16

_u = np.uint64
_WHOLE, _ONE = _u(1 << _TOTAL), _u(1 << _RATE)
_TO_TOTAL, _FROM_BOTH, _TOTAL_BITS = _u(_TOTAL - _RATE), _u(2 * _RATE - _TOTAL), _u(_TOTAL)
_WORD, _WORD_BITS, _FULL = _u(1 << 32), _u(32), _u((1 << 64) - 1)
_MASK, _UP, _MISSED = np.int32(_SURE), np.int32(3), np.int32(2 * _SURE + 2)
#: What becomes of a confidence and of its hit rate: twice the confidence after a hit, 16 more than
#: it after a miss. A prediction that was not right twice in a row is replaced by the id that came.
_REPLACED = np.int32(-_SURE - 1)
_CHANGE = np.zeros(3 * _SURE + 3, np.int32)
_CHANGE[0 : 2 * _SURE : 2] = 1
_CHANGE[_MISSED:] = [(n >> 1) - n if n > 1 else _REPLACED for n in range(_SURE + 1)]
_GAIN = np.full(3 * _SURE + 3, 3840)
_GAIN[_MISSED:] = 4


def _shares(counts: np.ndarray) -> tuple[int, np.ndarray]:
    """Bits of the whole, and the part of it that each id gets: one at least."""
    bits = max(16, min(_MOST, (len(counts) - 1).bit_length() + 4))
    if len(counts) > 1 << bits:
        raise ValueError("the vocabulary is too large for this coder")
    spare = (1 << bits) - len(counts)
    share = 1 + (counts.astype(np.uint64) * _u(spare) // _u(int(counts.sum()))).astype(np.int64)
    share[0] += (1 << bits) - int(share.sum())
    return bits, share


def _head(order: np.ndarray, counts: np.ndarray) -> bytes:
    body = np.array([order, counts], "<u4").tobytes()
    return zlib.crc32(body).to_bytes(4, "little") + zlib.compress(body)


def _read_head(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    try:
        body = zlib.decompress(raw[4:])
    except zlib.error as e:
        raise ValueError("the head is damaged") from e
    if zlib.crc32(body).to_bytes(4, "little") != raw[:4]:
        raise ValueError("the head is damaged")
    order, counts = np.frombuffer(body, "<u4").reshape(2, -1)
    return order, counts


class _Mix:
    """What all blocks have seen so far. Rows of two are order 1 and order 2."""

    def __init__(self, blocks: int, counts: np.ndarray) -> None:
        bits, share = _shares(counts)
        self.bits, self.top = _u(bits), _u((1 << bits) - 1)
        self.share = share.astype(np.uint64)
        self.below = np.cumsum(self.share) - self.share
        ids = np.arange(1, len(counts) + 1, dtype=np.uint64)
        self.hash1 = (ids * _u(0x9E3779B97F4A7C15) >> _u(64 - _SLOTS)).astype(np.int64)
        self.hash2 = (ids * _u(0xC2B2AE3D27D4EB4F) >> _u(64 - _SLOTS)).astype(np.int64)
        # The id that is expected and, in the low bits, its confidence.
        self.table = np.zeros(2 * blocks << _SLOTS, np.int32)
        self.rows = (np.arange(2 * blocks, dtype=np.int64) << _SLOTS).reshape(2, blocks)
        self.rate = np.tile(np.linspace(1 << 10, 7 << 13, _SURE + 1).astype(np.int64), 2 * blocks)
        self.row_p = (np.arange(2 * blocks, dtype=np.int64) * (_SURE + 1)).reshape(2, blocks)

    def look(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of both orders at these slots, and their rates of 65536."""
        self.at, self.entry = at, self.table.take(at, mode="wrap")
        self.sure = self.entry & _MASK
        self.p = self.row_p + self.sure
        self.r = self.rate.take(self.p, mode="wrap")
        return self.entry, self.r

    def learn(self, shifted: np.ndarray) -> None:
        """Take over the ids that came, given three bits up."""
        state = (np.minimum(self.entry ^ shifted, _MISSED) + self.sure).astype(np.int64)
        change = _CHANGE.take(state, mode="wrap")
        self.table[self.at] = np.where(change == _REPLACED, shifted, self.entry + change)
        self.rate[self.p] = self.r - (self.r >> 4) + _GAIN.take(state, mode="wrap")


def _weights(guess1, guess2, rate1, rate2) -> tuple[np.ndarray, np.ndarray]:
    """What order 1 and order 2 get of the interval."""
    one = (_ONE - rate2) * rate1 >> _FROM_BOTH
    return one * (guess1 != guess2), rate2 << _TO_TOTAL


def _blocks(n_ids: int) -> int:
    return -(-n_ids // BLOCK)


def encode(ids: np.ndarray, vocabulary: int) -> list[bytes]:
    """The head and the blocks of ``ids``: a checksum of the ids and the coded words."""
    blocks = _blocks(len(ids))
    if not blocks:
        return []
    counts = np.bincount(ids, minlength=vocabulary)
    if len(counts) > vocabulary:
        raise ValueError("an id is beyond the vocabulary")
    order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    number = np.zeros(vocabulary, np.int32)
    number[order] = np.arange(len(order))
    counts = counts[order]
    table = np.zeros(blocks * BLOCK, np.int32)
    np.take(number, ids, out=table[: len(ids)])
    table = np.ascontiguousarray(table.reshape(blocks, BLOCK).T)
    mix = _Mix(blocks, counts)
    words = np.zeros((blocks, BLOCK + 8), np.uint32)
    flat, width = words.ravel(), words.shape[1]
    at = np.arange(blocks, dtype=np.int64) * width + 1  # the first word takes no carry
    low, span = np.zeros(blocks, np.uint64), np.full(blocks, _FULL)
    first, second = np.zeros((1, blocks), np.int64), np.zeros((2, blocks), np.int64)
    for step in range(0, min(len(ids), BLOCK), _STEPS):
        x = table[step : min(step + _STEPS, len(ids))]
        first = np.concatenate([first[-1:], mix.hash1.take(x)])
        second = np.concatenate([second[-2:], mix.hash2.take(x)])
        slots = np.stack([first[:-1], first[:-1] ^ second[:-2]], axis=1) + mix.rows
        shifted = x << _UP
        entries, rates = np.empty(slots.shape, np.int32), np.empty(slots.shape, np.int64)
        for k in range(len(x)):
            entries[k], rates[k] = mix.look(slots[k])
            mix.learn(shifted[k])
        guesses, rates = entries >> _UP, rates.view(np.uint64)
        one, two = _weights(guesses[:, 0], guesses[:, 1], rates[:, 0], rates[:, 1])
        taken = one + two
        unit = (_WHOLE - taken) >> mix.bits
        begin, size = taken + unit * mix.below.take(x), unit * mix.share.take(x)
        for guess, low_it, size_it in ((guesses[:, 0], two, one), (guesses[:, 1], 0, two)):
            np.copyto(begin, low_it, where=guess == x)
            np.copyto(size, size_it, where=guess == x)
        for k in range(len(x)):
            unit = span >> _TOTAL_BITS
            add = unit * begin[k]
            low += add
            span = unit * size[k]
            over = np.flatnonzero(low < add)
            if len(over):
                over = at[over] - 1
                while len(over):
                    more = flat[over] + np.uint32(1)
                    flat[over] = more
                    over = over[more == 0] - 1
            small = np.flatnonzero(span < _WORD)
            if len(small):
                some, to = low[small], at[small]
                flat[to] = some >> _WORD_BITS
                at[small] = to + 1
                low[small] = some << _WORD_BITS
                span[small] <<= _WORD_BITS
    for shift in (32, 0):
        flat[at] = (low >> _u(shift)) & (_WORD - _u(1))
        at += 1
    used = at - np.arange(blocks) * width
    out = [_head(order, counts)]
    for b in range(blocks):
        check = zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes())
        out.append(check.to_bytes(4, "little") + words[b, 1 : used[b]].astype("<u4").tobytes())
    return out


def decode(coded: list[bytes], n_ids: int, vocabulary: int) -> np.ndarray:
    """The ids of ``encode``; a block whose checksum fails is an error."""
    blocks = _blocks(n_ids)
    if len(coded) != blocks + (blocks > 0):
        raise ValueError("blocks are missing")
    if not blocks:
        return np.empty(0, "<u4")
    order, counts = _read_head(coded[0])
    if len(order) > vocabulary or int(counts.sum()) != n_ids:
        raise ValueError("the head is not that of these ids")
    sizes = np.array([len(raw) // 4 - 1 for raw in coded[1:]])
    flat = np.frombuffer(b"".join([*(raw[4 : 4 * n + 4] for raw, n in zip(coded[1:], sizes)), bytes(8)]), "<u4")
    flat = flat.astype(np.uint64)
    at = np.cumsum(sizes) - sizes
    value = flat.take(at) << _u(32) | flat.take(at + 1, mode="clip")
    at += 2
    span = np.full(blocks, _FULL)
    mix = _Mix(blocks, counts)
    number = np.repeat(np.arange(len(order), dtype=np.int32), mix.share.astype(np.int64))
    table = np.zeros((BLOCK, blocks), np.int32)
    slots, before = mix.rows.copy(), mix.rows[1]
    for step in range(min(n_ids, BLOCK)):
        entry, rate = mix.look(slots)
        guess1, guess2 = entry >> _UP
        one, two = _weights(guess1, guess2, *rate.view(np.uint64))
        taken = one + two
        part = (_WHOLE - taken) >> mix.bits
        unit = span >> _TOTAL_BITS
        t = value // unit
        x = number.take(np.minimum((t - taken) // part, mix.top).view(np.int64))
        begin, size = taken + part * mix.below.take(x), part * mix.share.take(x)
        hit = np.flatnonzero(t < taken)
        x[hit], begin[hit], size[hit] = guess1[hit], two[hit], one[hit]
        hit = np.flatnonzero(t < two)
        x[hit], begin[hit], size[hit] = guess2[hit], 0, two[hit]
        value -= unit * begin
        span = unit * size
        small = np.flatnonzero(span < _WORD)
        if len(small):
            to = at[small]
            value[small] = value[small] << _WORD_BITS | flat.take(to, mode="clip")
            at[small] = to + 1
            span[small] <<= _WORD_BITS
        table[step] = x
        mix.learn(x << _UP)
        first = mix.hash1.take(x)
        np.add(mix.rows[0], first, out=slots[0])
        np.bitwise_xor(before, first, out=slots[1])
        before = mix.rows[1] + mix.hash2.take(x)
    ids = order.take(np.ascontiguousarray(table.T).reshape(-1)[:n_ids])
    for b, raw in enumerate(coded[1:]):
        check = zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK])
        if check.to_bytes(4, "little") != raw[:4]:
            raise ValueError(f"block {b} is damaged")
    return ids
