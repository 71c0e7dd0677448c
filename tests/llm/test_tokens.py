"""Token ids, files, counts and packing against the libraries."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from heatsheet.llm import id_coder, packing, ragged, token_count, token_file, token_ids

from cases import awkward, frame, prose, sort

ODD = [
    "", " ", " a", "a ", "a  b", "a\n b", "a \n b  c\n\n d", "don't 's it's x  y", "a.\nb\n.c\n\nd",
    "<|endoftext|> a<|endoftext|>", "é́ ́x", "x\x1c y \x85 z", "İSTANBUL ΑΣ ﬁ", "日本 語　x 12 3",
    "«été» déjà, là. à", "x≠y", "'' \" ..", "\x00a",
]


def _library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", [packing.TOKENIZER, token_file.TOKENIZER])
def test_pieces_encode_as_whole_texts(name):
    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet="aé.,'\n \t7　́A日", max_size=30), max_size=4))
    def check(texts):
        texts = texts + ODD
        want = [e.ids for e in _LIBRARY[name].encode_batch(texts, add_special_tokens=False)]
        _, _, ids, ends = next(token_ids.encoded(pa.array(texts), name))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want

    _LIBRARY[name] = _library(name)
    check()


_LIBRARY = {}


@pytest.mark.parametrize("n", [0, 1, id_coder.BLOCK - 1, id_coder.BLOCK, id_coder.BLOCK + 1, 20_000])
def test_coder_round_trip(n):
    r = np.random.default_rng(n)
    for ids in (np.zeros(n, np.int64), r.integers(0, 49_408, n), r.zipf(1.5, n) % 49_408):
        coded = id_coder.encode(ids, 49_408)
        assert np.array_equal(id_coder.decode(coded, n, 49_408), ids)


def test_coder_finds_damage():
    coded = id_coder.encode(np.arange(5000) % 700, 49_408)
    broken = bytearray(coded[0])
    broken[100] ^= 1
    with pytest.raises((ValueError, IndexError)):
        id_coder.decode([bytes(broken)], 5000, 49_408)
    content = bytearray(token_file.pack_file([1], np.array([3]), np.arange(3), 49_408))
    content[12] ^= 1
    with pytest.raises(ValueError):
        token_file.unpack_file(bytes(content))


def test_coder_counts_every_id_in_the_head():
    r = np.random.default_rng(2)
    for ids in (r.permutation(49_408)[r.zipf(1.3, 60_000) % 3000], r.integers(0, 49_408, 400) * 0 + 77):
        share = np.unique(ids, return_counts=True)[1] / len(ids)
        coded = id_coder.encode(ids, 49_408)
        # The entropy of the ids, a tenth of it for what two poor predictions cost, and the checksums.
        least = -(share * np.log2(share)).sum() * len(ids) / 8
        assert sum(map(len, coded)) < 1.1 * least + len(coded[0]) + 40 * len(coded)
        assert np.array_equal(id_coder.decode(coded, len(ids), 49_408), ids)


@pytest.mark.parametrize("vocabulary", [49_408, 90_000])
def test_coder_leaves_every_id_a_part(vocabulary):
    r = np.random.default_rng(3)
    rare = [np.concatenate([np.zeros(3000, np.int64), r.integers(0, vocabulary, 3)]) for _ in range(6)]
    ids = np.concatenate([np.arange(vocabulary), *rare, np.tile([5, 6, 7], 2000), np.arange(vocabulary)[::-1]])
    assert np.array_equal(id_coder.decode(id_coder.encode(ids, vocabulary), len(ids), vocabulary), ids)


def test_coder_carries():
    # Ids of the largest number come last in the interval, so the lower end grows at every step.
    ids = np.tile(np.arange(300)[::-1], 40)
    for n in (1, 2, 299, 4095, 4097, len(ids)):
        assert np.array_equal(id_coder.decode(id_coder.encode(ids[:n], 300), n, 300), ids[:n])


def test_damaged_head_or_block_is_found():
    ids = np.random.default_rng(6).integers(0, 700, 9000)
    coded = id_coder.encode(ids, 700)
    for k, block in enumerate(coded):
        for at in (0, 2, len(block) // 2):
            broken = [*coded[:k], block[:at] + bytes([block[at] ^ 4]) + block[at + 1 :], *coded[k + 1 :]]
            with pytest.raises(ValueError):
                id_coder.decode(broken, len(ids), 700)


def test_words_are_given_to_the_library_together():
    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet="aJTHÉéßÿİıK×ǰ.,'\n 7́̌̂￾􏿾", max_size=30), max_size=4))
    def check(texts):
        texts = texts + ODD + ["J̌ J ǰ T̈ Éa É A a-b B's", "<|ENDOFTEXT|> Straße NAÏVE naïve"]
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        _, _, ids, ends = next(token_ids.encoded(pa.array(texts), token_file.TOKENIZER, **token_file.ENCODING))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want

    library = _library(token_file.TOKENIZER)
    check()

    class Counted:
        def __init__(self):
            self.texts = 0

        def encode_batch_fast(self, texts, **options):
            self.texts += len(texts)
            return library.encode_batch_fast(texts, **options)

    encoder = token_ids.Encoder(token_file.TOKENIZER, words=True)
    encoder.library = counted = Counted()
    words = [f"{a}{b}{c}é" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcd"]
    data, offsets = ragged.column(pa.array([" ".join(words)]))
    ids, _ = encoder.encode(data, offsets)
    assert ids.tolist() == library.encode(" ".join(words), add_special_tokens=False).ids
    assert counted.texts <= 20


def test_distinct_hashes():
    r = np.random.default_rng(8)
    for top in (4, 300, 1 << 63):
        for n in (0, 1, 2, 500):
            h = r.integers(0, top, n).astype(np.uint64)
            want = np.unique(h, return_index=True, return_inverse=True)
            assert all(np.array_equal(a, b) for a, b in zip(token_ids.distinct(h), want))


def _ids(rows, name, end):
    library = _library(name)
    return [library.encode(t or "", add_special_tokens=False).ids + [end] for _, t in rows]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark):
    rows = awkward()
    files = token_file.write(frame(spark), file_bytes=10_000)
    assert files.count() > 1
    got = sort(token_file.digests(files).collect())
    ids = _ids(rows, token_file.TOKENIZER, token_file.END)
    assert sort((r[0], r[2], r[3]) for r in got) == sort((i, len(x), _crc(x)) for (i, _), x in zip(rows, ids))
    order = sorted(got, key=lambda r: r[1])
    assert [r[0] for r in order] == sorted((r[0] for r in got), key=lambda i: -1 if i is None else i)
    assert all(b[1] == a[1] + a[2] for a, b in zip(order, order[1:])) and order[0][1] == 0
    assert token_file.token_files(frame(spark, [])).collect() == []


def test_token_counts(spark):
    pieces = token_count.vocabulary()
    library = models.Unigram([("<unk>", min(s for _, s in pieces)), *pieces], 0, False)

    def want(text):
        if not text:
            return 0
        marked = token_count.MARK + text.replace(" ", token_count.MARK)
        return sum(len(t.value.encode()) if t.id == 0 else 1 for t in library.tokenize(marked))

    rows = awkward() + [(100 + k, t) for k, t in enumerate([*ODD, token_count.MARK + "x a▁b"])]
    got = token_count.token_counts(frame(spark, rows)).collect()
    assert sort(got) == sort((i, len((t or "").encode()), want(t)) for i, t in rows)
    assert token_count.token_counts(frame(spark, [])).collect() == []


def test_packing(spark, monkeypatch):
    rows = awkward()
    got = packing.packed(frame(spark)).collect()
    ids = _ids(rows, packing.TOKENIZER, packing.END)
    pieces = []
    for (i, _), x in zip(rows, ids):
        first = len(x) % packing.CAPACITY or packing.CAPACITY
        cuts = [0, *range(first, len(x) + 1, packing.CAPACITY)] if len(x) > first else [0, len(x)]
        pieces += [(i, k, a, b - a, _crc(x[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sort(r[:5] for r in got) == sort(pieces)
    _gapless(got)
    assert packing.packed(frame(spark, [])).collect() == []


def _gapless(rows):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(bins)


def test_groups_exchange_what_they_give_up(spark):
    r = np.random.default_rng(4)
    lengths = r.integers(1, 1500, 6000).tolist()
    rows = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECES)
    used = _gapless(packing.pack(rows, group=300).collect())
    assert used <= 1.002 * packing.least_bins(np.array(lengths), packing.CAPACITY) + 1


def test_bounds_are_bounds():
    r = np.random.default_rng(5)
    for top in (40, 60, 100):
        for _ in range(50):
            lengths = np.sort(r.integers(1, top + 1, 30))[::-1]
            assert packing.least_bins(lengths, 100) <= len(packing.best_fit(lengths, 100)[2])
    assert packing.least_bins(np.array([60] * 5), 100) == 5
    assert packing.least_bins(np.array([34] * 6), 100) == 3


def test_sequences_hold_the_ids(spark):
    docs = frame(spark, [(i, prose(i, 300)) for i in range(8)])
    ids = packing.pieces(docs, with_ids=True)
    placed = packing.pack(packing.pieces(docs))
    whole = {r.sequence_id: r.ids for r in packing.sequences(placed, ids).collect()}
    for r in placed.collect():
        assert _crc(whole[r.sequence_id][r.offset : r.offset + r.length]) == r.ids_crc32


def test_sequences_of_rows_without_id_or_sharing_one(spark):
    rows = [(i, prose(k, 300 + k)) for k, i in enumerate([None, None, 3, 3, 3, 4])] + [(None, prose(9, 3000))]
    docs = frame(spark, rows)
    placed = packing.pack(packing.pieces(docs))
    whole = {r.sequence_id: r.ids for r in packing.sequences(placed, packing.pieces(docs, with_ids=True)).collect()}
    at = placed.collect()
    for r in at:
        assert _crc(whole[r.sequence_id][r.offset : r.offset + r.length]) == r.ids_crc32
    assert sum(map(len, whole.values())) == sum(r.length for r in at)
    assert "row" not in packing.packed(docs).columns


def test_packing_cuts_and_marks_in_one_worker(spark, monkeypatch):
    steps, plain = [], packing.common.map_batches
    monkeypatch.setattr(packing.common, "map_batches", lambda *a: (steps.append(a[1]), plain(*a))[1])
    monkeypatch.setattr(token_ids.encoded, "__defaults__", (2_000, *token_ids.encoded.__defaults__[1:]))
    rows = [(i, prose(k, n)) for k, (i, n) in enumerate(
        [(None, 300), (3, 3000), (None, 3000), (3, 9000), (None, 9), (4, 50), (3, 300), (5, 5000)]
    )]
    docs = frame(spark, rows).coalesce(1)
    got = packing.pieces(docs).orderBy("row", "piece").collect()
    seen, want = set(), []
    for r in got:
        want.append((r.doc_id, r.piece) in seen)
        seen.add((r.doc_id, r.piece))
    assert [r.again for r in got] == want and 0 < sum(want) < len(want)
    steps.clear()
    placed = packing.packed(docs).collect()
    assert len(steps) == 1
    assert sort(r[:5] for r in placed) == sort(r[:5] for r in got)
    _gapless(placed)


def test_workers_give_back_what_arrow_keeps(monkeypatch):
    given = []

    class Pool:
        def release_unused(self):
            given.append("all")

    monkeypatch.setattr(packing.common.pa, "default_memory_pool", Pool)
    work = packing.common.released(lambda batches: (2 * b for b in batches))
    rows = work(iter([1, 2]))
    assert next(rows) == 2 and not given
    assert list(rows) == [4] and given == ["all"]


def test_pieces_of_one_id_are_dealt_to_many_groups(spark):
    rows = spark.createDataFrame([(None, 0, 0, 1000 + k % 40, 0) for k in range(4000)], packing.PIECES)
    groups = {r.sequence_id >> 24 for r in packing.pack(rows, group=500).collect()}
    assert len(groups) >= 8


def test_files_split_one_id(spark):
    docs = frame(spark, [(7, prose(k, 300)) for k in range(30)])
    files = token_file.write(docs, file_bytes=10_000)
    assert files.count() > 1
    assert token_file.digests(files).count() == 30


def test_hashes_of_runs_do_not_depend_on_place():
    data, offsets = ragged.column(pa.array(["one two", None, "two", " two one"]))
    starts, ends = ragged.runs(ragged.BLANK_SEPARATED[data], offsets)
    h = ragged.hash_runs(data, starts, ends)
    assert h[1] == h[2] == h[3] and h[0] == h[4] != h[1]
