"""Language-model scores against a dictionary of counts and one loop over each text."""

import math
import re
import zlib
from collections import Counter

import pytest

from heatsheet.llm import common, language_model, streams

from cases import awkward, frame, lowered, prose, sort


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lowered(text)) if w] + [None]


def holds_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def brute_force(rows, prior=language_model.PRIOR):
    one, two = Counter(), Counter()
    for doc_id, text in rows:
        if not holds_out(doc_id):
            read = tokens(text)
            one.update(read)
            two.update(zip([None, *read], read))
    total, distinct = sum(one.values()), len(one)

    def p(w):
        return (one[w] + 0.5) / (total + 0.5 * (distinct + 1))

    out = []
    for doc_id, text in rows:
        read = tokens(text)
        base = sum(math.log10(p(w)) for w in read)
        score = sum(
            math.log10((two[h, w] + prior * p(w)) / (one[h] + prior))
            for h, w in zip([None, *read], read)
        )
        known = sum(one[w] > 0 for w in read)
        out.append((doc_id, holds_out(doc_id), len(read), known, total, base, score))
    return sort(out)


def check(spark, rows, **options):
    got = sort(language_model.log_probabilities(frame(spark, rows), **options).collect())
    expected = brute_force(rows, **options)
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert g[:5] == e[:5]
        assert g[5:] == pytest.approx(e[5:], rel=1e-9)


def test_scores_equal_brute_force(spark):
    rows = awkward() + [(100 + i, prose(200 + i % 9, 30 + 40 * (i % 7))) for i in range(60)]
    check(spark, rows)
    check(spark, rows, prior=3.0)


def test_small_slices_and_lanes_change_nothing(spark, monkeypatch):
    rows = awkward() + [(100 + i, prose(i, 700)) for i in range(8)]
    before = sort(language_model.log_probabilities(frame(spark, rows)).collect())
    monkeypatch.setattr(streams, "OWNER_BYTES", 1 << 10)
    monkeypatch.setattr(streams, "SLICE_BYTES", 1 << 11)
    monkeypatch.setattr(language_model, "LANE", 7)
    after = sort(language_model.log_probabilities(frame(spark, rows)).collect())
    assert [r[:5] for r in before] == [r[:5] for r in after]
    for b, a in zip(before, after):
        assert b[5:] == pytest.approx(a[5:], rel=1e-9)


def test_a_text_longer_than_a_slice(spark):
    check(spark, [(1, prose(1, 1_500_000)), (2, prose(2, 50)), (3, "é" * 100_000)])


def test_nothing_learnt_and_no_rows(spark):
    held = next(i for i in range(99) if holds_out(i))
    check(spark, [(held, "amber birch"), (held, None)])
    assert language_model.log_probabilities(frame(spark, [])).collect() == []


def test_only_what_the_result_reads_is_kept(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_folder", lambda _: str(tmp_path))
    rows = awkward()
    result = language_model.log_probabilities(frame(spark, rows))
    files = [f.relative_to(tmp_path).parts for f in tmp_path.rglob("*.parquet")]
    kept = {(parts[0].rsplit("-", 1)[0], *parts[1:-1]) for parts in files}
    assert kept == {("lm-numbered", f"kind={streams.STREAM}"), ("lm-counted",)}
    first, again = sort(result.collect()), sort(result.collect())
    assert first == again
    for g, e in zip(first, brute_force(rows), strict=True):
        assert g[:5] == e[:5]
        assert g[5:] == pytest.approx(e[5:], rel=1e-9)


def test_the_bigram_model_sums_to_one(spark):
    text = prose(3, 400)
    (row,) = language_model.log_probabilities(frame(spark, [(2, text)])).collect()
    assert row.score > row.base_score
    one, two = Counter(tokens(text)), Counter(zip([None, *tokens(text)], tokens(text)))
    total, distinct, prior = sum(one.values()), len(one), language_model.PRIOR
    for h in list(one)[:5]:
        p = {w: (one[w] + 0.5) / (total + 0.5 * (distinct + 1)) for w in one}
        unseen = 0.5 / (total + 0.5 * (distinct + 1))
        mass = sum((two[h, w] + prior * p[w]) / (one[h] + prior) for w in one)
        assert mass + prior * unseen / (one[h] + prior) == pytest.approx(1)


def test_random_packs_survive():
    import numpy as np

    r = np.random.default_rng(1)
    arrays = [
        r.integers(0, 9, 5), r.integers(0, 2**60, 1000), np.empty(0, np.int32),
        r.random(7) < 0.5, r.integers(0, 255, 100).astype(np.uint8),
    ]
    for a, b in zip(arrays, streams.unpack(streams.pack(*arrays))):
        assert a.dtype == b.dtype and (a == b).all()
    wide = [r.integers(0, 2**62, 500), r.integers(0, 2**62, 500)]
    wide[0][:250] = wide[0][250:]
    wide[1][:100] = wide[1][250:350]
    different, first, which = streams.group_numbers(*wide)
    assert len(different) == 400
    assert all(wide[i][first][which].tolist() == wide[i].tolist() for i in (0, 1))
