"""Spelling variants against comparing every word with every other."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from heatsheet.llm import spelling

from cases import frame, lowered, prose, sort


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def brute_force(rows):
    n = counted(rows)
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and distance(v, w) == 1] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sort(out)


def some_rows(seed):
    r = random.Random(seed)
    base = ["anagram", "margana", "weather", "whether", "straße", "éclairée", "naïveté", "competition", "aaaaaaa"]
    words = []
    for w in base:
        words += [w] * 400
        for _ in range(12):
            k = r.randrange(len(w))
            v = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("xéw") + w[k:], w[:k] + r.choice("tÿa") + w[k + 1 :]])
            words += [v] * r.choice([1, 2, 3, 30, 60])
            k = r.randrange(len(v))
            words += [v[:k] + r.choice("qz") + v[k:]] * r.choice([2, 3, 4])
    r.shuffle(words)
    rows = [(None, None), (None, "weather weather"), (7, ""), (8, "12 !"), (8, "Weather WEATHER×÷ Éclairée éCLAIRéE")]
    for i in range(0, len(words), 25):
        rows.append((i, r.choice([" ", "1", "-", "日"]).join(words[i : i + 25])))
    return rows


def got(spark, rows):
    return sort(spelling.variants(frame(spark, rows)).collect())


def test_variants_equal_brute_force(spark):
    rows = some_rows(1)
    expected = brute_force(rows)
    assert any(e[1] and e[2] != e[1] for e in expected)
    assert got(spark, rows) == expected


def test_small_blocks_and_slices_change_nothing(spark, monkeypatch):
    rows = some_rows(2)
    monkeypatch.setattr(spelling, "BLOCK", 3)
    monkeypatch.setattr(spelling, "FRONTIER", 8)
    monkeypatch.setattr(spelling.streams, "SLICE_BYTES", 500)
    assert got(spark, rows) == brute_force(rows)


def test_long_texts_and_no_rows(spark):
    many = "anagram anagrams " * 30_000 + prose(1, 1_300_000)
    rows = [(1, "abcdefg" * 100), (2, "abcdefg" * 100), (3, many)]
    assert got(spark, rows) == brute_force(rows)
    assert got(spark, []) == []
    assert got(spark, [(1, "short"), (2, "onlyonce")]) == []


@settings(max_examples=200, deadline=None)
@given(st.text("abé", min_size=1, max_size=6), st.text("abé", min_size=1, max_size=6))
def test_one_apart(a, b):
    assert spelling.one_apart(a, b) == (distance(a, b) == 1)


def test_checksums_of_runs():
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 400).astype(np.uint8)
    starts = np.array([0, 5, 5, 100, 399])
    ends = np.array([5, 5, 90, 399, 400])
    heads = np.array([zlib.crc32(b"%d:" % i) for i in range(5)], np.uint32)
    expected = [zlib.crc32(b"%d:" % i + data[s:e].tobytes()) for i, (s, e) in enumerate(zip(starts, ends))]
    assert spelling.crc_runs(data, starts, ends, heads).tolist() == expected
