"""Collocations against counting every phrase of every piece."""

import random
import re
from collections import Counter

from heatsheet.llm import phrases, streams

from cases import lowered, prose, sort


def brute_force(rows, top=phrases.TOP):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in (1, 2, 3):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for phrase, a in f.items():
            if a < 10 or len(phrase) < 2:
                continue
            if len(phrase) == 2 and any(
                100 * b >= 50 * a and b >= 10 and phrase in (q[:2], q[1:])
                for q, b in f.items()
                if len(q) == 3
            ):
                continue
            cuts = []
            for k in range(1, len(phrase)):
                l, r = f[phrase[:k]], f[phrase[k:]]
                cuts.append((10**6 * a * a // (l * r), k, l, r))
            score, _, l, r = min(cuts)
            found.append((-score, -a, " ".join(phrase).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sort(out)


def frame(spark, rows):
    schema = "lang string, text string, doc_id long, w1 long, f string, rank int, word string"
    return spark.createDataFrame([(*r, 1, 2, "f", 3, "w") for r in rows], schema)


def some_rows(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["né", "日本", "...a", "b!b", "-"]
    rows = [(None, None), ("", ""), ("en", "  \t "), ("en", ".,;"), (None, "a b " * 40)]
    for _ in range(n):
        text = " ".join(
            r.choice(words) + r.choice(["", "", "", ".", ",", "\n", "\x0b", "\t"])
            for _ in range(r.randrange(40))
        )
        rows.append((r.choice(["en", "fr", "und", None, "é"]), text.upper() if r.random() < 0.2 else text))
    passage = " ".join(f"p{i}" for i in range(30)) + ". one end"
    return rows + [("en", f"x{i} {passage}") for i in range(12)] * 2


def got(spark, rows, **options):
    found = phrases.collocations(frame(spark, rows), **options)
    return found.collect()


def test_phrases_equal_brute_force(spark):
    rows = some_rows(1, 400)
    assert sort(r[:8] for r in got(spark, rows)) == brute_force(rows)


def test_ranks_cut_ties_by_bytes(spark):
    rows = some_rows(2, 300)
    assert sort(r[:8] for r in got(spark, rows, top=7)) == brute_force(rows, 7)


def test_small_slices_change_nothing(spark, monkeypatch):
    rows = some_rows(3, 150)
    monkeypatch.setattr(streams, "OWNER_BYTES", 1 << 9)
    monkeypatch.setattr(streams, "SLICE_BYTES", 1 << 10)
    assert sort(r[:8] for r in got(spark, rows)) == brute_force(rows)


def test_paths_are_compacted(spark):
    found = {r.phrase: r.path_words for r in got(spark, some_rows(4, 50)) if r.lang == "en"}
    # 30 words in a row that occur together only; their first word has many words before it.
    assert found["p3 p4 p5"] == 30
    assert found["one end"] == 2
    assert "p3 p4" not in found


def test_a_text_longer_than_a_slice_and_no_rows(spark):
    rows = [("en", prose(1, 1_300_000).replace("9 ", "9. ")), ("en", "z" * 100_000)]
    result = got(spark, rows)
    assert result and max(r.rank for r in result) <= phrases.TOP
    assert {r.n for r in result} == {1_300_001}
    assert got(spark, []) == []
    assert got(spark, [("en", "too rare")]) == []
