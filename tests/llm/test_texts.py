"""Decontamination, licenses, quality and language."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatsheet.llm import decontaminate, language, licenses, quality

from cases import awkward, frame, lowered, prose, sort


def _items(spark):
    words = prose(5, 5000).split()
    rows = [
        (1, " ".join(words[700:740])),  # inside the long document
        (1, " ".join(words[700:740])),
        (2, " ".join([*words[100:120], "other", *words[121:140]])),  # 31 of 36: found
        (3, " ".join([*words[100:110], "other", *words[111:125]])),  # 16 of 21: not found
        (4, "two WORDS"),
        (5, None),
        (6, prose(99, 30)),
        (None, " ".join(words[1000:1050]).upper()),
    ]
    return spark.createDataFrame(rows, "item_id long, text string")


def _shingles(text):
    w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_contaminated(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_MINIMA", broadcast)
    monkeypatch.setattr(decontaminate, "BROADCAST_CANDIDATES", broadcast)
    items = _items(spark)
    got = decontaminate.contaminated(frame(spark), items).collect()
    want = set()
    for i, t in awkward():
        for r in items.collect():
            a, b = _shingles(r.text), _shingles(t)
            if a and 100 * len(a & b) >= 80 * len(a):
                want.add((i, r.item_id, len(a), len(a & b), len(a & b) / len(a)))
    assert sort(got) == sort(want) and len(want) == 5


def test_contaminated_empty(spark):
    assert decontaminate.contaminated(frame(spark, []), _items(spark)).collect() == []
    assert decontaminate.contaminated(frame(spark), _items(spark).limit(0)).collect() == []


def test_rows_without_id_meet_their_own_items_only(spark):
    # Every row holds an item of its own; the whole corpus stands under one id, or none.
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(300)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    for shared in (None, 7):
        docs = spark.createDataFrame([(shared, f"before {t} after") for _, t in rows], "doc_id long, text string")
        found = decontaminate.contaminated(docs.unionByName(docs), items)
        got = sorted((r.item_id, r.doc_id, r.n_shared) for r in found.collect())
        assert got == [(i, shared, 16) for i in range(300)]


def test_only_texts_with_candidates_are_shuffled(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    plan = decontaminate.contaminated(frame(spark), _items(spark))._jdf.queryExecution()
    assert "BroadcastHashJoin" in plan.executedPlan().toString()


def test_licenses(spark):
    mit = dict((label, t) for t, label in licenses.NOTICES)["mit"].split()
    rows = awkward() + [
        (30, "CC BY, cc-by cc by? General  Public License. All rights reserved"),
        (31, "before " + " ".join([*mit[:6], "inserted", *mit[6:]]) + " after"),
        (32, " ".join(mit[:4]) + " something else entirely"),
        (33, "Licensed under the Apache License, Version 2.0. " + prose(33, 30)),
    ]
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, rows)).collect()}
    assert len(licenses.license_scan(frame(spark, rows)).collect()) == len(rows)
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t))
        places = [
            (k, label)
            for phrase, label in licenses.BASE
            for k in range(len(w))
            if w[k : k + len(phrase.split())] == phrase.split()
        ]
        r = got[i]
        if i is not None:
            assert r.n_words == len(w) and r.n_base == len(places)
            assert r.first_word == min((p for p, _ in places), default=None)
            assert r.last_word == max((p for p, _ in places), default=None)
            assert r.base_labels == ",".join(sorted({x for _, x in places}))
    assert got[30].n_base == 5 and got[30].base_labels == "cc-by,gpl,reserved" and got[30].score == 1
    assert got[31].labels == "mit" and 0.8 <= got[31].score < 1
    assert got[32].labels == "" and got[32].score == 0
    assert got[33].labels == "apache-2.0"


def _labelled(spark):
    docs = [(i, prose(i, 60) if i % 3 else prose(i, 60).upper().replace(" ", "!! ")) for i in range(240)]
    labels = [(i, int(i % 3 != 0)) for i in range(240)] + [(3, None), (999, 1)]
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality(spark):
    docs, labels = _labelled(spark)
    got = quality.quality(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.predicted == int(r.doc_id % 3 != 0) for r in held)
    assert all(0 <= r.score <= 1 for r in got)
    odd = quality.quality(frame(spark), labels).collect()
    assert len(odd) == len(awkward())


def test_quality_without_labels(spark):
    docs, labels = _labelled(spark)
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(docs.limit(0), labels).collect() == []


def test_quality_leaves_out_held_out_labels(spark):
    docs, labels = _labelled(spark)
    turned = labels.withColumn(
        "quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    assert np.array_equal(quality.train(docs, labels), quality.train(docs, turned))


def test_language(spark):
    parts = {"en": "the and of with thing", "fr": "le est une très été", "de": "und nicht groß über"}
    rows = []
    for i in range(90):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join(parts[lang].split()[(i * k) % 4] for k in range(1, 9)), lang))
    rows += [(100, None, "en"), (101, "12 !", "fr"), (102, "the thing", None), (None, "und", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.language(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:90])
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[100].score == 0
    assert got[102].lang_pred == "en" and got[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.language(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in language.language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
