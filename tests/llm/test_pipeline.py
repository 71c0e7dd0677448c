"""The pipeline on the smallest tables, stage by stage, and the registered queries' SQL."""

import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from heatsheet.llm import common, queries

from cases import frame, lowered, prose, sort

SF_DIR = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = common.read(spark, SF_DIR, "documents")
    sizes, clean = [docs.count()], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.written(stage(spark, clean, SF_DIR), "stage")
        assert kept.schema == docs.schema
        assert kept.join(clean, "doc_id", "left_anti").count() == 0
        clean = kept
        sizes.append(clean.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > sizes[4] > 0
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_stages_bear_awkward_rows(spark):
    docs = frame(spark)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        kept = stage(spark, docs, SF_DIR)
        assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert corpus_pipeline.drop_low_quality(spark, docs, SF_DIR).columns == docs.columns


def _texts(df):
    return sort((r.doc_id, r.text) for r in df.collect())


def test_stages_judge_rows_without_id_or_sharing_one(spark, tmp_path):
    item, a, b, c = prose(70, 40), prose(71, 60), prose(72, 60), prose(73, 60)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    rows = [
        (None, f"{a} {item}"), (None, a), (None, b), (None, b.upper()), (None, f"{b} tail"),
        (5, c), (5, f"{b} {item}"), (6, c), (6, prose(74, 60)), (6, f"{c} tail"), (6, f"{c} tail"),
    ]
    docs = frame(spark, rows)
    clean = [r for r in rows if item not in r[1]]
    assert _texts(corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))) == sort(clean)
    # Of equal texts the largest id stays, of rows without one any.
    kept = _texts(corpus_pipeline.drop_exact_copies(spark, docs, str(tmp_path)))
    low = [(i, t.lower()) for i, t in kept]
    assert sort(low) == sort((i, t) for i, t in {(i, t.lower()) for i, t in rows} - {(5, c)})
    # Of near texts the smallest id stays, of rows without one any.
    kept = _texts(corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)))
    assert len(kept) == 6 and sum(t.lower().startswith(b) for i, t in kept if i is None) == 1
    assert {r for r in kept if not r[1].lower().startswith(b) or r[0]} == {
        rows[0], rows[1], rows[5], rows[6], rows[8]
    }


def _word_sets(rows, pattern):
    out = []
    for _, t in rows:
        w = re.findall(pattern, lowered(t))
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    return out


def _largest_of_equal(rows):
    best = {}
    for i, t in rows:
        best[lowered(t)] = max((i, t), best.get(lowered(t), (i, t)))
    return best.values()


def _smallest_of_near(rows):
    sets = _word_sets(rows, r"[^\x20\x09-\x0D]+")
    root, having = list(range(len(rows))), {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in enumerate(sets):
        shared = Counter(b for g in s for b in having.get(g, ()))
        for g in s:
            having.setdefault(g, []).append(a)
        for b, both in shared.items():
            if 100 * both >= 80 * (len(s) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)), key=lambda k: rows[k][0])
                root[y] = x
    return [r for k, r in enumerate(rows) if root[k] == k]


def _without_items(rows, items):
    pattern = r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    known = [s for s in _word_sets(items, pattern) if s]
    return [
        r
        for r, d in zip(rows, _word_sets(rows, pattern))
        if not any(100 * len(s & d) >= 80 * len(s) for s in known)
    ]


def test_stages_keep_the_rows_that_brute_force_keeps(spark):
    rows = [(r.doc_id, r.text) for r in common.read(spark, SF_DIR, "documents").collect()]
    items = [(r.item_id, r.text) for r in common.read(spark, SF_DIR, "benchmark").collect()]
    top, base = max(i for i, _ in rows), prose(80, 104).split()
    # 90 to 95 of 100 shingles each way: similarities of 0.82 to 0.90, and one of 0.75.
    rows += [(top + 1, " ".join(base)), (top + 2, " ".join([*base[:94], *prose(81, 10).split()]))]
    rows += [(top + 3, " ".join([*prose(82, 7).split(), *base[7:], "end"]))]
    rows += [(top + 4, " ".join([*prose(83, 14).split(), *base[14:]]))]
    want = {
        corpus_pipeline.drop_exact_copies: _largest_of_equal(rows),
        corpus_pipeline.drop_near_copies: _smallest_of_near(rows),
        corpus_pipeline.drop_contaminated: _without_items(rows, items),
    }
    docs = frame(spark, rows, extra=False)
    for stage, kept in want.items():
        assert _texts(stage(spark, docs, SF_DIR)) == sort(kept), stage.__name__
        assert len(kept) < len(rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark"):
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    result = connection.execute(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(c[0] for c in result.description)
    rows = df.select(*[c[0] for c in result.description]).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, result.fetchall()))
