"""Exact, near and substring deduplication against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from heatsheet.llm import common, exact_dedup, near_dedup, substring_dedup
from heatsheet.llm.components import components

from cases import awkward, frame, lowered, prose, sort


@pytest.mark.parametrize("bucket_keys", [100_000, 1])
def test_exact(spark, bucket_keys):
    got = exact_dedup.exact_duplicates(frame(spark), bucket_keys).collect()
    groups = {}
    for i, t in awkward():
        groups.setdefault(lowered(t), []).append(i)
    want = []
    for i, t in awkward():
        ids = [x for x in groups[lowered(t)] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()))
    assert sort((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sort(want)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def _near(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows):
            if i is not None and j is not None and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return [(i, len(s), i if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(rows, sets)]


def test_near(spark):
    got = near_dedup.near_duplicates(frame(spark)).collect()
    assert sort(got) == sort(_near(awkward()))


def test_near_chain_across_components(spark):
    """A chain of texts, each near the next, most of them far from the first."""
    words = prose(3, 200).split()
    rows = []
    for k in range(40):
        words = [*words]
        words[(k * 5) % 200] = f"edit{k}"
        rows.append((100 - k, " ".join(words)))
    assert sort(near_dedup.near_duplicates(frame(spark, rows)).collect()) == sort(_near(rows))


def test_second_text_of_a_document_is_judged_by_itself():
    one, two = prose(40, 60), prose(41, 60)
    ids = np.array([7, 7, 7])
    sets = near_dedup._sets(ids, pa.array([one, two, two]))
    alone = [near_dedup._sets(ids[:1], pa.array([t]))[0] for t in (one, two)]
    assert [s.tolist() for s in sets] == [alone[i].tolist() for i in (0, 1, 1)]


def test_near_documents_with_several_texts(spark):
    texts = [prose(50 + k, 100) for k in range(6)]
    rows = [
        (9, texts[0]), (9, texts[1]), (9, texts[2]), (3, texts[1] + " tail"), (4, texts[2] + " tail"),
        (5, texts[3]), (8, texts[3]), (8, texts[4]), (7, texts[4]), (6, texts[5]),
    ]
    for some in (rows, rows[::-1]):
        assert sort(near_dedup.near_duplicates(frame(spark, some)).collect()) == sort(_near(some))


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(64)] + [(9, 9), (200, 201)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(1, 65)}, 201: 200}


def _repeated(rows, size=substring_dedup.LENGTH):
    key = lambda i: float("-inf") if i is None else i
    first = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for s in range(len(b) - size + 1):
            w = b[s : s + size]
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if first[b[s : s + size]] < key(i):
                gone[s : s + size] = b"\1" * size
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_bytes(spark):
    passage = prose(30, 12)
    rows = awkward() + [
        (20, "x" * 200),
        (21, "y" + "x" * 120),
        (22, passage[:49]),
        (23, "a " + passage + " b"),
        (24, "c " + passage + " d " + passage),
        (25, passage[3:] + "!"),
    ]
    assert sort(substring_dedup.repeated_bytes(frame(spark, rows)).collect()) == sort(_repeated(rows))


def _packed(texts, buckets):
    """Packs that the first pass makes of the texts, in batches of four."""
    made = []
    for k in range(0, len(texts), 4):
        ids = np.arange(k, k + len(texts[k : k + 4]))
        made.append(common.batch(doc_id=ids, row=0 * ids, text=pa.array(texts[k : k + 4])))
    return pa.Table.from_batches(list(substring_dedup._first_pass(buckets)(iter(made))))


def _unpacked(table):
    rows = set()
    for kind in set(table["kind"].to_pylist()):
        packs = table.filter(pc.equal(table["kind"], kind))["rows"].to_pylist()
        columns = substring_dedup._columns(kind, packs)
        rows |= {(kind, *row) for row in zip(*(c.tolist() for c in columns.values()))}
    return rows


def test_slices_share_the_packs_of_a_bucket(monkeypatch):
    """Packs for each slice and bucket grow with the square of the input."""
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", 5000)
    same, two = prose(60, 30), prose(61, 30)
    texts = [f"{prose(70 + k, 200)} {same if k % 3 else two} {same[: 40 + k]}" for k in range(60)]
    texts += [f"x{two}{same}", ""]
    few = _packed(texts, 16)
    assert few.num_rows <= 2 * 16 + 1
    monkeypatch.setattr(substring_dedup, "DEAL_ROWS", 1)
    many = _packed(texts, 16)
    assert many.num_rows > 3 * few.num_rows
    assert _unpacked(few) == _unpacked(many) and {r[0] for r in _unpacked(few)} == {0, 1, 2}


def test_a_bucket_of_samples_gives_one_pack_of_a_kind(monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", 2000)
    table = _packed([f"{prose(80 + k, 40)} {prose(90 + k % 5, 40)}" for k in range(40)], 4)
    found = 0
    for bucket in set(table["bucket"].to_pylist()):
        out = substring_dedup._rank(1000)(table.filter(pc.equal(table["bucket"], bucket)))
        assert out.num_rows <= 2 or out["kind"][0].as_py() != substring_dedup.RUNS
        found += out["kind"].to_pylist().count(substring_dedup.RUNS)
    assert found


@pytest.mark.parametrize("open_bytes", [1 << 20, 1])
def test_runs_are_merged_inside_a_text(monkeypatch, open_bytes):
    monkeypatch.setattr(substring_dedup, "OPEN_BYTES", open_bytes)
    least = substring_dedup._NONE
    rows = [(5, 0, 0, 50), (5, 0, 50, 60), (5, 0, 111, 50), (5, 9, 100, 50), (least, 0, 7, 75),
            (least, 0, 20, 50), (7, 0, 0, 50), (7, 0, (1 << 31) - 60, 55), (5, 0, 30, 50)]
    parts = []
    for some in (rows[:4], rows[4:]):
        doc, text, at, more = (np.array(c, np.int64) for c in zip(*some))
        parts.append(substring_dedup._runs(doc, text, at, more))
    found = {}
    for out in substring_dedup._by_document(substring_dedup.RUNS)(substring_dedup._batch(8, parts)):
        for r in out.to_pylist():
            pairs = np.frombuffer(r["runs"], np.int32).reshape(-1, 2).tolist()
            found.setdefault((r["doc_id"], r["row"]), []).extend(pairs)
    if open_bytes > 1:
        assert found == {
            (least, 0): [[7, 75]], (5, 0): [[0, 110], [111, 50]], (5, 9): [[100, 50]],
            (7, 0): [[0, 50], [(1 << 31) - 60, 55]],
        }
    else:
        assert sorted(found[5, 0]) == [[0, 110], [30, 50], [111, 50]] and len(found) == 4


@pytest.mark.parametrize(
    "operator",
    [exact_dedup.exact_duplicates, near_dedup.near_duplicates, substring_dedup.repeated_bytes],
)
def test_empty_table(spark, operator):
    assert operator(frame(spark, [])).collect() == []


def test_rounds_of_components_write_few_files(spark, conf):
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    conf("spark.sql.shuffle.partitions", "30")
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    roots = components(links)
    assert len(roots.inputFiles()) == 1
    assert {(r.node, r.root) for r in roots.collect()} == {(i, 0) for i in range(1, 61)}


def test_first_edges_of_components_are_few_files(spark, conf, monkeypatch):
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    conf("spark.sql.shuffle.partitions", "30")
    files, plain = [], common.written

    def written(*a, **b):
        table = plain(*a, **b)
        files.append(len(table.inputFiles()))
        return table

    monkeypatch.setattr(common, "written", written)
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 0) for i in range(1, 61)}
    assert set(files) == {1}
