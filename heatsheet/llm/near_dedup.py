"""Near-duplicate documents by MinHash.

1. Sketch: a document's set of 5-word shingles gives ``bands * rows`` minima of universal
   hashes, a key for each band of ``rows`` minima, and a fingerprint of the whole set.
   Both follow from the similarity asked for (40 x 8 at 0.85, 54 x 7 at 0.80), at which a pair
   shares no band once in ``MISSED`` pairs.
2. Documents with the same set are one class; only its smallest document goes on.
3. In every band bucket each member is paired with one hub, the member that meets most
   others, and with the smallest member, so a bucket of n members gives at most 2n pairs.
   Pairs whose signatures speak against a link are dropped; the rest is verified on full sets.
4. Components by large-star and small-star.
5. The pairs of a bucket left are those between different components. Buckets that hold
   more than one component are compared block by block on signatures inside the tasks; what
   passes is verified and the components are closed again. Inside a component no further
   link can change the result, so no link between different texts is lost.

Words are what stands between blanks, with A-Z lowered. A document with fewer than five
words has them all as its one shingle; one without words is linked with nothing, as is a row
without ``doc_id``. Rows that share a ``doc_id`` are one document with several texts.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatsheet.llm import common, ragged
from heatsheet.llm.components import components

WIDTH = 5
SIMILAR_PERCENT = 85
MISSED, MOST_MINIMA = 300_000, 384
BLOCK = 256
#: Text that is cut into shingles at a time, and text of pairs that are confirmed together.
SLICE_BYTES = 256 << 10
#: What a row of a block is: a member of the bucket's largest component, any other member, or
#: such a member on the side of the strays.
MAIN, MEMBER, STRAY = 0, 1, 2


@dataclass(frozen=True)
class Banding:
    """The similarity asked for, bands, minima a band, and how far the share of equal signature
    bytes may lie under the similarity."""

    percent: int
    bands: int
    rows: int
    margin: float


def banding(percent: int) -> Banding:
    """The longest bands that ``MOST_MINIMA`` allow. The margin is 4.5 standard deviations of
    as many draws, rounded up to a hundredth."""
    similar = min(percent / 100, 0.999)
    for rows in range(MOST_MINIMA if similar > 0 else 0, 0, -1):
        bands = math.ceil(-math.log(MISSED) / math.log1p(-(similar**rows)))
        if bands * rows <= MOST_MINIMA:
            spread = math.sqrt(similar * (1 - similar) / (bands * rows))
            return Banding(percent, bands, rows, math.ceil(450 * spread) / 100)
    raise ValueError(f"{MOST_MINIMA} minima do not find pairs of similarity {percent} %")


@lru_cache
def _universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(20))
    a = draw.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a, draw.integers(0, 1 << 32, n, dtype=np.uint32)


SKETCH = "doc_id long, n_shingles long, sum long, fold long, bands array<long>, signature binary"


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each of ``n`` universal hashes over a set of shingles."""
    a, b = _universal(n)
    least = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(least, (x[at : at + 256, None] * a + b).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, how: Banding) -> np.ndarray:
    parts = least.reshape(-1, how.bands, how.rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(how.bands, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(how.rows):
        h = ragged.mix(h * np.uint64(0x9FB21C651E98DF25) + parts[:, :, i])
    return h


def _sketch(how: Banding, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ids = batch.column("doc_id")
    for low, high, data, offsets in ragged.slices(batch.column("text"), SLICE_BYTES):
        sets = ragged.shingles(data, offsets, WIDTH)
        least = np.stack([minima(s, how.bands * how.rows) for s in sets])
        keys = band_keys(least, how).view(np.int64)
        yield common.batch(
            doc_id=ids.slice(low, high - low),
            n_shingles=np.array([len(s) for s in sets], np.int64),
            sum=np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64),
            fold=np.array(
                [np.bitwise_xor.reduce(ragged.mix(s + np.uint64(1))) if len(s) else 0 for s in sets],
                np.uint64,
            ).view(np.int64),
            bands=pa.ListArray.from_arrays(
                np.arange(len(sets) + 1, dtype=np.int32) * how.bands, keys.ravel()
            ),
            signature=pa.array([row.tobytes() for row in (least >> np.uint32(3)).astype(np.uint8)], pa.binary()),
        )


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarity that the share of equal signature bytes stands for."""
    same = (a == b).mean(axis=-1)
    return (same - 1 / 256) / (1 - 1 / 256)


def _signatures(column: pa.Array, how: Banding) -> np.ndarray:
    return ragged.column(column)[0].reshape(-1, how.bands * how.rows)


def _likely(how: Banding, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    a, b = (_signatures(batch.column(c), how) for c in ("signature_a", "signature_b"))
    keep = _agree(a, b) >= how.percent / 100 - how.margin
    sizes = (batch.column(c).to_numpy() for c in ("n_shingles_a", "n_shingles_b"))
    keep &= _fit(*sizes, how.percent)
    keep = pa.array(keep)
    yield pa.RecordBatch.from_arrays(
        [batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"]
    )


def _sets(ids: np.ndarray, texts: pa.Array) -> list[np.ndarray]:
    """Sets of every row; rows of the same document and text that follow one another share one."""
    other = pc.not_equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
    first = np.concatenate([[True], (ids[1:] != ids[:-1]) | other])
    sets: list[np.ndarray] = []
    for _, _, data, offsets in ragged.slices(texts.filter(pa.array(first)), SLICE_BYTES):
        sets += ragged.shingles(data, offsets, WIDTH)
    return [sets[i] for i in np.cumsum(first) - 1]


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of pairs whose texts begin in the same ``SLICE_BYTES``: few sets are held at once."""
    sizes = [pc.binary_length(batch.column(c)).to_numpy().astype(np.int64) for c in ("text_a", "text_b")]
    ends = np.cumsum(sizes[0] + sizes[1])
    begins = np.concatenate([[0], ends[:-1]]) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(begins)) + 1), len(ends)]
    for low, high in itertools.pairwise(cuts):
        yield batch.slice(low, high - low)


def _confirm(percent: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for block in _portions(batch):
        a, b = (block.column(c).to_numpy() for c in ("a", "b"))
        keep = []
        for x, y in zip(_sets(a, block.column("text_a")), _sets(b, block.column("text_b"))):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both) > 0)
        keep = np.array(keep)
        yield common.batch(a=a[keep], b=b[keep])


def _beside(frame: DataFrame, table: DataFrame, name: str) -> DataFrame:
    renamed = [F.col(c).alias(f"{c}_{name}") for c in table.columns if c != "doc_id"]
    return frame.join(table.select(F.col("doc_id").alias(name), *renamed), name)


def _likely_pairs(pairs: DataFrame, signatures: DataFrame, how: Banding) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures do not speak against a link."""
    both = _beside(_beside(pairs, signatures, "b"), signatures, "a")
    return common.map_batches(both, "a long, b long", partial(_likely, how)).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = _beside(_beside(pairs, texts, "b"), texts, "a")
    return common.map_batches(both, "a long, b long", partial(_confirm, percent)).distinct()


def _fit(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be similar enough at all."""
    return 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)


def _blocks(how: Banding, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block. Pairs between a block of members and a block of strays of
    one bucket that lie in different components and whose sizes and signatures agree. A pair
    that shares several buckets comes from the first of them alone, and once."""
    kept: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        if batch is not None:
            kept.append(batch)
        if not kept:
            continue
        table = pa.Table.from_batches(kept).combine_chunks()
        cell = [table.column(c).to_numpy() for c in ("band", "i", "j")]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cell], axis=0)) + 1
        ends = [0, *edge.tolist(), table.num_rows]
        whole = ends if batch is None else ends[:-1]
        kept = [] if batch is None else table.slice(ends[-2]).to_batches()
        ids, roots, sizes, role = (
            table.column(c).to_numpy() for c in ("doc_id", "root", "n_shingles", "role")
        )
        signatures = _signatures(table.column("signature").chunk(0), how)
        bands = table.column("bands").chunk(0).flatten().to_numpy().reshape(-1, how.bands)
        found: list[np.ndarray] = []
        for low, high in zip(whole[:-1], whole[1:]):
            left = low + np.flatnonzero(role[low:high] != STRAY)
            right = low + np.flatnonzero(role[low:high] == STRAY)
            if not len(left) or not len(right):
                continue
            near = roots[left][:, None] != roots[right][None, :]
            near &= _fit(sizes[left][:, None], sizes[right][None, :], how.percent)
            near &= (role[left] == MAIN)[:, None] | (ids[left][:, None] < ids[right][None, :])
            i, j = np.nonzero(near)
            for at in range(0, len(i), 1 << 14):
                x, y = left[i[at : at + (1 << 14)]], right[j[at : at + (1 << 14)]]
                shared = (bands[x] == bands[y]).argmax(axis=1)
                ok = bands[x, shared] == cell[0][low]
                ok &= _agree(signatures[x], signatures[y]) >= how.percent / 100 - how.margin
                found.append(np.stack([ids[x[ok]], ids[y[ok]]], axis=1))
        if found:
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            yield common.batch(a=pairs[:, 1].copy(), b=pairs[:, 0].copy())


def _across(
    buckets: DataFrame, roots: DataFrame, signatures: DataFrame, how: Banding
) -> DataFrame:
    """Pairs of members of one bucket in different components. The largest component's
    members are compared with the strays only, in blocks of about ``BLOCK`` by ``BLOCK``."""
    named = buckets.join(
        roots.withColumnRenamed("node", "doc_id"), "doc_id", "left"
    ).withColumn("root", F.coalesce("root", "doc_id"))
    per_root = named.groupBy("band", "root").agg(F.count("*").alias("n"))
    per_band = (
        per_root.groupBy("band")
        .agg(
            F.count("*").alias("roots"),
            F.sum("n").alias("members"),
            F.max(F.struct("n", "root")).alias("main"),
        )
        .filter("roots > 1")
        .select(
            "band",
            F.col("main.root").alias("main"),
            F.ceil(F.col("members") / BLOCK).cast("int").alias("rows"),
            F.ceil((F.col("members") - F.col("main.n")) / BLOCK).cast("int").alias("cols"),
        )
    )
    open_rows = named.join(per_band, "band").join(signatures, "doc_id")
    spot = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    common_columns = ["band", "doc_id", "root", "n_shingles", "signature", "bands"]
    kind = F.when(F.col("root") == F.col("main"), MAIN).otherwise(MEMBER).alias("role")
    left = open_rows.select(*common_columns, spot("rows").alias("i"), every("cols").alias("j"), kind)
    right = open_rows.filter(F.col("root") != F.col("main")).select(
        *common_columns, every("rows").alias("i"), spot("cols").alias("j"), F.lit(STRAY).alias("role")
    )
    return (
        left.unionByName(right)
        .repartition("band", "i", "j")
        .sortWithinPartitions("band", "i", "j")
        .mapInArrow(common.released(partial(_blocks, how)), "a long, b long")
        .distinct()
    )


def near_duplicates(docs: DataFrame, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept. Documents are
    linked from a similarity of ``percent`` on."""
    how = banding(percent)
    plain = common.texts(docs)
    sketch = common.written(common.map_batches(plain, SKETCH, partial(_sketch, how)), "sketch")
    same = ["n_shingles", "sum", "fold"]
    linked = sketch.filter("doc_id is not null and n_shingles > 0")
    classes = linked.groupBy(*same).agg(F.min("doc_id").alias("class_id"))
    classes = common.written(classes, "classes")
    firsts = linked.join(
        classes.withColumnRenamed("class_id", "doc_id"), ["doc_id", *same]
    ).dropDuplicates(["doc_id", *same])

    members = firsts.select("doc_id", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(
        F.count("*").alias("members"), F.min("doc_id").alias("least")
    ).filter("members > 1")
    buckets = common.written(members.join(sizes, "band"), "buckets")
    met = buckets.groupBy("doc_id").agg(F.sum("members").alias("met"))
    signatures = common.written(
        firsts.join(met, "doc_id").select("doc_id", "met", "n_shingles", "signature", "bands"),
        "signatures",
    )
    # The ids grow with the input, so they are never broadcast: one plan at every size.
    wanted = signatures.select("doc_id").distinct().hint("merge")
    texts = common.written(plain.join(wanted, "doc_id", "left_semi"), "candidates")
    hubs = (
        buckets.select("doc_id", "band")
        .join(signatures.select("doc_id", "met"), "doc_id")
        .groupBy("band")
        .agg(F.max(F.struct("met", -F.col("doc_id"))).alias("hub"))
        .select("band", (-F.col("hub.col2")).alias("hub"))
    )
    pairs = (
        buckets.join(hubs, "band")
        .select("doc_id", F.explode(F.array("hub", "least")).alias("hub"))
        .filter("doc_id != hub")
        .select(F.greatest("doc_id", "hub").alias("a"), F.least("doc_id", "hub").alias("b"))
        .distinct()
    )
    compared = signatures.select("doc_id", "n_shingles", "signature")
    # A document with several texts links their classes.
    several = linked.select("doc_id", *same).distinct().groupBy("doc_id").count().filter("count > 1")
    own = (
        linked.join(several.select("doc_id"), "doc_id")
        .join(classes, same)
        .select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
        .distinct()
    )
    found = _verified(_likely_pairs(pairs, compared, how), texts, percent).unionByName(own)
    links = common.written(found, "links")
    roots = components(links)
    across = _across(buckets.select("doc_id", "band"), roots, signatures.drop("met"), how)
    more = _verified(across, texts, percent)
    joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    roots = components(common.written(joined, "links"))

    named = classes.join(roots, F.col("class_id") == F.col("node"), "left").select(
        *same, F.coalesce("root", "class_id").alias("reached")
    )
    return (
        sketch.select("doc_id", *same)
        .join(named, same, "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("reached", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
