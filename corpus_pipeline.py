"""From raw documents to packed training sequences, stage by stage.

Each stage takes the documents its predecessor kept and is written and reread before the
next. Rows keep all columns of ``documents``; a NULL ``doc_id`` stays NULL. Every row is judged
by itself: stages number their rows and compare these numbers, never ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatsheet.llm import common, decontaminate, exact_dedup, near_dedup, packing, quality

#: From this similarity on documents are near duplicates here; op 8 itself asks for 85.
NEAR_PERCENT = 80


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold. Learns from all documents that
    are labelled, as op 4 does, and judges those it is given."""
    weights = quality.train(
        common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    )
    return quality.accepted(docs, weights)


def _numbered(docs: DataFrame) -> DataFrame:
    """``row``, a number of its own for every row, and the row itself as ``d``. Written, so
    that every later read sees the same numbers."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")
    return common.written(docs.select(F.monotonically_increasing_id().alias("row"), whole), "rows")


def _as_documents(rows: DataFrame) -> DataFrame:
    """What the operators judge: every row is a document of its own, whatever its doc_id."""
    return rows.select(F.col("row").alias("doc_id"), F.col("d.text").alias("text"))


def _chosen(rows: DataFrame, groups: DataFrame, choose) -> DataFrame:
    """The row of each group of ``groups`` (row, group) that ``choose`` takes by doc_id and row."""
    ids = rows.select("row", F.col("d.doc_id").cast("long").alias("id"))
    best = (
        groups.join(ids, "row")
        .groupBy("group")
        .agg(choose(F.col("id"), F.col("row")).alias("row"))
        .select("row")
    )
    return rows.join(best, "row", "left_semi").select("d.*")


def _largest(id_, row) -> F.Column:
    return F.max(F.struct(id_, row))["row"]


def _smallest(id_, row) -> F.Column:
    return F.min(F.struct(id_.isNull(), id_, row))["row"]


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: one with the largest doc_id, and one without a
    doc_id only if the whole group has none."""
    rows = _numbered(docs)
    judged = exact_dedup.exact_duplicates(_as_documents(rows))
    groups = judged.select(F.col("doc_id").alias("row"), F.col("keep_id").alias("group"))
    return _chosen(rows, groups, _largest)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of documents at least ``NEAR_PERCENT`` similar: one with the smallest doc_id, and one
    without a doc_id only if the whole component has none."""
    rows = _numbered(docs)
    judged = near_dedup.near_duplicates(_as_documents(rows), NEAR_PERCENT)
    groups = judged.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    return _chosen(rows, groups, _smallest)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    rows = _numbered(docs)
    found = decontaminate.contaminated(_as_documents(rows), common.read(spark, sf_dir, "benchmark"))
    # Written, so that its size is known when the join is planned: a small one is broadcast and
    # the rows are not shuffled.
    leaky = common.written(found.select(F.col("doc_id").alias("row")).distinct(), "leaky")
    return rows.join(leaky, "row", "left_anti").select("d.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in the training sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written and reread."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: Training, MinHash links and packing cannot be said in SQL; the tests compare the rows that
#: the exact, near-duplicate and decontamination stages keep with brute force.
ORACLE_SQL = None
