"""Benchmark items inside documents, by size-partitioned MinHash containment search.

An item is found in a document that holds at least ``CONTAINED_PERCENT`` of the item's
distinct 5-word shingles. Words are runs of digits, letters a-z and characters beyond ASCII,
after lower-casing.

A banded index over whole documents would need thousands of bands for an item of forty
shingles in a document of twenty thousand. So the sizes set what is probed, and nothing is
missed: an item of n shingles may lack at most m = n - ceil(0.8 n) of them, so at least one of
its m + 1 smallest shingle hashes is in every document that holds it. Items are partitioned
by n into classes of m + 1 minima, a document's sketch is its hashes up to the largest
minimum of any item, and a minimum is probed only in documents large enough to hold the
item. Candidates are verified on the shingles themselves: a second reading picks out the texts
that have any, by id and hash of the text, and only those are shuffled.

An item with fewer than five words has them all as one shingle and is found in documents of
exactly those words. Items or documents without words match nothing. Rows that share a
``doc_id``, or have none, are judged together; repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatsheet.llm import common

WIDTH = 5
CONTAINED_PERCENT = 80
#: Minima (of 16 bytes) that may be broadcast; beyond it they are joined by a shuffle.
BROADCAST_MINIMA = 500_000
#: Candidates (an id and a hash each) whose documents may be picked out by a broadcast.
BROADCAST_CANDIDATES = 500_000

NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text) -> F.Column:
    return F.filter(F.split(F.lower(text), NO_WORD), lambda w: w != "")


def _shingles(column: str, of) -> F.Column:
    """Distinct ``of`` of every five consecutive words; all words if there are fewer."""
    w, n = F.col(column), F.size(column)
    wide = F.transform(
        F.sequence(F.lit(1), n - (WIDTH - 1)),
        lambda i: of(*[F.element_at(w, i + k) for k in range(WIDTH)]),
    )
    short = F.array(of(F.array_join(w, " ")))
    none = F.slice(short, 1, 0)
    return F.array_distinct(F.when(n >= WIDTH, wide).when(n > 0, short).otherwise(none))


def _hashes(column: str) -> F.Column:
    return _shingles(column, F.xxhash64)


def _strings(column: str) -> F.Column:
    return _shingles(column, lambda *w: F.concat_ws(" ", *w))


def items(benchmark: DataFrame) -> DataFrame:
    """Items with their shingles and the minima to probe."""
    listed = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"),
        words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w"),
    ).distinct()
    sized = (
        listed.filter(F.size("w") > 0)
        .withColumn("hashes", F.array_sort(_hashes("w")))
        .withColumn("shingles", _strings("w"))
        .withColumn("n_item", F.size("shingles"))
    )
    need = F.ceil(F.col("n_item") * CONTAINED_PERCENT / 100).cast("int")
    return sized.select(
        F.monotonically_increasing_id().alias("item"), "item_id", "n_item", "shingles",
        need.alias("need"),
        F.slice("hashes", F.lit(1), F.col("n_item") - need + 1).alias("minima"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, n_item, n_shared,
    containment."""
    known = common.written(items(benchmark), "items")
    minima = known.select("item", "need", F.explode("minima").alias("hash"))
    size, largest = minima.agg(F.count("*"), F.max("hash")).first()
    plain = common.texts(docs).withColumn("text_hash", F.xxhash64("text"))
    sketch = (
        plain.select("doc_id", "text_hash", words(F.col("text")).alias("w"))
        .select("doc_id", "text_hash", _hashes("w").alias("hashes"))
        .select(
            "doc_id",
            "text_hash",
            F.size("hashes").alias("n_doc"),
            # The outer form: the filter that Spark infers from a plain explode would be pushed
            # below and take the words apart anew for every shingle. The join drops NULLs.
            F.explode_outer(F.filter("hashes", lambda h: h <= F.lit(largest))).alias("hash"),
        )
    )
    probe = F.broadcast(minima) if size <= BROADCAST_MINIMA else minima
    found = sketch.join(probe, "hash").filter("need <= n_doc")
    candidates = common.written(
        found.select("doc_id", "text_hash", "item").distinct(), "candidates"
    )
    pairs = candidates.join(known.select("item", "item_id", "n_item", "shingles"), "item")
    # A row meets the candidates of its own text only, so rows that share an id, or have none,
    # do not meet each other's.
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("id_hash") == F.col("text_hash"))
    holders = candidates.select("doc_id", "text_hash").distinct()
    if candidates.count() <= BROADCAST_CANDIDATES:
        holders = F.broadcast(holders)
    held = (
        plain.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("id_hash"), "text")
        .join(holders, same, "left_semi")
        .distinct()
    )
    checked = held.join(pairs, same)
    shared = F.size(F.array_intersect("shingles", _strings("w")))
    return (
        checked.withColumn("w", words(F.col("text")))
        .select("doc_id", "item_id", "n_item", shared.alias("n_shared"))
        .groupBy("doc_id", "item_id", "n_item")
        .agg(F.max("n_shared").alias("n_shared"))
        .filter(F.col("n_shared") * 100 >= F.col("n_item") * CONTAINED_PERCENT)
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
    )


ORACLE = f"""
with d as (
  select doc_id, [x for x in string_split_regex(lower(coalesce(text, '')), '{NO_WORD}') if x <> ''] w
  from documents
), i as (
  select item_id, [x for x in string_split_regex(lower(coalesce(text, '')), '{NO_WORD}') if x <> ''] w
  from benchmark
), ds as (
  select distinct doc_id, unnest(case when len(w) >= 5
    then [array_to_string(w[k:k + 4], ' ') for k in range(1, len(w) - 3)]
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from d
), its as (
  select distinct item_id, unnest(case when len(w) >= 5
    then [array_to_string(w[k:k + 4], ' ') for k in range(1, len(w) - 3)]
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from i
), n as (select item_id, count(*)::int n_item from its group by all)
select doc_id, item_id, n_item, count(*)::int n_shared, count(*) / n_item containment
from ds join its using (s) join n using (item_id)
group by doc_id, item_id, n_item
having count(*) * 100 >= n_item * {CONTAINED_PERCENT}
"""
