"""Operators against brute force, and on tables where one key holds a third of the rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from heatsheet.operators import (
    grid,
    lookup_join,
    number_rows,
    number_within,
    pair_all,
    stable,
)
from heatsheet.plans import cascade, edits, listings, registration, results


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffle_everything(conf):
    """Small partitions count as skewed and nothing is broadcast, as at a large scale."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "10KB")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20KB")
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    conf("spark.sql.files.maxPartitionBytes", "64KB")
    conf("spark.sql.files.openCostInBytes", "1KB")


@pytest.mark.parametrize("partitions", [None, 1, 7, 40])
def test_number_rows(spark, partitions):
    df = spark.range(1000, numPartitions=5).select(
        F.pmod(F.xxhash64("id"), F.lit(7)).alias("a"), "id"
    )
    df = df.withColumn("a", F.when(F.col("a") > 1, F.col("a")))
    order = [F.col("a").asc_nulls_last(), F.col("id").desc()]
    rows = number_rows(df, order, "n", partitions).collect()
    expected = sorted(rows, key=lambda r: (r.a is None, r.a or 0, -r.id))
    assert [r.n for r in expected] == list(range(1, 1001))


@pytest.mark.parametrize("chunk_keys", [1, 10, 64, 1 << 22])
def test_number_within(spark, chunk_keys):
    df = spark.range(-150, 450).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 10).alias("g"), "id"
    )
    rows = number_within(df, ["g"], "id", "n", chunk_keys).collect()
    assert len(rows) == 600
    groups = {}
    for r in sorted(rows, key=lambda r: r.id):
        groups.setdefault(r.g, []).append(r.n)
    assert all(numbers == list(range(1, len(numbers) + 1)) for numbers in groups.values())


def test_number_within_sorts_no_more_than_a_chunk(spark):
    df = spark.range(1000).select((F.col("id") % 1).alias("g"), "id")
    plan = _plan(number_within(df, ["g"], "id", "n", 100))
    assert re.search(r"row_number\(\) windowspecdefinition\(g#\d+L?, _chunk", plan)


@pytest.mark.parametrize("a_rows, b_rows", [(17, 11), (1, 50), (50, 1), (1, 1), (0, 5), (5, 0)])
@pytest.mark.parametrize("cell_pairs", [1 << 22, 2])
def test_pair_all(spark, conf, a_rows, b_rows, cell_pairs):
    left = spark.range(a_rows).withColumnRenamed("id", "a")
    right = spark.range(b_rows).withColumnRenamed("id", "b")
    paired = pair_all(left, right, 3, cell_pairs=cell_pairs)
    rows = [tuple(r) for r in paired.collect()]
    assert sorted(rows) == [(a, b) for a in range(a_rows) for b in range(b_rows)]
    assert "NestedLoop" not in _plan(paired) and "Cartesian" not in _plan(paired)


@pytest.mark.parametrize("big", [True, False])
def test_lookup_join_spreads_nulls_and_matches_only_keys(spark, conf, big):
    if big:
        _shuffle_everything(conf)
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.col("id") % 50).alias("key")
    )
    lookup = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    joined = lookup_join(rows, lookup, "key", "k", spread_by="id")
    found = joined.collect()
    assert len(found) == 3000
    assert all(r.twice == (None if r.key is None else 2 * r.key) for r in found)
    if big:
        assert "hashpartitioning(coalesce(key" in _plan(joined)


def _third_on_one(key, count):
    """Column that is 7 for a third of the ids and spread over ``count`` values otherwise."""
    return F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % count).alias(key)


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """30 000 drivers, a third with one car and a third with one caregiver; hot runs and edits."""
    folder = str(tmp_path_factory.mktemp("hot"))
    ids = spark.range(30_000, numPartitions=16)
    names = [
        F.concat(F.lit("First"), "id").alias("first_name"),
        F.concat(F.lit("Sur"), F.reverse(F.col("id").cast("string"))).alias("surname"),
    ]
    tables = {
        "driver": ids.select(
            F.col("id").alias("driver_id"), *names, F.lit(None).cast("date").alias("date_of_birth"),
            F.when(F.col("id") % 3 == 1, 15).alias("age"),
            F.when(F.col("id") % 3 == 1, F.lit(7)).cast("bigint").alias("caregiver"),
            _third_on_one("car", 5000).cast("bigint").alias("car"),
        ),
        "car": spark.range(5000).select(
            F.col("id").alias("car_num"), F.lit("m").alias("model"), F.lit("FWD").alias("drive_class")
        ),
        "course": spark.range(1).select(
            F.lit("A").alias("course_id"), F.lit("n").alias("name"), F.lit("i").alias("image")
        ),
        "run": ids.select(
            _third_on_one("dr_id", 30_000).cast("bigint").alias("dr_id"), F.lit("A").alias("crs_id"),
            F.col("id").cast("int").alias("run_num"), (F.col("id") % 90 + 10.5).alias("seconds"),
            F.lit(1).alias("cones"), F.lit(0).alias("wd"),
        ),
    }
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in tables}


def test_hot_car_and_caregiver_are_split(spark, conf, hot):
    _shuffle_everything(conf)
    listed = listings.list_drivers(hot["driver"], hot["car"])
    rows = listed.collect()
    assert len(rows) == 30_000
    assert sum(r.caregiver_name == "First7 Sur7" for r in rows) == 10_000
    assert "skew=true" in _plan(listed)


def test_hot_driver_is_split_in_run_listing(spark, conf, hot):
    _shuffle_everything(conf)
    listed = listings.runs_by_course(hot["run"], hot["driver"], hot["course"], "A")
    rows = listed.collect()
    assert len(rows) == 30_000
    assert [r.run_number for r in rows] == list(range(30_000))
    assert "skew=true" in _plan(listed)


def test_hot_driver_is_split_in_receipts(spark, conf, hot):
    _shuffle_everything(conf)
    batch = hot["run"].select(
        F.col("run_num").cast("bigint").alias("seq"), F.col("dr_id").cast("string").alias("dr_id"),
        "crs_id", F.col("run_num").cast("string").alias("run_num"), F.lit("20").alias("time"),
        F.lit("1").alias("cones"), F.lit("1").alias("wd"),
    )
    receipts = edits.edit_receipts(batch, hot["driver"], hot["course"])
    rows = receipts.collect()
    assert len(rows) == 30_000
    assert sum(r.first_name == "First7" for r in rows) >= 10_000
    assert "skew=true" in _plan(receipts)


def test_hot_driver_is_reduced_before_the_shuffle(spark, conf, hot):
    _shuffle_everything(conf)
    bests = results.stage_bests(hot["run"], ["A"])
    found = {r.dr_id: r.course_A for r in bests.collect()}
    expected = {}
    for i in range(30_000):
        driver = 7 if i % 3 == 0 else i
        expected[driver] = min(expected.get(driver, 1e9), i % 90 + 10.5 + 5)
    assert found == expected
    assert "partial_min" in _plan(bests)


def test_hot_keys_are_split_when_rekeyed_and_deleted(spark, conf, hot):
    _shuffle_everything(conf)
    mapping = hot["driver"].select(
        F.col("driver_id").alias("old"), (F.col("driver_id") + 100_000).alias("new")
    )
    changed = cascade.rekey_cascade(hot, "driver", mapping)
    runs = changed["run"]
    assert runs.filter("dr_id = 100007").count() == 10_001
    assert changed["driver"].filter("caregiver = 100007").count() == 10_000
    assert len(runs.collect()) == 30_000 and "skew=true" in _plan(runs)
    keys = hot["driver"].filter("driver_id % 2 = 1").select("driver_id")
    kept, blocked = cascade.delete_cascade(hot, "driver", keys)
    assert [r.key for r in blocked.collect()] == [7]
    left = kept["run"]
    gone = sum(1 for i in range(30_000) if i % 3 and i % 2 and i != 7)
    assert len(left.collect()) == 30_000 - gone and "skew=true" in _plan(left)


def test_a_long_chain_of_caregivers_takes_few_rounds(spark, monkeypatch):
    chain = spark.range(1, 66).selectExpr(
        "id as driver_id", "case when id > 1 then id - 1 end as caregiver", "id as car"
    )
    written = []

    def counted(df):
        written.append(df)
        return stable(df)

    monkeypatch.setattr(cascade, "stable", counted)
    keys = spark.range(1, 65).withColumnRenamed("id", "driver_id")
    blocked = cascade.blocked_keys(chain, "driver_id", keys)
    assert sorted(r.key for r in blocked.collect()) == list(range(1, 65))
    assert len(written) <= 2 + 3 * 8


def test_a_long_chain_of_cars_takes_few_rounds(spark, monkeypatch):
    chain = spark.range(1, 66).selectExpr(
        "id as driver_id", "case when id > 1 then id - 1 end as caregiver", "id as car"
    )
    rounds = []
    lengthened = cascade._lengthened

    def counted(*args):
        rounds.append(args)
        return lengthened(*args)

    monkeypatch.setattr(cascade, "_lengthened", counted)
    blocked = cascade.blocked_keys(chain, "car", spark.range(1, 65).toDF("car"))
    assert sorted(r.key for r in blocked.collect()) == list(range(1, 65))
    assert len(rounds) <= 8


@pytest.mark.parametrize("seed_number", range(3))
@pytest.mark.parametrize("growth", [0, 1, 4])
def test_blocked_cars_of_tangled_caregivers(spark, growth, seed_number):
    # Cars in cycles, forks and chains; a growth of 0 never makes longer jumps.
    chance = random.Random(seed_number)
    cars = 40
    drivers = []
    for number in range(120):
        near = chance.randrange(max(0, number - 9), min(120, number + 4))
        caregiver = near if chance.random() < 0.45 and near != number else None
        drivers.append((number, caregiver, number // 3))
    doomed = {c for c in range(cars) if chance.random() < 0.95}
    car_of = {d: c for d, _, c in drivers}
    kept = set(range(cars)) - doomed
    while True:
        more = {car_of[g] for _, g, c in drivers if g is not None and c in kept} - kept
        if not more:
            break
        kept |= more
    driver = spark.createDataFrame(drivers, "driver_id int, caregiver int, car int")
    keys = spark.createDataFrame([(c,) for c in doomed], "car int")
    blocked = cascade.blocked_keys(driver, "car", keys, growth)
    assert sorted(r.key for r in blocked.collect()) == sorted(kept & doomed)


def test_mappings_that_would_break_keys_are_refused(spark):
    course = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "z")], "course_id string, name string")
    run = spark.createDataFrame([(1, "A"), (1, "B"), (2, "C")], "dr_id int, crs_id string")
    tables = {"course": course, "run": run}
    pairs = [("A", "B"), ("B", "D"), ("B", "E"), ("C", "F"), ("X", "G"), ("Y", "G"), (None, "H")]
    mapping = spark.createDataFrame(pairs, "old string, new string")
    refused = cascade.rekey_refused(tables, "course", mapping).collect()
    assert {(r.old, r.new): r.reason for r in refused} == {
        ("A", "B"): "new exists",
        ("B", "D"): "old given twice",
        ("B", "E"): "old given twice",
        ("X", "G"): "new given twice",
        ("Y", "G"): "new given twice",
        (None, "H"): "missing key",
    }
    changed = cascade.rekey_cascade(tables, "course", mapping)
    assert sorted(r.course_id for r in changed["course"].collect()) == ["A", "B", "F"]
    assert sorted((r.dr_id, r.crs_id) for r in changed["run"].collect()) == [(1, "A"), (1, "B"), (2, "F")]


@pytest.mark.parametrize(
    "left, right, tasks, rows, columns",
    [
        (1, 4000, 8, 1, 32),  # one new driver, very many slots
        (4000, 1, 8, 32, 1),
        (1000, 1000, 8, 6, 6),
        (3, 5, 100, 3, 5),  # no more cells than pairs
        (0, 5, 8, 1, 5),
        (1 << 20, 1 << 20, 8, 512, 512),  # 4 194 304 pairs a cell
    ],
)
def test_grid_follows_the_sizes(spark, left, right, tasks, rows, columns):
    cells = spark.range(1).select(grid(F.lit(left), F.lit(right), tasks).alias("g")).first().g
    assert (cells.rows, cells.columns) == (rows, columns)


def test_one_driver_with_many_run_numbers_spreads_over_all_tasks(spark, conf):
    run = spark.range(1 << 20).selectExpr(
        "1 as dr_id", "cast(id % 3 as string) as crs_id", "cast(id * 3 as int) as run_num",
        "1.0D as seconds", "0 as cones", "0 as wd",
    )
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("blank-runs", "")
    blank = registration.blank_runs(spark.sql("select 9 as driver_id"), run)
    assert len(tracker.getJobIdsForGroup("blank-runs")) == 0
    sizes = [r["count"] for r in blank.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3 << 20
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8
    plan = _plan(blank)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
