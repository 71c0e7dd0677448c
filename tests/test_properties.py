"""Properties that hold for any set of runs and edits."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heatsheet import schemas
from heatsheet.plans import edits, results

STAGES = ["A", "B", "C"]
SETTINGS = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)

cents = st.integers(1000, 12000).map(lambda c: c / 100)
keys = st.tuples(st.integers(1, 6), st.sampled_from(STAGES), st.integers(1, 3))
attempts = st.dictionaries(
    keys,
    st.tuples(
        st.none() | cents, st.none() | st.integers(0, 25), st.integers(0, 1)
    ),
    min_size=1,
    max_size=40,
)
texts = st.none() | st.just("") | st.integers(10, 120).map(str)
batches = st.lists(
    st.tuples(keys, texts, texts, st.none() | st.sampled_from(["0", "1"])), max_size=30
)


def _runs(spark, table):
    return spark.createDataFrame([(*k, *v) for k, v in table.items()], schemas.RUN)


def _entrants(spark):
    driver = spark.createDataFrame(
        [(i, f"F{i}", f"S{i}", None, None, None, 1) for i in range(1, 8)], schemas.DRIVER
    )
    return driver, spark.createDataFrame([(1, "m", "FWD")], schemas.CAR)


def _total(attempt):
    seconds, cones, wd = attempt
    return None if seconds is None else seconds + 5 * (cones or 0) + 10 * wd


@SETTINGS
@given(table=attempts)
def test_results_equal_brute_force(spark, table):
    driver, car = _entrants(spark)
    scored = results.stage_results(
        driver, car, _runs(spark, table), spark.createDataFrame([(s,) for s in STAGES], "course_id string"), STAGES
    )
    rows = scored.orderBy(*results.ranking()).collect()
    assert len(rows) == 7
    for row in rows:
        bests = []
        for stage in STAGES:
            totals = [
                _total(v) for (d, s, _), v in table.items() if d == row.driver_id and s == stage
            ]
            best = min((t for t in totals if t is not None), default=None)
            bests.append(best)
            assert row[f"course_{stage}"] == (None if best is None else pytest.approx(best, abs=0.006))
        if None in bests:
            assert row.overall is None and not row.qualified
        else:
            assert row.overall == pytest.approx(sum(bests), abs=0.006) and row.qualified
    top = [r.driver_id for r in results.top_n(scored, 3).collect()]
    assert top == [r.driver_id for r in rows if r.qualified][:3]


@SETTINGS
@given(table=attempts, batch=batches)
def test_folded_edits_equal_one_by_one(spark, table, batch):
    expected = dict(table)
    for key, time, cones, wd in batch:
        if key in expected:
            seconds, hit, wrong = expected[key]
            if time is not None:
                seconds = None if time == "" else float(time)
            if cones is not None:
                hit = None if cones == "" else int(cones)
            expected[key] = (seconds, hit, wrong if wd is None else int(wd))
    rows = [
        (seq, str(key[0]), key[1], str(key[2]), time, cones, wd)
        for seq, (key, time, cones, wd) in enumerate(batch)
    ]
    staged = spark.createDataFrame(rows, schemas.EDITS).orderBy(F.rand(7))
    changed = edits.apply_run_edits(_runs(spark, table), staged).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in changed} == expected
    missed = {tuple(r[:3]) for r in edits.unmatched_edits(staged, _runs(spark, table)).collect()}
    assert missed == {tuple(map(str, key)) for key, *_ in batch if key not in table}


def test_edits_that_keep_everything_change_nothing(spark, seed):
    staged = seed["run"].select(
        F.monotonically_increasing_id().alias("seq"), F.col("dr_id").cast("string").alias("dr_id"),
        "crs_id", F.col("run_num").cast("string").alias("run_num"),
        *[F.lit(None).cast("string").alias(c) for c in ("time", "cones", "wd")],
    )
    changed = edits.apply_run_edits(seed["run"], staged)
    assert changed.exceptAll(seed["run"]).isEmpty() and changed.count() == 108
