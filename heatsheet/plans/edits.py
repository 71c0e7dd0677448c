"""Batches of run edits: folding, checking, applying and reporting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatsheet.functions import edited, refused
from heatsheet.operators import lookup_join

RUN_KEY = ["dr_id", "crs_id", "run_num"]

# What the edit form accepts.
SECONDS_RANGE = (10, 120)
SECONDS_DECIMALS = 2
CONES_RANGE = (0, 25)
WD_VALUES = ["0", "1"]


def _last_given(column: str):
    """Latest value that was supplied at all; an empty text counts as supplied."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("seq"))).alias(column)


def fold_edits(edits: DataFrame) -> DataFrame:
    """One edit per run, equal to applying that run's edits one by one in ``seq`` order.

    Keys arrive as text and are read as numbers here; an unreadable key matches no run
    and is reported by ``validate_edits``. Partial aggregation leaves one row per run
    and task, so a run edited very often does not gather in one place.
    """
    return (
        edits.select(
            "seq",
            F.col("dr_id").try_cast("bigint").alias("dr_id"),
            "crs_id",
            F.col("run_num").try_cast("int").alias("run_num"),
            "time",
            "cones",
            "wd",
        )
        .filter(F.col("dr_id").isNotNull() & F.col("crs_id").isNotNull() & F.col("run_num").isNotNull())
        .groupBy(*RUN_KEY)
        .agg(_last_given("time"), _last_given("cones"), _last_given("wd"))
    )


def apply_run_edits(run: DataFrame, edits: DataFrame) -> DataFrame:
    """New version of ``run``: time and cones are cleared, kept or replaced, wd kept or replaced.

    (dr_id, crs_id, run_num) is unique on both sides of the join, so no key is hot.
    """
    folded = fold_edits(edits).withColumnsRenamed(
        {"time": "_time", "cones": "_cones", "wd": "_wd"}
    )
    return run.join(folded, RUN_KEY, "left").select(
        *RUN_KEY,
        edited(F.col("_time"), F.col("seconds"), "double").alias("seconds"),
        edited(F.col("_cones"), F.col("cones"), "int").alias("cones"),
        F.coalesce(F.col("_wd").try_cast("int"), F.col("wd")).alias("wd"),
    )


def unmatched_edits(edits: DataFrame, run: DataFrame) -> DataFrame:
    """Edits, folded by their key as given, whose run does not exist: applying them changes
    nothing. A key that is NULL or no number matches no run and is reported too."""
    given = edits.groupBy(*RUN_KEY).agg(_last_given("time"), _last_given("cones"), _last_given("wd"))
    runs = run.select(*[F.col(c).alias(f"_{c}") for c in RUN_KEY])
    same = (
        (F.col("dr_id").try_cast("bigint") == F.col("_dr_id"))
        & (F.col("crs_id") == F.col("_crs_id"))
        & (F.col("run_num").try_cast("int") == F.col("_run_num"))
    )
    return given.join(runs, same, "left_anti")


def validate_edits(edits: DataFrame) -> DataFrame:
    """Edits the form would refuse, with the offending fields in ``reason``.

    NULL (keep) is always allowed, empty text (clear) for time and cones only.
    """
    return _judged(edits).filter(F.col("reason") != "")


def accepted_edits(edits: DataFrame) -> DataFrame:
    """Edits the form takes. Their times have two decimals, so no result ends in half a hundredth."""
    return _judged(edits).filter(F.col("reason") == "").drop("reason")


def _judged(edits: DataFrame) -> DataFrame:
    seconds = F.col("time").try_cast("decimal(18,6)")

    def not_given(column):
        return F.col(column).isNull() | (F.col(column) == "")

    checks = {
        "dr_id": F.col("dr_id").try_cast("bigint").isNotNull(),
        "crs_id": F.col("crs_id").isNotNull(),
        "run_num": F.col("run_num").try_cast("int").isNotNull(),
        "time": not_given("time")
        | (seconds.between(*SECONDS_RANGE) & (seconds == F.round(seconds, SECONDS_DECIMALS))),
        "cones": not_given("cones") | F.col("cones").try_cast("int").between(*CONES_RANGE),
        "wd": F.col("wd").isNull() | F.col("wd").isin(WD_VALUES),
    }
    return edits.select("*", refused(checks).alias("reason"))


def edit_receipts(edits: DataFrame, driver: DataFrame, course: DataFrame) -> DataFrame:
    """What is confirmed for each edit: who, where, and the submitted values as shown."""
    names = driver.select(F.col("driver_id").alias("_driver"), "first_name", "surname")
    courses = (
        course.select(F.col("course_id").alias("_course"), F.col("name").alias("course_name"))
    )
    keyed = edits.withColumn("dr_id", F.col("dr_id").try_cast("bigint"))
    named = lookup_join(keyed, names, "dr_id", "_driver", spread_by="seq")
    return lookup_join(named, courses, "crs_id", "_course").select(
        "seq",
        F.col("dr_id").alias("driver_id"),
        "first_name",
        "surname",
        F.col("crs_id").alias("course_id"),
        "course_name",
        F.col("run_num").alias("run_number"),
        F.coalesce("time", F.lit("None")).alias("time"),
        F.when(F.col("cones") != "", F.col("cones")).otherwise("None").alias("cones"),
        F.when(F.col("wd") == "1", "Some").otherwise("None").alias("wrong_direction"),
    )
