"""Stage results, overall results, leaders and medals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatsheet.functions import (
    NO_STAGE_RESULT,
    NOT_QUALIFIED,
    attempt_total,
    full_name,
    junior_tagged,
    text_or,
)
from heatsheet.operators import number_rows

# Symbols shown for first place and for the other leaders.
MEDALS = ("🏆", "🎁")
LEADERS = 5

#: Column that maps course ids to best totals where no stages are named.
BESTS = "bests"


def stage_column(stage: str) -> str:
    return f"course_{stage}"


def stage_columns(stages: list[str] | None) -> list[str]:
    return [BESTS] if stages is None else [stage_column(s) for s in stages]


def run_totals(run: DataFrame) -> DataFrame:
    """Run total per driver, course and run number, which is the declared key of ``run``."""
    return run.select(
        "dr_id", "crs_id", "run_num", F.round(attempt_total(), 2).alias("run_total")
    )


def stage_bests(run: DataFrame, stages: list[str]) -> DataFrame:
    """Best total per driver, one column per stage; only drivers with a timed run.

    One partial and one final aggregation: before the shuffle each task has already
    reduced a driver, however many runs they hold, to one row.
    """
    return (
        run.filter(F.col("seconds").isNotNull() & F.col("crs_id").isin(stages))
        .select("dr_id", "crs_id", attempt_total().alias("total"))
        .groupBy("dr_id")
        .agg(
            *[
                F.min(F.when(F.col("crs_id") == s, F.col("total"))).alias(stage_column(s))
                for s in stages
            ]
        )
    )


def course_bests(run: DataFrame, *by: str) -> DataFrame:
    """Best total per driver and course, and per ``by`` where given. Tasks reduce their runs
    before the shuffle, so a driver with many runs is no hot key."""
    return (
        run.filter(F.col("seconds").isNotNull())
        .select(*by, "dr_id", "crs_id", attempt_total().alias("total"))
        .groupBy(*by, "dr_id", "crs_id")
        .agg(F.min("total").alias("best"))
    )


def scores_of(bests: DataFrame, stages: list[str] | None) -> DataFrame:
    """Per driver of ``bests``: the sum of the best totals of all courses, the number of
    courses with one, and the best totals of the named stages, or of all courses as a map
    from course id to total where ``stages`` is None. A map has an entry a course at most.

    Courses stay rows until the sum, so any number of them counts. ``run.crs_id`` refers to
    ``course``; ``audit_foreign_keys`` reports where it does not.
    """
    if stages is None:
        entries = F.array_sort(F.collect_list(F.struct("crs_id", "best")))
        wide = [F.map_from_entries(entries).alias(BESTS)]
    else:
        wide = [
            F.min(F.when(F.col("crs_id") == s, F.col("best"))).alias(stage_column(s)) for s in stages
        ]
    return bests.groupBy("dr_id").agg(
        F.sum("best").alias("total"), F.count("*").alias("raced"), *wide
    )


def driver_scores(run: DataFrame, stages: list[str] | None) -> DataFrame:
    """``scores_of`` the bests of all runs."""
    return scores_of(course_bests(run), stages)


def scored(course: DataFrame, stages: list[str] | None) -> list[Column]:
    """Rounded bests of the named stages, the overall sum (NULL when any course has no
    result) and a flag. Which stages are named changes neither."""
    courses = course.agg(F.count("course_id")).scalar()
    qualified = F.coalesce(F.col("raced") == courses, F.lit(False))
    if stages is None:
        wide = [F.transform_values(BESTS, lambda _, best: F.round(best, 2)).alias(BESTS)]
    else:
        wide = [F.round(F.col(n), 2).alias(n) for n in stage_columns(stages)]
    return [
        *wide,
        F.when(qualified, F.round("total", 2)).alias("overall"),
        qualified.alias("qualified"),
    ]


def overall_sums(run: DataFrame, course: DataFrame) -> DataFrame:
    """Overall result of every driver with a timed run."""
    return sums_of(course_bests(run), course)


def sums_of(bests: DataFrame, course: DataFrame) -> DataFrame:
    """Overall result of every driver of ``bests``."""
    return scores_of(bests, []).select("dr_id", *scored(course, [])).drop("qualified")


def stage_results(
    driver: DataFrame,
    car: DataFrame,
    run: DataFrame,
    course: DataFrame,
    stages: list[str] | None = None,
) -> DataFrame:
    """One row per driver, with the bests of the named stages, overall and car model; unordered.

    Runs are aggregated before the join, so the join sees one row per driver.
    """
    return results_of(course_bests(run), driver, car, course, stages)


def results_of(
    bests: DataFrame,
    driver: DataFrame,
    car: DataFrame,
    course: DataFrame,
    stages: list[str] | None = None,
) -> DataFrame:
    """``stage_results`` from best totals per driver and course."""
    equipped = driver.join(car, F.col("car") == F.col("car_num"))
    scores = scores_of(bests, stages)
    return equipped.join(scores, F.col("driver_id") == F.col("dr_id"), "left").select(
        "driver_id", "first_name", "surname", "age", "model", *scored(course, stages)
    )


def ranking() -> list[Column]:
    """Qualified first by overall, then the rest; ties by id."""
    return [F.col("overall").asc_nulls_last(), F.col("driver_id").asc()]


def leader_medals(results: DataFrame) -> DataFrame:
    """driver_id and medal of the first five; the window sees only those rows."""
    first = results.select("driver_id", "overall").orderBy(*ranking()).limit(LEADERS)
    place = F.row_number().over(Window.orderBy(*ranking()))
    return first.select(
        "driver_id", F.when(place == 1, MEDALS[0]).otherwise(MEDALS[1]).alias("medal")
    )


def overall_results(
    driver: DataFrame,
    car: DataFrame,
    run: DataFrame,
    course: DataFrame,
    stages: list[str] | None = None,
) -> DataFrame:
    """Results page: tagged name, stage bests, overall and medal, in ranking order."""
    results = stage_results(driver, car, run, course, stages)
    return (
        results.join(F.broadcast(leader_medals(results)), "driver_id", "left")
        .select(
            "driver_id",
            junior_tagged(full_name(), F.col("age")).alias("driver_name"),
            "age",
            "model",
            *stage_columns(stages),
            "overall",
            "qualified",
            F.coalesce("medal", F.lit("")).alias("medal"),
        )
        .orderBy(*ranking())
    )


def result_labels(results: DataFrame, stages: list[str]) -> DataFrame:
    """Results with text in place of missing values, as shown to readers."""
    return results.withColumns(
        {
            **{n: text_or(F.col(n), NO_STAGE_RESULT) for n in stage_columns(stages)},
            "overall": text_or(F.col("overall"), NOT_QUALIFIED),
        }
    )


def course_labels(results: DataFrame, course: DataFrame) -> DataFrame:
    """Results that have a map of bests, as shown to readers: the map names every course
    there is, in order of their ids, whether the driver has a result on it or not."""
    ids = course.agg(F.array_sort(F.collect_set("course_id"))).scalar()

    def label(course_id: Column) -> Column:
        return text_or(F.try_element_at(F.col(BESTS), course_id), NO_STAGE_RESULT)

    # A lambda may read a column that holds the ids, but not the subquery itself.
    return (
        results.withColumn("_ids", ids)
        .withColumns(
            {
                BESTS: F.map_from_arrays("_ids", F.transform("_ids", label)),
                "overall": text_or(F.col("overall"), NOT_QUALIFIED),
            }
        )
        .drop("_ids")
    )


def positions(results: DataFrame, partitions: int | None = None) -> DataFrame:
    """Results with the position of every driver, at any number of drivers."""
    return number_rows(results, ranking(), "position", partitions)


def top_n(results: DataFrame, n: int = LEADERS) -> DataFrame:
    """Label and overall of the best ``n`` qualified drivers."""
    return (
        results.filter("qualified")
        .orderBy(*ranking())
        .limit(n)
        .select(
            "driver_id",
            F.concat(F.col("driver_id").cast("string"), F.lit(" "), full_name()).alias(
                "best_driver"
            ),
            "overall",
        )
    )


def chart_series(top: DataFrame) -> DataFrame:
    """Two parallel lists for a horizontal bar chart: bars go bottom-up, so best is last."""
    bars = F.reverse(
        F.array_sort(F.collect_list(F.struct("overall", "driver_id", "best_driver")))
    )
    return top.agg(bars.alias("bars")).select(
        F.col("bars.best_driver").alias("name_list"), F.col("bars.overall").alias("value_list")
    )
