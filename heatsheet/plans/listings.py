"""Course, driver, junior and run listings, and the pick lists of the forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatsheet.functions import (
    JUNIOR_AGES,
    attempt_total,
    collated,
    full_name,
    id_label,
    image_path,
    junior_highlight,
    text_or,
    wd_label,
)
from heatsheet.operators import lookup_join, number_rows


def list_courses(course: DataFrame) -> DataFrame:
    return course.select(
        "course_id", "name", "image", image_path(F.col("image")).alias("image_path")
    )


def guardian_names(driver: DataFrame) -> DataFrame:
    """Two-column lookup used to name a driver's caregiver."""
    return driver.select(
        F.col("driver_id").alias("guardian_id"), full_name().alias("caregiver_name")
    )


def with_caregiver_name(driver: DataFrame, everyone: DataFrame) -> DataFrame:
    """Add ``caregiver_name``. Most drivers have none, so NULL keys are spread by own id."""
    return lookup_join(
        driver, guardian_names(everyone), "caregiver", "guardian_id", spread_by="driver_id"
    )


def _names(collation: str | None, *columns: str) -> list[Column]:
    return [collated(F.col(c), collation) for c in columns]


def _in_order(rows: DataFrame, order: list[Column], numbered: bool) -> DataFrame:
    """Rows in an order that ends in a unique column, or with their place in it as ``pos``.

    A sorted table loses its order when it is stored or joined; the place stays. Numbering
    checkpoints the rows, so it runs a job when the listing is made.
    """
    return number_rows(rows, order, "pos") if numbered else rows.orderBy(*order)


def _pos(numbered: bool) -> list[str]:
    return ["pos"] if numbered else []


def list_drivers(
    driver: DataFrame, car: DataFrame, collation: str | None = None, numbered: bool = False
) -> DataFrame:
    """All drivers with car and caregiver, by surname and first name.

    Names sort by code points, or as ``collation`` has it; ``numbered`` adds ``pos``.
    """
    equipped = driver.join(car, F.col("car") == F.col("car_num"))
    order = [*_names(collation, "surname", "first_name"), F.col("driver_id")]
    return (
        _in_order(with_caregiver_name(equipped, driver), order, numbered)
        .select(
            *_pos(numbered),
            "driver_id",
            full_name().alias("driver_name"),
            "date_of_birth",
            "age",
            "caregiver_name",
            "model",
            "drive_class",
            junior_highlight(F.col("age")).alias("junior"),
        )
    )


def shown(listing: DataFrame, columns: list[str], missing: str = "") -> DataFrame:
    """Listing with the named columns as text and ``missing`` in place of NULL."""
    return listing.withColumns({c: text_or(F.col(c), missing) for c in columns})


def driver_picklist(driver: DataFrame) -> DataFrame:
    return driver.select(
        "driver_id", "first_name", "surname", F.concat_ws(" ", "first_name", "surname").alias("label")
    )


def car_picklist(car: DataFrame) -> DataFrame:
    return car.select(
        "car_num", "model", "drive_class", id_label("car_num", "model", "drive_class").alias("label")
    )


def caregiver_candidates(driver: DataFrame) -> DataFrame:
    """Drivers without a stored age, that is adults."""
    return driver.filter(F.col("age").isNull()).select(
        "driver_id",
        "first_name",
        "surname",
        id_label("driver_id", "first_name", "surname", gap=" ").alias("label"),
    )


def edit_picklists(driver: DataFrame, course: DataFrame) -> DataFrame:
    """Choices for finding runs to edit, by driver or by course."""
    drivers = driver.select(
        F.lit("driver").alias("choice"),
        F.col("driver_id").cast("string").alias("id"),
        F.concat(F.col("driver_id").cast("string"), F.lit("  "), full_name()).alias("label"),
    )
    courses = course.select(
        F.lit("course").alias("choice"),
        F.col("course_id").alias("id"),
        id_label("course_id", "name").alias("label"),
    )
    return drivers.unionByName(courses)


def junior_list(
    driver: DataFrame,
    ages: tuple[int, int] = JUNIOR_AGES,
    collation: str | None = None,
    numbered: bool = False,
) -> DataFrame:
    """Drivers of junior age with their caregiver, oldest first, then by surname."""
    juniors = driver.filter(F.col("age").between(*ages))
    order = [F.desc("age"), *_names(collation, "surname"), F.col("driver_id")]
    return _in_order(with_caregiver_name(juniors, driver), order, numbered).select(
        *_pos(numbered),
        "driver_id",
        "first_name",
        "surname",
        "date_of_birth",
        "age",
        "caregiver_name",
    )


def _one_driver(driver: DataFrame, driver_id: int) -> DataFrame:
    # driver_id is the primary key: at most one row, safe to broadcast.
    return F.broadcast(driver.filter(F.col("driver_id") == driver_id))


def _profile(driver: DataFrame, car: DataFrame, driver_id: int) -> DataFrame:
    return (
        car.join(_one_driver(driver, driver_id), F.col("car_num") == F.col("car"))
        .select("driver_id", "first_name", "surname", "model", "drive_class")
    )


def run_details(
    driver: DataFrame,
    run: DataFrame,
    course: DataFrame,
    car: DataFrame,
    driver_id: int,
    numbered: bool = False,
) -> DataFrame:
    """Runs of one driver with course, car and run total, by course and run number.

    (driver, course, run number) is unique, so each total is of a single row and the
    runs are not regrouped: they stay where the scan puts them until the final sort.
    """
    courses = course.select("course_id", F.col("name").alias("course_name"))
    rows = (
        run.filter(F.col("dr_id") == driver_id)
        .join(
            F.broadcast(_profile(driver, car, driver_id)), F.col("dr_id") == F.col("driver_id")
        )
        .join(courses, F.col("crs_id") == F.col("course_id"))
    )
    return _in_order(rows, [F.col("course_id"), F.col("run_num")], numbered).select(
        *_pos(numbered),
        "driver_id",
        "first_name",
        "surname",
        "model",
        "drive_class",
        "course_name",
        "run_num",
        "seconds",
        "cones",
        "wd",
        F.round(attempt_total(), 2).alias("run_total"),
    )


def run_header(driver: DataFrame, run: DataFrame, car: DataFrame, driver_id: int) -> DataFrame:
    """Profile shown above the run details: one row, or none for a driver without runs."""
    has_runs = run.filter(F.col("dr_id") == driver_id).select("dr_id").distinct()
    return _profile(driver, car, driver_id).join(
        F.broadcast(has_runs), F.col("driver_id") == F.col("dr_id"), "left_semi"
    )


def runs_by_driver(
    run: DataFrame, driver: DataFrame, course: DataFrame, dr_id: int, numbered: bool = False
) -> DataFrame:
    """Runs of one driver for editing, by course and run number."""
    courses = course.select("course_id", F.col("name").alias("course_name"))
    names = _one_driver(driver, dr_id).select("driver_id", "first_name", "surname")
    rows = (
        run.filter(F.col("dr_id") == dr_id)
        .join(F.broadcast(names), F.col("dr_id") == F.col("driver_id"))
        .join(courses, F.col("crs_id") == F.col("course_id"))
    )
    order = [F.col(c) for c in ("dr_id", "first_name", "surname", "course_id", "run_num")]
    return _in_order(rows, order, numbered).select(
        *_pos(numbered),
        "dr_id",
        "first_name",
        "surname",
        "course_id",
        "course_name",
        F.col("run_num").alias("run_number"),
        F.col("seconds").alias("time"),
        "cones",
        wd_label(F.col("wd")).alias("wd"),
    )


def runs_by_course(
    run: DataFrame, driver: DataFrame, course: DataFrame, crs_id: str, numbered: bool = False
) -> DataFrame:
    """Runs on one course for editing, by run number and driver."""
    # course_id is the primary key: at most one row, safe to broadcast.
    chosen = F.broadcast(
        course.filter(F.col("course_id") == crs_id).select(
            "course_id", F.col("name").alias("course_name")
        )
    )
    names = driver.select("driver_id", "first_name", "surname")
    rows = (
        run.filter(F.col("crs_id") == crs_id)
        .join(names, F.col("dr_id") == F.col("driver_id"))
        .join(chosen, F.col("crs_id") == F.col("course_id"))
    )
    order = [F.col(c) for c in ("course_id", "run_num", "dr_id")]
    return _in_order(rows, order, numbered).select(
        *_pos(numbered),
        "course_id",
        "course_name",
        F.col("run_num").alias("run_number"),
        "dr_id",
        "first_name",
        "surname",
        F.col("seconds").alias("time"),
        "cones",
        wd_label(F.col("wd")).alias("wd"),
    )


def runs_to_edit(
    run: DataFrame,
    driver: DataFrame,
    course: DataFrame,
    dr_id: int | None = None,
    crs_id: str | None = None,
    numbered: bool = False,
) -> DataFrame:
    """Runs of a driver, else of a course, else the choices; the driver wins over the course."""
    if dr_id is not None:
        return runs_by_driver(run, driver, course, dr_id, numbered)
    if crs_id is not None:
        return runs_by_course(run, driver, course, crs_id, numbered)
    return edit_picklists(driver, course)
