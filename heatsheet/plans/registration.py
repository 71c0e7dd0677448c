"""Registration of new drivers: age rules, caregivers, ids and blank runs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatsheet import schemas
from heatsheet.functions import (
    CAREGIVER_AGES,
    JUNIOR_AGES,
    birth_date,
    completed_years,
    full_name,
    refused,
    text_or,
)
from heatsheet.operators import GRID_PAIRS, lookup_join, number_rows, pair_all

# Outcomes of an application.
INSERT_ADULT = "insert_adult"
INSERT_JUNIOR = "insert_junior"
INSERT_WITH_CAREGIVER = "insert_with_caregiver"
NEEDS_CAREGIVER = "needs_caregiver"
REJECT_FORM = "reject_form"
REJECT_CAR = "reject_car"
REJECT_NO_DOB = "reject_no_dob"
REJECT_TOO_YOUNG = "reject_too_young"
REJECT_CAREGIVER = "reject_caregiver"
INSERTS = [INSERT_ADULT, INSERT_JUNIOR, INSERT_WITH_CAREGIVER]

# What the registration form accepts.
NAME_PATTERN = r"^(?=.*[A-Za-z])([A-Za-z\s]+)$"
BIRTH_DATE_RANGE = ("1940-01-01", "2023-12-31")

DECISION = [
    "applicant_id", "first_name", "surname", "date_of_birth", "age", "caregiver", "car",
    "caregiver_name", "outcome",
]


def classify_applicants(applicants: DataFrame, as_of: date | None = None) -> DataFrame:
    """Applicants with ``born``, ``age`` and the outcome of the age rules."""
    today = F.current_date() if as_of is None else F.lit(as_of)
    aged = applicants.withColumn("born", birth_date(F.col("date_of_birth"))).withColumn(
        "age", completed_years(F.col("born"), today)
    )
    age = F.col("age")
    return aged.withColumn(
        "outcome",
        F.when(~F.col("junior_driver").eqNullSafe("on"), INSERT_ADULT)
        .when(age.isNull(), REJECT_NO_DOB)
        .when(age < JUNIOR_AGES[0], REJECT_TOO_YOUNG)
        .when(age.between(*CAREGIVER_AGES), NEEDS_CAREGIVER)
        .when(age <= JUNIOR_AGES[1], INSERT_JUNIOR)
        .otherwise(INSERT_ADULT),
    )


def decide(
    applicants: DataFrame, driver: DataFrame, car: DataFrame, as_of: date | None = None
) -> DataFrame:
    """Final outcome per applicant, with the values that would be stored.

    What the form refuses, or a car that does not exist, comes before the age rules: the
    tables could not hold such a driver. A chosen caregiver must be a driver without a stored age. Only applicants who need
    one look one up; all others, and those who chose none, are spread by their own id.
    """
    known = car.select(
        F.col("car_num").cast("bigint").alias("_known_car"), F.lit(True).alias("has_car")
    )
    fields = classify_applicants(applicants, as_of).withColumns(
        {"_car": F.col("car_num").try_cast("bigint"), "reason": refused(form_checks())}
    )
    classified = lookup_join(
        fields, known, "_car", "_known_car", spread_by="applicant_id"
    ).withColumn(
        "outcome",
        F.when(F.col("reason") != "", REJECT_FORM)
        .when(F.col("has_car").isNull(), REJECT_CAR)
        .otherwise(F.col("outcome")),
    )
    needs = F.col("outcome") == NEEDS_CAREGIVER
    candidates = driver.filter(F.col("age").isNull()).select(
        F.col("driver_id").cast("bigint").alias("guardian_id"),
        full_name().alias("caregiver_name"),
        F.lit(True).alias("is_candidate"),
    )
    chosen = classified.withColumn(
        "chosen", F.when(needs & (F.col("caregiver") != ""), F.col("caregiver"))
    ).withColumn("guardian_key", F.col("chosen").try_cast("bigint"))
    outcome = (
        F.when(F.col("chosen").isNull(), F.col("outcome"))
        .when(F.col("is_candidate"), INSERT_WITH_CAREGIVER)
        .otherwise(REJECT_CAREGIVER)
    )
    junior = F.col("outcome").isin(INSERT_JUNIOR, INSERT_WITH_CAREGIVER)
    return (
        lookup_join(chosen, candidates, "guardian_key", "guardian_id", spread_by="applicant_id")
        .withColumn("outcome", outcome)
        .select(
            "applicant_id",
            "first_name",
            "surname",
            F.when(junior, F.col("born")).alias("date_of_birth"),
            F.when(junior, F.col("age")).alias("age"),
            F.when(F.col("outcome") == INSERT_WITH_CAREGIVER, F.col("guardian_key")).alias("caregiver"),
            F.col("car_num").try_cast("int").alias("car"),
            F.when(F.col("outcome") == INSERT_WITH_CAREGIVER, F.col("caregiver_name")).alias(
                "caregiver_name"
            ),
            "outcome",
        )
    )


def assign_ids(accepted: DataFrame, driver: DataFrame, partitions: int | None = None) -> DataFrame:
    """Accepted applicants with the next free ``driver_id``s, in order of application.

    The last used id is checkpointed with the numbered rows, so drivers, blank runs and
    receipts made from the result agree even after some of them have been stored.
    """
    last_id = driver.agg(F.coalesce(F.max("driver_id"), F.lit(0))).scalar()
    numbered = number_rows(
        accepted.select("*", last_id.alias("_last_id")),
        [F.col("applicant_id").asc()],
        "_number",
        partitions,
    )
    return numbered.withColumn("driver_id", F.col("_last_id") + F.col("_number")).drop(
        "_last_id", "_number"
    )


def register_drivers(
    applicants: DataFrame,
    driver: DataFrame,
    car: DataFrame,
    as_of: date | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Accepted applicants with their ids and stored values."""
    accepted = decide(applicants, driver, car, as_of).filter(F.col("outcome").isin(INSERTS))
    return assign_ids(accepted, driver, partitions).select("driver_id", *DECISION)


def register_with_caregiver(
    applicants: DataFrame,
    driver: DataFrame,
    car: DataFrame,
    as_of: date | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Only the applicants who needed a caregiver and chose a valid one."""
    accepted = decide(applicants, driver, car, as_of).filter(
        F.col("outcome") == INSERT_WITH_CAREGIVER
    )
    return assign_ids(accepted, driver, partitions).select("driver_id", *DECISION)


def rejected_applicants(
    applicants: DataFrame, driver: DataFrame, car: DataFrame, as_of: date | None = None
) -> DataFrame:
    """Applicants not registered, with the outcome that says why."""
    return decide(applicants, driver, car, as_of).filter(~F.col("outcome").isin(INSERTS)).select(
        "applicant_id", "first_name", "surname", "outcome"
    )


def new_driver_rows(registered: DataFrame, driver: DataFrame) -> DataFrame:
    """Registered applicants as rows of ``driver``, with its columns and types."""
    return registered.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in driver.schema]
    )


def registration_receipts(registered: DataFrame) -> DataFrame:
    """What is confirmed to each registered driver, with N/A for missing values."""
    return registered.select(
        "driver_id",
        "first_name",
        "surname",
        text_or(F.col("date_of_birth"), "N/A").alias("date_of_birth"),
        text_or(F.col("age"), "N/A").alias("age"),
        text_or(F.col("caregiver_name"), "N/A").alias("caregiver"),
        F.col("car").alias("car_number"),
    )


#: Run numbers that travel as one row. Numbers are distinct, so a row holds at most so many.
NUMBERS_A_ROW = 256


def _spans(run: DataFrame) -> DataFrame:
    """The distinct run numbers, up to ``NUMBERS_A_ROW`` of them a row, as ``numbers``."""
    span = F.floor(F.col("run_num") / NUMBERS_A_ROW)
    return run.groupBy(span.alias("span")).agg(F.collect_set("run_num").alias("numbers"))


def _courses() -> Column:
    """The ids of all courses that have a run, of which one character each allows few."""
    return F.array_sort(F.collect_set("crs_id"))


def blank_slots(run: DataFrame) -> DataFrame:
    """Every course that has a run with every run number that occurs."""
    return (
        _spans(run)
        .select("numbers", F.explode(run.agg(_courses()).scalar()).alias("crs_id"))
        .select("crs_id", F.explode("numbers").alias("run_num"))
    )


def blank_runs(new_drivers: DataFrame, run: DataFrame) -> DataFrame:
    """An untimed run for each new driver on every slot, as rows of ``run``.

    The result is a product by definition, made on a grid of tasks; run numbers reach
    them in sets and become rows only there.
    """
    ids = new_drivers.select(F.col("driver_id").alias("dr_id"))
    # One reading gives the courses and, to a few per cent, how many spans there are.
    span = F.floor(F.col("run_num") / NUMBERS_A_ROW)
    seen = run.agg(
        F.struct(F.approx_count_distinct(span).alias("spans"), _courses().alias("courses"))
    ).scalar()
    slots = _spans(run).select("numbers", F.explode(seen["courses"]).alias("crs_id"))
    many = seen["spans"] * F.size(seen["courses"])
    types = {f.name: f.dataType for f in run.schema}
    blank = {"seconds": F.lit(None), "cones": F.lit(None), "wd": F.lit(0)}
    pairs = pair_all(ids, slots, right_rows=many, cell_pairs=GRID_PAIRS // NUMBERS_A_ROW)
    return pairs.select(
        F.col("dr_id").cast(types["dr_id"]).alias("dr_id"),
        "crs_id",
        F.explode("numbers").alias("run_num"),
        *[value.cast(types[name]).alias(name) for name, value in blank.items()],
    )


def form_checks() -> dict:
    """What the form asks of each field, and that names fit their columns."""
    earliest, latest = [F.lit(date.fromisoformat(d)) for d in BIRTH_DATE_RANGE]
    return {
        **{
            name: F.col(name).rlike(NAME_PATTERN) & (F.length(name) <= most)
            for name, most in schemas.MAX_LENGTHS["driver"].items()
        },
        "car_num": F.col("car_num").try_cast("int").isNotNull(),
        "date_of_birth": F.col("date_of_birth").isNull()
        | (F.col("date_of_birth") == "")
        | birth_date(F.col("date_of_birth")).between(earliest, latest),
    }


def validate_applicants(applicants: DataFrame) -> DataFrame:
    """Applicants the form would refuse, with the offending fields in ``reason``."""
    return applicants.select("*", refused(form_checks()).alias("reason")).filter(
        F.col("reason") != ""
    )
