"""Age rules at their boundaries."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from heatsheet import schemas
from heatsheet.functions import birth_date, completed_years
from heatsheet.plans import registration

AS_OF = date(2024, 1, 1)

CASES = [
    ("02-01-2012", 11, "reject_too_young"),
    ("01-01-2012", 12, "needs_caregiver"),
    ("2011-12-31", 12, "needs_caregiver"),
    ("2007-01-02", 16, "needs_caregiver"),
    ("2007-01-01", 17, "insert_junior"),
    ("29-02-2004", 19, "insert_junior"),
    ("1998-01-02", 25, "insert_junior"),
    ("1998-01-01", 26, "insert_adult"),
    ("2023-06-01", 0, "reject_too_young"),
    ("2024-06-01", -1, "reject_too_young"),
    ("31-02-2005", None, "reject_no_dob"),
    ("", None, "reject_no_dob"),
    (None, None, "reject_no_dob"),
    ("1-2-2005", 18, "insert_junior"),
    ("2005/02/01", None, "reject_no_dob"),
    ("001-02-2005", None, "reject_no_dob"),
    ("01-02-05", None, "reject_no_dob"),
]


def _applicants(spark, rows):
    return spark.createDataFrame(rows, schemas.APPLICANTS)


def test_age_rules(spark):
    rows = [(i, "New", "Driver", "11", "on", born, None) for i, (born, _, _) in enumerate(CASES)]
    found = registration.classify_applicants(_applicants(spark, rows), AS_OF).collect()
    assert {r.applicant_id: (r.age, r.outcome) for r in found} == {
        i: (age, outcome) for i, (_, age, outcome) in enumerate(CASES)
    }


def test_birth_date_is_ignored_without_the_junior_box(spark):
    rows = [(i, "New", "Driver", "11", None, born, None) for i, (born, _, _) in enumerate(CASES)]
    found = registration.classify_applicants(_applicants(spark, rows), AS_OF).collect()
    assert {r.outcome for r in found} == {"insert_adult"}


def test_leap_day_birthday(spark):
    days = [date(2024, 2, 28), date(2024, 2, 29), date(2023, 2, 28), date(2023, 3, 1)]
    ages = [
        spark.range(1)
        .select(completed_years(birth_date(F.lit("29-02-2004")), F.lit(day)).alias("age"))
        .first()
        .age
        for day in days
    ]
    assert ages == [19, 20, 18, 19]


@pytest.mark.parametrize("partitions", [None, 3])
def test_register(spark, seed, partitions):
    rows = [
        (10, "Ann", "Adult", "11", None, "2010-01-01", "135"),
        (11, "Jo", "Junior", "17", "on", "05-06-2003", "135"),
        (12, "Kay", "Kid", "18", "on", "2010-01-01", "135"),
        (13, "Kim", "Kid", "18", "on", "2010-01-01", "129"),
        (14, "Kit", "Kid", "18", "on", "2010-01-01", "nobody"),
        (15, "Kat", "Kid", "18", "on", "2010-01-01", None),
        (16, "Tot", "Kid", "18", "on", "2020-01-01", "135"),
        (17, "Old", "Adult", "20", "on", "1980-01-01", "135"),
        (18, "Ken", "Kid", "18", "on", "2010-01-01", ""),
        (19, "Ann", "Adult", "999", None, None, None),
        (20, "Ann", "Adult", None, None, None, None),
        (21, "Ann", "Adult", "x", "on", "2010-01-01", "135"),
        (22, " ", "Adult", "11", None, None, None),
        (23, "Ann", "Adult", "11", None, "2024-01-01", None),
    ]
    registered = registration.register_drivers(
        _applicants(spark, rows), seed["driver"], seed["car"], AS_OF, partitions
    )
    stored = {
        r.applicant_id: (r.driver_id, r.date_of_birth, r.age, r.caregiver, r.car, r.outcome)
        for r in registered.collect()
    }
    assert stored == {
        10: (138, None, None, None, 11, "insert_adult"),
        11: (139, date(2003, 6, 5), 20, None, 17, "insert_junior"),
        12: (140, date(2010, 1, 1), 14, 135, 18, "insert_with_caregiver"),
        17: (141, None, None, None, 20, "insert_adult"),
    }
    receipts = {r.driver_id: r for r in registration.registration_receipts(registered).collect()}
    assert receipts[140].caregiver == "Maggie Atwood"
    assert (receipts[138].date_of_birth, receipts[138].age, receipts[138].caregiver) == (
        "N/A", "N/A", "N/A",
    )
    refused = registration.rejected_applicants(_applicants(spark, rows), seed["driver"], seed["car"], AS_OF)
    assert {r.applicant_id: r.outcome for r in refused.collect()} == {
        13: "reject_caregiver",
        14: "reject_caregiver",
        15: "needs_caregiver",
        16: "reject_too_young",
        18: "needs_caregiver",
        19: "reject_car",
        20: "reject_form",
        21: "reject_form",
        22: "reject_form",
        23: "reject_form",
    }
    cared = registration.register_with_caregiver(_applicants(spark, rows), seed["driver"], seed["car"], AS_OF)
    assert [(r.driver_id, r.applicant_id, r.caregiver_name) for r in cared.collect()] == [
        (138, 12, "Maggie Atwood")
    ]


def test_ids_do_not_depend_on_later_inserts(spark, seed):
    rows = [(1, "Ann", "Adult", "11", None, None, None)]
    registered = registration.register_drivers(_applicants(spark, rows), seed["driver"], seed["car"])
    plan = registered._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Subquery" not in plan


def test_first_driver_gets_id_one(spark, seed):
    rows = [(1, "Ann", "Adult", "11", None, None, None)]
    registered = registration.register_drivers(
        _applicants(spark, rows), seed["driver"].filter("false"), seed["car"]
    )
    assert [r.driver_id for r in registered.collect()] == [1]


def test_form_checks(spark):
    rows = [
        (1, "Ann Marie", "Adult", "11", None, None, None),
        (2, "Ann2", " ", "11", None, "", None),
        (3, "Ann", "Adult", None, None, "1939-12-31", None),
        (4, "Ann", "Adult", "x", None, "01-01-1940", None),
        (5, None, "Adult", "11", None, "2023-12-31", None),
        (6, "Ann", "Adult", "11", None, "2024-01-01", None),
    ]
    refused = registration.validate_applicants(_applicants(spark, rows)).collect()
    assert {r.applicant_id: r.reason for r in refused} == {
        2: "first_name,surname",
        3: "car_num,date_of_birth",
        4: "car_num",
        5: "first_name",
        6: "date_of_birth",
    }
