"""Table definitions: types, keys, references and length limits."""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _field(name, kind, required=False):
    return StructField(name, kind(), not required)


CAR = StructType([
    _field("car_num", IntegerType, required=True),
    _field("model", StringType, required=True),
    _field("drive_class", StringType, required=True),
])

DRIVER = StructType([
    _field("driver_id", IntegerType, required=True),
    _field("first_name", StringType, required=True),
    _field("surname", StringType, required=True),
    _field("date_of_birth", DateType),
    _field("age", IntegerType),
    _field("caregiver", IntegerType),
    _field("car", IntegerType, required=True),
])

COURSE = StructType([
    _field("course_id", StringType, required=True),
    _field("name", StringType, required=True),
    _field("image", StringType),
])

RUN = StructType([
    _field("dr_id", IntegerType, required=True),
    _field("crs_id", StringType, required=True),
    _field("run_num", IntegerType, required=True),
    _field("seconds", DoubleType),
    _field("cones", IntegerType),
    _field("wd", IntegerType, required=True),
])

# Form payloads arrive as text; seq, applicant_id and term_id give a batch its order.
EDITS = StructType(
    [_field("seq", LongType, required=True)]
    + [_field(c, StringType) for c in ("dr_id", "crs_id", "run_num", "time", "cones", "wd")]
)
APPLICANTS = StructType(
    [_field("applicant_id", LongType, required=True)]
    + [
        _field(c, StringType)
        for c in ("first_name", "surname", "car_num", "junior_driver", "date_of_birth", "caregiver")
    ]
)
TERMS = StructType([_field("term_id", LongType, required=True), _field("search_term", StringType)])

# Which driver each application became; applicant ids are never used again.
REGISTERED = StructType([
    _field("applicant_id", LongType, required=True),
    _field("driver_id", IntegerType, required=True),
])

# The best total per driver and course among the runs of one bucket of the stored runs.
BEST = StructType([
    _field("run_bucket", IntegerType, required=True),
    _field("dr_id", IntegerType, required=True),
    _field("crs_id", StringType, required=True),
    _field("best", DoubleType, required=True),
])

TABLES = {"car": CAR, "driver": DRIVER, "course": COURSE, "run": RUN}
STORED = TABLES | {"registered": REGISTERED, "best": BEST}

PRIMARY_KEYS = {
    "car": ["car_num"],
    "driver": ["driver_id"],
    "course": ["course_id"],
    "run": ["dr_id", "crs_id", "run_num"],
}
STORED_KEYS = PRIMARY_KEYS | {
    "registered": ["applicant_id"],
    "best": ["run_bucket", "dr_id", "crs_id"],
}
# Stored tables whose rows follow the buckets of another table, by the column that names them.
FOLLOWED_BUCKETS = {"best": "run_bucket"}

# (child table, column, parent table, column)
FOREIGN_KEYS = [
    ("driver", "car", "car", "car_num"),
    ("driver", "caregiver", "driver", "driver_id"),
    ("run", "dr_id", "driver", "driver_id"),
    ("run", "crs_id", "course", "course_id"),
]

MAX_LENGTHS = {
    "car": {"model": 20, "drive_class": 3},
    "driver": {"first_name": 25, "surname": 25},
    "course": {"course_id": 1, "name": 30, "image": 20},
    "run": {"crs_id": 1},
}

DEFAULTS = {"run": {"wd": 0}, "car": {"drive_class": "RWD"}}


def required_columns(table: str) -> list[str]:
    return [f.name for f in TABLES[table].fields if not f.nullable]
