"""Column expressions shared by the jobs. All are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an attempt costs, in seconds, on top of its time.
CONE_PENALTY = 5
WD_PENALTY = 10

# Inclusive age ranges, in completed years.
JUNIOR_AGES = (12, 25)
CAREGIVER_AGES = (12, 16)

# Texts shown in place of a missing result.
NO_STAGE_RESULT = "dnf"
NOT_QUALIFIED = "NQ"

# Birth dates are read day first, else year first. Each pattern is
# guarded by a shape, because the pattern letters alone accept longer numbers.
BIRTH_DATE_FORMS = [
    (r"^\d{1,2}-\d{1,2}-(?!0000)\d{4}$", "d-M-yyyy"),
    (r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
]


# Order and match of names that pay no heed to case or accents.
NAME_COLLATION = "UNICODE_CI_AI"


def collated(value: Column, collation: str | None) -> Column:
    """Text that sorts and matches by ``collation``; by its code points if there is none."""
    return F.collate(value, collation) if collation else value


def attempt_total(cone_penalty: float = CONE_PENALTY, wd_penalty: float = WD_PENALTY) -> Column:
    """Time plus penalties of one attempt; NULL when there is no time."""
    return (
        F.col("seconds")
        + F.coalesce(F.col("cones"), F.lit(0)) * cone_penalty
        + F.coalesce(F.col("wd"), F.lit(0)) * wd_penalty
    )


def full_name(first: str = "first_name", last: str = "surname") -> Column:
    """First name and surname; NULL when either is NULL (as after a left join)."""
    return F.concat(F.col(first), F.lit(" "), F.col(last))


def id_label(key: str, *parts: str, gap: str = "  ") -> Column:
    """A pick-list label such as ``17  GR Yaris  4WD``."""
    return F.concat_ws(gap, F.col(key).cast("string"), *[F.col(p) for p in parts])


def junior_tagged(name: Column, age: Column, ages: tuple[int, int] = JUNIOR_AGES) -> Column:
    """Name with ``(J)`` appended for ages inside the junior range."""
    return F.when(age.between(*ages), F.concat(name, F.lit("(J)"))).otherwise(name)


def junior_highlight(age: Column, oldest: int = JUNIOR_AGES[1]) -> Column:
    """Whether a listing marks the entrant as junior. There is no lower bound here."""
    return F.coalesce(age <= oldest, F.lit(False))


def wd_label(wd: Column) -> Column:
    return F.when(wd == 1, F.lit("wd")).otherwise(F.lit(""))


def text_or(value: Column, missing: str) -> Column:
    """Value as text, or ``missing`` for NULL."""
    return F.coalesce(value.cast("string"), F.lit(missing))


def image_path(image: Column) -> Column:
    return F.concat(F.lit("static/"), image)


def sum_all(columns: list[str]) -> Column:
    """Left-to-right sum; NULL when any column is NULL."""
    total = F.col(columns[0])
    for name in columns[1:]:
        total = total + F.col(name)
    return total


def birth_date(text: Column) -> Column:
    """Date from form text; NULL when empty or in neither accepted form."""
    return F.coalesce(
        *[F.when(text.rlike(shape), F.try_to_date(text, form)) for shape, form in BIRTH_DATE_FORMS]
    )


def completed_years(born: Column, as_of: Column) -> Column:
    """Age in whole years on ``as_of``; negative for a date in the future."""
    before_birthday = F.struct(F.month(as_of), F.dayofmonth(as_of)) < F.struct(
        F.month(born), F.dayofmonth(born)
    )
    return F.year(as_of) - F.year(born) - F.when(before_birthday, 1).otherwise(0)


def edited(text: Column, current: Column, kind: str) -> Column:
    """Tri-state edit: empty text clears, NULL (or unreadable text) keeps, else replaces.

    A double is read by way of a decimal, which knows no ``NaN`` and no ``Infinity``.
    """
    given = text.try_cast("decimal(18,6)").cast(kind) if kind == "double" else text.try_cast(kind)
    return F.when(text == "", F.lit(None).cast(kind)).otherwise(F.coalesce(given, current))


def refused(checks: dict[str, Column]) -> Column:
    """Names of the checks that do not hold, joined by commas; to be selected as a column.

    ``explode`` of one value yields that value. It keeps a filter on the result above this
    column; pushed below, the filter would evaluate every check a second time, in
    generated code too long to be compiled.
    """
    names = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    return F.explode(F.array(F.concat_ws(",", *names)))
