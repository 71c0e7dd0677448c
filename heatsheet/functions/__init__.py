from heatsheet.functions.columns import (
    BIRTH_DATE_FORMS,
    CAREGIVER_AGES,
    CONE_PENALTY,
    JUNIOR_AGES,
    NAME_COLLATION,
    NOT_QUALIFIED,
    NO_STAGE_RESULT,
    WD_PENALTY,
    attempt_total,
    birth_date,
    collated,
    completed_years,
    edited,
    full_name,
    id_label,
    image_path,
    junior_highlight,
    junior_tagged,
    refused,
    sum_all,
    text_or,
    wd_label,
)

__all__ = [
    "BIRTH_DATE_FORMS",
    "CAREGIVER_AGES",
    "CONE_PENALTY",
    "JUNIOR_AGES",
    "NAME_COLLATION",
    "NOT_QUALIFIED",
    "NO_STAGE_RESULT",
    "WD_PENALTY",
    "attempt_total",
    "birth_date",
    "collated",
    "completed_years",
    "edited",
    "full_name",
    "id_label",
    "image_path",
    "junior_highlight",
    "junior_tagged",
    "refused",
    "sum_all",
    "text_or",
    "wd_label",
]
