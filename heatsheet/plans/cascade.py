"""Deletes and key changes that carry over to dependent tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatsheet.operators import lookup_join, stable

# (child table, column) pairs that follow a key of each table.
FOLLOWERS = {
    "car": [("driver", "car")],
    "driver": [("driver", "caregiver"), ("run", "dr_id")],
    "course": [("run", "crs_id")],
}
KEYS = {"car": "car_num", "driver": "driver_id", "course": "course_id"}

#: Longer jumps are made only while they are at most this many times the links of the first step.
GROWTH = 4


def _key_set(keys: DataFrame) -> DataFrame:
    return keys.select(F.col(keys.columns[0]).alias("key")).distinct()


def _without(rows: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    return rows.join(gone, F.col(column) == F.col("key"), "left_anti")


def _lengthened(jumps: DataFrame, reached: DataFrame, most: int | None) -> DataFrame:
    """Jumps of twice the length that do not end in ``reached``, or the same jumps if the longer
    ones would be more than ``most``. They are counted before they are made, by their middles."""
    ends = jumps.join(reached, F.col("guardian_root") == F.col("key"), "left_anti").select(
        F.col("ward_root").alias("middle"), F.col("guardian_root").alias("end")
    )
    if most is not None:
        arriving = jumps.groupBy(F.col("guardian_root").alias("middle")).agg(
            F.count("*").alias("arriving")
        )
        leaving = ends.groupBy("middle").agg(F.count("*").alias("leaving"))
        pairs = arriving.join(leaving, "middle").agg(F.sum(F.col("arriving") * F.col("leaving")))
        if (pairs.first()[0] or 0) > most:
            return jumps
    return (
        jumps.join(ends, F.col("guardian_root") == F.col("middle"))
        .filter(F.col("ward_root") != F.col("end"))
        .select("ward_root", F.col("end").alias("guardian_root"))
        .distinct()
    )


def blocked_keys(
    driver: DataFrame, root: str, keys: DataFrame, growth: int = GROWTH
) -> DataFrame:
    """Keys that cannot be deleted because a driver under them looks after a survivor.

    ``root`` is the driver column that holds the deleted key: ``driver_id`` when drivers
    are deleted, ``car`` when cars are. A blocked key keeps its drivers, whose own
    caregivers are then blocked too, until nothing changes.

    Every round doubles the length of the jumps from ward to caregiver, so the rounds follow the
    logarithm of the depth. After a round all keys nearer than some distance are known, and this
    is at least the length of the next jumps: jumps of exactly that length then reach whatever
    comes next, and those that end in a key known before are of no use. A driver has one caregiver, so
    jumps between drivers never become more. Cars have many on both sides: where longer jumps
    would be more than ``growth`` times the links, the round keeps its length, and the rounds
    that follow take equal steps until doubling is cheap again.
    """
    wanted = _key_set(keys)
    wards = driver.filter(F.col("caregiver").isNotNull()).select(
        "caregiver", F.col(root).alias("ward_root")
    )
    guardians = driver.select(
        F.col("driver_id").alias("guardian"), F.col(root).alias("guardian_root")
    ).join(wanted, F.col("guardian_root") == F.col("key"), "left_semi")
    links = stable(
        wards.join(guardians, F.col("caregiver") == F.col("guardian"))
        .filter(~F.col("ward_root").eqNullSafe(F.col("guardian_root")))
        .select("ward_root", "guardian_root")
        .distinct()
    )
    stays = links.join(wanted, F.col("ward_root") == F.col("key"), "left_anti")
    blocked = stable(stays.select(F.col("guardian_root").alias("key")).distinct())
    jumps = links.join(wanted, F.col("ward_root") == F.col("key"), "left_semi")
    most = None if root == "driver_id" else growth * links.count()
    while True:
        onward = jumps.join(blocked, F.col("guardian_root") == F.col("key"), "left_anti")
        more = stable(
            onward.join(blocked, F.col("ward_root") == F.col("key"), "left_semi")
            .select(F.col("guardian_root").alias("key"))
            .distinct()
        )
        if more.isEmpty():
            return blocked
        jumps = stable(_lengthened(onward, more, most))
        blocked = stable(blocked.unionByName(more))


def delete_cascade(
    tables: dict[str, DataFrame], table: str, keys: DataFrame
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the given keys of ``table`` and everything under them, and the blocked keys."""
    kept = dict(tables)
    keys = stable(_key_set(keys))
    if table == "course":
        gone = keys
        kept["course"] = _without(tables["course"], "course_id", gone)
        kept["run"] = _without(tables["run"], "crs_id", gone)
        return kept, keys.filter(F.lit(False))
    root = {"car": "car", "driver": "driver_id"}[table]
    blocked = blocked_keys(tables["driver"], root, keys)
    gone = stable(keys.join(blocked, "key", "left_anti"))
    if table == "car":
        kept["car"] = _without(tables["car"], "car_num", gone)
    kept["driver"] = _without(tables["driver"], root, gone)
    gone_drivers = gone
    if root != "driver_id":
        under = tables["driver"].join(gone, F.col(root) == F.col("key"), "left_semi")
        gone_drivers = under.select(F.col("driver_id").alias("key"))
    kept["run"] = _without(tables["run"], "dr_id", gone_drivers)
    return kept, blocked


def _judged(tables: dict[str, DataFrame], table: str, mapping: DataFrame) -> DataFrame:
    """``mapping`` with the ``reason`` to refuse a row, or NULL. Keys are counted before the
    joins, so a key given very often reaches them as one row."""
    olds = mapping.groupBy(F.col("old").alias("_o")).agg(F.count("*").alias("_olds"))
    news = mapping.groupBy(F.col("new").alias("_n")).agg(F.count("*").alias("_news"))
    keys = tables[table].select(F.col(KEYS[table]).alias("_k")).distinct()
    old, new = F.col("old"), F.col("new")
    return (
        mapping.select("old", "new")
        .join(olds, old == F.col("_o"), "left")
        .join(news, new == F.col("_n"), "left")
        .join(keys, new == F.col("_k"), "left")
        .select(
            "old",
            "new",
            F.when(old.isNull() | new.isNull(), "missing key")
            .when(F.col("_olds") > 1, "old given twice")
            .when(F.col("_news") > 1, "new given twice")
            .when(F.col("_k").isNotNull() & (old != new), "new exists")
            .alias("reason"),
        )
    )


def rekey_refused(
    tables: dict[str, DataFrame], table: str, mapping: DataFrame
) -> DataFrame:
    """Rows of ``mapping`` that ``rekey_cascade`` does not apply, with the reason: a missing key,
    an old or a new key given twice, or a new key that the table has already."""
    return _judged(tables, table, mapping).filter(F.col("reason").isNotNull())


def rekey_cascade(
    tables: dict[str, DataFrame], table: str, mapping: DataFrame
) -> dict[str, DataFrame]:
    """Tables after changing keys of ``table`` from ``old`` to ``new`` wherever they occur.

    Rows listed by ``rekey_refused`` change nothing; so each ``old`` key has one ``new``.
    """
    accepted = _judged(tables, table, mapping).filter(F.col("reason").isNull())
    lookup = accepted.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    changed = dict(tables)
    for name, column in [(table, KEYS[table]), *FOLLOWERS[table]]:
        rows = changed[name]
        spread = "driver_id" if column == "caregiver" else None
        changed[name] = (
            lookup_join(rows, lookup, column, "_old", spread_by=spread)
            .withColumn(column, F.coalesce("_new", column))
            .select(*rows.columns)
        )
    return changed
