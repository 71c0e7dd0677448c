"""Registrations, edits and appends as single changes of a ``Store``.

With the runs the store keeps ``best``: for every bucket of runs the best total per driver and
course among its rows. An edit may raise a minimum, so what it touched cannot be mended from the old
minimum; it is computed again, but from the runs of the touched buckets only, which the edit has
rewritten anyway. A driver's runs lie in all buckets, so their best is the least of their bests there,
and a driver with a third of all runs has no more rows than any other with as many courses.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatsheet import schemas
from heatsheet.plans import constraints
from heatsheet.plans.edits import apply_run_edits, fold_edits
from heatsheet.plans.registration import (
    DECISION,
    INSERTS,
    assign_ids,
    blank_runs,
    decide,
    new_driver_rows,
)
from heatsheet.plans.results import course_bests, results_of
from heatsheet.sources.store import Change, Store, bucket_of


def _bucket_bests(run: DataFrame, buckets: int) -> DataFrame:
    """Rows of ``best`` for runs that are stored in ``buckets`` buckets."""
    return course_bests(run.withColumn("run_bucket", bucket_of("run", buckets)), "run_bucket")


def stored_bests(store: Store, version: int | None = None) -> DataFrame:
    """Best total per driver and course, from what is kept for each bucket of runs."""
    if "best" not in store.state(version):
        return course_bests(store.read("run", version))
    kept = store.read("best", version)
    return kept.groupBy("dr_id", "crs_id").agg(F.min("best").alias("best"))


def stored_results(store: Store, stages: list[str] | None = None) -> DataFrame:
    """``results.stage_results`` of one state of the store; no run is read."""
    version = store.version()
    driver, car, course = (store.read(t, version) for t in ("driver", "car", "course"))
    return results_of(stored_bests(store, version), driver, car, course, stages)


def load(store: Store, tables: dict[str, DataFrame], buckets: dict[str, int] | None = None) -> int:
    """Drop and reload: all ``tables`` become the state of the store at once."""

    def work(change: Change) -> None:
        for name, df in tables.items():
            change.create(df, name, (buckets or {}).get(name, 1))
        if "run" in tables:
            size = change.buckets("run")
            change.create(_bucket_bests(change.read("run"), size), "best", size)

    return store.transact(work)[1]


def edit_runs(store: Store, edits: DataFrame) -> list[str]:
    """Apply a batch of edits to the stored runs and renew the bests. Only the buckets of edited
    runs are read and written; returns which they are."""
    keys = fold_edits(edits).select(*schemas.PRIMARY_KEYS["run"])

    def work(change: Change) -> list[str]:
        touched = change.rewrite("run", keys, lambda run: apply_run_edits(run, edits))
        if touched and change.buckets("best"):
            renewed = _bucket_bests(change.read("run", touched), change.buckets("run"))
            change.replace("best", touched, renewed)
        return touched

    return store.transact(work)[0]


def append_checked(store: Store, rows: DataFrame, table: str) -> DataFrame:
    """Append what ``table`` can take and return the other rows with their ``reason``."""
    parents = {p for t, _, p, _ in schemas.FOREIGN_KEYS if t == table}

    def work(change: Change) -> DataFrame:
        stored = {name: change.read(name) for name in {table, *parents}}
        good, refused = constraints.split(rows, table, stored)
        change.append(good, table)
        if table == "run" and change.buckets("best"):
            # A minimum of minima: what was kept for these buckets stays right beside it.
            change.append(_bucket_bests(good, change.buckets("run")), "best")
        return refused

    return store.transact(work)[0]


def register(store: Store, applicants: DataFrame, as_of: date | None = None) -> DataFrame:
    """Store new drivers, their blank runs and which application each came from, in one change.

    Returns accepted applicants with the ids that are stored, those of applications registered before
    too, so receipts made from it name drivers who exist. After a conflict everything is decided
    and numbered again from the new state.
    """

    def work(change: Change) -> DataFrame:
        driver, run, known = (change.read(t) for t in ("driver", "run", "registered"))
        accepted = decide(applicants, driver, change.read("car"), as_of).filter(
            F.col("outcome").isin(INSERTS)
        )
        used = driver.select("driver_id").unionByName(known.select("driver_id"))
        dealt = assign_ids(accepted.join(known, "applicant_id", "left_anti"), used)
        change.append(new_driver_rows(dealt, driver), "driver")
        change.append(blank_runs(dealt, run), "run")
        change.append(dealt.select("applicant_id", "driver_id"), "registered")
        return accepted

    accepted, version = store.transact(work)
    return accepted.join(store.read("registered", version), "applicant_id").select(
        "driver_id", *DECISION
    )
