"""Jobs that change stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatsheet.plans.edits import apply_run_edits
from heatsheet.plans.registration import assign_ids, blank_runs, new_driver_rows
from heatsheet.sources import tables


def store_registration(registered: DataFrame, folder: str) -> DataFrame:
    """Append new drivers, then their blank runs.

    The table ``registered`` is written first: it holds the driver id of every application
    there has been. Applications in it keep their id, the others get ids above all that are
    stored or promised. Drivers and runs skip keys already stored, so repeating the
    job completes it, also from a new plan and after a failure between the tables.
    Returns the batch with its stored ids; receipts must be made from that, not from the ids
    that ``registered`` came with.
    """
    spark = registered.sparkSession
    driver = tables.read_parquet(spark, folder, "driver")
    promised = tables.read_or_empty(spark, folder, "registered")
    applications = registered.drop("driver_id")
    used = driver.select("driver_id").unionByName(promised.select("driver_id"))
    dealt = assign_ids(applications.join(promised, "applicant_id", "left_anti"), used)
    tables.append(
        dealt.select("applicant_id", F.col("driver_id").cast("int").alias("driver_id")),
        folder,
        "registered",
    )
    ids = tables.read_parquet(spark, folder, "registered")
    settled = applications.join(ids, "applicant_id")
    tables.append_once(new_driver_rows(settled, driver), folder, "driver")
    run = tables.read_parquet(spark, folder, "run")
    tables.append_once(blank_runs(settled, run), folder, "run")
    return settled.select(*registered.columns)


def store_edits(edits: DataFrame, folder: str, staging: str) -> None:
    """Replace the stored runs by the edited ones, by way of ``staging``."""
    run = tables.read_parquet(edits.sparkSession, folder, "run")
    tables.replace(apply_run_edits(run, edits), folder, "run", staging)
