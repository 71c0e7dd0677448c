"""Every job over tables derived from the given parquet files, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatsheet import schemas
from heatsheet.functions import (
    NAME_COLLATION,
    attempt_total,
    birth_date,
    completed_years,
    full_name,
    junior_tagged,
    wd_label,
)
from heatsheet.operators.lineage import shared_folder
from heatsheet.plans import (
    cascade,
    constraints,
    edits,
    listings,
    quality,
    registration,
    results,
    search,
    transactions,
)
from heatsheet.sources import star
from heatsheet.sources.store import Store
from oracle_texts import TEXTS

try:
    from heatsheet.llm import queries as llm
except ImportError:  # the package works without its training-data operators
    llm = None

AS_OF = date(2024, 1, 1)
#: Stages shown as columns; overall results count every course there is.
STAGES = ["1", "2", "3", "4", "5"]
DRIVER_ID = 7
COURSE_ID = "2"
TERM = "customer 0001"


def _results(spark, d):
    return results.stage_results(
        star.driver(spark, d), star.car(spark, d), star.attempts(spark, d), star.course(spark, d), STAGES
    )


def _overall(spark, d):
    return results.overall_results(
        star.driver(spark, d), star.car(spark, d), star.attempts(spark, d), star.course(spark, d), STAGES
    )


def _as_text(bests, value):
    return F.array_join(
        F.transform(
            F.map_entries(bests), lambda e: F.concat(e["key"], F.lit("="), value(e["value"]))
        ),
        ";",
    )


def _overall_courses(spark, d):
    """Results with the bests of whatever courses there are, as shown."""
    course = star.course(spark, d)
    whole = results.stage_results(
        star.driver(spark, d), star.car(spark, d), star.attempts(spark, d), course
    )
    return results.course_labels(whole, course).withColumn(
        "bests", _as_text("bests", lambda v: v)
    )


def _search_courses(spark, d):
    return search.driver_search(
        star.driver(spark, d), star.car(spark, d), star.attempts(spark, d), star.course(spark, d),
        None, "00012 00034",
    ).withColumn("bests", _as_text("bests", lambda v: v.cast("string")))


def _blocked_cars(spark, d):
    """Cars that stay because chains of caregivers lead to them from every hundredth car."""
    drivers = star.chained(spark, d)
    cars = drivers.select("car").distinct()
    return cascade.blocked_keys(drivers, "car", cars.filter("car % 100 <> 0"))


def _chart(spark, d):
    return results.chart_series(results.top_n(_results(spark, d))).select(
        F.array_join("name_list", ",").alias("name_list"),
        F.array_join(
            F.transform("value_list", lambda v: v.cast("decimal(12,2)").cast("string")), ","
        ).alias("value_list"),
    )


def _registered(spark, d):
    return registration.register_drivers(
        star.applicants(spark, d), star.driver(spark, d), star.car(spark, d), AS_OF
    )


def _store(spark, tables, buckets):
    store = Store(spark, shared_folder(spark, "store"))
    transactions.load(store, tables, buckets)
    return store


def _stored_edits(spark, d):
    """Runs read back from bucketed storage after a batch of edits."""
    store = _store(spark, {"run": star.run(spark, d)}, {"run": 16})
    transactions.edit_runs(store, star.edits(spark, d))
    return store.read("run").withColumn("dr_id", F.col("dr_id").cast("long"))


def _stored_results(spark, d):
    """Results from kept bests, renewed for what the accepted edits of a batch touched."""
    t = star.tables(spark, d)
    store = _store(spark, t, {"driver": 4, "run": 16})
    transactions.edit_runs(store, edits.accepted_edits(star.edits(spark, d)))
    return transactions.stored_results(store, STAGES).withColumn(
        "driver_id", F.col("driver_id").cast("long")
    )


def _stored_receipts(spark, d):
    """Receipts made from what a registration stored."""
    t = star.tables(spark, d)
    store = _store(spark, {n: t[n] for n in ("car", "driver", "run")}, {"driver": 4, "run": 16})
    return registration.registration_receipts(
        transactions.register(store, star.applicants(spark, d), AS_OF)
    ).withColumn("driver_id", F.col("driver_id").cast("long"))


def _deleted(spark, d):
    """What is left when the 4WD cars are deleted, and which of them are blocked."""
    t = star.tables(spark, d)
    keys = t["car"].filter(F.col("drive_class") == "4WD").select("car_num")
    kept, blocked = cascade.delete_cascade(t, "car", keys)
    return _table_sizes(kept, blocked)


def _deleted_drivers(spark, d):
    """What is left when the drivers who did not qualify are deleted, and who is blocked."""
    t = star.tables(spark, d)
    keys = (
        results.stage_results(t["driver"], t["car"], t["run"], t["course"], STAGES)
        .filter(~F.col("qualified"))
        .select("driver_id")
    )
    kept, blocked = cascade.delete_cascade(t, "driver", keys)
    return _table_sizes(kept, blocked)


def _deleted_courses(spark, d):
    """Runs left when the course that holds the fastest attempt is deleted."""
    t = star.tables(spark, d)
    fastest = (
        t["run"]
        .filter(F.col("seconds").isNotNull())
        .agg(F.min_by("crs_id", F.struct("seconds", "crs_id")).alias("course_id"))
    )
    kept, _ = cascade.delete_cascade(t, "course", fastest)
    return kept["run"]


def _table_sizes(tables, blocked):
    counts = [
        df.agg(F.count("*").alias("size"), F.sum(key).cast("bigint").alias("key_sum")).select(
            F.lit(name).alias("table"), "size", "key_sum"
        )
        for name, df, key in [
            ("car", tables["car"], "car_num"),
            ("driver", tables["driver"], "driver_id"),
            ("run", tables["run"], "dr_id"),
            ("blocked", blocked, "key"),
        ]
    ]
    whole = counts[0]
    for part in counts[1:]:
        whole = whole.unionByName(part)
    return whole


def _rekeyed(table, mapping):
    def job(spark, d):
        t = star.tables(spark, d)
        return cascade.rekey_cascade(t, table, mapping(t))

    return job


def _refused_mapping(spark, d):
    """New driver ids of which some exist, some are given twice and some drivers get two."""
    drivers = star.driver(spark, d)
    mapping = drivers.selectExpr(
        "driver_id as old",
        """case when driver_id % 10 = 0 then driver_id + 1
           when driver_id % 10 = 2 then 3000000 + driver_id div 20
           else 1000000 + driver_id end as new""",
    ).unionByName(
        drivers.filter("driver_id % 10 = 3").selectExpr(
            "driver_id as old", "2000000 + driver_id as new"
        )
    )
    return cascade.rekey_refused({"driver": drivers}, "driver", mapping)


def _rekeyed_drivers(spark, d):
    changed = _rekeyed(
        "driver",
        lambda t: t["driver"].select(
            F.col("driver_id").alias("old"), (F.col("driver_id") + 1_000_000).alias("new")
        ),
    )(spark, d)
    drivers, runs = changed["driver"], changed["run"]
    return drivers.select("driver_id", "caregiver").join(
        runs.groupBy("dr_id").agg(F.count("*").alias("runs")),
        F.col("driver_id") == F.col("dr_id"),
        "left",
    ).select("driver_id", "caregiver", "runs")


def _rekeyed_courses(spark, d):
    changed = _rekeyed(
        "course",
        lambda t: t["course"].select(
            F.col("course_id").alias("old"),
            F.translate(F.col("course_id"), "12345", "ABCDE").alias("new"),
        ),
    )(spark, d)
    return changed["run"]


def _rekeyed_cars(spark, d):
    changed = _rekeyed(
        "car",
        lambda t: t["car"].select(
            F.col("car_num").alias("old"), (F.col("car_num") + 100).alias("new")
        ),
    )(spark, d)
    return listings.list_drivers(changed["driver"], changed["car"]).select(
        "driver_id", "model"
    ).join(changed["driver"].select("driver_id", "car"), "driver_id")


def entry(spark: SparkSession) -> DataFrame:
    """Overall results at the smallest scale."""
    return _overall(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return core_queries() | (llm.queries() if llm else {})


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # Listings
        "list_courses": lambda s, d: listings.list_courses(star.course(s, d)),
        "list_drivers": lambda s, d: listings.list_drivers(star.driver(s, d), star.car(s, d)),
        "list_drivers_shown": lambda s, d: listings.shown(
            listings.list_drivers(star.driver(s, d), star.car(s, d)),
            ["date_of_birth", "age", "caregiver_name"],
        ),
        "driver_picklist": lambda s, d: listings.driver_picklist(star.driver(s, d)),
        "car_picklist": lambda s, d: listings.car_picklist(star.car(s, d)),
        "caregiver_candidates": lambda s, d: listings.caregiver_candidates(star.driver(s, d)),
        "edit_picklists": lambda s, d: listings.edit_picklists(
            star.driver(s, d), star.course(s, d)
        ),
        "junior_list": lambda s, d: listings.junior_list(star.driver(s, d)),
        "junior_list_shown": lambda s, d: listings.shown(
            listings.junior_list(star.driver(s, d)),
            ["date_of_birth", "age", "caregiver_name"],
            "N/A",
        ),
        "run_details": lambda s, d: listings.run_details(
            star.driver(s, d), star.run(s, d), star.course(s, d), star.car(s, d), DRIVER_ID
        ),
        "run_details_shown": lambda s, d: listings.shown(
            listings.run_details(
                star.driver(s, d), star.run(s, d), star.course(s, d), star.car(s, d), DRIVER_ID
            ).withColumn("wd", wd_label(F.col("wd"))),
            ["seconds", "cones", "run_total"],
        ),
        "run_header": lambda s, d: listings.run_header(
            star.driver(s, d), star.attempts(s, d), star.car(s, d), DRIVER_ID
        ),
        "runs_by_driver": lambda s, d: listings.runs_to_edit(
            star.run(s, d), star.driver(s, d), star.course(s, d), dr_id=DRIVER_ID
        ),
        "runs_by_course": lambda s, d: listings.runs_to_edit(
            star.run(s, d), star.driver(s, d), star.course(s, d), crs_id=COURSE_ID
        ),
        # Listings with places
        "list_drivers_numbered": lambda s, d: listings.list_drivers(
            star.driver(s, d), star.car(s, d), numbered=True
        ),
        "list_drivers_collated": lambda s, d: listings.list_drivers(
            star.accented(s, d), star.car(s, d), NAME_COLLATION, numbered=True
        ),
        "junior_list_numbered": lambda s, d: listings.junior_list(
            star.driver(s, d), numbered=True
        ),
        "junior_list_collated": lambda s, d: listings.junior_list(
            star.accented(s, d), collation=NAME_COLLATION, numbered=True
        ),
        "run_details_numbered": lambda s, d: listings.run_details(
            star.driver(s, d), star.run(s, d), star.course(s, d), star.car(s, d), DRIVER_ID,
            numbered=True,
        ),
        "runs_by_driver_numbered": lambda s, d: listings.runs_to_edit(
            star.run(s, d), star.driver(s, d), star.course(s, d), dr_id=DRIVER_ID, numbered=True
        ),
        "runs_by_course_numbered": lambda s, d: listings.runs_to_edit(
            star.run(s, d), star.driver(s, d), star.course(s, d), crs_id=COURSE_ID, numbered=True
        ),
        # Results
        "overall_courses": _overall_courses,
        "overall_results": _overall,
        "overall_labels": lambda s, d: results.result_labels(_results(s, d), STAGES),
        "overall_positions": lambda s, d: results.positions(
            _results(s, d).select("driver_id", "overall")
        ),
        "leader_medals": lambda s, d: results.leader_medals(_results(s, d)),
        "top_n": lambda s, d: results.top_n(_results(s, d)),
        "chart_series": _chart,
        "run_totals": lambda s, d: results.run_totals(star.run(s, d)),
        "stage_bests": lambda s, d: results.stage_bests(star.attempts(s, d), STAGES),
        "stage_sums": lambda s, d: results.overall_sums(star.attempts(s, d), star.course(s, d)),
        "attempt_total": lambda s, d: star.run(s, d).select(
            "dr_id", "crs_id", "run_num", F.round(attempt_total(), 2).alias("total")
        ),
        "junior_tag": lambda s, d: star.driver(s, d).select(
            "driver_id", junior_tagged(full_name(), F.col("age")).alias("driver_name")
        ),
        # Search
        "driver_search": lambda s, d: search.driver_search(
            star.driver(s, d), star.car(s, d), star.attempts(s, d), star.course(s, d), STAGES, TERM
        ),
        "driver_search_word": lambda s, d: search.driver_search(
            star.driver(s, d), star.car(s, d), star.attempts(s, d), star.course(s, d), STAGES, "00012"
        ),
        "driver_search_two_words": lambda s, d: search.driver_search(
            star.driver(s, d), star.car(s, d), star.attempts(s, d), star.course(s, d), STAGES,
            "00012 00034",
        ),
        "driver_search_shown": lambda s, d: listings.shown(
            results.result_labels(
                search.driver_search(
                    star.driver(s, d), star.car(s, d), star.attempts(s, d), star.course(s, d), STAGES, TERM
                ),
                STAGES,
            ),
            ["date_of_birth", "age", "caregiver_name"],
        ),
        "name_match": lambda s, d: star.driver(s, d)
        .filter(search.name_matches("99"))
        .select("driver_id", "first_name", "surname"),
        "name_match_collated": lambda s, d: star.accented(s, d)
        .filter(search.name_matches("JOSÉ oscar0000", NAME_COLLATION))
        .select("driver_id", "first_name", "surname"),
        "driver_search_courses": _search_courses,
        "search_terms": lambda s, d: search.search_terms(star.driver(s, d), star.name_terms(s, d)),
        "validate_search": lambda s, d: search.validate_search(star.terms(s, d)),
        # Edits
        "apply_run_edits": lambda s, d: edits.apply_run_edits(star.run(s, d), star.edits(s, d)),
        "fold_edits": lambda s, d: edits.fold_edits(star.edits(s, d)),
        "unmatched_edits": lambda s, d: edits.unmatched_edits(star.edits(s, d), star.run(s, d)),
        "validate_edits": lambda s, d: edits.validate_edits(star.edits(s, d)),
        "edit_receipts": lambda s, d: edits.edit_receipts(
            star.edits(s, d), star.driver(s, d), star.course(s, d)
        ),
        # Registration
        "birth_date": lambda s, d: star.applicants(s, d).select(
            "applicant_id", birth_date(F.col("date_of_birth")).alias("born")
        ),
        "completed_years": lambda s, d: star.driver(s, d).select(
            "driver_id", completed_years(F.col("date_of_birth"), F.lit(AS_OF)).alias("years")
        ),
        "classify_applicants": lambda s, d: registration.classify_applicants(
            star.applicants(s, d), AS_OF
        ).select("applicant_id", "age", "outcome"),
        "register_drivers": _registered,
        "register_with_caregiver": lambda s, d: registration.register_with_caregiver(
            star.applicants(s, d), star.driver(s, d), star.car(s, d), AS_OF
        ),
        "rejected_applicants": lambda s, d: registration.rejected_applicants(
            star.applicants(s, d), star.driver(s, d), star.car(s, d), AS_OF
        ),
        "registration_receipts": lambda s, d: registration.registration_receipts(
            _registered(s, d)
        ),
        "append_drivers": lambda s, d: star.driver(s, d).unionByName(
            registration.new_driver_rows(_registered(s, d), star.driver(s, d))
        ),
        "assign_ids": lambda s, d: registration.assign_ids(
            star.applicants(s, d).select("applicant_id"), star.driver(s, d)
        ),
        "blank_slots": lambda s, d: registration.blank_slots(star.run(s, d)),
        "blank_runs": lambda s, d: registration.blank_runs(_registered(s, d), star.run(s, d)),
        "validate_applicants": lambda s, d: registration.validate_applicants(
            star.applicants(s, d)
        ),
        "stored_receipts": _stored_receipts,
        "stored_edits": _stored_edits,
        "stored_results": _stored_results,
        "judged_drivers": lambda s, d: constraints.judged(
            star.new_drivers(s, d), "driver", {"driver": star.driver(s, d), "car": star.car(s, d)}
        ).select("driver_id", "first_name", "surname", "caregiver", "car", "reason"),
        # Audits, defaults and cascades
        "audit_primary_key": lambda s, d: quality.audit_primary_key(
            star.read(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]
        ),
        "audit_foreign_key": lambda s, d: quality.audit_foreign_key(
            star.applicants(s, d), "caregiver",
            star.driver(s, d).withColumn("driver_id", F.col("driver_id").cast("string")),
            "driver_id",
        ),
        "audit_foreign_keys": lambda s, d: quality.audit_foreign_keys(star.flawed(s, d)),
        "audit_primary_keys": lambda s, d: quality.audit_primary_keys(star.flawed(s, d)),
        "audit_not_nulls": lambda s, d: quality.audit_not_nulls(star.flawed(s, d)),
        "audit_lengths": lambda s, d: quality.audit_lengths(star.flawed(s, d)),
        "fill_car_defaults": lambda s, d: quality.fill_defaults(
            star.flawed(s, d)["car"], schemas.DEFAULTS["car"]
        ),
        "audit_not_null": lambda s, d: quality.audit_not_null(
            star.run(s, d), schemas.required_columns("run") + ["seconds", "cones"]
        ),
        "audit_length": lambda s, d: quality.audit_length(
            star.car(s, d), ["car_num"], {"model": 8, "drive_class": 3}
        ),
        "fill_defaults": lambda s, d: quality.fill_defaults(
            star.run(s, d), {"cones": 0, **schemas.DEFAULTS["run"]}
        ),
        "delete_cars": _deleted,
        "blocked_cars": _blocked_cars,
        "delete_drivers": _deleted_drivers,
        "delete_courses": _deleted_courses,
        "rekey_refused": _refused_mapping,
        "rekey_drivers": _rekeyed_drivers,
        "rekey_courses": _rekeyed_courses,
        "rekey_cars": _rekeyed_cars,
    }


def oracle_sql() -> dict[str, str]:
    return TEXTS | (llm.oracle_sql() if llm else {})
