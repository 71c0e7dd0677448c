"""Changes of stored tables: all or nothing, one after another, and only where something changes."""

import os
import random
from datetime import date

import pytest

from heatsheet import schemas
from heatsheet.plans import constraints, edits, quality, registration, results, transactions
from heatsheet.sources.store import Change, Conflict, Store, bucket_of

AS_OF = date(2024, 1, 1)


@pytest.fixture
def store(spark, seed, tmp_path):
    made = Store(spark, str(tmp_path / "store"))
    transactions.load(made, seed, {"driver": 3, "run": 8})
    return made


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(store, table):
    """Every data file and its time of change, by bucket."""
    return {
        b: {
            (f, os.stat(os.path.join(store.folder, p, f)).st_mtime_ns)
            for p in folders
            for f in os.listdir(os.path.join(store.folder, p))
        }
        for b, folders in store.files(table).items()
    }


def one_edit(spark, *keys):
    return spark.createDataFrame(
        [(i, str(d), c, str(n), "45.5", "1", "0") for i, (d, c, n) in enumerate(keys)], schemas.EDITS
    )


def applicants(spark, *numbers):
    return spark.createDataFrame(
        [(n, "Ann", "Adult", "11", None, None, None) for n in numbers], schemas.APPLICANTS
    )


def test_tables_come_back_whole(store, seed):
    for name, df in seed.items():
        assert rows(store.read(name)) == rows(df)
    assert store.read("registered").collect() == []
    assert len(store.files("run")) > 4


def test_an_edit_rewrites_only_its_bucket(spark, store, seed):
    batch = one_edit(spark, (129, "F", 1))
    expected = rows(edits.apply_run_edits(seed["run"], batch))
    before, others = files(store, "run"), {t: files(store, t) for t in ("car", "driver", "course")}
    touched = transactions.edit_runs(store, batch)
    after = files(store, "run")
    assert len(touched) == 1
    assert {b for b in before if before[b] != after[b]} == set(touched)
    assert {t: files(store, t) for t in others} == others
    assert rows(store.read("run")) == expected
    key = seed["run"].filter("dr_id = 129 and crs_id = 'F' and run_num = 1")
    assert [str(r[0]) for r in key.select(bucket_of("run", 8)).collect()] == touched


def test_an_edit_of_no_run_changes_nothing(spark, store):
    before = files(store, "run")
    transactions.edit_runs(store, one_edit(spark, (999, "F", 1)))
    after = files(store, "run")
    assert {b for b in before if before[b] != after[b]} <= {
        str(r[0])
        for r in spark.sql("select 999 as dr_id, 'F' as crs_id, 1 as run_num")
        .select(bucket_of("run", 8))
        .collect()
    }
    assert store.read("run").count() == 108


@pytest.mark.parametrize("step", [0, 1, 2])
def test_a_crash_at_any_step_leaves_the_old_state(spark, store, seed, monkeypatch, step):
    written, append = [], Change.append

    def failing(self, df, table):
        if len(written) == step:
            raise OSError("lost")
        append(self, df, table)
        written.append(table)

    version = store.version()
    with monkeypatch.context() as broken:
        broken.setattr(Change, "append", failing)
        with pytest.raises(OSError):
            transactions.register(store, applicants(spark, 1, 2), AS_OF)
    assert store.version() == version and len(written) == step
    for name, df in seed.items():
        assert rows(store.read(name)) == rows(df)
    receipts = transactions.register(store, applicants(spark, 1, 2), AS_OF)
    assert sorted(r.driver_id for r in receipts.collect()) == [138, 139]
    assert store.read("driver").count() == 11 and store.read("run").count() == 132


def test_a_crash_before_the_manifest_leaves_the_old_state(spark, store, seed, monkeypatch):
    def lost(self):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(Change, "commit", lost)
        with pytest.raises(OSError):
            transactions.register(store, applicants(spark, 1), AS_OF)
    assert rows(store.read("driver")) == rows(seed["driver"])
    assert rows(store.read("run")) == rows(seed["run"])


def test_of_two_changes_one_is_refused(store, seed):
    first, second = store.change(), store.change()
    first.append(seed["car"].filter("car_num = 11").selectExpr("99 as car_num", "model", "drive_class"), "car")
    second.append(seed["car"].filter("car_num = 11").selectExpr("98 as car_num", "model", "drive_class"), "car")
    first.commit()
    with pytest.raises(Conflict):
        second.commit()
    assert {r.car_num for r in store.read("car").collect()} >= {99}
    assert store.read("car").count() == 9


def test_a_refused_registration_is_made_again(spark, store, monkeypatch):
    commit, raced = Change.commit, []

    def race(self):
        if not raced:
            raced.append(True)
            transactions.register(store, applicants(spark, 50), AS_OF)
        return commit(self)

    monkeypatch.setattr(Change, "commit", race)
    (receipt,) = registration.registration_receipts(
        transactions.register(store, applicants(spark, 1), AS_OF)
    ).collect()
    stored = {r.applicant_id: r.driver_id for r in store.read("registered").collect()}
    assert stored == {50: 138, 1: 139} and receipt.driver_id == 139
    assert store.read("driver").count() == 11 and store.read("run").count() == 132


def test_old_versions_stay_readable(spark, store, seed):
    version = store.version()
    transactions.register(store, applicants(spark, 1), AS_OF)
    assert rows(store.read("driver", version)) == rows(seed["driver"])


def test_registered_before_keeps_its_id(spark, store):
    for batch in ((1,), (1,), (1, 2), (2,)):
        receipts = transactions.register(store, applicants(spark, *batch), AS_OF).collect()
        stored = {r.applicant_id: r.driver_id for r in store.read("registered").collect()}
        assert {r.applicant_id: r.driver_id for r in receipts} == {n: stored[n] for n in batch}
    assert store.read("driver").count() == 11


def test_only_rows_that_keep_the_constraints_are_appended(spark, store):
    long = "x" * 26
    bad = [
        (138, "Ann", "Good", None, None, 135, 11, ""),
        (None, "No", "Key", None, None, None, 11, "null:driver_id"),
        (139, None, long, None, None, None, 11, "null:first_name,length:surname"),
        (140, "Twice", "Over", None, None, None, 11, "repeated"),
        (140, "Twice", "Over", None, None, None, 11, "repeated"),
        (120, "Is", "Stored", None, None, None, 11, "stored"),
        (141, "No", "Car", None, None, None, 99, "missing:car"),
        (142, "No", "Car", None, None, None, None, "null:car"),
        (143, "Not", "Yet", None, None, 138, 11, "missing:caregiver"),
    ]
    batch = spark.createDataFrame([r[:7] for r in bad], schemas.StructType(
        [schemas.StructField(f.name, f.dataType) for f in schemas.DRIVER.fields]
    ))
    refused = transactions.append_checked(store, batch, "driver")
    assert sorted(r.reason for r in refused.collect()) == sorted(r[7] for r in bad if r[7])
    assert store.read("driver").count() == 10
    runs = spark.createDataFrame(
        [(138, "A", 1, None, None, 0), (138, "Z", 1, None, None, 0), (7, None, 1, None, None, None)],
        "dr_id int, crs_id string, run_num int, seconds double, cones int, wd int",
    )
    refused = transactions.append_checked(store, runs, "run")
    assert sorted(r.reason for r in refused.collect()) == [
        "missing:crs_id", "null:crs_id,null:wd,missing:dr_id",
    ]
    tables = {n: store.read(n) for n in schemas.TABLES}
    assert quality.audit_primary_keys(tables).count() == 0
    assert quality.audit_foreign_keys(tables).count() == 0
    assert quality.audit_lengths(tables).count() == 0
    assert all(list(r)[-1] == 0 for r in quality.audit_not_nulls(tables).collect())


def test_a_hot_parent_and_rows_without_one_spread(spark):
    batch = spark.range(3000).selectExpr(
        "cast(id as int) as driver_id", "'a' as first_name", "'b' as surname",
        "cast(null as date) as date_of_birth", "cast(null as int) as age",
        "cast(null as int) as caregiver", "cast(if(id % 3 = 0, id, 7) as int) as car",
    )
    car = spark.sql("select 7 as car_num")
    judged = constraints.judged(batch, "driver", {"driver": batch.limit(0), "car": car})
    found = {r.reason: r["count"] for r in judged.groupBy("reason").count().collect()}
    assert found == {"": 2000, "missing:car": 1000}


def test_results_after_many_edits_equal_a_full_run(spark, store, conf):
    conf("spark.sql.shuffle.partitions", "2")
    keys = [tuple(r) for r in store.read("run").select(*edits.RUN_KEY).collect()]
    pick = random.Random(7)
    for _ in range(100):
        batch = [
            (
                i, str(dr), crs, str(num),
                pick.choice([None, "", "11.5", f"{pick.uniform(10, 120):.2f}"]),
                pick.choice([None, "", "0", "4"]), pick.choice([None, "0", "1"]),
            )
            for i, (dr, crs, num) in enumerate(pick.choices(keys, k=pick.choice([1, 1, 3])))
        ]
        transactions.edit_runs(store, spark.createDataFrame(batch, schemas.EDITS))
    tables = {n: store.read(n) for n in schemas.TABLES}
    whole = results.stage_results(*(tables[n] for n in ("driver", "car", "run", "course")))
    got = [tuple(r) for r in transactions.stored_results(store).collect()]
    assert sorted(got, key=repr) == rows(whole) and len(got) == 9
    assert rows(transactions.stored_bests(store)) == rows(results.course_bests(tables["run"]))


def test_an_edit_renews_only_the_bests_of_its_buckets(spark, store):
    best = store.read("best").orderBy("best").first()
    number = store.read("run").filter(f"dr_id = {best.dr_id} and crs_id = '{best.crs_id}'").filter(
        bucket_of("run", 8) == best.run_bucket
    ).first().run_num
    before = files(store, "best")
    touched = transactions.edit_runs(store, one_edit(spark, (best.dr_id, best.crs_id, number)))
    after = files(store, "best")
    assert {b for b in before.keys() | after.keys() if before.get(b) != after.get(b)} <= set(touched)
    assert touched == [str(best.run_bucket)]


def test_results_read_no_runs_and_one_version(spark, store):
    def paths(df):
        return {f.partition("/store/")[2].partition("-")[0] for f in df.inputFiles()}

    assert paths(transactions.stored_bests(store)) == {"best"}
    assert paths(transactions.stored_results(store)) <= {"best", "driver", "car", "course"}
    version, old = store.version(), rows(transactions.stored_bests(store))
    transactions.edit_runs(store, one_edit(spark, (129, "F", 1)))
    assert rows(transactions.stored_bests(store, version)) == old


def test_appended_and_blank_runs_keep_the_bests_right(spark, store):
    runs = spark.createDataFrame(
        [(129, "F", 77, 10.5, None, 0), (129, "G", 77, 119.0, 3, 1), (129, "A", 78, None, 1, 0)],
        "dr_id int, crs_id string, run_num int, seconds double, cones int, wd int",
    )
    transactions.append_checked(store, runs, "run")
    transactions.register(store, applicants(spark, 1), AS_OF)
    assert store.read("run").filter("run_num >= 77 and dr_id = 129").count() > 0
    assert rows(transactions.stored_bests(store)) == rows(results.course_bests(store.read("run")))


def test_a_store_without_bests_computes_them(spark, store, seed):
    change = store.change()
    del change.state["best"]
    change.commit()
    assert transactions.edit_runs(store, one_edit(spark, (129, "F", 1)))
    assert rows(transactions.stored_bests(store)) == rows(results.course_bests(store.read("run")))
    with pytest.raises(ValueError, match="belong"):
        change = store.change()
        change.create(spark.createDataFrame([(1, 1, "A", 2.0)], schemas.BEST), "best", 8)
        change.replace("best", ["0"], spark.createDataFrame([(1, 1, "A", 2.0)], schemas.BEST))
