"""Reading, appending and replacing tables."""

from datetime import date

import pytest

from heatsheet import schemas
from heatsheet.operators.lineage import _use_checkpoint_dir
from heatsheet.plans import edits, quality, registration, results, updates
from heatsheet.sources import tables


def test_seed_sizes_and_types(seed):
    sizes = {name: df.count() for name, df in seed.items()}
    assert sizes == {"car": 8, "driver": 9, "course": 6, "run": 108}
    assert [f.dataType for f in seed["run"].schema] == [f.dataType for f in schemas.RUN]
    assert seed["run"].filter("seconds is null").count() == 9
    assert seed["run"].filter("cones is not null").count() == 5
    assert seed["run"].filter("wd = 1").count() == 6


def test_rows_append_and_replace(spark, seed, tmp_path):
    folder, staging = str(tmp_path / "db"), str(tmp_path / "staging")
    tables.overwrite(seed["run"], folder, "run")
    stored = tables.read_parquet(spark, folder, "run")
    more = tables.from_rows(spark, [(135, "A", 3, None, None, 0), (135, "A", 1, 1.0, 1, 1)], "run")
    tables.append_once(more, folder, "run")
    tables.append_once(more, folder, "run")
    stored = tables.read_parquet(spark, folder, "run")
    assert stored.count() == 109
    batch = spark.createDataFrame([(1, "135", "A", "3", "44.5", "", "1")], schemas.EDITS)
    tables.replace(edits.apply_run_edits(stored, batch), folder, "run", staging)
    again = tables.read_parquet(spark, folder, "run")
    assert again.count() == 109
    row = again.filter("dr_id = 135 and crs_id = 'A' and run_num = 3").first()
    assert (row.seconds, row.cones, row.wd) == (44.5, None, 1)


def test_registration_and_edits_reach_the_stored_tables(spark, seed, tmp_path):
    folder, staging = str(tmp_path / "db"), str(tmp_path / "staging")
    for name, df in seed.items():
        tables.overwrite(df, folder, name)
    stored = lambda name: tables.read_parquet(spark, folder, name)
    applicants = spark.createDataFrame(
        [(1, "Ann", "Adult", "11", None, None, None), (2, "Kay", "Kid", "18", "on", "2010-01-01", "135")],
        schemas.APPLICANTS,
    )
    registered = registration.register_drivers(
        applicants, stored("driver"), stored("car"), date(2024, 1, 1)
    )
    for _ in range(2):
        updates.store_registration(registered, folder)
        assert stored("driver").count() == 11 and stored("run").count() == 132
    assert quality.audit_foreign_keys({n: stored(n) for n in seed}).count() == 0
    batch = spark.createDataFrame(
        [(i, "138", stage, "1", "30", None, "1") for i, stage in enumerate("ABCDEF")], schemas.EDITS
    )
    updates.store_edits(batch, folder, staging)
    assert stored("run").count() == 132
    scored = results.stage_results(stored("driver"), stored("car"), stored("run"), stored("course"), list("ABCDEF"))
    assert results.top_n(scored, 1).first().best_driver == "138 Ann Adult"
    assert scored.filter("driver_id = 138").first().overall == 240.0


def test_registration_is_repeatable_from_fresh_plans(spark, seed, tmp_path, monkeypatch):
    folder = str(tmp_path / "db")
    for name, df in seed.items():
        tables.overwrite(df, folder, name)
    stored = lambda name: tables.read_parquet(spark, folder, name)

    def batch(*numbers):
        rows = [(n, "Ann", "Adult", "11", None, None, None) for n in numbers]
        applicants = spark.createDataFrame(rows, schemas.APPLICANTS)
        registered = registration.register_drivers(
            applicants, stored("driver"), stored("car"), date(2024, 1, 1)
        )
        return updates.store_registration(registered, folder)

    def fail(*_):
        raise OSError("lost between the tables")

    with monkeypatch.context() as broken:
        broken.setattr(updates, "blank_runs", fail)
        with pytest.raises(OSError):
            batch(1)
    assert stored("driver").count() == 10 and stored("run").count() == 108
    for numbers in ((1,), (1,), (1, 2), (2,)):
        settled = registration.registration_receipts(batch(*numbers))
        receipts = sorted(r.driver_id for r in settled.collect())
        ids = {r.applicant_id: r.driver_id for r in stored("registered").collect()}
        assert receipts == sorted(ids[n] for n in numbers)
        assert stored("driver").filter(f"driver_id in ({','.join(map(str, receipts))})").count() == len(numbers)
    ids = {r.applicant_id: r.driver_id for r in stored("registered").collect()}
    assert sorted(ids) == [1, 2] and len(set(ids.values())) == 2
    assert stored("registered").count() == 2
    assert stored("driver").count() == 11 and stored("run").count() == 132
    for driver_id in ids.values():
        assert stored("run").filter(f"dr_id = {driver_id}").count() == 12


def test_malformed_csv_raises(spark, tmp_path):
    path = tmp_path / "car.csv"
    path.write_text("car_num,model,drive_class\nx,Mini,FWD\n")
    with pytest.raises(Exception):
        tables.read_csv(spark, str(path), schemas.CAR).collect()


class _Reader:
    def __init__(self):
        self.read = self

    def jdbc(self, url, table, **options):
        return url, table, options


class _Rows(list):
    def first(self):
        return self[0]

    def collect(self):
        return self


class _Server(_Reader):
    """Answers the two questions before a sliced read."""

    def __init__(self, ends, sizes):
        self.ends, self.sizes, self.asked = ends, sizes, []
        self.read = self

    def jdbc(self, url, table, **options):
        if table.startswith("(select min"):
            self.asked.append(table)
            return _Rows([self.ends])
        if table.startswith("("):
            self.asked.append(table)
            return _Rows({"step": s, "size": n} for s, n in self.sizes.items())
        return url, table, options


def test_jdbc_reads_slices_of_the_index_and_cuts_a_hot_range():
    # Steps are 10 wide: 3 slices x 64 steps from 1 to 1920. Step 100 has two thirds of all rows.
    server = _Server((1, 1920), {0: 10, 3: 10, 50: 25, 100: 140, 101: 5, 191: 20})
    _, table, options = tables.read_jdbc(
        server, "jdbc:mysql://db/club", "run", {"user": "u"}, partitions=3
    )
    assert table == "run" and options["properties"] == {"user": "u"}
    assert server.asked == [
        "(select min(dr_id) as low, max(dr_id) as high from run) e",
        "(select floor((dr_id - 1) / 10) as step, count(*) as size from run "
        "group by floor((dr_id - 1) / 10)) h",
    ]
    hashed = "mod(crc32(concat_ws('|', dr_id, crs_id, run_num)), 2)"
    assert options["predicates"] == [
        "dr_id < 1001",
        f"dr_id >= 1001 and dr_id < 1011 and {hashed} = 0",
        f"dr_id >= 1001 and dr_id < 1011 and {hashed} = 1",
        "dr_id >= 1011",
    ]


def test_jdbc_without_rows_or_with_text_keys():
    _, _, options = tables.read_jdbc(_Server((None, None), {}), "u", "run", partitions=3)
    assert "predicates" not in options
    _, _, options = tables.read_jdbc(_Server(None, {}), "u", "course", partitions=2)
    assert options["predicates"] == [f"mod(crc32(concat_ws('|', course_id)), 2) = {i}" for i in range(2)]


@pytest.mark.parametrize("partitions", [2, 5, 16])
@pytest.mark.parametrize("keys", ["id", "if(id % 3 = 0, 7, id)", "7", "id * id - 500", "id % 4 * 1000"])
def test_index_slices_hold_every_row_once(spark, keys, partitions):
    run = spark.range(2000).selectExpr(
        f"cast({keys} as int) as dr_id", "'A' as crs_id", "cast(id as int) as run_num"
    )
    run.createOrReplaceTempView("run")
    low, high = run.selectExpr("min(dr_id)", "max(dr_id)").first()
    query = tables.histogram_query("run", low, high, partitions)
    sizes = {r.step: r.size for r in spark.sql(f"select * from {query}").collect()}
    assert len(sizes) <= partitions * tables.STEPS
    slices = tables.index_slices("run", sizes, low, high, partitions)
    held = run.selectExpr(*[f"count_if({s}) as s{n}" for n, s in enumerate(slices)]).first()
    assert sum(held) == 2000 and max(held) < 2 * 2000 / partitions
    assert len(slices) <= 2 * partitions + 1
    beyond = spark.sql(f"select {low - 9} as dr_id, 'A' as crs_id, 1 as run_num union all "
                       f"select {high + 9}, 'A', 1")  # fmt: skip
    assert sum(beyond.selectExpr(*[f"count_if({s})" for s in slices]).first()) == 2


def test_plain_jdbc_reads_in_one_piece():
    _, _, plain = tables.read_jdbc(_Reader(), "jdbc:mysql://db/club", "course")
    assert "predicates" not in plain


def test_key_slices_hold_every_row_once_even_for_one_hot_driver(spark):
    run = spark.range(3000).selectExpr(
        "case when id % 3 = 0 then 7 else id end as dr_id", "'A' as crs_id", "id as run_num"
    )
    sizes = [run.filter(condition).count() for condition in tables.key_slices("run", 4)]
    assert sum(sizes) == 3000 and max(sizes) < 900


class _Context:
    master = "spark://cluster:7077"
    used = None

    def getCheckpointDir(self):
        return self.used

    def setCheckpointDir(self, folder):
        self.used = folder


class _Session:
    def __init__(self, options):
        self.sparkContext, self.options = _Context(), options
        self.conf = self

    def get(self, name, default):
        return self.options.get(name, default)


def test_checkpoint_folder_comes_from_the_session():
    session = _Session({"spark.checkpoint.dir": "/shared/checkpoints"})
    _use_checkpoint_dir(session)
    assert session.sparkContext.used == "/shared/checkpoints"
    with pytest.raises(RuntimeError):
        _use_checkpoint_dir(_Session({}))
