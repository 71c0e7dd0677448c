"""Jobs on the sample competition against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from heatsheet import schemas
from heatsheet.functions import NAME_COLLATION
from heatsheet.plans import cascade, edits, listings, quality, registration, results, search

STAGES = list("ABCDEF")

OVERALL = [
    (135, "Maggie Atwood", "MX-5", [41.64, 44.07, 55.92, 43.02, 22.0, 42.31], 248.96, "🏆"),
    (124, "Dora Watson", "Charade", [45.41, 41.64, 45.92, 54.92, 24.89, 45.62], 258.40, "🎁"),
    (132, "Lucas Morales", "GR Yaris", [60.38, 38.36, 45.76, 55.91, 23.71, 37.6], 261.72, "🎁"),
    (120, "Tina Zheng(J)", "MX-5", [56.0, 36.84, 50.03, 59.89, 22.4, 38.68], 263.84, "🎁"),
    (137, "Daniel Celeste", "Camaro", [49.16, 39.09, 63.47, 46.37, 36.5, 49.47], 284.06, "🎁"),
    (121, "Li Bao", "MX-5", [69.7, 42.18, 58.48, 50.29, 25.14, 42.7], 288.49, ""),
    (133, "Oliver Ngatai", "BRZ", [65.12, 51.42, 61.31, 39.4, 32.41, 42.93], 292.59, ""),
    (128, "Alan Montgomery", "Swift", [65.38, 36.26, 59.84, 54.83, 37.38, None], None, ""),
    (129, "Jack Atwood(J)", "MX-5", [69.37, 48.9, 44.99, 40.08, 31.91, None], None, ""),
]


def _scored(seed):
    return results.stage_results(seed["driver"], seed["car"], seed["run"], seed["course"], STAGES)


def test_nobody_qualifies_while_a_course_is_unrun(spark, seed):
    more = seed["course"].unionByName(
        spark.createDataFrame([("G", "Seventh", None)], seed["course"].schema)
    )
    unrun = results.stage_results(seed["driver"], seed["car"], seed["run"], more, STAGES)
    assert unrun.filter("qualified or overall is not null").isEmpty()
    seventh = seed["run"].filter("crs_id = 'A'").withColumn("crs_id", F.lit("G"))
    run = seed["run"].unionByName(seventh)
    rows = results.stage_results(seed["driver"], seed["car"], run, more, []).filter("qualified")
    before = {r.driver_id: r for r in _scored(seed).filter("qualified").collect()}
    assert {r.driver_id: r.overall for r in rows.collect()} == {
        i: round(r.overall + r.course_A, 2) for i, r in before.items()
    }


def test_overall_results(seed):
    rows = results.overall_results(seed["driver"], seed["car"], seed["run"], seed["course"], STAGES).collect()
    shown = [
        (r.driver_id, r.driver_name, r.model, [r[f"course_{s}"] for s in STAGES], r.overall, r.medal)
        for r in rows
    ]
    assert shown == OVERALL
    assert [r.qualified for r in rows] == [True] * 7 + [False] * 2


def test_labels(seed):
    rows = {r.driver_id: r for r in results.result_labels(_scored(seed), STAGES).collect()}
    assert rows[128].course_F == "dnf" and rows[128].overall == "NQ"
    assert rows[135].overall == "248.96"


def test_top_and_chart(seed):
    top = results.top_n(_scored(seed))
    labels = [r.best_driver for r in top.collect()]
    assert labels == [
        "135 Maggie Atwood", "124 Dora Watson", "132 Lucas Morales", "120 Tina Zheng",
        "137 Daniel Celeste",
    ]
    chart = results.chart_series(top).first()
    assert chart.name_list == labels[::-1]
    assert chart.value_list == [284.06, 263.84, 261.72, 258.4, 248.96]


def test_top_holds_only_qualified(seed):
    assert results.top_n(_scored(seed), 100).count() == 7


def test_medals_reach_unqualified_when_few_qualify(seed):
    few = _scored(seed).filter("driver_id in (135, 128, 129)")
    medals = {r.driver_id: r.medal for r in results.leader_medals(few).collect()}
    assert medals == {135: "🏆", 128: "🎁", 129: "🎁"}


@pytest.mark.parametrize("partitions", [None, 4])
def test_positions(seed, partitions):
    rows = results.positions(_scored(seed), partitions).collect()
    placed = {r.position: r.driver_id for r in rows}
    assert placed == {i + 1: row[0] for i, row in enumerate(OVERALL)}


def test_list_drivers(seed):
    rows = listings.list_drivers(seed["driver"], seed["car"]).collect()
    assert [r.driver_id for r in rows] == [129, 135, 121, 137, 128, 132, 133, 124, 120]
    assert {r.driver_id: r.caregiver_name for r in rows if r.caregiver_name} == {
        129: "Maggie Atwood"
    }
    assert [r.driver_id for r in rows if r.junior] == [129, 120]


def test_junior_list(seed):
    rows = listings.junior_list(seed["driver"]).collect()
    assert [(r.driver_id, r.age, r.caregiver_name) for r in rows] == [
        (120, 18, None), (129, 12, "Maggie Atwood"),
    ]
    shown = listings.shown(listings.junior_list(seed["driver"]), ["caregiver_name"], "N/A")
    assert [r.caregiver_name for r in shown.collect()] == ["N/A", "Maggie Atwood"]


def test_courses_and_picklists(seed):
    courses = {r.course_id: r.image_path for r in listings.list_courses(seed["course"]).collect()}
    assert courses["F"] == "static/fluoro.gif"
    cars = {r.car_num: r.label for r in listings.car_picklist(seed["car"]).collect()}
    assert cars[17] == "17  GR Yaris  4WD"
    choices = {
        (r.choice, r.id): r.label
        for r in listings.runs_to_edit(seed["run"], seed["driver"], seed["course"]).collect()
    }
    assert choices["driver", "129"] == "129  Jack Atwood"
    assert choices["course", "A"] == "A  Going Loopy"
    assert len(choices) == 15
    ids = sorted(r.driver_id for r in listings.caregiver_candidates(seed["driver"]).collect())
    assert ids == [121, 124, 128, 132, 133, 135, 137]


def test_run_details(seed):
    t = seed
    rows = listings.run_details(t["driver"], t["run"], t["course"], t["car"], 129).collect()
    assert [r.run_total for r in rows] == [
        103.72, 69.37, 51.2, 48.9, 77.43, 44.99, 40.08, 42.49, 33.53, 31.91, None, None,
    ]
    assert rows[0].course_name == "Going Loopy" and rows[0].model == "MX-5"
    header = listings.run_header(t["driver"], t["run"], t["car"], 129).collect()
    assert [tuple(r) for r in header] == [(129, "Jack", "Atwood", "MX-5", "RWD")]


def test_driver_without_runs_has_no_details(seed):
    t = seed
    none = t["run"].filter("dr_id <> 129")
    assert listings.run_details(t["driver"], none, t["course"], t["car"], 129).count() == 0
    assert listings.run_header(t["driver"], none, t["car"], 129).count() == 0
    row = (
        results.stage_results(t["driver"], t["car"], none, t["course"], STAGES)
        .filter("driver_id = 129")
        .first()
    )
    assert row.overall is None and not row.qualified


def test_runs_to_edit(seed):
    t = seed
    by_driver = listings.runs_to_edit(t["run"], t["driver"], t["course"], dr_id=129).collect()
    assert len(by_driver) == 12
    assert [r.wd for r in by_driver[:4]] == ["wd", "wd", "", "wd"]
    by_course = listings.runs_to_edit(t["run"], t["driver"], t["course"], crs_id="C").collect()
    assert len(by_course) == 18
    assert [r.dr_id for r in by_course[:3]] == [120, 121, 124]
    both = listings.runs_to_edit(t["run"], t["driver"], t["course"], dr_id=129, crs_id="C")
    assert both.count() == 12


@pytest.mark.parametrize(
    "term, expected",
    [
        ("an", [137, 128]),
        (" an", [137, 128]),
        ("Jack Atwood", [135, 129]),
        ("ATWOOD", [135, 129]),
        ("zz", []),
        ("_", []),
    ],
)
@pytest.mark.parametrize("few", [True, False])
def test_driver_search(seed, conf, term, expected, few):
    if not few:
        conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    t = seed
    rows = search.driver_search(t["driver"], t["car"], t["run"], t["course"], STAGES, term).collect()
    assert [r.driver_id for r in rows] == expected
    by_id = {row[0]: row for row in OVERALL}
    for r in rows:
        assert [r[f"course_{s}"] for s in STAGES] == by_id[r.driver_id][3]
        assert r.overall == by_id[r.driver_id][4]


def _edits(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.EDITS)


def test_apply_one_edit(spark, seed):
    batch = _edits(spark, (1, "129", "F", "1", "45.5", "1", "0"))
    changed = edits.apply_run_edits(seed["run"], batch)
    assert changed.schema.names == seed["run"].schema.names
    rows = results.overall_results(seed["driver"], seed["car"], changed, seed["course"], STAGES).collect()
    assert (rows[5].driver_id, rows[5].course_F, rows[5].overall) == (129, 50.5, 285.75)
    assert changed.count() == 108


def test_fold_then_apply(spark, seed):
    batch = _edits(
        spark,
        (1, "129", "A", "1", "50.5", "2", "1"),
        (3, "129", "A", "1", None, "", None),
        (2, "129", "A", "1", "", None, "0"),
        (4, "129", "A", "9", "11", "1", "1"),
    )
    folded = {r.run_num: (r.time, r.cones, r.wd) for r in edits.fold_edits(batch).collect()}
    assert folded == {1: ("", "", "0"), 9: ("11", "1", "1")}
    row = (
        edits.apply_run_edits(seed["run"], batch)
        .filter("dr_id = 129 and crs_id = 'A' and run_num = 1")
        .first()
    )
    assert (row.seconds, row.cones, row.wd) == (None, None, 0)
    assert [r.run_num for r in edits.unmatched_edits(batch, seed["run"]).collect()] == ["9"]


def test_edit_checks_and_receipts(spark, seed):
    batch = _edits(
        spark,
        (1, "129", "A", "1", "10", "0", "1"),
        (2, "129", "A", "1", "120", "25", "0"),
        (3, "129", "A", "1", "", "", None),
        (4, "129", "A", "1", "9.99", "26", "2"),
        (5, "129", "A", "1", "120.01", "-1", ""),
        (6, "129", "A", "1", "45.505", "x", "0"),
        (7, "x", None, "", "fast", None, None),
    )
    refused = {r.seq: r.reason for r in edits.validate_edits(batch).collect()}
    assert refused == {
        4: "time,cones,wd",
        5: "time,cones,wd",
        6: "time,cones",
        7: "dr_id,crs_id,run_num,time",
    }
    receipts = {
        r.seq: r for r in edits.edit_receipts(batch, seed["driver"], seed["course"]).collect()
    }
    assert len(receipts) == 7
    assert receipts[1].course_name == "Going Loopy" and receipts[1].wrong_direction == "Some"
    assert receipts[3].cones == "None" and receipts[3].wrong_direction == "None"
    assert receipts[7].first_name is None


def test_blank_runs(spark, seed):
    applicant = spark.createDataFrame(
        [(1, "New", "Driver", "11", None, None, None)], schemas.APPLICANTS
    )
    registered = registration.register_drivers(applicant, seed["driver"], seed["car"])
    assert [r.driver_id for r in registered.collect()] == [138]
    drivers = registration.new_driver_rows(registered, seed["driver"])
    assert drivers.schema.simpleString() == seed["driver"].schema.simpleString()
    runs = registration.blank_runs(registered, seed["run"])
    assert runs.schema.simpleString() == seed["run"].schema.simpleString()
    rows = runs.collect()
    assert len(rows) == 12 and len(set(rows)) == 12
    assert {(r.dr_id, r.seconds, r.cones, r.wd) for r in rows} == {(138, None, None, 0)}
    more = seed["run"].unionByName(runs)
    before = results.stage_bests(seed["run"], STAGES).collect()
    assert sorted(results.stage_bests(more, STAGES).collect()) == sorted(before)
    assert registration.blank_runs(registered, seed["run"].filter("false")).count() == 0


def _left(kept):
    return {name: df.count() for name, df in kept.items()}


def test_delete_car(spark, seed):
    keys = spark.createDataFrame([(22,)], "car_num int")
    kept, blocked = cascade.delete_cascade(seed, "car", keys)
    assert _left(kept) == {"car": 7, "driver": 7, "course": 6, "run": 84}
    assert blocked.count() == 0


def test_delete_course(spark, seed):
    keys = spark.createDataFrame([("F",)], "course_id string")
    kept, blocked = cascade.delete_cascade(seed, "course", keys)
    assert _left(kept) == {"car": 8, "driver": 9, "course": 5, "run": 90}
    assert blocked.count() == 0


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_caregiver_blocks_delete(spark, seed, conf, adaptive):
    conf("spark.sql.adaptive.enabled", adaptive)
    keys = spark.createDataFrame([(135,), (121,)], "driver_id int")
    kept, blocked = cascade.delete_cascade(seed, "driver", keys)
    assert [r.key for r in blocked.collect()] == [135]
    assert _left(kept) == {"car": 8, "driver": 8, "course": 6, "run": 96}
    both = spark.createDataFrame([(135,), (129,)], "driver_id int")
    kept, blocked = cascade.delete_cascade(seed, "driver", both)
    assert blocked.count() == 0 and _left(kept)["driver"] == 7


def test_blocking_follows_chains(spark):
    # 1 looks after 2, who looks after 3, who looks after 4; only 4 is to stay.
    driver = spark.createDataFrame(
        [(1, None, 7), (2, 1, 7), (3, 2, 8), (4, 3, 9)], "driver_id int, caregiver int, car int"
    )
    keys = spark.createDataFrame([(1,), (2,), (3,)], "driver_id int")
    assert sorted(r.key for r in cascade.blocked_keys(driver, "driver_id", keys).collect()) == [1, 2, 3]
    cars = spark.createDataFrame([(7,), (8,)], "car int")
    assert sorted(r.key for r in cascade.blocked_keys(driver, "car", cars).collect()) == [7, 8]


def test_rekey(spark, seed):
    mapping = spark.createDataFrame([(135, 900), (129, 901)], "old int, new int")
    changed = cascade.rekey_cascade(seed, "driver", mapping)
    assert changed["driver"].filter("driver_id = 901 and caregiver = 900").count() == 1
    assert changed["run"].filter("dr_id in (900, 901)").count() == 24
    assert changed["run"].count() == 108
    assert quality.audit_foreign_keys(changed).count() == 0


def test_audits_find_nothing(seed):
    for name, keys in schemas.PRIMARY_KEYS.items():
        assert quality.audit_primary_key(seed[name], keys).count() == 0
        nulls = quality.audit_not_null(seed[name], schemas.required_columns(name) or keys)
        assert all(r.nulls == 0 for r in nulls.collect())
        assert quality.audit_length(seed[name], keys, schemas.MAX_LENGTHS[name]).count() == 0
    assert quality.audit_foreign_keys(seed).count() == 0


def test_audits_find_bad_rows(spark, seed):
    bad = spark.createDataFrame(
        [(1, "A", 1, 20.0, None, None), (1, "A", 1, None, None, 0), (2, "Z9", 1, 20.0, 1, 0)],
        "dr_id int, crs_id string, run_num int, seconds double, cones int, wd int",
    )
    tables = {**seed, "run": bad}
    orphans = {(r.reference, r.value): r.orphans for r in quality.audit_foreign_keys(tables).collect()}
    assert orphans == {("run.dr_id", "1"): 2, ("run.dr_id", "2"): 1, ("run.crs_id", "Z9"): 1}
    keys = schemas.PRIMARY_KEYS["run"]
    assert [tuple(r) for r in quality.audit_primary_key(bad, keys).collect()] == [(1, "A", 1, 2)]
    nulls = {r.column: r.nulls for r in quality.audit_not_null(bad, ["seconds", "wd"]).collect()}
    assert nulls == {"seconds": 1, "wd": 1}
    long = quality.audit_length(bad, keys, schemas.MAX_LENGTHS["run"]).collect()
    assert [tuple(r) for r in long] == [(2, "Z9", 1, "crs_id", 1, 2)]
    filled = quality.fill_defaults(bad, schemas.DEFAULTS["run"])
    assert filled.filter(F.col("wd").isNull()).count() == 0


def test_search_terms(spark):
    rows = [(1, "Jane Doe"), (2, "  "), (3, ""), (4, "R2"), (5, None), (6, "bob")]
    terms = spark.createDataFrame(rows, schemas.TERMS)
    valid = {r.term_id: r.valid for r in search.validate_search(terms).collect()}
    assert valid == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True}


def _entrants(spark):
    names = [(1, "José", "Zed"), (2, "JOSE", "de Boer"), (3, "Zoë", "Émile"), (4, "Ann", "Eck"), (5, "Ann", "émile")]
    return spark.createDataFrame(
        [(i, f, s, None, 15, None, 1) for i, f, s in names], schemas.DRIVER
    )


def test_names_sort_and_match_by_collation(spark):
    driver = _entrants(spark)
    car = spark.createDataFrame([(1, "Swift", "FWD")], schemas.CAR)
    plain = [r.driver_id for r in listings.list_drivers(driver, car).collect()]
    assert plain == [4, 1, 2, 3, 5]
    rows = listings.list_drivers(driver, car, NAME_COLLATION).collect()
    assert [r.driver_id for r in rows] == [2, 4, 5, 3, 1]
    placed = listings.list_drivers(driver, car, NAME_COLLATION, numbered=True).collect()
    assert sorted((r.pos, r.driver_id) for r in placed) == [(1, 2), (2, 4), (3, 5), (4, 3), (5, 1)]
    juniors = listings.junior_list(driver, collation=NAME_COLLATION, numbered=True).collect()
    assert sorted((r.pos, r.driver_id) for r in juniors) == [(1, 2), (2, 4), (3, 3), (4, 5), (5, 1)]

    def found(term, collation):
        return sorted(
            r.driver_id for r in driver.filter(search.name_matches(term, collation)).collect()
        )

    assert found("jose", None) == [2] and found("jose", NAME_COLLATION) == [1, 2]
    assert found("zoe EMILE", NAME_COLLATION) == [3, 5]
    assert listings.list_drivers(driver.limit(0), car, NAME_COLLATION, numbered=True).count() == 0


def test_search_by_collation_scores_those_it_finds(spark, seed):
    driver = seed["driver"].withColumn("surname", F.translate("surname", "ao", "áÓ"))
    found = search.driver_search(
        driver, seed["car"], seed["run"], seed["course"], STAGES, "WATSON", NAME_COLLATION
    ).collect()
    assert [(r.driver_id, r.surname, r.overall) for r in found] == [(124, "WátsÓn", 258.40)]


def test_numbered_listings_agree_with_sorted_ones(spark, seed):
    t = seed
    pairs = [
        (listings.list_drivers(t["driver"], t["car"], numbered=n) for n in (False, True)),
        (listings.junior_list(t["driver"], numbered=n) for n in (False, True)),
        (listings.run_details(t["driver"], t["run"], t["course"], t["car"], 124, n) for n in (False, True)),
        (listings.runs_by_driver(t["run"], t["driver"], t["course"], 124, n) for n in (False, True)),
        (listings.runs_by_course(t["run"], t["driver"], t["course"], "B", n) for n in (False, True)),
    ]
    for ordered, placed in pairs:
        rows = sorted(placed.collect(), key=lambda r: r.pos)
        assert [r.pos for r in rows] == list(range(1, len(rows) + 1)) and rows
        assert [tuple(r)[1:] for r in rows] == [tuple(r) for r in ordered.collect()]


def test_every_course_is_shown_without_being_named(spark, seed):
    more = seed["course"].unionByName(
        spark.createDataFrame([("G", "Seventh", None)], seed["course"].schema)
    )
    once = seed["run"].filter("crs_id = 'A' and dr_id <> 124").withColumn("crs_id", F.lit("G"))
    run = seed["run"].unionByName(once)
    whole = results.overall_results(seed["driver"], seed["car"], run, more)
    rows = {r.driver_id: r for r in whole.collect()}
    named = {r.driver_id: r for r in _scored(seed).collect()}
    for i, row in rows.items():
        expected = {c: named[i][f"course_{c}"] for c in STAGES if named[i][f"course_{c}"] is not None}
        if i != 124 and "A" in expected:
            expected["G"] = expected["A"]
        assert row.bests == expected
    assert not rows[124].qualified and rows[135].medal == "🏆"
    shown = {r.driver_id: r for r in results.course_labels(whole, more).collect()}
    assert shown[124].bests["G"] == "dnf" and shown[124].overall == "NQ"
    assert list(shown[135].bests) == [*STAGES, "G"]
    unraced = results.stage_results(seed["driver"], seed["car"], run.limit(0), more)
    assert {tuple(r.bests.values()) for r in results.course_labels(unraced, more).collect()} == {
        ("dnf",) * 7
    }
    found = search.driver_search(seed["driver"], seed["car"], run, more, None, "watson").collect()
    assert [r.bests for r in found] == [rows[124].bests]
