import pytest

from tallyspan.operators import coverage, grid, quality

S = "k string, m long, y long"


def monthly(spark, data):
    return spark.createDataFrame(data, S)


def test_grid_has_every_key_in_every_period_and_fills_nothing(spark, rows):
    full = grid.dense_grid(monthly(spark, [("a", 1, 5), ("a", 4, 0), ("b", 2, 7)]))
    assert full.count() == 2 * 4
    assert rows(full.filter("k = 'a'"), "m", "y") == [(1, 5), (2, None), (3, None), (4, 0)]
    own = grid.dense_grid(monthly(spark, [("a", 1, 5), ("a", 4, 0), ("b", 2, 7)]), own_span=True)
    assert rows(own.filter("k = 'b'"), "m", "y") == [(2, 7)]


def test_study_grid_says_why_a_count_is_absent(spark, rows):
    data = [("a", 2001, 2001 * 12 + i, 0 if i == 0 else 3) for i in range(12)]
    reported = spark.createDataFrame(data, "k string, year long, m long, y long")
    cells = grid.study_grid(reported, 2000, 2002, (2002,))
    assert cells.count() == 36
    status = {(r.year, r.status) for r in cells.collect()}
    assert status == {(2000, "outside_annual_top"), (2001, "observed"), (2001, "observed_zero"), (2002, "report_unavailable")}
    history = {r.year: (r.annual_total, r.status) for r in coverage.annual_history(cells, (2002,)).collect()}
    assert history == {2000: (None, "outside_annual_top"), 2001: (33, "reported"), 2002: (None, "report_unavailable")}


def test_readiness_lists_what_is_missing(spark):
    data = [("a", 2000 * 12 + i, 0 if i else None, "observed_zero" if i else "outside_annual_top") for i in range(12)]
    cells = spark.createDataFrame(data, "k string, m long, y long, status string")
    row = coverage.readiness(cells, (2000, 2001)).first()
    assert (row.year_count, row.month_count, row.missing_years) == (1, 11, [2001])
    assert row.missing_months == [2000 * 12] + [2001 * 12 + i for i in range(12)]
    ready = coverage.readiness(cells, (2000, 2001))
    assert coverage.readiness_decision(ready, coverage.threshold_policy(11)).first().eligible
    assert not coverage.readiness_decision(ready, coverage.threshold_policy(12)).first().eligible
    assert coverage.readiness_decision(ready).first().readiness_status == "methodology_configuration_required"


def test_absent_candidate_is_listed_and_not_ready(spark, rows):
    ready = spark.createDataFrame([("a", 20)], "k string, month_count long")
    names = spark.createDataFrame([("a",), ("NONE",)], "k string")
    decided = coverage.readiness_decision(coverage.candidate_universe(ready, names), coverage.threshold_policy(17))
    assert rows(decided, "k", "month_count", "eligible") == [("NONE", 0, False), ("a", 20, True)]


@pytest.mark.parametrize("data,reason", [
    ([("a", 1, 1), ("a", 1, 2)], "duplicate_period"), ([("a", 1, 1), ("a", 3, 2)], "missing_period"), ([("a", 1, 1), ("a", 2, -2)], "invalid_count"),
    ([("a", 1, 0), ("a", 2, 0)], "insufficient_history"), ([("a", 1, 0), ("a", 2, 0), ("a", 3, 0)], "ok"),
])
def test_coverage_gate(spark, data, reason):
    assert coverage.coverage_gate(monthly(spark, data), 3).first().reason == reason


def test_zero_fill_only_behind_the_gate(spark, rows):
    df = monthly(spark, [("a", 1, 1), ("a", 2, 2), ("b", 1, 1), ("b", 3, 2)])
    assert rows(grid.zero_filled(df, coverage.coverage_gate(df, 2))) == [("a", 1, 1), ("a", 2, 2)]


def weekly(spark, data):
    return spark.createDataFrame(data, "k string, year long, week long, y long, reporting_status string")


def test_weekly_grid_ends_with_the_last_complete_week_and_knows_week_53(spark, rows):
    df = weekly(spark, [("a", 2020, 52, 4, "complete"), ("a", 2021, 2, 0, "complete"), ("a", 2021, 3, 9, "incomplete")])
    assert rows(grid.weekly_grid(df)) == [("a", 2020, 52, 4), ("a", 2020, 53, None), ("a", 2021, 1, None), ("a", 2021, 2, 0)]


def test_missing_weeks_treat_zero_as_present(spark, rows):
    df = weekly(spark, [("a", 2019, 51, 0, None), ("a", 2020, 1, 1, None)])
    assert rows(coverage.missing_weeks(df)) == [("a", 2019, 52)]


def test_quality_report_counts(spark):
    df = weekly(spark, [("a", 2019, 53, 0, "complete"), ("a", 2020, 1, None, "complete"), ("a", 2020, 2, 3, None), ("a", 2020, 2, 3, "complete")])
    found = {r.check: r.findings for r in coverage.quality_report(df).collect()}
    assert found == {
        "observations": 4, "duplicates": 2, "blank_observations": 1, "zero_weeks": 1, "week53": 1, "week53_conflicts": 1,
        "excluded_from_training": 1, "missing_weeks": 0,
    }


def test_routes(spark, rows):
    data = [("long", 2018 + i // 52, i % 52 + 1, 1, "complete") for i in range(104)] + [("short", 2020, 1, 1, "complete"), ("other", 2020, 1, 1, "complete")]
    reasons = coverage.eligibility_reasons(weekly(spark, data), 100, ["long", "short"])
    assert rows(coverage.workflow_route(reasons), "k", "route") == [("long", "research"), ("other", "refused"), ("short", "refused")]


def test_duplicates_list_all_copies(spark, rows):
    df = spark.createDataFrame([("a", 1, "s1"), ("a", 1, "s2"), ("b", 1, "s1")], "k string, m long, source string")
    assert rows(quality.duplicate_keys(df, ["k", "m"]), "k", "source", "copies") == [("a", "s1", 2), ("a", "s2", 2)]
    assert rows(quality.duplicate_sources(df, ["k", "m"], "source"), "k", "source", "n_sources") == [("a", "s1", 2), ("a", "s2", 2)]


def test_duplicates_with_one_hot_key(spark):
    df = spark.range(6000).selectExpr("if(id % 3 = 0, -1, id) AS k", "id")
    found = quality.duplicate_keys(df, ["k"])
    assert found.count() == 2000 and found.select("copies").distinct().first()[0] == 2000


def test_first_spelling_wins(spark, rows):
    df = spark.createDataFrame([(3, "DENGUE"), (1, " Dengue  fever"), (2, "dengue FEVER"), (4, "  ")], "row long, label string")
    found = quality.label_first_spelling(df, "label", "row")
    assert rows(found, "row", "canonical", "label_ok") == [
        (1, "Dengue fever", True), (2, "Dengue fever", True), (3, "DENGUE", True), (4, "", False)
    ]


def test_metadata_is_adopted_only_when_all_rows_agree(spark, rows):
    df = spark.createDataFrame([("s", "x", "1", None), ("s", "x", "2", None), ("s", "x", None, " ")], "source string, a string, b string, c string")
    assert rows(quality.metadata_adoption(df, ["a", "b", "c"], "source"), "field", "value", "state") == [
        ("a", "x", "adopted"), ("b", None, "incomplete"), ("c", None, "absent")
    ]


def test_decisions(spark, rows):
    from pyspark.sql import functions as F

    data = [
        ("a", 2019, 53, "blank", "nonexistent", "letter", None), ("a", 2020, 53, "blank", "nonexistent", "letter", None),
        ("a", 2019, 1, "blank", "corrected", "letter", "2.5"), ("a", 2019, 2, "blank", "corrected", "letter", "7"),
        ("a", 2019, 3, "blank", "zero", " ", None), ("a", 2019, 4, "conflict", "zero", "letter", None), ("a", 2019, 5, "blank", "zero", "letter", None),
    ]
    from tallyspan.functions.calendar import year_length

    decisions = spark.createDataFrame(data, "k string, year long, week long, target string, action string, evidence string, corrected string")
    checked = quality.decision_error(decisions, year_length(F.col("year")))
    assert rows(checked, "year", "week", "error") == [
        (2019, 1, "bad_corrected_value"), (2019, 2, "ok"), (2019, 3, "evidence_required"), (2019, 4, "unknown_action"), (2019, 5, "ok"),
        (2019, 53, "ok"), (2020, 53, "week_exists"),
    ]
    cells = decisions.select("k", "year", "week").withColumn("y", F.lit(None).cast("long"))
    applied = quality.apply_decisions(cells, checked)
    assert rows(applied.filter("year = 2019 and week in (2, 3, 5, 53)"), "week", "resolved", "excluded") == [
        (2, 7, False), (3, None, False), (5, 0, False), (53, None, True)
    ]


def test_cell_compare_treats_null_as_equal_and_absence_as_difference(spark, rows):
    a = monthly(spark, [("a", 1, None), ("a", 2, 1), ("a", 3, 1)])
    b = monthly(spark, [("a", 1, None), ("a", 2, 2)])
    assert rows(quality.cell_compare(a, b), "m", "match") == [(1, True), (2, False), (3, False)]


@pytest.mark.parametrize("count,status,expected,error", [
    (0, None, "observed_zero", None), (3, "observed", "observed", None), (0, "observed", "observed_zero", "status_conflict"),
    (None, None, None, "missing_without_reason"), (None, "report_unavailable", "report_unavailable", None), (-1, None, None, "negative_count"),
])
def test_observation_status(spark, count, status, expected, error):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(count, status)], "y long, s string")
    found = df.select(*quality.observation_status(F.col("y"), F.col("s"), ["report_unavailable"])).first()
    assert tuple(found) == (expected, error)
