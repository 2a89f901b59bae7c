import pytest
from pyspark.sql import functions as F

from tallyspan.operators import intake
from tallyspan.session import new_folder
from tallyspan.sources import readers, writers


def sheet(spark, lines, source="s"):
    data = [(source, i, j, v) for i, line in enumerate(lines) for j, v in enumerate(line)]
    return spark.createDataFrame(data, "source string, row_pos long, col_pos long, value string")


def test_header_row_skips_titles_and_prefers_the_earliest(spark, rows):
    cells = sheet(spark, [["Report", ""], ["Disease", "Year"], ["x", "2001"], ["Disease", "Year"]])
    assert rows(intake.header_rows(cells)) == [("s", 1, 2)]


def test_headers_are_named_and_numbered(spark, rows):
    cells = sheet(spark, [["Cases", "", "Cases", "Week"]])
    found = intake.header_cells(cells, intake.header_rows(cells))
    assert rows(found, "col_pos", "header") == [(0, "Cases"), (1, "Unnamed column 2"), (2, "Cases (column 3)"), (3, "Week")]
    states = {r.role: r.state for r in intake.role_resolution(found).collect()}
    assert states == {"disease": "unresolved", "year": "unresolved", "morbidity_week": "mapped", "case_count": "ambiguous"}


def test_layouts(spark, rows):
    def layout(header):
        cells = sheet(spark, [header, ["1"] * len(header)])
        headers = intake.header_cells(cells, intake.header_rows(cells))
        return intake.layout_class(intake.role_resolution(headers), headers).first().layout

    assert layout(["Morbidity Week", "2019", "2020"]) == "week_by_year"
    assert layout(["Disease", "Year", "Week", "Cases"]) == "rows"
    assert layout(["Something", "Else"]) == "rejected"


def test_column_roles_ignore_totals_and_blanks(spark, rows):
    cells = sheet(spark, [["Disease", "a", "b"], ["x", "2001", "53"], ["Total", "", "0"], ["y", "2002", "7"]])
    found = intake.column_roles(cells, intake.header_rows(cells))
    assert rows(found, "col_pos", "as_label", "as_year", "as_week", "as_count") == [
        (0, True, False, False, False), (1, False, True, False, True), (2, False, False, False, True)
    ]


@pytest.mark.parametrize("raw,convention,expected", [
    ("03/04/2020", "day-first", "2020-04-03"), ("03/04/2020", "month-first", "2020-03-04"), ("2020-04-03", "month-first", "2020-04-03"),
    ("2020/4/3 10:00", "day-first", "2020-04-03"), ("43831", "day-first", "2020-01-01"), ("31/31/2020", "day-first", None), ("soon", "day-first", None),
])
def test_dates(spark, raw, convention, expected):
    df = spark.createDataFrame([(raw,)], "x string")
    found = df.select(intake.parse_date(F.col("x"), convention).cast("string")).first()[0]
    assert found == expected


def test_names_and_required_columns(spark):
    assert intake.canonical_names([" ICD-10 Block", "Month Number", "month"], {"icd_10_block": "block", "month_number": "month"}) == ["block", "month_number", "month"]
    good = spark.createDataFrame([("a", 1)], "k string, y long")
    rows, skipped = intake.union_tables({"one": good, "two": good, "totals": spark.range(1)}, ["k", "y"])
    assert rows.count() == 2 and skipped == ["totals"]
    with pytest.raises(ValueError, match="lacks y"):
        intake.union_tables({"one": good, "broken": spark.createDataFrame([("a", 1)], "k string, month long")}, ["k", "y"])
    with pytest.raises(ValueError, match="no table"):
        intake.union_tables({"totals": spark.range(1)}, ["k", "y"])


def test_unpivot_keeps_blanks_and_ignores_totals(spark, rows):
    wide = spark.createDataFrame([("a", "1", "3", None, "3"), ("a", "Grand Total", "3", None, "3")], "k string, week string, `2019` string, `2020` string, Total string")
    kept = intake.excluded_rows(wide, ["2019", "2020"], "week").filter("reason is null")
    assert rows(intake.unpivot_years(kept, ["k", "week"]), "week", "year", "value") == [("1", 2019, "3"), ("1", 2020, None)]


def test_week_53_rules(spark, rows):
    df = spark.createDataFrame([("a", 2019, 53, 0), ("a", 2019, 53, 4), ("a", 2020, 53, 0), ("a", 2019, 53, None)], "k string, year long, week long, y long")
    assert rows(intake.week53_rules(df), "year", "y", "outcome") == [
        (2019, 0, "dropped_zero"), (2019, 4, "conflict"), (2019, None, "kept"), (2020, 0, "kept")
    ]


def test_matrix_carries_the_year_over_and_checks_totals(spark, rows):
    months = [f"c{i}" for i in range(1, 13)]
    schema = "page long, row_pos long, label string, " + ", ".join(f"{m} string" for m in months) + ", total string"
    blank = [None] * 12
    data = [
        (1, 1, "2019", *blank, None),
        (1, 5, "Dengue (A90-A91)\nMeasles", *["1\n1,000"] * 12, "12\n12,001"),
        (1, 6, "Broken\nLine", *["1"] * 12, "12"),
    ]
    found = intake.expand_matrix(spark.createDataFrame(data, schema))
    assert found.count() == 24
    assert rows(found.filter("month = 1"), "label", "year", "y") == [("Dengue", 2019, 1.0), ("Measles", 2019, 1000.0)]
    assert rows(intake.printed_total_check(found), "label", "printed", "summed") == [("Measles", 12001.0, 12000.0)]


def test_rollups(spark, rows):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, None), ("b", 1, 2), ("b", 1, None)], "k string, m long, y long")
    assert rows(intake.monthly_rollup(df), "k", "y") == [("a", None), ("b", 2)]
    assert rows(intake.voiding_rollup(df, F.col("m")), "k", "y") == [("a", None), ("b", None)]


def test_source_names(spark, rows):
    names = spark.createDataFrame([("Notes 1",), ("Sheet 3",), ("Dengue",), ("notebook",), ("READ ME",)], "name string")
    assert rows(intake.source_name_class(names), "name", "default_included", "label_hint") == [
        ("Dengue", True, "Dengue"), ("Notes 1", False, None), ("READ ME", False, None), ("Sheet 3", True, None), ("notebook", True, "notebook")
    ]


def test_csv_round_trip_keeps_blank_apart_from_zero(spark, rows):
    path = new_folder(spark, "t-csv")
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, None)], "k string, m long, y long")
    writers.export_csv(df, path)
    assert rows(readers.read_monthly_csv(spark, path, ["k", "m", "y"])) == [("a", 1, 0), ("a", 2, None)]
    with pytest.raises(ValueError, match="lacks z"):
        readers.read_monthly_csv(spark, path, ["k", "z"])


def test_raw_cells_are_kept_as_text(spark, rows):
    path = new_folder(spark, "t-text")
    spark.createDataFrame([("r1;NA;;1.0",)], "value string").coalesce(1).write.text(path)
    assert rows(readers.read_raw_cells(spark, path, ";"), "col_pos", "value") == [(0, "r1"), (1, "NA"), (2, ""), (3, "1.0")]


def test_snapshot_is_never_replaced(spark):
    root, mark = new_folder(spark, "t-snap"), "a" * 64
    writers.write_snapshot(spark.range(3), root, mark)
    with pytest.raises(Exception, match="(?i)already exists"):
        writers.write_snapshot(spark.range(3), root, mark)
    with pytest.raises(ValueError):
        writers.write_snapshot(spark.range(3), root, "not a signature")
