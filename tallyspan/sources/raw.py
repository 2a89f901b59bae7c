"""Raw, all-text rows and sheet cells derived from the orders, the input of the intake checks.

The text carries the usual defects of hand-kept tables: mixed spellings, month names, decimals, blanks, words where
numbers belong, out-of-range values. Which row has which defect follows from its order key, so the tables grow and
shrink with the orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyspan.functions.calendar import declared_year
from tallyspan.functions.text import MONTH_NAMES
from tallyspan.sources.tables import table

RAW_COLUMNS = (
    "year_text", "month_text", "code_text", "label_text", "count_text", "status_text", "date_text", "reporting_status",
    "population", "location",
)


def _every(n: int) -> Column:
    return F.col("o_orderkey") % n == 0


ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    return raw_rows(table(spark, folder, "orders", *ORDER_COLUMNS))


def raw_rows(orders: DataFrame) -> DataFrame:
    """One text row per order, batch or stream: source sheet, source row and ten text columns."""
    year, month, day = F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    names = F.array(*[F.lit(n.capitalize()) for n in MONTH_NAMES])
    name = F.element_at(names, month)
    digit = F.substring("o_orderpriority", 1, 1)
    word = F.substring("o_orderpriority", 3, 20)
    count = F.floor(F.col("o_totalprice") / 1000).cast("string")
    return orders.select(
        F.concat(F.lit("sheet "), F.col("o_custkey").cast("string")).alias("source"),
        F.col("o_orderkey").alias("source_row"),
        F.when(_every(17), "x").when(_every(19), F.concat(year.cast("string"), F.lit(".5"))).when(_every(23), F.lit(None))
        .when(_every(29), "3").when(_every(5), F.concat(year.cast("string"), F.lit(".0"))).otherwise(year.cast("string")).alias("year_text"),
        F.when(_every(37), "Smarch").when(_every(41), "13").when(_every(3), F.concat(F.lit(" "), F.upper(name)))
        .when(_every(2), F.lower(F.substring(name, 1, 3))).otherwise(month.cast("string")).alias("month_text"),
        F.when(_every(43), "Z9").when(_every(47), F.concat(F.lit("B0"), digit, F.lit("-A00")))
        .when(_every(2), F.concat(F.lit(" a0"), digit, F.lit(" – a0"), digit, F.lit(" ")))
        .otherwise(F.concat(F.lit("A0"), digit, F.lit("-A0"), digit)).alias("code_text"),
        F.when(_every(31), "  ").when(_every(7), F.concat(F.lit(" "), F.lower(word), F.lit("  "))).when(_every(4), F.initcap(word))
        .otherwise(word).alias("label_text"),
        F.when(_every(13), F.lit(None)).when(_every(53), "").when(_every(59), "n/a").when(_every(61), "-4").when(_every(67), "2.5")
        .when(_every(11), "0").otherwise(count).alias("count_text"),
        F.when(_every(26), "report_unavailable").when(_every(39), "outside_annual_top").when(_every(71), "observed").otherwise(F.lit(None)).alias("status_text"),
        F.when(_every(73), "soon").when(_every(6), F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(_every(5), F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30")).cast("string"))
        .otherwise(F.format_string("%d/%d/%04d", day, month, year)).alias("date_text"),
        F.when(_every(10), F.lit(None)).when(_every(9), "incomplete").when(_every(8), "COMPLETE").otherwise("complete").alias("reporting_status"),
        F.when(F.col("o_custkey") % 3 == 0, "5-19").when(_every(79), F.lit(None)).otherwise("all ages").alias("population"),
        F.when(F.col("o_custkey") % 4 == 0, F.lit(None)).when(F.col("o_orderstatus") == "P", "North").otherwise(F.lit("South")).alias("location"),
    )


# Header spellings by sheet style.
HEADER_STYLES = (
    ("Disease", "Year", "Morbidity Week", "Case Count", "Notes"),
    ("Illness", "Reporting Year", "Epi Week", "No. of Cases", "Remarks"),
    ("Diagnosis ", "Report Year", "Week No", "Total", "Total"),
    ("Label", "Period", "Wk", "", ""),
)


def sheet_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of one sheet per customer: up to three title rows, a header row, and one row per order.

    Row positions only order the rows. Titles take position 0 to 2, the header 3, and an order its key plus 10.
    """
    orders = table(spark, folder, "orders", *ORDER_COLUMNS)
    source = F.concat(F.lit("sheet "), F.col("o_custkey").cast("string"))
    week = (F.floor((F.dayofyear("o_orderdate") - 1) / 7) + 1).cast("bigint")
    body = orders.select(
        source.alias("source"), (F.col("o_orderkey") + 10).alias("row_pos"),
        F.array(
            F.substring("o_orderpriority", 3, 20), F.year("o_orderdate").cast("string"), week.cast("string"),
            F.when(F.col("o_orderkey") % 13 == 0, "").otherwise(F.floor(F.col("o_totalprice") / 1000).cast("string")),
            F.when(F.col("o_orderstatus") == "P", "late").otherwise(""),
        ).alias("cells"),
    )
    customers = table(spark, folder, "customer", "c_custkey").withColumnRenamed("c_custkey", "o_custkey")
    styles = F.array(*[F.array(*[F.lit(x) for x in style]) for style in HEADER_STYLES])
    header = customers.select(
        source.alias("source"), F.lit(3).cast("bigint").alias("row_pos"),
        F.element_at(styles, (F.col("o_custkey") % 4 + 1).cast("int")).alias("cells"),
    )
    titles = customers.select(
        source.alias("source"), F.explode(F.expr("sequence(0L, 2L)")).alias("row_pos"), "o_custkey"
    ).filter(F.col("row_pos") < F.col("o_custkey") % 3 + 1).select(
        "source", "row_pos", F.array(F.lit("Weekly report"), *[F.lit("")] * 4).alias("cells")
    )
    rows = body.unionByName(header).unionByName(titles)
    return rows.select("source", "row_pos", F.posexplode("cells").alias("col_pos", "value")).select(
        "source", "row_pos", F.col("col_pos").cast("bigint").alias("col_pos"), "value"
    )


def wide_weeks(spark: SparkSession, folder: str, years: list[int]) -> DataFrame:
    """Week-by-year sheet: one row per nation and week, one text column per year, a total column and a total row.

    A row of a year without a column is an error.
    """
    from tallyspan.sources.series import weekly_reports

    weekly = weekly_reports(spark, folder).withColumn("year", declared_year(F.col("year"), years))
    cells = [
        F.max(F.when(F.col("year") == y, F.coalesce(F.col("y").cast("string"), F.lit("")))).alias(str(y)) for y in years
    ]
    weeks = weekly.groupBy("k", F.col("week").cast("string").alias("week")).agg(*cells, F.sum("y").cast("string").alias("Total"))
    sums = [F.sum(F.when(F.col("year") == y, F.col("y"))).cast("string").alias(str(y)) for y in years]
    total = weekly.groupBy("k").agg(F.lit("Grand Total").alias("week"), *sums, F.sum("y").cast("string").alias("Total"))
    return weeks.unionByName(total)


def month_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Yearly report pages per brand pair: a year marker row, then one row whose cells hold two lines each.

    Every year of two neighbouring brands becomes a label cell, twelve month cells, blank where nothing was shipped, and a total cell. The
    printed total is one too high where the year and the first brand number add up to a multiple of five.
    """
    from tallyspan.sources.series import brand_monthly

    cells = brand_monthly(spark, folder).withColumn("num", F.regexp_extract("k", r"(\d+)$", 1).cast("bigint"))
    lines = cells.groupBy("k", "num", "year").agg(
        *[F.max(F.when(F.col("month") == i, F.col("y"))).alias(f"c{i}") for i in range(1, 13)], F.sum("y").alias("total")
    ).withColumn("page", F.floor(F.col("num") / 2).cast("bigint"))
    wrong = F.when((F.col("year") + F.col("num")) % 5 == 0, 1).otherwise(0)
    label = F.concat(F.col("k"), F.lit(" (A00-A09)"))

    def stack(column: Column) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct("num", column.alias("v"))))
        return F.array_join(F.transform(ordered, lambda s: s["v"]), "\n")

    data = lines.groupBy("page", "year").agg(
        stack(label).alias("label"), *[stack(F.coalesce(F.format_number(f"c{i}", 0), F.lit(""))).alias(f"c{i}") for i in range(1, 13)],
        stack((F.col("total") + wrong).cast("string")).alias("total"),
    )
    names = ["label", *[f"c{i}" for i in range(1, 13)], "total"]
    empty = [F.lit(None).cast("string").alias(n) for n in names[1:]]
    marker = F.struct((F.col("year") * 2).alias("row_pos"), F.col("year").cast("string").alias("label"), *empty)
    line = F.struct((F.col("year") * 2 + 1).alias("row_pos"), *[F.col(n) for n in names])
    return data.select("page", F.explode(F.array(marker, line)).alias("r")).select("page", "r.*")
