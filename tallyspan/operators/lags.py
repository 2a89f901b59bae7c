"""Calendar-true lags and what is built on them.

A lag is the value at the period index minus n, found by a RANGE frame on the index. A hole in the calendar gives null;
values never move up to fill it. One shuffle by key serves every lag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _at(n: int, key: str = "k", period: str = "m"):
    return Window.partitionBy(key).orderBy(period).rangeBetween(-n, -n)


def lag_value(value: Column, n: int) -> Column:
    return F.max(value).over(_at(n))


def calendar_lags(df: DataFrame, lags: int, value: str = "y") -> DataFrame:
    return df.select("*", *[lag_value(F.col(value), n).alias(f"lag{n}") for n in range(1, lags + 1)])


def seasonal_pairs(df: DataFrame, season: int) -> DataFrame:
    """Rows with a known value both now and one season ago."""
    return df.withColumn("previous", lag_value(F.col("y"), season)).filter(
        F.col("y").isNotNull() & F.col("previous").isNotNull()
    )


def differences(df: DataFrame, season: int = 12) -> DataFrame:
    """Seasonal difference, then the ordinary difference of it."""
    seasonal = df.withColumn("d_season", F.col("y") - lag_value(F.col("y"), season))
    return seasonal.withColumn("d_both", F.col("d_season") - lag_value(F.col("d_season"), 1))


def positional_lags(df: DataFrame, lags: int) -> DataFrame:
    """Lags over row order. They ignore holes in the calendar and are kept as a contrast to `calendar_lags`."""
    order = Window.partitionBy("k").orderBy("m")
    return df.select("*", *[F.lag("y", n).over(order).alias(f"row_lag{n}") for n in range(1, lags + 1)])


def decompose(df: DataFrame, season: int = 12, minimum: int = 24) -> DataFrame:
    """Additive decomposition: centred moving average, re-centred seasonal means, remainder.

    Both frames follow the calendar: where one lacks a position, at an end or in a hole, the average is null. Keys with too few points
    are left out.
    """
    by_key = Window.partitionBy("k")
    order = by_key.orderBy("m")
    half = season // 2
    early, late = order.rangeBetween(-half, half - 1), order.rangeBetween(-half + 1, half)
    full = (F.count("y").over(early) == 2 * half) & (F.count("y").over(late) == 2 * half)
    framed = df.withColumn("_n", F.count("*").over(by_key)).filter(F.col("_n") >= minimum).withColumn(
        "trend", F.when(full, (F.avg("y").over(early) + F.avg("y").over(late)) / 2)
    )
    by_phase = Window.partitionBy("k", "_phase")
    raw = framed.withColumn("_phase", F.col("m") % season).withColumn(
        "_mean", F.avg(F.col("y") - F.col("trend")).over(by_phase)
    )
    first_of_phase = F.when(F.row_number().over(by_phase.orderBy("m")) == 1, F.col("_mean"))
    return raw.withColumn("_first", first_of_phase).withColumn(
        "seasonal", F.col("_mean") - F.avg("_first").over(by_key)
    ).select(
        "k", "m", "y", "trend", "seasonal", (F.col("y") - F.col("trend") - F.col("seasonal")).alias("remainder")
    )


def autocorrelations(df: DataFrame, lags: list[int], value: str = "y") -> DataFrame:
    """Autocorrelation at each lag: lagged products around the overall mean over the total sum of squares."""
    by_key = Window.partitionBy("k")
    centred = df.filter(F.col(value).isNotNull()).withColumn("_c", F.col(value) - F.avg(value).over(by_key))
    products = [F.sum(F.col("_c") * F.col(f"_l{n}")).alias(f"_s{n}") for n in lags]
    sums = (
        centred.select("k", "m", "_c", *[lag_value(F.col("_c"), n).alias(f"_l{n}") for n in lags])
        .groupBy("k").agg(F.count("*").alias("n"), (F.max("m") - F.min("m") + 1).alias("span"),
                          F.sum(F.col("_c") * F.col("_c")).alias("_ss"), *products)
    )
    pairs = F.explode(F.array(*[F.struct(F.lit(n).cast("bigint").alias("lag"), F.col(f"_s{n}").alias("s")) for n in lags]))
    return sums.select("k", "n", "span", "_ss", pairs.alias("p")).select(
        "k", "n", "span", F.col("p.lag").alias("lag"),
        F.when(F.col("_ss") > 0, F.coalesce("p.s", F.lit(0.0)) / F.col("_ss")).alias("r"),
    )


def ljung_box(df: DataFrame, at: list[int], value: str = "y") -> DataFrame:
    """Portmanteau statistic at the given lags; null for series with gaps, without variance or too short."""
    r = autocorrelations(df, list(range(1, max(at) + 1)), value)
    n = F.col("n")
    term = n * (n + 2) * F.col("r") * F.col("r") / (n - F.col("lag"))
    sums = r.groupBy("k", "n", "span").agg(
        *[F.sum(F.when(F.col("lag") <= lag, term)).alias(f"q{lag}") for lag in at]
    )
    pairs = F.explode(F.array(*[F.struct(F.lit(lag).cast("bigint").alias("lag"), F.col(f"q{lag}").alias("q")) for lag in at]))
    return sums.select("k", "n", "span", pairs.alias("p")).select(
        "k", "n", F.col("p.lag").alias("lag"),
        F.when((n >= 2 * F.col("p.lag")) & (n == F.col("span")), F.col("p.q")).alias("q"),
    )


def lag_correlation(df: DataFrame, n: int) -> DataFrame:
    """Plain correlation of a series with itself n periods earlier."""
    return df.withColumn("_l", lag_value(F.col("y"), n)).groupBy("k").agg(
        F.corr(F.col("y").cast("double"), F.col("_l").cast("double")).alias("r"),
        F.count(F.when(F.col("_l").isNotNull() & F.col("y").isNotNull(), 1)).alias("pairs"),
    )


def unit_root_screen(df: DataFrame, minimum: int = 8) -> DataFrame:
    """t statistic of the slope of the difference on the previous level; null for gaps, constants and short series."""
    previous = lag_value(F.col("y"), 1)
    framed = df.filter(F.col("y").isNotNull()).withColumn("_x", previous.cast("double")).withColumn(
        "_d", F.when(F.col("_x").isNotNull(), F.col("y") - F.col("_x"))
    )
    sums = framed.groupBy("k").agg(
        F.count("*").alias("n"),
        (F.max("m") - F.min("m") + 1).alias("span"),
        (F.max("y") - F.min("y")).alias("width"),
        F.count("_d").alias("pairs"),
        F.regr_slope("_d", "_x").alias("slope"),
        F.regr_sxx("_d", "_x").alias("sxx"),
        F.regr_syy("_d", "_x").alias("syy"),
    )
    rss = F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx")
    error = F.sqrt(rss / (F.col("pairs") - 2) / F.col("sxx"))
    usable = (F.col("n") >= minimum) & (F.col("n") == F.col("span")) & (F.col("width") > 0)
    return sums.select("k", "n", F.when(usable & (rss > 0), F.col("slope") / error).alias("t_statistic"))


def zero_runs(df: DataFrame, length: int = 3) -> DataFrame:
    """Runs of consecutive observed zeros, reported where they reach the given length."""
    zeros = df.filter(F.col("y") == 0)
    island = F.col("m") - F.row_number().over(Window.partitionBy("k").orderBy("m"))
    place = F.row_number().over(Window.partitionBy("k", "_g").orderBy("m"))
    return zeros.withColumn("_g", island).withColumn("_p", place).filter(F.col("_p") == length).select("k", "m")
