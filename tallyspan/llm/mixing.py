"""Mixing sources to target weights by weighted sampling without replacement.

A document's key is an exponential draw divided by its quality weight (Efraimidis and Spirakis); taking documents by rising key
until a budget is met is a weighted sample. Draws come from a digest of the document's id, so every run takes the same words.

A source's target is met with complete epochs over all its documents first and a fractional epoch, in key order, for the rest. Prefix
sums within a source run over ranges of keys: each source is cut into ranges of about RANGE documents, the ranges are added up, and
only within a range are documents sorted. No source is held by one task, however large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspan.llm.common import settle, space_words

#: Weights of the sources in order of their names, repeated; share of all words to take; limit as a multiple of a source's words.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
#: Documents in one range of keys, about; a constant of the method, the result does not depend on it.
RANGE = 5_000
DRAW_DIGITS = 12


def draw(*columns: Column) -> Column:
    """Uniform number above 0 and at most 1 from the columns' values."""
    digest = F.md5(F.concat_ws("/", *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns]))
    return (F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("double") + 1) / F.lit(float(16**DRAW_DIGITS))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Words to take from each source: rows (source, source_size, n, target) for rows (source, source_size, n).

    The n-th source by name (code points, null last) has the n-th weight, repeating. Targets above `limit` times a source's size stop
    there and what is over is shared out again by weight. The end of that is a common level: a target is the lesser of its limit and
    its weight times the level, and sources meet their limits in the order of limit / weight. One row per source is sorted here;
    a mixture's list of sources is a setting's size, and each row is three numbers.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(limit))
    ends = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    rows = rows.select(
        "*", F.sum("cap").over(ends.rowsBetween(Window.unboundedPreceding, -1)).alias("capped"),
        F.sum("weight").over(ends.rowsBetween(0, Window.unboundedFollowing)).alias("open_weight"),
        (F.sum("source_size").over(whole) * share).alias("budget"),
    )
    level = (F.col("budget") - F.coalesce("capped", F.lit(0.0))) / F.col("open_weight")
    # The level rises as long as sources are rightly held at their limits and falls after that, so the common one is the highest.
    rows = rows.withColumn("level", level).withColumn("common", F.max("level").over(whole))
    target = F.least("cap", F.col("weight") * F.col("common"))
    return rows.select("source", "source_size", "n", F.round(target, 6).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """How much of each document the mixture takes: rows (doc_id, source, size, source_size, target, epochs, taken), one per row of `docs`.

    `quality` has rows (doc_id, weight) with weights above 0; documents without one, and weights that are null or not above 0, count 1.
    Several weights of one doc_id are averaged. `taken` is the number of words, repeats counted: `epochs` whole passes and, of the
    document where the budget ends, its first words. Null texts have size 0 and take nothing. A null source is a source. Equal doc_ids
    share a draw and are ordered by the digest of their text; rows equal in that too get the same place, and the budget may then
    end up to one of them early or late. Other columns are ignored; an empty table gives an empty table.
    """
    rows = docs.select("doc_id", "source", space_words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("tie"))
    if quality is not None:
        usable = quality.filter("doc_id is not null").groupBy("doc_id").agg(F.avg("weight").alias("weight"))
        rows = rows.join(usable, "doc_id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(None).cast("double"))
    rows = settle(rows.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)), "sizes")
    by_source = settle(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, limit), "targets")

    plan = by_source.select(
        F.col("source").alias("_source"), "source_size", "target",
        F.ceil(F.col("n") / RANGE).alias("ranges"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint").alias("epochs"),
    ).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint"))
    key = -F.log(draw(F.col("doc_id"))) / F.col("weight")
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("key", key)
    placed = placed.withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * F.col("ranges")))

    per_range = placed.groupBy("source", "range").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.select(F.col("source").alias("_source"), F.col("range").alias("_range"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    sums = sums.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("inside")))
    return sums.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).alias("taken"))
