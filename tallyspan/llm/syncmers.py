"""Document fingerprints from closed syncmers.

A text is a sequence of words. A run of K words is an anchor when the least of its inner runs of S words, by hash, is the first or
the last of them. Whether a run is chosen depends on its own words alone, so an edit elsewhere leaves it chosen. A fingerprint holds
every anchor with its place, in the order of the text, so it grows with the text and a passage keeps its anchors in any text.

Anchors are matched by position in links: two anchors that follow each other, and the number of words between them. A passage that two texts
share gives both the same links wherever it stands, and an inserted or changed word breaks only the links around it. Likeness is the share of
links that two texts have in common; `passages` chains common links into stretches of words.

Column functions only. Anchors and their places are arrays of one row, so a text is not exploded or shuffled word by word, except
by `passages` for the pairs that are asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspan.llm.common import SPACE_CLASS

K = 6
S = 2
INNER = K - S + 1
#: Rows of a stretch of neighbouring ids, about, and stretches at most; neighbours across stretches are found by their heads.
STRETCH = 2_000
STRETCHES = 1_024
_FINE = 32


def with_anchors(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Adds `name` = struct(hashes, places): all anchors in the order of the text, and the word at which each starts.

    A text with words but no anchor has one entry, the hash of all its words at place 0; a text without words, or null, has none. Each
    step is a column of its own, for a step that refers to another inside a lambda would otherwise be worked out anew for each element.
    """
    w, h, sm, at, ah = (f"__{name}_{x}" for x in ("words", "hashes", "inner", "at", "anchors"))
    n = F.size(h)
    rows = docs.withColumn(w, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), f"[{SPACE_CLASS}]+"), lambda x: x != ""))
    rows = rows.withColumn(h, F.transform(w, lambda x: F.xxhash64(x))).drop(w)
    rows = rows.withColumn(sm, F.transform(h, lambda x, i: F.xxhash64(F.get(h, i), F.get(h, i + 1))))

    def chosen(i: Column) -> Column:
        inner = [F.get(sm, i + j) for j in range(INNER)]
        return F.least(*inner) == F.least(inner[0], inner[-1])

    rows = rows.withColumn(at, F.when(n >= K, F.filter(F.sequence(F.lit(0), n - K), chosen)).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn(ah, F.transform(at, lambda i: F.xxhash64(*[F.get(sm, i + j) for j in range(0, INNER, S)])))
    whole = F.struct(F.array(F.xxhash64(h)).alias("hashes"), F.array(F.lit(0)).alias("places"))
    found = F.when((F.size(ah) == 0) & (n > 0), whole).otherwise(F.struct(F.col(ah).alias("hashes"), F.col(at).alias("places")))
    return rows.withColumn(name, found).drop(h, sm, at, ah)


def as_text(anchors: str) -> Column:
    """The fingerprint as text: the upper half of each hash, and its place."""
    half = lambda h: F.lpad(F.lower(F.hex(F.shiftrightunsigned(h, 32))), 8, "0")
    return F.concat_ws(" ", F.zip_with(f"{anchors}.hashes", f"{anchors}.places", lambda h, p: F.concat(half(h), F.lit(":"), p.cast("string"))))


def with_links(rows: DataFrame, anchors: str, name: str) -> DataFrame:
    """Adds `name`, the links of a fingerprint in the order of the text: one more than anchors, as its start and end are linked too."""
    h, p = f"__{name}_hashes", f"__{name}_places"
    rows = rows.withColumn(h, F.col(f"{anchors}.hashes")).withColumn(p, F.col(f"{anchors}.places"))

    def link(i: Column) -> Column:
        apart = F.get(p, i) - F.get(p, i - 1)
        return F.xxhash64(F.coalesce(F.get(h, i - 1), F.lit(-1)), F.coalesce(F.get(h, i), F.lit(-1)), F.coalesce(apart, F.lit(0)))

    return rows.withColumn(name, F.transform(F.sequence(F.lit(0), F.size(h)), link)).drop(h, p)


def likeness(a: str, b: str) -> Column:
    """Likeness of two columns of links, 0 to 1: of the different links of both texts, the share that both have. Two texts without words are alike."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def passages(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Stretches that pairs of documents share: rows (a, b, place_a, place_b, n_words) for rows (a, b) of `pairs`, ids of `docs` (doc_id, text).

    A stretch is a chain of common links whose places differ by one distance; it starts at the word `place_a` of a and `place_b` of b and covers
    n_words words, at least K + 1. Of a link that a text holds several times, the first occurrence meets the other text's first, the second its
    second, and so on, so nothing is multiplied. Repeated pairs count once; pairs with an unknown or null id give no row. Of documents
    with the same id the one whose text sorts first is taken; texts without two anchors give no row.
    """
    wanted = pairs.select("a", "b").distinct()
    ids = wanted.select(F.col("a").alias("doc_id")).unionByName(wanted.select(F.col("b").alias("doc_id"))).distinct()
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = with_links(with_anchors(texts, "text", "anchors"), "anchors", "links")
    inner = F.transform(F.filter(F.sequence(F.lit(0), F.size("links") - 1), lambda i: (i > 0) & (i < F.size("links") - 1)), lambda i: F.struct(
        F.get("links", i).alias("link"), F.get(F.col("anchors.places"), i - 1).alias("place"), F.get(F.col("anchors.places"), i).alias("until")))
    single = rows.select("doc_id", F.explode(inner).alias("x")).select("doc_id", "x.*")
    nth = F.row_number().over(Window.partitionBy("doc_id", "link").orderBy("place"))
    single = single.withColumn("nth", nth)
    left = wanted.join(single.select(F.col("doc_id").alias("a"), "link", "nth", F.col("place").alias("place_a"), "until"), "a")
    both = left.join(single.select(F.col("doc_id").alias("b"), "link", "nth", F.col("place").alias("place_b")), ["b", "link", "nth"])
    along = Window.partitionBy("a", "b", "shift").orderBy("place_a")
    both = both.withColumn("shift", F.col("place_b") - F.col("place_a"))
    both = both.withColumn("new", F.when(F.lag("until").over(along) == F.col("place_a"), 0).otherwise(1)).withColumn("run", F.sum("new").over(along))
    found = both.groupBy("a", "b", "shift", "run").agg(F.min("place_a").alias("place_a"), F.min("place_b").alias("place_b"), F.max("until").alias("until"))
    return found.select("a", "b", "place_a", "place_b", (F.col("until") + K - F.col("place_a")).alias("n_words"))


def _stretch(bounds: list[int]) -> Column:
    """Number of the stretch of a doc_id, from the largest ids down; rows without an id come last."""
    if not bounds:
        return F.when(F.col("doc_id").isNull(), 1).otherwise(0)
    fine, coarse = F.array(*map(F.lit, bounds)), F.array(*map(F.lit, bounds[_FINE - 1::_FINE] or [bounds[-1]]))
    whole = F.size(F.filter(coarse, lambda x: x <= F.col("doc_id"))) if len(bounds) >= _FINE else F.lit(0)
    below = whole * _FINE + F.size(F.filter(F.slice(fine, whole * _FINE + 1, F.lit(_FINE)), lambda x: x <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(len(bounds) - below)


def with_next(docs: DataFrame, *columns: str) -> DataFrame:
    """Adds next_<column> of the next document by falling doc_id; after the last comes the first.

    Rows without doc_id come after all others; equal ids are ordered by text, falling. Ids are cut into stretches at their quantiles, at most STRETCHES
    numbers that the driver holds; within a stretch a window looks ahead, and the last row of a stretch takes the head of the
    next. No task sees more than a stretch, and the window writes to disk what does not fit.
    """
    n = docs.count()
    many = max(1, min(STRETCHES, math.ceil(n / STRETCH)))
    named = docs.filter("doc_id is not null")
    quantiles = [i / many for i in range(1, many)]
    bounds = named.agg(F.percentile_approx("doc_id", quantiles, 100 * many)).first()[0] if quantiles and not named.isEmpty() else []
    rows = docs.withColumn("__stretch", _stretch(sorted(set(bounds or []))))
    heads = [r[0] for r in rows.filter("doc_id is not null").groupBy("__stretch").agg(F.max("doc_id")).select("max(doc_id)").collect()]
    first = rows.filter(F.col("doc_id").isin(heads) | F.col("doc_id").isNull()).groupBy("__stretch").agg(F.max_by(F.struct(*columns), F.struct("text")).alias("__head"))
    order = Window.orderBy("__stretch")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = first.select("__stretch", F.coalesce(F.lead("__head").over(order), F.first("__head").over(whole)).alias("__head"))
    falling = Window.partitionBy("__stretch").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last())
    ahead = rows.select("*", F.lead(F.struct(*columns)).over(falling).alias("__ahead")).join(after, "__stretch", "left")
    found = ahead.withColumn("__found", F.coalesce("__ahead", "__head"))
    return found.select(*docs.columns, *[F.col(f"__found.{c}").alias(f"next_{c}") for c in columns])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, fingerprint) for rows (doc_id, text), one for each."""
    return with_anchors(docs.select("doc_id", "text"), "text", "anchors").select("doc_id", as_text("anchors").alias("fingerprint"))


def edit_trial(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text whose last half is replaced by the start of the next document, and how alike they are.

    Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one per row of `docs`. Null texts count as empty.
    A single document is its own next. Repeated rows follow each other. Other columns are ignored; an empty table gives an empty table.
    """
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", "text", "next_text", n.cast("bigint").alias("n_chars"), edited.alias("edited"))
    # Anchors are found after the shuffle, which moves nothing but texts; each text gives way to its links.
    rows = with_links(with_anchors(rows, "next_text", "after"), "after", "after_links").drop("next_text", "after")
    rows = with_links(with_anchors(rows, "text", "own"), "own", "own_links").drop("text")
    rows = rows.withColumn("near_next", likeness("own_links", "after_links")).drop("after_links").withColumn("fingerprint", as_text("own")).drop("own")
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    rows = with_links(with_anchors(rows, "edited", "changed"), "changed", "changed_links").drop("edited")
    rows = rows.withColumn("near_edited", likeness("own_links", "changed_links"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", as_text("changed").alias("edited_fingerprint"), "near_edited", "near_next")
