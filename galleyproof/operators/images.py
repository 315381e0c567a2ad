"""Matching of images by perceptual hashes (64 bits) and colour hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The largest distances at which an image is the same, and the same in colour.
HASH_LIMIT, COLOUR_LIMIT = 18, 15


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def nearest_sources(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target (doc_id, idx, phash, chash) with the nearest source of its document; ties go to the first.

    Images of one document only are compared, so a pair list stays within a document.
    """
    s = sources.select("doc_id", F.col("idx").alias("source_idx"), F.col("phash").alias("sp"), F.col("chash").alias("sc"))
    both = targets.join(s, "doc_id").withColumn("distance", hamming(F.col("phash"), F.col("sp"))).withColumn("colour_distance", hamming(F.col("chash"), F.col("sc")))
    best = F.min(F.struct("distance", "source_idx", "colour_distance"))
    return both.groupBy("doc_id", "idx").agg(best.alias("b")).select("doc_id", "idx", "b.source_idx", "b.distance", "b.colour_distance")


def verdict(distance: Column, colour: Column) -> Column:
    return F.when((distance <= HASH_LIMIT) & (colour <= COLOUR_LIMIT), "ok").when(distance <= HASH_LIMIT, "Image Possibly Wrong").otherwise("Image Doesn't Match Source")


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance / 64.0)


def missing(sources: DataFrame, matched: DataFrame) -> DataFrame:
    """Sources that no target has as its match."""
    used = matched.where(F.col("distance") <= HASH_LIMIT).select("doc_id", F.col("source_idx").alias("idx"))
    return sources.select("doc_id", "idx").join(used, ["doc_id", "idx"], "left_anti")


def extra(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets beyond the number of sources."""
    n = sources.groupBy("doc_id").agg(F.count("*").alias("n"))
    return targets.join(n, "doc_id").where(F.col("position") >= F.col("n")).select("doc_id", "idx")


def order_issues(matched: DataFrame) -> DataFrame:
    """(doc_id, first_bad): documents whose matches are all different but not in the sources' order."""
    ok = matched.where(F.col("distance") <= HASH_LIMIT)
    ranked = ok.withColumn("a", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))).withColumn("b", F.row_number().over(Window.partitionBy("doc_id").orderBy("source_idx")))
    out = ranked.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("source_idx").alias("d"), F.min(F.when(F.col("a") != F.col("b"), F.col("a"))).cast("long").alias("first_bad"))
    return out.where((F.col("n") >= 2) & (F.col("n") == F.col("d")) & F.col("first_bad").isNotNull()).select("doc_id", "first_bad")


#: Tolerances of declared sizes and of ratios, and the largest side of a spacer.
SIZE_TOLERANCE, RATIO_TOLERANCE, SPACER = 0.08, 0.03, 8
#: Categories that are computed but, unless asked for, not reported.
DIMENSION_CATEGORIES = ("Image Display Size Mismatch", "Image Aspect Ratio Mismatch", "Image File Aspect Ratio Mismatch")


def is_spacer(width: Column, height: Column) -> Column:
    return F.coalesce((width <= SPACER) & (height <= SPACER), F.lit(False))


def content_images(images: DataFrame, ignored_names: tuple[str, ...] = ()) -> DataFrame:
    """``images`` (doc_id, idx, name, width, height, ...) without spacers and ignored names, numbered anew (``position``)."""
    name = F.lower(F.element_at(F.split(F.coalesce("name", F.lit("")), "/"), -1))
    kept = images.where(~is_spacer(F.col("width"), F.col("height")))
    if ignored_names:
        kept = kept.where(~name.isin(*ignored_names))
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")).cast("long") - 1)


def broken(targets: DataFrame) -> DataFrame:
    """Targets whose picture could not be read: they have no hash."""
    return targets.where(F.col("phash").isNull()).select("doc_id", "idx")


def image_issues(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, idx, category) of all image rules; ``idx`` is the target's, or the source's for Missing Image.

    Both sides: doc_id, idx, phash, chash; targets without a hash are broken. A document
    without sources has broken images only, as there is nothing to compare with.
    """
    sources, read = sources.where(F.col("phash").isNotNull()), targets.where(F.col("phash").isNotNull())
    numbered = read.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")).cast("long") - 1)
    matched = nearest_sources(sources, read)
    judged = matched.withColumn("category", verdict(F.col("distance"), F.col("colour_distance"))).where("category <> 'ok'")
    ordered = matched.where(F.col("distance") <= HASH_LIMIT).withColumn("a", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")).cast("long"))
    moved = order_issues(matched).join(ordered, "doc_id").where("a = first_bad")
    named = lambda rows, category: rows.select("doc_id", "idx", F.lit(category).alias("category"))
    out = judged.select("doc_id", "idx", "category")
    for rows, category in ((broken(targets), "Broken Image"), (missing(sources, matched), "Missing Image"), (moved, "Image Order Mismatch"), (extra(sources, numbered), "Extra Image")):
        out = out.unionByName(named(rows, category))
    return out


def ratio_error(actual: Column, expected: Column) -> Column:
    """Relative difference; 0 where either is missing or zero."""
    return F.when(F.coalesce(actual, F.lit(0.0)) * F.coalesce(expected, F.lit(0.0)) == 0, 0.0).otherwise(F.abs(actual - expected) / expected)


def dimension_issues(placed: DataFrame) -> DataFrame:
    """(doc_id, idx, category) of ``placed``: declared_w, declared_h, expected_w, expected_h, file_w, file_h.

    Nothing declared, or no expected height: nothing to check. These categories are
    advisory; ``DIMENSION_CATEGORIES`` lists them for filters.
    """
    dw, dh, ew, eh = (F.col(c).cast("double") for c in ("declared_w", "declared_h", "expected_w", "expected_h"))
    rows = placed.where(F.coalesce(dw, dh).isNotNull() & (F.coalesce(eh, F.lit(0.0)) != 0))
    ratio = ew / eh
    size = (ratio_error(dw, ew) > SIZE_TOLERANCE) | (ratio_error(dh, eh) > SIZE_TOLERANCE)
    shape = F.when(dw.isNotNull() & (dh != 0), ratio_error(F.try_divide(dw, dh), ratio) > RATIO_TOLERANCE).otherwise(False)
    file = F.when(F.coalesce("file_h", F.lit(0)) != 0, ratio_error(F.try_divide(F.col("file_w"), F.col("file_h")), ratio) > RATIO_TOLERANCE).otherwise(False)
    hits = F.array(*(F.when(c, n) for c, n in zip((size, shape, file), DIMENSION_CATEGORIES, strict=True)))
    return rows.select("doc_id", "idx", F.explode(F.array_compact(hits)).alias("category"))


def repeated(placements: DataFrame, pages: DataFrame) -> DataFrame:
    """``placements`` (doc_id, idx, page, group) whose group is on at least half of the document's pages, and on two: marks, not content.

    ``pages``: doc_id, n_pages.
    """
    n = placements.groupBy("doc_id", "group").agg(F.countDistinct("page").alias("on_pages")).join(pages, "doc_id")
    marks = n.where(F.col("on_pages") >= F.greatest(F.lit(2), F.ceil(F.col("n_pages") / 2))).select("doc_id", "group")
    return placements.join(marks, ["doc_id", "group"], "left_semi")
