"""Measures of masks (image, y, x, v), point sets (poly, i, x, y) and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.geometry import dist2, hull_area, lengths, thin
from gridloom.operators.raster import KEY, boundary, dilate_mask, foreground


def ratio(a: Column, b: Column) -> Column:
    """0 where the divisor is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def mask_iou(a: DataFrame, b: DataFrame, threshold: int = 127) -> DataFrame:
    """op E1: inter, uni and iou of each image."""
    p, q = a.where(foreground(threshold)).select(*KEY, F.lit(1).alias("p")), b.where(foreground(threshold)).select(*KEY, F.lit(1).alias("q"))
    both = a.select("image").unionAll(b.select("image")).distinct().join(p.join(q, KEY, "full").groupBy("image").agg(F.sum(F.coalesce("p", F.lit(0)) * F.coalesce("q", F.lit(0))).alias("inter"), F.count("*").alias("uni")), "image", "left")
    i, u = F.coalesce("inter", F.lit(0)), F.coalesce("uni", F.lit(0))
    return both.select("image", i.alias("inter"), u.alias("uni"), ratio(i, u).alias("iou"))


def boundary_f1(a: DataFrame, b: DataFrame, tolerance: int = 2, threshold: int = 127) -> DataFrame:
    """op E2: precision, recall and f1 of a's boundary against b's, within a square of the tolerance."""

    def share(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        ring = boundary(x, threshold).select(*KEY)
        full = y.select(*KEY).join(boundary(y, threshold).select(*KEY, F.lit(255).alias("v")), KEY, "left").select(*KEY, F.coalesce("v", F.lit(0)).alias("v"))
        near = dilate_mask(full, 127, tolerance).where("v > 0").select(*KEY, F.lit(1).alias("hit"))
        s = ring.join(near, KEY, "left").groupBy("image").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("h"), F.count("*").alias("n"))
        return s.select("image", ratio(F.col("h"), F.col("n")).alias(name))

    images = a.select("image").distinct()
    out = images.join(share(a, b, "precision"), "image", "left").join(share(b, a, "recall"), "image", "left").fillna(0.0)
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def nearest(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each point of a with its distance to the nearest point of b in the same group: (grp, i, d). a, b: grp, i, x, y. All
    pairs of a group are compared, so large sets are thinned before (see thinned)."""
    pairs = a.join(b.select("grp", F.col("x").alias("qx"), F.col("y").alias("qy")), "grp")
    return pairs.groupBy("grp", "i").agg(F.sqrt(F.min(dist2(F.col("x"), F.col("y"), F.col("qx"), F.col("qy")))).alias("d"))


def mean_min_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """op E4, E7: from a to b."""
    return nearest(a, b).groupBy("grp").agg(F.avg("d").alias("mean_min"))


def thinned(points: DataFrame, most: int) -> DataFrame:
    """op G18 for groups of points (grp, i, x, y)."""
    return thin(points.withColumnRenamed("grp", "poly"), most).withColumnRenamed("poly", "grp")


def hausdorff_and_chamfer(a: DataFrame, b: DataFrame, most: int = 400) -> DataFrame:
    """op E5, E6: the larger of the two largest nearest distances, and the mean of the two mean ones, over sets thinned to
    `most` points."""
    a, b = thinned(a, most), thinned(b, most)
    there = nearest(a, b).groupBy("grp").agg(F.max("d").alias("m1"), F.avg("d").alias("a1"))
    back = nearest(b, a).groupBy("grp").agg(F.max("d").alias("m2"), F.avg("d").alias("a2"))
    return there.join(back, "grp").select("grp", F.greatest("m1", "m2").alias("hausdorff"), ((F.col("a1") + F.col("a2")) / 2).alias("chamfer"))


def rmse(a: DataFrame, b: DataFrame) -> DataFrame:
    """op E10: root of the mean squared nearest distance from a to b."""
    return nearest(a, b).groupBy("grp").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"))


def tightness(hull_area: Column, mask_area: Column) -> Column:
    """op E3."""
    return ratio(hull_area, mask_area)


def evaluate_mask(a: DataFrame, b: DataFrame, tolerance: int = 2, threshold: int = 127) -> DataFrame:
    """op E8: iou, boundary f1, tightness of a (hull area over area) and a million pixels' part of a's area."""
    mask = a.where(foreground(threshold))
    size = mask.groupBy("image").agg(F.count("*").alias("area"))
    # the hull of a row's ends is the hull of all its pixels
    ends = mask.groupBy("image", "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    points = ends.select("image", F.explode(F.array(F.col("lo").cast("double"), F.col("hi").cast("double"))).alias("x"), F.col("y").cast("double").alias("y"))
    tight = hull_area(points, "image").join(size, "image").select("image", tightness(F.col("hull_area"), F.col("area")).alias("tightness"), (F.col("area") / 1e6).alias("megapixels"))
    out = mask_iou(a, b, threshold).select("image", "iou").join(boundary_f1(a, b, tolerance, threshold).select("image", "f1"), "image")
    return out.join(tight, "image", "left").fillna(0.0, ["tightness", "megapixels"])


def evaluate_polyline(a: DataFrame, b: DataFrame, most: int = 400) -> DataFrame:
    """op E8 for contours (poly, i, x, y): hausdorff, chamfer and rmse from a to b, and both closed lengths."""
    p, q = (x.select(F.col("poly").alias("grp"), "i", "x", "y") for x in (a, b))
    out = hausdorff_and_chamfer(p, q, most).join(rmse(thinned(p, most), thinned(q, most)), "grp").withColumnRenamed("grp", "poly")
    return out.join(lengths(a), "poly").join(lengths(b).withColumnRenamed("length", "other_length"), "poly")


def accuracy(rows: DataFrame, passed: Column, *by: str) -> DataFrame:
    """op E11: passed, total and accuracy."""
    return rows.groupBy(*by).agg(F.sum(passed.cast("long")).alias("passed"), F.count("*").alias("total")).withColumn("accuracy", ratio(F.col("passed"), F.col("total")))


def token_error_rate(reference: Column, found: Column) -> Column:
    """op E12: edit distance of two arrays of tokens over the reference's length. Each token becomes one character, by its
    place among both arrays' tokens."""
    known = F.array_distinct(F.concat(reference, found))

    def letters(tokens: Column) -> Column:
        code = F.transform(tokens, lambda t: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, t) + 0x4E00), 4, "0")), "UTF-16BE"))
        return F.array_join(code, "")

    n = F.size(reference)
    return F.when(n > 0, F.levenshtein(letters(found), letters(reference)) / n).otherwise(0.0)


def hit_score(expected: Column, found: Column) -> Column:
    """op E12: share of the expected keys that are found."""
    return F.when(F.size(expected) > 0, F.size(F.array_intersect(expected, found)) / F.size(expected)).otherwise(0.0)
