"""Moments, invariants and other descriptors of masks (image, y, x, v) and closed polylines (poly, i, x, y)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.geometry import along, whole, dist2, segments
from gridloom.operators.raster import foreground


def moments(px: DataFrame, threshold: int = 127) -> DataFrame:
    """op H1: area, centre, central (mu) and scaled (eta) moments of the foreground, up to order three.

    Raw sums are one aggregate over whole numbers; central moments follow from them.
    """
    x, y = F.col("x").cast("long"), F.col("y").cast("long")

    def power(c: Column, k: int) -> Column:
        out = F.lit(1).cast("long")
        for _ in range(k):
            out = out * c
        return out

    orders = [(p, q) for p in range(4) for q in range(4 - p)]
    m = px.where(foreground(threshold)).groupBy("image").agg(*(F.sum(power(x, p) * power(y, q)).cast("double").alias(f"m{p}{q}") for p, q in orders))
    m = m.withColumn("cx", F.col("m10") / F.col("m00")).withColumn("cy", F.col("m01") / F.col("m00"))
    cx, cy, c = F.col("cx"), F.col("cy"), F.col
    mu = {
        "20": c("m20") - cx * c("m10"), "02": c("m02") - cy * c("m01"), "11": c("m11") - cx * c("m01"),
        "30": c("m30") - 3 * cx * c("m20") + 2 * cx * cx * c("m10"), "03": c("m03") - 3 * cy * c("m02") + 2 * cy * cy * c("m01"),
        "21": c("m21") - 2 * cx * c("m11") - cy * c("m20") + 2 * cx * cx * c("m01"), "12": c("m12") - 2 * cy * c("m11") - cx * c("m02") + 2 * cy * cy * c("m10"),
    }
    m = m.select("image", F.col("m00").alias("area"), "cx", "cy", *(v.alias(f"mu{k}") for k, v in mu.items()))
    return m.select("*", *((F.col(f"mu{k}") / F.pow(F.col("area"), F.lit(1 + (int(k[0]) + int(k[1])) / 2))).alias(f"eta{k}") for k in mu))


def hu(m: DataFrame) -> DataFrame:
    """op H2: adds hu1 to hu7 to moments()."""
    n = {k: F.col(f"eta{k}") for k in ("20", "02", "11", "30", "03", "21", "12")}
    a, b, p, q = n["30"] + n["12"], n["21"] + n["03"], n["30"] - 3 * n["12"], 3 * n["21"] - n["03"]
    d = n["20"] - n["02"]
    return m.select(
        "*", (n["20"] + n["02"]).alias("hu1"), (d * d + 4 * n["11"] * n["11"]).alias("hu2"), (p * p + q * q).alias("hu3"), (a * a + b * b).alias("hu4"),
        (p * a * (a * a - 3 * b * b) + q * b * (3 * a * a - b * b)).alias("hu5"), (d * (a * a - b * b) + 4 * n["11"] * a * b).alias("hu6"),
        (q * a * (a * a - 3 * b * b) - p * b * (3 * a * a - b * b)).alias("hu7"),
    )


def affine(m: DataFrame) -> DataFrame:
    """op H3: adds the four affine moment invariants of Flusser and Suk, af1 to af4, to moments()."""
    u = {k: F.col(f"mu{k}") for k in ("20", "02", "11", "30", "03", "21", "12")}
    a = F.col("area")
    i1 = (u["20"] * u["02"] - u["11"] ** 2) / a**4
    i2 = (u["30"] ** 2 * u["03"] ** 2 - 6 * u["30"] * u["21"] * u["12"] * u["03"] + 4 * u["30"] * u["12"] ** 3 + 4 * u["21"] ** 3 * u["03"] - 3 * u["21"] ** 2 * u["12"] ** 2) / a**10
    i3 = (u["20"] * (u["21"] * u["03"] - u["12"] ** 2) - u["11"] * (u["30"] * u["03"] - u["21"] * u["12"]) + u["02"] * (u["30"] * u["12"] - u["21"] ** 2)) / a**7
    i4 = (
        u["20"] ** 3 * u["03"] ** 2 - 6 * u["20"] ** 2 * u["11"] * u["12"] * u["03"] - 6 * u["20"] ** 2 * u["02"] * u["21"] * u["03"] + 9 * u["20"] ** 2 * u["02"] * u["12"] ** 2
        + 12 * u["20"] * u["11"] ** 2 * u["21"] * u["03"] + 6 * u["20"] * u["11"] * u["02"] * u["30"] * u["03"] - 18 * u["20"] * u["11"] * u["02"] * u["21"] * u["12"]
        - 8 * u["11"] ** 3 * u["30"] * u["03"] - 6 * u["20"] * u["02"] ** 2 * u["30"] * u["12"] + 9 * u["20"] * u["02"] ** 2 * u["21"] ** 2
        + 12 * u["11"] ** 2 * u["02"] * u["30"] * u["12"] - 6 * u["11"] * u["02"] ** 2 * u["30"] * u["21"] + u["02"] ** 3 * u["30"] ** 2
    ) / a**11
    return m.select("*", i1.alias("af1"), i2.alias("af2"), i3.alias("af3"), i4.alias("af4"))


def log_vector(columns: list[str]) -> Column:
    """op H4: log(1 + |value|) of some columns, as an array."""
    return F.array(*(F.log1p(F.abs(F.col(c))) for c in columns))


def fourier(points: DataFrame, n: int = 64, top: int = 16) -> DataFrame:
    """op H5: |F1..F_top| / |F1| of each polyline of n points (use resample() first), by a join with the twiddle factors."""
    mean = points.withColumn("_x", F.col("x") - F.avg("x").over(whole())).withColumn("_y", F.col("y") - F.avg("y").over(whole()))
    table = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(2 * math.pi * k / n).alias("w")) for k in range(1, top + 1)))
    rows = mean.select("poly", "i", "_x", "_y", F.explode(table).alias("t"))
    a = F.col("t.w") * F.col("i")
    f = rows.groupBy("poly", F.col("t.k").alias("k")).agg(F.sum(F.col("_x") * F.cos(a) + F.col("_y") * F.sin(a)).alias("re"), F.sum(F.col("_y") * F.cos(a) - F.col("_x") * F.sin(a)).alias("im"))
    f = f.withColumn("m", F.sqrt(F.col("re") ** 2 + F.col("im") ** 2))
    first = F.max(F.when(F.col("k") == 1, F.col("m"))).over(Window.partitionBy("poly"))
    return f.withColumn("fd", F.when(first > 1e-12, F.col("m") / first).otherwise(0.0)).select("poly", "k", "fd")


def turning(points: DataFrame, bins: int = 128) -> DataFrame:
    """op H7: the direction's total turn, from the first segment on, at the centres of bins of arc length."""
    s = segments(points).withColumn("_l", F.sqrt(dist2(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")))).where("_l > 0")
    s = s.withColumn("_a", F.atan2(F.col("ny") - F.col("y"), F.col("nx") - F.col("x")))
    d = F.col("_a") - F.lag("_a").over(along())
    turn = d - 2 * math.pi * F.floor((d + math.pi) / (2 * math.pi))
    upto = along().rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_d", F.coalesce(turn, F.lit(0.0))).withColumn("theta", F.sum("_d").over(upto)).withColumn("_end", F.sum("_l").over(upto)).withColumn("_total", F.sum("_l").over(whole()))
    step = F.col("_total") / bins
    first, last = F.ceil((F.col("_end") - F.col("_l")) / step - 0.5), F.ceil(F.col("_end") / step - 0.5) - 1
    s = s.withColumn("_p", F.greatest(F.lit(0), first)).withColumn("_q", F.least(F.lit(bins - 1), last)).where("_p <= _q")
    return s.select("poly", F.explode(F.sequence("_p", "_q").cast("array<int>")).alias("bin"), "theta")


def geometry_stats(stats: DataFrame) -> DataFrame:
    """op H9: aspect and compactness of rows with w, h, area, perimeter; 0 where a side is 0."""
    return stats.withColumn("aspect", F.when(F.col("h") > 0, F.col("w") / F.col("h")).otherwise(0.0)).withColumn("compactness", F.when(F.col("perimeter") > 0, 4 * math.pi * F.col("area") / F.col("perimeter") ** 2).otherwise(0.0))


def lut_bins(bins: int = 8) -> tuple[Column, Column]:
    """op H10: bins of log aspect within 1/4..4, and of compactness within 0..1."""
    a = F.floor((F.log(F.greatest(F.col("aspect"), F.lit(1e-6))) / math.log(4.0) + 1) / 2 * bins)
    c = F.floor(F.col("compactness") * bins)
    return tuple(F.greatest(F.lit(0), F.least(F.lit(bins - 1), x)).cast("int") for x in (a, c))


def lut(stats: DataFrame, bins: int = 8) -> DataFrame:
    """op H10: the table of bins, each with the label inserted last (largest seq)."""
    a, c = lut_bins(bins)
    return stats.groupBy(a.alias("abin"), c.alias("cbin")).agg(F.max_by("label", "seq").alias("label"))


def lut_lookup(queries: DataFrame, table: DataFrame, bins: int = 8) -> DataFrame:
    """op H10: adds the table's label to rows with aspect and compactness; null for an empty bin."""
    a, c = lut_bins(bins)
    return queries.withColumn("abin", a).withColumn("cbin", c).join(table, ["abin", "cbin"], "left")
