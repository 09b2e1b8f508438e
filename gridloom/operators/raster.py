"""Pixel projections and neighbourhood operators on long rasters (image, y, x, v).

Stencils of radius 1 and box filters are separable windows along rows, then columns, so a pixel is one row throughout;
only kernels that aren't separable multiply rows. Each window is bounded by a row or column of one image.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_image() -> WindowSpec:
    return Window.partitionBy("image")


def along_row() -> WindowSpec:
    return Window.partitionBy("image", "y").orderBy("x")


def along_column() -> WindowSpec:
    return Window.partitionBy("image", "x").orderBy("y")


KEY = ["image", "y", "x"]


# ---- projections


def luma(r: Column, g: Column, b: Column) -> Column:
    """op P1: 0.299 r + 0.587 g + 0.114 b of whole numbers, cut to a whole number, in whole-number arithmetic."""
    return F.floor((299 * r + 587 * g + 114 * b) / 1000).cast("int")


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """op P2: CIE L*a*b* (D65) of sRGB in 0..255."""

    def linear(c: Column) -> Column:
        c = c / 255.0
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    def f(t: Column) -> Column:
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)

    r, g, b = linear(r), linear(g), linear(b)
    x = f((0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047)
    y = f(0.2126729 * r + 0.7151522 * g + 0.0721750 * b)
    z = f((0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883)
    return 116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)


def delta_e2(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """op P3: squared CIE76 difference."""
    return sum(((p - q) * (p - q) for p, q in zip(a, b, strict=True)), F.lit(0.0))


def foreground(threshold: int = 127, v: str = "v") -> Column:
    """op P5."""
    return F.col(v) > threshold


def below_iso(iso: float, v: str = "v") -> Column:
    """op P6: 255 where a field is at most iso."""
    return F.when(F.col(v) <= iso, 255).otherwise(0)


def dimensions(px: DataFrame) -> DataFrame:
    return px.groupBy("image").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def sample_bilinear(field: DataFrame, points: DataFrame) -> DataFrame:
    """op P7: adds value to points (image, px, py), between the four pixels around each, clamped to the image."""
    at = points.join(dimensions(field), "image").withColumn("_cx", F.greatest(F.lit(0.0), F.least(F.col("px"), F.col("w") - 1.0))).withColumn("_cy", F.greatest(F.lit(0.0), F.least(F.col("py"), F.col("h") - 1.0)))
    at = at.withColumn("_x0", F.floor("_cx").cast("int")).withColumn("_y0", F.floor("_cy").cast("int"))
    fx, fy = F.col("_cx") - F.col("_x0"), F.col("_cy") - F.col("_y0")
    corners = F.array(*(F.struct(F.least(F.col("_x0") + dx, F.col("w") - 1).alias("x"), F.least(F.col("_y0") + dy, F.col("h") - 1).alias("y"), ((fx if dx else 1 - fx) * (fy if dy else 1 - fy)).alias("k")) for dy in (0, 1) for dx in (0, 1)))
    rows = at.select("image", "px", "py", F.explode(corners).alias("c")).select("image", "px", "py", "c.*")
    return rows.join(field.select(*KEY, "v"), KEY).groupBy("image", "px", "py").agg(F.sum(F.col("k") * F.col("v")).alias("value"))


def downscale(px: DataFrame, side: int) -> DataFrame:
    """op P8: nearest neighbour, to a largest side of so many pixels; smaller images stay."""
    d = dimensions(px).withColumn("m", F.greatest("w", "h"))
    d = d.withColumn("nw", F.when(F.col("m") > side, F.greatest(F.lit(1), F.floor(F.col("w") * side / F.col("m")))).otherwise(F.col("w")).cast("int"))
    d = d.withColumn("nh", F.when(F.col("m") > side, F.greatest(F.lit(1), F.floor(F.col("h") * side / F.col("m")))).otherwise(F.col("h")).cast("int"))
    grid = d.withColumn("nx", F.explode(F.sequence(F.lit(0), F.col("nw") - 1))).withColumn("ny", F.explode(F.sequence(F.lit(0), F.col("nh") - 1)))
    grid = grid.select("image", "nx", "ny", F.expr("cast(nx * w div nw as int)").alias("x"), F.expr("cast(ny * h div nh as int)").alias("y"))
    return grid.join(px, KEY).select("image", F.col("ny").alias("y"), F.col("nx").alias("x"), "v")


def rotate90(px: DataFrame) -> DataFrame:
    """op P9: (x, y) to (h - 1 - y, x)."""
    return px.join(dimensions(px), "image").select("image", F.col("x").alias("y"), (F.col("h") - 1 - F.col("y")).alias("x"), "v")


def crop(px: DataFrame, threshold: int = 127, margin: float = 0.12, least: int = 16) -> DataFrame:
    """op P10: the box of the foreground with a margin, moved to the origin; ox, oy say from where."""
    box = mask_bbox(px, threshold).join(dimensions(px).withColumnRenamed("w", "iw").withColumnRenamed("h", "ih"), "image")
    m = F.greatest(F.lit(least), F.floor(margin * F.greatest("w", "h"))).cast("int")
    box = box.select("image", F.greatest(F.lit(0), F.col("bx") - m).alias("ox"), F.greatest(F.lit(0), F.col("by") - m).alias("oy"), F.least(F.col("iw") - 1, F.col("bx") + F.col("w") - 1 + m).alias("ex"), F.least(F.col("ih") - 1, F.col("by") + F.col("h") - 1 + m).alias("ey"))
    inside = px.join(box, "image").where("x between ox and ex and y between oy and ey")
    return inside.select("image", (F.col("y") - F.col("oy")).alias("y"), (F.col("x") - F.col("ox")).alias("x"), "v", "ox", "oy")


def uncrop(part: DataFrame, whole: DataFrame) -> DataFrame:
    """op P10: a crop() put back over zeros of the whole's size."""
    back = part.select("image", (F.col("y") + F.col("oy")).alias("y"), (F.col("x") + F.col("ox")).alias("x"), F.col("v").alias("_v"))
    return whole.select(*KEY).join(back, KEY, "left").select(*KEY, F.coalesce("_v", F.lit(0)).alias("v"))


def mask_points(px: DataFrame, threshold: int = 127) -> DataFrame:
    """op P11."""
    return px.where(foreground(threshold)).select(*KEY)


def mask_algebra(a: DataFrame, b: DataFrame, how: str, threshold: int = 127) -> DataFrame:
    """op P12: or, and, minus or xor of two masks, as 0 and 255."""
    p, q = foreground(threshold, "v"), foreground(threshold, "_w")
    says = {"or": p | q, "and": p & q, "minus": p & ~q, "xor": p != q}[how]
    both = a.select(*KEY, "v").join(b.select(*KEY, F.col("v").alias("_w")), KEY, "full").select(*KEY, F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("_w", F.lit(0)).alias("_w"))
    return both.select(*KEY, F.when(says, 255).otherwise(0).alias("v"))


def normalise(px: DataFrame, v: str = "v") -> DataFrame:
    """op P13, K2: v scaled between each image's extremes to 0..255."""
    lo, hi = F.min(v).over(by_image()), F.max(v).over(by_image())
    return px.withColumn(v, F.when(hi > lo, F.floor((F.col(v) - lo) * 255.0 / (hi - lo))).otherwise(0).cast("int"))


def mask_bbox(px: DataFrame, threshold: int = 127) -> DataFrame:
    """op C4: the foreground's box; the whole image where there is none."""
    on = foreground(threshold)
    box = px.groupBy("image").agg(*(f(F.when(on, F.col(c))).alias(f"{n}_{c}") for c in ("x", "y") for f, n in ((F.min, "lo"), (F.max, "hi"))), F.max("x").alias("mx"), F.max("y").alias("my"))
    lo = {c: F.coalesce(f"lo_{c}", F.lit(0)) for c in "xy"}
    hi = {c: F.coalesce(f"hi_{c}", f"m{c}") for c in "xy"}
    return box.select("image", lo["x"].alias("bx"), lo["y"].alias("by"), (hi["x"] - lo["x"] + 1).alias("w"), (hi["y"] - lo["y"] + 1).alias("h"))


# ---- separable stencils


def _beside(c: Column, w, k: int) -> Column:
    """The neighbour k before (negative) or after, the pixel itself at the border."""
    return F.coalesce(F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w), c)


def sobel(px: DataFrame, v: str = "v") -> DataFrame:
    """op N1: adds gx8, gy8 (in eighths, whole for whole input) and mag."""
    c = F.col(v)
    px = px.withColumn("_up", _beside(c, along_column(), -1)).withColumn("_down", _beside(c, along_column(), 1))
    px = px.withColumn("_s", F.col("_up") + 2 * c + F.col("_down")).withColumn("_d", F.col("_down") - F.col("_up"))
    s, d = F.col("_s"), F.col("_d")
    px = px.withColumn("gx8", _beside(s, along_row(), 1) - _beside(s, along_row(), -1)).withColumn("gy8", _beside(d, along_row(), -1) + 2 * d + _beside(d, along_row(), 1))
    return px.drop("_up", "_down", "_s", "_d").withColumn("mag", F.sqrt((F.col("gx8") * F.col("gx8") + F.col("gy8") * F.col("gy8")).cast("double")) / 8)


def laplacian(px: DataFrame, v: str = "v") -> DataFrame:
    """op N2: adds lap."""
    c = F.col(v)
    px = px.withColumn("_v", _beside(c, along_column(), -1) + _beside(c, along_column(), 1))
    return px.withColumn("lap", F.col("_v") + _beside(c, along_row(), -1) + _beside(c, along_row(), 1) - 4 * c).drop("_v")


def edge_energy(px: DataFrame) -> DataFrame:
    """op N3: adds energy, -(mag / largest)^2, to sobel()'s rows."""
    top = F.max("mag").over(by_image())
    return px.withColumn("energy", F.when(top > 0, -F.pow(F.col("mag") / top, F.lit(2))).otherwise(0.0))


def gradient(px: DataFrame, v: str = "v") -> DataFrame:
    """op N18: adds dx, dy, half the difference of the neighbours."""
    c = F.col(v)
    px = px.withColumn("dy", (_beside(c, along_column(), 1) - _beside(c, along_column(), -1)) / 2)
    return px.withColumn("dx", (_beside(c, along_row(), 1) - _beside(c, along_row(), -1)) / 2)


def dilate(px: DataFrame, radius: int = 1, v: str = "v") -> DataFrame:
    """op N9, N10: the largest value in a square."""
    px = px.withColumn(v, F.max(v).over(along_column().rowsBetween(-radius, radius)))
    return px.withColumn(v, F.max(v).over(along_row().rowsBetween(-radius, radius)))


def erode(px: DataFrame, radius: int = 1, v: str = "v") -> DataFrame:
    """op N10: the smallest value in a square."""
    px = px.withColumn(v, F.min(v).over(along_column().rowsBetween(-radius, radius)))
    return px.withColumn(v, F.min(v).over(along_row().rowsBetween(-radius, radius)))


def binary(px: DataFrame, threshold: int = 127) -> DataFrame:
    return px.withColumn("v", F.when(foreground(threshold), 255).otherwise(0))


def erode_mask(px: DataFrame, threshold: int = 127) -> DataFrame:
    """op N7: 3x3 erosion of a mask, whose border pixels become background."""
    one = binary(px, threshold)
    for w in (along_column(), along_row()):
        frame = w.rowsBetween(-1, 1)
        one = one.withColumn("v", F.when(F.count("*").over(frame) == 3, F.min("v").over(frame)).otherwise(0))
    return one


def dilate_mask(px: DataFrame, threshold: int = 127, radius: int = 1) -> DataFrame:
    """op N7, N9."""
    return dilate(binary(px, threshold), radius)


def opened(px: DataFrame, threshold: int = 127) -> DataFrame:
    """op N8: erosion, then dilation."""
    return dilate_mask(erode_mask(px, threshold))


def closed(px: DataFrame, threshold: int = 127) -> DataFrame:
    """op N8: dilation, then erosion; also the clean-up of masks."""
    return erode_mask(dilate_mask(px, threshold))


def black_tophat(px: DataFrame, radius: int = 2) -> DataFrame:
    """op N11: adds tophat, how far closing raises a pixel, in 0..255."""
    closing = erode(dilate(px.withColumn("_c", F.col("v")), radius, "_c"), radius, "_c")
    return closing.withColumn("tophat", F.greatest(F.lit(0), F.least(F.lit(255), F.col("_c") - F.col("v")))).drop("_c")


def boundary(px: DataFrame, threshold: int = 127) -> DataFrame:
    """op N17: the foreground pixels with a background 4-neighbour or on the border."""
    on = foreground(threshold).cast("int")
    out = px.withColumn("_l", F.lag(on).over(along_row())).withColumn("_r", F.lead(on).over(along_row())).withColumn("_u", F.lag(on).over(along_column())).withColumn("_d", F.lead(on).over(along_column()))
    inner = F.least(*(F.coalesce(c, F.lit(0)) for c in ("_l", "_r", "_u", "_d")))
    return out.where(foreground(threshold) & (inner == 0)).select(*KEY, "v")


# ---- kernels


def neighbours(px: DataFrame, offsets: list[tuple[int, int, float]], v: str = "v") -> DataFrame:
    """image, y, x, v and, for each offset (dx, dy, k), its k and the value there, clamped to the image."""
    table = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(k)).alias("k")) for dx, dy, k in offsets))
    at = px.join(dimensions(px), "image").select(*KEY, F.col(v).alias("v"), "w", "h", F.explode(table).alias("o"))
    at = at.select(*KEY, "v", F.col("o.k").alias("k"), F.greatest(F.lit(0), F.least(F.col("w") - 1, F.col("x") + F.col("o.dx"))).alias("qx"), F.greatest(F.lit(0), F.least(F.col("h") - 1, F.col("y") + F.col("o.dy"))).alias("qy"))
    return at.join(px.select("image", F.col("y").alias("qy"), F.col("x").alias("qx"), F.col(v).alias("nv")), ["image", "qy", "qx"])


def bilateral(px: DataFrame, radius: int = 3, sigma_s: float = 2.0, sigma_r: float = 28.0) -> DataFrame:
    """op N4: v smoothed by weights in space and value; as a double, smooth."""
    span = range(-radius, radius + 1)
    near = neighbours(px, [(dx, dy, math.exp(-(dx * dx + dy * dy) / (2 * sigma_s**2))) for dy in span for dx in span])
    d = F.col("nv") - F.col("v")
    near = near.withColumn("_w", F.col("k") * F.exp(-(d * d) / (2 * sigma_r**2)))
    return near.groupBy(*KEY).agg(F.first("v").alias("v"), (F.sum(F.col("_w") * F.col("nv")) / F.sum("_w")).alias("smooth"))


def log_kernel(sigma: float = 1.4) -> list[tuple[int, int, float]]:
    """A Laplacian of a Gaussian, negative at its centre, with mean 0."""
    r = max(2, math.ceil(3 * sigma))
    cells = [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    k = [(q - 2 * sigma**2) / sigma**4 * math.exp(-q / (2 * sigma**2)) for q in (dx * dx + dy * dy for dx, dy in cells)]
    mean = sum(k) / len(k)
    return [(dx, dy, c - mean) for (dx, dy), c in zip(cells, k, strict=True)]


def log_response(px: DataFrame, sigma: float = 1.4) -> DataFrame:
    """op N5: adds response."""
    return neighbours(px, log_kernel(sigma)).groupBy(*KEY).agg(F.first("v").alias("v"), F.sum(F.col("k") * F.col("nv")).alias("response"))


def zero_crossings(px: DataFrame, c: str = "response") -> DataFrame:
    """op N6: the inner pixels whose sign differs from the left or upper neighbour's."""
    on = (F.col(c) >= 0).cast("int")
    out = px.withColumn("_left", F.lag(on).over(along_row())).withColumn("_up", F.lag(on).over(along_column())).join(dimensions(px), "image")
    inner = (F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < F.col("w") - 1) & (F.col("y") < F.col("h") - 1)
    return out.where(inner & ((F.col("_left") != on) | (F.col("_up") != on))).select(*KEY, c)


def valley_response(px: DataFrame, sigma: float = 1.4, radius: int = 2, dark: bool = True) -> DataFrame:
    """op N12: the response of dark valleys (or bright ridges) and the black top-hat, summed as valley."""
    r = log_response(px, sigma).select(*KEY, (F.col("response") if dark else -F.col("response")).alias("_r"))
    return black_tophat(px, radius).join(r, KEY).withColumn("valley", F.greatest(F.lit(0.0), F.col("_r")) + F.col("tophat")).drop("_r")


def spine(px: DataFrame, v: str = "valley", share: float = 0.12) -> DataFrame:
    """op N13: pixels above a share of the largest value that no neighbour along the gradient exceeds."""
    g = gradient(px, v)
    ax = F.when(F.abs("dx") >= 0.4142 * F.abs("dy"), F.signum("dx")).otherwise(0).cast("int")
    ay = F.when(F.abs("dy") >= 0.4142 * F.abs("dx"), F.signum("dy")).otherwise(0).cast("int")
    g = g.withColumn("_ax", ax).withColumn("_ay", ay).withColumn("_top", F.max(v).over(by_image())).where(F.col(v) > share * F.col("_top"))
    for n, s in (("_a", 1), ("_b", -1)):
        other = px.select("image", F.col("y").alias("_qy"), F.col("x").alias("_qx"), F.col(v).alias(n))
        g = g.withColumn("_qx", F.col("x") + s * F.col("_ax")).withColumn("_qy", F.col("y") + s * F.col("_ay")).join(other, ["image", "_qy", "_qx"], "left").drop("_qx", "_qy")
    return g.where((F.col(v) >= F.coalesce("_a", F.lit(0.0))) & (F.col(v) >= F.coalesce("_b", F.lit(0.0)))).select(*KEY, v)


def canny_marks(px: DataFrame, low: float = 0.08, high: float = 0.24) -> DataFrame:
    """op N14, first part: thinned edges with v 255 where strong and 128 where weak. Keep components with a strong one."""
    g = sobel(px)
    along = F.abs("gx8") >= F.abs("gy8")
    g = g.withColumn("_h", F.greatest(_beside(F.col("mag"), along_row(), -1), _beside(F.col("mag"), along_row(), 1))).withColumn("_v", F.greatest(_beside(F.col("mag"), along_column(), -1), _beside(F.col("mag"), along_column(), 1)))
    g = g.withColumn("_top", F.max("mag").over(by_image())).where(F.col("mag") >= F.when(along, F.col("_h")).otherwise(F.col("_v")))
    g = g.where((F.col("mag") > 0) & (F.col("mag") >= low * F.col("_top")))
    return g.select(*KEY, F.when(F.col("mag") >= high * F.col("_top"), 255).otherwise(128).alias("v"))


def hue_gradient(rgb: DataFrame) -> DataFrame:
    """op N15: of (image, y, x, r, g, b), half the Lab difference across left and right, and up and down, as de."""
    L, a, b = lab(F.col("r"), F.col("g"), F.col("b"))
    px = rgb.select(*KEY, L.alias("L"), a.alias("a"), b.alias("b"))
    for axis, w in (("h", along_row()), ("v", along_column())):
        px = px.withColumn(f"_{axis}", delta_e2(tuple(_beside(F.col(c), w, 1) for c in "Lab"), tuple(_beside(F.col(c), w, -1) for c in "Lab")))
    return px.withColumn("de", 0.5 * F.sqrt(F.col("_h") + F.col("_v"))).drop("_h", "_v")


# ---- template matching


def ncc(px: DataFrame, template: DataFrame, offsets: DataFrame, flat: float | None = None) -> DataFrame:
    """op N19, N20: zero-mean correlation of template (image, ty, tx, tv) at offsets (image, oy, ox), by six sums. Where
    the window or the template is all of one value: flat, or else 1 for equal sums and 0 for others."""
    at = offsets.join(template, "image").select("image", "oy", "ox", (F.col("oy") + F.col("ty")).alias("y"), (F.col("ox") + F.col("tx")).alias("x"), F.col("tv").cast("double").alias("t"))
    rows = at.join(px.select(*KEY, F.col("v").cast("double").alias("p")), KEY)
    s = rows.groupBy("image", "oy", "ox").agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("t").alias("st"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("t")).alias("pt"))
    den = F.sqrt(F.greatest(F.lit(0.0), (F.col("pp") - F.col("sp") * F.col("sp") / F.col("n")) * (F.col("tt") - F.col("st") * F.col("st") / F.col("n"))))
    value = F.when(den > 1e-8, (F.col("pt") - F.col("sp") * F.col("st") / F.col("n")) / den).otherwise(F.when(F.col("sp") == F.col("st"), 1.0).otherwise(0.0) if flat is None else F.lit(flat))
    return s.select("image", "oy", "ox", "n", value.alias("ncc"))


def ncc_scan(px: DataFrame, template: DataFrame, stride: int = 8, flat: float | None = None) -> DataFrame:
    """op N21: the best place of a template on a coarse grid, the first in reading order among equals. NaN, which flat may
    be (see ncc), is above all numbers."""
    t = template.groupBy("image").agg((F.max("tx") + 1).alias("tw"), (F.max("ty") + 1).alias("th"))
    grid = dimensions(px).join(t, "image").where("w >= tw and h >= th").withColumn("oy", F.explode(F.expr(f"sequence(0, h - th, {stride})"))).withColumn("ox", F.explode(F.expr(f"sequence(0, w - tw, {stride})"))).select("image", "oy", "ox")
    best = F.max_by(F.struct("oy", "ox", "ncc"), F.struct(F.round("ncc", 9), -F.col("oy"), -F.col("ox")))
    return ncc(px, template, grid, flat).groupBy("image").agg(best.alias("b")).select("image", F.col("b.oy").alias("peak_y"), F.col("b.ox").alias("peak_x"), F.col("b.ncc").alias("peak_ncc"))


# ---- margins


def pad(px: DataFrame, margin: int, value: int = 0) -> DataFrame:
    """op P10: `margin` more pixels of a value on every side."""
    size = dimensions(px)
    grid = size.select("image", F.explode(F.sequence(F.lit(0), F.col("h") + 2 * margin - 1)).alias("y"), "w").select("image", "y", F.explode(F.sequence(F.lit(0), F.col("w") + 2 * margin - 1)).alias("x"))
    moved = px.select("image", (F.col("y") + margin).alias("y"), (F.col("x") + margin).alias("x"), "v")
    return grid.join(moved, KEY, "left").select(*KEY, F.coalesce("v", F.lit(value)).cast(px.schema["v"].dataType).alias("v"))


def grown(boxes: DataFrame, px: DataFrame, margin: int) -> DataFrame:
    """op P10: boxes (image, bx, by, w, h) with a margin on every side, within their images."""
    size = dimensions(px).select("image", F.col("w").alias("iw"), F.col("h").alias("ih"))
    x0, y0 = F.greatest(F.lit(0), F.col("bx") - margin), F.greatest(F.lit(0), F.col("by") - margin)
    x1, y1 = F.least(F.col("iw"), F.col("bx") + F.col("w") + margin), F.least(F.col("ih"), F.col("by") + F.col("h") + margin)
    return boxes.join(size, "image").select("image", x0.alias("bx"), y0.alias("by"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def gradient_at(px: DataFrame, at: DataFrame) -> DataFrame:
    """op N18 between pixels: of points (image, px, py), the bilinear value's differences over one pixel each way, as dx, dy."""
    steps = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in (("r", 0.5, 0.0), ("l", -0.5, 0.0), ("d", 0.0, 0.5), ("u", 0.0, -0.5))))
    many = at.distinct().withColumn("_s", F.explode(steps)).select("image", F.col("px").alias("_x"), F.col("py").alias("_y"), F.col("_s.n").alias("_n"), (F.col("px") + F.col("_s.a")).alias("px"), (F.col("py") + F.col("_s.b")).alias("py"))
    size = dimensions(px)
    many = many.join(size, "image").withColumn("px", F.greatest(F.lit(0.0), F.least(F.col("w") - 1.0, F.col("px")))).withColumn("py", F.greatest(F.lit(0.0), F.least(F.col("h") - 1.0, F.col("py"))))
    value = sample_bilinear(px, many.select("image", "px", "py").distinct()).select("image", "px", "py", "value")
    got = many.join(value, ["image", "px", "py"]).groupBy("image", F.col("_x").alias("px"), F.col("_y").alias("py")).agg(*(F.max(F.when(F.col("_n") == n, F.col("value"))).alias(n) for n in "rldu"))
    return got.select("image", "px", "py", (F.col("r") - F.col("l")).alias("dx"), (F.col("d") - F.col("u")).alias("dy"))
