"""Distance fields and regions of long rasters (image, y, x, v)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.raster import along_column, by_image, KEY, along_row, dimensions, foreground

_EIGHT = [(-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]


def _from_rows(px: DataFrame, on: Column, metric: str, name: str) -> DataFrame:
    """Adds `name`, the least over all rows of a column of metric(rows between, gap along that row): first the gap to the
    nearest pixel of the row where `on`, then each column's rows by one array, in ever larger steps until none can win."""
    seed = F.when(on, F.col("x"))
    before = F.last(seed, ignorenulls=True).over(along_row().rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(seed, ignorenulls=True).over(along_row().rowsBetween(0, Window.unboundedFollowing))
    gap = px.select(*KEY, F.least(F.col("x") - before, after - F.col("x")).alias("g"))
    columns = gap.groupBy("image", "x").agg(F.sort_array(F.collect_list(F.struct("y", "g"))).alias("c"))
    columns = columns.select("image", "x", F.col("c.y").alias("ys"), F.transform("c.g", lambda g: F.coalesce(g.cast("double"), F.lit(float("inf")))).alias("gs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["image", "x", "ys"]].assign(ds=[column_least(np.asarray(y), np.asarray(g), metric) for y, g in zip(pdf.ys, pdf.gs, strict=True)])

    found = columns.mapInPandas(run, "image string, x int, ys array<int>, ds array<double>")
    rows = found.select("image", "x", F.explode(F.arrays_zip("ys", "ds")).alias("r")).select("image", F.col("r.ys").alias("y"), "x", F.nanvl(F.col("r.ds"), F.lit(None).cast("double")).alias(name))
    return px.join(rows, KEY, "left")


def column_least(ys: np.ndarray, gaps: np.ndarray, metric: str) -> np.ndarray:
    """Of each row of a column, the least squared or chamfer distance over all rows; NaN where no row has a seed."""
    h = int(ys.max()) + 1
    g = np.full(h, np.inf)
    g[ys] = gaps

    def value(dy: int, g: np.ndarray) -> np.ndarray:
        return g * g + dy * dy if metric == "square" else np.maximum(g, dy) + 0.41421356237309515 * np.minimum(g, dy)

    best = value(0, g)
    for dy in range(1, h):
        if value(dy, np.zeros(1))[0] >= best.max():  # no row so far away is nearer than what is found
            break
        with np.errstate(invalid="ignore"):
            np.minimum(best[dy:], np.where(np.isinf(g[:-dy]), np.inf, value(dy, g[:-dy])), out=best[dy:])
            np.minimum(best[:-dy], np.where(np.isinf(g[dy:]), np.inf, value(dy, g[dy:])), out=best[:-dy])
    best = best[ys]
    return np.where(np.isinf(best), np.nan, best)


def squared_distance(px: DataFrame, on: Column) -> DataFrame:
    """op F1: adds d2, the squared distance to the nearest pixel where `on`; null where the image has none."""
    return _from_rows(px, on, "square", "d2").withColumn("d2", F.col("d2").cast("long"))


def distance(px: DataFrame, threshold: int = 127, to: str = "foreground") -> DataFrame:
    """op F3: adds d, the distance to the foreground or background."""
    on = foreground(threshold)
    return squared_distance(px, on if to == "foreground" else ~on).withColumn("d", F.sqrt(F.col("d2").cast("double"))).drop("d2")


def signed_distance(px: DataFrame, threshold: int = 127) -> DataFrame:
    """op F2, F4: adds sdf, negative inside: distance to the foreground less distance to the background."""
    out = distance(px, threshold).withColumnRenamed("d", "_f")
    out = distance(out, threshold, "background")
    return out.withColumn("sdf", F.coalesce("_f", F.lit(0.0)) - F.coalesce("d", F.lit(0.0))).drop("_f", "d")


def chamfer(px: DataFrame, on: Column) -> DataFrame:
    """op F5: adds chamfer, the distance by steps of 1 and sqrt(2) to the nearest pixel where `on`.

    On a free grid it is the least over seeds of max + (sqrt(2) - 1) min of the two offsets; for a row the best seed is
    the nearest one.
    """
    return _from_rows(px, on, "chamfer", "chamfer")


def signed_chamfer(px: DataFrame, threshold: int = 127) -> DataFrame:
    """op F6: adds sdf by chamfer distances, negative inside."""
    on = foreground(threshold)
    out = chamfer(px, on).withColumnRenamed("chamfer", "_f")
    return chamfer(out, ~on).withColumn("sdf", F.coalesce("_f", F.lit(0.0)) - F.coalesce("chamfer", F.lit(0.0))).drop("_f", "chamfer")


def circle_sdf(x: Column, y: Column, cx: float, cy: float, r: float) -> Column:
    """op F7."""
    return F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) - r


def box_sdf(x: Column, y: Column, cx: float, cy: float, hx: float, hy: float) -> Column:
    """op F7."""
    qx, qy = F.abs(x - cx) - hx, F.abs(y - cy) - hy
    ox, oy = F.greatest(qx, F.lit(0.0)), F.greatest(qy, F.lit(0.0))
    return F.sqrt(ox * ox + oy * oy) + F.least(F.greatest(qx, qy), F.lit(0.0))


def medial_axis(px: DataFrame, threshold: int = 127) -> DataFrame:
    """op F8: foreground pixels whose inner distance d is 0.75 at least, that no neighbour exceeds by more than 0.25 and
    at least four don't reach by that much."""
    d = distance(px, threshold, "background").withColumn("d", F.when(foreground(threshold), F.coalesce("d", F.lit(0.0))).otherwise(0.0))
    table = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in _EIGHT))
    near = d.where("d >= 0.75").select(*KEY, "d", F.explode(table).alias("o")).select(*KEY, "d", (F.col("y") + F.col("o.dy")).alias("qy"), (F.col("x") + F.col("o.dx")).alias("qx"))
    near = near.join(d.select("image", F.col("y").alias("qy"), F.col("x").alias("qx"), F.col("d").alias("nd")), ["image", "qy", "qx"])
    s = near.groupBy(*KEY).agg(F.first("d").alias("d"), F.max("nd").alias("top"), F.sum((F.col("nd") <= F.col("d") + 0.25).cast("int")).alias("low"))
    return s.where("top <= d + 0.25 and low >= 4").select(*KEY, "d")


# ---- regions


def runs(px: DataFrame, on: Column) -> DataFrame:
    """Runs (image, y, x0, x1) of pixels where `on`, by gaps and islands along rows."""
    rows = px.where(on).select(*KEY)
    rows = rows.withColumn("_g", F.col("x") - F.row_number().over(along_row()))
    return rows.groupBy("image", "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")


def run_links(r: DataFrame, reach: int) -> DataFrame:
    """Pairs of runs in successive rows that touch (reach 1: also at corners)."""
    a = r.select("image", "y", F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    b = r.select("image", (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    touch = (F.col("b0") <= F.col("a1") + reach) & (F.col("a0") <= F.col("b1") + reach)
    return a.join(b, ["image", "y"]).where(touch)


def connected_components(px: DataFrame, on: Column, eight: bool = True) -> DataFrame:
    """op C1: runs (image, y, x0, x1, comp) of each component; comp is its least y * width + x.

    An image's runs, far fewer than its pixels, are joined in one task each. For an image whose runs a task can't hold,
    see connected_components_spread().
    """
    reach = int(eight)
    sized = runs(px, on).join(dimensions(px).select("image", "w"), "image")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x0"]).reset_index(drop=True)
        comp = joined_runs(pdf.y.to_numpy(), pdf.x0.to_numpy(), pdf.x1.to_numpy(), reach)
        first = pdf.y.to_numpy().astype(np.int64) * pdf.w.to_numpy() + pdf.x0.to_numpy()
        return pdf[["image", "y", "x0", "x1"]].assign(comp=first[comp])

    return sized.groupBy("image").applyInPandas(run, "image string, y int, x0 int, x1 int, comp long")


def joined_runs(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> np.ndarray:
    """Of runs in reading order, the number of each one's component's first run."""
    parent = list(range(len(y)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ys, a, b = y.tolist(), x0.tolist(), x1.tolist()
    above = 0
    for i in range(len(ys)):
        while ys[above] < ys[i] - 1 or (ys[above] == ys[i] - 1 and b[above] + reach < a[i]):
            above += 1
        j = above
        while ys[j] == ys[i] - 1 and a[j] <= b[i] + reach:
            p, q = find(i), find(j)
            parent[max(p, q)] = min(p, q)
            j += 1
    return np.array([find(i) for i in range(len(ys))], np.int64)


def connected_components_spread(px: DataFrame, on: Column, eight: bool, write) -> DataFrame:
    """op C1 across tasks, for images that are too large for one: labels spread over links between runs and jump to their
    label's label until none changes. write(df, name) stores a round's table and reads it again.
    """
    w = dimensions(px).select("image", "w")
    r = write(runs(px, on).join(w, "image").withColumn("id", F.col("y").cast("long") * F.col("w") + F.col("x0")).drop("w"), "runs")
    ids = r.select("image", "y", "x0", "id")
    links = run_links(r, int(eight))
    links = links.join(ids.select("image", "y", F.col("x0").alias("a0"), F.col("id").alias("a")), ["image", "y", "a0"])
    links = links.join(ids.select("image", (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("id").alias("b")), ["image", "y", "b0"]).select("image", "a", "b")
    links = write(links.unionAll(links.select("image", F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = r.select("image", "id", F.col("id").alias("comp"))
    while True:
        near = links.join(labels.select("image", F.col("id").alias("b"), F.col("comp").alias("_n")), ["image", "b"]).groupBy("image", F.col("a").alias("id")).agg(F.min("_n").alias("_n"))
        # hook a label to the least label around its members, then jump twice
        least = labels.join(near, ["image", "id"], "left").select("image", "id", "comp", F.least("comp", "_n").alias("_m"))
        hook = least.groupBy("image", "comp").agg(F.min("_m").alias("_h"))
        hook2 = hook.join(hook.select("image", F.col("comp").alias("_h"), F.col("_h").alias("_h2")), ["image", "_h"], "left").select("image", "comp", F.coalesce("_h2", "_h").alias("_h"))
        fresh = write(labels.join(hook2, ["image", "comp"]).select("image", "id", F.col("_h").alias("comp"), (F.col("_h") < F.col("comp")).alias("_moved")), "labels")
        labels = fresh.select("image", "id", "comp")
        if fresh.where("_moved").isEmpty():
            return r.join(labels, ["image", "id"]).drop("id")


def component_stats(comps: DataFrame) -> DataFrame:
    """op C2: area and box of each component of connected_components()."""
    return comps.groupBy("image", "comp").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))


def euler(px: DataFrame, threshold: int = 127) -> DataFrame:
    """op C3: components, holes (background components off the border) and chi, both with eight neighbours."""
    on = foreground(threshold)
    fg = component_stats(connected_components(px, on)).groupBy("image").agg(F.count("*").alias("components"))
    size = dimensions(px).select("image", F.col("w").alias("iw"), F.col("h").alias("ih"))
    bg = component_stats(connected_components(px, ~on)).join(size, "image")
    bg = bg.where("x > 0 and y > 0 and x + w < iw and y + h < ih").groupBy("image").agg(F.count("*").alias("holes"))
    out = size.select("image").join(fg, "image", "left").join(bg, "image", "left")
    c, h = F.coalesce("components", F.lit(0)), F.coalesce("holes", F.lit(0))
    return out.select("image", c.alias("components"), h.alias("holes"), (c - h).alias("chi"))


def euler_quads(px: DataFrame, threshold: int = 127) -> DataFrame:
    """op C3 by counting 2x2 patterns (foreground with eight neighbours), one aggregate and no labelling."""
    table = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(1 << k).alias("k")) for k, (dx, dy) in enumerate([(0, 0), (1, 0), (0, 1), (1, 1)])))
    q = px.where(foreground(threshold)).select("image", "y", "x", F.explode(table).alias("o")).groupBy("image", (F.col("y") - F.col("o.dy")).alias("qy"), (F.col("x") - F.col("o.dx")).alias("qx"))
    q = q.agg(F.count("*").alias("n"), F.sum("o.k").alias("m"))
    one, three, diagonal = (F.sum(c.cast("int")) for c in (F.col("n") == 1, F.col("n") == 3, F.col("m").isin(6, 9)))
    return q.groupBy("image").agg(one.alias("q1"), three.alias("q3"), diagonal.alias("qd")).select("image", ((F.col("q1") - F.col("q3") - 2 * F.col("qd")) / 4).cast("int").alias("chi"))


def canny(marks: DataFrame) -> DataFrame:
    """op N14, second part: of canny_marks(), the pixels in components that hold a strong one."""
    comps = connected_components(marks, F.lit(True))
    at = marks.join(comps, (marks.image == comps.image) & (marks.y == comps.y) & marks.x.between(comps.x0, comps.x1)).select(marks.image, marks.y, marks.x, marks.v, "comp")
    strong = at.where("v = 255").select("image", "comp").distinct()
    return at.join(strong, ["image", "comp"], "left_semi").select(*KEY, "comp")


def minima(px: DataFrame, v: str = "v") -> DataFrame:
    """op C6: inner pixels that no 8-neighbour is below."""
    low = F.min(v).over(along_column().rowsBetween(-1, 1))
    out = px.withColumn("_m", low)
    out = out.withColumn("_m", F.min("_m").over(along_row().rowsBetween(-1, 1))).join(dimensions(px), "image")
    return out.where((F.col(v) <= F.col("_m")) & (F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < F.col("w") - 1) & (F.col("y") < F.col("h") - 1)).select(*KEY, v)


def faces(labels: DataFrame) -> DataFrame:
    """op C15: of (image, y, x, label, v), each face's area, centre and mean value."""
    return labels.groupBy("image", "label").agg(F.count("*").alias("area"), (F.avg("x") + 0.5).alias("cx"), (F.avg("y") + 0.5).alias("cy"), F.avg("v").alias("mean_v"))


def _cracks(labels: DataFrame) -> DataFrame:
    """Pixel sides between different labels: (image, a, b, va, vb, and the side's ends)."""
    out = None
    for w, ends in ((along_row(), ("x + 1", "y", "x + 1", "y + 1")), (along_column(), ("x", "y + 1", "x + 1", "y + 1"))):
        side = labels.withColumn("b", F.lead("label").over(w)).withColumn("vb", F.lead("v").over(w)).where("b is not null and b <> label")
        side = side.select("image", F.col("label").alias("a"), "b", F.col("v").alias("va"), "vb", *(F.expr(f"cast({e} as int)").alias(n) for e, n in zip(ends, ("px", "py", "qx", "qy"), strict=True)))
        out = side if out is None else out.unionAll(side)
    return out


def adjacency(labels: DataFrame) -> DataFrame:
    """op C15: shared length and mean step of value of each pair of faces with a common 4-neighbour side."""
    c = _cracks(labels)
    return c.groupBy("image", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("length"), F.avg(F.abs(F.col("va") - F.col("vb"))).alias("step"))


def half_edges(labels: DataFrame) -> DataFrame:
    """op C16: two directed sides for each crack and, by the order of angles at its end, the one that follows."""
    c = _cracks(labels)
    both = c.select("image", F.col("a").alias("face"), "px", "py", "qx", "qy").unionAll(c.select("image", F.col("b").alias("face"), F.col("qx").alias("px"), F.col("qy").alias("py"), F.col("px").alias("qx"), F.col("py").alias("qy")))
    angle = F.atan2(F.col("qy") - F.col("py"), F.col("qx") - F.col("px"))
    at = Window.partitionBy("image", "px", "py").orderBy(angle)
    around = both.withColumn("nx", F.coalesce(F.lead("qx").over(at), F.first("qx").over(at))).withColumn("ny", F.coalesce(F.lead("qy").over(at), F.first("qy").over(at)))
    # after p -> q comes what follows q -> p in the order around q
    turn = around.select("image", F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("qx").alias("px"), F.col("qy").alias("py"), F.col("nx"), F.col("ny"))
    return both.join(turn, ["image", "px", "py", "qx", "qy"], "left")


def livewire_cost(px: DataFrame, crossings: DataFrame) -> DataFrame:
    """op C18: 0.02 + 0.45 (1 - mag / largest) + 0.35 where there is no zero crossing; of sobel()'s rows."""
    top = F.max("mag").over(by_image())
    hit = crossings.select(*KEY, F.lit(1).alias("_z"))
    share = F.when(top > 0, F.col("mag") / top).otherwise(0.0)
    return px.join(hit, KEY, "left").withColumn("cost", 0.02 + 0.45 * (1 - share) + F.when(F.col("_z").isNull(), 0.35).otherwise(0.0)).drop("_z")


