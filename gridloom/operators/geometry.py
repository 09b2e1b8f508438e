"""Polylines (poly, i, x, y) and boxes (id, x, y, w, h)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridloom.operators.kernels import hull


def along() -> WindowSpec:
    return Window.partitionBy("poly").orderBy("i")


def whole() -> WindowSpec:
    return Window.partitionBy("poly")


# ---- vectors (op G5)


def dot(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * bx + ay * by


def dist2(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def unit(x: Column, y: Column) -> tuple[Column, Column]:
    """A vector at length 1; 0 if it is shorter than 1e-8."""
    n = F.sqrt(x * x + y * y)
    return F.when(n < 1e-8, 0.0).otherwise(x / n), F.when(n < 1e-8, 0.0).otherwise(y / n)


def segments(points: DataFrame, closed: bool = True) -> DataFrame:
    """Adds nx, ny, the next point; the last one's is the first (closed) or missing (dropped)."""
    out = points
    for c in "xy":
        following = F.lead(c).over(along())
        out = out.withColumn(f"n{c}", F.coalesce(following, F.first(c).over(along().rowsBetween(Window.unboundedPreceding, 0))) if closed else following)
    return out if closed else out.where("nx is not null")


def lengths(points: DataFrame, closed: bool = True) -> DataFrame:
    """op G3."""
    d = F.sqrt(dist2(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")))
    return segments(points, closed).groupBy("poly").agg(F.sum(d).alias("length"))


def areas(points: DataFrame) -> DataFrame:
    """op G4: shoelace, without sign; 0 for fewer than three points."""
    cross = F.col("x") * F.col("ny") - F.col("nx") * F.col("y")
    return segments(points).groupBy("poly").agg(F.when(F.count("*") < 3, 0.0).otherwise(F.abs(F.sum(cross)) / 2).alias("area"))


def resample(points: DataFrame, n: int) -> DataFrame:
    """op G2: n points at equal arc lengths around closed polylines. Each segment gives the points that fall on it."""
    s = segments(points).withColumn("_l", F.sqrt(dist2(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))))
    s = s.withColumn("_end", F.sum("_l").over(along().rowsBetween(Window.unboundedPreceding, 0))).withColumn("_total", F.sum("_l").over(whole())).where("_l > 0")
    step = F.col("_total") / n
    first, last = F.ceil((F.col("_end") - F.col("_l")) / step - 1e-9), F.ceil(F.col("_end") / step - 1e-9) - 1
    s = s.withColumn("_a", F.greatest(F.lit(0), first)).withColumn("_b", F.least(F.lit(n - 1), last)).where("_a <= _b").withColumn("k", F.explode(F.sequence("_a", "_b")))
    t = (F.col("k") * step - (F.col("_end") - F.col("_l"))) / F.col("_l")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return s.select("poly", F.col("k").cast("int").alias("i"), (F.col("x") + t * (F.col("nx") - F.col("x"))).alias("px"), (F.col("y") + t * (F.col("ny") - F.col("y"))).alias("py")).select("poly", "i", F.col("px").alias("x"), F.col("py").alias("y"))


def spans(points: DataFrame, width: int | Column, height: int | Column) -> DataFrame:
    """op G6 by runs: (poly, y, x0, x1), the first and the last pixel of each. width and height may be columns of points."""
    e = segments(points.withColumn("_w", F.lit(width)).withColumn("_h", F.lit(height))).where("y <> ny")
    lo, hi = F.least("y", "ny"), F.greatest("y", "ny")
    e = e.withColumn("_a", F.greatest(F.lit(0), F.ceil(lo - 0.5))).withColumn("_b", F.least(F.col("_h") - 1, F.ceil(hi - 0.5) - 1)).where("_a <= _b").withColumn("row", F.explode(F.sequence("_a", "_b")))
    cut = F.col("x") + (F.col("row") + 0.5 - F.col("y")) * (F.col("nx") - F.col("x")) / (F.col("ny") - F.col("y"))
    w = Window.partitionBy("poly", "row").orderBy("_x", "i")
    e = e.select("poly", "row", "i", "_w", cut.alias("_x")).withColumn("_k", F.row_number().over(w)).withColumn("_to", F.lead("_x").over(w)).where("_k % 2 = 1 and _to is not null")
    e = e.withColumn("_a", F.greatest(F.lit(0), F.ceil("_x"))).withColumn("_b", F.least(F.col("_w") - 1, F.floor("_to"))).where("_a <= _b")
    return e.select("poly", F.col("row").cast("int").alias("y"), F.col("_a").cast("int").alias("x0"), F.col("_b").cast("int").alias("x1"))


def rasterise(points: DataFrame, width: int, height: int) -> DataFrame:
    """op G6: pixels (poly, y, x) inside by the even-odd rule on lines at y + 0.5, from ceil(x0) to floor(x1)."""
    return spans(points, width, height).select("poly", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def outline(points: DataFrame, closed: bool = True) -> DataFrame:
    """op G7: distinct pixels along the segments, max(1, floor(2 distance)) steps each."""
    s = segments(points, closed)
    n = F.greatest(F.lit(1), F.floor(2 * F.sqrt(dist2(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))))).cast("int")
    s = s.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    at = {c: F.floor(F.col(c) + (F.col(f"n{c}") - F.col(c)) * F.col("_k") / F.col("_n") + 0.5).cast("int").alias(f"p{c}") for c in "xy"}
    return s.select("poly", at["y"], at["x"]).distinct().select("poly", F.col("py").alias("y"), F.col("px").alias("x"))


def xor_fill(points: DataFrame, group: Column, width: int, height: int) -> DataFrame:
    """op G8: pixels (grp, y, x) inside an odd number of a group's loops. group: a column over poly."""
    return rasterise(points, width, height).groupBy(group.alias("grp"), "y", "x").count().where("count % 2 = 1").drop("count")


def largest(points: DataFrame, group: Column) -> DataFrame:
    """op G10: the polyline with the largest area of each group, the smallest poly among equals."""
    return areas(points).groupBy(group.alias("grp")).agg(F.max_by("poly", F.struct("area", -F.col("poly"))).alias("poly"), F.max("area").alias("area"))


def thin(points: DataFrame, most: int) -> DataFrame:
    """op G18: at most so many points a polyline, by a uniform stride."""
    n = F.count("*").over(whole())
    rank = F.row_number().over(along()) - 1
    out = points.withColumn("_n", n).withColumn("_r", rank)
    keep = (F.col("_n") <= most) | (F.floor((F.col("_r") + 1) * most / F.col("_n")) > F.floor(F.col("_r") * most / F.col("_n")))
    return out.where(keep).drop("_n", "_r")


def simplification_error(full: DataFrame, kept: DataFrame) -> DataFrame:
    """op G13: the largest distance of a full polyline's point to the nearest kept segment's line, of each poly."""
    s = segments(kept, False).select("poly", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("nx").alias("bx"), F.col("ny").alias("by"))
    both = full.join(s, "poly")
    length = F.sqrt(dist2(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    line = F.abs((F.col("bx") - F.col("ax")) * (F.col("ay") - F.col("y")) - (F.col("ax") - F.col("x")) * (F.col("by") - F.col("ay"))) / length
    point = F.sqrt(dist2(F.col("ax"), F.col("ay"), F.col("x"), F.col("y")))
    d = F.when(length < 1e-12, point).otherwise(line)
    return both.groupBy("poly", "i").agg(F.min(d).alias("d")).groupBy("poly").agg(F.max("d").alias("max_err"))


def hull_area(points: DataFrame, key: str) -> DataFrame:
    """op G14: (key, hull_area) of points (key, x, y): one pass over each group's points in order, in its task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = hull(pdf[["x", "y"]].to_numpy(float))
        area = abs(float(np.sum(c[:, 0] * np.roll(c[:, 1], -1) - np.roll(c[:, 0], -1) * c[:, 1]))) / 2
        return pd.DataFrame({key: [pdf[key].iloc[0]], "hull_area": [area]})

    return points.groupBy(key).applyInPandas(run, points.select(key, F.lit(0.0).alias("hull_area")).schema)


def hull_edges(points: DataFrame) -> DataFrame:
    """op G14 as a relation: the pairs of points of which all others lie on one side. For small sets, as a check."""
    p = points.select("poly", "x", "y").distinct()
    a, b, c = (p.select("poly", F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y")) for n in "abc")
    edge = a.join(b, "poly").where("ax <> bx or ay <> by").join(c, "poly")
    side = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))
    return edge.groupBy("poly", "ax", "ay", "bx", "by").agg(F.min(side).alias("_m")).where("_m >= 0").drop("_m")


def marching_segments(field: DataFrame, iso: float = 0.0, v: str = "v") -> DataFrame:
    """op G9, relational part: (image, cy, cx, ax, ay, bx, by), the iso line's pieces within cells of four pixels."""
    row = Window.partitionBy("image", "y").orderBy("x")
    column = Window.partitionBy("image", "x").orderBy("y")
    f = field.select("image", "y", "x", F.col(v).cast("double").alias("p00")).withColumn("p10", F.lead("p00").over(row))
    f = f.withColumn("p01", F.lead("p00").over(column)).withColumn("p11", F.lead("p10").over(column)).where("p10 is not null and p01 is not null and p11 is not null")
    case = sum((F.when(F.col(c) <= iso, 1 << k).otherwise(0) for k, c in enumerate(("p00", "p10", "p11", "p01"))), F.lit(0))

    def cut(a: str, b: str, x: tuple[float, float], y: tuple[float, float]) -> Column:
        t = (F.lit(iso) - F.col(a)) / (F.col(b) - F.col(a))
        return F.struct((F.col("x") + x[0] + t * (x[1] - x[0])).alias("x"), (F.col("y") + y[0] + t * (y[1] - y[0])).alias("y"))

    side = {"t": cut("p00", "p10", (0, 1), (0, 0)), "r": cut("p10", "p11", (1, 1), (0, 1)), "b": cut("p01", "p11", (0, 1), (1, 1)), "l": cut("p00", "p01", (0, 0), (0, 1))}
    # which sides are joined, by the corners below iso (bits: upper left, upper right, lower right, lower left)
    joins = {1: ["lt"], 2: ["tr"], 3: ["lr"], 4: ["rb"], 5: ["lt", "rb"], 6: ["tb"], 7: ["lb"], 8: ["bl"], 9: ["bt"], 10: ["tr", "bl"], 11: ["br"], 12: ["rl"], 13: ["rt"], 14: ["tl"]}
    pieces = F.lit(None)
    for k, own in joins.items():
        pieces = F.when(F.col("_k") == k, F.array(*(F.struct(side[p].alias("a"), side[q].alias("b")) for p, q in own))).otherwise(pieces)
    f = f.withColumn("_k", case).where("_k between 1 and 14").select("image", F.col("y").alias("cy"), F.col("x").alias("cx"), F.explode(pieces).alias("s"))
    return f.select("image", "cy", "cx", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by")).where("ax <> bx or ay <> by")


# ---- boxes


def intersects(a: str, b: str) -> Column:
    """Strict overlap: touching edges don't count."""
    return (F.col(f"{a}.x") < F.col(f"{b}.x") + F.col(f"{b}.w")) & (F.col(f"{b}.x") < F.col(f"{a}.x") + F.col(f"{a}.w")) & (F.col(f"{a}.y") < F.col(f"{b}.y") + F.col(f"{b}.h")) & (F.col(f"{b}.y") < F.col(f"{a}.y") + F.col(f"{a}.h"))


def box_join(left: DataFrame, right: DataFrame, cell: float = 64.0) -> DataFrame:
    """op I1, I2: pairs (a, b) of ids of overlapping boxes, over a grid of cells.

    A box goes to each cell it covers; a pair is found in the cell of its overlap's upper left corner alone, so nothing
    need be made distinct afterwards. AQE splits cells that hold many boxes.
    """

    def dealt(df: DataFrame) -> DataFrame:
        cells = {c: F.sequence(F.floor(F.col(c) / cell), F.floor((F.col(c) + F.col(s)) / cell)) for c, s in (("x", "w"), ("y", "h"))}
        return df.select("id", "x", "y", "w", "h", F.explode(cells["x"]).alias("cx")).withColumn("cy", F.explode(cells["y"]))

    a, b = dealt(left).alias("a"), dealt(right).alias("b")
    own = (F.floor(F.greatest("a.x", "b.x") / cell) == F.col("a.cx")) & (F.floor(F.greatest("a.y", "b.y") / cell) == F.col("a.cy"))
    return a.join(b, (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & intersects("a", "b") & own).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def dominated(px: np.ndarray, py: np.ndarray, ids: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each query, the number of points with px < qx and py < qy and the sum of their ids, by a wavelet matrix: the points
    in order of px, parted by the bits of py from the highest on. Whole numbers from 0 on."""
    n, total = np.zeros(len(qx), np.int64), np.zeros(len(qx), np.int64)
    if not len(px) or not len(qx):
        return n, total
    order = np.argsort(px, kind="stable")
    v, w = py[order], ids[order]
    left, right = np.zeros(len(qx), np.int64), np.searchsorted(px[order], qx)
    for bit in reversed(range(int(max(py.max(), qy.max())).bit_length())):
        low = (v >> bit) & 1 == 0
        before, summed = np.append(0, np.cumsum(low)), np.append(0, np.cumsum(np.where(low, w, 0)))
        up = (qy >> bit) & 1 == 1
        l0, r0 = before[left], before[right]
        n += np.where(up, r0 - l0, 0)
        total += np.where(up, summed[right] - summed[left], 0)
        left, right = np.where(up, before[-1] + left - l0, l0), np.where(up, before[-1] + right - r0, r0)
        parted = np.append(np.flatnonzero(low), np.flatnonzero(~low))
        v, w = v[parted], w[parted]
    return n, total


def sides(p: pd.DataFrame, q: pd.DataFrame, c: str, ends: bool) -> tuple[np.ndarray, np.ndarray]:
    """Along axis c, whole numbers such that a box of p lies before the mark of one of q where its number is smaller.

    Either begins before q ends; or, ends, has ended when q begins. Boxes without extent at one place don't overlap, so there
    an ended one counts as ended for those with an extent alone.
    """
    values, marks = (p[c + "1"], q[c]) if ends else (p[c], q[c + "1"])
    known = np.unique(values.to_numpy())
    at = np.searchsorted(known, values.to_numpy()) * 2
    low, high = (np.searchsorted(known, marks.to_numpy(), s) * 2 for s in ("left", "right"))
    if not ends:
        return at, low
    return at + p["p" + c].to_numpy(), np.where((high > low) & q["p" + c].to_numpy(), low + 1, high)


def cells_of(pdf: pd.DataFrame, c: str, ends: bool, bounds: np.ndarray, marks: bool) -> np.ndarray:
    """The slab of each box (or mark) in the order of sides(). Boxes on a bound that slabs share are dealt over those."""
    v = pdf[c + "1" if ends != marks else c].to_numpy()
    low, high = np.searchsorted(bounds, v, "left"), np.searchsorted(bounds, v, "right")
    point = pdf["p" + c].to_numpy()
    middle = (low + high) // 2
    if marks:
        return np.where(point, middle, high) if ends else low
    if ends:
        low, high = np.where(point, middle, low), np.where(point, high, middle)
    mixed = (pdf.id.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return low + mixed.astype(np.int64) % (high - low + 1)


#: Quantiles along each axis by which box_hits() deals boxes.
SLABS = 64


def box_hits(left: DataFrame, right: DataFrame, write=lambda df, name: df, slabs: int = SLABS) -> DataFrame:
    """op I1, I2 without the pairs, whose number may be the square of the boxes': (a, hits, ids), of each id in left how many
    boxes of right with another id it overlaps, and the sum of their ids. Sides are 0 or more; boxes with nulls overlap none.

    Along an axis b overlaps a if it begins before a ends, but not if it has ended when a begins. So hits are numbers of
    corners below and left of a corner, of four kinds with signs. They are counted over a grid of quantiles: whole cells by
    a table of their sums, the rest within the mark's column and row of cells, each a task that sorts.
    """
    ends = {"x1": F.col("x") + F.col("w"), "y1": F.col("y") + F.col("h")}
    a, b = (d.select(F.col("id").cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in "xy"), *(v.cast("double").alias(c) for c, v in ends.items())).where("id is not null and x is not null and x1 is not null and y is not null and y1 is not null") for d in (left, right))
    slabs = max(2, slabs)
    # a bound for each slab but the last; the same one several times where very many boxes share a place
    at = ["x", "x1", "y", "y1"]
    bounds = {c: np.sort(np.array(v, float)) for c, v in zip(at, b.approxQuantile(at, [k / slabs for k in range(1, slabs)], 0.25 / slabs), strict=True)}
    kinds = [(c, e) for c in "xy" for e in (False, True)]

    def placed(marks: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                # without an extent; NaN is above all numbers
                pdf = pdf.assign(**{"p" + c: ~((pdf[c] < pdf[c + "1"]) | pdf[c].notna() & pdf[c + "1"].isna()) for c in "xy"}, mark=marks)
                yield pdf.assign(**{f"c{k}": cells_of(pdf, c, e, bounds[c + "1" * e], marks) for k, (c, e) in enumerate(kinds)})

        return run

    schema = "id long, x double, y double, x1 double, y1 double, px boolean, py boolean, mark boolean, c0 long, c1 long, c2 long, c3 long"
    points, marks = write(b.mapInPandas(placed(False), schema), "boxes"), a.mapInPandas(placed(True), schema)
    corners = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}").alias("u"), F.col(f"c{j}").alias("v")) for i in (0, 1) for j in (2, 3))))
    table = points.select("id", corners.alias("c")).groupBy("c").agg(F.count("*").alias("n"), F.sum("id").alias("s")).select("c.*", "n", "s").toPandas()  # 4 * slabs ** 2 rows at most
    below = np.zeros((2, 2, 2, slabs + 1, slabs + 1), np.int64)
    below[:, table.i, table.j - 2, table.u + 1, table.v + 1] = table[["n", "s"]].to_numpy().T
    below = below.cumsum(3).cumsum(4)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["k"].iloc[0])
        p, q = pdf[~pdf["mark"]], pdf[pdf["mark"]]
        n, total = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        if k < 2:  # a column of cells: corners of any height
            first = sides(p, q, "x", k == 1)
            second = [sides(p, q, "y", e) for e in (False, True)]
            pairs = [(first, y, k + e) for e, y in enumerate(second)]
            for e in (0, 1):
                cell = below[:, k, e][:, q[f"c{k}"], q[f"c{2 + e}"]]
                n, total = n + (-1) ** (k + e) * cell[0], total + (-1) ** (k + e) * cell[1]
        else:  # a row of cells: corners in columns before the mark's
            second = sides(p, q, "y", k == 3)
            pairs = [((p[f"c{e}"].to_numpy(), q[f"c{e}"].to_numpy()), second, k + e) for e in (0, 1)]
        for (px, qx), (py, qy), sign in pairs:
            m, t = dominated(px, py, p.id.to_numpy(), qx, qy)
            n, total = n + (-1) ** sign * m, total + (-1) ** sign * t
        return pd.DataFrame({"a": q.id, "hits": n, "ids": total})

    dealt = points.unionAll(marks).select("*", F.posexplode(F.array("c0", "c1", "c2", "c3")).alias("k", "cell"))
    found = dealt.groupBy("k", "cell").applyInPandas(run, "a long, hits long, ids long")
    own = a.alias("a").join(b.alias("b"), F.col("a.id") == F.col("b.id")).where("a.x < b.x1 and b.x < a.x1 and a.y < b.y1 and b.y < a.y1").select(F.col("a.id").alias("a"), F.lit(-1).cast("long").alias("hits"), (-F.col("b.id")).alias("ids"))
    return found.unionAll(own).groupBy("a").agg(F.sum("hits").alias("hits"), F.sum("ids").alias("ids")).where("hits > 0")


def box_join_brute(left: DataFrame, right: DataFrame) -> DataFrame:
    """op I3: the same by comparing all pairs; a check for small inputs."""
    return left.alias("a").join(right.alias("b"), intersects("a", "b")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def box_iou(a: str = "a", b: str = "b") -> Column:
    """op E9: overlap over union of two struct columns' boxes, 0 without area."""
    w = F.greatest(F.lit(0.0), F.least(F.col(f"{a}.x") + F.col(f"{a}.w"), F.col(f"{b}.x") + F.col(f"{b}.w")) - F.greatest(f"{a}.x", f"{b}.x"))
    h = F.greatest(F.lit(0.0), F.least(F.col(f"{a}.y") + F.col(f"{a}.h"), F.col(f"{b}.y") + F.col(f"{b}.h")) - F.greatest(f"{a}.y", f"{b}.y"))
    both = w * h
    union = F.col(f"{a}.w") * F.col(f"{a}.h") + F.col(f"{b}.w") * F.col(f"{b}.h") - both
    return F.when(union > 0, both / union).otherwise(0.0)
