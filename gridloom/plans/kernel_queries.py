"""Queries through kernels. Their figures are checked by invariants in the tests; SQL has those that it can express."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.operators import fields as D
from gridloom.operators import geometry as G
from gridloom.operators import kernels as K
from gridloom.operators import signal as S
from gridloom.operators.kernel_ops import per_image, per_polyline
from gridloom.plans.raster_queries import PX, big
from gridloom.plans.shape_queries import _frames
from gridloom.sources import adapters as A

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _box(m: np.ndarray) -> tuple[int, int, int, int]:
    ys, xs = np.nonzero(m)
    return (int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1) if len(xs) else (0, 0, m.shape[1], m.shape[0])


@query("gvf")
def gvf(spark, sf):
    def f(a):
        n = np.hypot(*K.gradient_flow(a))
        return {"max_flow": round(float(n.max()), 4), "mean_flow": round(float(n.mean()), 6)}

    return per_image(A.event_raster(spark, sf), f, "max_flow double, mean_flow double")


@query("watershed_mask")
def watershed_mask(spark, sf):
    def f(a):
        w = K.watershed_of_mask(a > 60)
        return {"n_basins": int(w.max()), "n_watershed": int((w == 0).sum())}

    return per_image(A.event_raster(spark, sf), f, "n_basins long, n_watershed long")


@query("watershed_gradient")
def watershed_gradient(spark, sf):
    def f(a):
        relief = K.sobel(a)
        w = K.watershed(relief, K.minima(relief))
        return {"n_basins": int(w.max()), "n_watershed": int((w == 0).sum())}

    return per_image(A.event_raster(spark, sf), f, "n_basins long, n_watershed long")


@query("slic")
def slic(spark, sf):
    def f(a):
        out = K.merge_small(K.superpixels(a), max(8, a.shape[0] * a.shape[1] // 400))
        return {"slic_labels": int(len(np.unique(out)))}

    return per_image(A.event_rgb(spark, sf), f, "slic_labels long")


@query("fh_segments")
def fh_segments(spark, sf):
    return per_image(A.event_rgb(spark, sf), lambda a: {"fh_labels": int(K.graph_segments(K.lab(a)).max()) + 1}, "fh_labels long")


@query("graph_cut")
def graph_cut(spark, sf):
    return per_image(A.event_rgb(spark, sf), lambda a: {"fg_pixels": int(K.graph_cut(K.lab(a), (4, 8, 20, 40)).sum())}, "fg_pixels long")


@query("kmeans_lab")
def kmeans_lab(spark, sf):
    return per_image(A.event_rgb(spark, sf), lambda a: {"spread": round(float(np.ptp(K.lloyd(K.lab(a).reshape(-1, 3), 4))), 3)}, "spread double")


@query("max_flow")
def max_flow(spark, sf):
    def f(a):
        h, w = a.shape
        g = K.Flow(h * w + 2)
        for y in range(h):
            g.edge(h * w, y * w, 1e9)
            g.edge(y * w + w - 1, h * w + 1, 1e9)
            for x in range(w - 1):
                g.edge(y * w + x, y * w + x + 1, 1.0 + a[y, x])
        return {"flow": round(g.run(h * w, h * w + 1), 3)}

    return per_image(A.event_raster(spark, sf), f, "flow double")


ORACLES["max_flow"] = f"WITH {PX} SELECT image, round(CAST(sum(m) AS DOUBLE), 3) AS flow FROM (SELECT image, y, min(v) + 1 AS m FROM px WHERE x < 30 GROUP BY 1, 2) GROUP BY image"


@query("region_colouring")
def region_colouring(spark, sf):
    """op C17 over the adjacency graph, whose edges are made relationally first."""
    edges = D.adjacency(A.event_raster(spark, sf).withColumn("label", F.expr("cast(v div 50 as int)")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(pdf.a) | set(pdf.b))
        c = K.colour_graph(list(zip(pdf.a, pdf.b, strict=True)), nodes)
        return pd.DataFrame({"image": [pdf.image.iloc[0]], "n_faces": [len(nodes)], "n_adj": [len(pdf)], "conflicts": [sum(c[p] == c[q] for p, q in zip(pdf.a, pdf.b, strict=True))]})

    return edges.groupBy("image").applyInPandas(run, "image string, n_faces long, n_adj long, conflicts long")


@query("livewire")
def livewire(spark, sf):
    def f(a):
        m = K.components(a > 60)
        ring = K.trace_boundary(m == np.bincount(m.ravel())[1:].argmax() + 1) if m.any() else np.zeros((0, 2), int)
        seeds = K.seeds_along(ring, 12)
        return {"n_seeds": len(seeds), "n_points": len(K.trace_through(K.livewire_cost(a), seeds))}

    return per_image(A.event_raster(spark, sf), f, "n_seeds long, n_points long")


@query("moore_trace")
def moore_trace(spark, sf):
    def f(a):
        m = K.components(a > 60)
        out = []
        for k in range(1, int(m.max()) + 1):
            p = K.trace_boundary(m == k)
            out.append({"comp": k, "n_points": len(p), "pixels": int((m == k).sum())})
        return out

    return per_image(A.event_raster(spark, sf), f, "comp long, n_points long, pixels long").groupBy("image").agg(big(F.count("*"), "components"), big(F.sum("n_points"), "n_points"), big(F.sum("pixels"), "pixels"))


@query("marching_squares_loops")
def marching_squares_loops(spark, sf):
    segments = G.marching_segments(A.event_raster(spark, sf), 90)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        loops = K.stitch(pdf.sort_values(["cy", "cx"])[["ax", "ay", "bx", "by"]].to_numpy())
        area = [abs(float(np.sum(p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]))) / 2 for p in loops]
        return pd.DataFrame({"image": [pdf.image.iloc[0]], "n_loops": [len(loops)], "n_points": [sum(map(len, loops))], "area": [round(max(area, default=0.0), 3)]})

    return segments.groupBy("image").applyInPandas(run, "image string, n_loops long, n_points long, area double")


@query("dual_contouring")
def dual_contouring(spark, sf):
    def f(a):
        v, links = K.dual_contour(a, 90)
        return {"n_vertices": len(v), "n_edges": int(links)}

    return per_image(A.event_raster(spark, sf), f, "n_vertices long, n_edges long")


@query("rdp_simplify")
def rdp_simplify(spark, sf):
    return per_polyline(A.event_polylines(spark, sf), lambda p: {"n_in": len(p), "n_out": int(K.simplify(p, 25.0).sum())}, "n_in long, n_out long")


@query("convex_hull")
def convex_hull(spark, sf):
    def f(p):
        c = K.hull(p)
        area = abs(float(np.sum(c[:, 0] * np.roll(c[:, 1], -1) - np.roll(c[:, 0], -1) * c[:, 1]))) / 2
        return {"hull_n": len(c), "defects": K.defects(p, c), "area": round(area, 3)}

    return per_polyline(A.event_polylines(spark, sf), f, "hull_n long, defects long, area double")


@query("tightness")
def tightness(spark, sf):
    """op E3: hull area over mask area."""

    def f(a):
        ys, xs = np.nonzero(a > 60)
        c = K.hull(np.stack([xs, ys], 1))
        area = abs(float(np.sum(c[:, 0] * np.roll(c[:, 1], -1) - np.roll(c[:, 0], -1) * c[:, 1]))) / 2
        return {"tightness": round(area / max(1, len(xs)), 4)}

    return per_image(A.event_raster(spark, sf), f, "tightness double")


@query("snakes")
def snakes(spark, sf):
    def f(a):
        p = K.snake(a, _box(a > 60))
        return {"n_points": len(p), "area": round(abs(float(np.sum(p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]))) / 2, 2)}

    return per_image(A.event_raster(spark, sf), f, "n_points long, area double")


@query("level_set")
def level_set(spark, sf):
    return per_image(A.event_raster(spark, sf), lambda a: {"inside": int((K.chan_vese(a) < 0).sum())}, "inside long")


@query("tps_rmse")
def tps_rmse(spark, sf):
    def f(p):
        q = p / 500.0
        c = q[:: max(1, len(q) // 16)]
        w = K.thin_plate(c, c)
        return {"n_centers": len(c), "fitted": bool(np.isfinite(w).all()), "rmse": round(float(np.sqrt(np.mean((K.thin_plate_at(c, c, w) - c) ** 2))), 4)}

    return per_polyline(A.event_polylines(spark, sf), f, "n_centers long, fitted boolean, rmse double")


@query("power_spectrum")
def power_spectrum(spark, sf):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = K.power_spectrum(pdf.sort_values("n").s.to_numpy(), 32)
        return pd.DataFrame({"clip": [pdf["clip"].iloc[0]], "frame": [pdf.frame.iloc[0]], "total": [round(float(2 * p.sum() - p[0] - p[-1]), 1)]})

    return _frames(spark, sf).groupBy("clip", "frame").applyInPandas(run, "clip long, frame long, total double")


@query("lpc_formants")
def lpc_formants(spark, sf):
    """op A7 to A11 and I11: from frames to vowels; only the roots are found in NumPy."""
    p = S.packed(_frames(spark, sf, True)).withColumn("a", S.levinson(S.autocorrelation(F.col("xs"), 8), 8)).select("clip", "frame", "a")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"clip": pdf["clip"], "frame": pdf.frame, "poles": [[{"freq": f, "bw": b} for f, b in K.poles(np.array(a), S.RATE)] for a in pdf.a]})

    roots = p.mapInPandas(run, "clip long, frame long, poles array<struct<freq: double, bw: double>>")
    fs = S.repair(F.transform(S.formant_list(F.col("poles")), lambda q: q["freq"]))
    got = roots.withColumn("fs", fs).select("clip", "frame", *(F.coalesce(F.get("fs", i), F.lit(0.0)).alias(f"f{i + 1}") for i in range(3)))
    return S.nearest_vowel(got).groupBy("vowel").agg(big(F.count("*"), "n"))
