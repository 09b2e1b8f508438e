"""Kernels over DataFrames: one call for each image, polyline or clip, in parallel across them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def per_image(px: DataFrame, f: Callable[[np.ndarray], dict | list[dict]], schema: str) -> DataFrame:
    """Rows that f gives for each image's array (h, w), or (h, w, 3) with columns r, g, b; image comes first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf.y.max()) + 1, int(pdf.x.max()) + 1
        cols = ["r", "g", "b"] if "r" in pdf else ["v"]
        a = np.zeros((h, w, len(cols)))
        a[pdf.y, pdf.x] = pdf[cols]
        got = f(a if len(cols) > 1 else a[..., 0])
        return pd.DataFrame([{"image": pdf.image.iloc[0]} | r for r in (got if isinstance(got, list) else [got])], columns=["image", *(c.split()[0] for c in schema.split(", "))])

    return px.groupBy("image").applyInPandas(run, f"image string, {schema}")


def per_polyline(points: DataFrame, f: Callable[[np.ndarray], dict | list[dict]], schema: str) -> DataFrame:
    """Rows that f gives for each polyline's points (n, 2) in order; poly comes first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        got = f(pdf[["x", "y"]].to_numpy(float))
        return pd.DataFrame([{"poly": pdf.poly.iloc[0]} | r for r in (got if isinstance(got, list) else [got])], columns=["poly", *(c.split()[0] for c in schema.split(", "))])

    return points.groupBy("poly").applyInPandas(run, f"poly long, {schema}")
