"""Signals (clip, t, s): framing, energy, linear prediction, formants, vowels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from gridloom.operators.kernels import poles


def along() -> WindowSpec:
    return Window.partitionBy("clip").orderBy("t")


def by_frame() -> WindowSpec:
    return Window.partitionBy("clip").orderBy("frame")


FRAME, HOP, PADDED, RATE = 400, 160, 512, 16000
#: (key, ipa, example, f1, f2, f3, tolerance): fixed values of the vowel table, in its order, by which ties go.
VOWELS = (
    ("IY", "i", "beet", 270.0, 2290.0, 3010.0, 80.0),
    ("IH", "ɪ", "bit", 390.0, 1990.0, 2550.0, 90.0),
    ("EY", "eɪ", "bait", 530.0, 1840.0, 2480.0, 90.0),
    ("EH", "ɛ", "bet", 660.0, 1720.0, 2410.0, 100.0),
    ("AE", "æ", "bat", 730.0, 1090.0, 2440.0, 110.0),
    ("AH", "ʌ", "butt", 640.0, 1190.0, 2390.0, 100.0),
    ("ER", "ɝ", "bird", 490.0, 1350.0, 1690.0, 90.0),
    ("AX", "ə", "about", 500.0, 1500.0, 2500.0, 100.0),
    ("AA", "ɑ", "father", 730.0, 1090.0, 2440.0, 110.0),
    ("AO", "ɔ", "bought", 570.0, 840.0, 2410.0, 100.0),
    ("OW", "oʊ", "boat", 500.0, 1000.0, 2350.0, 90.0),
    ("UH", "ʊ", "book", 440.0, 1020.0, 2240.0, 90.0),
    ("UW", "u", "boot", 300.0, 870.0, 2240.0, 80.0),
    ("UW", "u", "two (fronted)", 360.0, 1300.0, 2200.0, 110.0),
)


def pre_emphasis(samples: DataFrame, a: float = 0.95) -> DataFrame:
    """op A1."""
    return samples.withColumn("s", F.col("s") - a * F.coalesce(F.lag("s").over(along()), F.lit(0.0)))


def hamming(n: Column, size: int) -> Column:
    """op A2."""
    return 0.54 - 0.46 * F.cos(2 * math.pi * n / (size - 1))


def frames(samples: DataFrame, size: int = FRAME, hop: int = HOP, window: bool = True) -> DataFrame:
    """op A3: (clip, frame, n, s) of complete frames; a sample goes to each frame it lies in. t counts from 0."""
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - (size - 1)) / hop)).cast("long")
    last = F.floor(F.col("t") / hop).cast("long")
    f = samples.where(first <= last).select("clip", "t", "s", F.explode(F.sequence(first, last)).alias("frame"))
    f = f.withColumn("n", F.col("t") - F.col("frame") * hop).withColumn("_k", F.count("*").over(Window.partitionBy("clip", "frame"))).where(F.col("_k") == size)
    return f.select("clip", "frame", "n", (F.col("s") * hamming(F.col("n"), size) if window else F.col("s")).alias("s"))


def energy(f: DataFrame, padded: int = PADDED) -> DataFrame:
    """op A5: root of the squares' sum over the padded length."""
    return f.groupBy("clip", "frame").agg(F.sqrt(F.sum(F.col("s") * F.col("s")) / padded).alias("energy"))


def zero_crossing_rate(f: DataFrame, padded: int | None = None) -> DataFrame:
    """op A6: changes of sign (0 counts as positive) over the number of steps, of the padded frame if given."""
    on = (F.col("s") >= 0).cast("int")
    w = Window.partitionBy("clip", "frame").orderBy("n")
    f = f.withColumn("_c", (on != F.lag(on).over(w)).cast("int"))
    steps = F.lit(padded - 1) if padded else F.count("*") - 1
    return f.groupBy("clip", "frame").agg((F.coalesce(F.sum("_c"), F.lit(0)) / F.greatest(F.lit(1), steps)).alias("zcr"))


def packed(f: DataFrame) -> DataFrame:
    """(clip, frame, xs), the samples of each frame as an array."""
    return f.groupBy("clip", "frame").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]).alias("xs"))


def autocorrelation(xs: Column, order: int) -> Column:
    """op A7: lags 0 to order of an array."""

    def lag(k: Column) -> Column:
        n = F.greatest(F.lit(0), F.size(xs) - k)
        return F.aggregate(F.zip_with(F.slice(xs, 1, n), F.slice(xs, k + 1, n), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    return F.transform(F.sequence(F.lit(0), F.lit(order)), lag)


def levinson(r: Column, order: int) -> Column:
    """op A8: prediction coefficients 1, a1 .. a_order from autocorrelations; zeros where r0 isn't positive."""
    start = F.struct(F.array(F.lit(1.0)).alias("a"), F.element_at(r, 1).alias("e"))

    def step(acc: Column, i: Column) -> Column:
        k = -F.aggregate(F.zip_with(acc["a"], F.reverse(F.slice(r, 2, i)), lambda a, x: a * x), F.lit(0.0), lambda s, x: s + x) / acc["e"]
        longer = F.concat(acc["a"], F.array(F.lit(0.0)))
        return F.struct(F.zip_with(longer, F.reverse(longer), lambda a, b: a + k * b).alias("a"), (acc["e"] * (1 - k * k)).alias("e"))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(order)), start, step)["a"]
    return F.when(F.element_at(r, 1) > 0, out).otherwise(F.array_repeat(F.lit(0.0), order + 1))


def formant_list(poles: Column, rate: float = RATE) -> Column:
    """op A10: poles (freq, bw) that may be formants, by frequency."""
    return F.sort_array(F.filter(poles, lambda p: (p["freq"] > 50) & (p["freq"] < rate / 2 - 50) & (p["bw"] < 400)))


def repair(fs: Column) -> Column:
    """op A11: where the first two formants have run together, one is set in between."""
    f1, f2 = F.get(fs, 0), F.get(fs, 1)
    merged = (F.size(fs) >= 2) & (f1 < 650) & (f2 > 1850) & (2.2 * f1 < 1200)
    return F.when(merged, F.concat(F.array(f1, 2.2 * f1), F.slice(fs, 2, F.greatest(F.size(fs) - 1, F.lit(0))))).otherwise(fs)


def gate(rows: DataFrame, share: float = 0.08, least: float = 1.5e-4, zcr: float = 0.35) -> DataFrame:
    """op A12: adds silent, by energy against the clip's largest, crossing rate, and formants f1, f2 if there are such."""
    top = F.max("energy").over(Window.partitionBy("clip"))
    quiet = (F.col("energy") < F.greatest(share * top, F.lit(least))) | (F.col("zcr") > zcr)
    if "f1" in rows.columns:
        quiet = quiet | (F.coalesce("f1", F.lit(0.0)) <= 0) | (F.coalesce("f2", F.lit(0.0)) <= 0)
    return rows.withColumn("silent", quiet)


def upper_median(c: str, w) -> Column:
    """op A13: element n / 2 of the frame's sorted values above 0; 0 if none."""
    xs = F.sort_array(F.filter(F.collect_list(c).over(w), lambda x: x > 0))
    return F.coalesce(F.get(xs, F.floor(F.size(xs) / 2).cast("int")), F.lit(0.0))


def smoothed(rows: DataFrame, *columns: str) -> DataFrame:
    """op A13: the median of three frames, within the clip."""
    return rows.select("*", *(upper_median(c, by_frame().rowsBetween(-1, 1)).alias(f"{c}_smooth") for c in columns))


def bark(f: Column) -> Column:
    """op A14."""
    return 26.81 * f / (1960.0 + f) - 0.53


def vowel_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *v) for i, v in enumerate(VOWELS)], "ord int, key string, ipa string, example string, v1 double, v2 double, v3 double, tolerance double")


def nearest_vowel(rows: DataFrame, f1: str = "f1", f2: str = "f2", f3: str = "f3") -> DataFrame:
    """op I11: adds vowel, vowel_dist and in_bounds; the first of the table among equals. The table is a literal."""
    table = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(v[0]).alias("key"), F.lit(v[3]).alias("v1"), F.lit(v[4]).alias("v2"), F.lit(v[5]).alias("v3"), F.lit(v[6]).alias("tol")) for i, v in enumerate(VOWELS)))
    a, b, c = (F.col(x) for x in (f1, f2, f3))

    def scored(v: Column) -> Column:
        d1, d2, d3 = bark(a) - bark(v["v1"]), bark(b) - bark(v["v2"]), bark(c) - bark(v["v3"])
        third = F.when(F.coalesce(c, F.lit(0.0)) > 0, 0.35 * 0.35 * d3 * d3).otherwise(0.0)
        inside = (F.abs(a - v["v1"]) <= 1.5 * v["tol"]) & (F.abs(b - v["v2"]) <= 2 * v["tol"])
        return F.struct(F.sqrt(1.5 * d1 * d1 + d2 * d2 + third).alias("d"), v["ord"].alias("ord"), v["key"].alias("key"), inside.alias("inside"))

    best = F.array_min(F.transform(table, scored))
    return rows.withColumn("_b", best).select("*", F.col("_b.key").alias("vowel"), F.col("_b.d").alias("vowel_dist"), F.col("_b.inside").alias("in_bounds")).drop("_b")


def collapse_runs(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """op A15: (key, runs, text): each key's values in order with repeats of the one before left out."""
    w = Window.partitionBy(key).orderBy(*order)
    kept = rows.withColumn("_p", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("_p")))
    listed = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return kept.groupBy(key).agg(F.count("*").alias("runs"), F.array_join(F.transform(listed, lambda x: x["_v"]), " ").alias("text"))


def vowel_strings(samples: DataFrame, order: int = 16, size: int = FRAME, hop: int = HOP, rate: float = RATE, limits: tuple[float, float, float] = (0.08, 1.5e-4, 0.35)) -> DataFrame:
    """op A1 to A15, U7: (clip, runs, text), the vowels of each clip (clip, t, s) in order: pre-emphasis, framing, energy and
    crossing gate, linear prediction, poles, formants, median over three frames, nearest vowel, runs put together. A clip
    without a sounding frame has none and isn't listed. limits: as gate() takes them. Only the polynomials' roots are found in NumPy."""
    raw = pre_emphasis(samples)
    framed = frames(raw, size, hop)
    coefficients = packed(framed).select("clip", "frame", levinson(autocorrelation(F.col("xs"), order), order).alias("a"))

    def roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"clip": pdf["clip"], "frame": pdf.frame, "poles": [[{"freq": f, "bw": b} for f, b in poles(np.array(a), rate)] for a in pdf.a]})

    kind = samples.schema["clip"].dataType.simpleString()
    found = coefficients.mapInPandas(roots, f"clip {kind}, frame long, poles array<struct<freq: double, bw: double>>")
    fs = repair(F.transform(formant_list(F.col("poles"), rate), lambda p: p["freq"]))
    f = found.withColumn("_f", fs).select("clip", "frame", *(F.coalesce(F.get("_f", i), F.lit(0.0)).alias(f"f{i + 1}") for i in range(3)))
    sound = energy(framed).join(zero_crossing_rate(framed), ["clip", "frame"]).join(f, ["clip", "frame"])
    kept = smoothed(gate(sound, *limits).where(~F.col("silent")), "f1", "f2", "f3")
    named = nearest_vowel(kept, "f1_smooth", "f2_smooth", "f3_smooth")
    return collapse_runs(named, "clip", ["frame"], "vowel")
