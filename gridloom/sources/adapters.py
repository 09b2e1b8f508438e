"""Rasters, signals, polylines, boxes and vectors out of the driver's tables, and closed-form rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

W, H = 31, 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for each event type: row user mod 64, column day of the month, value 60 for each event, 255 at most."""
    e = read(spark, sf_dir, "events")
    n = e.groupBy(F.col("event_type").alias("image"), F.expr("cast(user_id % 64 as int)").alias("y"), (F.dayofmonth("ts") - 1).alias("x")).count()
    images = e.select(F.col("event_type").alias("image")).distinct()
    grid = images.select("image", F.explode(F.sequence(F.lit(0), F.lit(H - 1))).alias("y")).select("image", "y", F.explode(F.sequence(F.lit(0), F.lit(W - 1))).alias("x"))
    return grid.join(n, ["image", "y", "x"], "left").select("image", "y", "x", F.least(F.lit(255), F.coalesce(60 * F.col("count"), F.lit(0))).cast("int").alias("v"))


def event_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_raster() as colours: r the value, g and b turned by row and column."""
    px = event_raster(spark, sf_dir)
    return px.select("image", "y", "x", F.col("v").alias("r"), ((F.col("v") + 4 * F.col("y")) % 256).alias("g"), ((F.col("v") + 8 * F.col("x")) % 256).alias("b"))


def event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip for each user: the events' values about their middle, in order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), (F.row_number().over(w) - 1).cast("long").alias("t"), (F.col("value") - 245.0).alias("s"))


def event_polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed polyline for each user: hour of the month across, value up, in order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = (F.dayofmonth("ts") * 24 + F.hour("ts")).cast("double")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("poly"), (F.row_number().over(w) - 1).alias("i"), x.alias("x"), F.col("value").alias("y"))


def event_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each user and event type: days across, values up."""
    e = read(spark, sf_dir, "events")
    kinds = F.array_position(F.array(*map(F.lit, ("click", "login", "purchase", "search", "view", "signup", "logout", "error"))), F.col("event_type"))
    g = e.groupBy((F.col("user_id") * 100 + kinds).alias("id")).agg(F.min(F.dayofmonth("ts")).cast("double").alias("x"), F.max(F.dayofmonth("ts")).cast("double").alias("x1"), F.min("value").alias("y"), F.max("value").alias("y1"))
    return g.select("id", "x", "y", (F.col("x1") - F.col("x") + 1).alias("w"), (F.col("y1") - F.col("y")).alias("h"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


# ---- closed forms (op S18, S19, S20)


def grid(spark: SparkSession, w: int, h: int, image: str) -> DataFrame:
    out = spark.range(w * h).select(F.lit(image).alias("image"), F.expr(f"cast(id div {w} as int)").alias("y"), F.expr(f"cast(id % {w} as int)").alias("x"))
    return out


def disk(cx: int, cy: int, r: int):
    return (F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy) <= r * r


def synthetic(spark: SparkSession, name: str) -> DataFrame:
    """op S14, S18: a named raster by its pixels' formula. Raises ValueError for a name that isn't known."""
    x, y = F.col("x"), F.col("y")
    star = disk(109, 64, 14) | disk(77, 106, 14) | disk(27, 90, 14) | disk(27, 37, 14) | disk(77, 21, 14)
    d32 = (x - 32) * (x - 32) + (y - 32) * (y - 32)
    made = {
        "donut": (128, 128, disk(64, 64, 42) & ~disk(64, 64, 21)),
        "nested_donut": (128, 128, None),
        "concave_star": (128, 128, star),
        "blob": (128, 128, disk(64, 64, 32)),
        "crescent": (128, 128, disk(72, 64, 42) & ~disk(56, 64, 42)),
        "glyph_O": (64, 64, (d32 >= 100) & (d32 <= 400)),
        "glyph_1": (64, 64, (x == 32) & y.between(8, 56)),
        "sine_band": (128, 128, F.abs(y - (64 + 20 * F.sin(3 * 2 * 3.141592653589793 * x / 128))) < 2.5),
    }
    if name not in made:
        raise ValueError(f"no synthetic raster is named {name!r}; there are {', '.join(sorted(made))}")
    w, h, on = made[name]
    v = F.when(on, 255).otherwise(0) if on is not None else F.when(disk(64, 64, 16), 128).when(disk(64, 64, 42), 255).otherwise(0)
    return grid(spark, w, h, name).withColumn("v", v)


def synthetic_boxes(spark: SparkSession, n: int = 32) -> DataFrame:
    """op S19."""
    return spark.range(n).selectExpr("id", "cast(37 * id % 400 as double) x", "cast(53 * id % 400 as double) y", "cast(30 + 11 * id % 40 as double) w", "cast(20 + 17 * id % 50 as double) h")
