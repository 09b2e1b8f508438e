"""Readers and writers of image, sound, table and annotation files; binary formats are decoded within tasks."""

from __future__ import annotations

import io
import os
import re
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.operators.geometry import spans
from gridloom.operators.raster import luma

IMAGE = "image string, width int, height int, channels int, data binary"
SUFFIXES = ("png", "jpg", "jpeg", "pgm", "ppm", "bmp", "gif")


def list_images(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """op S1: path, length and content of image files, by name whatever the case. Content is read where it is used."""
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in s) for s in SUFFIXES) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def jvm_images(spark: SparkSession, path: str) -> DataFrame:
    """op S2, S3: images that the JVM decodes (png, jpg, bmp, gif), in blue-green-red order."""
    return spark.read.format("image").option("dropInvalid", "true").load(path).select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def decode_netpbm(raw: bytes) -> np.ndarray | None:
    """op S4: P2, P3, P5 and P6 as (h, w, channels) of 8 bits; None for what isn't one."""
    at, fields = 2, []
    kind = raw[:2]
    if kind not in (b"P2", b"P3", b"P5", b"P6"):
        return None
    token = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")
    for _ in range(3):
        m = token.match(raw, at)
        if not m:
            return None
        fields.append(int(m[1]))
        at = m.end()
    w, h, top = fields
    c = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P5", b"P6"):
        v = np.frombuffer(raw, np.uint8 if top < 256 else ">u2", offset=at + 1)
    else:
        v = np.array(re.sub(rb"#[^\n]*", b"", raw[at:]).split(), np.int64)
    if w * h * c > len(v) or not top:
        return None
    return (v[: w * h * c].astype(np.int64) * 255 // top).astype(np.uint8).reshape(h, w, c)


def encode_pgm(a: np.ndarray) -> bytes:
    """op K1."""
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + np.clip(a, 0, 255).astype(np.uint8).tobytes()


def decode_bmp(raw: bytes) -> np.ndarray | None:
    """op S5: uncompressed BMP of 8 or 24 bits as gray (h, w, 1)."""
    if raw[:2] != b"BM" or len(raw) < 54:
        return None
    start, w, h, bits, packing = (int.from_bytes(raw[a:b], "little", signed=True) for a, b in ((10, 14), (18, 22), (22, 26), (28, 30), (30, 34)))
    if bits not in (8, 24) or packing:
        return None
    line = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(raw, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        size = int.from_bytes(raw[14:18], "little")
        table = np.frombuffer(raw, np.uint8, start - 14 - size, 14 + size)
        table = table[: len(table) // 4 * 4].reshape(-1, 4)
        gray = (table[:, :3].astype(int) @ [114, 587, 299] // 1000).astype(np.uint8) if len(table) else np.arange(256, dtype=np.uint8)
        return gray[np.minimum(rows, len(gray) - 1)][..., None]
    p = rows.reshape(abs(h), w, 3).astype(int)
    return (p @ [114, 587, 299] // 1000).astype(np.uint8)[..., None]


def decode_wav(raw: bytes) -> tuple[np.ndarray, int] | None:
    """op S21: mono samples in -1..1 at 16 kHz, by linear interpolation from other rates."""
    try:
        with wave.open(io.BytesIO(raw)) as f:
            c, size, rate, n = f.getnchannels(), f.getsampwidth(), f.getframerate(), f.getnframes()
            data = f.readframes(n)
    except (wave.Error, EOFError):
        return None
    if size == 1:
        s = np.frombuffer(data, np.uint8).astype(float) / 128 - 1
    elif size in (2, 4):
        s = np.frombuffer(data, f"<i{size}").astype(float) / 2.0 ** (8 * size - 1)
    else:
        return None
    s = s[: len(s) // c * c].reshape(-1, c).mean(1)
    if rate != 16000 and len(s):
        s = np.interp(np.arange(int(len(s) * 16000 / rate)) * rate / 16000, np.arange(len(s)), s)
    return s, 16000


def decode_images(files: DataFrame) -> DataFrame:
    """op S6: (path, content) as images, by the name's end; files that can't be decoded give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf.path, pdf.content, strict=True):
                a = decode_bmp(raw) if path.lower().endswith(".bmp") else decode_netpbm(raw)
                if a is not None:
                    rows.append((path, a.shape[1], a.shape[0], a.shape[2], a.tobytes()))
            yield pd.DataFrame(rows, columns=["image", "width", "height", "channels", "data"])

    return files.select("path", "content").mapInPandas(run, IMAGE)


def to_pixels(images: DataFrame) -> DataFrame:
    """Long pixels (image, y, x, c, v) of decoded images."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for image, width, channels, data in zip(pdf.image, pdf.width, pdf.channels, pdf.data, strict=True):
                v = np.frombuffer(data, np.uint8)
                for at in range(0, len(v), 1 << 20):  # a large image in parts
                    k = np.arange(at, min(at + (1 << 20), len(v)))
                    yield pd.DataFrame({"image": image, "y": (k // (width * channels)).astype(np.int32), "x": (k // channels % width).astype(np.int32), "c": (k % channels).astype(np.int32), "v": v[k].astype(np.int32)})

    return images.select("image", "width", "channels", "data").mapInPandas(run, "image string, y int, x int, c int, v int")


def gray(pixels: DataFrame) -> DataFrame:
    """op S2: pixels (image, y, x, c, v) as gray (image, y, x, v): one channel as it is, of three the luma."""
    p = pixels.groupBy("image", "y", "x").agg(*(F.max(F.when(F.col("c") == k, F.col("v"))).alias(f"c{k}") for k in range(3)))
    return p.select("image", "y", "x", F.when(F.col("c2").isNull(), F.col("c0")).otherwise(luma(F.col("c0"), F.col("c1"), F.col("c2"))).alias("v"))


def audio(files: DataFrame) -> DataFrame:
    """op S21: of (path, content), the samples (clip, t, s) of WAV files at 16 kHz; clip is the path. Others give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf.path, pdf.content, strict=True):
                found = decode_wav(raw)
                if found is not None:
                    s = found[0]
                    for at in range(0, len(s), 1 << 20):
                        part = s[at : at + (1 << 20)]
                        yield pd.DataFrame({"clip": path, "t": np.arange(at, at + len(part)), "s": part})

    return files.select("path", "content").mapInPandas(run, "clip string, t long, s double")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """op S9: (path, text), each file's whole text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def write_tables(rows: DataFrame, folder: str, by: str, suffix: str = ".tsv") -> DataFrame:
    """op K5: a TSV file below folder for each value of `by`, with a header, rows in their columns' order; gives path, bytes."""
    names = [c for c in rows.columns if c != by]
    line = F.concat_ws("\t", *(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\t\r\n]", " ") for c in names))
    files = rows.groupBy(by).agg(F.sort_array(F.collect_list(line)).alias("l"))
    text = F.concat(F.lit("\t".join(names) + "\n"), F.array_join("l", "\n"), F.lit("\n"))
    return write_files(files.select(F.concat(F.col(by).cast("string"), F.lit(suffix)).alias("path"), text.cast("binary").alias("content")), folder)


def manifest(written: DataFrame, title: str) -> DataFrame:
    """op K6: one row (title, files, bytes, json) that sums up files (path, bytes) as a JSON document."""
    listed = F.sort_array(F.collect_list(F.struct("path", "bytes")))
    one = written.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), listed.alias("entries"))
    return one.select(F.lit(title).alias("title"), "files", "bytes", F.to_json(F.struct(F.lit(title).alias("title"), "files", "bytes", "entries")).alias("json"))


def rendered(paths: DataFrame, folder: str) -> DataFrame:
    """op K8: (atom, kind, path), of written files atom__kind.suffix below folder."""
    stem = F.regexp_extract("path", r"([^/]*?)\.[^./]*$", 1)
    return paths.select(F.split(stem, "__")[0].alias("atom"), F.coalesce(F.get(F.split(stem, "__"), 1), F.lit("")).alias("kind"), F.concat(F.lit(folder.rstrip("/") + "/"), "path").alias("path"))


def to_pgm(px: DataFrame) -> DataFrame:
    """op K1, K2: (path, content), a PGM file of each image; write with write_files()."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1))
        a[pdf.y, pdf.x] = pdf.v
        return pd.DataFrame({"path": [f"{pdf.image.iloc[0]}.pgm"], "content": [encode_pgm(a)]})

    return px.groupBy("image").applyInPandas(run, "path string, content binary")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """op K1: writes each (path, content) below a folder that executors share; gives path and bytes. A retried task
    writes the same files again, each through a name of its own that then takes the place of the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content, strict=True):
                full = os.path.join(folder, name)
                with open(f"{full}.{os.getpid()}.part", "wb") as f:
                    f.write(content)
                os.replace(f"{full}.{os.getpid()}.part", full)
            yield pd.DataFrame({"path": pdf.path, "bytes": pdf.content.map(len)})

    return files.mapInPandas(run, "path string, bytes long")


def svg(points: DataFrame, width: int, height: int) -> DataFrame:
    """op K3: (poly, svg), each polyline as a drawing."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("i", "x", "y"))), lambda p: F.concat_ws(",", F.round(p["x"], 2), F.round(p["y"], 2)))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><polygon fill="none" stroke="black" points="'
    return points.groupBy("poly").agg(F.concat(F.lit(head), F.array_join(listed, " "), F.lit('"/></svg>')).alias("svg"))


def reports(rows: DataFrame, key: str) -> DataFrame:
    """op K4: (key, json), each row as a JSON document."""
    return rows.select(key, F.to_json(F.struct("*")).alias("json"))


def overlay(px: DataFrame, ink: DataFrame, value: int = 255) -> DataFrame:
    """op K7: pixels at half their value, ink (image, y, x) drawn over them."""
    marked = ink.select("image", "y", "x", F.lit(1).alias("_i")).distinct()
    return px.join(marked, ["image", "y", "x"], "left").withColumn("v", F.when(F.col("_i").isNotNull(), value).otherwise(F.expr("cast(v div 2 as int)"))).drop("_i")


def label_boundaries(labels: DataFrame, value: int = 255) -> DataFrame:
    """op K7: (image, y, x, label) with v `value` where the right or lower neighbour has another label, else 0."""
    right, down = (F.lead("label").over(Window.partitionBy("image", a).orderBy(b)) for a, b in (("y", "x"), ("x", "y")))
    edge = F.coalesce(right != F.col("label"), F.lit(False)) | F.coalesce(down != F.col("label"), F.lit(False))
    return labels.withColumn("v", F.when(edge, value).otherwise(0))


def box_ink(boxes: DataFrame) -> DataFrame:
    """op K7: (image, y, x) of the sides of boxes (image, x, y, w, h) of whole numbers, for overlay()."""
    b = boxes.select("image", *(F.col(c).cast("int").alias(c) for c in "xywh"))
    rows = b.select("image", "x", "w", F.explode(F.expr("array(y, y + h - 1)")).alias("y")).select("image", "y", F.explode(F.expr("sequence(x, x + w - 1)")).alias("x"))
    columns = b.select("image", "y", "h", F.explode(F.expr("array(x, x + w - 1)")).alias("x")).select("image", F.explode(F.expr("sequence(y, y + h - 1)")).alias("y"), "x")
    return rows.unionByName(columns).distinct()


def label_colour(label: Column) -> Column:
    """op K7."""
    return F.when(label > 0, 40 + (label * 47) % 200).otherwise(0)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """op S7: rows after the header as file, label, extra and all fields; blank lines and carriage returns go. Lines are
    read in parallel; a file's first line is the one that begins where the file does."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("at"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("k"), F.input_file_name().alias("f"))
    first = lines.where("at = 0").groupBy("f").agg(F.min("k").alias("k"))
    return tsv_rows(lines.join(F.broadcast(first), ["f", "k"], "left_anti"))


def tsv_rows(lines: DataFrame) -> DataFrame:
    line = F.regexp_replace("line", "\r", "")
    f = lines.where(F.trim(line) != "").select(F.split(line, "\t").alias("fields"))
    return f.select(F.get("fields", 0).alias("file"), F.get("fields", 1).alias("label"), F.get("fields", 2).alias("extra"), "fields")


def xy_points(docs: DataFrame, column: str) -> DataFrame:
    """op S8: adds poly points (i, x, y) from JSON texts that hold "x" and "y" pairs anywhere."""
    xs = F.regexp_extract_all(F.col(column), F.lit(r'"x"\s*:\s*(-?[0-9.eE+-]+)'), F.lit(1))
    ys = F.regexp_extract_all(F.col(column), F.lit(r'"y"\s*:\s*(-?[0-9.eE+-]+)'), F.lit(1))
    both = F.arrays_zip(xs.alias("x"), ys.alias("y"))
    return docs.select("*", F.posexplode(both).alias("i", "_p")).withColumn("x", F.col("_p.x").cast("double")).withColumn("y", F.col("_p.y").cast("double")).drop("_p").where("x is not null and y is not null")


COCO = "images array<struct<id: long, file_name: string, width: int, height: int>>, annotations array<struct<image_id: long, category_id: int, segmentation: array<array<double>>, bbox: array<double>>>"


def coco_polygons(index: DataFrame) -> DataFrame:
    """op S10, S11: of rows (images, annotations), the rings as polylines: image_id, stem, width, height, poly, i, x, y.
    All rings of an annotation count."""
    images = index.select(F.explode("images").alias("m")).select(F.col("m.id").alias("image_id"), F.regexp_replace("m.file_name", r"\.[^.]*$", "").alias("stem"), "m.width", "m.height")
    rings = index.select(F.posexplode("annotations").alias("k", "a")).select("k", F.col("a.image_id").alias("image_id"), F.posexplode("a.segmentation").alias("r", "ring"))
    rings = rings.withColumn("poly", F.xxhash64("image_id", "k", "r")).withColumn("i", F.explode(F.expr("sequence(0, cast(size(ring) / 2 as int) - 1)")))
    rings = rings.where("size(ring) >= 6").withColumn("x", F.expr("ring[2 * i]")).withColumn("y", F.expr("ring[2 * i + 1]")).drop("ring")
    return rings.join(images, "image_id")


def coco_mask(polygons: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """op S12: (stem, y, x) of the pixels in any ring of an image, within width and height, or else the image's own. Runs get
    their stem and lose what earlier runs of the row cover before they become pixels, so no pixel is joined, shuffled or
    compared."""
    inside = spans(polygons, F.col("width") if width is None else width, F.col("height") if height is None else height)
    inside = inside.join(polygons.select("poly", "stem").distinct(), "poly").select("stem", "y", "x0", "x1")
    before = F.max("x1").over(Window.partitionBy("stem", "y").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1))
    fresh = inside.withColumn("x0", F.greatest("x0", before + 1)).where("x0 <= x1")
    return fresh.select("stem", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def prefixes(stem: Column) -> Column:
    """All beginnings of a stem, itself among them; none of an empty one."""
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(stem), F.lit(1))), lambda n: F.substr(stem, F.lit(1), n)), lambda x: x != "")


def pair_by_stem(images: DataFrame, truths: DataFrame, by_prefix: bool = True) -> DataFrame:
    """op S16: each image path with the ground truth of the same stem, or that with a known ending, in this order, or else,
    by_prefix, the first one whose stem begins with the image's (so that 2 gets 21 where nothing is named after 2)."""
    stem = lambda c: F.regexp_extract(c, r"([^/]*?)(?:\.[^./]*)?$", 1)
    ends = ("", "_mask", "_gt", "-mask", "_label")
    wanted = F.array(*(F.struct(F.lit(k).alias("k"), F.concat(stem("path"), F.lit(e)).alias("s")) for k, e in enumerate(ends)))
    a = images.select("path", F.explode(wanted).alias("w")).select("path", "w.*")
    b = truths.select(F.col("path").alias("gt_path"), stem("path").alias("s"))
    found = a.join(b, "s").select("path", "k", "gt_path")
    if by_prefix:
        rest = images.join(found, "path", "left_anti").select("path", stem("path").alias("s"))
        cut = b.select("gt_path", F.explode(prefixes(F.col("s"))).alias("s"))
        found = found.unionAll(rest.join(cut, "s").select("path", F.lit(len(ends)).alias("k"), "gt_path"))
    found = found.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("k", "gt_path"))).where("_n = 1").select("path", "gt_path")
    return images.select("path").join(found, "path", "left")


#: Folders of images and of truths by data set (op S17).
LAYOUTS = {
    "ade20k": ("images", "annotations"),
    "bsds500": ("BSR/BSDS500/data/images", "bench/data/png"),
    "coco": ("val2017", None),
    "dis5k": ("images", "masks"),
    "lvis": ("lvis_subset_images", None),
    "sbd": ("dataset/img", "dataset/inst"),
}


ALIASES = {"ade": "ade20k", "bsds": "bsds500", "bsd": "bsds500", "dis": "dis5k", "ms_coco": "coco", "mscoco": "coco"}


def resolved(spark: SparkSession, folder: str, inner: str) -> str | None:
    """op S15, S25: the folder below `folder` by the names of inner, whatever their case; null if there is none."""
    j = spark._jvm.org.apache.hadoop.fs
    at = j.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for name in inner.split("/"):
        if not fs.exists(at):
            return None
        found = sorted(x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory() and x.getPath().getName().lower() == name.lower())
        if not found:
            return None
        at = j.Path(at, name if name in found else found[0])
    return at.toString()


def dataset(spark: SparkSession, name: str, root: str) -> DataFrame:
    """op S13, S14, S15, S17: path and gt_path of a data set under a root folder, by name or alias, whatever the case of
    both. Without its folder, no rows: use synthetic rasters instead. Raises ValueError for other names."""
    key = ALIASES.get(name.lower(), name.lower())
    if key not in LAYOUTS:
        raise ValueError(f"no data set is named {name!r}; there are {', '.join(LAYOUTS)}")
    images, truths = (x and resolved(spark, root, x) for x in LAYOUTS[key])
    if images is None:
        return spark.createDataFrame([], "path string, gt_path string")
    left = list_images(spark, images).select("path")
    return pair_by_stem(left, list_images(spark, truths).select("path")) if truths else left.withColumn("gt_path", F.lit(None).cast("string"))


class RasterSource(DataSource):
    """op U3, S13: closed-form rasters and boxes as a Python data source: spark.read.format("gridloom").option("name", ...)."""

    @classmethod
    def name(cls) -> str:
        return "gridloom"

    def schema(self) -> str:
        return "image string, y int, x int, v int"

    def reader(self, schema) -> DataSourceReader:
        return RasterReader(dict(self.options))


class RasterReader(DataSourceReader):
    """Rows of a disk or a ring: options name, size, radius, hole; each partition has a band of lines."""

    def __init__(self, options: dict):
        self.image = options.get("name", "disk")
        self.size, self.radius, self.hole = (int(options.get(k, d)) for k, d in (("size", 64), ("radius", 20), ("hole", -1)))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(y) for y in range(0, self.size, 256)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        c = self.size // 2
        for y in range(partition.value, min(partition.value + 256, self.size)):
            for x in range(self.size):
                d = (x - c) ** 2 + (y - c) ** 2
                yield self.image, y, x, 255 if self.hole**2 * (self.hole >= 0) - (self.hole < 0) < d <= self.radius**2 else 0


def sample_list(rows: DataFrame, contains: str = "", most: int | None = None) -> DataFrame:
    """op S23, S24: rows whose file holds a text; label from the file's name up to the first _ where it has none. `most`
    is the caller's own cap on samples."""
    stem = F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1)
    out = rows.where(F.col("file").contains(contains)).withColumn("label", F.coalesce("label", F.split(stem, "_")[0]))
    return out.orderBy("file").limit(most) if most else out
