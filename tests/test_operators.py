"""Operators on closed forms, invariants of kernels, and queries against their SQL."""

import json
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gridloom.operators import fields as D
from gridloom.operators import geometry as G
from gridloom.operators import kernels as K
from gridloom.operators import raster as R
from gridloom.operators import signal as S
from gridloom.operators import similarity as I
from gridloom.plans import registry
from gridloom.plans.store import write
from gridloom.sources import adapters as A
from gridloom.sources import formats as O

SF = "/root/testdata/sf0.001"
SOME = ["sobel_energy", "signed_edt_minmax", "rag_edges", "hu_moments", "resample_64", "rect_intersects_grid", "knn_exact", "frames_hamming_rms", "vowel_argmin", "run_collapse", "netpbm_round_trip", "stream_sliding", "stream_sessions", "stream_pre_emphasis", "mask_iou", "ccl_components", "canny_edges", "euler_synthetic", "edt_to_fg", "signed_chamfer", "chamfer_closed_form", "evaluate_mask", "evaluate_polyline", "pad_grow", "gradient_between", "token_errors", "label_edges", "convex_hull", "tightness", "turning_function", "crease_spine", "delta_e_gradient", "power_spectrum", "region_colouring", "dual_contouring"]


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    cols = list(want.columns)
    want, got = (d.sort_values(cols).reset_index(drop=True) for d in (want, got))
    assert len(want) and want.astype(str).equals(got.astype(str))


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_circle_distance_is_analytic(spark):
    px = A.synthetic(spark, "blob")
    sdf = D.signed_distance(px).withColumn("c", D.circle_sdf(F.col("x"), F.col("y"), 64, 64, 32))
    assert sdf.agg(F.max(F.abs(F.col("sdf") - F.col("c")))).first()[0] <= 1.0
    assert sdf.where("(v > 127) <> (sdf < 0)").isEmpty()


def test_unknown_synthetic_raster(spark):
    with pytest.raises(ValueError):
        A.synthetic(spark, "nothing")


def test_components_match_a_flood_fill(spark):
    px = registry.raster_queries.A.event_raster(spark, SF)
    one = D.connected_components(px, R.foreground(100))
    spread = D.connected_components_spread(px, R.foreground(100), True, write).select(one.columns)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, spread.collect()))
    got = one.groupBy("image").agg(F.countDistinct("comp").alias("n")).collect()
    p = px.toPandas()
    for r in got:
        own = p[p.image == r.image]
        a = np.zeros((64, 31))
        a[own.y, own.x] = own.v
        assert K.components(a > 100).max() == r.n


def test_hull_relation_agrees_with_the_kernel(spark):
    rng = np.random.default_rng(1)
    p = rng.integers(0, 30, (25, 2))
    df = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(p.tolist())], "poly long, i int, x double, y double")
    edges = {(r.ax, r.ay) for r in G.hull_edges(df).collect()}
    assert {tuple(map(float, c)) for c in K.hull(p)} <= edges


def test_box_join_equals_brute_force(spark):
    b = A.synthetic_boxes(spark)
    pairs = lambda d: sorted(map(tuple, d.collect()))
    assert pairs(G.box_join(b, b, 37.0)) == pairs(G.box_join_brute(b, b))


def test_levinson_recovers_a_prediction(spark):
    a, x = [1.3, -0.7], [1.0, 0.5]
    rng = np.random.default_rng(0)
    for e in rng.normal(size=4000):
        x.append(float(a[0] * x[-1] + a[1] * x[-2] + e))
    got = spark.createDataFrame([(x,)], "xs array<double>").select(S.levinson(S.autocorrelation(F.col("xs"), 2), 2)).first()[0]
    assert np.allclose(got, [1, -1.3, 0.7], atol=0.06)
    assert len(K.poles(np.array(got), 16000)) == 1


def test_kernels_keep_their_invariants():
    yy, xx = np.mgrid[:40, :40]
    disk = (xx - 20) ** 2 + (yy - 20) ** 2 <= 100
    ring = K.trace_boundary(disk)
    assert (np.abs(np.diff(np.concatenate([ring, ring[:1]]), axis=0)).max(1) == 1).all()
    assert all(disk[y, x] for x, y in ring)
    edt = K.distance_to(~disk)
    brute = min(np.hypot(20 - x, 20 - y) for y, x in zip(*np.nonzero(~disk), strict=True))
    assert edt[20, 20] == pytest.approx(brute)
    two = ((xx - 12) ** 2 + (yy - 20) ** 2 <= 64) | ((xx - 27) ** 2 + (yy - 20) ** 2 <= 64)
    assert K.watershed_of_mask(two).max() == 2
    line = np.stack([np.arange(50.0), np.zeros(50)], 1)
    assert K.simplify(line, 0.5).sum() == 2
    g = K.Flow(4)
    for a, b, r in ((0, 1, 3), (0, 2, 2), (1, 2, 1), (1, 3, 2), (2, 3, 4)):
        g.edge(a, b, r)
    assert g.run(0, 3) == pytest.approx(5)
    c = K.colour_graph([(0, 1), (1, 2), (2, 0), (2, 3)], [0, 1, 2, 3])
    assert all(c[a] != c[b] for a, b in ((0, 1), (1, 2), (2, 0), (2, 3)))
    image = np.where(disk[..., None], 200.0, 20.0).repeat(3, 2)
    assert (K.graph_cut(image, (8, 8, 24, 24)) == disk).mean() > 0.98
    assert len(np.unique(K.graph_segments(image))) == 2
    phi = K.chan_vese(np.where(disk, 255, 0))
    assert ((phi < 0) == disk).mean() > 0.95
    path = K.shortest_path(np.ones((10, 10)), (0, 0), (9, 9))
    assert path[0] == (0, 0) and path[-1] == (9, 9) and len(path) == 10


def test_marching_squares_close_around_a_disk(spark):
    field = A.grid(spark, 20, 20, "g").withColumn("v", D.circle_sdf(F.col("x"), F.col("y"), 10, 10, 5.3))
    rows = G.marching_segments(field, 0.0).toPandas()
    loops = K.stitch(rows[["ax", "ay", "bx", "by"]].to_numpy())
    p = loops[0]
    area = abs(np.sum(p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1])) / 2
    assert len(loops) == 1 and area == pytest.approx(np.pi * 5.3**2, rel=0.05)


def test_image_formats(spark, tmp_path):
    a = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    assert (O.decode_netpbm(O.encode_pgm(a))[..., 0] == a).all()
    text = b"P2\n# note\n4 3\n255\n" + b" ".join(str(v).encode() for v in a.ravel())
    assert (O.decode_netpbm(text)[..., 0] == a).all()
    line = b"".join(bytes([v, v, v]) for v in a[0])
    bmp = b"BM" + (54 + 12).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (4).to_bytes(4, "little") + (1).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24) + line
    assert (O.decode_bmp(bmp)[0, :, 0] == a[0]).all()
    assert O.decode_netpbm(b"nothing") is None and O.decode_bmp(b"BM") is None and O.decode_wav(b"RIFF") is None
    (tmp_path / "one.pgm").write_bytes(O.encode_pgm(a))
    (tmp_path / "index.tsv").write_bytes(b"file\tlabel\r\none.pgm\tx\textra\r\n\r\n")
    px = O.to_pixels(O.decode_images(O.list_images(spark, str(tmp_path))))
    assert px.count() == 12 and px.agg(F.sum("v")).first()[0] == a.sum()
    assert O.read_tsv(spark, str(tmp_path / "index.tsv")).select("file", "label", "extra").collect() == [("one.pgm", "x", "extra")]


def test_wav_files_to_vowels(spark, tmp_path):
    """Two made-up vowels, by resonances at their formants, with silence between them."""
    import wave

    rng = np.random.default_rng(2)

    def vowel(formants, n=8000):
        s = np.zeros(n)
        s[::133] = 1.0  # a voice of 120 Hz
        for f in formants:
            r, w = np.exp(-np.pi * 70 / S.RATE), 2 * np.pi * f / S.RATE
            out = np.zeros(n)
            for i in range(n):
                out[i] = s[i] + 2 * r * np.cos(w) * (out[i - 1] if i else 0) - r * r * (out[i - 2] if i > 1 else 0)
            s = out
        return s / np.abs(s).max()

    quiet = 1e-5 * rng.normal(size=4000)
    for name, order in (("one", (4, 3)), ("two", (3, 4))):
        s = np.concatenate([quiet, *(np.concatenate([vowel(S.VOWELS[k][3:6]), quiet]) for k in order)])
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as f:
            f.setparams((1, 2, S.RATE, 0, "NONE", ""))
            f.writeframes((s * 30000).astype("<i2").tobytes())
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(str(tmp_path)).select("path", "content")
    got = {r["clip"].rsplit("/", 1)[1]: r.text.split() for r in S.vowel_strings(O.audio(files)).collect()}
    assert got == {"one.wav": ["AE", "EH"], "two.wav": ["EH", "AE"]}
    assert O.audio(files.withColumn("content", F.lit(b"no sound"))).count() == 0


def test_data_sets_and_sinks(spark, tmp_path):
    for folder, names in (("Images", ("a1.PGM", "b2.pgm", "c3.pgm")), ("masks", ("a1.pgm", "b2-x7.pgm"))):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_bytes(O.encode_pgm(np.arange(6).reshape(2, 3)))
    rows = {r.path.rsplit("/", 1)[1]: r.gt_path and r.gt_path.rsplit("/", 1)[1] for r in O.dataset(spark, "DIS", str(tmp_path)).collect()}
    assert rows == {"a1.PGM": "a1.pgm", "b2.pgm": "b2-x7.pgm", "c3.pgm": None}
    assert O.dataset(spark, "coco", str(tmp_path)).count() == 0 and O.resolved(spark, str(tmp_path), "nothing") is None
    with pytest.raises(ValueError):
        O.dataset(spark, "unknown", str(tmp_path))
    image = O.decode_images(O.list_images(spark, str(tmp_path / "masks")))
    assert sorted(r.v for r in O.gray(O.to_pixels(image)).collect()) == sorted([*range(6)] * 2)
    rows = spark.createDataFrame([("iou", "a", 1.5), ("iou", "b\tc", None), ("f1", "a", 2.0)], "atom string, name string, score double")
    written = O.write_tables(rows, str(tmp_path / "out"), "atom")
    sizes = {r.path: r.bytes for r in written.collect()}
    assert (tmp_path / "out" / "iou.tsv").read_text().splitlines() == ["name\tscore", "a\t1.5", "b c\t"] and set(sizes) == {"iou.tsv", "f1.tsv"}
    one = O.manifest(spark.createDataFrame(list(sizes.items()), "path string, bytes long"), "run").first()
    assert (one.files, one.bytes) == (2, sum(sizes.values())) and '"title":"run"' in one.json
    assert O.whole_texts(spark, str(tmp_path / "out")).count() == 2
    names = spark.createDataFrame([("ccl__mask.pgm",), ("edt.pgm",)], "path string")
    assert [tuple(r) for r in O.rendered(names, "/x/").collect()] == [("ccl", "mask", "/x/ccl__mask.pgm"), ("edt", "", "/x/edt.pgm")]


def test_table_lines_are_read_in_parallel(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.tsv").write_text("file\tlabel\textra\n" + "".join(f"{name}{i}.wav\t{i}\tx\r\n\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    got = O.read_tsv(spark, str(tmp_path))
    assert got.count() == 10_000 and got.where("file = 'file'").isEmpty() and got.select("label").distinct().count() == 5000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")


def test_rasters_as_a_data_source(spark):
    spark.dataSource.register(O.RasterSource)
    ring = spark.read.format("gridloom").option("name", "ring").option("size", 300).option("radius", 40).option("hole", 20).load()
    d = (F.col("x") - 150) * (F.col("x") - 150) + (F.col("y") - 150) * (F.col("y") - 150)
    assert ring.count() == 90_000 and ring.where((F.col("v") > 0) != ((d <= 1600) & (d > 400))).isEmpty()
    assert spark.read.format("gridloom").load().where("v > 0").count() == spark.read.format("gridloom").option("hole", 0).load().where("v > 0").count() + 1


def test_box_ink_and_margins(spark):
    boxes = spark.createDataFrame([("i", 1, 2, 4, 3)], "image string, x int, y int, w int, h int")
    assert {(r.y, r.x) for r in O.box_ink(boxes).collect()} == {(y, x) for y in range(2, 5) for x in range(1, 5) if y in (2, 4) or x in (1, 4)}


def test_column_distances_of_sparse_columns():
    rng = np.random.default_rng(1)
    for _ in range(50):
        h = int(rng.integers(1, 40))
        g = np.where(rng.random(h) < 0.4, rng.integers(0, 30, h).astype(float), np.inf)
        dy = np.abs(np.arange(h)[:, None] - np.arange(h)[None])
        with np.errstate(invalid="ignore"):
            square = (g[None] ** 2 + dy**2).min(1)
            chamfer = np.where(np.isinf(g[None]), np.inf, np.maximum(dy, g[None]) + 0.41421356237309515 * np.minimum(dy, g[None])).min(1)
        for metric, want in (("square", square), ("chamfer", chamfer)):
            got = D.column_least(np.arange(h), g, metric)
            assert np.allclose(np.where(np.isnan(got), np.inf, got), want)


def rows_and_sql(spark, name, folder):
    """A query's rows and its SQL's, as text, in order."""
    con = duckdb.connect()
    for f in sorted(folder.glob("*.parquet")):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    want = con.sql(registry.ORACLES[name]).df()
    cols = list(want.columns)
    got = registry.QUERIES[name](spark, str(folder)).toPandas()[cols]
    return [list(map(tuple, d.sort_values(cols).astype(str).to_numpy())) for d in (got, want)]


def test_pairs_by_stem_match_sql(spark, tmp_path):
    duckdb.sql(f"copy (select i as c_custkey from range(-20, 300) t(i) union all select null) to '{tmp_path}/customer.parquet' (format parquet)")
    got, want = rows_and_sql(spark, "pair_by_stem", tmp_path)
    assert len(want) == 321 and got == want
    images, truths = (spark.createDataFrame([(p,) for p in own], "path string") for own in (["a/2.png", "a/3.png"], ["b/21.png", "b/3_gt.png", "b/30.png"]))
    assert sorted(map(tuple, O.pair_by_stem(images, truths).collect())) == [("a/2.png", "b/21.png"), ("a/3.png", "b/3_gt.png")]


def test_correlation_peaks_of_flat_windows_match_sql(spark, tmp_path):
    # a: flat at (8, 0) alone; b: flat everywhere, template too; c: nowhere
    cell = "cast('2024-01-01' as timestamp) + interval (x) day as ts, y as user_id"
    both = "range(64) a(y), range(31) b(x), range(4) c(k)"
    a = f"select {cell}, 'a' as event_type from {both} where k < (x + 2 * y) % 4 and not (y between 8 and 15 and x < 8)"
    c = f"select {cell}, 'c' as event_type from {both} where k < (x * y + x) % 5"
    duckdb.sql(f"copy (select row_number() over () as event_id, * from ({a} union all select {cell}, 'b' from {both} where k = 0 union all {c})) to '{tmp_path}/events.parquet' (format parquet)")
    got, want = rows_and_sql(spark, "ncc_scan_peak", tmp_path)
    assert got == want and [r[3] == "nan" for r in got] == [True, True, False] and got[0][1:3] == ("8", "0")
    px = A.event_raster(spark, str(tmp_path))
    t = px.where("y between 8 and 15 and x between 8 and 15").selectExpr("image", "y - 8 ty", "x - 8 tx", "v tv")
    assert [tuple(r) for r in R.ncc_scan(px, t).orderBy("image").select("image", "peak_ncc").collect()][1] == ("b", 1.0)


def test_masks_of_overlapping_rings_hold_each_pixel_once(spark, tmp_path):
    rings = [[[1, 1, 9, 1, 9, 6, 1, 6], [4, 2, 14, 2, 14, 8, 4, 8]], [[0, 0, 3, 0, 3, 9, 0, 9], [5, 3, 7, 3, 7, 5, 5, 5], [12, 0, 19, 0, 12, 9]]]
    doc = {"images": [{"id": k, "file_name": f"m{k}.jpg", "width": 20, "height": 10} for k in range(2)], "annotations": [{"image_id": k, "segmentation": own} for k, own in enumerate(rings)]}
    polygons = O.coco_polygons(spark.createDataFrame([(json.dumps(doc),)], "j string").select(F.from_json("j", O.COCO).alias("d")).select("d.*"))
    mask = O.coco_mask(polygons, 20, 10)
    got = sorted(map(tuple, mask.select("stem", "y", "x").collect()))
    inside = G.rasterise(polygons.select("poly", "i", "x", "y"), 20, 10).join(polygons.select("poly", "stem").distinct(), "poly")
    assert got == sorted({tuple(r) for r in inside.select("stem", "y", "x").collect()}) and len(got) > 100
    # pixels, which are many times the rows that they are made of, meet no join and no shuffle
    plan = mask._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sequence(x0") < min(plan.index(x) for x in ("Join", "Window"))
    assert not any(x in plan[: plan.index("sequence(x0")] for x in ("Aggregate", "Join"))


def test_coco_masks_match_sql(spark, tmp_path):
    duckdb.sql(f"copy (select i as event_id, i % 700 as user_id, cast((i * 37) % 480 as double) + 0.25 as value from range(3000) t(i)) to '{tmp_path}/events.parquet' (format parquet)")
    got, want = rows_and_sql(spark, "coco_masks", tmp_path)
    assert len(want) == 700 and got == want


def test_coco_masks_beyond_one_width_match_sql(spark, tmp_path):
    # greatest values past 589, where a width of 600 ended, below 0 and missing; events of no user
    duckdb.sql(f"copy (select i as event_id, nullif(i % 40, 39) as user_id, case when i % 40 = 3 then null else (i % 40 - 6) * 55.5 - i // 40 end as value from range(120) t(i)) to '{tmp_path}/events.parquet' (format parquet)")
    got, want = rows_and_sql(spark, "coco_masks", tmp_path)
    assert len(want) == 40 and got == want and len({p for _, p in want}) > 30


def test_cosine_neighbours_match_the_pairwise_metric(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "QUERIES", 7)  # several blocks
    rng = np.random.default_rng(3)
    vecs = rng.integers(-3, 4, (60, 5)).astype(float)
    vecs[20:30], vecs[30:34], vecs[40] = vecs[3], 2 * vecs[5], 0  # copies, multiples, no length
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vecs.tolist())], "id long, vec array<double>")
    queries = rows.where("id % 2 = 0")
    got = {(r.query_id, r["rank"]): r for r in I.cosine_knn(queries, rows, 3).collect()}
    want = I.knn(queries, rows, 3, lambda a, b: 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), I.cosine(a, b)))).collect()
    assert len(got) == len(want) == 90
    assert all(abs(1 - r.dist - got[r.query_id, r["rank"]].cosine) < 1e-12 for r in want)
    assert [got[20, k].id for k in (1, 2, 3)] == [3, 21, 22]  # of equals the least, not the query itself
    assert I.cosine_knn(queries.where("false"), rows, 3).count() == 0
    # queries by rows: no join of vectors
    assert "NestedLoop" not in I.cosine_knn(queries, rows, 3)._jdf.queryExecution().executedPlan().toString()


def test_nearest_in_chunks_equals_all_at_once():
    rng = np.random.default_rng(4)
    vecs, ids = rng.integers(-2, 3, (500, 4)).astype(float), rng.permutation(500)
    one, many = (I.Nearest(ids[:80], vecs[:80], 2) for _ in range(2))
    one.add(ids, vecs)
    for at in range(0, 500, 37):
        many.add(ids[at : at + 37], np.ascontiguousarray(vecs[at : at + 37]))
    assert all((x == y).all() for a, b in zip(one.rows, many.rows, strict=True) for x, y in zip(a, b, strict=True))


def test_cosine_top1_of_repeated_ids_matches_sql(spark, tmp_path):
    rng = np.random.default_rng(6)
    vecs = rng.normal(size=(60, 5))
    rows = [(i, v + 1e-4 * (i % 40 > 0) * rng.normal(size=5)) for i, v in enumerate(vecs) for _ in range(50)]  # as equals, or just near
    rows += [(100 * i + 1, vecs[i]) for i in (0, 40)]
    spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/all")
    next((tmp_path / "all").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    got, want = rows_and_sql(spark, "cosine_top1", tmp_path)
    assert [r[0] for r in want] == ["0", "20", "40"] and {r[1] for r in want} >= {"1", "4001"} and got == want


@pytest.mark.parametrize("n", [1, 60])
def test_cosine_top1_without_vectors_matches_sql(spark, tmp_path, n):
    vec = "case when i not in (20, 21) then [1 + i, (i * i) % 7, 3 - i]::float[] end"
    duckdb.sql(f"copy (select nullif(i, 5) as vec_id, {vec} as embedding from range({n}) t(i)) to '{tmp_path}/embeddings.parquet' (format parquet)")
    got, want = ([tuple(x.removesuffix(".0").replace("<NA>", "nan") for x in r) for r in own] for own in rows_and_sql(spark, "cosine_top1", tmp_path))
    assert [r[0] for r in want] == (["0", "20", "40"] if n > 1 else []) and got == want


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_of_repeated_ids_equal_all_pairs(k):
    rng = np.random.default_rng(k)
    vecs, ids = rng.integers(-2, 3, (300, 3)).astype(float), rng.integers(0, 12, 300)
    nearest = I.Nearest(ids[:40], vecs[:40], k)
    for at in range(0, 300, 150):
        nearest.add(ids[at : at + 150], np.ascontiguousarray(vecs[at : at + 150]))
    n = np.linalg.norm(vecs, axis=1)
    cos = np.round(np.where(np.outer(n[:40], n) > 0, vecs[:40] @ vecs.T / np.maximum(np.outer(n[:40], n), 1e-12), 0), 9)
    want = [sorted((-c, i) for c, i in zip(row, ids, strict=True) if i != own)[:k] for row, own in zip(cos, ids[:40], strict=False)]
    q, i, c = nearest.rows[0]
    got = [sorted((-x, y) for x, y in zip(np.round(c[q == at], 9), i[q == at], strict=True)) for at in range(40)]
    assert [[x for x, _ in own] for own in got] == [[x for x, _ in own] for own in want]


def test_cosine_top1_matches_sql(spark):
    got, want = rows_and_sql(spark, "cosine_top1", Path(SF))
    assert want and got == want


@pytest.mark.parametrize("slabs", [1, 3, 16])
def test_box_hits_equal_the_pairs(spark, slabs):
    rng = np.random.default_rng(slabs)
    whole = rng.integers(0, 9, (150, 4)) * [1, 1, 0.5, 0.5]  # many shared places, many sides of 0
    loose = np.concatenate([rng.normal(0, 9, (100, 2)), rng.exponential(4, (100, 2))], 1)
    same = np.tile([4.0, 4.0, 0.0, 2.0], (40, 1))
    odd = [[float("nan"), 1.0, 2.0, 2.0], [1.0, 1.0, float("inf"), 3.0], [1.0, 1.0, 2.0, float("nan")], [2.0, None, 1.0, 1.0]]
    rows = [(i, *v) for i, v in enumerate([*whole.tolist(), *loose.tolist(), *same.tolist(), *odd])]
    a, b = (spark.createDataFrame(own, "id long, x double, y double, w double, h double") for own in (rows[::2] + rows[-4:-1], rows[20:]))
    want = G.box_join_brute(a.distinct(), b).where("a <> b").groupBy("a").agg(F.count("*").alias("hits"), F.sum("b").alias("ids"))
    got = G.box_hits(a.distinct(), b, slabs=slabs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 60
    assert G.box_hits(a, b.where("false"), slabs=slabs).count() == 0


def test_box_hits_take_no_pairs(spark):
    b = spark.range(20000).selectExpr("id", "cast(id % 7 as double) x", "cast(id % 11 as double) y", "50d w", "50d h")
    got = G.box_hits(b, b, write).agg(F.count("*"), F.min("hits"), F.max("hits"), F.sum("ids")).first()
    assert tuple(got) == (20000, 19999, 19999, 19999 * 19999 * 10000)
