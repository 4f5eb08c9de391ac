import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright import schemas
from tilewright.errors import CoverageError, EngineError, RefusalError
from tilewright.functions import keys, pixels, units
from tilewright.operators import geometry, grid, metrics, quality, raster, sampling, splits, synth
from tilewright.sources import annotations, files, heatmaps, images, listing
from tilewright.streaming import windows


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_units(spark):
    r = one(spark, units.mm2_to_px(F.lit(0.02), F.lit(2.0)), units.mm2_to_px(F.lit(0.02), F.lit(0.5)), units.um_to_px(F.lit(10.0), F.lit(2.0)), units.um_to_px(F.lit(10.0), F.lit(0.5)), units.um_to_px(F.lit(2.5), F.lit(1.0)), units.um_to_px(F.lit(0.1), F.lit(1.0)))
    assert list(r) == [5000, 80000, 5, 20, 2, 1]
    d = F.array(F.lit(1.0), F.lit(1.9992175), F.lit(3.998435))
    assert one(spark, units.resolve_level(d, F.lit(0.25), 0.5)["level"])[0] == 1
    assert tuple(one(spark, units.resolve_level(F.array(F.lit(1.0), F.lit(2.0)), F.lit(0.5), 0.5).alias("b"))["b"]) == (0, 1.0)


@pytest.mark.parametrize("bad", [
    lambda: units.resolve_level(F.array(F.lit(1.0)), F.lit(0.0), 0.5),
    lambda: units.isotropic_mpp(F.lit(0.25), F.lit(0.3)),
    lambda: units.checked_origin(F.lit(-1), F.lit(0)),
    lambda: units.clamp(F.lit(0), F.lit(100), 512, F.lit(1.0)),
    lambda: keys.patient_id(F.lit("x_1"), r"(patient_\d+)"),
])
def test_refusals(spark, bad):
    with pytest.raises(Exception, match="USER_RAISED|raise|missing|square|origin|larger|patient"):
        spark.range(1).select(bad().alias("x")).collect()


def test_stratified_split_sizes(spark):
    rows = [(f"t{i}", "tumor") for i in range(61)] + [(f"n{i}", "normal") for i in range(70)] + [("a", "one"), ("b", "two"), ("c", "two"), ("d", "three"), ("e", "three"), ("f", "three")]
    d = splits.stratified_split(spark.createDataFrame(rows, "patient string, cls string"))
    n = {(r.cls, r.split): r["count"] for r in d.groupBy("cls", "split").count().collect()}
    assert (n["tumor", "train"], n["tumor", "val"], n["tumor", "test"]) == (43, 9, 9)
    assert {s for c, s in n if c == "three"} == {"train", "val", "test"}
    again = splits.stratified_split(spark.createDataFrame(random.sample(rows, len(rows)), "patient string, cls string").repartition(7))
    assert sorted(map(tuple, d.collect())) == sorted(map(tuple, again.collect()))


def test_split_gates(spark):
    p = spark.createDataFrame([(f"s{i}", s, 0.1) for s, n in (("train", 4), ("val", 3), ("test", 1)) for i in range(n)], "slide_id string, split string, tumor_frac double")
    assert splits.split_problems(p).first().problems == ["test: only 1 slides"]
    assert splits.leaks(p).count() == 3
    with pytest.raises(EngineError):
        quality.refuse(splits.leaks(p), "slides in two splits")


def test_interleave_against_a_loop(spark):
    rnd = random.Random(3)
    for ratio in (0.5, 1.0, 2.0):
        rows = [(f"{k}{i}", k, rnd.randint(1, 90)) for k, n in (("tumor", 12), ("normal", 15), ("annotation", 3)) for i in range(n)]
        got = {r.name for r in sampling.interleaved_plan(spark.createDataFrame(rows, "name string, kind string, size long"), 700, ratio=ratio).collect()}
        import hashlib

        of = lambda k: sorted((r for r in rows if r[1] == k), key=lambda r: hashlib.md5(f"1337:{r[0]}".encode()).hexdigest())
        tumor, normal, chosen = of("tumor"), of("normal"), {r[0] for r in rows if r[1] == "annotation"}
        used, t, n = sum(r[2] for r in rows if r[1] == "annotation"), 0, 0
        while t < len(tumor) or n < len(normal):
            take_normal = t == len(tumor) or (n < len(normal) and n < ratio * max(t, 1))
            r = normal[n] if take_normal else tumor[t]
            if used + r[2] > 700:
                break
            chosen.add(r[0])
            used, t, n = used + r[2], t + (not take_normal), n + take_normal
        # the first tumour precedes the first normal in the plan, as both are needed for a ratio
        assert len(got) == len(chosen)


def test_balanced_draw_with_replacement(spark):
    rows = [("tumor", f"t{i}") for i in range(10)] + [("normal", f"n{i}") for i in range(7)] + [("boundary", f"b{i}") for i in range(5)]
    d = sampling.balanced_draw(spark.createDataFrame(rows, "bucket string, key string"), "bucket", F.col("key"))
    n = {r.bucket: r.s for r in d.groupBy("bucket").agg(F.sum("copies").alias("s")).collect()}
    assert n == {"tumor": 10, "normal": 30, "boundary": 1}


def test_constant_field_is_rebuilt(spark):
    g = grid.grid(spark.createDataFrame([("s", 200, 333)], "slide string, w int, h int"), ["slide"], F.col("w"), F.col("h"), F.lit(1.0), 64, 32, far_edge=True)
    t = g.select("slide", F.col("x0").alias("hx"), F.col("y0").alias("hy"), F.array_repeat(F.lit(0.37), 64 * 64).alias("values"))
    s = raster.overlap_add(t, ["slide"], 64, F.lit(333), F.lit(200))
    heat = raster.finalised(s)
    r = heat.agg(F.count(F.lit(1)), F.min("heat"), F.max("heat")).first()
    assert r[0] == 200 * 333 and abs(r[1] - 0.37) < 1e-3 and abs(r[2] - 0.37) < 1e-3
    holes = spark.createDataFrame([("s", 0, 500)], "slide string, y long, x long")
    with pytest.raises(CoverageError):
        raster.assert_covered(raster.coverage(holes, s, ["slide"]))


def _mask(spark, picture):
    return spark.createDataFrame([("s", y, x) for y, line in enumerate(picture) for x, c in enumerate(line) if c == "#"], "k string, y long, x long")


def _cells(df):
    return {(r.y, r.x) for r in df.collect()}


def test_components_across_tiles(spark):
    rnd = random.Random(1)
    cells = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(900)}
    m = spark.createDataFrame([("s", y, x) for y, x in cells], "k string, y long, x long")
    got = {(r.y, r.x): (r.root_y, r.root_x) for r in raster.components(m, ["k"], tile=8).collect()}
    left, want = set(cells), {}
    while left:
        root = min(left)
        todo, found = [root], {root}
        while todo:
            y, x = todo.pop()
            for c in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if c in left and c not in found:
                    found.add(c)
                    todo.append(c)
        want |= dict.fromkeys(found, root)
        left -= found
    assert got == want


def test_fill_holes_and_small(spark):
    m = _mask(spark, ["......", ".####.", ".#..#.", ".####.", "......", "...#.."])
    assert len(_cells(raster.fill_holes(m, ["k"], 6, 6))) == 13
    assert (5, 3) not in _cells(raster.remove_small(m, ["k"], 2))


def test_lesions_keep_long_ones(spark):
    heat = spark.createDataFrame([("s", y, x, 0.9 if (2 <= y < 5 and 2 <= x < 32) or (20 <= y < 23 and 10 <= x < 13) else 0.0) for y in range(30) for x in range(40)], "k string, y long, x long, heat double")
    rows = raster.lesions(heat, ["k"], 0.5, 2.0, 30, 40, opening_px=1, min_axis_um=20.0).collect()
    assert len(rows) == 1 and rows[0].lesion == 1 and rows[0].axis_um == pytest.approx(58.0, abs=2.1)
    with pytest.raises(ValueError):
        raster.lesions(heat, ["k"], 1.5, 2.0, 30, 40)


def test_geometry(spark):
    bar = [(0, 0), (100, 0), (100, 10), (0, 10)]
    a = math.radians(45)
    turned = [(x * math.cos(a) - y * math.sin(a), x * math.sin(a) + y * math.cos(a)) for x, y in bar]
    assert geometry.major_axis(np.array(bar, float)) == pytest.approx(geometry.major_axis(np.array(turned))) == pytest.approx(100)
    assert geometry.area_of(geometry.clip_ring(np.array(bar, float), 50, -5, 60, 5)) == pytest.approx(50)
    assert one(spark, geometry.ring_area(geometry.ring(turned)))[0] == pytest.approx(1000)
    d = spark.createDataFrame([([{"x": 0.0, "y": 0.0}, {"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}],), ([{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 0.0}],)], f"ring {geometry.RING}")
    assert [len(r.ring) for r in geometry.repaired(d).collect()] == [3]


def test_auc_and_froc_degenerate(spark):
    d = spark.createDataFrame([(0.1, True), (0.2, True)], "s double, y boolean")
    assert metrics.rank_auc(d, F.col("s"), F.col("y")).first().auc is None
    f = metrics.froc(d.withColumn("id", F.lit(1)), "s", "y", "id", F.lit(0), F.lit(3))
    assert f.count() == 0
    assert {r.sensitivity for r in metrics.sensitivity_at(f).collect()} == {0.0}


def test_bootstrap_interval(spark):
    v = [(i, float(i % 10)) for i in range(400)]
    r = metrics.bootstrap_ci(spark.createDataFrame(v, "k long, v double"), "k", "v", draws=400).first()
    half = 1.96 * np.std([x for _, x in v]) / 20
    assert r.lo == pytest.approx(4.5 - half, abs=0.1) and r.hi == pytest.approx(4.5 + half, abs=0.1)
    assert metrics.bootstrap_ci(spark.createDataFrame([], "k long, v double"), "k", "v", draws=5).first().lo is None


def test_stain_jitter(spark):
    same = pixels.stain_jitter([F.lit(120), F.lit(60), F.lit(200)], [F.lit(1.0)] * 3, [F.lit(0.0)] * 3)
    assert all(abs(a - b) <= 1 for a, b in zip(one(spark, *same), (120, 60, 200), strict=True))
    m = np.array(pixels.STAINS)
    od = -np.log(np.array([120, 60, 200]) / 255) @ np.linalg.inv(m) * np.array([1.04, 0.97, 1.0]) + np.array([0.01, -0.02, 0.0])
    want = np.clip(np.exp(-(od @ m)) * 255, 0, 255).astype(int)
    got = one(spark, *pixels.stain_jitter([F.lit(120), F.lit(60), F.lit(200)], [F.lit(1.04), F.lit(0.97), F.lit(1.0)], [F.lit(0.01), F.lit(-0.02), F.lit(0.0)]))
    assert all(abs(a - b) <= 1 for a, b in zip(got, want, strict=True))


def test_annotation_file(spark, tmp_path):
    ring = lambda lo, hi: [(lo, lo), (hi, lo), (hi, hi), (lo, hi)]
    (tmp_path / "a.xml").write_text(synth.annotation_xml([("_0", ring(0.0, 6000.0)), ("_2", ring(1000.0, 3000.0)), ("odd", [(0, 0), (1, 1)])]))
    d = annotations.read(spark, str(tmp_path / "a.xml"))
    assert sorted((r.slide_id, r.grp) for r in d.collect()) == [("a", "exclusion"), ("a", "tumor")]
    assert annotations.areas(d, 0.25).first().tumor_mm2 == pytest.approx((6000**2 - 2000**2) * 0.0625 / 1e6)


def test_files(spark, tmp_path):
    for n in ("x/a.tif", "x/a_mask.tif", "b.svs", "c.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(n.encode())
    assert {r.slide_id for r in files.discover(spark, str(tmp_path)).collect()} == {"a", "b"}
    assert files.digests(spark, str(tmp_path)).count() == 4
    d = spark.createDataFrame([("s", 1, 2, 0, 512, 0.5, 0.1, "train"), ("s", 3, 4, 0, 512, 0.5, 0.0, "val")], schemas.PATCHES)
    files.write_patches(d, str(tmp_path / "p"))
    back = files.read_patches(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, d.collect()))
    assert files.row_hash(back).first() == files.row_hash(d.repartition(3)).first()
    with pytest.raises(EngineError):
        schemas.conform(d.drop("x0"), schemas.PATCHES)
    files.log_metrics(spark.createDataFrame([(1, 0.5)], "epoch int, dice double"), str(tmp_path / "m"))
    files.log_metrics(spark.createDataFrame([(2, 0.6)], "epoch int, dice double"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    files.write_report(spark.createDataFrame([(1, 0.5)], "n int, auc double"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == '{"n":1,"auc":0.5}'


def test_listing(spark):
    lines = ["2024-01-01 10:00:00 123 a/b c.tif", "2024-01-01 10:00:00 PRE x", "short line", "2024-01-01 10:00:00 9 k"]
    assert {tuple(r) for r in listing.parsed(spark.createDataFrame([(x,) for x in lines], "value string")).collect()} == {("a/b c.tif", 123), ("k", 9)}


def test_heatmap_chunks(spark, tmp_path):
    c = spark.createDataFrame([("s", y, x, y * 0.1 + x) for y in range(5) for x in range(7)], "slide string, y long, x long, heat double")
    heatmaps.write(heatmaps.chunks(c, ["slide"], "heat", 4), spark.createDataFrame([("s", 0.25)], "slide string, mpp double"), ["slide"], str(tmp_path / "h"))
    back, attrs = heatmaps.read(spark, str(tmp_path / "h"))
    assert sorted(map(tuple, heatmaps.cells(back, ["slide"], "heat", 4).collect())) == sorted(map(tuple, c.collect())) and attrs.count() == 1


def _tiff(a: np.ndarray) -> bytes:
    h, w, s = a.shape
    data = zlib.compress(a.tobytes())
    entries = [(256, 4, 1, w), (257, 4, 1, h), (259, 3, 1, 8), (273, 4, 1, 8), (277, 3, 1, s), (278, 4, 1, h), (279, 4, 1, len(data))]
    body = b"".join(struct.pack("<HHI", t, k, n) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v)) for t, k, n, v in entries)
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + struct.pack("<H", len(entries)) + body + struct.pack("<I", 0)


def test_slide_source_and_regions(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 255, (20, 30, 3), dtype=np.uint8)
    (tmp_path / "a.tif").write_bytes(_tiff(a))
    (tmp_path / "bad.tif").write_bytes(b"nothing")
    spark.dataSource.register(images.SlideSource)
    d = {r.path: r for r in spark.read.format("slides").option("paths", f"{tmp_path}/a.tif,{tmp_path}/bad.tif").load().collect()}
    assert [tuple(x) for x in d[f"{tmp_path}/a.tif"].levels] == [(30, 20)] and "not a TIFF" in d[f"{tmp_path}/bad.tif"].error
    w = spark.createDataFrame([(f"{tmp_path}/a.tif", 0, 25, 15, 10, 10)], "path string, level int, x int, y int, w int, h int")
    got = np.frombuffer(images.read_regions(w).first().pixels, np.uint8).reshape(10, 10, 3)
    assert (got[:5, :5] == a[15:, 25:]).all() and (got[5:] == 255).all()
    rgba = np.zeros((2, 2, 4), np.uint8)
    assert (images.on_white(rgba) == 255).all()
    (tmp_path / "m.png").write_bytes(images.png(np.array([[0, 255], [255, 0]])))
    assert bytes(spark.read.format("image").load(str(tmp_path / "m.png")).first().image.data) in (b"\0\xff\xff\0", b"\0\0\0\xff\xff\xff\xff\xff\xff\0\0\0")


def test_guards(spark):
    runs = spark.createDataFrame([("a", True, 0.5)], "run string, dirty boolean, tau double")
    with pytest.raises(RefusalError):
        quality.assert_reportable(runs, F.col("dirty"))
    with pytest.raises(RefusalError):
        quality.assert_attributes(runs, F.col("run"), "a", F.col("tau"), 0.4)
    quality.assert_attributes(runs, F.col("run"), "a", F.col("tau"), 0.5)
    assert "pyspark" in quality.environment()


def test_stream_windows(spark, tmp_path):
    e = spark.range(200).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("a").alias("event_type"), F.col("id").cast("double").alias("value"))
    e.repartition(4).write.parquet(str(tmp_path / "in"))
    s = windows.tumbling(windows.from_files(spark, str(tmp_path / "in"), "ts timestamp, user_id bigint, event_type string, value double", 100), "1 hour", late="0 seconds")
    windows.to_table(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r.start, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got <= {(r.start, r.n) for r in windows.tumbling(e, "1 hour").collect()} and len(got) >= 3
    assert windows.sessions(e, "2 minutes").count() == 200 or windows.sessions(e, "5 minutes").count() == 3


def test_tissue_mask(spark):
    from tilewright import catalog

    r = {x.slide: x for x in catalog.QUERIES["R22_Q4_tissue_mask"](spark, "").collect()}
    blob = 19 * 25 / 48**2
    assert r[0].tissue_frac == 0 and r[0].pen_frac == 0
    assert r[1].tissue_frac == pytest.approx(blob, rel=0.05) and r[1].qc_flag == "ok"
    assert r[2].tissue_frac == pytest.approx(blob, rel=0.05) and r[2].pen_frac == pytest.approx((48 * 4 + 9 * 21) / 48**2, rel=0.01)


def test_patch_set(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files/s_0_0.png").write_bytes(b"img")
    m = spark.createDataFrame([("s_0_0", 3, 0, 0.5, "s", 0, "train", 0, 0), ("s_1_0", 3, 0, 0.5, "s", 0, "val", 1, 0)], schemas.MANIFEST)
    assert bytes(files.patch_set(spark, str(tmp_path), m, "train").first().content) == b"img"
    f = spark.createDataFrame([("2024", "s", "p", "e", "t")], schemas.FAILED)
    files.write_failures(f, str(tmp_path / "failed"))
    files.write_failures(f.limit(0), str(tmp_path / "failed"))
    assert files.read_failures(spark, str(tmp_path / "failed")).count() == 0
