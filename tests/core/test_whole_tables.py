"""Queries over whole tables, against brute force: tables beyond the sizes that their SQL stops at."""

import hashlib

import numpy as np
import pytest

from tilewright import catalog
from tilewright.plans import rasters
from tilewright.registry import Tables

N_SUPPLIERS, N_TILES = 60, 260


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    spark.range(1, N_SUPPLIERS + 1).withColumnRenamed("id", "s_suppkey").write.parquet(f"{out}/supplier.parquet")
    rng = np.random.default_rng(4)
    rows = [(i, "a", [float(x) for x in rng.normal(0.02, 0.3, 64)]) for i in range(N_TILES)]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").write.parquet(f"{out}/embeddings.parquet")
    return out


def _rows(spark, folder, name):
    return [tuple(r) for r in catalog.QUERIES[name](spark, folder).collect()]


def _size(k):
    return k % 7 * 300 + 400, k % 5 * 350 + 500


def _mask(k):
    y, x = np.mgrid[:20, :25]
    return ((y * 7 + x * 3 + k) % 5 < 2).astype(float)


def _windows(k):
    w, h = _size(k)
    along = lambda n: sorted({*range(0, n - 256 + 1, 128), n - 256})
    return w, h, [(x, y) for x in along(w) for y in along(h)]


def test_training_grid(spark, folder):
    want = {(k, x, y) for k in range(1, N_SUPPLIERS + 1) for x in range(0, max(_size(k)[0] - 512, 0) + 1, 512) for y in range(0, max(_size(k)[1] - 512, 0) + 1, 512)}
    got = catalog.QUERIES["R1_training_grid"](spark, folder).collect()
    assert {(r.s_suppkey, r.gx, r.gy) for r in got} == want and len(got) == len(want)


def test_inference_grid(spark, folder):
    got = catalog.QUERIES["R2_R33_inference_grid"](spark, folder).collect()
    want = {(k, p) for k in range(1, N_SUPPLIERS + 1) for p in range(len(_windows(k)[2]))}
    assert {(r.s_suppkey, r.place) for r in got} == want and len(got) == len(want)


def test_window_fractions(spark, folder):
    got = {(r.s_suppkey, r.r, r.c): r.frac for r in catalog.QUERIES["O6_R3_window_fraction"](spark, folder).collect()}
    want = {(k, r, c): _mask(k)[r : r + 5, c : c + 6].mean() for k in range(1, N_SUPPLIERS + 1) for r in range(0, 18, 3) for c in range(0, 24, 4)}
    assert got == pytest.approx(want, abs=1e-6)


def test_gated_plan(spark, folder):
    want = {}
    for k in range(1, N_SUPPLIERS + 1):
        w, h, at = _windows(k)
        for x, y in at:
            r0, c0, r1, c1 = round(y / (h / 20)), round(x / (w / 25)), round((y + 256) / (h / 20)), round((x + 256) / (w / 25))
            if (part := _mask(k)[r0:r1, c0:c1]).size and part.mean() >= 0.4:
                want[k, x, y] = part.mean()
    got = {(r.s_suppkey, r.x0, r.y0): r.tissue_frac for r in catalog.QUERIES["R2_W1_gated_plan"](spark, folder).collect()}
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("name", ["O6_R3_window_fraction", "R2_W1_gated_plan"])
def test_nothing_exploded_is_broadcast(spark, folder, name):
    """The planner takes cells and windows for as few rows as there are slides; a broadcast of them fills the driver."""
    d = catalog.QUERIES[name](spark, folder)
    assert d.count() > N_SUPPLIERS
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()


def test_mask_area(spark, folder):
    got = {r.s_suppkey: r.tissue_frac for r in catalog.QUERIES["A27_mask_area"](spark, folder).collect()}
    assert got == pytest.approx({k: _mask(k).mean() for k in range(1, N_SUPPLIERS + 1)}, abs=1e-6)


def test_split_problems_of_all_slides(spark, tmp_path):
    """Train has its only tumor patch, and val its third slide, outside of the multiples of 500."""
    split = lambda c: (lambda h: "train" if h < 70 else "val" if h < 85 else "test")(int(hashlib.md5(f"1337:{c}".encode()).hexdigest()[:8], 16) % 100)
    of = {s: [c for c in range(1, 500) if split(c) == s][:4] for s in ("train", "val", "test")}
    slides = {500 * (i + 1) + (i % 2): (s, c) for i, (s, c) in enumerate((s, c) for s in of for c in of[s])}
    spark.createDataFrame([(k, c) for k, (_, c) in slides.items()], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    tumor = {k: 0.09 if k % 500 and s != "val" else 0.0 for k, (s, _) in slides.items()}
    lines = [(k, n, 1, 1, 20.0, tumor[k] if n == 1 else 0.0) for k in slides for n in (1, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(r.problem for r in catalog.QUERIES["Q1_split_problems"](spark, str(tmp_path)).collect())
    assert got == ["test: no tumor patches", "val: no tumor patches"]


def _tiles(spark, folder):
    return {r.vec_id: np.array(r.embedding, dtype=float).reshape(8, 8) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}


def test_median_blur_of_all_tiles(spark, folder):
    got = {r.vec_id: r["values"] for r in catalog.QUERIES["R18_median_blur"](spark, folder).collect()}
    assert len(got) == N_TILES
    for i, a in _tiles(spark, folder).items():
        p = np.pad(a, 1, mode="edge")
        want = [np.median(p[y : y + 3, x : x + 3]) for y in range(8) for x in range(8)]
        assert got[i] == pytest.approx(want)


def test_blur_of_all_tiles(spark, folder):
    got = {(r.vec_id, r.y, r.x): r.v for r in catalog.QUERIES["R26_blur"](spark, folder).collect()}
    k = np.array([[max(0.0, 0.5 - abs(i - j) / 4) if abs(i - j) < 2 else 0.0 for j in range(8)] for i in range(8)])
    k /= k.sum(axis=1, keepdims=True)
    want = {(i, y, x): v for i, a in _tiles(spark, folder).items() for (y, x), v in np.ndenumerate(k @ a @ k.T)}
    assert got == pytest.approx(want, abs=1.1e-6)


def _binary(spark, folder, above):
    return {(r.y, r.x) for r in rasters.binary(Tables(spark, folder), above).collect()}


DISK = ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))


def _eroded(m):
    return {(y, x) for y, x in m if all((y + a, x + b) in m for a, b in DISK)}


def _dilated(m):
    return {(y + a, x + b) for y, x in m for a, b in DISK if y + a >= 0 and 0 <= x + b < 52}


def _components(m):
    left, out = set(m), []
    while left:
        todo, found = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            found.add((y, x))
            for a, b in DISK[1:]:
                if (y + a, x + b) in left:
                    left.remove((y + a, x + b))
                    todo.append((y + a, x + b))
        out.append(found)
    return out


def _filled(m):
    """In an image with a free row below the mask."""
    height = max(y for y, _ in m) + 2
    free = {(y, x) for y in range(height) for x in range(52)} - m
    return m.union(*(c for c in _components(free) if not any(y in (0, height - 1) or x in (0, 51) for y, x in c)))


def test_morphology_of_high_rasters(spark, folder):
    cells = lambda name: {(r.y, r.x) for r in catalog.QUERIES[name](spark, folder).collect()}
    low, half, high = (_binary(spark, folder, a) for a in (0.45, 0.5, 0.6))
    assert max(y for y, _ in high) > 70
    assert cells("R11_opening") == _dilated(_eroded(low))
    assert cells("R11_closing") == _eroded(_dilated(high))
    assert cells("R10_fill_holes") == _filled(half)
    assert _filled(half) > half


def test_lesions_of_high_rasters(spark, folder):
    want = [c for c in _components(_dilated(_eroded(_filled(_binary(spark, folder, 0.5))))) if len(c) > 20]
    d = catalog.QUERIES["R16_R15_lesions"](spark, folder)
    assert d.columns == ["label", "lesion", "area_px", "area_mm2", "axis_um", "cy", "cx", "score_mean", "score_max"]
    every = d.collect()
    by_key = {k: sorted(r.lesion for r in every if r.label == k) for k in {r.label for r in every}}
    assert all(x == list(range(1, len(x) + 1)) for x in by_key.values())
    assert all(r.area_mm2 == pytest.approx(r.area_px * 4e-6) and 0.5 < r.score_max <= 1 and r.score_mean <= r.score_max and r.axis_um >= 6 for r in every)
    got = {(r.area_px, round(r.cy, 6), round(r.cx, 6)) for r in every}
    assert max(max(y for y, _ in c) for c in want) > 70
    assert {(len(c), round(float(np.mean([y for y, _ in c])), 6), round(float(np.mean([x for _, x in c])), 6)) for c in want} <= got
