"""Tissue masks of thumbnails: rows (keys..., y, x, r, g, b) in, mask cells and a report per slide out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import pixels
from ..sources.store import written
from . import raster


class TissueDetectionError(EngineError):
    """A thumbnail that no mask should be made of."""


@dataclass(frozen=True)
class TissueConfig:
    """Sizes are physical and become pixels at run time."""

    close_um: float = 40.0
    open_um: float = 24.0
    min_object_mm2: float = 0.02
    bimodality_min: float = 0.08
    floor_sat: int = 20
    floor_gray: int = 40
    least_valid: float = 0.01
    most_tissue: float = 0.90
    least_mm2: float = 1.0


def _px(um: float, mpp: float) -> int:
    return max(1, round(um / mpp))


def tissue_mask(thumbs: DataFrame, keys: list[str], mpp: float, height: int, width: int, cfg: TissueConfig | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(mask, report). Artifacts are left out before the thresholds are found: a black border would otherwise make the histogram bimodal by itself.

    mask: (keys..., y, x). report: keys, sat_threshold, gray_threshold, qc_flag, pen_frac, tissue_frac, tissue_mm2; with
    strict, a slide outside of the contract raises.
    """
    cfg = cfg or TissueConfig()
    d = thumbs.select(*keys, "y", "x", pixels.hsv(F.col("r"), F.col("g"), F.col("b")).alias("c"), pixels.inverted_gray(F.col("r"), F.col("g"), F.col("b")).alias("gray"))
    d = written(d.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("c.s").alias("sat"), "gray", pixels.artifact(F.col("c.h"), F.col("c.s"), F.col("c.v")).alias("pen")), "channels")
    pen = d.groupBy(*keys).agg(F.avg(F.col("pen").cast("double")).alias("pen_frac"))
    if bad := pen.filter(F.col("pen_frac") > 1 - cfg.least_valid).limit(5).collect():
        raise TissueDetectionError(f"hardly a pixel without artifact: {[r.asDict() for r in bad]}")
    valid = d.filter(~F.col("pen"))
    sat = raster.otsu(valid, keys, "sat", cfg.floor_sat, cfg.bimodality_min).select(*keys, F.col("threshold").alias("sat_threshold"), F.col("bimodal").alias("ok_sat"))
    gray = raster.otsu(valid, keys, "gray", cfg.floor_gray, cfg.bimodality_min).select(*keys, F.col("threshold").alias("gray_threshold"), F.col("bimodal").alias("ok_gray"))
    cuts = written(sat.join(gray, keys), "thresholds")  # a row a slide
    raw = valid.join(cuts, keys).filter((F.col("sat") > F.col("sat_threshold")) | (F.col("gray") > F.col("gray_threshold"))).select(*keys, "y", "x")
    m = raster.closing(raw, keys, _px(cfg.close_um, mpp), height, width)
    m = raster.opening(m, keys, _px(cfg.open_um, mpp), height, width)
    m = written(m, "opened")
    m = raster.remove_small(m, keys, max(1, round(cfg.min_object_mm2 * 1e6 / mpp**2)))
    m = written(raster.fill_holes(written(m, "large"), keys, height, width), "mask")
    area = m.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    report = cuts.join(pen, keys).join(area, keys, "left").select(
        *keys, "sat_threshold", "gray_threshold", F.when(F.col("ok_sat") | F.col("ok_gray"), "ok").otherwise("unimodal_fallback").alias("qc_flag"), "pen_frac",
        (F.coalesce("n", F.lit(0)) / float(height * width)).alias("tissue_frac"), (F.coalesce("n", F.lit(0)) * mpp * mpp / 1e6).alias("tissue_mm2"),
    )
    if strict:
        from . import quality

        quality.refuse(quality.tissue_contract(report, F.col("tissue_frac"), F.col("tissue_mm2"), cfg.most_tissue, cfg.least_mm2), "tissue contract", TissueDetectionError)
    return m, report
