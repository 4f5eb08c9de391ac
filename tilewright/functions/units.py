"""Physical units, pyramid levels and coordinates, as column expressions. Coordinates that persist are level-0 pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def level_to_l0(x: Column, downsamples: Column, level: Column) -> Column:
    return x * F.element_at(downsamples, level.cast("int") + 1)


def l0_to_level(x: Column, downsamples: Column, level: Column) -> Column:
    return x / F.element_at(downsamples, level.cast("int") + 1)


def resolve_level(downsamples: Column, mpp0: Column, target: Column | float) -> Column:
    """struct(level, residual): the level nearest to the target in log scale, the lowest on ties; an error without a positive scale."""
    target = target if isinstance(target, Column) else F.lit(target)
    best = F.array_min(F.transform(downsamples, lambda d, i: F.struct(F.round(F.abs(F.ln(mpp0 * d / target)), 12).alias("e"), i.alias("level"))))["level"]
    out = F.struct(best.alias("level"), (mpp0 * F.element_at(downsamples, best + 1) / target).alias("residual"))
    return F.when((mpp0 > 0) & ~F.isnan(mpp0), out).otherwise(F.raise_error(F.lit("scale is missing or not positive")).cast("struct<level:int,residual:double>"))


def needs_resample(residual: Column, tolerance: float = 0.05) -> Column:
    return F.abs(residual - 1) > tolerance


def um_to_px(um: Column, mpp: Column) -> Column:
    """Whole pixels, half to even, one at least."""
    return F.greatest(F.lit(1), F.bround(um / mpp)).cast("long")


def px_to_um(px: Column, mpp: Column) -> Column:
    return px * mpp


def mm2_to_px(mm2: Column, mpp: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(mm2 * 1e6 / (mpp * mpp))).cast("long")


def area_mm2(px: Column, mpp: Column) -> Column:
    return px * mpp * mpp / 1e6


def checked_origin(x0: Column, y0: Column) -> Column:
    """struct(x0, y0); an error if a coordinate is missing, not finite or negative."""
    good = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (c >= 0) & (c < float("inf"))
    return F.when(good(x0) & good(y0), F.struct(x0.alias("x0"), y0.alias("y0"))).otherwise(F.raise_error(F.lit("an origin must be finite and not negative")))


def clamp(x: Column, level_extent: Column, size: int, downsample: Column) -> Column:
    """A window's origin moved inside the slide; an error if the level is smaller than the window."""
    top = F.floor((level_extent - size) * downsample)
    return F.when(level_extent >= size, F.least(F.greatest(x, F.lit(0)), top)).otherwise(F.raise_error(F.lit("the window is larger than its level")).cast("long")).cast("long")


def extent_l0(size: Column, downsample: Column) -> Column:
    return size * downsample


def bbox_l0(x0: Column, y0: Column, size: Column, downsample: Column) -> Column:
    e = extent_l0(size, downsample)
    return F.struct(x0.alias("xmin"), y0.alias("ymin"), (x0 + e).alias("xmax"), (y0 + e).alias("ymax"))


def positive(text: Column) -> Column:
    """A text as a positive number, else null."""
    v = text.try_cast("double")
    return F.when((v > 0) & ~F.isnan(v), v)


def resolve_mpp(props: Column) -> Column:
    """struct(x, y), micrometres per pixel, from a map of properties: the first source that has both axes; null if none has."""
    at = lambda k: positive(F.try_element_at(props, F.lit(k)))
    both = lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))
    unit = F.lower(F.coalesce(F.try_element_at(props, F.lit("tiff.ResolutionUnit")), F.lit("")))
    um = F.when(unit.isin("centimeter", "cm", "3"), 10000.0).when(unit.isin("inch", "2"), 25400.0)
    return F.coalesce(
        both(at("openslide.mpp-x"), at("openslide.mpp-y")), both(at("aperio.MPP"), at("aperio.MPP")), both(at("tiffslide.mpp-x"), at("tiffslide.mpp-y")),
        both(philips_mpp(F.try_element_at(props, F.lit("tiff.ImageDescription"))), philips_mpp(F.try_element_at(props, F.lit("tiff.ImageDescription")))),
        both(um / at("tiff.XResolution"), um / at("tiff.YResolution")),
    )


def philips_mpp(description: Column) -> Column:
    """The spacing in a scanner's XML description, in micrometres: the least of the whole-slide image's own spacings, or of all; null outside 1e-5 to 1e-2 mm."""
    number = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
    spacing = "//Attribute[contains(@Name,'PIXEL_SPACING')]/text()"
    own = "//DataObject[Attribute[contains(@Name,'IMAGE_TYPE') and normalize-space(text())='WSI']]//Attribute[contains(@Name,'PIXEL_SPACING')]/text()"
    least = lambda path: F.array_min(F.filter(F.transform(F.regexp_extract_all(F.concat_ws(" ", F.xpath(description, F.lit(path))), F.lit(number), F.lit(0)), lambda v: v.cast("double")), lambda v: v > 0))
    mm = F.coalesce(least(own), least(spacing))
    return F.when(description.like("%DPUfsImport%") & (mm > 1e-5) & (mm < 1e-2), mm * 1000.0)


def isotropic_mpp(mx: Column, my: Column, tolerance: float = 0.02) -> Column:
    mean = (mx + my) / 2
    return F.when(F.abs(mx - my) / mean <= tolerance, mean).otherwise(F.raise_error(F.lit("pixels are not square")).cast("double"))


def normal_downsamples(level_dims: Column, reported: Column) -> Column:
    """The reported factors if there is one a level, else the mean of width and height ratios."""
    first = F.element_at(level_dims, 1)
    return F.when(F.size(reported) == F.size(level_dims), reported).otherwise(F.transform(level_dims, lambda d: 0.5 * (first["w"] / d["w"] + first["h"] / d["h"])))


def powers_of_two(downsamples: Column) -> Column:
    return F.forall(F.transform(downsamples, lambda d, i: F.abs(d - F.pow(F.lit(2.0), i))), lambda x: x < 1e-9)


def bucket(tumor_frac: Column, threshold: float = 0.05) -> Column:
    return F.when(tumor_frac > threshold, "tumor").when(tumor_frac > 0, "boundary").otherwise("normal")


def clinical_class(axis_um: Column) -> Column:
    return F.when(axis_um >= 2000, "macro").when(axis_um >= 200, "micro").otherwise("itc")


def export_bytes(n: Column, jpeg_kb: float = 78.0, mask_kb: float = 3.5) -> Column:
    return (n * ((jpeg_kb + mask_kb) * 1024)).cast("long")


def patch_mm2(size: Column, mpp0: Column, downsample: Column) -> Column:
    return F.pow(size * mpp0 * downsample / 1000.0, F.lit(2.0))


def floor_bound(threshold: Column, floor: Column | int) -> Column:
    return threshold <= floor
