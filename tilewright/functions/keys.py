"""Identifiers, hashes and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def patient_id(slide_id: Column, rule: str | None = None) -> Column:
    """The slide itself, or the one group of a pattern anchored at the start; an error where it doesn't match."""
    if rule is None:
        return slide_id
    got = F.regexp_extract(slide_id, f"^(?:{rule})", 1)
    return F.when(got != "", got).otherwise(F.raise_error(F.concat(F.lit("no patient in "), slide_id)).cast("string"))


def md5_int(text: Column) -> Column:
    """The first 32 bits of an MD5, as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_split(patient: Column, seed: int = 1337, bounds: tuple[int, int] = (70, 85)) -> Column:
    h = md5_int(F.concat(F.lit(f"{seed}:"), patient.cast("string"))) % 100
    return F.when(h < bounds[0], "train").when(h < bounds[1], "val").otherwise("test")


def shuffle_key(name: Column, seed: int = 1337) -> Column:
    """An order that depends on the seed and the name alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), name.cast("string")))


def patch_key(slide: Column, x0: Column, y0: Column, copy: Column | None = None) -> Column:
    base = F.concat_ws("_", slide.cast("string"), x0.cast("string"), y0.cast("string"))
    return base if copy is None else F.when(copy.isNull(), base).otherwise(F.concat(base, F.lit("_j"), copy.cast("string")))


def config_hash(canonical_json: Column, n: int = 8) -> Column:
    return F.substring(F.sha1(canonical_json), 1, n)


def run_id(at: Column, sha: Column, config: Column, dirty: Column) -> Column:
    return F.concat(F.date_format(at, "yyyyMMdd"), F.lit("_"), F.substring(sha, 1, 7), F.when(dirty, "-dirty").otherwise(""), F.lit("_"), config)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def with_suffix(path: Column, new: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(new))


def name_prefix(path: Column) -> Column:
    """The name before its first digit."""
    return F.regexp_extract(F.substring_index(path, "/", -1), r"^([^0-9]*)", 1)


def folder(key: Column) -> Column:
    return F.regexp_extract(key, "^(.*)/", 1)


#: Groups of annotations.
def annotation_group(part_of_group: Column, name: Column, exclusion=("_2", "exclusion", "normal"), tumor=("_0", "_1", "tumor", "metastases")) -> Column:
    """exclusion or tumor: the group, else the name, trimmed and in lower case; unknown ones count as tumor."""
    g = F.lower(F.coalesce(F.nullif(F.trim(part_of_group), F.lit("")), F.nullif(F.trim(name), F.lit("")), F.lit("")))
    return F.when(g.isin(*exclusion), "exclusion").when(g.isin(*tumor), "tumor").otherwise("tumor")


def object_kind(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.like("tumor%"), "tumor").when(low.like("normal%"), "normal").when(low.like("test%"), "test").otherwise("other")


def is_slide(key: Column) -> Column:
    low = F.lower(key)
    return (low.endswith(".tif") | low.endswith(".tiff") | low.endswith(".svs") | low.endswith(".ndpi")) & ~is_raster(key)


def is_annotation(key: Column) -> Column:
    return F.lower(key).endswith(".xml")


def is_raster(key: Column) -> Column:
    """Masks and tissue rasters, which are images but not slides."""
    return F.lower(stem(key)).rlike("(_mask|_tissue)$")
