"""Schemas of the persisted tables, and the check that a table has its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import EngineError

PATCHES = "slide_id string, x0 int, y0 int, level tinyint, size smallint, tissue_frac float, tumor_frac float, split string"
SLIDES = (
    "slide_id string, path string, backend string, vendor string, mpp0 double, residual_scale double, tissue_frac double, pen_frac double, tumor_mm2 double, "
    "level_w int, level_t int, thumb_h int, thumb_w int, sat_threshold int, gray_threshold int, n_lesions int, qc_flag string, patient_id string, slide_class string, "
    "split string, git_sha string, sat_floor_bound boolean, gray_floor_bound boolean, has_xml boolean, dirty boolean"
)
GRID = "slide_id string, x0 int, y0 int, prob_mean double, prob_max double"
MANIFEST = "key string, img bigint, msk bigint, tumor_frac float, slide_id string, shard int, split string, x0 int, y0 int"
FAILED = "run_utc string, slide_id string, path string, error string, traceback string"


def columns(schema: str) -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in schema.split(", ")]


def missing(df: DataFrame, schema: str) -> list[str]:
    """The columns of the schema that df lacks."""
    return [c for c, _ in columns(schema) if c not in df.columns]


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with the columns of the schema, in its order and types; a lacking column is an error."""
    if lacks := missing(df, schema):
        raise EngineError(f"missing columns: {', '.join(lacks)}")
    return df.select(*[F.col(c).cast(t) for c, t in columns(schema)])
