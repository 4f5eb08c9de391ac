"""All queries of the engine."""

from __future__ import annotations

from .plans import evaluation, gates, grids, media, rasters, relational, scalars  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
