"""Gates: a gate is a DataFrame of violations, and refuse() raises if it has any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError, RefusalError


def refuse(violations: DataFrame, what: str, error: type[EngineError] = EngineError) -> None:
    """Raises with the first few violations."""
    if rows := violations.limit(5).collect():
        raise error(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def tissue_contract(slides: DataFrame, frac: Column, mm2: Column, most: float = 0.90, least_mm2: float = 1.0) -> DataFrame:
    """Slides with implausibly much or little tissue, and why."""
    why = F.when(frac > most, "too much tissue").when(mm2 < least_mm2, "too little tissue")
    return slides.withColumn("problem", why).filter("problem is not null")


def not_binary(cells: DataFrame, value: Column) -> DataFrame:
    return cells.filter(~value.isin(0, 1) | value.isNull())


def unacknowledged(failures: DataFrame, allowed: bool) -> DataFrame:
    return failures.limit(0) if allowed else failures


def plan_warnings(slides: DataFrame, kind: str = "kind", least: dict[str, int] | None = None) -> DataFrame:
    """A row per class with fewer slides than it should have."""
    least = least or {"tumor": 40, "normal": 20}
    row = slides.agg(*[F.count_if(F.col(kind) == k).alias(k) for k in least])
    found = F.array_compact(F.array(*[F.when(F.col(k) < n, F.struct(F.lit(k).alias("kind"), F.col(k).alias("n"), F.lit(n).alias("least"))) for k, n in least.items()]))
    return row.select(F.explode(found).alias("w")).select("w.kind", "w.n", "w.least")


def assert_reportable(run: DataFrame, dirty: Column) -> None:
    refuse(run.filter(dirty), "the tree is dirty", RefusalError)


def assert_attributes(maps: DataFrame, run_id: Column, expected_run: str, tau: Column, expected_tau: float) -> None:
    refuse(maps.filter((run_id != expected_run) | (F.abs(tau - expected_tau) > 1e-9)), "a map belongs to another model", RefusalError)


def environment() -> dict[str, str]:
    """Versions of what the engine needs; an error if something is missing."""
    from importlib.metadata import PackageNotFoundError, version

    out = {}
    for name in ("pyspark", "pyarrow", "pandas", "numpy"):
        try:
            out[name] = version(name)
        except PackageNotFoundError as e:
            raise EngineError(f"{name} isn't installed") from e
    return out
