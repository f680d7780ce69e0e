"""Registered sources: which adapter normalises each, how it says that it was refused, how long it may run, when to skip it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import REGISTRATION
from .ingest import ADAPTERS

MINUTES = 60_000
DEFAULT_TIMEOUT = 45 * MINUTES


def registration(code: str, adapter: str, markers: Iterable[str] = (), timeout_ms: int = DEFAULT_TIMEOUT, skip_scheduled: str | None = None) -> tuple:
    """One row. A source without markers has no way to tell that it was refused. skip_scheduled: the reason."""
    if adapter not in ADAPTERS:
        raise ValueError(f"no adapter {adapter}")
    markers = list(markers)
    return code, adapter, markers, bool(markers), timeout_ms, skip_scheduled


def registry(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The registrations as a table; a code that is there twice raises."""
    codes = [r[0] for r in rows]
    if len(set(codes)) < len(codes):
        raise ValueError("a source is registered twice")
    return spark.createDataFrame(rows, REGISTRATION)


def refused(output: Column, markers: Column) -> Column:
    """Whether a run's output holds one of its source's markers."""
    return F.exists(F.coalesce(markers, F.array().cast("array<string>")), lambda m: F.contains(output, m))


def planned(sources: DataFrame, trigger: str, only: list[str] | None = None) -> DataFrame:
    """code, adapter, timeout_ms, skipped (the reason or null) of a run's sources; naming a source overrides its guard."""
    from .quality import skip_reason

    rows = sources if only is None else sources.filter(F.col("code").isin(only))
    skipped = skip_reason(F.col("skip_scheduled"), F.lit(trigger), F.lit(only is not None))
    return rows.select("code", "adapter", "timeout_ms", skipped.alias("skipped"))


def status_of(runs: DataFrame) -> Column:
    """The status of finished runs, joined with their sources: output, found, failed, seconds, error, markers, timeout_ms.

    A run over its time is an error; a refusal is one only where nothing was found (``quality.run_status``).
    """
    from .quality import run_status

    late = runs["seconds"] * 1000 > runs["timeout_ms"]
    error = F.coalesce(runs["error"], F.when(late, F.concat(F.lit("over "), runs["timeout_ms"], F.lit(" ms"))))
    blocked = F.when(refused(runs["output"], runs["markers"]), 1).otherwise(0)
    return run_status(runs["found"], blocked, runs["failed"], error)
