"""Summaries of resource samples: an explicit, tiny time series for each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delta(value: str, at: Column) -> Column:
    """Last minus first value in time, not below zero."""
    return F.greatest(F.max_by(value, at) - F.min_by(value, at), F.lit(0))


def usage(samples: DataFrame, run: str = "run_id", time: str = "monotonic_seconds", order: str = "sample_no") -> DataFrame:
    """Wall and CPU time, last and peak memory of each run; nulls are left out of peaks."""
    at = F.struct(time, order)
    return samples.groupBy(run).agg(
        F.count("*").alias("samples"),
        delta(time, at).alias("wall_time_seconds"),
        delta("process_cpu_seconds", at).alias("process_cpu_seconds"),
        F.max_by("current_rss_bytes", at).alias("current_rss_bytes"),
        F.max_by("process_peak_rss_bytes", at).alias("process_peak_rss_bytes"),
        F.max("current_rss_bytes").alias("sampled_peak_current_rss_bytes"),
        F.max_by("gpu_memory_bytes", at).alias("gpu_memory_bytes"),
        F.max("gpu_memory_bytes").alias("sampled_peak_gpu_memory_bytes"),
    )


def calibrated(trials: DataFrame, group: str, value: str) -> DataFrame:
    """Exact median of the trials of each group."""
    return trials.groupBy(group).agg(F.median(value).alias("median"), F.count(value).alias("trials"))


def gate_blockers(checks: dict[str, Column]) -> Column:
    """Codes of the gate conditions that do not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks.items()]))
