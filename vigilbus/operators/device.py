"""Device metrics from raw counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilbus.operators.state import ORDER
from vigilbus.plans.series import rolling


def cpu_usage(df: DataFrame, idle: str = "idle", total: str = "total", key: str = "vehicle_id",
              target_rows: float | None = None) -> DataFrame:
    """CPU percent from cumulative counters; 0 for the first sample and for a zero interval."""
    def build(w, index):
        d_idle = F.col(idle) - F.lag(idle).over(w)
        d_total = F.nullif(F.col(total) - F.lag(total).over(w), F.lit(0))
        return {"cpu_usage_percent": F.coalesce(100.0 * (1 - d_idle / d_total), F.lit(0.0))}

    return rolling(df, [key], ORDER, 1, build, target_rows)


def memory_used_mb(total_kb: Column, available_kb: Column) -> Column:
    return (total_kb - available_kb) / 1024.0


def memory_percent(total_kb: Column, available_kb: Column) -> Column:
    return F.coalesce(
        F.try_divide(100.0 * (total_kb - available_kb), total_kb.cast("double")), F.lit(0.0)
    )


def temperature_c(milli: Column) -> Column:
    return milli / 1000.0


def throttling_state(flag_text: Column) -> Column:
    """1 if the hex value after ``=0x`` is not zero, else 0."""
    digits = F.substring_index(F.trim(flag_text), "0x", -1)
    return F.coalesce((F.conv(digits, 16, 10) != F.lit("0")).cast("int"), F.lit(0))
