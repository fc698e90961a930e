"""Plausibility rules and risk tiers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilbus.operators.state import ORDER
from vigilbus.plans.series import rolling
from vigilbus.schema import SIGNALS

# Rule limits.
SPEED_HIGH, SPEED_LOW = 300.0, -50.0
BOTH_PEDALS = 80.0
SPEED_JUMP, BATTERY_JUMP = 50.0, 10.0
ALERT_SPEED, ALERT_BRAKE = 100.0, 0.7


def _present(flags: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in flags]))


def driving_alerts(speed: Column, brake: Column) -> Column:
    return _present([(speed > ALERT_SPEED, "high_speed"), (brake > ALERT_BRAKE, "hard_brake")])


def range_rules(scale: float = 1.0) -> Column:
    """Violated range rules; ``scale`` turns throttle and brake into 0-100 units."""
    flags = [
        (F.col("speed_kmh") > SPEED_HIGH, "speed_high"),
        (F.col("speed_kmh") < SPEED_LOW, "speed_low"),
    ]
    for name, unit in (("battery_level", 1.0), ("throttle", scale), ("brake", scale)):
        x = F.col(name) * unit
        flags += [(x > 100, f"{name}_high"), (x < 0, f"{name}_low")]
    return _present(flags)


def both_pedals(scale: float = 1.0) -> Column:
    return (F.col("throttle") * scale > BOTH_PEDALS) & (F.col("brake") * scale > BOTH_PEDALS)


def rapid_change(df: DataFrame, key: str = "vehicle_id",
                 target_rows: float | None = None) -> DataFrame:
    """Jumps against the previous row of the vehicle.

    The compared row is the one before; comparing a row with itself could never fire.
    """
    def jump(w, name, limit):
        return F.coalesce(F.abs(F.col(name) - F.lag(name).over(w)) > limit, F.lit(False))

    return rolling(
        df, [key], ORDER, 1,
        lambda w, i: {"speed_jump": jump(w, "speed_kmh", SPEED_JUMP),
                      "battery_jump": jump(w, "battery_level", BATTERY_JUMP)},
        target_rows,
    )


def is_valid(names: list[str] | None = None) -> Column:
    """All signals present, numeric and finite."""
    checks = []
    for name in names or SIGNALS:
        x = F.col(name)
        checks.append(F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return reduce(lambda a, b: a & b, checks)


def all_rules(df: DataFrame, key: str = "vehicle_id", scale: float = 1.0,
              target_rows: float | None = None) -> DataFrame:
    """``rules``: every violated rule of the row."""
    rows = rapid_change(df, key, target_rows)
    extra = _present([
        (both_pedals(scale), "throttle_and_brake"), (F.col("speed_jump"), "speed_jump"),
        (F.col("battery_jump"), "battery_jump"),
    ])
    return rows.withColumn("rules", F.concat(range_rules(scale), extra))


def risk(probability: Column, rule_fired: Column) -> dict[str, Column]:
    """Tier, final decision and boosted confidence."""
    p = probability
    return {
        "tier": F.when(p > 0.5, "attack").when(p > 0.3, "elevated").otherwise("normal"),
        "is_attack": (p > 0.5) | rule_fired,
        "confidence": F.when(rule_fired & (p > 0.3), F.least(p + 0.2, F.lit(1.0))).otherwise(p),
    }


def is_anomaly(score: Column, threshold: Column) -> Column:
    """Score above threshold; never before calibration (null threshold)."""
    return F.coalesce(score > threshold, F.lit(False))


def detection_counters(df: DataFrame, keys: list[str], flag: str = "is_attack") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(flag)).alias("detections"),
        (100.0 * F.avg(F.col(flag).cast("double"))).alias("detection_rate"),
    )
