"""Bus frames: filtering, signal lookup, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilbus.functions import frames as B
from vigilbus.plans.series import positions, small_side


def data_frames(frames: DataFrame) -> DataFrame:
    """Without error and remote frames."""
    return frames.where(~F.col("is_error") & ~F.col("is_remote"))


def split_id(frames: DataFrame) -> DataFrame:
    return frames.withColumns({
        "edge": F.expr("arbitration_id div 256"), "code": F.expr("arbitration_id % 256")})


def map_signals(frames: DataFrame, dim: DataFrame) -> DataFrame:
    """Inner join with the fixed six-row signal dimension on the low ID byte."""
    return split_id(frames).join(small_side(dim), "code")


def unmapped(frames: DataFrame, dim: DataFrame) -> DataFrame:
    return split_id(frames).join(small_side(dim.select("code")), "code", "left_anti")


def decode_signals(frames: DataFrame, dim: DataFrame, endian: str = "big") -> DataFrame:
    """Long signal rows; frames with a short payload give a null value."""
    rows = map_signals(data_frames(frames), dim)
    return rows.withColumn("_w", B.word(F.col("data"), endian)).select(
        "ts", "vehicle_id", "seq", "signal",
        B.value_of(F.col("_w"), F.col("kind")).alias("value"),
        B.signature_flag(F.col("data")).alias("signature_flag"),
    )


def unmarked(frames: DataFrame) -> DataFrame:
    return frames.where(~B.signature_flag(F.col("data")))


def capture_summary(frames: DataFrame) -> DataFrame:
    """Frames and distinct IDs of a capture."""
    per_id = id_counts(frames)
    return per_id.agg(F.sum("n").alias("frames"), F.count(F.lit(1)).alias("distinct_ids"))


def id_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("arbitration_id").agg(F.count(F.lit(1)).alias("n"))


def top_unmapped(frames: DataFrame, dim: DataFrame, k: int = 5) -> DataFrame:
    counts = id_counts(unmapped(data_frames(frames), dim))
    return counts.orderBy(F.col("n").desc(), "arbitration_id").limit(k)


def bus_health(frames: DataFrame, dim: DataFrame) -> DataFrame:
    """Error frames, remote frames, and data frames with an unmapped ID, in one scan."""
    known = small_side(dim.select("code", F.lit(True).alias("_known")))
    joined = split_id(frames).join(known, "code", "left")
    usable = ~F.col("is_error") & ~F.col("is_remote")
    return joined.agg(
        F.count_if("is_error").alias("error_frames"),
        F.count_if("is_remote").alias("remote_frames"),
        F.count_if(usable & F.col("_known").isNull()).alias("unmapped_frames"),
    )


def frames_per_second(frames: DataFrame, seconds: int = 30) -> DataFrame:
    """Frames per second in each status interval and vehicle."""
    slot = F.window("ts", f"{seconds} seconds")
    return frames.groupBy(slot.alias("w"), "vehicle_id").agg(
        (F.count(F.lit(1)) / float(seconds)).alias("fps")
    ).select("vehicle_id", F.unix_micros("w.start").alias("start_us"), "fps")


def modified_replay(frames: DataFrame, dim: DataFrame,
                    target_rows: float | None = None) -> DataFrame:
    """Replay of each vehicle's capture with values alternately doubled and halved, gear moved by one within
    -1..6, unknown IDs scaled byte by byte, and every non-empty payload marked.

    ``kind`` and ``value`` describe the decoded replacement; ``data`` is the scaled and marked
    payload for unknown IDs and the marked original for known ones.
    """
    numbered = positions(frames, ["vehicle_id"], ["ts", "seq"], "_n", target_rows)
    rows = split_id(numbered).join(small_side(dim), "code", "left").withColumn(
        "_w", B.word(F.col("data")))
    up = F.col("_n") % 2 == 1
    data, kind = F.col("data"), F.col("kind")
    plain = B.value_of(F.col("_w"), kind)
    gear = F.when(up, F.least(F.lit(6.0), plain + 1)).otherwise(F.greatest(F.lit(-1.0), plain - 1))
    value = F.when(plain.isNull(), None).when(kind == "i32", gear).when(kind == "f32", plain * F.when(up, 2.0).otherwise(0.5))
    unknown = kind.isNull() & (F.length(data) >= 4)
    return rows.select(
        "ts", "vehicle_id", "seq", "arbitration_id", "signal",
        F.when(up, "increase").otherwise("decrease").alias("modification"),
        value.alias("value"),
        B.mark(F.when(unknown, B.scale_bytes(data, up)).otherwise(data)).alias("data"),
    )
