"""Names, schemas and constants shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

SIGNALS = ["speed_kmh", "battery_level", "throttle", "brake", "steering", "gear"]
LOCATION = ["location_x", "location_y"]
WINDOW_FEATURES = SIGNALS + LOCATION
DERIVED = [
    "speed_delta", "throttle_brake_ratio", "message_frequency", "inter_arrival_time",
    "payload_entropy",
]

# The device metrics, in model input order.
DEVICE_METRICS = [
    "cpu_usage_percent", "cpu_temperature_c", "memory_used_mb", "memory_total_mb",
    "memory_usage_percent", "load_average_1min", "throttling_state", "network_rx_bytes",
    "network_tx_bytes", "can_rx_count", "can_tx_count", "can_error_count",
]
EDGE_FEATURES = SIGNALS + LOCATION + DERIVED + DEVICE_METRICS

# Accepted column names per feature; the first one present is taken.
COLUMN_ALIASES = {
    "speed_kmh": ["speed_kmh", "speed", "velocity"],
    "battery_level": ["battery_level", "battery", "soc"],
    "throttle": ["throttle", "throttle_pct"],
    "brake": ["brake", "brake_pct"],
    "steering": ["steering", "steer", "steering_angle"],
    "gear": ["gear", "current_gear"],
    "location_x": ["location_x", "loc_x", "pos_x", "x"],
    "location_y": ["location_y", "loc_y", "pos_y", "y"],
}

# Low byte of the frame ID, signal name, payload kind.
SIGNAL_CODES = [
    (0x23, "speed_kmh", "f32"),
    (0x24, "battery_level", "f32"),
    (0x25, "throttle", "f32"),
    (0x26, "brake", "f32"),
    (0x27, "steering", "f32"),
    (0x28, "gear", "i32"),
]

# Last-known state before a signal was ever seen (gateway form).
STATE_DEFAULTS = {
    "speed_kmh": 0.0, "battery_level": 85.0, "throttle": 0.0, "brake": 0.0, "steering": 0.0,
    "gear": 0.0,
}

WINDOW_LENGTH = 20
N_FEATURES = len(WINDOW_FEATURES)

CAN_FRAMES = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("vehicle_id", T.IntegerType()),
    T.StructField("seq", T.LongType()),
    T.StructField("arbitration_id", T.IntegerType()),
    T.StructField("data", T.BinaryType()),
    T.StructField("is_error", T.BooleanType()),
    T.StructField("is_remote", T.BooleanType()),
])

LABELLED_TELEMETRY = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("vehicle_model", T.StringType()),
    T.StructField("speed_kmh", T.DoubleType()),
    T.StructField("location_x", T.DoubleType()),
    T.StructField("location_y", T.DoubleType()),
    T.StructField("location_z", T.DoubleType()),
    T.StructField("throttle", T.DoubleType()),
    T.StructField("brake", T.DoubleType()),
    T.StructField("steering", T.DoubleType()),
    T.StructField("gear", T.IntegerType()),
    T.StructField("tampered", T.BooleanType()),
    T.StructField("tampering_type", T.StringType()),
])

ATTACK_LOG = T.StructType([
    T.StructField("attack_type", T.StringType()),
    T.StructField("start_time", T.TimestampType()),
    T.StructField("end_time", T.TimestampType()),
    T.StructField("trigger_type", T.StringType()),
])

# Signal name in a packet -> column in flat telemetry. Fixed values.
PACKET_SIGNALS = {
    "Speed (km/h)": "speed_kmh",
    "Battery Level (%)": "battery_level",
    "Throttle": "throttle",
    "Brake": "brake",
    "Steering": "steering",
    "Gear": "gear",
}

SIGNAL_FIELDS = "value double, timestamp string, raw_timestamp double, attacked string"
DETECTION_FIELDS = "detected boolean, confidence double, method string"

# Recurrent autoencoder tensors, in exchange order (F inputs, H hidden units).
GRU_HIDDEN = 32


def weight_shapes(features: int = N_FEATURES, hidden: int = GRU_HIDDEN) -> dict[str, tuple]:
    joint = features + hidden
    return {
        "Wr": (joint, hidden), "br": (hidden,),
        "Wz": (joint, hidden), "bz": (hidden,),
        "Wn_x": (features, hidden), "Wn_h": (hidden, hidden), "bn": (hidden,),
        "Dec_Wr": (joint, hidden), "Dec_br": (hidden,),
        "Dec_Wz": (joint, hidden), "Dec_bz": (hidden,),
        "Dec_Wn_x": (features, hidden), "Dec_Wn_h": (hidden, hidden), "Dec_bn": (hidden,),
        "Wo": (hidden, features), "bo": (features,),
    }
