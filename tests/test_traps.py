"""Hand-worked rows for behaviour that is easy to get wrong."""

import datetime as dt
import math
import struct

import pytest
from pyspark.sql import functions as F

from vigilbus.functions import frames as B
from vigilbus.functions import packets as P
from vigilbus.functions import text
from vigilbus.operators import (
    declared, evaluate, features, federated, frames, privacy, rules, scaling, state, windows,
)
from vigilbus.sources import readers, views

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def series(spark, values, column="speed_kmh", step=1.0):
    rows = [(1, at(i * step), i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"vehicle_id int, ts timestamp, seq long, {column} double")


def column(df, name, order="seq"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]


FLOATS = [0.0, -0.0, 1.0, -65.5, 1e-40, -1e-45, 3.4e38, float("inf"), float("-inf"), 0.1]


@pytest.mark.parametrize("endian", ["big", "little"])
def test_float_decoding(spark, endian):
    mark = ">" if endian == "big" else "<"
    data = [(i, bytearray(struct.pack(mark + "f", x) + b"\x01")) for i, x in enumerate(FLOATS)]
    df = spark.createDataFrame(data, "seq int, data binary")
    got = column(df.select("seq", B.float32(F.col("data"), endian).alias("x")), "x")
    want = [struct.unpack(">f", struct.pack(">f", x))[0] for x in FLOATS]
    assert got == want
    assert math.copysign(1, got[1]) == -1


@pytest.mark.parametrize("endian", ["big", "little"])
def test_int_decoding(spark, endian):
    mark = ">" if endian == "big" else "<"
    numbers = [0, 1, -1, 2**31 - 1, -(2**31)]
    data = [(i, bytearray(struct.pack(mark + "i", x))) for i, x in enumerate(numbers)]
    df = spark.createDataFrame(data, "seq int, data binary")
    assert column(df.select("seq", B.int32(F.col("data"), endian).alias("x")), "x") == numbers


def test_short_empty_and_marked_payloads(spark):
    data = [(0, bytearray()), (1, bytearray(b"\x01\x02\x80")), (2, bytearray(b"\x00" * 7 + b"\x7f")),
            (3, bytearray(struct.pack(">f", 3.4e38)[:4]))]
    df = spark.createDataFrame(data, "seq int, data binary").select(
        "seq", B.float32(F.col("data")).alias("x"), B.signature_flag(F.col("data")).alias("s"),
        B.mark(F.col("data")).alias("m"))
    assert column(df, "x")[:2] == [None, None]
    assert column(df, "s") == [False, True, False, True]  # an ordinary float can have the bit
    assert [bytes(m)[-1:] for m in column(df, "m")] == [b"", b"\x80", b"\xff", bytes([0x9E | 0x80])]


def test_gear_stays_in_range_on_replay(spark):
    gears = [6, 6, -1, -1]
    data = [(at(i), 1, i, 0x128, bytearray(struct.pack(">i", g)), False, False)
            for i, g in enumerate(gears)]
    df = spark.createDataFrame(
        data, "ts timestamp, vehicle_id int, seq long, arbitration_id int, data binary,"
              " is_error boolean, is_remote boolean")
    out = frames.modified_replay(df, views.signal_dim(spark))
    assert column(out, "value") == [6.0, 5.0, 0.0, -1.0]
    assert column(out, "modification") == ["increase", "decrease"] * 2


def test_edge_number(spark):
    df = spark.createDataFrame([(0, "edge_2"), (1, "edge"), (2, "a_b_17"), (3, "edge_x")], "seq int, c string")
    assert column(df.select("seq", text.edge_number(F.col("c")).alias("n")), "n") == [2, 1, 17, 1]


def test_aliases_and_required_columns(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0)],
        "SPEED double, soc double, throttle_pct double, brake double, steer double,"
        " current_gear double, pos_x double, y double")
    assert readers.resolve_aliases(df).columns[:2] == ["speed_kmh", "battery_level"]
    with pytest.raises(ValueError, match="location_y"):
        readers.resolve_aliases(df.drop("y"))
    with pytest.raises(ValueError, match="gear"):
        readers.require_columns(df, ["brake", "gear"])


def test_labelled_csv(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(
        "timestamp,vehicle_model,speed_kmh,location_x,location_y,location_z,throttle,brake,steering,"
        "gear,tampered,tampering_type\n"
        "2025-01-13 19:04:28,m,0.0,80.27,16.91,0.0,0.0,0.0,0.0,0,False,none\n"
        "2025-01-13 19:04:29,m,15.7,4690.7,1688.4,0.0,0.85,0.0,0.0,1,True,gps\n")
    rows = readers.labelled_telemetry(spark, str(path)).orderBy("timestamp").collect()
    assert [r["tampered"] for r in rows] == [False, True]
    assert rows[1]["gear"] == 1 and rows[1]["tampering_type"] == "gps"


def test_folder_of_parquet_files(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).write.parquet(str(tmp_path / f"a{i}" / "b"))
    assert readers.load_parquet(spark, str(tmp_path)).count() == 30


def test_location_text(spark):
    df = spark.createDataFrame([("1,2,3",), ("1, 2 ,x",), ("1,2",), ("1,2,3,4",)], "value string")
    assert readers.parse_location(df).count() == 1
    assert readers.parse_location(df, parts=2, exact=False).count() == 4


def test_state_defaults_and_equal_times(spark):
    rows = [(1, at(0), 1, "brake", 5.0), (1, at(0), 0, "brake", 4.0), (1, at(1), 2, "throttle", 7.0)]
    df = spark.createDataFrame(rows, "vehicle_id int, ts timestamp, seq long, signal string, value double")
    out = state.assemble_state(df)
    assert column(out, "brake") == [4.0, 5.0, 5.0]
    assert column(out, "battery_level") == [85.0] * 3


def test_rapid_change_compares_with_the_row_before(spark):
    df = series(spark, [60.0, 60.0, 120.0, 121.0]).withColumn("battery_level", F.lit(85.0))
    assert column(rules.rapid_change(df), "speed_jump") == [False, False, True, False]


def test_rule_rows(spark):
    values = [(60.0 + 60 * i, 85.0 - 15 * i, 100.0 if i else 30.0, 0.0) for i in range(6)]
    rows = [(1, at(i), i, *v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "vehicle_id int, ts timestamp, seq long, speed_kmh double,"
                                     " battery_level double, throttle double, brake double")
    fired = column(rules.all_rules(df), "rules")
    assert fired[0] == [] and set(fired[1]) == {"speed_jump", "battery_jump"}
    assert "speed_high" in fired[5]


def test_range_scale_for_unit_pedals(spark):
    df = spark.createDataFrame([(0, 1.0, 50.0, 0.9, 0.9)], "seq int, speed_kmh double, battery_level double, throttle double, brake double")
    assert column(df.select("seq", rules.both_pedals(100).alias("x")), "x") == [True]
    assert column(df.select("seq", rules.both_pedals().alias("x")), "x") == [False]


def test_rate_is_strictly_below_one_second(spark):
    df = series(spark, [0.0] * 4, step=0.5).select("vehicle_id", "ts", "seq")
    assert column(features.message_rate(df, ["vehicle_id"]), "rate") == [1, 2, 2, 2]


def test_alert_stays_on_for_three_seconds(spark):
    df = series(spark, [0.0] * 6).withColumn("is_attack", F.col("seq") == 1)
    assert column(features.alert_hold(df, ["vehicle_id"]), "alert_on") == [False, True, True, True, True, False]


def test_first_row_features(spark):
    df = series(spark, [10.0, None, 4.0])
    assert column(features.deltas(df, ["speed_kmh"]), "speed_kmh_delta") == [0.0, -10.0, 4.0]
    assert column(features.inter_arrival(df), "inter_arrival_time") == [0.1, 1.0, 1.0]
    assert column(features.row_rate(df), "message_frequency") == [1.0, 2.0, 1.5]
    same = features.row_rate(series(spark, [1.0, 2.0], step=0.0))
    assert column(same, "message_frequency") == [1.0, 2.0]


def test_25_features_from_one_row(spark):
    row = series(spark, [65.5]).withColumns({
        "battery_level": F.lit(82.3), "throttle": F.lit(35.0), "brake": F.lit(0.0),
        "steering": F.lit(2.5), "gear": F.lit(4), "location_x": F.lit(125.3),
        "location_y": F.lit(-45.7), "cpu_usage_percent": F.lit(12.5)})
    v = features.edge_features(row).first()["features"]
    assert len(v) == 25 and v[:8] == [65.5, 82.3, 35.0, 0.0, 2.5, 4.0, 125.3, -45.7]
    assert v[8:13] == [0.0, 0.0, 1.0, 0.1, 0.0] and v[13] == 12.5 and v[14:] == [0.0] * 11


def test_population_std_and_constant_features(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    z = {r["feature"]: r for r in scaling.zscore_fit(df, ["a", "b"]).collect()}
    assert z["a"]["scale"] == pytest.approx(1.2472191) and z["b"]["scale"] == 1.0
    assert not z["a"]["fitted"]
    m = scaling.constants(scaling.minmax_fit(df, ["a", "b"]))
    assert column(scaling.apply(df, m), "b", "a") == [0.0, 0.0, 0.0]


def test_training_windows_need_a_row_after_them(spark):
    assert windows.training(series(spark, [1.0] * 40), ["speed_kmh"]).count() == 1
    assert windows.training(series(spark, [1.0] * 41), ["speed_kmh"]).count() == 2
    assert windows.training(series(spark, [1.0] * 70), ["speed_kmh"], stride=1, cap=7).count() == 7
    assert windows.sliding(series(spark, [1.0] * 40), ["speed_kmh"]).count() == 21
    assert windows.sliding(series(spark, [1.0] * 19), ["speed_kmh"]).count() == 0


def test_padding_in_front(spark):
    df = series(spark, [3.0, 4.0])
    zero = windows.padded_short(df, ["speed_kmh"], 4).first()["w"]
    first = windows.padded_short(df, ["speed_kmh"], 4, "first").first()["w"]
    assert zero == [[0.0], [0.0], [3.0], [4.0]] and first == [[3.0], [3.0], [3.0], [4.0]]


def test_calibration_needs_more_than_twenty(spark):
    df = spark.range(20).select(F.col("id").cast("double").alias("score"))
    assert evaluate.calibrate(df).first()["threshold"] is None
    more = spark.range(101).select(F.col("id").cast("double").alias("score"))
    assert evaluate.calibrate(more).first()["threshold"] == pytest.approx(99 * 1.5)


def test_quality_without_positives(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "score double, label int")
    row = evaluate.confusion(df, F.lit(1.0)).first()
    assert (row["precision"], row["recall"], row["f1"], row["fp_rate"]) == (0.0, 0.0, 0.0, 0.0)


def test_constant_reconstruction_has_no_correlation(spark):
    df = spark.createDataFrame([(1, 1.0, 3.0), (1, 2.0, 3.0)], "trial int, t double, r double")
    row = evaluate.reconstruction(df, ["trial"], [1.5]).first()
    assert row["pearson_r"] == 0.0 and row["mae"] == 1.5 and row["tol_0"] == 0.5


def test_round_ten_comes_after_nine(spark, tmp_path):
    path = str(tmp_path / "rounds")
    for n in (9, 10):
        federated.save_round(spark.createDataFrame([(n, "k", 0, float(n))], "round int, key string, idx int, value double"), path)
    assert federated.load_latest(spark, path).first()["value"] == 10.0


def test_average_without_samples_is_null(spark):
    w = spark.createDataFrame([("a", 1, 1, "k", 0, 2.0)], "client_id string, round int, update_id int, key string, idx int, value double")
    u = spark.createDataFrame([("a", 1, 1, 0)], "client_id string, round int, update_id int, num_samples long")
    assert federated.average(w, u).first()["value"] is None


def test_rollback_every_third_worse_cycle(spark):
    losses = [5.0, 4.0, 4.5, 4.2, 4.1, 6.0, 6.0, 6.0, 3.0]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(losses)], "client_id string, cycle int, loss double")
    out = federated.rollback(df)
    assert column(out, "worse_streak", "cycle") == [0, 0, 1, 2, 3, 4, 5, 6, 0]
    assert [i for i, x in enumerate(column(out, "rollback", "cycle")) if x] == [4, 7]


def test_phase_switch_is_permanent(spark):
    losses = [1.0, 0.99, 0.5, 0.4, 0.3, 0.29, 0.1, 0.05]
    df = spark.createDataFrame(list(enumerate(losses, 1)), "round int, avg_loss double")
    out = federated.phases(df)
    assert column(out, "phase", "round") == ["early"] * 5 + ["late"] * 3
    assert column(out, "interval_s", "round")[-1] == 3600


def test_divergence_without_reference(spark):
    cur = spark.createDataFrame([("a", "k", 0, 1.0), ("b", "k", 0, 1.0)], "client_id string, key string, idx int, value double")
    out = federated.divergence(cur, cur.where("client_id = 'a'"))
    assert column(out, "divergence", "client_id") == [0.0, float("inf")]


def test_each_event_pays_the_delta_term(spark):
    df = spark.createDataFrame([("a", i, 1.0, 0.1, 1) for i in range(3)], "client_id string, step int, noise_multiplier double, sample_rate double, steps int")
    each, term = 0.01 + math.log(1e5), math.log(1e5)
    assert column(privacy.ledger(df, 100.0), "epsilon_spent", "step")[-1] == pytest.approx(3 * each)
    composed = privacy.ledger(df, 100.0, composed=True)
    assert column(composed, "epsilon_spent", "step")[-1] == pytest.approx(0.03 + term)
    silent = df.withColumn("noise_multiplier", F.lit(0.0))
    assert column(privacy.ledger(silent, 100.0), "exhausted", "step") == [True] * 3


def test_any_marked_signal_marks_the_packet(spark):
    body = "struct<value:double,raw_timestamp:double,attacked:string>"
    df = spark.createDataFrame([(0, (1.0, 2.0, "no"), (1.0, 2.0, "yes")), (1, (1.0, 2.0, "no"), None)],
                               f"seq int, a {body}, b {body}")
    assert column(df.select("seq", P.any_attacked(["a", "b"]).alias("x")), "x") == [True, False]


def test_interpolation_at_the_ends(spark):
    out = declared.fill_missing(series(spark, [None, 2.0, None, None, 8.0, None]), "speed_kmh")
    assert column(out, "speed_kmh") == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0]


def test_bootstrap_leaves_out_nulls_by_either_path(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(i, None if i % 3 == 0 else float(i * i)) for i in range(30)], "id int, x double")
    full = rows.where("x IS NOT NULL")
    want = evaluate.bootstrap_mean(full, "x", ["id"], n_boot=50).first()
    assert want.ci_low < want.mean < want.ci_high
    short = evaluate.bootstrap_mean(rows, "x", ["id"], n_boot=50).first()
    monkeypatch.setattr(evaluate, "MAX_SMALL_ROWS", 5)
    long = evaluate.bootstrap_mean(rows, "x", ["id"], n_boot=50).first()
    for got in (short, long):
        assert got.asDict() == pytest.approx(want.asDict())
    nothing = rows.selectExpr("id", "CAST(NULL AS DOUBLE) AS x")
    monkeypatch.undo()
    assert evaluate.bootstrap_mean(nothing, "x", ["id"], n_boot=5).collect() == []
