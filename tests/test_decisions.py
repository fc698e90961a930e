"""A client's cycle decisions, by hand."""

from vigilbus.operators import decisions

SCHEMA = ("client_id string, time_s double, event long, kind string, round int, weights array<double>, "
          "loss double, requested boolean")


def run(spark, events):
    rows = [("c", 1000.0 * i, i, *e) for i, e in enumerate(events)]
    out = decisions.cycle_decisions(spark.createDataFrame(rows, SCHEMA)).orderBy("event").collect()
    return [(r.reason, r.send, r.calibrated) for r in out]


def cycle(round_no, loss, requested=False, w=0.0):
    return ("cycle", round_no, [w, w], loss, requested)


def test_a_request_waits_for_the_end_of_a_rollback(spark):
    got = run(spark, [cycle(1, 1.0), cycle(2, 2.0), cycle(3, 2.0), cycle(4, 2.0, True), cycle(5, 2.0)])
    assert got == [("initial", True, True), ("concept_drift", True, True), ("waiting", False, True),
                   ("rolled_back", False, True), ("server_request", True, True)]


def test_a_global_model_is_the_reference_and_resets_calibration(spark):
    got = run(spark, [("global", 0, [0.5, 0.5], None, None), cycle(1, 1.0, w=0.5),
                      ("global", 1, [9.0, 9.0], None, None), cycle(2, 0.99, w=9.0), cycle(2, 0.98, w=20.0),
                      cycle(2, 0.97, w=40.0)])
    assert got[0] == ("global_model", False, False)
    assert got[1] == ("concept_drift", True, True)  # no loss known before
    assert got[2] == ("global_model", False, False)
    assert got[3] == ("waiting", False, True)
    assert got[4] == ("weight_divergence", True, True)
    assert got[5] == ("already_sent", False, True)


def test_clients_do_not_mix_and_order_is_by_time(spark):
    rows = [(c, 1000.0 * i, i, *cycle(i, 1.0 / (i + 1))) for i in range(6) for c in ("a", "b")]
    alone = decisions.cycle_decisions(spark.createDataFrame([r for r in rows if r[0] == "a"], SCHEMA))
    both = decisions.cycle_decisions(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5))
    want = sorted(map(str, alone.drop("client_id").collect()))
    for client in ("a", "b"):
        got = both.where(f"client_id = '{client}'").drop("client_id").collect()
        assert sorted(map(str, got)) == want


def test_blocks_of_a_long_history_change_nothing(spark):
    rows = [("c", 500.0 * i, i, *cycle(i // 3, (i * 37 % 11) / 10 + 0.1, i % 17 == 3, w=i * 0.05))
            for i in range(120)]
    frame = spark.createDataFrame(rows, SCHEMA)
    whole, cut = (sorted(map(str, decisions.cycle_decisions(frame, target_rows=t).collect()))
                  for t in (None, 10))
    assert whole == cut and len(whole) == 120
