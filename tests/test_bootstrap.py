"""Bootstrap draws are numbers inside a task, equal to the digests in SQL."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from vigilbus.functions import noise
from vigilbus.operators import evaluate


def test_draws_equal_the_digest():
    want = [int(hashlib.md5(f"0|17|{i}".encode()).hexdigest()[:13], 16) / 16**13 for i in range(95, 1205)]
    assert (noise.uniforms("0|17", 95, 1205) == np.array(want)).all()


def test_long_columns_are_not_expanded(spark, monkeypatch):
    rows = spark.range(57).select("id", F.sin("id").alias("x"))
    x = np.sin(np.arange(57))
    means = [np.mean([x[int(u * 57)] for u in noise.uniforms(f"0|{b}", 1, 58)]) for b in range(40)]
    for sent in (8_000_000, 10):  # blocks sent to all tasks, or joined one by one
        monkeypatch.setattr(evaluate, "MAX_SMALL_ROWS", 5)
        monkeypatch.setattr(evaluate, "SENT_VALUES", sent)
        out = evaluate.bootstrap_mean(rows, "x", ["id"], n_boot=40)
        # No row for each draw: the plan has no generator.
        assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = out.first()
        assert abs(got.ci_low - np.quantile(means, 0.025)) < 1e-9
        assert abs(got.ci_high - np.quantile(means, 0.975)) < 1e-9
