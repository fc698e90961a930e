"""Window scores on a stream while the model changes.

Rounds of weights land in a table (``federated.save_round``) as the federation goes on. Every
micro-batch takes the newest round that is there when it first runs, and notes which. A batch that runs
again reads the note, not the table's newest round, so its scores and their round stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilbus.models import train
from vigilbus.streaming import batches


def noted_round(spark: SparkSession, models: str, note: str) -> int:
    """The round in ``note``, or else the newest of ``models``, which is then noted."""
    try:
        return spark.read.schema("round int").parquet(note).first()["round"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    newest = spark.read.parquet(models).agg(F.max("round").cast("int").alias("round"))
    newest.coalesce(1).write.mode("overwrite").parquet(note)
    return spark.read.schema("round int").parquet(note).first()["round"]


def score_with_newest(stream: DataFrame, net, columns: Sequence[str], models: str, limits: DataFrame | None,
                      folder: str, target_rows: float | None = None,
                      keep_s: float | None = None) -> StreamingQuery:
    """Score of every window as it completes, with the round of the weights that gave it.

    Input: ts, us, vehicle_id, seq and the columns. ``models``: folder of (key, idx, value, round);
    ``limits``: (round, threshold), by which ``alarm`` is set where the round has a threshold.
    """
    slide = batches.online_windows(columns, net.length, target_rows)
    kind = dict(stream.dtypes)["vehicle_id"]

    def choose(spark: SparkSession, number: int) -> batches.Step:
        used = noted_round(spark, models, f"{folder}/round/batch={number}")
        weights = spark.read.parquet(models).where(F.col("round") == used)
        shared = spark.sparkContext.broadcast(train.to_params(net, weights))
        row = None if limits is None else limits.where(F.col("round") == used).first()
        limit = None if row is None else row["threshold"]

        def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                if len(pdf):
                    flat = np.stack(pdf["flat"].to_numpy()).astype(float)
                    yield pdf[["vehicle_id", "end_seq"]].assign(score=net.scores(shared.value, flat))

        def step(rows: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
            done, after = slide(rows, held)
            scored = done.mapInPandas(score, f"vehicle_id {kind}, end_seq long, score double")
            return scored.withColumns({
                "round": F.lit(used), "alarm": F.col("score") > F.lit(limit).cast("double")}), after

        return step

    return batches.follow_each(stream, choose, folder, keep_s=keep_s)
