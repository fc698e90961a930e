"""Thresholds, detector quality and reconstruction metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilbus.functions import noise
from vigilbus.plans.series import MAX_SMALL_ROWS, positions, running, small_side
from vigilbus.plans.stats import percentile_grid, percentiles

PERCENTILE, SAFETY, MIN_ERRORS = 0.99, 1.5, 20
#: Bootstrap: values that are sent to every task, draws of a task and at a time.
SENT_VALUES, SHARE_DRAWS, DRAWS = 8_000_000, 20_000_000, 8192


def calibrate(scores: DataFrame, score: str = "score", by: Sequence[str] = (),
              fraction: float = PERCENTILE, factor: float = SAFETY, min_rows: int = MIN_ERRORS,
              target_rows: float | None = None) -> DataFrame:
    """``threshold`` = percentile * factor; null with ``min_rows`` scores or fewer."""
    p = percentiles(scores, score, {"p": fraction}, by, target_rows)
    return p.withColumn("threshold", F.when(F.col("n") > min_rows, F.col("p") * factor)).drop("p")


def distribution(scores: DataFrame, score: str = "score", by: Sequence[str] = (),
                 target_rows: float | None = None) -> DataFrame:
    """n, mean, p50, p95, p99 and max of the scores."""
    p = percentiles(scores, score, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, by, target_rows)
    rows = scores.where(F.col(score).isNotNull())
    measures = [F.avg(score).alias("mean"), F.max(score).alias("max")]
    if by:
        return p.join(rows.groupBy(*by).agg(*measures), list(by))
    one = F.lit(1).alias("_one")
    return p.select("*", one).join(rows.agg(*measures).select("*", one), "_one").drop("_one")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def quality(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Precision, recall, F1 and false-positive rate; 0 where undefined."""
    return {
        "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn), "fp_rate": _ratio(fp, fp + tn),
    }


def confusion(scores: DataFrame, threshold: Column, score: str = "score", label: str = "label",
              by: Sequence[str] = ()) -> DataFrame:
    hit, bad = F.col(score) > threshold, F.col(label) == 1
    counts = scores.groupBy(*by).agg(
        F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"),
        F.count_if(~hit & bad).alias("fn"), F.count_if(~hit & ~bad).alias("tn"))
    c = [F.col(n) for n in ("tp", "fp", "fn", "tn")]
    return counts.withColumns(quality(*c))


def auroc_by_family(scores: DataFrame, kind: str = "kind", score: str = "score",
                    label: str = "label", target_rows: float | None = None) -> DataFrame:
    """AUROC of each family's positives against all benign rows, ties counted half."""
    benign = F.col(label) == 0
    counts = scores.groupBy(score).agg(F.count_if(benign).alias("_no"))
    ranked = running(counts.withColumn("_all", F.lit(0)), ["_all"], [score],
                     {"_cum": ("sum", F.col("_no"))}, target_rows)
    below = ranked.select(
        score, ((F.col("_cum") - F.col("_no")) + F.col("_no") / 2.0).alias("_below"))
    families = scores.where(F.col(label) == 1).groupBy(kind, score).agg(
        F.count(F.lit(1)).alias("_n"))
    sums = families.join(below, score).groupBy(kind).agg(
        F.sum("_n").alias("positives"), F.sum(F.col("_n") * F.col("_below")).alias("_wins"))
    total = scores.agg(F.count_if(benign).alias("_negatives")).withColumn("_one", F.lit(1))
    return sums.withColumn("_one", F.lit(1)).join(total, "_one").select(
        kind, "positives",
        F.try_divide("_wins", F.col("positives").cast("double") * F.col("_negatives"))
        .alias("auroc"))


def sweep_fractions(low: float = 50.0, high: float = 99.9, points: int = 200) -> list[float]:
    return [(low + (high - low) * i / (points - 1)) / 100 for i in range(points)]


def threshold_sweep(scores: DataFrame, score: str = "score", label: str = "label",
                    fractions: Sequence[float] | None = None,
                    target_rows: float | None = None) -> DataFrame:
    """Confusion and F1 at each distinct candidate threshold (evenly spaced percentiles)."""
    grid = percentile_grid(scores, score, label, fractions or sweep_fractions(), target_rows)
    rows = grid.select(
        F.col("point").alias("threshold"), (F.col("_all_yes") - F.col("_yes")).alias("tp"),
        (F.col("_all_no") - F.col("_no")).alias("fp"), F.col("_yes").alias("fn"),
        F.col("_no").alias("tn"))
    return rows.withColumns(quality(*[F.col(n) for n in ("tp", "fp", "fn", "tn")]))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Row with the highest F1; the lowest threshold wins ties."""
    chosen = F.max_by(F.struct("threshold", "f1", "precision", "recall"),
                      F.struct("f1", -F.col("threshold")))
    return sweep.agg(chosen.alias("_b")).select("_b.*")


def head_to_head(metrics: DataFrame, detectors: Sequence[str]) -> DataFrame:
    """(metric, detector, value) rows as one column per detector."""
    return metrics.groupBy("metric").pivot("detector", list(detectors)).agg(F.first("value"))


def recent_stats(scores: DataFrame, threshold: Column, score: str = "score") -> DataFrame:
    return scores.groupBy("vehicle_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(score).alias("min"), F.avg(score).alias("mean"),
        F.max(score).alias("max"), F.count_if(F.col(score) > threshold).alias("above"))


def squared_error(w: Column, r: Column) -> Column:
    """Mean squared difference of two number arrays."""
    parts = F.zip_with(w, r, lambda a, b: (a - b) * (a - b))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(w)


def step_errors(w: Column, r: Column) -> Column:
    """Mean squared error of each step of two windows."""
    return F.zip_with(w, r, squared_error)


def mean_square(w: Column) -> Column:
    """Mean of squares of a flattened window: the model-free score of a z-scored window."""
    v = F.flatten(w)
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) / F.size(v)


def loss_proxy(scores: DataFrame, key: str, order: Sequence[str], first: int = 100,
               at_least: int = 10, score: str = "score",
               target_rows: float | None = None) -> DataFrame:
    """Mean score of the first windows of each key; null if there are too few."""
    rows = positions(scores, [key], order, "_p", target_rows).where(F.col("_p") <= first)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.avg(score).alias("_m")).select(
        key, F.when(F.col("_n") >= at_least, F.col("_m")).alias("loss"))


def pair_elements(pairs: DataFrame, keep: Sequence[str], true: str = "x_true",
                  rebuilt: str = "x_rec") -> DataFrame:
    """One row per element of two equal-length arrays."""
    zipped = F.arrays_zip(F.col(true).alias("t"), F.col(rebuilt).alias("r"))
    rows = pairs.select(*keep, F.posexplode(zipped).alias("pos", "_z"))
    return rows.select(*keep, "pos", F.col("_z.t").cast("double").alias("t"),
                       F.col("_z.r").cast("double").alias("r"))


def reconstruction(elements: DataFrame, by: Sequence[str], tolerances: Sequence[float]) -> DataFrame:
    """MAE, Pearson r (0 for a constant side) and share of elements within each tolerance."""
    error = F.abs(F.col("r") - F.col("t"))
    sr, st = F.stddev_pop("r"), F.stddev_pop("t")
    r = F.when((sr > 1e-9) & (st > 1e-9), F.try_divide(F.covar_pop("r", "t"), sr * st))
    return elements.groupBy(*by).agg(
        F.avg(error).alias("mae"), F.coalesce(r, F.lit(0.0)).alias("pearson_r"),
        *[F.avg((error < tol).cast("double")).alias(f"tol_{i}") for i, tol in enumerate(tolerances)])


def tolerance_curve(elements: DataFrame, high: float = 0.2, points: int = 41) -> DataFrame:
    """Share of elements with an error below each tolerance of an even grid.

    Errors are first counted per grid cell, so rows are not multiplied by the grid.
    """
    error = F.abs(F.col("r") - F.col("t"))
    grid = [high * i / (points - 1) for i in range(points)]
    levels = F.array(*[F.lit(g) for g in grid])
    cell = F.size(F.filter(levels, lambda g: g <= error))
    cells = elements.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    summary = cells.agg(F.sum("_n").alias("_all"),
                        F.collect_list(F.struct("_cell", "_n")).alias("_c"))
    rows = summary.select("_all", "_c", F.posexplode(levels).alias("_i", "tolerance"))
    inside = F.aggregate(F.filter("_c", lambda c: c["_cell"] <= F.col("_i")),
                         F.lit(0).cast("long"), lambda a, c: a + c["_n"])
    return rows.select("tolerance", (inside / F.col("_all")).alias("share"))


def bootstrap_mean(values: DataFrame, value: str, order: Sequence[str], n_boot: int = 10_000,
                   alpha: float = 0.05, seed: int = 0,
                   target_rows: float | None = None) -> DataFrame:
    """Mean and percentile interval of the mean over resamples with replacement.

    Draw i of a resample is a seeded index. The column is sent to the tasks in blocks of values; a task
    draws the indexes of some resamples and adds up those that fall into a block. So a draw is a number
    in a task, never a row. Nulls take no part.
    """
    values = values.where(F.col(value).isNotNull())
    n = values.count()
    spark = values.sparkSession
    numbered = positions(
        values.select(F.col(value).cast("double").alias(value), *order), [], order, "_i", target_rows)
    size = MAX_SMALL_ROWS
    blocks = numbered.groupBy(F.expr(f"(_i - 1) div {size}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("_i", value))).alias("_s")).select(
        "block", F.transform("_s", lambda s: s[value]).alias("v"))
    # One share to a partition, since each meets all blocks.
    shares = min(n_boot, max(spark.sparkContext.defaultParallelism, n * n_boot // SHARE_DRAWS))
    boots = spark.range(0, shares, 1, shares)
    near = F.broadcast(blocks) if n <= SENT_VALUES else blocks

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                              range(batch.num_rows), strict=True))
            for share, found in groupby(rows, lambda r: r[0]):
                here = list(found)
                place = np.full(-(-n // size), -1)  # of a block's first value, if it is here
                place[[b for _, b, _ in here]] = np.arange(len(here)) * size
                x = np.concatenate([batch.column(2)[i].values.to_numpy() for _, _, i in here])
                mine = range(share * n_boot // shares, (share + 1) * n_boot // shares)
                yield pa.RecordBatch.from_pydict({
                    "boot": pa.array(mine, pa.int64()), "part": pa.array(
                        [_drawn_sum(x, place, size, n, f"{seed}|{b}") for b in mine], pa.float64())})

    means = boots.crossJoin(near).mapInArrow(draw, "boot long, part double").groupBy("boot").agg(
        (F.sum("part") / n).alias("_mean"))
    return _mean_band(values, value, means, alpha)


def _drawn_sum(x: np.ndarray, place: np.ndarray, size: int, n: int, prefix: str) -> float:
    """Sum of the values among a resample's ``n`` draws that are in the blocks at hand."""
    total = 0.0
    for start in range(1, n + 1, DRAWS):
        at = np.floor(noise.uniforms(prefix, start, min(start + DRAWS, n + 1)) * n).astype(np.int64)
        if len(x) < n:
            first = place[at // size]
            at = (first + at % size)[first >= 0]
        total += float(x[at].sum())
    return total


def _mean_band(values: DataFrame, value: str, means: DataFrame, alpha: float) -> DataFrame:
    band = percentiles(means, "_mean", {"ci_low": alpha / 2, "ci_high": 1 - alpha / 2})
    one = F.lit(1).alias("_one")
    centre = values.agg(F.avg(value).alias("mean")).select("*", one)
    return band.select("ci_low", "ci_high", one).join(centre, "_one").select(
        "mean", "ci_low", "ci_high", ((F.col("ci_high") - F.col("ci_low")) / 2).alias("halfwidth"))


def best_trial(trials: DataFrame, by: Sequence[str], metric: str, columns: Sequence[str]) -> DataFrame:
    """Row with the lowest metric per group."""
    pick = F.min_by(F.struct(metric, *columns), F.struct(metric, *columns))
    return trials.groupBy(*by).agg(pick.alias("_b")).select(*by, "_b.*")


def pool(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
