"""Ordered computations per key that stay exact when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(...)`` puts a whole key in one task. Every helper
here first asks, with one map-side-combined count, whether any key is heavier than
``target_rows``. If none is, the plain window is used. Otherwise the heavy keys (and only
they) are range-partitioned on (key, order), numbered exactly, and cut into blocks of at most
``target_rows`` consecutive rows. Bounded look-back then needs the last rows of the previous
block copied forward; running values need one small summary row per block.

The number of heavy keys is at most rows / target_rows, and so is the number of blocks; those
are the only tables that are broadcast, and only while they are below ``MAX_SMALL_ROWS``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from vigilbus.session import cut_lineage

TARGET_ROWS = 2_000_000
MAX_SMALL_ROWS = 100_000
SORT_BLOCKS = 4  # blocks per range partition; sorting spills, so these may be larger
BOUNDED = math.inf  # target for callers that know no key is heavy: no check, plain windows

BLOCK, HALO, INDEX = "_block", "_halo", "_index"


def _names(keys: Sequence[str]) -> list[str]:
    return list(keys)


def join_null_safe(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str) -> DataFrame:
    """Equi-join that treats null keys as equal and keeps the left side's key columns."""
    marks = {c: f"_r_{c}" for c in cols}
    renamed = right.withColumnsRenamed(marks)
    condition = reduce(
        lambda a, b: a & b, [left[c].eqNullSafe(renamed[marks[c]]) for c in cols]
    )
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*marks.values())


def small_side(df: DataFrame, limit: int = MAX_SMALL_ROWS) -> DataFrame:
    """Broadcast hint if ``df`` has at most ``limit`` rows; otherwise leave the choice to Spark."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def heavy_keys(df: DataFrame, keys: Sequence[str], target_rows: float) -> DataFrame | None:
    """Keys with more than ``target_rows`` rows, with their counts; None if there are none."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    heavy = counts.where(F.col("_rows") > target_rows)
    found = heavy.limit(MAX_SMALL_ROWS + 1).collect()
    if not found:
        return None
    if len(found) <= MAX_SMALL_ROWS:
        return F.broadcast(df.sparkSession.createDataFrame(found, heavy.schema))
    return cut_lineage(heavy)


def settle(df: DataFrame, keys: Sequence[str], target_rows: float | None = None) -> float:
    """Check for heavy keys once, for operators that order the same rows several times."""
    target = target_rows or TARGET_ROWS
    if target == BOUNDED:
        return target
    heavy = heavy_keys(df, keys, target) if keys else df.limit(target + 1).count() > target
    return BOUNDED if heavy is None or heavy is False else target


@dataclass(frozen=True)
class Layout:
    """Rows plus the columns that identify one independently ordered group."""

    df: DataFrame
    keys: list[str]
    order: list
    blocked: bool

    @property
    def group(self) -> list[str]:
        return self.keys + [BLOCK] if self.blocked else self.keys

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*(self.group or [F.lit(0)])).orderBy(*self.order)

    @property
    def index(self) -> Column:
        """1-based position within the key."""
        local = F.row_number().over(self.window).cast("long")
        return F.coalesce(F.col(INDEX), local) if self.blocked else local


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence, rows: int,
                target_rows: float) -> DataFrame:
    """Exact 1-based position per key in column ``_index``, by range partitioning.

    The range-partitioned rows are written out once, so that partition numbers cannot change
    between the two passes that read them.
    """
    keys = _names(keys)
    parts = max(2, math.ceil(rows / (SORT_BLOCKS * target_rows)))
    ranged = (
        df.repartitionByRange(parts, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    ranged = cut_lineage(ranged).withColumn("_part", F.shiftright("_pos", 33))
    runs = ranged.groupBy(*keys, "_part").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = join_null_safe(ranged, small_side(runs), [*keys, "_part"], "inner")
    return numbered.withColumn(
        INDEX, F.col("_pos") - F.col("_first") + 1 + F.col("_before")
    ).drop("_pos", "_part", "_first", "_before")


def lay_out(df: DataFrame, keys: Sequence[str], order: Sequence, lookback: int = 0,
            target_rows: float | None = None) -> Layout:
    """Prepare ``df`` for ordered work per key; see the module text."""
    keys, order = _names(keys), list(order)
    target = target_rows or TARGET_ROWS
    if target == BOUNDED:
        return Layout(df, keys, order, False)
    if lookback >= target:
        raise ValueError("look-back must be shorter than a block")
    if keys:
        heavy = heavy_keys(df, keys, target)
        if heavy is None:
            return Layout(df, keys, order, False)
        names = heavy.select(*keys)
        hot = join_null_safe(df, names, keys, "left_semi")
        cold = join_null_safe(df, names, keys, "left_anti")
        rows = heavy.agg(F.sum("_rows")).first()[0]
    else:
        rows = df.count()
        if rows <= target:
            return Layout(df, keys, order, False)
        hot, cold = df, None

    numbered = number_rows(hot, keys, order, rows, target)
    zero_based = F.col(INDEX) - 1
    home = F.floor(zero_based / target).cast("long")
    if lookback:
        carried = zero_based % target >= target - lookback
        blocks = F.explode(F.when(carried, F.array(home, home + 1)).otherwise(F.array(home)))
    else:
        blocks = home
    out = numbered.select("*", blocks.alias(BLOCK)).withColumn(HALO, F.col(BLOCK) != home)
    if cold is not None:
        out = out.unionByName(
            cold.withColumns({
                INDEX: F.lit(None).cast("long"), BLOCK: F.lit(0).cast("long"), HALO: F.lit(False),
            })
        )
    return Layout(out, keys, order, True)


def rolling(df: DataFrame, keys: Sequence[str], order: Sequence, lookback: int,
            build: Callable[[WindowSpec, Column], dict[str, Column]],
            target_rows: float | None = None) -> DataFrame:
    """Add columns that look at most ``lookback`` rows back within the key.

    ``build(window, index)`` gets the ordered window without a frame and the 1-based position.
    """
    laid = lay_out(df, keys, order, lookback, target_rows)
    out = laid.df.withColumns(build(laid.window, laid.index))
    if laid.blocked:
        out = out.where(~F.col(HALO)).drop(BLOCK, HALO, INDEX)
    return out


def positions(df: DataFrame, keys: Sequence[str], order: Sequence, name: str,
              target_rows: float | None = None) -> DataFrame:
    """Add the exact 1-based position within the key (or over all rows for no keys)."""
    return rolling(df, keys, order, 0, lambda w, index: {name: index}, target_rows)


_LOCAL = {
    "sum": F.sum, "count": F.count, "min": F.min, "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _block_total(kind: str, name: str, order: Sequence[str]) -> Column:
    value = F.col(name)
    if kind == "last":
        place = F.when(value.isNotNull(), F.struct(*order))
        return F.max_by(value, place)
    return _LOCAL[kind](value)


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "last":
        return F.coalesce(local, carried)
    if kind == "min":
        return F.least(carried, local)
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "count":
        return F.coalesce(carried, F.lit(0)) + local
    return F.when(carried.isNull() & local.isNull(), F.lit(None)).otherwise(
        F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    )


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            values: dict[str, tuple[str, Column]], target_rows: float | None = None) -> DataFrame:
    """Add running values from the first row of the key to the current one.

    ``values`` maps a new column to (kind, input); kinds are sum, count, min, max and last
    (the last non-null input). ``order`` must be column names, ascending.
    """
    laid = lay_out(df, keys, order, 0, target_rows)
    frame = laid.window.rowsBetween(Window.unboundedPreceding, 0)
    if not laid.blocked:
        return laid.df.withColumns({n: _LOCAL[k](c).over(frame) for n, (k, c) in values.items()})

    inputs = {n: f"_in_{n}" for n in values}
    rows = laid.df.withColumns({inputs[n]: c for n, (_, c) in values.items()})
    totals = rows.where(F.col(INDEX).isNotNull()).groupBy(*laid.group).agg(
        *[_block_total(k, inputs[n], order).alias(f"_t_{n}") for n, (k, _) in values.items()]
    )
    earlier = Window.partitionBy(*(laid.keys or [F.lit(0)])).orderBy(BLOCK).rowsBetween(
        Window.unboundedPreceding, -1
    )
    merge = {**_LOCAL, "count": F.sum}
    carry = totals.select(
        *laid.group,
        *[merge[k](F.col(f"_t_{n}")).over(earlier).alias(f"_c_{n}")
          for n, (k, _) in values.items()],
    )
    rows = rows.withColumns(
        {f"_l_{n}": _LOCAL[k](F.col(inputs[n])).over(frame) for n, (k, _) in values.items()}
    )
    joined = join_null_safe(rows, small_side(carry), laid.group, "left")
    out = joined.withColumns(
        {n: _combine(k, F.col(f"_c_{n}"), F.col(f"_l_{n}")) for n, (k, _) in values.items()}
    )
    helpers = [f"{p}{n}" for n in values for p in ("_c_", "_l_", "_in_")]
    return out.drop(BLOCK, HALO, INDEX, *helpers)


def trailing_count(df: DataFrame, keys: Sequence[str], ts: str, span_us: int, name: str,
                   target_rows: float | None = None) -> DataFrame:
    """Rows of the key with ``ts`` in (t - span, t], peers at t included."""
    keys = _names(keys)
    target = target_rows or TARGET_ROWS
    micros = F.unix_micros(ts)
    heavy = None if target == BOUNDED else heavy_keys(df, keys, target)

    def plain(part: DataFrame) -> DataFrame:
        frame = Window.partitionBy(*keys).orderBy("_us").rangeBetween(-(span_us - 1), 0)
        return part.withColumn("_us", micros).withColumn(
            name, F.count(F.lit(1)).over(frame)
        ).drop("_us")

    if heavy is None:
        return plain(df)
    names = heavy.select(*keys)
    hot = join_null_safe(df, names, keys, "left_semi").withColumn("_us", micros)
    # Level of a counter that rises at t and falls at t + span, one row per distinct time.
    rises = hot.groupBy(*keys, "_us").agg(F.count(F.lit(1)).alias("_d"))
    falls = rises.withColumns({"_us": F.col("_us") + span_us, "_d": -F.col("_d")})
    steps = rises.unionByName(falls).groupBy(*keys, "_us").agg(F.sum("_d").alias("_d"))
    levels = running(steps, keys, ["_us"], {name: ("sum", F.col("_d"))}, target).drop("_d")
    counted = join_null_safe(hot, levels, [*keys, "_us"], "inner").drop("_us")
    return plain(join_null_safe(df, names, keys, "left_anti")).unionByName(counted)
