"""Interval algebra per entity: merged periods and the gaps between them.

Intervals are half-open ``[start, end)`` in whole milliseconds. The intervals of an entity are never gathered in one task:
rows are first reduced to the furthest end per start (at most ``SLICE_MS`` starts in a time slice), and each slice learns
from the earlier ones only the furthest end and the last start of an island so far. What an entity has in one task is one
row a slice, a minute of its time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time slice; also the bound on the rows of a slice after pre-aggregation.
SLICE_MS = 60_000


def to_ms(seconds: Column) -> Column:
    """Seconds to the nearest millisecond; NaN and infinities become null."""
    finite = F.when(~F.isnan(seconds) & (F.abs(seconds) < 9e12), seconds)
    return F.round(finite * 1000).cast("bigint")


def islands(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Periods of covered time per entity, each with the gap before it.

    Returns ``keys``, ``period_start_ms``, ``period_end_ms``, ``gap_start_ms`` (null before the first period).
    Overlapping, nested and touching intervals are one period. Intervals with a null or non-finite bound, or an end not
    after the start in milliseconds, don't count. Null keys are an entity of their own. Repeated rows change nothing;
    an empty table gives no rows; further columns are ignored, whatever their names.
    """
    inner = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(f"`{k}`").alias(a) for k, a in zip(keys, inner, strict=True)), to_ms(F.col(f"`{start}`")).alias("_s"), to_ms(F.col(f"`{end}`")).alias("_e"))
    rows = rows.where(F.col("_e") > F.col("_s")).withColumn("_slice", F.floor(F.col("_s") / SLICE_MS))
    starts = rows.groupBy(*inner, "_slice", "_s").agg(F.max("_e").alias("_e"))
    in_slice = Window.partitionBy(*inner, "_slice").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    local = starts.withColumn("_reach", F.max("_e").over(in_slice))
    over_slices = Window.partitionBy(*inner).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*inner, "_slice").agg(F.max("_e").alias("_e")).select(*inner, "_slice", F.max("_e").over(over_slices).alias("_carry"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in inner] + [F.col("a._slice") == F.col("b._slice")]
    seen = local.alias("a").join(carried.alias("b"), same).select("a.*", F.greatest("a._reach", "b._carry").alias("_before"))
    marked = seen.withColumn("_new", (F.col("_before").isNull() | (F.col("_s") > F.col("_before"))).cast("int"))
    # An island is named by its start: the last one begun in the slice so far, else in the slices before.
    marked = marked.withColumn("_begun", F.when(F.col("_new") == 1, F.col("_s")))
    so_far = Window.partitionBy(*inner, "_slice").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    pieces = (
        marked.withColumn("_label", F.max("_begun").over(so_far))
        .groupBy(*inner, "_slice", "_label")
        .agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.min(F.when(F.col("_new") == 1, F.col("_before"))).alias("_gap"))
    )
    last = pieces.groupBy(*inner, "_slice").agg(F.max("_label").alias("_last")).select(*inner, "_slice", F.max("_last").over(over_slices).alias("_open"))
    named = pieces.alias("a").join(last.alias("b"), same).select("a.*", F.coalesce("a._label", "b._open").alias("_island"))
    periods = named.groupBy(*inner, "_island").agg(F.min("_s").alias("period_start_ms"), F.max("_e").alias("period_end_ms"), F.min("_gap").alias("gap_start_ms"))
    return periods.select(*(F.col(a).alias(k) for k, a in zip(keys, inner, strict=True)), "period_start_ms", "period_end_ms", "gap_start_ms")


def merged_periods(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """``keys``, ``period_start_ms``, ``period_end_ms``: see :func:`islands`."""
    return islands(df, keys, start, end).drop("gap_start_ms")


def gaps(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """``keys``, ``gap_start_ms``, ``gap_end_ms``: the uncovered stretches between an entity's periods, at full length."""
    found = islands(df, keys, start, end).where(F.col("gap_start_ms").isNotNull())
    return found.select(*(F.col(f"`{k}`") for k in keys), "gap_start_ms", F.col("period_start_ms").alias("gap_end_ms"))
