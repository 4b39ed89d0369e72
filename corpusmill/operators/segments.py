"""Ordered segments of a recording: bounded merging, cutting, time interpolation, clustering."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


#: Milliseconds of a time slice, in which segments look for the one before.
SLICE_MS = 600_000


def _folded(n_keys: int, max_span: int, max_gap: int | None):
    """Chunks of sorted rows (keys, s, e, stretch): the state is one open chunk."""

    def run(batches):
        group, begin, end, n = None, 0, 0, 0
        for batch in batches:
            values = [c.to_pylist() for c in batch.columns]
            out: list[tuple] = []
            for *name, s, e, stretch in zip(*values, strict=True):
                name = (*name, stretch)
                if name == group and e - begin <= max_span and (max_gap is None or s - end < max_gap):
                    end, n = e, n + 1
                    continue
                if n:
                    out.append((*group[:-1], begin, end, n))
                group, begin, end, n = name, s, e, 1
            yield _chunk_rows(out, batch.schema, n_keys)
            schema = batch.schema
        if n:
            yield _chunk_rows([(*group[:-1], begin, end, n)], schema, n_keys)

    return run


def _chunk_rows(rows: list[tuple], schema: pa.Schema, n_keys: int) -> pa.RecordBatch:
    fields = [*(schema.field(i) for i in range(n_keys)), *(pa.field(c, pa.int64()) for c in ("chunk_start", "chunk_end", "n"))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=pa.schema(fields))


def bounded_merge(df: DataFrame, keys: Sequence[str], start: str, end: str, tie: Sequence[str], max_span: int, max_gap: int | None, min_length: int = 0) -> DataFrame:
    """Chunks of consecutive segments: a segment is appended while the span stays within ``max_span`` and the gap under ``max_gap``.

    Returns ``keys``, chunk_start, chunk_end, n. Segments of no positive length are skipped. Sorted rows are folded as they
    stream, with one open chunk as the state, so that time is linear and memory fixed whatever an entity's size. A gap of
    ``max_gap`` or more always begins a chunk, so rows are first cut into stretches at such gaps, and the stretches of an
    entity are folded in different tasks. Without ``max_gap`` each cut depends on the one before, and an entity is one stream.
    """
    rows = _stretches(df.where(F.col(end) > F.col(start)).select(*keys, *dict.fromkeys([start, end, *tie])), keys, start, end, tie, max_gap)
    rows = rows.select(*keys, F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"), "_stretch")
    schema = StructType([*df.select(*keys).schema.fields, *(StructField(c, LongType()) for c in ("chunk_start", "chunk_end", "n"))])
    return rows.mapInArrow(_folded(len(keys), max_span, max_gap), schema).where(F.col("chunk_end") - F.col("chunk_start") >= min_length)


def chunk_labels(df: DataFrame, keys: Sequence[str], start: str, end: str, tie: Sequence[str], max_span: int, max_gap: int | None, out: str = "chunk") -> DataFrame:
    """Rows of positive length with ``out``, a number that the rows of one chunk of :func:`bounded_merge` share.

    Numbers differ between all chunks of a run but aren't the same in every run; group by them, or materialise them.
    """
    rows = _stretches(df.where(F.col(end) > F.col(start)), keys, start, end, tie, max_gap)
    schema = StructType([*rows.schema.fields, StructField(out, LongType())])
    return rows.mapInArrow(_labelled(list(keys), start, end, max_span, max_gap, out), schema).drop("_stretch")


def _labelled(keys: list[str], start: str, end: str, max_span: int, max_gap: int | None, out: str):
    """Adds chunk numbers to sorted rows; the state is one open chunk."""

    def run(batches):
        group, begin, upto, number = None, 0, 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            values = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*keys, "_stretch", start, end)]
            labels = []
            for *name, s, e in zip(*values, strict=True):
                if name != group or e - begin > max_span or (max_gap is not None and s - upto >= max_gap):
                    group, begin, number = name, s, number + 1
                upto = e
                labels.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.int64())], names=[*batch.schema.names, out])

    return run


def _stretches(rows: DataFrame, keys: Sequence[str], start: str, end: str, tie: Sequence[str], max_gap: int | None) -> DataFrame:
    """``rows`` with ``_stretch``, parted by stretch and sorted inside: a gap of ``max_gap`` or more begins a stretch."""
    columns = rows.columns
    if max_gap is None:
        rows = rows.withColumn("_stretch", F.lit(0).cast("bigint"))
    else:
        # The segment before may be in an earlier slice: slices carry their last segment's end and their last stretch's start.
        rows = rows.withColumn("_slice", F.floor(F.col(start) / SLICE_MS))
        order = F.struct(start, end, *tie)
        inside = Window.partitionBy(*keys, "_slice").orderBy(start, end, *tie)
        over_slices = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        ends = rows.groupBy(*keys, "_slice").agg(F.max_by(end, order).alias("_last")).withColumn("_carry", F.last("_last").over(over_slices)).drop("_last")
        seen = _by_slice(rows, ends, keys)
        before = F.coalesce(F.lag(end).over(inside), F.col("_carry"))
        seen = seen.withColumn("_begin", F.when(before.isNull() | (F.col(start) - before >= max_gap), F.col(start))).drop("_carry")
        begun = seen.groupBy(*keys, "_slice").agg(F.max("_begin").alias("_last")).withColumn("_open", F.max("_last").over(over_slices)).drop("_last")
        local = F.max("_begin").over(inside.rowsBetween(Window.unboundedPreceding, 0))
        rows = _by_slice(seen.withColumn("_local", local), begun, keys).withColumn("_stretch", F.coalesce("_local", "_open").cast("bigint"))
    return rows.select(*columns, "_stretch").repartition(*keys, "_stretch").sortWithinPartitions(*keys, "_stretch", start, end, *tie)


def _by_slice(rows: DataFrame, slices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with what ``slices`` know of their slice; null keys are keys."""
    same = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in (*keys, "_slice")]
    return rows.alias("a").join(slices.alias("b"), same).select("a.*", *(f"b.`{c}`" for c in slices.columns if c not in (*keys, "_slice")))


def cluster(df: DataFrame, keys: Sequence[str], position: str, most: float, tie: Sequence[str], out: str = "cluster") -> DataFrame:
    """``df`` with ``out``: a new cluster where the step from the value before is more than ``most``."""
    order = Window.partitionBy(*keys).orderBy(position, *tie)
    jump = F.coalesce((F.col(position) - F.lag(position).over(order) > most).cast("int"), F.lit(0))
    return df.withColumn("_jump", jump).withColumn(out, F.sum("_jump").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_jump")


def runs(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], value: str) -> DataFrame:
    """Runs of equal consecutive values: ``keys``, value, run, n."""
    order = Window.partitionBy(*keys).orderBy(*order_by)
    new = F.coalesce((F.col(value) != F.lag(value).over(order)).cast("int"), F.lit(0))
    marked = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "run").agg(F.min(value).alias(value), F.count("*").alias("n"))


def interpolated(df: DataFrame, keys: Sequence[str], place: str, time: str, weight: str) -> DataFrame:
    """``df`` with ``time_between``: known times, and between two known ones times in proportion to the weights passed."""
    order = Window.partitionBy(*keys).orderBy(place)
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    x = df.withColumn("_sum", F.sum(weight).over(before))
    known = F.col(time).isNotNull()
    x = x.withColumn("_t0", F.last(time, True).over(before)).withColumn("_w0", F.last(F.when(known, F.col("_sum")), True).over(before))
    x = x.withColumn("_t1", F.first(time, True).over(after)).withColumn("_w1", F.first(F.when(known, F.col("_sum")), True).over(after))
    part = (F.col("_sum") - F.col("_w0")) / F.nullif(F.col("_w1") - F.col("_w0"), F.lit(0))
    return x.withColumn("time_between", F.when(known, F.col(time)).otherwise(F.col("_t0") + (F.col("_t1") - F.col("_t0")) * part)).drop("_sum", "_t0", "_w0", "_t1", "_w1")


def cut_score(para_end: Column, sentence_end: Column, comma: Column, pause: Column, anchored_edge: Column) -> Column:
    """How good a place a token's end is to cut at: paragraph, sentence, comma, pause, and the edge of sure times."""
    return F.when(para_end, 3.0).otherwise(0.0) + F.when(sentence_end, 2.0).otherwise(0.0) + F.when(comma, 1.0).otherwise(0.0) + F.when(pause >= 0.3, 1.0 + F.least(pause, F.lit(1.5))).otherwise(0.0) + F.when(anchored_edge, 0.5).otherwise(0.0)


def best_cut_chunks(starts: np.ndarray, ends: np.ndarray, scores: np.ndarray, max_seconds: float = 28.0) -> list[tuple[int, int]]:
    """Token ranges: from each first token, the last of the best-scored ends within ``max_seconds``; the rest if it fits."""
    out, at, n = [], 0, len(starts)
    while at < n:
        fits = at + int(np.searchsorted(ends[at:], starts[at] + max_seconds, side="right"))
        if fits >= n:
            stop = n
        elif fits <= at + 1:
            stop = at + 1
        else:
            part = scores[at:fits]
            stop = at + len(part) - int(np.argmax(part[::-1]))
        out.append((at, stop))
        at = stop
    return out


def chunked(tokens: DataFrame, keys: Sequence[str], max_seconds: float = 28.0, min_seconds: float = 1.0, pad: float = 0.15) -> DataFrame:
    """Chunks of each entity's tokens (place, surface, start, end, score): one recording is one group, as cuts depend on the cut before."""
    schema = tokens.select(*keys).schema.simpleString()[7:-1].replace(":", " ") + ", chunk bigint, start double, end double, n_words bigint, text string"

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        starts, ends = frame["start"].to_numpy(), np.maximum.accumulate(frame["end"].to_numpy())
        rows, before = [], 0.0
        for a, b in best_cut_chunks(starts, ends, frame["score"].to_numpy(), max_seconds):
            start, end = max(before, starts[a] - pad, 0.0), ends[b - 1] + pad
            if end - start >= min_seconds:
                rows.append([*frame.iloc[0][list(keys)], len(rows), start, end, b - a, " ".join(frame["surface"].iloc[a:b])])
            before = end
        return pd.DataFrame(rows, columns=[*keys, "chunk", "start", "end", "n_words", "text"])

    return tokens.groupBy(*keys).applyInPandas(cut, schema)
