"""Incremental forms: new files once, running error rates, and bounded merging of segments as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def new_files(spark: SparkSession, folder: str, schema: StructType, files_a_batch: int = 100) -> DataFrame:
    """A stream of Parquet files; the checkpoint of its query remembers which have been read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is new and stops; run again, it goes on where it stopped, and each input counts once."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def running_rate(stream: DataFrame, keys: list[str], edits: str = "edits", total: str = "n_ref") -> DataFrame:
    """Edits and words so far by key."""
    return stream.groupBy(*keys).agg(F.sum(edits).alias(edits), F.sum(total).alias(total))


def windowed_counts(stream: DataFrame, time: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Rows of each time window; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n")).select("w.start", "w.end", "n")


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """First row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def merged_stream(stream: DataFrame, key: str, max_span: int, max_gap: int) -> DataFrame:
    """Chunks of segments (key, s, e in milliseconds, in order of start within and across batches), as they close.

    The state of a key is its open chunk alone; a chunk is given out when a later segment doesn't fit it.
    """
    kind = stream.schema[key].dataType.simpleString()

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunk = state.get if state.exists else None
        closed = []
        rows = pd.concat(list(frames)).sort_values(["s", "e"])
        for s, e in zip(rows["s"].tolist(), rows["e"].tolist(), strict=True):
            if e <= s:
                continue
            if chunk is not None and e - chunk[0] <= max_span and s - chunk[1] < max_gap:
                chunk = (chunk[0], e, chunk[2] + 1)
            else:
                if chunk is not None:
                    closed.append((group[0], *chunk))
                chunk = (s, e, 1)
        if chunk is not None:
            state.update(chunk)
        yield pd.DataFrame(closed, columns=[key, "chunk_start", "chunk_end", "n"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, chunk_start bigint, chunk_end bigint, n bigint", "s bigint, e bigint, n bigint", "append", GroupStateTimeout.NoTimeout)
