"""Texts as numbers of words, in blocks of documents.

A block lists its own distinct words and, for each document, the sequence of their numbers. What is known of a word can
then be joined to it once a block instead of once an occurrence, and no block grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import kept

#: Characters of text in a block; a longer text is a block of its own.
BLOCK_CHARS = 2_000_000
#: Numbers of lists in a block of these; a longer list is a block of its own.
BLOCK_NUMBERS = 500_000


class _Words(dict):
    """Numbers of distinct words, in order of first use."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _blocks(cutter: Callable[[], Callable[[str], list[str] | None]]):
    """Rows (block, documents, counts, codes, words): codes are the numbers of each document's words in the block."""

    def run(batches):
        part, number, words_in = TaskContext.get().partitionId(), 0, cutter()
        keys: list[int] = []
        runs: list[np.ndarray] = []
        words, held = _Words(), 0

        def block():
            codes = np.concatenate(runs)
            counts = np.array([len(r) for r in runs], np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 33) | number], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (np.array(keys, np.int64), counts, codes)), pa.array([list(words)], pa.list_(pa.string()))],
                names=["block", "documents", "counts", "codes", "words"],
            )

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                found = words_in(text)
                if found is None:
                    continue
                if runs and held + len(text) > BLOCK_CHARS:
                    yield block()
                    number, held, keys, runs, words = number + 1, 0, [], [], _Words()
                keys.append(key)
                runs.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                held += len(text)
        if runs:
            yield block()

    return run


def word_blocks(df: DataFrame, key: str, text: str, cutter: Callable[[], Callable[[str], list[str] | None]]) -> DataFrame:
    """The blocks of ``df``, materialised. ``cutter()`` makes a function from a text to its words, or None to leave it out."""
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text"))
    return kept(rows.mapInArrow(_blocks(cutter), "block bigint, documents binary, counts binary, codes binary, words array<string>"))


def _number_blocks(batches):
    """Rows (block, documents, counts, codes, words) of lists of numbers; a block has lists of one batch."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        keys, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends, flat = ends - ends[0], lists.flatten().to_numpy(zero_copy_only=False)
        at = 0
        while at < len(keys):
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_NUMBERS, side="right")) - 1)
            numbers, codes = np.unique(flat[ends[at] : ends[upto]], return_inverse=True)
            columns = [keys[at:upto].astype(np.int64), np.diff(ends[at : upto + 1]).astype(np.int32), codes.astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 33) | number], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in columns), pa.array([numbers.astype(np.int32)], pa.list_(pa.int32()))],
                names=["block", "documents", "counts", "codes", "words"],
            )
            number, at = number + 1, upto


def id_blocks(df: DataFrame, key: str, ids: str) -> DataFrame:
    """The same blocks of lists of numbers; a block's ``words`` are its distinct numbers. Null lists are empty ones."""
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("doc"), F.coalesce(F.col(f"`{ids}`").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return kept(rows.mapInArrow(_number_blocks, "block bigint, documents binary, counts binary, codes binary, words array<int>"))


def words_in(blocks: DataFrame) -> DataFrame:
    """(block, number, word) of the words of each block."""
    return blocks.select("block", F.posexplode("words").alias("number", "word"))


def with_entries(blocks: DataFrame, values: DataFrame, value: Column) -> DataFrame:
    """``blocks`` with ``entries``, what ``values`` (word, ...) knows of their words as ``value``; null if nothing."""
    entries = words_in(blocks).join(values, "word").groupBy("block").agg(F.collect_list(F.struct("number", value.alias("value"))).alias("entries"))
    return blocks.drop("words").join(entries, "block", "left")
