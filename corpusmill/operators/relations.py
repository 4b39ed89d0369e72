"""Relational steps that the plans share: latest rows, first and last wins, shards, upserts, ordered sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import cut


def latest(df: DataFrame, keys: Sequence[str], by: Sequence[Column]) -> DataFrame:
    """One row per key, the one with the greatest ``by``: one aggregation with partial results, no sort. Null ``by`` come first."""
    others = [c for c in df.columns if c not in keys]
    order = F.struct(*(b.alias(f"o{i}") for i, b in enumerate(by)))
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.`{c}`").alias(c) for c in others)).select(*df.columns)


def earliest(df: DataFrame, keys: Sequence[str], by: Sequence[Column]) -> DataFrame:
    """One row per key, the one with the least ``by``."""
    others = [c for c in df.columns if c not in keys]
    order = F.struct(*(b.alias(f"o{i}") for i, b in enumerate(by)))
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.`{c}`").alias(c) for c in others)).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` rows, and the ``old`` ones whose keys aren't in ``new``."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def numbered(df: DataFrame, order: Sequence[str], out: str = "_nth") -> DataFrame:
    """``df`` with ``out``, each row's place from 0 in the given order over all rows, without a task that holds them all.

    Rows are put in ranges of the order, each sorted by itself and numbered there, and materialised so; the ranges' sizes,
    one row a range, are summed up.
    """
    ranges = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("id")))
    part, inside = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    sizes = ranges.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = ranges.withColumn("part", part).join(F.broadcast(before), "part")  # one row a partition
    return placed.select("row.*", (F.col("before") + inside).alias(out))


def shard(df: DataFrame, order: Sequence[str], index: int, of: int, within: Sequence[str] = ()) -> DataFrame:
    """Every ``of``-th row from the ``index``-th, in the given order, within each group of ``within``."""
    if within:
        rows = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1)
    else:
        rows = numbered(df, order)
    return rows.where(F.col("_nth") % of == index).drop("_nth")


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows whose key digests come first: the same rows in every engine and partitioning. A top-k plan."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def both_ways(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with ``side``: left, right or both, by one full outer join of the distinct keys."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    side = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")
    return a.join(b, list(keys), "full_outer").select(*keys, side.alias("side"))


def share_of_total(df: DataFrame, value: str, out: str = "total") -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over all rows, as a scalar subquery."""
    return df.withColumn(out, df.agg(F.sum(value)).scalar())
