"""Problem 4: bodies that are the same text with small changes, over the whole collection.

Signatures have ``SEGMENTS * WIDTH`` positions, each the word that comes first in one random order of all words (rarer
words tend to come first). Two bodies differ at a position with the share of words, weighed by rarity, that only one of
them has. A signature is cut into few segments, so that similar bodies have one that differs in at most one position:
each segment is indexed with each of its positions left out in turn, equal variants are joined, and pairs are verified
by their words. The chance that a pair of weighed similarity s has no such segment is
``(1 - WIDTH * s**(WIDTH-1) + (WIDTH-1) * s**WIDTH) ** SEGMENTS``: 3e-4 at 0.6 and 1e-6 at 0.7.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.wording import mixed, signed
from corpusmill.session import cut

SIMILAR = 0.6
SEGMENTS, WIDTH = 20, 5
#: Words are maximal runs of the letters alef to tav.
WORD = "[א-ת]+"
_SEED = 0x5D588B656C078965


def _variants(batches):
    """Rows (rep, variant) of the segments of each text's signature with one position left out."""
    n = SEGMENTS * WIDTH
    with np.errstate(over="ignore"):
        orders = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_SEED))
    left = np.array([[p for p in range(WIDTH) if p != q] for q in range(WIDTH)])
    for batch in batches:
        reps, lists = batch.column(0), batch.column(1)
        for at in range(0, batch.num_rows, 200):
            some = lists.slice(at, 200)
            offsets = some.offsets.to_numpy()
            flat = some.flatten()
            words = flat.field(0).to_numpy(zero_copy_only=False).view(np.uint64)
            weights = flat.field(1).to_numpy(zero_copy_only=False)
            starts = (offsets - offsets[0])[:-1]
            with np.errstate(over="ignore"):
                least = np.empty((len(some), n), np.uint64)
                for i in range(n):
                    hashes = mixed(words ^ orders[i])
                    # The first of exponential times with the words' rates: equal words have equal times in every text, so
                    # the least time of a text tells its word.
                    times = -np.log((hashes >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weights
                    least[:, i] = np.minimum.reduceat(times, starts).view(np.uint64)
                parts = least.reshape(len(some), SEGMENTS, WIDTH)
                keys = np.zeros((len(some), SEGMENTS, WIDTH), np.uint64) + (np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(WIDTH))[None, :, None] + np.arange(WIDTH, dtype=np.uint64)[None, None, :]
                for k in range(WIDTH - 1):
                    keys = mixed(keys + mixed(parts[:, :, left[:, k]]))
            yield pa.RecordBatch.from_arrays([reps.slice(at, 200).take(pa.array(np.repeat(np.arange(len(some)), n))), signed(keys.reshape(-1))], names=["rep", "variant"])


def similar_bodies(df: DataFrame, key: str, body: str, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(members, links) of texts whose distinct words overlap by at least ``similar`` of all their distinct words.

    ``members`` (key, rep): the representative of each record's set of words, the least key that has it. ``links``
    (rep_a, rep_b, similarity): pairs of representatives, rep_a < rep_b. Null keys, null texts and texts without a word
    take no part; repeated rows change nothing; empty tables give no rows; further columns are ignored.
    """
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(f"`{body}`"), F.lit(WORD), F.lit(0))))
    rows = df.select(F.col(f"`{key}`").alias("key"), words.alias("words")).where("key is not null and words is not null and size(words) > 0")
    # Sets of words, each once; a set is known by its digest.
    rows = rows.withColumn("set", F.sha2(F.array_join("words", " "), 256))
    sets = cut(rows.groupBy("set").agg(F.min("key").alias("rep"), F.first("words").alias("words")))
    members = rows.select("key", "set").join(sets.select("set", "rep"), "set").select("key", "rep").distinct()
    used = sets.select("rep", F.explode("words").alias("word"))
    total = sets.count()
    rarity = used.groupBy("word").agg(F.log(F.lit(1.0 + total) / F.count("*")).alias("weight"))
    weighed = used.join(rarity, "word").groupBy("rep").agg(F.collect_list(F.struct(F.xxhash64("word").alias("word"), "weight")).alias("words"))
    kind = sets.schema["rep"].dataType.simpleString()
    variants = cut(weighed.mapInArrow(_variants, f"rep {kind}, variant bigint"))
    shared = variants.groupBy("variant").agg(F.count("*").alias("n")).where("n > 1").select("variant")
    variants = variants.join(shared, "variant", "left_semi")
    one, two = variants.select("variant", F.col("rep").alias("rep_a")), variants.select("variant", F.col("rep").alias("rep_b"))
    pairs = one.join(two, "variant").where("rep_a < rep_b").select("rep_a", "rep_b").distinct()
    lists = sets.select("rep", "words")
    pairs = pairs.join(lists.select(F.col("rep").alias("rep_a"), F.col("words").alias("words_a")), "rep_a").join(lists.select(F.col("rep").alias("rep_b"), F.col("words").alias("words_b")), "rep_b")
    both = F.size(F.array_intersect("words_a", "words_b"))
    pairs = pairs.select("rep_a", "rep_b", both.alias("_both"), (F.size("words_a") + F.size("words_b") - both).alias("_all"))
    links = pairs.where(F.col("_both") >= F.col("_all") * F.lit(similar)).select("rep_a", "rep_b", (F.col("_both") / F.col("_all")).alias("similarity"))
    return members, links


def similar_pairs(df: DataFrame, key: str, body: str, similar: float = SIMILAR) -> DataFrame:
    """(``key``_a, ``key``_b, similarity): every pair of records with similar texts, the smaller key first."""
    members, links = similar_bodies(df, key, body, similar)
    links = cut(links)
    one, two = members.select(F.col("rep").alias("rep_a"), F.col("key").alias("_a")), members.select(F.col("rep").alias("rep_b"), F.col("key").alias("_b"))
    apart = links.join(one, "rep_a").join(two, "rep_b").select("_a", "_b", "similarity")
    equal = one.join(two, F.col("rep_a") == F.col("rep_b")).where("_a < _b").select("_a", "_b", F.lit(1.0).alias("similarity"))
    found = apart.unionByName(equal).select(F.least("_a", "_b").alias(f"{key}_a"), F.greatest("_a", "_b").alias(f"{key}_b"), "similarity")
    return found.distinct()


def similar_groups(df: DataFrame, key: str, body: str, similar: float = SIMILAR) -> DataFrame:
    """(``key``, rep, links): the representative of each record's set of words, and its number of links to others."""
    members, links = similar_bodies(df, key, body, similar)
    ends = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(ends, "rep", "left").select(F.col("key").alias(key), "rep", F.coalesce("links", F.lit(0)).alias("links"))
