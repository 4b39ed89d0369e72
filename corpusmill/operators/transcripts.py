"""Machine transcripts: gates, time slices, fallbacks between window sets, synopses, phases of a day's lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators.intervals import to_ms
from corpusmill.operators.segments import chunk_labels

#: Least mean log probability and greatest silence probability of a sure segment; the same and words a second of an added one.
SURE_LOGPROB, MOST_SILENCE = -0.6, 0.5
ADDED_LOGPROB, ADDED_PACE = -0.35, 1.0
#: Coverage under which speech windows are taken from the next detector, for recordings of at least so many seconds.
LEAST_COVER, LONG_SECONDS = 0.3, 120.0
LOW_LOGPROB = -1.0


def sure_segments(segments: DataFrame) -> DataFrame:
    """Segments with text that their scores make sure of; null scores are unsure."""
    return segments.where((F.col("avg_logprob") >= SURE_LOGPROB) & (F.col("no_speech_prob") <= MOST_SILENCE) & (F.trim("text") != ""))


def kept_windows(windows: DataFrame) -> DataFrame:
    """Windows (added, logprob, text, start, end) without the added ones that are unsure or hold too few words for their time."""
    pace = text.word_count(F.col("text")) / F.greatest(F.lit(0.001), F.col("end") - F.col("start"))
    doubtful = F.coalesce("added", F.lit(False)) & ((F.col("logprob") < ADDED_LOGPROB) | (pace < ADDED_PACE))
    return windows.where(~F.coalesce(doubtful, F.lit(False)))


def merged_texts(segments: DataFrame, keys: Sequence[str], max_span: float = 28.0, max_gap: float = 1.5) -> DataFrame:
    """Sure segments (start, end, text, avg_logprob) merged: texts joined, the least score kept, n counted."""
    rows = sure_segments(segments).withColumn("s", to_ms(F.col("start"))).withColumn("e", to_ms(F.col("end")))
    rows = chunk_labels(rows, keys, "s", "e", ["text"], round(max_span * 1000), round(max_gap * 1000), "_chunk")
    parts = F.sort_array(F.collect_list(F.struct("s", "e", "text")))  # a chunk's span is bounded
    texts = F.array_join(F.transform(parts, lambda p: F.trim(p.text)), " ")
    merged = rows.groupBy(*keys, "_chunk").agg(F.min("s").alias("chunk_start"), F.max_by("e", F.struct("s", "e", "text")).alias("chunk_end"), texts.alias("text"), F.min("avg_logprob").alias("min_logprob"), F.count("*").alias("n"))
    return merged.drop("_chunk")


def after_head(segments: DataFrame, offset: Column, intro_end: Column, default: float = 7.0) -> DataFrame:
    """Segments that start after the head of a recording: its offset and the end of its intro, where 0 counts as unknown."""
    return segments.where(F.col("start") >= F.coalesce(offset, F.lit(0.0)) + F.coalesce(F.nullif(intro_end, F.lit(0.0)), F.lit(default)))


def time_slice(segments: DataFrame, skip: float = 0.0, length: float | None = None) -> DataFrame:
    """Segments within a stretch of a recording; their times stay those of the whole."""
    rows = segments.where(F.col("end") > skip)
    return rows if length is None else rows.where(F.col("start") < skip + length)


def window_fallback(candidates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """For each recording the windows of the first detector of ``order`` that covers enough of it, else those of the last.

    ``candidates`` has ``keys``, detector, start, end, seconds. Short recordings take the first detector that found any.
    """
    rank = F.array_position(F.array(*(F.lit(o) for o in order)), F.col("detector"))
    by = candidates.where(rank > 0).withColumn("_rank", rank)
    cover = by.groupBy(*keys, "_rank").agg((F.sum(F.col("end") - F.col("start")) / F.max("seconds")).alias("_cover"), F.max("seconds").alias("_seconds"))
    enough = (F.col("_cover") >= LEAST_COVER) | (F.col("_seconds") < LONG_SECONDS) | (F.col("_rank") == len(order))
    best = cover.groupBy(*keys).agg(F.coalesce(F.min(F.when(enough, F.col("_rank"))), F.max("_rank")).alias("_rank"))
    return by.join(best, [*keys, "_rank"]).drop("_rank")


def with_intervals_before(windows: DataFrame, keys: Sequence[str], least: float = 0.4) -> DataFrame:
    """Windows of at least ``least`` seconds with ``silence``, the time since the one before ended."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    return windows.where(F.col("end") - F.col("start") >= least).withColumn("silence", F.col("start") - F.lag("end").over(by))


def low_scores(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments, and those of low probability, of each transcript."""
    return segments.groupBy(*keys).agg(F.count("*").alias("segments"), F.count_if(F.col("avg_logprob") < LOW_LOGPROB).alias("low"))


def synopses(page: Column, pattern: str) -> Column:
    """Array of (label, minutes) that a page's contents name; ``pattern`` has a group for each."""
    labels, minutes = (F.regexp_extract_all(page, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.arrays_zip(labels.alias("label"), minutes.alias("minutes"))


def phases(lines: DataFrame, keys: Sequence[str], place: str, trigger: Column) -> DataFrame:
    """``lines`` with ``phase``: the last non-null trigger of the lines so far, as header, summary, marker and body follow each other."""
    so_far = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("phase", F.last(trigger, True).over(so_far))


def one_letter_off(words: DataFrame, known: DataFrame) -> DataFrame:
    """(word, place, right, votes): letters that known words have at one place of a word, a word's votes split among its candidates.

    An equality join of words with a hole at each place; nothing is compared pairwise.
    """

    def holes(df: DataFrame, name: str) -> DataFrame:
        places = df.select(F.col("word").alias(name), F.explode(F.sequence(F.lit(1), F.length("word"))).alias("place")).where(F.length(name) >= 1)
        hole = F.concat(F.expr(f"substring({name}, 1, place - 1)"), F.lit("\u0001"), F.expr(f"substring({name}, place + 1)"))
        return places.select(name, "place", hole.alias("hole"))

    met = holes(words.select("word").distinct(), "word").join(holes(known.select("word").distinct(), "fixed"), ["place", "hole"]).where("word <> fixed")
    n = met.groupBy("word", "place").agg(F.count("*").alias("n"))
    return met.join(n, ["word", "place"]).select("word", "place", F.expr("substring(fixed, place, 1)").alias("right"), (F.lit(1.0) / F.col("n")).alias("votes"))
