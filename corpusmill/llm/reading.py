"""Problem 10: reading level of each document.

Each word gets an acquisition grade: the mean grade of the graded texts it stands in, weighed by how often it stands
there and by how much text there is of each grade. A document's level is read off the quantiles of the grades of its
known words, together with the share of unknown ones, calibrated on graded documents whose own words were taken out of
the statistics first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.blocks import with_entries, word_blocks
from corpusmill.llm.wording import bounded, words_of
from corpusmill.session import cut

#: Grades, easiest first.
GRADES = (1, 2, 3, 4)
#: Words, separated by white space, that a document needs to get a level.
LEAST_WORDS = 40
#: Quantiles of a document's known-word grades.
QUANTILES = (0.1, 0.25, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
#: Occurrences, spread evenly over the grades, that each word's distribution starts with.
PRIOR = 0.3
#: Graded documents that the calibration is fitted on, at most: the first in the order of their ids' hashes.
FIT_DOCUMENTS = 5000


def _words(least: int):
    def cutter():
        return lambda text: words_of(text) if len(text.split()) >= least else None

    return cutter


def _counts(least: int):
    """Rows (doc, word, n, total) of the distinct words of each text."""

    def run(batches):
        from collections import Counter

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                rows, words, n, total = [], [], [], []
                for i, text in enumerate(some.column(1).to_pylist()):
                    if text is None or len(text.split()) < least:
                        continue
                    found = Counter(words_of(text))
                    rows += [i] * len(found)
                    words += found.keys()
                    n += found.values()
                    total += [found.total()] * len(found)
                take = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([some.column(0).take(take), some.column(2).take(take), pa.array(words, pa.string()), pa.array(n, pa.int32()), pa.array(total, pa.int32())], names=["doc", "grade", "word", "n", "total"])

    return run


def _features(values: np.ndarray) -> np.ndarray:
    """Quantiles and mean of the known grades among ``values``, and the share of unknown ones; the middle of the scale if none is known."""
    known = np.sort(values[~np.isnan(values)])
    unknown = 1 - len(known) / max(1, len(values))
    if not len(known):
        known = np.array([(GRADES[0] + GRADES[-1]) / 2])
    at = np.array(QUANTILES) * (len(known) - 1)
    low = at.astype(np.int64)
    high = np.minimum(low + 1, len(known) - 1)
    return np.concatenate([known[low] + (known[high] - known[low]) * (at - low), [known.mean(), unknown]])


def _acquisition(counts: list, totals: list):
    """The grade of a word from its occurrences by grade (columns) and the words of each grade (columns)."""
    whole = sum(totals[1:], totals[0])
    rates = [c / F.greatest(t, F.lit(1e-9)) * whole / len(GRADES) + PRIOR / len(GRADES) for c, t in zip(counts, totals, strict=True)]
    return sum((r * g for r, g in zip(rates[1:], GRADES[1:], strict=True)), rates[0] * GRADES[0]) / sum(rates[1:], rates[0])


def _sampled(batches):
    """Features of documents given as lists of word grades."""
    for batch in batches:
        features = [_features(np.array([np.nan if v is None else v for v in x], float)) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(features, pa.list_(pa.float64()))], names=["doc", "grade", "features"])


def _fit(sample: list) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the features and the two-sided cuts of their sum, from (features, grade) rows."""
    x = np.array([[1.0, *r["features"]] for r in sample])
    y = np.array([r["grade"] for r in sample])
    weights = np.linalg.solve(x.T @ x + 1e-3 * np.eye(x.shape[1]), x.T @ y)
    score = x @ weights
    order = np.argsort(score, kind="stable")
    level, cuts = np.rint(y[order]), []
    for grade in GRADES[:-1]:
        # Errors if all up to a place are at most this grade and all after it above.
        above = level > grade
        errors = np.concatenate([[0], np.cumsum(above)]) + np.concatenate([np.cumsum((~above)[::-1])[::-1], [0]])
        best = np.nonzero(errors == errors.min())[0]
        at = int(best[len(best) // 2])
        ends = np.concatenate([[score[order[0]] - 1], score[order], [score[order[-1]] + 1]])
        cuts.append((ends[at] + ends[at + 1]) / 2)
    return weights, np.array(cuts)


def _levels(weights: np.ndarray, cuts: np.ndarray):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts, codes = np.frombuffer(row["documents"], np.int64), np.frombuffer(row["counts"], np.int32), np.frombuffer(row["codes"], np.int32)
                grades = np.full(int(codes.max()) + 1 if len(codes) else 0, np.nan)
                for e in row["entries"] or []:
                    grades[e["number"]] = e["value"]
                values, upto, levels = grades[codes], np.concatenate([[0], np.cumsum(counts)]), []
                for i in range(len(keys)):
                    score = weights[0] + _features(values[upto[i] : upto[i + 1]]) @ weights[1:]
                    levels.append(GRADES[int(np.searchsorted(cuts, score, side="left"))])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(levels, pa.int32())], names=["doc", "grade"])

    return run


def reading_levels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "grade", least_words: int = LEAST_WORDS, fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """``key`` and ``grade`` of each document of at least ``least_words`` words.

    Grades of several raters are averaged; null and out-of-scale grades are left out. Null and shorter texts give no
    row; a document without known words gets the level of the middle of the scale; without any graded document of
    enough words there is no model and no rows. Keys are 64-bit integers; further columns are ignored.
    """
    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text")).where("doc is not null and text is not null")
    given = labels.select(F.col(f"`{key}`").cast("bigint").alias("doc"), F.col(f"`{grade}`").cast("double").alias("grade")).where(F.col("doc").isNotNull() & F.col("grade").between(GRADES[0], GRADES[-1]))
    given = given.groupBy("doc").agg(F.avg("grade").alias("grade"))
    graded = texts.join(bounded(given), "doc").select("doc", "text", "grade")
    words = cut(graded.mapInArrow(_counts(least_words), "doc bigint, grade double, word string, n int, total int"))
    # A grade between two levels counts for both, by nearness.
    shares = [F.greatest(F.lit(0.0), 1 - F.abs(F.col("grade") - g)) for g in GRADES]
    names = [f"g{g}" for g in GRADES]
    lexicon = cut(words.groupBy("word").agg(*(F.sum(F.col("n") * s).alias(a) for s, a in zip(shares, names, strict=True)), F.count("*").alias("texts")))
    totals = lexicon.agg(*(F.coalesce(F.sum(a), F.lit(0.0)).alias(a) for a in names)).first()
    own = words.groupBy("doc", "grade").agg(F.max("total").alias("total")).orderBy(F.xxhash64("doc"), "doc").limit(fit_documents)
    mine = words.join(F.broadcast(own.select("doc")), "doc").join(lexicon, "word")
    rest = [F.greatest(F.lit(0.0), F.col(a) - F.col("n") * s) for a, s in zip(names, shares, strict=True)]
    rest_totals = [F.lit(float(totals[a])) - F.col("total") * s for a, s in zip(names, shares, strict=True)]
    value = F.when(F.col("texts") > 1, _acquisition(rest, rest_totals))
    sample = mine.groupBy("doc", "grade").agg(F.flatten(F.collect_list(F.array_repeat(value, F.col("n")))).alias("values"))
    # Only a few numbers a document come to the driver.
    sample = sample.mapInArrow(_sampled, "doc bigint, grade double, features array<double>").orderBy("doc").collect()
    if not sample:
        return docs.sparkSession.createDataFrame([], f"`{key}` bigint, grade int")
    weights, cuts = _fit(sample)
    grades = lexicon.select("word", _acquisition([F.col(a) for a in names], [F.lit(float(totals[a])) for a in names]).alias("grade"))
    blocks = with_entries(word_blocks(texts, "doc", "text", _words(least_words)), grades, F.col("grade"))
    return blocks.mapInArrow(_levels(weights, cuts), "doc bigint, grade int").withColumnRenamed("doc", key)
