"""Alignment of a reference token sequence with recognised words: sure anchors first, then a fuzzy match in the gaps.

Ties are a contract. Of several pairings of the same total similarity in a gap the one is given that, read from the end,
leaves out a reference word where it can, else a recognised word, and pairs two words only where both would lose.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Similarity from which two words are alike.
LEAST = 0.75
#: Totals of a pairing held at a time; of a larger gap a row here and there is held, and the rows between are made again.
HELD = 1 << 20
#: Parts that the rows of a larger gap are cut into, and each part again where it has to be.
PARTS = 16
#: Likenesses known at a time.
KNOWN = 500_000
#: Places after the pointer in which a segment's words are sought.
REACH = 400


def anchors(ref: list[str], hyp: list[str]) -> list[tuple[int, int, float]]:
    """(ref place, hyp place, 1.0) of equal words in matching blocks: longest blocks first, recursively on both sides."""
    blocks = difflib.SequenceMatcher(None, ref, hyp, autojunk=False).get_matching_blocks()
    return [(b.a + k, b.b + k, 1.0) for b in blocks for k in range(b.size)]


class Likeness(dict):
    """Similarities of pairs of words of at least ``least``, each pair compared once; the others are 0."""

    def __init__(self, least: float) -> None:
        super().__init__()
        self.least = least

    def __missing__(self, pair: tuple[str, str]) -> float:
        one, two = pair
        value = 0.0
        # Twice the shorter length by both lengths is the most that a ratio can be.
        if 2 * min(len(one), len(two)) >= self.least * (len(one) + len(two)):
            found = difflib.SequenceMatcher(None, one, two, autojunk=False).ratio()
            value = found if found >= self.least else 0.0
        self[pair] = value
        return value

    def alike(self, ref: list[str], hyp: list[str]) -> Alike:
        """The similarities of all pairs of places, by distinct words."""
        rows, cols = (dict.fromkeys(words) for words in (ref, hyp))
        for words in (rows, cols):
            words.update((w, k) for k, w in enumerate(words))
        known = [self.row(w, cols) for w in rows] if len(rows) * len(cols) <= 64 else self.rows(list(rows), list(cols))
        return Alike([rows[w] for w in ref], np.array([cols[w] for w in hyp], np.int64), known, len(cols))

    def row(self, word: str, cols: Iterable[str]) -> tuple[list[int], list[float]]:
        """The places in ``cols`` of words like ``word``, and how like it they are."""
        found = [(k, v) for k, c in enumerate(cols) if (v := self[word, c]) > 0]
        return [k for k, _ in found], [v for _, v in found]

    def rows(self, rows: list[str], cols: list[str]) -> list[tuple[list[int], list[float]]]:
        """:meth:`row` of each of ``rows``, where only pairs that share letters enough are compared.

        Matching blocks can't have more of a letter than either word has, so the likeness reckoned from that is the most
        that a ratio can be.
        """
        letters = {c: k for k, c in enumerate(dict.fromkeys("".join(rows + cols)))}
        counts = []
        for words in (rows, cols):
            held = np.zeros((len(letters), len(words)), np.int32)
            np.add.at(held, ([letters[c] for w in words for c in w], np.repeat(np.arange(len(words)), [len(w) for w in words])), 1)
            counts.append(held)
        lengths, out = [held.sum(axis=0) for held in counts], []
        some = max(1, HELD // len(cols))
        for at in range(0, len(rows), some):
            shared = np.zeros((len(rows[at : at + some]), len(cols)), np.int32)
            for one, two in zip(counts[0][:, at : at + some], counts[1], strict=True):
                mine, theirs = np.nonzero(one)[0], np.nonzero(two)[0]
                shared[np.ix_(mine, theirs)] += np.minimum.outer(one[mine], two[theirs])
            near = 2.0 * shared / np.maximum(1, lengths[0][at : at + some, None] + lengths[1]) >= self.least
            for word, row in zip(rows[at : at + some], near, strict=True):
                found = [(int(k), v) for k in np.nonzero(row)[0] if (v := self[word, cols[k]]) > 0]
                out.append(([k for k, _ in found], [v for _, v in found]))
                if len(self) > KNOWN:
                    self.clear()
        return out


class Alike:
    """Similarities of all pairs of places of two lists of words, of which a row is made when it is asked for."""

    def __init__(self, row_of: list[int], col_of: np.ndarray, known: list[tuple[list[int], list[float]]], distinct: int) -> None:
        self.row_of, self.col_of, self.known, self.distinct = row_of, col_of, known, distinct
        self.shape = len(row_of), len(col_of)

    def __getitem__(self, i: int) -> np.ndarray:
        row = np.zeros(self.distinct)
        cols, values = self.known[self.row_of[i]]
        row[cols] = values
        return row[self.col_of]


def _below(above: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """The next row of totals: pairs extend the row above by one column, and a running maximum does the columns left out."""
    paired = np.where(alike > 0, above[:-1] + alike, 0.0)
    return np.concatenate(([0.0], np.maximum.accumulate(np.maximum(above[1:], paired))))


def best_pairing(alike: np.ndarray | Alike) -> list[tuple[int, int]]:
    """Pairs in order, of positive likeness each, with the greatest sum of likenesses.

    A whole row of totals is made at a time. The way back reads the totals alone; where they are too many to be held
    (``HELD``), ``PARTS`` rows of them are, and the rows between two of these are made again when the way comes there.
    """
    n, m = alike.shape
    pairs: list[tuple[int, int]] = []
    _way_back(alike, 0, n, np.zeros(m + 1), pairs)
    return pairs[::-1]


def _way_back(alike: np.ndarray | Alike, low: int, high: int, above: np.ndarray, pairs: list[tuple[int, int]]) -> int:
    """Adds the pairs of rows ``low`` to ``high``, last ones first, to ``pairs``; the column at which the way leaves them.

    ``above`` has the totals over row ``low`` as far as the column at which the way comes in.
    """
    j = len(above) - 1
    size = high - low if (high - low + 1) * (j + 1) <= HELD or high - low == 1 else -(-(high - low) // PARTS)
    whole = size == high - low
    totals = [above]
    for i in range(low, high):
        above = _below(above, alike[i][:j])
        if whole or (i + 1 - low) % size == 0:
            totals.append(above)
    if not whole:
        for k in range(-(-(high - low) // size) - 1, -1, -1):
            j = _way_back(alike, low + k * size, min(high, low + (k + 1) * size), totals[k][: j + 1], pairs)
        return j
    i = high - low
    while i and totals[i][j] > 0:
        if totals[i - 1][j] == totals[i][j]:
            i -= 1
        elif totals[i][j - 1] == totals[i][j]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((low + i, j))
    return j


def fuzzy(ref: list[str], hyp: list[str], least: float = LEAST, likeness: Likeness | None = None) -> list[tuple[int, int, float]]:
    """Anchors, and between them the pairing in order of the greatest total similarity, of words at least ``least`` alike."""
    likeness = Likeness(least) if likeness is None else likeness
    found = anchors(ref, hyp)
    ends = np.array([(-1, -1), *((i, j) for i, j, _ in found), (len(ref), len(hyp))])
    sizes = np.diff(ends, axis=0) - 1
    for k in np.nonzero(sizes.min(axis=1) > 0)[0]:
        (row, col), (rows, cols) = ends[k] + 1, sizes[k]
        alike = likeness.alike(ref[row : row + rows], hyp[col : col + cols])
        found += [(int(row + i), int(col + j), float(alike[i][j])) for i, j in best_pairing(alike)]
    return sorted(found)


def aligned(ref: DataFrame, hyp: DataFrame, keys: Sequence[str], exact: bool = False, least: float = LEAST) -> DataFrame:
    """``keys``, ref_place, hyp_place, score: tokens (place, norm) of both sides, matched within each entity."""
    schema = ref.select(*keys).schema.simpleString()[7:-1].replace(":", " ") + ", ref_place bigint, hyp_place bigint, score double"

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("place"), b.sort_values("place")
        one, two = a["norm"].tolist(), b["norm"].tolist()
        pairs = anchors(one, two) if exact else fuzzy(one, two, least)
        head = list(a.iloc[0][list(keys)]) if len(a) else []
        return pd.DataFrame([[*head, a["place"].iloc[i], b["place"].iloc[j], s] for i, j, s in pairs], columns=[*keys, "ref_place", "hyp_place", "score"])

    return ref.groupBy(*keys).cogroup(hyp.groupBy(*keys)).applyInPandas(match, schema)


@F.pandas_udf(LongType())
def matched(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """How many words of ``ref`` are matched, exactly or nearly, with words of ``hyp``; null where ``ref`` is."""
    likeness, out = Likeness(LEAST), []
    for one, two in zip(ref, hyp, strict=True):
        out.append(None if one is None else len(fuzzy(list(one), list(two), likeness=likeness)))
        if len(likeness) > KNOWN:
            likeness.clear()
    return pd.Series(out, dtype="Int64")


def match_counts(texts: DataFrame, keys: Sequence[str], ref: str, hyp: str) -> DataFrame:
    """``keys``, n_ref, n_hyp, matched, unmatched: how much of each entity's reference found a word.

    ``ref`` and ``hyp`` are arrays of words. Where an entity has several rows its words are taken by place, those of equal
    place in the order of the alphabet. One without reference words gives no row. Equal sides aren't compared further.
    """
    sides = F.collect_list(F.struct(F.coalesce(ref, F.array().cast("array<string>")).alias("ref"), F.coalesce(hyp, F.array().cast("array<string>")).alias("hyp")))
    placed = lambda side: F.flatten(F.transform("_sides", lambda s: F.transform(s[side], lambda w, i: F.struct(i, w.alias("w")))))
    words = lambda side: F.when(F.size("_sides") == 1, F.col("_sides")[0][side]).otherwise(F.transform(F.sort_array(placed(side)), lambda x: x.w))
    rows = texts.groupBy(*keys).agg(sides.alias("_sides")).select(*keys, words("ref").alias("_ref"), words("hyp").alias("_hyp")).where(F.size("_ref") > 0)
    n_ref, n_hyp = (F.size(c).cast("bigint") for c in ("_ref", "_hyp"))
    apart = (F.col("_ref") != F.col("_hyp")) & (n_hyp > 0)
    rows = rows.select(*keys, n_ref.alias("n_ref"), n_hyp.alias("n_hyp"), F.when(F.col("_ref") == F.col("_hyp"), n_ref).when(n_hyp == 0, 0).alias("_sure"), *(F.when(apart, F.col(c)).alias(c) for c in ("_ref", "_hyp")))
    rows = rows.withColumn("matched", F.coalesce("_sure", matched("_ref", "_hyp")))
    return rows.select(*keys, "n_ref", "n_hyp", "matched", (F.col("n_ref") - F.col("matched")).alias("unmatched"))


def forward_matches(tokens: DataFrame, segments: DataFrame, keys: Sequence[str], reach: int = REACH) -> DataFrame:
    """``keys``, place, first, last: the tokens (place, norm) that say the words of each segment (place, words).

    Segments are taken in order; each is sought from the end of the last one found, in at most ``reach`` places, as a run
    of equal words. One that isn't found moves nothing. Segments without words give no rows.
    """
    schema = segments.select(*keys).schema.simpleString()[7:-1].replace(":", " ") + ", place bigint, first bigint, last bigint"

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("place"), b.sort_values("place")
        norms, numbers = a["norm"].tolist(), a["place"].tolist()
        # Places of each word, so that only those of a segment's first word are looked at.
        places: dict[str, list[int]] = {}
        for i, norm in enumerate(norms):
            places.setdefault(norm, []).append(i)
        rows, pointer = [], 0
        for place, words in zip(b["place"].tolist(), b["words"].tolist(), strict=True):
            words = list(words) if words is not None else []
            starts = places.get(words[0], []) if words else []
            at = int(np.searchsorted(starts, pointer))
            hit = next((i for i in starts[at:] if i < pointer + reach and norms[i : i + len(words)] == words), None) if words else None
            if hit is not None:
                pointer = hit + len(words)
                rows.append([*b.iloc[0][list(keys)], place, numbers[hit], numbers[pointer - 1]])
        return pd.DataFrame(rows, columns=[*keys, "place", "first", "last"])

    return tokens.groupBy(*keys).cogroup(segments.groupBy(*keys)).applyInPandas(match, schema)
