"""Edit distances of words and characters, error rates and alignments."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

#: First of the code points that stand for words; there are 20,000 up to the surrogates' neighbours.
_FIRST = 0x4E00
ALIGNMENT = ArrayType(StructType([StructField(name, StringType()) for name in ("op", "ref", "hyp")]))


def word_edits(ref: Column, hyp: Column) -> Column:
    """Least number of word insertions, deletions and replacements between arrays of words.

    Each distinct word of the pair becomes one character, and the built-in distance compares the two strings; pairs with
    more than 20,000 distinct words are refused by the character range, so use ``long_edits`` for long texts.
    """
    both = F.array_distinct(F.concat(ref, hyp))

    def packed(words: Column) -> Column:
        codes = F.transform(words, lambda w: F.lpad(F.hex(F.array_position(both, w) + (_FIRST - 1)), 4, "0"))
        return F.decode(F.unhex(F.array_join(codes, "")), "utf-16be")

    return F.levenshtein(packed(ref), packed(hyp)).cast("bigint")


def least_edits(ref: list[str], hyp: list[str]) -> int:
    """Least number of insertions, deletions and replacements between lists of any length and number of distinct words.

    Columns of the distance table are held as bits of two integers, the places where it goes up and down by one.
    """
    n = len(ref)
    if not n:
        return len(hyp)
    places: dict[str, int] = {}
    for i, word in enumerate(ref):
        places[word] = places.get(word, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, total = full, 0, n
    for word in hyp:
        equal = places.get(word, 0)
        steps = (((equal & up) + up) ^ up) | equal | down
        more, less = down | (full & ~(steps | up)), up & steps
        total += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & full, (less << 1) & full
        across = equal | down
        up, down = less | (full & ~(across | more)), more & across
    return total


@F.pandas_udf(LongType())
def long_edits(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """``word_edits`` of long texts."""
    return pd.Series([least_edits(list(r), list(h)) for r, h in zip(ref, hyp, strict=True)], dtype="int64")


def char_edits(ref: Column, hyp: Column, blanks: bool = True) -> Column:
    """Least number of character edits; without ``blanks`` they are dropped first."""
    if not blanks:
        ref, hyp = F.replace(ref, F.lit(" "), F.lit("")), F.replace(hyp, F.lit(" "), F.lit(""))
    return F.levenshtein(ref, hyp).cast("bigint")


def rate(edits: Column, total: Column) -> Column:
    """Edits by total, where a total of 0 counts as 1."""
    return edits / F.greatest(F.lit(1), total)


def align_words(ref: list[str], hyp: list[str]) -> list[tuple[str, str | None, str | None]]:
    """Operations of a least-cost alignment; where several cost the least, equal or replace goes before delete, then insert, from the end."""
    n, m = len(ref), len(hyp)
    cost = np.zeros((n + 1, m + 1), np.int32)
    cost[:, 0], cost[0, :] = np.arange(n + 1), np.arange(m + 1)
    codes = {w: i for i, w in enumerate(dict.fromkeys([*ref, *hyp]))}
    b = np.array([codes[w] for w in hyp], np.int32)
    steps = np.arange(m + 1)
    for i, word in enumerate(ref, 1):
        row = np.minimum(cost[i - 1, 1:] + 1, cost[i - 1, :-1] + (b != codes[word]))
        # An insertion costs one a place: the running minimum of (cost - place) does them all.
        cost[i] = np.minimum.accumulate(np.concatenate([[i], row]) - steps) + steps
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (ref[i - 1] != hyp[j - 1]):
            out.append(("equal" if ref[i - 1] == hyp[j - 1] else "replace", ref[i - 1], hyp[j - 1]))
            i, j = i - 1, j - 1
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            out.append(("delete", ref[i - 1], None))
            i -= 1
        else:
            out.append(("insert", None, hyp[j - 1]))
            j -= 1
    return out[::-1]


@F.pandas_udf(ALIGNMENT)
def word_alignment(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """The operations between two texts' words, in order."""
    return pd.Series([[dict(zip(("op", "ref", "hyp"), x, strict=True)) for x in align_words((r or "").split(), (h or "").split())] for r, h in zip(ref, hyp, strict=True)])


@F.pandas_udf(DoubleType())
def similarity(one: pd.Series, two: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks by all characters."""
    return pd.Series([difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).ratio() for a, b in zip(one, two, strict=True)])
