"""Comparison forms of texts, hashes of their parts, and joins with a side whose size is checked."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.forms import Plain

#: Rows, and characters of text in them, up to which a side of a join is broadcast; both are counted first, and a larger
#: side is shuffled.
BROADCAST_ROWS, BROADCAST_CHARS = 100_000, 8_000_000
#: Mark-up that words are compared without: tags, character references, page marks in double brackets.
MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);|\[\[[^\[\]]*\]\]")

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows and ``BROADCAST_CHARS`` characters of text; else ``df``."""
    chars = sum((F.coalesce(F.length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"), F.lit(0).cast("bigint"))
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(chars), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= BROADCAST_CHARS else df


def sliced(batches, rows: int = 500):
    """Batches of at most ``rows`` rows, so that what a batch becomes stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Hashes(dict):
    """64-bit hashes of words, each computed once."""

    def __missing__(self, word: str) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_PLAIN = Plain()


def words_of(text: str | None) -> list[str]:
    """Words in comparison form: letters and digits in lower case, without points, punctuation, mark-up or layout."""
    if not text:
        return []
    if "<" in text or "&" in text or "[[" in text:
        text = MARKUP.sub(" ", text)
    return text.translate(_PLAIN).split()


def plain_of(text: str | None) -> str:
    """Words in comparison form, separated by one blank."""
    return " ".join(words_of(text))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def flat_hashes(lists: list[list[str]], hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words one after another, and the offsets of the lists."""
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return np.fromiter((hashes[w] for x in lists for w in x), np.uint64, int(offsets[-1])), offsets


def grams(flat: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """At each place the hash of the ``k`` words from it; the top value where they would leave the list."""
    n = len(flat)
    out = np.full(n, _TOP, np.uint64)
    if n < k:
        return out
    with np.errstate(over="ignore"):
        total = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            total = mixed(total + flat[j : n - k + 1 + j] + np.uint64(j + 1))
    out[: n - k + 1] = np.where(total == _TOP, np.uint64(0), total)
    for j in range(1, k):
        ends = offsets[1:] - j
        out[ends[ends >= 0]] = _TOP
    return out


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places that hold the least hash of some window of ``window`` places; of a run of equal hashes the first and last.

    The longest match of two such runs is aligned at their first or last places, so the ones between add nothing.
    """
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64)
    padded = np.concatenate([np.full(window - 1, _TOP), hashes, np.full(window - 1, _TOP)])
    least = np.lib.stride_tricks.sliding_window_view(padded, window).min(axis=1)
    most = np.lib.stride_tricks.sliding_window_view(least, window).max(axis=1)
    inner = np.zeros(n, bool)
    inner[1:-1] = (hashes[1:-1] == hashes[:-2]) & (hashes[1:-1] == hashes[2:])
    return np.nonzero((hashes == most) & (hashes != _TOP) & ~inner)[0]


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as Spark's signed ones."""
    return pa.array(x.view(np.int64), pa.int64())
