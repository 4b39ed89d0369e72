"""Problem 7: oversized items cut into pieces under the limits, by byte ranges.

An item is a run of UTF-8 bytes, the text of a row or a whole file, and no worker needs more of it than one range with a
halo on either side:

1. The bytes are read in ranges. Characters that begin in a range are counted there, and a prefix sum over the counts,
   one row a range, gives each range its place in characters.
2. Workers detect boundaries: for each point of a fixed grid of characters in their range the best place before it. Cuts
   depend only on the text near a grid point, so they are the same however an item is divided into ranges.
3. The boundary tables of all ranges are stitched: each cut is the start of a piece, the end of the one before and the
   floor of the one after, which one aggregation by piece puts together.
4. Pieces go back to the range they begin in, as a list of offsets, and are emitted out of its bytes.
"""

from __future__ import annotations

import unicodedata
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators.intervals import to_ms
from corpusmill.session import cut

#: Bytes of a range.
RANGE = 1 << 16
#: The grid's step as a share of the limit, and the share of a step before a grid point where the cut is sought. A piece
#: has at most (1 + SEEK) steps and what it repeats of the piece before; the rest of the limit is room for that.
STEP, SEEK = 0.6, 0.25
#: Characters of a halo, as a multiple of the limit; a character has four bytes at most.
HALO, CHAR = 3, 4
#: Where a cut is natural, best first; the cut is after the mark and the blanks that follow it.
ENDS = (".!?׃…。", ";:", ",،")

_RANGE_TABLE = "item bigint, nth bigint, base bigint, lo bigint, hi bigint, data binary, chars bigint"


def _cut_in(text: str, low: int, high: int) -> int:
    """The best place p with low < p <= high to cut ``text`` before: after a line or sentence end, a pause, a word."""
    best, rank = high, 0
    p = high
    while p > low:
        before = text[p - 1]
        if before.isspace() and not (p < len(text) and text[p].isspace()):
            q = p - 1
            while q > 0 and text[q - 1].isspace():
                q -= 1
            mark = text[q - 1] if q else ""
            blanks = text[q:p]
            if mark in "\"'”’)]" and q > 1:
                mark = text[q - 2]
            now = 5 if "\n" in blanks or "\r" in blanks else 4 if mark in ENDS[0] else 3 if mark in ENDS[1] else 2 if mark in ENDS[2] else 1
            if not mark:
                now = 1
            if now > rank:
                best, rank = p, now
        p -= 1
    if rank == 0:
        # No blank: at least don't part a mark from its letter.
        while best > low + 1 and best < len(text) and unicodedata.combining(text[best]):
            best -= 1
        if best < len(text) and unicodedata.combining(text[best]):
            best = high
    return best


def _back(text: str, at: int, floor: int, words: int) -> tuple[int, int]:
    """The start of the ``words``-th word before ``at``, but not before ``floor``, and how many words that gives."""
    p, got, best = at, 0, at
    while got < words:
        q = p
        while q > floor and text[q - 1].isspace():
            q -= 1
        start = q
        while start > floor and not text[start - 1].isspace():
            start -= 1
        if start == q or (start == floor and floor > 0 and not text[floor - 1].isspace()):
            break
        p = best = start
        got += 1
    return best, got


def _begins(data: bytes, at: int) -> int:
    """The first place from ``at`` where a character begins."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _chars(data: bytes) -> int:
    """Characters that begin in ``data``."""
    return int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))


def _of_range(data: bytes, base: int, lo: int, hi: int) -> tuple[str, int, int]:
    """Text of a range with its halo, and the characters in it before and after the range's first one."""
    first = _begins(data, 0)
    inside = _begins(data, lo - base)
    text = data[first:].decode("utf-8", "replace")
    return text, _chars(data[first:inside]), _chars(data[inside : max(inside, hi - base)])


def _text_ranges(size: int):
    """Rows of the range table out of rows (item, text, limit): each range is a slice of the bytes."""

    def run(batches):
        for batch in batches:
            for item, text, limit in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                halo = HALO * CHAR * limit
                rows = []
                for nth, lo in enumerate(range(0, len(data), size)):
                    hi, base = min(len(data), lo + size), max(0, lo - halo)
                    rows.append((item, nth, base, lo, hi, data[base : hi + halo], _chars(data[lo:hi])))
                    if len(rows) == 64 or hi == len(data):
                        yield _range_rows(rows)
                        rows = []

    return run


def _file_ranges(halo: int):
    """Rows of the range table out of rows (item, path, nth, lo, hi): each worker opens the file and reads its range alone."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for item, path, nth, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                # Names come as they are, not as addresses with percent codes.
                system, name = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(quote(path, safe=":/@"))
                base = max(0, lo - halo)
                with system.open_input_file(name) as file:
                    data = file.read_at(hi + halo - base, base)
                yield _range_rows([(item, nth, base, lo, hi, data, _chars(data[lo - base : hi - base]))])

    return run


def _range_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("item", pa.int64()), ("nth", pa.int64()), ("base", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("data", pa.binary()), ("chars", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], schema=pa.schema(kinds))


def _grid(limit: int, size: int) -> tuple[int, int]:
    """The step of the grid and the number of its points inside an item."""
    step = max(1, int(limit * STEP))
    return step, (size - 1) // step if size > limit else 0


def _boundaries(batches):
    """Rows (item, point, nth, at) of the cuts of grid points in a range; ``at`` is in characters of the item."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("item", "point", "nth", "at")}
        for r in batch.to_pylist():
            step, points = _grid(r["limit"], r["size"])
            seek = int(step * SEEK)
            text, before, inside = _of_range(r["data"], r["base"], r["lo"], r["hi"])
            origin = r["offset"] - before
            for point in range(max(1, -(-r["offset"] // step)), min(points, -(-(r["offset"] + inside) // step) - 1) + 1):
                high = point * step - origin
                at = _cut_in(text, high - seek - 1, high) if seek else high
                for name, value in zip(out, (r["item"], point, r["nth"], origin + at), strict=True):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in out]))


def _emitted(overlap: int):
    """Rows (item, number, begin, upto, text, shared) of the pieces that begin in a range."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("item", "number", "begin", "upto", "text", "shared")}
            for r in batch.to_pylist():
                text, before, _ = _of_range(r["data"], r["base"], r["lo"], r["hi"])
                origin = r["offset"] - before
                for p in r["pieces"]:
                    begin, upto, shared = p["at"] - origin, p["upto"] - origin, 0
                    if p["number"]:
                        begin, shared = _back(text, begin, max(0, upto - r["limit"], p["floor"] - origin), overlap)
                    for name, value in zip(out, (r["item"], p["number"], origin + begin, p["upto"], text[begin:upto], shared), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("item", pa.int64()), ("number", pa.int64()), ("begin", pa.int64()), ("upto", pa.int64()), ("text", pa.string()), ("shared", pa.int32())]))

    return run


def _cut_ranges(ranges: DataFrame, limits: DataFrame | None, max_chars: int, overlap_words: int) -> DataFrame:
    """(item, number, begin, upto, text, shared) of a materialised range table; ``limits`` (item, limit) where they differ."""
    by_item = Window.partitionBy("item").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    lengths = ranges.select("item", "nth", "chars").withColumn("offset", F.coalesce(F.sum("chars").over(by_item), F.lit(0)))
    sizes = ranges.groupBy("item").agg(F.sum("chars").alias("size"))
    known = sizes.withColumn("limit", F.lit(max_chars).cast("bigint")) if limits is None else sizes.join(limits, "item")
    known = known.toDF(*known.columns)
    placed = lengths.select("item", "nth", "offset").join(known, "item")
    parts = ranges.select("item", "nth", "base", "lo", "hi", "data").join(placed, ["item", "nth"])
    table = cut(parts.mapInArrow(_boundaries, "item bigint, point bigint, nth bigint, at bigint"))
    # The start of an item is a boundary too, and its end.
    steps = F.greatest(F.lit(1), F.floor(F.col("limit") * STEP).cast("bigint"))
    points = F.when(F.col("size") > F.col("limit"), F.floor((F.col("size") - 1) / steps)).otherwise(0).cast("bigint")
    zero = F.lit(0).cast("bigint")
    ends = known.select("item", F.explode(F.array(F.struct(zero.alias("point"), zero.alias("nth"), zero.alias("at")), F.struct((points + 1).alias("point"), F.lit(-1).cast("bigint").alias("nth"), F.col("size").alias("at")))).alias("e")).select("item", "e.*")
    table = table.unionByName(ends)
    at, point, none = F.col("at"), F.col("point"), F.lit(None).cast("bigint")
    roles = F.array(
        F.struct(point.alias("number"), F.col("nth"), at.alias("at"), none.alias("upto"), none.alias("floor")),
        F.struct((point - 1).alias("number"), none.alias("nth"), none.alias("at"), at.alias("upto"), none.alias("floor")),
        F.struct((point + 1).alias("number"), none.alias("nth"), none.alias("at"), none.alias("upto"), at.alias("floor")),
    )
    stitched = table.select("item", F.explode(roles).alias("r")).groupBy("item", "r.number").agg(*(F.max(f"r.{c}").alias(c) for c in ("nth", "at", "upto", "floor")))
    stitched = stitched.where("at is not null and upto is not null")
    # A range has a bounded number of pieces.
    lists = stitched.groupBy("item", "nth").agg(F.sort_array(F.collect_list(F.struct("number", "at", "upto", F.coalesce("floor", F.lit(0)).alias("floor")))).alias("pieces"))
    return parts.join(lists, ["item", "nth"]).mapInArrow(_emitted(overlap_words), "item bigint, number bigint, begin bigint, upto bigint, text string, shared int")


def oversized(text: Column, start: Column, end: Column, max_chars: int, max_ms: int) -> Column:
    """Whether a text is too long, or its span: a null bound gives no span, and a reversed one none above the limit."""
    return (F.coalesce(F.length(text), F.lit(0)) > max_chars) | F.coalesce(to_ms(end) - to_ms(start) > max_ms, F.lit(False))


def cut_files(spark: SparkSession, paths: str, max_chars: int, overlap_words: int, range_size: int = RANGE) -> DataFrame:
    """(path, piece, begin, upto, text, shared_words): the pieces of UTF-8 text files, each read in ranges by many workers.

    A file within the limit is one piece, an empty one gives none. Bytes that are no UTF-8 become replacement characters.
    Only names and lengths are listed; contents are read by the workers, at most ``range_size`` bytes and the halos each.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "length").where("length > 0")
    files = cut(files.withColumn("item", F.monotonically_increasing_id()))
    nth = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / range_size).cast("bigint")))
    asked = files.select("item", "path", "length", nth.alias("nth"))
    asked = asked.select("item", "path", "nth", (F.col("nth") * range_size).alias("lo"), F.least("length", (F.col("nth") + 1) * range_size).alias("hi")).repartition("item", "nth")
    ranges = cut(asked.mapInArrow(_file_ranges(HALO * CHAR * max_chars), _RANGE_TABLE))
    pieces = _cut_ranges(ranges, None, max_chars, overlap_words)
    return pieces.join(files.select("item", "path"), "item").select("path", F.col("number").alias("piece"), "begin", "upto", "text", F.col("shared").alias("shared_words"))


def cut_oversized(df: DataFrame, key: str, text: str, start: str, end: str, max_chars: int, max_seconds: float, overlap_words: int, range_size: int = RANGE) -> DataFrame:
    """The pieces of each item beyond a limit; items within the limits give no rows.

    Returns ``key``, ``piece`` (from 0), ``begin`` and ``upto`` (code points of the text), ``text``, ``shared_words``
    (words at its start that the piece before has at its end), ``start_ms`` and ``end_ms``. Time runs evenly over the
    text's code points; where a bound is null or the span isn't positive, a piece has no times. Pieces end at a line or
    sentence end, else a pause, else a word, else anywhere but between a letter and its mark. A piece repeats
    ``overlap_words`` words, or as many whole ones as fit. An item of too long a span and a text too short to cut (or
    null or empty) gives pieces of equal time with the text in the first. Equal rows count once; null keys are kept.
    """
    max_ms = round(max_seconds * 1000)
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{start}`").alias("start"), F.col(f"`{end}`").alias("end"))
    rows = rows.where(oversized(F.col("text"), F.col("start"), F.col("end"), max_chars, max_ms)).distinct()
    span = to_ms(F.col("end")) - to_ms(F.col("start"))
    rows = rows.withColumn("size", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).withColumn("ms", F.when(span > 0, span))
    by_time = F.when(F.col("ms") > max_ms, F.floor(F.col("size") * F.lit(max_ms) / F.col("ms"))).otherwise(F.lit(max_chars)).cast("bigint")
    rows = cut(rows.withColumn("limit", F.least(F.lit(max_chars).cast("bigint"), by_time)).withColumn("from_ms", to_ms(F.col("start"))).withColumn("item", F.monotonically_increasing_id()))
    long = rows.where("limit >= 1 and size > 0")
    ranges = cut(long.select("item", "text", "limit").mapInArrow(_text_ranges(range_size), _RANGE_TABLE))
    pieces = _cut_ranges(ranges, long.select("item", "limit"), max_chars, overlap_words).join(long.select("item", "key", "from_ms", "ms", "size"), "item")

    def at(place: Column) -> Column:
        return F.col("from_ms") + F.round(F.col("ms") * place / F.col("size")).cast("bigint")

    found = pieces.select(F.col("key").alias(key), F.col("number").alias("piece"), "begin", "upto", "text", F.col("shared").alias("shared_words"), at(F.col("begin")).alias("start_ms"), at(F.col("upto")).alias("end_ms"))
    short = rows.where("limit < 1 or size = 0").withColumn("n", F.ceil(F.col("ms") / max_ms).cast("bigint"))
    short = short.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("piece"))
    first = F.col("piece") == 0

    def even(i: Column) -> Column:
        return F.col("from_ms") + F.floor(F.col("ms") * i / F.col("n")).cast("bigint")

    plain = short.select(F.col("key").alias(key), "piece", F.when(first, 0).otherwise(F.col("size")).cast("bigint").alias("begin"), F.col("size").alias("upto"), F.when(first, F.coalesce("text", F.lit(""))).otherwise("").alias("text"), F.lit(0).alias("shared_words"), even(F.col("piece")).alias("start_ms"), even(F.col("piece") + 1).alias("end_ms"))
    return found.unionByName(plain)
