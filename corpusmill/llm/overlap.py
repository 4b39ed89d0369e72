"""Problem 1: the same or nearly the same record in different splits.

Normalised records are cut into chunks, the digests of the chunks are joined across splits, and the lengths of shared
chunks are summed up for each pair of records. Two cuts are used:

* Candidates need a sum that no close pair falls short of. With 15 edits per 100 characters spread evenly, six characters
  in a row are all that stays whole, so that chunks cut where a rolling hash says are lost; here every window of the rolling
  hash is a chunk. An edit takes at most as many windows as a window has characters, so close records share all but that
  many for each edit, however short they are and however frequent what they share.
* The overlapping fractions that are reported are of content-defined chunks, cut where the rolling hash says.

The held-out records are a stated query set against all others. Digests are joined inside blocks of both sides, so that a
frequent digest is never the key of a shuffle: records lie in bands of length such that close texts are in the same or
neighbouring bands, bands are cut into pieces by hash, and each pair of pieces is one block. In a block the texts of one side
are cut into segments of which one has an edit at most, and these are looked up in an index of the other side, so that
most pairs are never met (:func:`_meetings`). What passes is compared by edit distance.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.wording import mixed, plain_of
from corpusmill.session import cut

#: Characters in the rolling window, and the mean length of a chunk.
ROLL = 3
MEAN = 8
#: Records of a piece of a band, of the held-out side and of the other.
PIECES = (65_536, 131_072)
#: Characters of a piece, of the held-out side and of the other, at most but for one text; a longer one is a piece of its own.
PIECE_CHARS = (8_000_000, 16_000_000)
#: Characters of a piece that travel as one compressed row, and those held until rows are made of what there is.
ROW_CHARS = 500_000
HELD_CHARS = 8_000_000
#: Classes of digests of windows of two characters, which are counted, and of ``ROLL`` characters, which are bits.
BIGRAMS = 256
WINDOWS = 1024
#: Characters of a window whose place is looked at too: an edit moves what follows it by one place at most.
PLACED = 4
#: Edits allowed per 100 characters of the longer text, and the least number of words of a text.
EDITS = 15
WORDS = 6

#: Characters of a segment at most, and the fewest that make three parts.
SEGMENT = 12
SHORTEST = 7
#: Texts of the held-out side from which on an index of the others is made.
INDEXED = 1500
#: Characters of texts in an index, and pairs looked at, at a time.
INDEX_CHARS = 2_000_000
PAIRS = 500_000
#: Bits of a digest by which a look-up that finds nothing is mostly known without one.
SEEN = 24

_BASE = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD1342543DE82EF95)
SLICE = 4000


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & 0xFFFFFFFFFFFFFFFF), np.uint64)
    if n:
        out[0] = np.uint64(1)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, digest and length of the content-defined chunks of all texts, in order."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        letters = mixed(codes + np.uint64(1))
        roll = letters.copy()
        place = np.arange(n) - np.repeat(ends - sizes, sizes)
        for j in range(1, min(ROLL, n)):
            # The window doesn't reach back into the text before.
            roll[j:] += np.where(place[j:] >= j, letters[:-j] * mixed(np.array([j], np.uint64) + _BASE)[0], np.uint64(0))
        last = np.zeros(n, bool)
        last[ends[sizes > 0] - 1] = True
        stop = np.nonzero((mixed(roll) % np.uint64(MEAN) == 0) | last)[0] + 1
        begin = np.concatenate([[0], stop[:-1]])
        inverse = pow(int(_BASE), -1, 1 << 64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * _powers(n, int(_BASE)), dtype=np.uint64)])
        digest = mixed((sums[stop] - sums[begin]) * _powers(n, inverse)[begin] + (stop - begin).astype(np.uint64))
    return np.searchsorted(ends, begin, side="right"), digest, stop - begin


#: Classes of letters that are counted.
CLASSES = 24


def _allowed(longer: Column, edits: int) -> Column:
    return F.floor(longer * edits / 100).cast("int")


def _records(batches):
    """Adds the normalised text in place of the text."""
    for batch in batches:
        plain = pa.array([plain_of(t) for t in batch.column(2).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], plain], names=["key", "side", "plain"])


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, counts of letters and of pairs of letters by class, and the windows' classes as bits, one row a text; counts stop at 255.

    An edit changes one letter, two pairs and ``ROLL`` windows on either side, so with k edits one text has at most k letters,
    2k pairs and ``ROLL * k`` windows that the other lacks. Classes that fall together and counts that stop only lower that.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    letters, pairs = np.zeros((len(texts), CLASSES), np.uint8), np.zeros((len(texts), BIGRAMS), np.uint8)
    windows = np.zeros((len(texts), WINDOWS // 64), np.uint64)
    for at in range(0, len(texts), SLICE):
        some = sizes[at : at + SLICE]
        codes = np.frombuffer("".join(texts[at : at + SLICE]).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(some)), some)
        inside = np.nonzero(owner[1:] == owner[:-1])[0]
        both = mixed(codes[inside].astype(np.uint64) << np.uint64(32) | codes[inside + 1].astype(np.uint64)) % np.uint64(BIGRAMS)
        for out, who, kind in ((letters, owner, codes % np.uint32(CLASSES)), (pairs, owner[inside], both.astype(np.int64))):
            n = out.shape[1]
            out[at : at + len(some)] = np.minimum(np.bincount(who * n + kind, minlength=len(some) * n), 255).reshape(-1, n)
        whole = np.nonzero(owner[ROLL - 1 :] == owner[: len(owner) - ROLL + 1])[0]
        with np.errstate(over="ignore"):
            roll = np.zeros(len(whole), np.uint64)
            for j in range(ROLL):
                roll = mixed(roll + codes[whole + j].astype(np.uint64) + np.uint64(1))
        bits = np.zeros((len(some), WINDOWS), bool)
        bits[owner[whole], (roll % np.uint64(WINDOWS)).astype(np.int64)] = True
        windows[at : at + len(some)] = np.packbits(bits, axis=1).view(np.uint64)
    return sizes, letters, pairs, windows


class Placed:
    """Digests of the windows of ``PLACED`` characters of each text, sorted, with their places."""

    #: Places are the low bits of a digest's key; of texts that are longer, places are taken as equal.
    BITS = 24

    def __init__(self, texts: list[str]) -> None:
        self.texts, self.keys = texts, {}

    def __getitem__(self, i: int) -> np.ndarray:
        found = self.keys.get(i)
        if found is None:
            codes = np.frombuffer(self.texts[i].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            n = max(0, len(codes) - PLACED + 1)
            with np.errstate(over="ignore"):
                digest = np.zeros(n, np.uint64)
                for j in range(PLACED):
                    digest = mixed(digest + codes[j : j + n] + np.uint64(1))
            found = (digest >> np.uint64(self.BITS + 1) << np.uint64(self.BITS)) | np.arange(n, dtype=np.uint64) % np.uint64(1 << self.BITS)
            self.keys[i] = found = np.sort(found.astype(np.int64))
        return found


def lacking(ours: np.ndarray, theirs: np.ndarray, reach: int) -> int:
    """Windows of one text that the other doesn't have within ``reach`` places; both as :class:`Placed` gives them."""
    if not len(theirs) or max(len(ours), len(theirs)) + reach >= 1 << Placed.BITS:
        return 0 if len(theirs) else len(ours)
    low, mask = (1 << Placed.BITS) - 1, ~((1 << Placed.BITS) - 1)
    first = (ours & mask) + np.maximum((ours & low) - reach, 0)
    at = np.minimum(np.searchsorted(theirs, first), len(theirs) - 1)
    return int(np.count_nonzero((theirs[at] < first) | (theirs[at] > ours + reach)))


class _Side:
    """The texts of a piece by length, with what :func:`counted` knows of those that are asked for."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        sizes = pc.utf8_length(column).to_numpy().astype(np.int64)
        self.order = np.argsort(sizes, kind="stable")
        self.sizes, self.column = sizes[self.order], column

    def texts(self, begin: int, end: int) -> list[str]:
        return self.column.take(pa.array(self.order[begin:end])).to_pylist()


def _classes(sizes: np.ndarray, edits: int) -> list[tuple[int, int]]:
    """Ranges of sorted lengths that allow as many edits or nearly so, of ``INDEX_CHARS`` characters or one text at most."""
    out, begin, ends = [], 0, np.cumsum(sizes)
    while begin < len(sizes):
        least = int(sizes[begin])
        top = max(int(least * 1.04), ((least * edits // 100 + 1) * 100 - 1) // max(edits, 1))
        end = min(int(np.searchsorted(sizes, top, side="right")), int(np.searchsorted(ends, ends[begin] - least + INDEX_CHARS, side="right")))
        out.append((begin, max(end, begin + 1)))
        begin = out[-1][1]
    return out


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, length: int) -> np.ndarray:
    """Digests of the ``length`` characters from each place."""
    n = max(0, len(codes) - length + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            out += codes[j : j + n]
            out *= _BASE
    return out


class _Grams(dict):
    """The digests of texts by length, made when asked for."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts

    def __missing__(self, length: int) -> np.ndarray:
        self[length] = found = _grams(_codes(self.texts), length)
        return found


def _both(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Digests of two digests."""
    with np.errstate(over="ignore"):
        return mixed(one * _OTHER + two)


def _parts(length: int) -> tuple[int, int]:
    """Characters of the outer and of the middle part of a segment."""
    outer = 4 if length > 9 else 3
    return outer, length - 2 * outer


def _meetings(grams: dict[int, np.ndarray], starts: np.ndarray, n: np.ndarray, texts: list[str], others: np.ndarray, edits: int):
    """Yields (i, j): every pair that may be close, and few others; ``grams`` of one side, by length, and the lengths ``others`` of ``texts``.

    A text is cut into half as many segments as edits are allowed, and one more, of which one then has an edit at most.
    The first such one at which the edits up to its end are under twice the segments so far begins at most ``2 * nth + 1``
    places off, counted from the front, and all allowed edits less ``2 * nth``, counted from the end. A segment is of three
    parts; an edit leaves two of them whole: the first two, the last two, or the outer ones, whose distance changes by one
    place at most. Those two parts, their distance and their place are looked up among those of the other texts.
    """
    least, most = int(others[0]), int(others[-1])
    allowed = np.maximum(n, most) * edits // 100
    segments = allowed // 2 + 1
    length = np.minimum(n // segments, SEGMENT)
    looked: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    cuts = {}
    for size in np.unique(length).tolist():
        fit = np.nonzero(length == size)[0]
        who = np.repeat(fit, segments[fit])
        nth = np.arange(len(who)) - np.repeat(np.cumsum(segments[fit]) - segments[fit], segments[fit])
        begin = nth * n[who] // segments[who]
        cuts[size] = who, nth, begin, starts[who] + begin
        outer, middle = _parts(size)
        for first, second, apart in [(0, middle, middle), (outer, outer + middle, middle), *((0, outer + middle, outer + middle + d) for d in (-1, 0, 1))]:
            looked.setdefault((outer, apart), []).append((size, first, second))
    theirs = _codes(texts)
    record_bits, place_bits = max(1, (len(others) - 1).bit_length()), most.bit_length()
    low, last = record_bits + place_bits, (1 << record_bits) - 1
    place = np.arange(len(theirs), dtype=np.int32) - np.repeat((np.cumsum(others) - others).astype(np.int32), others)
    room = np.repeat(others.astype(np.int32), others) - place
    tail = place.astype(np.int64) << record_bits | np.repeat(np.arange(len(others), dtype=np.int32), others)
    del place
    of = {}
    for (outer, apart), kinds in sorted(looked.items()):
        if outer not in of:
            of = {outer: _grams(theirs, outer)}
        upto = max(0, len(of[outer]) - apart)
        whole = room[:upto] >= apart + outer
        keys = _both(of[outer][:upto], of[outer][apart : apart + upto])[whole]
        seen = np.zeros(1 << SEEN, bool)
        seen[keys >> np.uint64(64 - SEEN)] = True
        # Digest, place and record in one number; the sign is left free.
        keys >>= np.uint64(low + 1)
        keys <<= np.uint64(low)
        keys = keys.view(np.int64)
        keys |= tail[:upto][whole]
        keys.sort()
        for size, first, second in kinds:
            who, nth, begin, base = cuts[size]
            digest = _both(grams[outer][base + first], grams[outer][base + second])
            asked = np.nonzero(seen[digest >> np.uint64(64 - SEEN)])[0]
            # In order, so that neighbours are looked up one after the other.
            asked = asked[np.argsort(digest[asked])]
            digest = (digest[asked] >> np.uint64(low + 1) << np.uint64(low)).astype(np.int64)
            who, nth, at = who[asked], nth[asked], begin[asked] + first
            mine, back = n[who], allowed[who] - 2 * nth
            from_place = np.maximum(at + np.maximum(-(2 * nth + 1), least - mine - back), 0)
            upto_place = np.minimum(at + np.minimum(2 * nth + 1, most - mine + back), most)
            lower, upper = np.searchsorted(keys, digest | from_place << record_bits), digest | upto_place << record_bits | last
            hit = np.nonzero((from_place <= upto_place) & (lower < len(keys)))[0]
            hit = hit[keys[lower[hit]] <= upper[hit]]
            who, at, back, lower = who[hit], at[hit], back[hit], lower[hit]
            count = np.searchsorted(keys, upper[hit], side="right") - lower
            ends = np.cumsum(count)
            parted = np.searchsorted(ends, np.arange(1, int(count.sum()) // PAIRS + 1) * PAIRS)
            for b, e in itertools.pairwise([0, *np.unique(parted).tolist(), len(count)]):
                if b == e:
                    continue
                c = count[b:e]
                key = keys[np.arange(int(c.sum())) + np.repeat(lower[b:e] - (ends[b:e] - c - (ends[b] - c[0])), c)]
                nth_hit, j = np.repeat(np.arange(b, e), c), key & last
                i = who[nth_hit]
                longer = others[j] - n[i]
                off = (key >> record_bits & ((1 << place_bits) - 1)) - at[nth_hit]
                good = (np.abs(longer) <= np.maximum(n[i], others[j]) * edits // 100) & (np.abs(longer - off) <= back[nth_hit])
                yield i[good], j[good]


def _all(letters: np.ndarray, n: np.ndarray, their_letters: np.ndarray, others: np.ndarray, edits: int):
    """Yields (i, j): every pair near enough in length and letters."""
    # Sums over classes stay in the type of their terms, which is what makes a pair cost a few nanoseconds.
    letters, by_class = letters.astype(np.uint16), np.ascontiguousarray(their_letters.T.astype(np.uint16))
    sum_of, sums = letters.sum(1, dtype=np.uint16), by_class.sum(0, dtype=np.uint16)
    # Beyond 20,000 edits the condition on letters always holds: their counts stop far below that.
    some, somes = (np.minimum(m * edits // 100, 20_000).astype(np.uint16) for m in (n, others))
    begin, end = np.searchsorted(others, n - n * edits // 100), np.searchsorted(others, n * 100 // (100 - edits), side="right")
    ours, theirs, held = [], [], 0
    for i in np.nonzero(begin < end)[0]:
        span = slice(begin[i], end[i])
        more = np.maximum(by_class[:, span], letters[i][:, None]).sum(0, dtype=np.uint16)
        near = np.nonzero(more <= np.minimum(sums[span], sum_of[i]) + np.maximum(somes[span], some[i]))[0] + begin[i]
        if len(near):
            ours.append(np.full(len(near), i))
            theirs.append(near)
            held += len(near)
        if held > PAIRS:
            yield np.concatenate(ours), np.concatenate(theirs)
            ours, theirs, held = [], [], 0
    if held:
        yield np.concatenate(ours), np.concatenate(theirs)


def _united(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The sums of the greater of two counts by class of letters, a row a pair; eight counts lie in a number."""
    great = np.maximum(one, two).view(np.uint64)
    halves = np.uint64(0x00FF00FF00FF00FF)
    return ((((great & halves) + (great >> np.uint64(8) & halves)).sum(1) * np.uint64(0x0001000100010001)) >> np.uint64(48)).astype(np.int64)


def _compared(edits: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """(a, b, plain_a, plain_b): pairs of two pieces whose shared windows let them be close."""
        found = [np.empty((0, 2), np.int64)]
        if left.num_rows and right.num_rows:
            one, two = _Side(left.column("plain")), _Side(right.column("plain"))
            mine = one.texts(0, len(one.sizes))
            starts, n, grams = np.cumsum(one.sizes) - one.sizes, one.sizes, _Grams(mine)
            ours = counted(mine)[1:]
            sums = [x.sum(1, dtype=np.int64) for x in ours[:2]]
            placed = Placed(mine)
            for begin, end in _classes(two.sizes, edits):
                others = two.sizes[begin:end]
                least, most = int(others[0]), int(others[-1])
                first, upto = int(np.searchsorted(n, least - least * edits // 100)), int(np.searchsorted(n, most * 100 // (100 - edits), side="right"))
                if first >= upto:
                    continue
                texts = two.texts(begin, end)
                theirs, their_placed = counted(texts)[1:], Placed(texts)
                their_sums = [x.sum(1, dtype=np.int64) for x in theirs[:2]]
                # A text whose segments are too short for three parts meets all, as few texts do, for which an index costs more.
                short = n[first:upto] // (np.maximum(n[first:upto], most) * edits // 100 // 2 + 1) < SHORTEST
                if (upto - first) < INDEXED:
                    short[:] = True
                pairs = []
                for meets, some in ((True, np.nonzero(short)[0] + first), (False, np.nonzero(~short)[0] + first)):
                    if not len(some):
                        continue
                    met = _all(ours[0][some], n[some], theirs[0], others, edits) if meets else _meetings(grams, starts[some], n[some], texts, others, edits)
                    for i, j in met:
                        i = some[i]
                        allowed = np.maximum(n[i], others[j]) * edits // 100
                        for counts, their_counts, each in ((ours[0], theirs[0], 1), (ours[1], theirs[1], 2), (ours[2], theirs[2], ROLL)):
                            got, want = counts.take(i, 0), their_counts.take(j, 0)
                            if each == ROLL:
                                fits = np.maximum(np.bitwise_count(got & ~want).sum(1, dtype=np.int64), np.bitwise_count(want & ~got).sum(1, dtype=np.int64)) <= allowed * ROLL
                            else:
                                fits = _united(got, want) <= np.minimum(sums[each - 1][i], their_sums[each - 1][j]) + allowed * each
                            i, j, allowed = i[fits], j[fits], allowed[fits]
                        pairs.append(np.unique(i * len(others) + j))
                if pairs:
                    i, j = np.divmod(np.unique(np.concatenate(pairs)), len(others))
                    allowed = np.maximum(n[i], others[j]) * edits // 100
                    near = [k for k, (x, y, most_edits) in enumerate(zip(i.tolist(), j.tolist(), allowed.tolist(), strict=True)) if lacking(placed[x], their_placed[y], most_edits) <= PLACED * most_edits]
                    found.append(np.stack([one.order[i[near]], two.order[begin:end][j[near]]], 1))
        pairs = np.concatenate(found)
        ours, theirs = left.take(pa.array(pairs[:, 0])), right.take(pa.array(pairs[:, 1]))
        return pa.table({"a": ours.column("a"), "b": theirs.column("b"), "plain_a": ours.column("plain"), "plain_b": theirs.column("plain")})

    return run


def _overlap(batches):
    """(a, b, edits) with the fractions of the two texts that lie in chunks they share."""
    for batch in batches:
        n = batch.num_rows
        both = [chunks(batch.column(batch.schema.get_field_index(c)).to_pylist()) for c in ("plain_a", "plain_b")]
        out = []
        for one, two in (both, both[::-1]):
            # A chunk is shared if the pair's other text has its digest too.
            ids, place = np.unique(np.concatenate([one[1], two[1]]), return_inverse=True)
            mine, theirs = one[0] * len(ids) + place[: len(one[0])], two[0] * len(ids) + place[len(one[0]) :]
            shared = np.bincount(one[0], one[2] * np.isin(mine, theirs), minlength=n)
            out.append(pa.array(shared / np.maximum(1, np.bincount(one[0], one[2], minlength=n))))
        kept = [batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "edits")]
        yield pa.RecordBatch.from_arrays([*kept, *out], names=["a", "b", "edits", "overlap_a", "overlap_b"])


def _ours() -> Column:
    return F.col("rec").bitwiseAND(1) == 1


def _packed(batches):
    """Rows (band, piece, texts) of rows (band, piece, rec, plain): records of a piece, compressed."""
    held: dict[tuple[int, int], tuple[list[int], list[str]]] = {}
    chars: Counter = Counter()

    def row(key):
        sink = pa.BufferOutputStream()
        recs, texts = held.pop(key)
        table = pa.table({"rec": pa.array(recs, pa.int64()), "plain": pa.array(texts, pa.string())})
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        del chars[key]
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["band", "piece", "texts"])

    for batch in batches:
        for band, piece, rec, plain in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            recs, texts = held.setdefault((band, piece), ([], []))
            recs.append(rec)
            texts.append(plain)
            chars[band, piece] += len(plain)
            if chars[band, piece] > ROW_CHARS:
                yield row((band, piece))
        if chars.total() > HELD_CHARS:
            yield from map(row, list(held))
    yield from map(row, list(held))


def _unpacked(edits: int):
    """:func:`_compared` for pieces in rows as :func:`_packed` makes them."""
    compared = _compared(edits)
    empty = pa.table({"rec": pa.array([], pa.int64()), "plain": pa.array([], pa.string())})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = (pa.concat_tables([empty, *(pa.ipc.open_stream(row.as_buffer()).read_all() for row in side.column("texts"))]).combine_chunks() for side in (left, right))
        return compared(*(side.rename_columns([name, "plain"]) for side, name in zip(sides, "ab", strict=True)))

    return run


def _candidates(records: DataFrame, edits: int) -> DataFrame:
    """(a, b, plain_a, plain_b): records of the two sides that may be close, each pair once."""
    # A band is a little wider than the lengths of close texts are apart, so these are at most one band apart.
    width = -1.001 * math.log(1 - max(edits, 1) / 100)
    banded = records.withColumn("band", F.floor(F.log(F.greatest(F.length("plain"), F.lit(1))) / width).cast("int"))
    sides = []
    for ours, most, chars in zip((True, False), PIECES, PIECE_CHARS, strict=True):
        rows = banded.where(_ours() if ours else ~_ours())
        # As many pieces as hold the records of a band; one row a band.
        pieces = rows.groupBy("band").agg(F.ceil(F.greatest(F.count("*") / most, F.sum(F.length("plain")) / chars)).cast("int").alias("pieces"))
        placed = rows.join(F.broadcast(pieces), "band").select("band", F.pmod(F.xxhash64("rec"), "pieces").cast("int").alias("piece"), "rec", "plain")
        # Rows are copied to every piece that they meet, so they are compressed before.
        sides.append((placed.mapInArrow(_packed, "band int, piece int, texts binary"), cut(pieces)))
    (one, held), (two, rest) = sides
    near = F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("other")
    # Groups are (band and piece of the held-out side, band and piece of the other).
    whole = held.select("band", "pieces", near).join(rest.select(F.col("band").alias("other"), F.col("pieces").alias("others")), "other")
    key = ["band", "piece", "other", "part"]
    one = one.join(F.broadcast(whole.select("band", "other", "others")), "band").select("band", "piece", "other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("part"), "texts")
    two = two.select(F.col("band").alias("other"), F.col("piece").alias("part"), "texts")
    two = two.join(F.broadcast(whole.select("band", "other", "pieces")), "other").select("band", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "other", "part", "texts")
    # Both sides come from one table; new names keep their columns apart.
    one, two = one.toDF(*one.columns), two.toDF(*two.columns)
    return one.groupBy(*key).cogroup(two.groupBy(*key)).applyInArrow(_unpacked(edits), "a bigint, b bigint, plain_a string, plain_b string")


def close_records(df: DataFrame, key: str, text: str, held_out: Column, words: int = WORDS, edits: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """(members, links) of held-out and other records that are equal or nearly so.

    ``members`` (key, side, rec): the class of each record, its text in comparison form; copies on a side are one class.
    ``links`` (a, b, edits, overlap_a, overlap_b): pairs of a held-out and another class, with the fractions of each
    text's characters in chunks that both have. See :func:`overlaps` for the cases.
    """
    if not 0 <= edits < 100:
        raise ValueError("edits per 100 characters must be from 0 to 99")
    rows = df.select(F.col(f"`{key}`").alias("key"), held_out.alias("side"), F.col(f"`{text}`").alias("text")).where("key is not null and side is not null and text is not null")
    kind = df.schema[key].dataType.simpleString()
    members = rows.mapInArrow(_records, f"key {kind}, side boolean, plain string").where(F.size(F.split("plain", " ")) >= words)
    # Equal texts of a side are one record. The lowest bit of a record's number tells its side.
    number = (F.shiftleft(F.monotonically_increasing_id(), 1) + F.col("side").cast("int")).alias("rec")
    records = cut(members.select("side", "plain").distinct().select(number, "plain"))
    near = _candidates(records, edits).withColumn("_most", _allowed(F.greatest(F.length("plain_a"), F.length("plain_b")), edits))
    close = near.withColumn("edits", F.expr("levenshtein(plain_a, plain_b, _most)"))
    links = cut(close.where("edits >= 0").mapInArrow(_overlap, "a bigint, b bigint, edits int, overlap_a double, overlap_b double"))
    named = members.join(records.select(_ours().alias("side"), "plain", "rec"), ["side", "plain"]).select("key", "side", "rec")
    return named, links


def overlaps(df: DataFrame, key: str, text: str, held_out: Column, words: int = WORDS, edits: int = EDITS) -> DataFrame:
    """Pairs of texts, one held out and one not, that are equal or nearly so.

    Returns ``key_a`` (of a held-out record), ``key_b``, ``edits``, ``overlap_a`` and ``overlap_b`` (fractions of each
    text's characters in chunks that both have). A pair has at most ``edits`` edits per 100 characters of the longer
    text, in comparison form. ``held_out`` tells the sides; where it is null the row takes no part, and neither do a
    null key, a null text and one of fewer than ``words`` words. Copies of a text on one side are compared once and
    listed by key. Repeated rows give one pair; empty tables none; further columns are ignored, whatever their names.
    """
    members, links = close_records(df, key, text, held_out, words, edits)
    left = members.where("side").select(F.col("key").alias("key_a"), F.col("rec").alias("a"))
    right = members.where("not side").select(F.col("key").alias("key_b"), F.col("rec").alias("b"))
    return links.join(left, "a").join(right, "b").select("key_a", "key_b", "edits", "overlap_a", "overlap_b").distinct()


def leaked(df: DataFrame, key: str, text: str, held_out: Column, words: int = WORDS, edits: int = EDITS) -> DataFrame:
    """(``key``, edits, overlap): for each held-out record that also stands on the other side the least edits and the greatest overlap.

    Links are reduced to a row a class before members are joined, so that copies are never paired. See :func:`overlaps`.
    """
    members, links = close_records(df, key, text, held_out, words, edits)
    best = links.groupBy(F.col("a").alias("rec")).agg(F.min("edits").alias("edits"), F.max("overlap_a").alias("overlap"))
    return members.where("side").join(best, "rec").groupBy(F.col("key").alias(key)).agg(F.min("edits").alias("edits"), F.max("overlap").alias("overlap"))
