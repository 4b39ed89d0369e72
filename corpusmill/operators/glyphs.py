"""Text out of placed glyphs: baseline rows, right-to-left tokens, and codes turned into letters."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.segments import cluster
from corpusmill.session import cut

ROW_STEP, TOKEN_GAP, OVERLAP = 2.5, 2.5, 0.5
#: Words that a font needs before its codes are solved.
LEAST_WORDS = 300


def baseline_rows(glyphs: DataFrame, keys: Sequence[str], step: float = ROW_STEP) -> DataFrame:
    """``glyphs`` (keys, y, x0, x1, code, ...) with ``row``: a new one where y steps by more than ``step``."""
    return cluster(glyphs, keys, "y", step, ["x1", "x0", "code"], "row")


def row_tokens(glyphs: DataFrame, keys: Sequence[str], gap: float = TOKEN_GAP) -> DataFrame:
    """``keys``, row, token, codes, font: tokens of each row from right to left.

    The pen is the leftmost edge of the glyphs so far that have a width. A token ends at a blank that doesn't overlap
    the glyph before, and where a glyph lies further left than ``gap``.
    """
    by = Window.partitionBy(*keys, "row").orderBy(F.desc("x1"), F.desc("x0"), "code")
    solid = F.when((F.col("code") != " ") & (F.col("x1") > F.col("x0")), F.col("x0"))
    pen = F.min(solid).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = glyphs.withColumn("_pen", pen)
    blank = (F.col("code") == " ") & (F.col("_pen").isNull() | (F.col("x1") <= F.col("_pen") + OVERLAP))
    far = (F.col("code") != " ") & (F.col("_pen") - F.col("x1") > gap)
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_token", F.sum((blank | F.coalesce(far, F.lit(False))).cast("int")).over(so_far)).withColumn("_place", F.row_number().over(by))
    kept = rows.where("code <> ' '").groupBy(*keys, "row", "_token").agg(F.sort_array(F.collect_list(F.struct("_place", "code", "font"))).alias("g"))
    number = F.row_number().over(Window.partitionBy(*keys, "row").orderBy("_token")) - 1
    return kept.select(*keys, "row", number.alias("token"), F.col("g.code").alias("codes"), F.col("g")[0]["font"].alias("font"))


def decoded_tokens(tokens: DataFrame, font_map: DataFrame) -> DataFrame:
    """``tokens`` with ``text``: codes by the letters of their font (font, code, letter), others as they are."""
    maps = font_map.groupBy("font").agg(F.map_from_entries(F.collect_list(F.struct("code", "letter"))).alias("_map"))
    joined = tokens.join(maps, "font", "left")
    letters = F.transform("codes", lambda c: F.coalesce(F.try_element_at("_map", c), c))
    return joined.withColumn("text", F.array_join(letters, "")).drop("_map")


def zero_width(glyphs: DataFrame, share: float = 0.9) -> DataFrame:
    """(font, code) of the codes that are marks: nearly all of their glyphs have no width."""
    return glyphs.groupBy("font", "code").agg(F.count_if(F.col("x1") <= F.col("x0")).alias("z"), F.count("*").alias("n")).where(F.col("z") >= share * F.col("n")).select("font", "code")


def shape(word: Sequence[str]) -> tuple[int, ...]:
    """A word's pattern of repeats: words of one shape can stand for each other."""
    seen: dict[str, int] = {}
    return tuple(seen.setdefault(c, len(seen)) for c in word)


def patched(letters: dict[str, str], code: str, letter: str) -> dict[str, str]:
    """``letters`` with ``letter`` for ``code``, still one to one: what held it takes what ``code`` had, or nothing."""
    out = dict(letters)
    holder = next((c for c, x in letters.items() if x == letter and c != code), None)
    had = out.pop(code, None)
    if holder is not None:
        del out[holder]
        if had is not None:
            out[holder] = had
    out[code] = letter
    return out


def crib(rows: Sequence[Sequence[tuple[str, ...]]], prefix: Sequence[str], names: Sequence[str], pinned: dict[str, str]) -> dict[str, str]:
    """Letters that header rows give away: a row whose first words have the shape of the known ``prefix`` spells it out.

    The word after the prefix is one of ``names``: it pins letters where a single name of its shape agrees with what is
    pinned. Rows that contradict what is pinned are left alone.
    """

    def agrees(codes: Sequence[str], word: str, known: dict[str, str]) -> bool:
        held = {x: c for c, x in known.items()}
        return shape(codes) == shape(word) and all(known.get(c, x) == x and held.get(x, c) == c for c, x in zip(codes, word, strict=True))

    for row in rows:
        known = dict(pinned)
        if len(row) < len(prefix) or not all(agrees(codes, word, known) for codes, word in zip(row, prefix)):
            continue
        for codes, word in zip(row, prefix):
            known.update(zip(codes, word, strict=True))
        if len(row) > len(prefix):
            fitting = [n for n in names if agrees(row[len(prefix)], n, known)]
            if len(fitting) == 1:
                known.update(zip(row[len(prefix)], fitting[0], strict=True))
        pinned = known
    return pinned


def voted(coded: Counter, vocabulary: dict[str, int], pinned: dict[str, str], rounds: int = 30) -> dict[str, str]:
    """Letters for codes, one to one, by votes of the known words of each coded word's shape.

    At first every word of the shape has a vote, then, round by round, only those that agree with the letters chosen so far
    in all places but one at most; each round, letters are chosen by the strongest votes.
    """
    shapes: dict[tuple[int, ...], list[tuple[str, int]]] = defaultdict(list)
    for word, n in vocabulary.items():
        shapes[shape(word)].append((word, n))
    chosen = dict(pinned)
    for turn in range(rounds):
        votes: Counter[tuple[str, str]] = Counter()
        for word, times in coded.items():
            options = shapes.get(shape(word), ())
            if chosen:
                wrong = [(sum(c in chosen and chosen[c] != x for c, x in zip(word, known, strict=True)), known, n) for known, n in options]
                least = min((w for w, _, _ in wrong), default=0)
                options = [(known, n) for w, known, n in wrong if w == least and w <= max(1, len(word) // (2 + turn))]
            total = sum(n for _, n in options)
            for known, n in options:
                for c, x in zip(word, known, strict=True):
                    votes[c, x] += times * n / total * len(word)
        new = dict(pinned)
        for (c, x), _ in sorted(votes.items(), key=lambda v: (-v[1], v[0])):
            if c not in new and x not in new.values():
                new[c] = x
        if new == chosen:
            break
        chosen = new
    return chosen


class Climb:
    """Hill climbing over maps of codes to letters; the height is the letters in known words, a word by its times."""

    def __init__(self, coded: Counter, vocabulary: dict[str, int]) -> None:
        self.coded, self.vocabulary = coded, vocabulary
        self.holding: dict[str, list[tuple[str, ...]]] = defaultdict(list)
        for word in coded:
            for code in set(word):
                self.holding[code].append(word)

    def height(self, letters: dict[str, str], codes: Sequence[str] | None = None) -> int:
        """Of all words, or of those that hold one of ``codes``."""
        words = self.coded if codes is None else {w: None for c in codes for w in self.holding[c]}
        return sum(self.coded[w] * len(w) for w in words if "".join(letters.get(c, c) for c in w) in self.vocabulary)

    def _better(self, letters: dict[str, str], other: dict[str, str]) -> bool:
        changed = [c for c in {*letters, *other} if letters.get(c) != other.get(c)]
        return self.height(other, changed) > self.height(letters, changed)

    def up(self, letters: dict[str, str], pinned: dict[str, str], alphabet: Sequence[str]) -> dict[str, str]:
        """The map from which no patch leads higher; pinned codes and letters stay."""
        codes, free = sorted(c for c in self.holding if c not in pinned), [x for x in alphabet if x not in pinned.values()]
        moved = True
        while moved:
            moved = False
            for code in codes:
                for letter in free:
                    if letters.get(code) != letter:
                        other = patched(letters, code, letter)
                        if self._better(letters, other):
                            letters, moved = other, True
        return letters

    def shared(self, letters: dict[str, str], pinned: dict[str, str], alphabet: Sequence[str]) -> dict[str, str]:
        """A last step that lets two codes have one letter, as fonts with several forms of a letter need."""
        for code in sorted(c for c in self.holding if c not in pinned):
            for letter in alphabet:
                other = {**letters, code: letter}
                if letters.get(code) != letter and self._better(letters, other):
                    letters = other
        return letters


def solve(words: list[tuple[str, ...]], vocabulary: dict[str, int], rounds: int = 30, pinned: dict[str, str] | None = None, seeds: int = 4) -> dict[str, str]:
    """Letters for codes that make most of the words known: hill climbing from ``seeds`` starts, the highest wins.

    The first start is the vote of shapes, the second the order of frequencies, the others shuffle that.
    """
    coded, pinned = Counter(words), dict(pinned or {})
    use: Counter[str] = Counter()
    for word, n in vocabulary.items():
        for x in word:
            use[x] += n
    alphabet = [x for x, _ in sorted(use.items(), key=lambda v: (-v[1], v[0]))]
    often: Counter[str] = Counter()
    for word, times in coded.items():
        for c in word:
            often[c] += times
    codes = [c for c, _ in sorted(often.items(), key=lambda v: (-v[1], v[0])) if c not in pinned]
    free = [x for x in alphabet if x not in pinned.values()]
    climb, best = Climb(coded, vocabulary), None
    for seed in range(max(1, seeds)):
        if seed == 0:
            start = voted(coded, vocabulary, pinned, rounds)
        else:
            order = free if seed == 1 else random.Random(seed).sample(free, len(free))
            start = {**pinned, **dict(zip(codes, order))}
        top = climb.up(start, pinned, alphabet)
        if best is None or climb.height(top) > climb.height(best):
            best = top
        if seed == 0 and climb.height(best) >= 0.95 * sum(n * len(w) for w, n in coded.items()):
            break
    return climb.shared(best, pinned, alphabet)


def solved_fonts(tokens: DataFrame, vocabulary: DataFrame, least: int = LEAST_WORDS, most: int = 3000, least_count: int = 2, most_known: int = 2_000_000) -> DataFrame:
    """(font, code, letter, known_share) of each font with at least ``least`` words of two codes or more.

    A font's ``most`` first words in the order of their hashes are what its letters are fitted to. ``known_share`` is over
    all of its tokens. Words of ``vocabulary`` (word, n) count as known from ``least_count`` on, all of them; a vocabulary of
    more than ``most_known`` such words is refused, not cut, as every task holds it.
    """
    known = vocabulary.where(F.col("n") >= least_count).select("word", "n")
    rows = known.limit(most_known + 1).collect()
    if len(rows) > most_known:
        raise ValueError(f"a vocabulary may have {most_known} words; raise least_count")
    table = {r["word"]: r["n"] for r in rows}
    ranked = tokens.where(F.size("codes") >= 2).withColumn("_nth", F.row_number().over(Window.partitionBy("font").orderBy(F.xxhash64("codes"), "codes"))).where(F.col("_nth") <= most)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        words = [tuple(w) for w in frame["codes"]]
        letters = solve(words, table) if len(words) >= least else {}
        return pd.DataFrame([(frame["font"].iloc[0], c, x) for c, x in letters.items()], columns=["font", "code", "letter"])

    maps = cut(ranked.groupBy("font").applyInPandas(run, "font string, code string, letter string"))
    decoded = decoded_tokens(tokens.where(F.size("codes") >= 2).select("font", "codes"), maps).groupBy("font", "text").agg(F.count("*").alias("times"))
    shares = decoded.join(known.select(F.col("word").alias("text"), F.lit(1).alias("known")), "text", "left").groupBy("font").agg((F.sum(F.when(F.col("known") == 1, F.col("times")).otherwise(0)) / F.sum("times")).alias("known_share"))
    return maps.join(shares, "font")


def majority(votes: DataFrame, least: int = 3, share: float = 0.8) -> DataFrame:
    """(code, letter) by votes (code, letter): enough of them, and one letter for most; of rivals for a letter the stronger stays."""
    counts = votes.groupBy("code", "letter").agg(F.count("*").alias("n"))
    by_code = counts.groupBy("code").agg(F.max_by(F.struct("letter", "n"), F.struct("n", "letter")).alias("best"), F.sum("n").alias("total"))
    strong = by_code.where((F.col("best.n") >= least) & (F.col("best.n") >= share * F.col("total"))).select("code", "best.letter", "best.n")
    return strong.groupBy("letter").agg(F.max_by("code", F.struct("n", "code")).alias("code")).select("code", "letter")
