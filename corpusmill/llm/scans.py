"""Problem 2: text of scanned pages made into continuous paragraphs.

Averaged perceptrons edit the text. The first tells furniture (running headers, page numbers) from text lines by what
stands on a line, where it stands on its page, whether its number is one of the pages of the document, and how often its
like stands in other documents of the year. The editor chooses for each word one of the operations keep, replace, delete and
insert, and for each line end keep or join. Candidates of words come from an equality join of one-letter variants with the
words of the collection; the editor is trained on clean words that were misread on purpose, by letters replaced as the
collection's own confusions go, dropped or doubled. Joins are trained on the line ends that leave no doubt, with and without
sight of the mark.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.numerals import LETTER_VALUES
from corpusmill.llm.wording import bounded, sliced
from corpusmill.session import cut, kept

#: Words that the editor is trained on, at most: half of them the most frequent, half the first in the order of their hashes.
TRAIN_WORDS = 6_000
PASSES = 5
LINE_PASSES = 60
#: Occurrences a word needs to be what another one is a misreading of.
SUPPORT = 3
#: Share of a word's occurrences that may be misread in one and the same way; what is seen oftener is a word itself.
SAME_MISREADING = 0.05
#: Share of the words taught with a letter dropped, and of those with one doubled.
DROPPED = 0.03
#: Marks of a broken word; the first three are used for nothing else.
BREAKS = "¬‐­-־"
SURE_BREAKS = "¬‐­"

_LETTERS = "א-ת"
#: Punctuation around words.
_TRIM = ".,;:!?\"()״׳“”„…"
#: A number of a page: digits, or Hebrew letters with geresh or gershayim.
_NUMBER = rf"(?:\d{{1,4}}|[א-ת]׳(?![{_LETTERS}])|ת?ת?[ק-ת]?[י-צ]?״?[א-ט](?<=״.)|ת?ת?[ק-ת]?״?[י-צ](?<=״.)|ת?ת?״?[ק-ת](?<=״.)|[קרש]?ט״[וז])"
_NUMERAL = re.compile(rf"[(\"]?{_NUMBER}[{re.escape(_TRIM)}]*")
_ALONE = re.compile(rf"(?:[\[(—–\-|•]\s*)*(?:עמוד\s+|דף\s+|page\s+)?{_NUMBER}(?:\s*[\])—–\-|•.])*", re.IGNORECASE)
_FIRST = re.compile(rf"^\s*{_NUMBER}\s+")
_LAST = re.compile(rf"\s+{_NUMBER}\s*$")
_PREFIXED = re.compile(rf"[{_LETTERS}]?\d+")


class Perceptron:
    """Averaged perceptron over named features; candidates of an example compete, the first feature list is 'keep'."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = defaultdict(float)
        self._totals: dict[str, float] = defaultdict(float)
        self._since: dict[str, int] = defaultdict(int)
        self._step = 0

    def score(self, features: list[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in features)

    def best(self, candidates: list[list[str]]) -> int:
        scores = [self.score(c) for c in candidates]
        return scores.index(max(scores))

    def _add(self, feature: str, by: float) -> None:
        self._totals[feature] += (self._step - self._since[feature]) * self.weights[feature]
        self._since[feature] = self._step
        self.weights[feature] += by

    def fit(self, examples: list[tuple[list[list[str]], int]], passes: int = PASSES, margin: float = 0.0) -> "Perceptron":
        """Learns from (candidates, right one); with a ``margin`` also from those that are right by less than it."""
        order = list(range(len(examples)))
        shuffle = random.Random(7).shuffle
        for _ in range(passes):
            shuffle(order)
            for i in order:
                candidates, gold = examples[i]
                self._step += 1
                scores = [self.score(c) - margin * (k == gold) for k, c in enumerate(candidates)]
                guess = scores.index(max(scores))
                if guess != gold:
                    for f in candidates[gold]:
                        self._add(f, 1.0)
                    for f in candidates[guess]:
                        self._add(f, -1.0)
        for f in list(self.weights):
            self._add(f, 0.0)
            self.weights[f] = self._totals[f] / max(1, self._step)
        return self


def line_shape(line: str) -> tuple[str, int, int]:
    """The line without what furniture adds to it, and its marks: 1 number alone, 2 bullet, 4 bars, 8 wide gaps, 16 number at an end, 32 digits alone."""
    text = line.strip()
    if _ALONE.fullmatch(text):
        return "", 1 + 32 * text.isdigit(), 0
    marks = 2 * ("•" in text) + 4 * (text.startswith("|") or text.endswith("|")) + 8 * bool(re.search(r"\S {2,}\S", text))
    core = re.sub(r"[|•]", " ", text)
    less = _LAST.sub("", _FIRST.sub("", core))
    less = _LAST.sub("", less)
    marks += 16 * (less.strip() != core.strip())
    core = " ".join(less.split())
    return core, marks, len(core.split(" ")) if core else 0


def numbers_of(line: str) -> set[int]:
    """Values of the numbers that stand alone or at an end of a line, in digits or letters; a section's name doesn't count as one."""
    text = re.sub(r"[|•]", " ", line.strip())
    found = [text] if _ALONE.fullmatch(text) else [m.group(0) for m in (_FIRST.search(text), _LAST.search(text)) if m]
    out = {int(d) for x in found for d in re.findall(r"\d{1,4}", x)}
    return out | {n for x in found if (n := sum(LETTER_VALUES.get(c, 0) for c in re.sub("עמוד|דף", "", x)))}


def _lines(batches):
    for batch in sliced(batches):
        ids, years, bodies, listed = (batch.column(i).to_pylist() for i in range(4))
        out: dict[str, list] = {k: [] for k in ("doc", "year", "line_no", "core", "marks", "words", "edge_of", "blank_by", "last", "listed")}
        for doc, year, body, numbers in zip(ids, years, bodies, listed, strict=True):
            numbers = set(numbers or ())
            lines = body.split("\n")
            sizes = sorted(len(x) for x in lines if x.strip())
            middle = sizes[len(sizes) // 2] if sizes else 1
            for i, line in enumerate(lines):
                if not line.strip():
                    continue
                core, marks, words = line_shape(line)
                blank = int(i == 0 or not lines[i - 1].strip()) + int(i == len(lines) - 1 or not lines[i + 1].strip())
                beside = any(0 <= j < len(lines) and lines[j].strip() and line_shape(lines[j])[1] & 1 for j in (i - 1, i + 1))
                known = int(bool(numbers) and marks & 15 != 0 and bool(numbers_of(line) & numbers))
                row = (doc, year, i, core, marks, words, int(i == 0 or i == len(lines) - 1), blank + 4 * beside, min(3, 4 * len(line) // max(1, middle)), known)
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc", batch.schema.field(0).type), ("year", pa.int32()), ("line_no", pa.int32()), ("core", pa.string()), *((k, pa.int32()) for k in ("marks", "words", "edge_of", "blank_by", "last", "listed"))]))


def _line_features() -> dict[str, Column]:
    """Yes-or-no features of a line, which stay in the JVM."""
    marks, out = F.col("marks"), {"bias": F.lit(True)}
    for name, bit in (("number", 1), ("bullet", 2), ("bars", 4), ("gaps", 8), ("number at end", 16), ("digits", 32)):
        out[name] = marks.bitwiseAND(bit) > 0
    out |= {"one word": F.col("words") == 1, "few words": F.col("words").between(2, 6), "many words": F.col("words") > 6}
    out |= {"header of the year": F.col("near") == 0, "near header": F.col("near").between(1, 98), "no header": F.col("near") > 98}
    out |= {"page of the document": F.col("listed") == 1, "page edge": F.col("edge_of") == 1, "blank beside": F.col("blank_by").bitwiseAND(3) > 0, "by number": F.col("blank_by") >= 4, "short": F.col("last") <= 1, "full": F.col("last") >= 3}
    return out


def furniture(df: DataFrame, key: str, body: str, year: str, pages: str | None = None) -> DataFrame:
    """(doc, line_no) of running headers and page numbers. See :func:`scan_findings` for its cases."""
    listed = F.lit(None).cast("array<int>") if pages is None else F.col(f"`{pages}`").cast("array<int>")
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`").alias("doc"), F.coalesce(F.col(f"`{year}`").cast("int"), F.lit(-1)).alias("year"), F.col(f"`{body}`").alias("body"), listed.alias("listed")).where("doc is not null and body is not null")
    lines = kept(rows.mapInArrow(_lines, f"doc {kind}, year int, line_no int, core string, marks int, words int, edge_of int, blank_by int, last int, listed int"))
    strong = F.col("marks").bitwiseAND(14) > 0
    headers = lines.where("words >= 2").groupBy("year", "core").agg(F.countDistinct("doc").alias("docs"), F.count("*").alias("n"), F.count(F.when(strong, 1)).alias("marked"))
    headers = cut(headers.where("marked >= 1 and n >= 2 and (docs >= 2 or marked >= 2)").select("year", F.col("core").alias("header")))
    # A line meets the headers of its year whose length allows the distance: an equality join on year and length.
    most = 1 + F.floor(F.length("header") / 5).cast("int")
    by_length = headers.select("year", "header", most.alias("most"), F.explode(F.sequence(F.greatest(F.lit(1), F.length("header") - most), F.length("header") + most)).alias("size"))
    shapes = lines.where("words >= 1").select("year", "core").distinct().withColumn("size", F.length("core"))
    near = shapes.join(bounded(by_length, 100_000), ["year", "size"]).withColumn("near", F.expr("levenshtein(core, header, most)")).where("near >= 0").groupBy("year", "core").agg(F.min("near").alias("near"))
    seen = lines.join(near, ["year", "core"], "left").withColumn("near", F.coalesce("near", F.lit(99)))
    features = _line_features()
    # Sure cases teach: a recurring header or number alone is furniture, a full line that is like no header is text.
    sure = F.when((F.col("marks") == 1) | (F.col("marks").bitwiseAND(1) == 1) & (F.col("listed") == 1) | strong & (F.col("near") < 99), 1).when((F.col("near") == 99) & ~strong & (F.col("words") >= 1), 0)
    sample = seen.select(sure.alias("gold"), *(v.alias(k) for k, v in features.items())).where("gold is not null").distinct().collect()
    # Each kind of line once: marks, numbers of words and places make at most a few thousand.
    examples = sorted(([["keep"], [k for k in features if r[k]]], r["gold"]) for r in sample)
    # There are few distinct examples, and they are told apart by rules: many passes and a margin leave none of them wrong.
    model = Perceptron().fit(examples, LINE_PASSES, 1.0) if {g for _, g in examples} == {0, 1} else None
    if model is None:
        return seen.where((F.col("marks").bitwiseAND(1) == 1) | strong).select("doc", "line_no")
    total = F.lit(-model.weights["keep"])
    for name, flag in features.items():
        total = total + F.when(flag, F.lit(model.weights[name])).otherwise(0.0)
    return seen.where(total > 0).select("doc", "line_no")


def words_of_line(line: str) -> list[str]:
    """Words with what may be misread in them; outer punctuation, maqaf compounds and plain numbers are taken apart."""
    out = []
    for token in line.split():
        if _NUMERAL.fullmatch(token):
            continue
        for part in re.split("[־–—]", token):
            word = part.strip(_TRIM)
            if word and not (word.startswith("[") and word.endswith("]")):
                out.append(word.rstrip("".join(BREAKS)))
    return out


def _odd(word: str) -> bool:
    """Whether a word of Hebrew letters holds a character that no such word has."""
    if not re.search(f"[{_LETTERS}]", word) or _PREFIXED.fullmatch(word):
        return False
    plain = re.sub(rf"(?<=[{_LETTERS}])[\"״׳](?=[{_LETTERS}])", "", word)
    return bool(re.search(rf"[^{_LETTERS}]", plain))


def _plain(word: str) -> str:
    return re.sub(rf"(?<=[{_LETTERS}])[\"״](?=[{_LETTERS}])", "", word)


def _tokens(batches):
    """Rows (doc, line_no, word, left, right, mark): the words of text lines; for line ends also the parts of a join."""
    for batch in sliced(batches):
        out: dict[str, list] = {k: [] for k in ("doc", "line_no", "word", "left", "right", "mark")}

        def put(*row):
            for name, value in zip(out, row, strict=True):
                out[name].append(value)

        for doc, body, edges in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            skip = set(edges or ())
            lines = [(i, x) for i, x in enumerate(body.split("\n")) if x.strip() and i not in skip]
            for n, (i, line) in enumerate(lines):
                for word in words_of_line(line):
                    if re.search(f"[{_LETTERS}]", word):
                        put(doc, i, _plain(word), None, None, None)
                if n + 1 < len(lines):
                    end, begin = line.split()[-1], lines[n + 1][1].split()[0]
                    mark = end[-1] if end[-1] in BREAKS else ""
                    left = re.search(rf"([{_LETTERS}\"״|·'\w]*)$", end[: -1 if mark else None])
                    right = re.match(rf"[(\"]*([{_LETTERS}\"״|·'\w]*)", begin)
                    x, y = _plain(left.group(1).strip(_TRIM)), _plain(right.group(1).strip(_TRIM))
                    if (mark or end[-1].isalpha()) and re.search(f"[{_LETTERS}]", x) and re.search(f"[{_LETTERS}]", y):
                        put(doc, i, x + y, x, y, mark)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc", batch.schema.field(0).type), ("line_no", pa.int32()), *((k, pa.string()) for k in ("word", "left", "right", "mark"))]))


#: A prime and a base of the hashes of variants; a hole is a character that no text has.
_PRIME, _RADIX, _HOLE = (1 << 61) - 1, 0x5851F42D4C957F2D % ((1 << 61) - 1), 0x110000


def variant_keys(word: str) -> list[tuple[int, str, int]]:
    """(key, op, place) of a word, of the word with a hole at each place, and of the word less each letter.

    Keys are polynomial hashes put together from those of the word's beginnings and ends, so time is linear in its length.
    """
    n = len(word)
    before, after, power = [0] * (n + 1), [0] * (n + 1), [1] * (n + 2)
    for i, ch in enumerate(word):
        before[i + 1] = (before[i] * _RADIX + ord(ch) + 1) % _PRIME
        power[i + 1] = power[i] * _RADIX % _PRIME
    power[n + 1] = power[n] * _RADIX % _PRIME
    for i in range(n - 1, -1, -1):
        after[i] = ((ord(word[i]) + 1) * power[n - 1 - i] + after[i + 1]) % _PRIME
    rows = [(before[n], "whole", -1)]
    rows += [((before[i] * power[n - i] + _HOLE * power[n - i - 1] + after[i + 1]) % _PRIME, "hole", i) for i in range(n)]
    return rows + [((before[i] * power[n - i - 1] + after[i + 1]) % _PRIME, "less", i) for i in range(n) if i == 0 or word[i] != word[i - 1]]


def _variants(batches):
    """Rows (key, word, op, place) of the one-letter variants of words of two letters or more."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            out: dict[str, list] = {"key": [], "word": [], "op": [], "place": []}
            for word in batch.column(0).slice(at, 2000).to_pylist():
                if len(word) < 2:
                    continue
                for key, op, place in variant_keys(word):
                    for name, value in zip(out, (key, word, op, place), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("key", pa.int64()), ("word", pa.string()), ("op", pa.string()), ("place", pa.int32())]))


_VARIANT = "key bigint, word string, op string, place int"


def candidates(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, op, place, fixed, support): lexicon words one letter from each word, by an equality join of variants."""
    seen = words.select("word").distinct().mapInArrow(_variants, _VARIANT)
    known = lexicon.where(F.col("n") >= SUPPORT)
    index = known.select("word").mapInArrow(_variants, _VARIANT).withColumnRenamed("word", "fixed").withColumnRenamed("op", "fixed_op").withColumnRenamed("place", "fixed_place")
    index = index.join(known.select(F.col("word").alias("fixed"), F.col("n").alias("support")), "fixed")
    met = seen.join(index, "key").where("word <> fixed")
    op = (
        F.when((F.col("op") == "hole") & (F.col("fixed_op") == "hole") & (F.col("place") == F.col("fixed_place")), "replace")
        .when((F.col("op") == "less") & (F.col("fixed_op") == "whole"), "delete")
        .when((F.col("op") == "whole") & (F.col("fixed_op") == "less"), "insert")
    )
    return met.select("word", op.alias("op"), F.greatest("place", "fixed_place").alias("place"), "fixed", "support").where("op is not null and levenshtein(word, fixed, 1) = 1").distinct()


def _bucket(x: float) -> int:
    return max(-3, min(6, round(x)))


def _candidate_features(word: str, count: float, seen: float, op: str, place: int, fixed: str, support: float, confusion: dict[tuple[str, str], float]) -> list[str]:
    known = "new" if count == 0 else "rare" if count < 0.2 * seen else "known"
    odd = "odd" if _odd(word) else "plain"
    out = [f"{op} {known} {odd}"]
    if op == "replace":
        weight = confusion.get((fixed[place], word[place]), -9.0)
        out += [f"confusion {_bucket(weight)}", f"confusion {_bucket(weight)} {known}"]
    else:
        out += [f"{op}", f"{op} at {'end' if place >= len(word) - 1 else 'start' if place == 0 else 'middle'}"]
    return [*out, f"support {_bucket(math.log10(support + 1) * 1.5)} {known}", f"length {min(6, len(word))} {known}"]


def _decided(batches, model, confusion, ratio):
    """Rows (word, op, fixed) of words whose best operation isn't keep."""
    for batch in sliced(batches):
        rows = []
        for r in batch.to_pylist():
            word, count, seen = r["word"], r["expected"], r["seen"]
            options = sorted((c["op"], c["place"], c["fixed"], c["support"]) for c in r["options"] or [])
            if not _odd(word) and seen >= SUPPORT:
                options = [o for o in options if seen <= max(1.0, SAME_MISREADING * ratio * o[3])]
            lists = [["keep", f"keep {'odd' if _odd(word) else 'plain'}"], *(_candidate_features(word, count, seen, *o, confusion) for o in options)]
            best = model.best(lists)
            if best or _odd(word):
                rows.append((word, options[best - 1][0] if best else "replace", options[best - 1][2] if best else None))
        yield pa.RecordBatch.from_pydict({k: [x[i] for x in rows] for i, k in enumerate(("word", "op", "fixed"))}, schema=pa.schema([(k, pa.string()) for k in ("word", "op", "fixed")]))


def lexicon_of(texts: DataFrame, text: str) -> DataFrame:
    """(word, n) of the runs of Hebrew letters in clean texts, without points."""
    plain = F.regexp_replace(F.regexp_replace(F.col(f"`{text}`"), "[֑-ֽֿ-ׇ]", ""), '(?<=[א-ת])["״](?=[א-ת])', "")
    words = texts.select(F.explode(F.regexp_extract_all(plain, F.lit("[א-ת]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def scan_findings(df: DataFrame, clean: DataFrame, key: str = "pdf_id", body: str = "body", year: str = "year", clean_text: str = "text", pages: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, fixes) of scanned bodies.

    ``findings`` (``key``, line_no, kind): ``edge`` for a running header or page number, ``hyphen`` for a line whose last
    word goes on in the next line of text, ``misread`` for a line with a misread word; lines count from 0, blank ones
    included. ``fixes`` (doc, line_no, word, op, fixed, left, right): the edits; op ``join`` puts left and right together.
    ``clean`` are texts whose words are taken as read rightly. Null keys and bodies give no rows, empty bodies none;
    a null year is a year of its own; ``pages`` names a column with the numbers of a document's pages, if there is one;
    further columns are ignored.
    """
    kind = df.schema[key].dataType.simpleString()
    edges = cut(furniture(df, key, body, year, pages))
    per_doc = edges.groupBy("doc").agg(F.collect_set("line_no").alias("edges"))
    bodies = df.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{body}`").alias("body")).where("doc is not null and body is not null").join(per_doc, "doc", "left").select("doc", "body", "edges")
    tokens = kept(bodies.mapInArrow(_tokens, f"doc {kind}, line_no int, word string, left string, right string, mark string"))
    lexicon = cut(lexicon_of(clean, clean_text))
    size = lexicon.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] or 1
    words = tokens.where("left is null")
    counts = cut(words.groupBy("word").agg(F.count("*").alias("seen")))
    read = counts.agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0] or 1
    # Line ends: a break if the mark says so, or if the whole is a word and the parts aren't likelier by themselves.
    ends = tokens.where("left is not null")
    known = bounded(lexicon)
    for part in ("left", "right", "word"):
        ends = ends.join(known.select(F.col("word").alias(f"_{part}"), F.col("n").alias(f"n_{part}")), F.col(part) == F.col(f"_{part}"), "left").drop(f"_{part}")
    n = {p: F.coalesce(f"n_{p}", F.lit(0)) for p in ("left", "right", "word")}
    # How many times likelier the whole is than its parts side by side.
    odds = F.log10((n["word"] + 0.02) * F.lit(float(size)) / ((n["left"] + 0.02) * (n["right"] + 0.02)))
    ends = ends.select("doc", "line_no", "word", "left", "right", "mark", odds.alias("odds"), *(n[p].alias(f"n_{p}") for p in ("word", "left", "right")))
    joined = cut(_joined(ends))
    # Words of text lines that aren't parts of a broken word, as often as the clean texts let one expect them.
    halves = joined.select("left").union(joined.select("right")).groupBy(F.col("left").alias("word")).agg(F.count("*").alias("halves"))
    rows = counts.join(halves, "word", "left").withColumn("seen", F.greatest(F.lit(0), F.col("seen") - F.coalesce("halves", F.lit(0)))).where("seen > 0")
    rows = cut(rows.join(lexicon, "word", "left").select("word", "seen", (F.coalesce("n", F.lit(0)) * F.lit(read / size)).alias("expected")))
    doubtful = rows.where("expected < 0.1 * seen")
    options = candidates(doubtful, lexicon)
    options = cut(options)
    # Confusions: what new words have in place of the letters of the words they are one letter from.
    new = rows.where("expected = 0").select("word", "seen")
    mapped = options.where("op = 'replace'").join(new, "word").select(F.expr("substring(fixed, place + 1, 1)").alias("right"), F.expr("substring(word, place + 1, 1)").alias("wrong"), (F.col("seen") * F.col("support")).alias("w"), "word", "seen")
    best = mapped.groupBy("word", "right", "wrong").agg(F.max("w").alias("w"), F.max("seen").alias("seen")).groupBy("word").agg(F.max_by(F.struct("right", "wrong", "seen"), "w").alias("x"))
    table = best.groupBy("x.right", "x.wrong").agg(F.sum("x.seen").alias("n")).collect()  # at most the square of the alphabet
    total = sum(r["n"] for r in table) or 1
    by_right, by_wrong = defaultdict(float), defaultdict(float)
    for r in table:
        by_right[r["right"]] += r["n"]
        by_wrong[r["wrong"]] += r["n"]
    confusion = {(r["right"], r["wrong"]): math.log2((r["n"] + 0.5) * total / (by_right[r["right"]] * by_wrong[r["wrong"]] + 1)) + math.log10(r["n"] + 1) - 1 for r in table}
    model = _trained(lexicon, table, confusion, read / size)
    grouped = rows.join(options.groupBy("word").agg(F.collect_list(F.struct("op", "place", "fixed", "support")).alias("options")), "word", "left")
    grouped = grouped.where("options is not null or word rlike '[^א-ת]'").select("word", "seen", "expected", "options")
    decided = cut(grouped.mapInArrow(lambda batches: _decided(batches, model, confusion, read / size), "word string, op string, fixed string"))
    # The two halves of a broken word aren't words; only their odd characters tell.
    parts = joined.where("not left rlike '[^א-ת]'").select("doc", "line_no", F.col("left").alias("word"))
    misread = words.select("doc", "line_no", "word").join(bounded(decided), "word").select("doc", "line_no", "word", "op", "fixed")
    first = joined.select("doc", F.col("right").alias("word"))
    misread = misread.join(parts, ["doc", "line_no", "word"], "left_anti")
    halves_of = misread.join(first, ["doc", "word"], "left_semi").where("not word rlike '[^א-ת]'")
    misread = misread.join(halves_of.select("doc", "line_no", "word").distinct(), ["doc", "line_no", "word"], "left_anti")
    findings = edges.select("doc", "line_no", F.lit("edge").alias("kind")).unionByName(joined.select("doc", "line_no", F.lit("hyphen").alias("kind"))).unionByName(misread.select("doc", "line_no", F.lit("misread").alias("kind"))).distinct()
    fixes = misread.select("doc", "line_no", "word", "op", "fixed", F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right")).unionByName(joined.select("doc", "line_no", "word", F.lit("join").alias("op"), F.col("word").alias("fixed"), "left", "right"))
    return findings.withColumnRenamed("doc", key), fixes


#: Odds of the whole, as powers of ten, under which a line end without a mark is surely kept and above which it is surely joined.
SURE_ODDS = (1.0, 3.0)
#: Bounds between the classes of odds, as powers of ten.
ODDS = (-4, -3, -2, -1, -0.5, 0, 0.5, 1, 1.5, 2, 2.5, 3, 4, 5, 6)


#: Kinds of marks at a line's end.
MARKS = ("none", "other", "sure")


def _end_features(code: int) -> list[str]:
    """Features of joining a line end by its code: kind of mark, which of whole, left and right are words, class of odds."""
    code, level = divmod(code, len(ODDS) + 1)
    kind, known = divmod(code, 8)
    out = ["join", MARKS[kind]] + [f"{MARKS[kind]}, {part} known" for bit, part in ((4, "whole"), (2, "left"), (1, "right")) if known & bit]
    # Odds count up: each class passed adds its weight.
    return out + [f"{MARKS[kind]}, no part known"] * (known & 3 == 0) + [f"{MARKS[kind]}, odds over {low}" for low in ODDS[:level]]


def _end_code(mark: Column) -> Column:
    kind = F.when(mark.isin(*SURE_BREAKS), 2).when(mark != "", 1).otherwise(0)
    known = sum((F.when(F.col(c) > 0, bit).otherwise(0) for c, bit in (("n_word", 4), ("n_left", 2), ("n_right", 1))), F.lit(0))
    level = sum((F.when(F.col("odds") > low, 1).otherwise(0) for low in ODDS), F.lit(0))
    return (kind * 8 + known) * (len(ODDS) + 1) + level


def _joined(ends: DataFrame) -> DataFrame:
    """(doc, line_no, word, left, right) of the line ends that the editor joins.

    Sure ends teach. Those with a mark used for nothing else are joined, and where the whole is a word they are shown with a
    doubtful mark too. Those without a mark are joined where the whole is a word and far likelier than its parts, and
    kept apart where it is none or no likelier; so are those with a doubtful mark between two words that make none.
    All of them teach, each kind of end once: an end has one of a few hundred codes.
    """
    mark = F.col("mark")
    sure = mark.isin(*SURE_BREAKS)
    whole, parts = F.col("n_word") >= SUPPORT, (F.col("n_left") > 0) & (F.col("n_right") > 0)
    likely = (mark == "") & (F.col("n_word") > 0) & (F.col("odds") > SURE_ODDS[1])
    apart = (mark == "") & ((F.col("n_word") == 0) | (F.col("odds") < SURE_ODDS[0])) | (mark != "") & ~sure & (F.col("n_word") == 0) & parts
    told = F.when(sure & whole, F.array(mark, F.lit("-"))).when(sure | likely | apart, F.array(mark))
    shown = ends.where(sure | likely | apart).select("*", (sure | likely).cast("int").alias("gold"), F.explode(told).alias("shown"))
    taught = sorted(tuple(r) for r in shown.select(_end_code(F.col("shown")).alias("code"), "gold").distinct().collect())
    if {g for _, g in taught} != {0, 1}:
        return ends.where(sure).select("doc", "line_no", "word", "left", "right")
    model = Perceptron().fit([([["keep"], _end_features(code)], gold) for code, gold in taught], LINE_PASSES, 1.0)
    codes = [code for code in range(len(MARKS) * 8 * (len(ODDS) + 1)) if model.best([["keep"], _end_features(code)])]
    return ends.where(sure | _end_code(mark).isin(*codes)).select("doc", "line_no", "word", "left", "right")


def _trained(lexicon: DataFrame, table: list, confusion: dict, ratio: float) -> Perceptron:
    """The editor, taught on clean words of which every second is misread: a letter replaced, or now and then dropped or doubled."""
    chance = random.Random(11)
    wrong_of: dict[str, tuple[list[str], list[float]]] = defaultdict(lambda: ([], []))
    for r in table:
        wrong_of[r["right"]][0].append(r["wrong"])
        wrong_of[r["right"]][1].append(r["n"])
    # Half frequent words, as texts have them, and half any words, as the lexicon has them.
    by_use = lexicon.orderBy(F.desc("n"), "word").limit(TRAIN_WORDS // 2).collect()
    by_hash = lexicon.where(F.col("n") >= SUPPORT).orderBy(F.xxhash64("word"), "word").limit(TRAIN_WORDS // 2).collect()
    pairs = []
    for r in [*by_use, *by_hash]:
        word = r["word"]
        at = chance.randrange(len(word))
        draw = chance.random()
        if len(word) > 2 and draw < DROPPED:
            pairs.append((word[:at] + word[at + 1 :], word))
        elif len(word) > 1 and draw < 2 * DROPPED:
            pairs.append((word[: at + 1] + word[at:], word))
        elif len(word) > 1 and word[at] in wrong_of and draw < 0.5:
            wrong = chance.choices(*wrong_of[word[at]])[0]
            pairs.append((word[:at] + wrong + word[at + 1 :], word))
        else:
            pairs.append((word, word))
    spark = lexicon.sparkSession
    shown = spark.createDataFrame(sorted({p[0] for p in pairs}), "string").toDF("word")
    got = candidates(shown, lexicon).collect() if pairs else []
    known = {r["word"]: r["n"] for r in shown.join(lexicon, "word").collect()} if pairs else {}
    options = defaultdict(list)
    for r in got:
        options[r["word"]].append((r["op"], r["place"], r["fixed"], r["support"]))
    examples = []
    for seen, word in pairs:
        choices = sorted(options[seen])
        gold = next((i + 1 for i, o in enumerate(choices) if o[2] == word), 0) if seen != word else 0
        if seen != word and not gold:
            continue
        expected = known.get(seen, 0) * ratio
        lists = [["keep", f"keep {'odd' if _odd(seen) else 'plain'}"], *(_candidate_features(seen, expected, 1.0, *o, confusion) for o in choices)]
        examples.append((lists, gold))
    return Perceptron().fit(examples)


def paragraphs(bodies: DataFrame, findings: DataFrame, fixes: DataFrame, key: str = "pdf_id", body: str = "body") -> DataFrame:
    """(``key``, paragraph, text): the repaired text, without furniture, broken words joined, one line a paragraph."""
    per_doc = findings.where("kind = 'edge'").groupBy(F.col(f"`{key}`").alias("doc")).agg(F.collect_set("line_no").alias("edges"))
    per_fix = fixes.groupBy("doc").agg(F.collect_set(F.struct("line_no", "word", "op", "fixed", "left", "right")).alias("fixes"))
    rows = bodies.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{body}`").alias("body")).where("doc is not null and body is not null").join(per_doc, "doc", "left").join(per_fix, "doc", "left")
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.select("doc", "body", "edges", "fixes").mapInArrow(_repaired, f"doc {kind}, paragraph int, text string").withColumnRenamed("doc", key)


def _repaired(batches):
    for batch in sliced(batches):
        out: dict[str, list] = {"doc": [], "paragraph": [], "text": []}
        for r in batch.to_pylist():
            skip, joins, fix = set(r["edges"] or ()), set(), defaultdict(dict)
            for f in r["fixes"] or ():
                if f["op"] == "join":
                    joins.add(f["line_no"])
                elif f["fixed"]:
                    fix[f["line_no"]][f["word"]] = f["fixed"]
            texts, now, glue = [], "", False
            for i, line in enumerate(r["body"].split("\n")):
                if i in skip:
                    continue
                if not line.strip():
                    if now and not glue:
                        texts.append(now)
                        now = ""
                    continue
                line = " ".join(line.split())
                for wrong, right in fix[i].items():
                    line = re.sub(rf"(?<![{_LETTERS}]){re.escape(wrong)}(?![{_LETTERS}])", right, line)
                now = now + line if glue or not now else f"{now} {line}"
                glue = i in joins
                if glue:
                    now = now.rstrip(BREAKS)
            if now:
                texts.append(now)
            for n, text in enumerate(texts):
                for name, value in zip(out, (r["doc"], n, text), strict=True):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc", batch.schema.field("doc").type), ("paragraph", pa.int32()), ("text", pa.string())]))
