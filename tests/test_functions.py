import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import dates, edits, numerals, text


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_scoring_text_drops_maqaf_before_hyphens(spark):
    assert tuple(one(spark, text.scoring_text(F.lit("<b>א־ב</b> ג-ד [ה] ו״ז abc")), text.scoring_text(F.lit("")), text.scoring_text(F.lit("A-b c"), "latin"))) == ("אב ג ד ה וז", "", "a b c")


def test_training_text(spark):
    assert one(spark, text.training_text(F.lit("אָב &amp; ג״ד [ה] www.x.org ווז , ש")))[0] == 'אב & ג"ד ה ווז, ש'


def test_paragraphs(spark):
    got = one(spark, text.paragraphs(F.lit("<p>הנחה</p><p class=x>א</p><p> </p><p>ב</p>")), text.paragraphs(F.lit("none")), text.paragraphs(F.lit("<p>הנחה</p>")))
    assert got == (["א", "ב"], [], [])


def test_classes(spark):
    assert tuple(one(spark, text.spelling_class(F.lit("אב")), text.spelling_class(F.lit("שבת")), text.spelling_class(F.lit("ייד")), text.frequency_class(F.lit(9)), text.frequency_class(F.lit(100)))) == ("short", "consonantal", "yiddish-like", "1-9", "100+")
    assert one(spark, text.page_class(F.lit("איז דער און די וואס מיט")), text.page_class(F.lit("a b c d e f")), text.page_class(F.lit("a")))[:] == ("yiddish", "english", "blank")


def test_lines(spark):
    got = one(spark, text.clean_line(F.lit("אב ,גד 0000 ה")), text.is_page_number(F.lit(" 12 ")), text.is_page_number(F.lit("עמוד 3")), text.is_page_number(F.lit("אבגדה")), text.upright(F.lit("(א 12)")), text.srt_time(F.lit(3725.5)), text.slug(F.lit("--a b/ג")))
    assert got[:] == ("אב, גד ה", True, True, False, ")א 21(", "01:02:05,500", "a_b_ג")


def test_page_numbers(spark):
    yes = ["12", "- 12 -", "1|2", "א", "רמ״", "קכג'", "Page 4", "page12", "עמוד  31", "1234567"]
    no = ["", "אבגד", "page", "12 x", "- 123456", "א״ב", "12a"]
    assert one(spark, *[text.is_page_number(F.lit(x)) for x in yes + no])[:] == (*[True] * len(yes), *[False] * len(no))


def test_front_matter(spark):
    long = " ".join(["x"] * 130)
    pages = ["a " * 30 + "Contents", "Contents " + long, long, "a b", "x ...... 1\ny ...... 2\nz ...... 3\n" + long, ""]
    assert one(spark, *[text.is_front_matter(F.lit(p), ["Contents"]) for p in pages])[:] == (True, False, False, True, True, False)


def test_dedication(spark):
    got = one(spark, text.without_dedication(F.lit("א\n*\nב\n*\nלזכות ג"), ["לזכות"]), text.without_dedication(F.lit("א\n*\nב"), ["לזכות"]))
    assert got[:] == ("א\nב", "א\nב")


@pytest.mark.parametrize(("words", "seconds", "loops"), [("a b c d", 9.0, False), ("a a a a", 9.0, True), ("x " * 3, 9.0, False), ("a b " * 9, 9.0, True), ("a b c d e f g", 1.0, True)])
def test_repetitive(spark, words, seconds, loops):
    assert one(spark, text.is_repetitive(F.lit(words), F.lit(seconds)))[0] is loops


def test_dates(spark):
    forms = ["1964-08-14", " 1964/08/14 ", "14-08-1964", "14 Aug 1964", "August 14, 1964", "19640814"]
    assert set(one(spark, *[dates.calendar_date(F.lit(x)) for x in forms])) == {datetime.date(1964, 8, 14)}
    assert set(one(spark, *[dates.calendar_date(F.lit(x)) for x in ("", "30-02-1964", "14 Foo 1964", "x")])) == {None}


def test_hebrew_calendar(spark):
    c = lambda *x: numerals.civil_date(*(F.lit(v) for v in x))
    assert one(spark, c(5784, 1, 1), c(5784, 6, 14), c(5782, 7, 15), c(5784, 6, 14, False))[:] == (datetime.date(2023, 9, 16), datetime.date(2024, 3, 24), datetime.date(2022, 4, 16), datetime.date(2024, 2, 23))


def test_numerals_and_digest(spark):
    assert one(spark, numerals.source_year(F.lit('תשמ"ה')), numerals.source_year(F.lit("")), numerals.year_of_name(F.lit('x תשל"ב')), numerals.year_of_name(F.lit("a 5741 b")))[:] == (5745, None, 5732, 5741)
    for key in ("abc", "001 6-Tishrei", ""):
        assert one(spark, numerals.digest_bucket(F.lit(key)))[0] == int(hashlib.sha1(key.encode()).hexdigest(), 16) % 10


def test_edits(spark):
    a, b = F.split(F.lit("a b c d"), " "), F.split(F.lit("a x c"), " ")
    assert one(spark, edits.word_edits(a, b), edits.word_edits(a, a), edits.word_edits(F.array().cast("array<string>"), a))[:] == (2, 0, 4)
    r = random.Random(2)
    for _ in range(300):
        x, y = ([r.choice("abcd") for _ in range(r.randrange(0, 90))] for _ in range(2))
        assert edits.least_edits(x, y) == sum(o != "equal" for o, _, _ in edits.align_words(x, y))
    many = [str(i) for i in range(40_000)]
    assert edits.least_edits(many, [*many[1:30_000], "x", *many[30_001:]]) == 2
    ops = edits.align_words("a b c d".split(), "a x c e".split())
    assert [o for o, _, _ in ops] == ["equal", "replace", "equal", "replace"]
    assert edits.align_words([], ["a"]) == [("insert", None, "a")]


def test_rounding_of_the_binary_value(spark):
    values = [2.675, 0.125, 0.375, 1.005, -2.5, 2.5]
    assert list(one(spark, *[numerals.rounded(F.lit(v), F.lit(k)) for v, k in zip(values, [2, 2, 2, 2, 0, 0])])) == [round(v, k) for v, k in zip(values, [2, 2, 2, 2, 0, 0])]
    assert one(spark, numerals.stamp(F.lit(datetime.datetime(2024, 1, 2, 3, 4, 5))))[0] == "2024-01-02T03:04:05"
