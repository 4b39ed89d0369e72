"""Letter numerals, the Hebrew calendar and hash buckets, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: The number that each letter stands for.
LETTER_VALUES = {"א": 1, "ב": 2, "ג": 3, "ד": 4, "ה": 5, "ו": 6, "ז": 7, "ח": 8, "ט": 9, "י": 10, "כ": 20, "ל": 30, "מ": 40, "נ": 50, "ס": 60, "ע": 70, "פ": 80, "צ": 90, "ק": 100, "ר": 200, "ש": 300, "ת": 400}
#: Month names in Latin letters, in the order of the year that begins in autumn.
MONTHS = ("tishrei", "cheshvan", "kislev", "teves", "shvat", "adar", "nissan", "iyar", "sivan", "tammuz", "av", "elul")


def letter_number(text: Column) -> Column:
    """Sum of the values of the letters; other characters count nothing."""
    values = F.create_map(*(F.lit(x) for pair in LETTER_VALUES.items() for x in pair))
    return F.aggregate(F.split(text, ""), F.lit(0), lambda total, c: total + F.coalesce(F.try_element_at(values, c), F.lit(0)))


def source_year(text: Column, base: int = 5700) -> Column:
    """Year named by a letter number, with or without its century letters, as in תשמ"ה; null unless the rest is 1 to 99."""
    bare = F.regexp_replace(F.regexp_replace(text, "[\"'״׳]", ""), "^תש", "")
    value = letter_number(bare)
    return F.when(value.between(1, 99), value + base)


def year_of_name(name: Column) -> Column:
    """The Hebrew year in a file name: 57xx in digits, else תש and two letters, else two letters that stand alone."""
    quoted = F.translate(name, "_״", '""')
    pair = F.coalesce(*(F.nullif(F.regexp_replace(F.regexp_extract(quoted, p, 0), "^תש", ""), F.lit("")) for p in ('תש[א-ת]"[א-ת]', '(?<![א-ת])[א-ת]"[א-ת](?![א-ת])')))
    digits = F.nullif(F.regexp_extract(name, r"(57\d\d)", 1), F.lit("")).cast("int")
    return F.coalesce(digits, letter_number(F.regexp_replace(pair, '"', "")) + 5700)


def year_in(text: Column) -> Column:
    """The first Hebrew year in digits (5000 to 5999) that stands in a text."""
    return F.nullif(F.regexp_extract(text, r"(?<!\d)(5\d{3})(?!\d)", 1), F.lit("")).cast("int")


def _elapsed_days(year: Column) -> Column:
    """Days from the epoch of the calendar to the new year of ``year``, with its postponements."""
    months = F.floor((235 * year - 234) / 19)
    parts = 12084 + 13753 * months
    day = 29 * months + F.floor(parts / 25920)
    return F.when((3 * (day + 1)) % 7 < 3, day + 1).otherwise(day)


def new_year(year: Column) -> Column:
    """Day number, from the epoch, of the first day of a Hebrew year."""
    before, at, after = (_elapsed_days(year + k) for k in (-1, 0, 1))
    return at + F.when(after - at == 356, 2).when(at - before == 382, 1).otherwise(0)


def is_leap(year: Column) -> Column:
    """Whether a Hebrew year has thirteen months."""
    return (7 * year + 1) % 19 < 7


def civil_date(year: Column, month: Column, day: Column, second_adar: Column | None = None) -> Column:
    """Civil date of a Hebrew date; ``month`` counts from Tishrei as 1 to Elul as 12.

    In a leap year month 6 is the second Adar, or the first one where ``second_adar`` is false.
    """
    begin = new_year(year)
    size = new_year(year + 1) - begin
    long_second, short_third, leap = size % 10 == 5, size % 10 == 3, is_leap(year)
    upto = F.lit(0)
    lengths = [F.lit(30), F.when(long_second, 30).otherwise(29), F.when(short_third, 29).otherwise(30), F.lit(29), F.lit(30), F.when(leap, 59).otherwise(29), *(F.lit(n) for n in (30, 29, 30, 29, 30, 29))]
    for i, length in enumerate(lengths, 1):
        upto = upto + F.when(month > i, length).otherwise(0)
    first = F.lit(False) if second_adar is None else ~second_adar
    upto = upto + F.when((month == 6) & leap & ~first, 30).otherwise(0)
    # Elapsed day 0 is 2,092,590 days before 1970-01-01.
    return F.date_add(F.lit("1970-01-01").cast("date"), (begin + upto + day - 1 - 2092590).cast("int"))


def digest_bucket(text: Column, buckets: int = 10) -> Column:
    """The SHA-1 of a text, as a whole number, modulo ten: powers of sixteen end in six, so digits add up."""
    if buckets != 10:
        raise ValueError("only ten buckets have this closed form")
    digits = F.transform(F.split(F.sha1(text), ""), lambda c: F.when(c == "", 0).otherwise(F.conv(c, 16, 10).cast("int")))
    total = F.aggregate(digits, F.lit(0), lambda a, x: a + x)
    last = F.conv(F.right(F.sha1(text), F.lit(1)), 16, 10).cast("int")
    return (6 * (total - last) + last) % 10


def split_of_digest(text: Column) -> Column:
    """test, dev or train by the digest of a key."""
    bucket = digest_bucket(text)
    return F.when(bucket == 0, "test").when(bucket == 1, "dev").otherwise("train")


@F.pandas_udf(DoubleType())
def rounded(x: pd.Series, places: pd.Series) -> pd.Series:
    """Rounding of the exact binary value, halves to the even digit; the built-in rounds the shortest decimal form."""
    return pd.Series([None if v != v or v is None else round(float(v), int(p)) for v, p in zip(x, places, strict=True)], dtype="float64")


def stamp(time: Column) -> Column:
    """A time as text, to the second."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
