"""Calendar dates out of text, and the Hebrew calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English month names, by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def calendar_date(text: Column) -> Column:
    """The date that ``text`` names, else null.

    Knows year-month-day and day-month-year with ``-``, ``/`` or ``.``, eight digits, "14 Aug 1964" and
    "August 14, 1964"; blanks around don't matter; a date that isn't in the calendar is null.
    """
    x = F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))
    month_number = F.create_map(*(v for i, m in enumerate(MONTHS) for v in (F.lit(m), F.lit(str(i + 1)))))

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))

    def joined(year: Column, month: Column, day: Column) -> Column:
        return F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")).try_cast("date")

    ymd = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$"
    dmy = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$"
    eight = r"^(\d{4})(\d{2})(\d{2})$"
    day_name = r"^(\d{1,2})\.? ([a-z]{3})[a-z]*\.?,? (\d{4})$"
    name_day = r"^([a-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})$"
    name = lambda c: F.try_element_at(month_number, c)
    return F.coalesce(
        joined(part(ymd, 1), part(ymd, 2), part(ymd, 3)),
        joined(part(dmy, 3), part(dmy, 2), part(dmy, 1)),
        joined(part(eight, 1), part(eight, 2), part(eight, 3)),
        joined(part(day_name, 3), name(part(day_name, 2)), part(day_name, 1)),
        joined(part(name_day, 3), name(part(name_day, 1)), part(name_day, 2)),
    )
