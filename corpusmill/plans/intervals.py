"""Problem 3: speech periods and silent gaps of each recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators.intervals import gaps, merged_periods
from corpusmill.session import table


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Gaps between the speech intervals of each recording."""
    return gaps(table(spark, root, "speech_window"), ["year", "day"])


def p3_periods(spark: SparkSession, root: str) -> DataFrame:
    """Continuous speech periods of each recording."""
    return merged_periods(table(spark, root, "speech_window"), ["year", "day"])


_ROWS = """WITH w AS (
  SELECT DISTINCT year, day, CAST(round(start * 1000) AS BIGINT) AS s, CAST(round("end" * 1000) AS BIGINT) AS e
  FROM speech_window WHERE start IS NOT NULL AND "end" IS NOT NULL
), r AS (
  SELECT *, max(e) OVER (PARTITION BY year, day ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM w WHERE e > s
)"""

QUERIES = {"p3_found": p3_found, "p3_periods": p3_periods}
SQL = {
    "p3_found": _ROWS + " SELECT year, day, reach AS gap_start_ms, s AS gap_end_ms FROM r WHERE s > reach",
    "p3_periods": _ROWS
    + """, l AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY year, day ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT year, day, min(s) AS period_start_ms, max(e) AS period_end_ms FROM l GROUP BY year, day, island""",
}
