import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corpusmill.operators.intervals import gaps, islands, merged_periods

SCHEMA = "who string, start double, end double, n int"


def brute(rows):
    by = {}
    for who, s, e, *_ in rows:
        if s is None or e is None or s != s or e != e or round(e * 1000) <= round(s * 1000):
            continue
        by.setdefault(who, []).append((round(s * 1000), round(e * 1000)))
    periods = set()
    for who, spans in by.items():
        spans.sort()
        low, high = spans[0]
        for s, e in spans[1:]:
            if s > high:
                periods.add((who, low, high))
                low, high = s, e
            else:
                high = max(high, e)
        periods.add((who, low, high))
    return periods


def test_overlap_nest_touch_gap(spark):
    rows = [("a", 0.0, 2.0, 1), ("a", 1.0, 1.5, 2), ("a", 2.0, 3.0, 3), ("a", 3.001, 4.0, 4), ("b", 70.0, 71.0, 5), ("b", 200.0, 300.0, 6), ("b", 250.0, 260.0, 7), (None, 1.0, 2.0, 8)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in merged_periods(df, ["who"]).collect()}
    assert got == brute(rows)
    assert {tuple(r) for r in gaps(df, ["who"]).collect()} == {("a", 3000, 3001), ("b", 71000, 200000)}


def test_bad_rows_and_empty_tables(spark):
    rows = [("a", None, 2.0, 1), ("a", 5.0, None, 2), ("a", 3.0, 3.0, 3), ("a", 4.0, 3.0, 4), ("a", float("nan"), 3.0, 5), ("a", float("inf"), 3.0, 6), ("a", 1.0, 1.0002, 7)]
    assert islands(spark.createDataFrame(rows, SCHEMA), ["who"]).count() == 0
    assert gaps(spark.createDataFrame([], SCHEMA), ["who"]).count() == 0


def test_clashing_column_names_and_repeats(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0, 1, 2), ("a", 0.0, 1.0, 1, 2), ("a", 2.0, 3.0, 1, 2)], "who string, start double, end double, _s int, _slice int")
    assert [tuple(r) for r in gaps(df, ["who"]).collect()] == [("a", 1000, 2000)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("ab"), s := round(r.uniform(-100, 500), 3), round(s + r.choice([-1, 0, 0.001, 5, 90]), 3), i) for i in range(r.randrange(40))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(x) for x in merged_periods(df, ["who"]).collect()} == brute(rows)
