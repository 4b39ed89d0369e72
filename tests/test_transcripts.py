from pyspark.sql import functions as F

from corpusmill.functions.registry import register
from corpusmill.operators import transcripts as t

SEGMENT = "k string, start double, end double, text string, avg_logprob double, no_speech_prob double"


def segments(spark):
    return spark.createDataFrame([("a", 0.0, 2.0, "x y", -0.1, 0.1), ("a", 3.0, 4.0, "z", -0.5, 0.1), ("a", 9.0, 10.0, "late", -0.2, 0.1), ("a", 11.0, 12.0, "bad", -2.0, 0.1), ("a", 12.0, 13.0, " ", -0.1, 0.1)], SEGMENT)


def test_gates_and_merging(spark):
    assert t.sure_segments(segments(spark)).count() == 3
    assert sorted(tuple(r) for r in t.merged_texts(segments(spark), ["k"]).collect()) == [("a", 0, 4000, "x y z", -0.5, 2), ("a", 9000, 10000, "late", -0.2, 1)]
    assert t.low_scores(segments(spark), ["k"]).first()[:] == ("a", 5, 1)
    windows = spark.createDataFrame([(True, -0.1, "a b c", 0.0, 1.0), (True, -0.5, "a b c", 0.0, 1.0), (True, -0.1, "a", 0.0, 5.0), (False, -9.0, "a", 0.0, 5.0), (None, -9.0, "a", 0.0, 5.0)], "added boolean, logprob double, text string, start double, end double")
    assert t.kept_windows(windows).count() == 3


def test_times(spark):
    assert t.after_head(segments(spark), F.lit(1.0), F.lit(0.0)).count() == 3
    assert t.time_slice(segments(spark), 3.5, 6.0).count() == 2
    assert [r.silence for r in t.with_intervals_before(segments(spark), ["k"]).orderBy("start").collect()] == [None, 1.0, 5.0, 1.0, 0.0]


def test_fallback(spark):
    rows = [("a", "vad", 0.0, 10.0, 600.0), ("a", "low", 0.0, 300.0, 600.0), ("b", "vad", 0.0, 10.0, 60.0), ("b", "low", 0.0, 60.0, 60.0), ("c", "vad", 0.0, 1.0, 600.0)]
    got = {(r.k, r.detector) for r in t.window_fallback(spark.createDataFrame(rows, "k string, detector string, start double, end double, seconds double"), ["k"], ["vad", "low", "fixed"]).collect()}
    assert got == {("a", "low"), ("b", "vad"), ("c", "vad")}


def test_pages_and_words(spark):
    page = spark.range(1).select(t.synopses(F.lit("Sicha 1 on x (14 min)\nMaamar (7:30 min)"), r"(?i)(sicha \d|maamar)[^(\n]*\(([\d:]+) min").alias("s")).first().s
    assert [tuple(x) for x in page] == [("Sicha 1", "14"), ("Maamar", "7:30")]
    lines = spark.createDataFrame([(1, 1, "H"), (1, 2, None), (1, 3, "B"), (1, 4, None)], "d int, n int, t string")
    assert [r.phase for r in t.phases(lines, ["d"], "n", F.col("t")).orderBy("n").collect()] == ["H", "H", "B", "B"]
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    assert {tuple(r) for r in t.one_letter_off(words("abx"), words("abc", "abd", "zbx")).collect()} == {("abx", 3, "c", 0.5), ("abx", 3, "d", 0.5), ("abx", 1, "z", 1.0)}


def test_sql_functions(spark):
    assert "is_repetitive" in register(spark)
    assert spark.sql("select is_repetitive('a a a a', 9.0D) r").first().r is True
