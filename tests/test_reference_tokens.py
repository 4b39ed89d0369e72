import pytest
from pyspark.sql import functions as F

from corpusmill.operators.relations import numbered, shard
from corpusmill.operators.tokens import reference_tokens, token_times
from corpusmill.plans.clips import guarded, required
from corpusmill.plans.scripts import days_chosen
from corpusmill.session import checkpoint_folder


def tokens_of(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc string, para int, text string, token int")
    return [tuple(r) for r in reference_tokens(df, ["doc"], "para", "text", **more).drop("doc").orderBy("token").collect()]


def test_tokens_have_separators_glue_and_flags(spark):
    got = tokens_of(spark, [("d", 0, "— אב־גד, [הו] \" ווז.", 9), ("d", 1, "! זח", 9), ("d", 2, None, 9), ("d", 3, "", 9)])
    assert [g[1:4] for g in got] == [("אב", " ", "אב"), ("גד,", "־", "גד"), ('[הו]"', " ", "הו"), ("ווז.!", " ", "ווז"), ("זח", " ", "זח")]
    assert [g[5:] for g in got] == [(False, False, False), (False, True, False), (False, False, False), (True, False, True), (False, False, True)]
    assert [g[4] for g in got] == [0, 0, 0, 0, 1] and [g[0] for g in got] == list(range(5))
    assert [g[1] for g in tokens_of(spark, [("d", 0, "א [ב ג] ד", 9)], keep_brackets=False)] == ["א", "ד"]
    assert tokens_of(spark, [("d", 0, "\" — .", 9)]) == [] and tokens_of(spark, []) == []


def test_times_run_at_a_pace_before_and_after(spark):
    rows = [("a", i, None, None, 2) for i in range(3)] + [("a", 3, 10.0, 11.0, 2), ("a", 4, None, None, 1), ("a", 5, None, None, 3), ("a", 6, 15.0, 16.0, 2), ("a", 7, None, None, 2), ("b", 0, None, None, 1)]
    df = spark.createDataFrame(rows, "k string, place int, s double, e double, w int")
    got = {(r.k, r.place): (r.token_start, r.token_end) for r in token_times(df, ["k"], "place", "s", "e", "w", F.lit(0.0), F.lit(16.2), pace=1.0).collect()}
    assert got["a", 0] == (7.0, 8.0) and got["a", 2] == (9.0, 10.0) and got["a", 3] == (10.0, 11.0)
    assert got["a", 4] == (11.0, 12.0) and got["a", 5] == (12.0, 15.0)
    assert got["a", 7] == pytest.approx((16.0, 16.2)) and got["b", 0] == (None, None)
    clipped = {r.place: r.token_start for r in token_times(df.where("k = 'a'"), ["k"], "place", "s", "e", "w", F.lit(9.4), F.lit(99.0), pace=1.0).collect()}
    assert clipped[0] == pytest.approx(9.4)


def test_guard(spark):
    years = spark.createDataFrame([("1", 100, 30), ("2", 50, 40)], "year string, clips long, dropped long")
    assert guarded(years, 50, 99, 0.25).first()[:] == (80, 1, False)
    assert required(guarded(years, 50, 100, 0.25)).first()[:] == (80, 0, True)
    with pytest.raises(Exception, match="launch guard"):
        required(guarded(years, 90, 100, 0.25)).collect()
    assert guarded(years.limit(0), 1, 1, 0.1).first()[:] == (0, 0, False)


def test_days_by_conditions(spark):
    rows = [(1, "a", "x", None, None, None), (1, "b", "x", 2.0, True, None), (2, "a", "y", 2.0, False, 1.0), (2, "c", "y", None, None, 1.0)]
    df = spark.createDataFrame(rows, "year int, day string, month_dir string, site_shift_seconds double, sync_untrusted boolean, local_offset_seconds double")
    days = lambda **x: sorted((r.year, r.day) for r in days_chosen(df, **x).collect())
    assert days(names=["a"], years=[2]) == [(2, "a")] and days(months=["x"]) == [(1, "a"), (1, "b")]
    assert days(missing_only=True) == [(1, "a"), (1, "b"), (2, "c")] and days(site_timed=True) == [(1, "b"), (2, "a")]
    assert days(missing_only=True, force=False) == [(1, "a"), (1, "b")] and days(names=["c"], force=False) == [(2, "c")]


def test_numbering_of_a_whole_table(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), F.lit("a").alias("_part"))
    got = numbered(df.repartition(5), ["x"]).orderBy("x").collect()
    assert [r["_nth"] for r in got] == list(range(5000)) and got[0]["_part"] == "a"
    assert [r.x for r in shard(df.select("x"), ["x"], 2, 1000).orderBy("x").collect()] == [2, 1002, 2002, 3002, 4002]
    assert numbered(df.limit(0), ["x"]).count() == 0


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(RuntimeError, match="share"):
        checkpoint_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d)))
