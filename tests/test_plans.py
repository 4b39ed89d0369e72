"""Every core query runs over the smallest tables, and gives what its SQL gives; plans keep their shape."""

import os

import pytest

import __spark_entry__ as entry
from corpusmill.functions.edits import align_words
from corpusmill.plans import clips, files, intervals, measures, records, scripts

ROOT = "/root/testdata/sf0.001"
MODULES = (intervals, clips, measures, records, scripts, files)
NAMES = [(m, n) for m in MODULES for n in m.QUERIES]
pytestmark = pytest.mark.skipif(not os.path.exists(ROOT), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(ROOT):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{ROOT}/{file}'")
    return con


def plain(value):
    if value is None or value != value:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.9g}"
    return str(value)


@pytest.mark.parametrize(("module", "name"), NAMES, ids=[n for _, n in NAMES])
def test_query(spark, duck, module, name):
    df = module.QUERIES[name](spark, ROOT)
    rows = [r.asDict() for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name not in module.SQL:
        return
    got = duck.sql(module.SQL[name])
    names = sorted(df.columns)
    assert sorted(got.columns) == names
    other = [dict(zip(got.columns, r, strict=True)) for r in got.fetchall()]
    assert sorted(tuple(plain(r[n]) for n in names) for r in rows) == sorted(tuple(plain(r[n]) for n in names) for r in other)


def test_whole_days_have_every_word(spark, tmp_path):
    long = [" ".join("אבגדהוז"[(i * k) % 7] * (1 + i % 9) for i in range(150)) for k in (1, 3)]
    rows = [(f"1/d/{k:03}", 1, "d", "train", 1.0, t) for k, t in enumerate(long)]
    spark.createDataFrame(rows, "id string, year int, day string, split string, duration double, text string").write.parquet(f"{tmp_path}/manifest.parquet")
    got = measures.whole_day_wer(spark, str(tmp_path)).collect()
    parts = clips.scored(spark, str(tmp_path)).orderBy("id").collect()
    ref, hyp = ([w for p in parts for w in p[c]] for c in ("ref_words", "hyp_words"))
    assert len(ref) == 300 and [(r.ref_words, r.hyp_words, r.edits) for r in got] == [(300, len(hyp), sum(x[0] != "equal" for x in align_words(ref, hyp)))]


def test_names_are_distinct_and_described():
    seen = [n for _, n in NAMES]
    assert len(seen) == len(set(seen))
    assert set(seen) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert all(m.QUERIES[n].__doc__ for m, n in NAMES)


def test_plans(spark):
    plan = lambda name: entry.queries()[name](spark, ROOT)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan("measured_shift") and "BroadcastNestedLoopJoin" not in plan("p3_found")
    assert "PushedFilters: [IsNotNull(start), IsNotNull(vad_mode)]" in plan("vad_runs")
    assert "ReadSchema: struct<year:int,day:string,split:string>" in plan("split_by_list")


def test_clips_are_counted_without_a_group_of_tokens_each(spark, tmp_path):
    rows = [("1/d/1", "אב גד הו", "אב גד הו"), ("1/d/2", "אבגדה הו", "אבגדז הו זח"), ("1/d/3", "אב", ""), ("1/d/4", "", "אב"), ("1/d/5", None, "אב"), ("1/d/6", "אב גד", "אב הו"), ("1/d/6", "הו", "זח")]
    spark.createDataFrame([rows[0], *rows], "id string, text string, text_raw string").write.parquet(f"{tmp_path}/manifest.parquet")
    df = scripts.alignment_counts(spark, str(tmp_path))
    assert sorted(tuple(r[c] for c in ("id", "n_ref", "n_hyp", "matched", "unmatched")) for r in df.collect()) == [("1/d/1", 3, 3, 3, 0), ("1/d/2", 2, 3, 2, 0), ("1/d/3", 1, 0, 0, 1), ("1/d/6", 3, 3, 2, 1)]
    assert "CoGroups" not in df._jdf.queryExecution().optimizedPlan().toString()
