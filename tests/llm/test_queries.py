"""The registered queries over the smallest tables, against their SQL where there is one."""

import os

import pytest

from corpusmill.llm.queries import QUERIES, SQL

ROOT = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": {"id_a": "string", "id_b": "string"},
    "p2_found": {"pdf_id": "bigint", "line_no": "int", "kind": "string"},
    "p4_found": {"pdf_id_a": "bigint", "pdf_id_b": "bigint"},
    "p5_found": {"year": "int", "day": "string"},
    "p6_found": {"seg_id_a": "bigint", "seg_id_b": "bigint"},
    "p7_found": {"seg_id": "bigint"},
    "p8_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p9_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p10_found": {"doc_id": "bigint", "grade": "int"},
}
pytestmark = pytest.mark.skipif(not os.path.exists(ROOT), reason="no test tables")


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, ROOT)
    rows = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
        assert len({str(r) for r in rows}) == len(rows)
    if name in SQL:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for file in os.listdir(ROOT):
            con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{ROOT}/{file}'")
        got = con.sql(SQL[name])
        order = [got.columns.index(c) for c in df.columns]
        assert sorted(rows) == sorted(tuple(r[i] for i in order) for r in got.fetchall())


def test_shares_and_whole_groups(spark):
    clips = spark.read.parquet(f"{ROOT}/manifest.parquet").select("id", "year", "day").distinct().join(QUERIES["p5_assigned"](spark, ROOT), "id")
    assert clips.count() == spark.read.parquet(f"{ROOT}/manifest.parquet").select("id").distinct().count()
    assert clips.groupBy("year", "day").agg({"split": "min", "id": "count"}).count() == clips.select("year", "day", "split").distinct().count()
