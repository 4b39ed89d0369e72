import random

import pytest

from corpusmill.llm.pieces import cut_files, cut_oversized

SCHEMA = "seg_id bigint, yiddish string, start double, end double, row string, size int"


def pieces(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return cut_oversized(df, "seg_id", "yiddish", "start", "end", 600, 28.0, 8, **more)


def text_of(r, n):
    return "".join(r.choice(["אבג", "ד", "הוזחטי"]) + r.choice([" ", ". ", ", ", "\n", " "]) for _ in range(n))


@pytest.mark.parametrize("size", [1 << 16, 700])
def test_pieces(spark, size):
    r = random.Random(3)
    texts = {1: text_of(r, 2000), 2: "א" * 5000, 3: text_of(r, 60), 4: "אָ" * 900, 5: " " * 700}
    rows = [(k, t, 0.0, 100.0 if k == 3 else None) for k, t in texts.items()]
    got = {}
    for x in pieces(spark, rows, range_size=size).orderBy("piece").collect():
        got.setdefault(x.seg_id, []).append(x)
    assert got.keys() == texts.keys()
    for k, xs in got.items():
        assert [x.piece for x in xs] == list(range(len(xs)))
        assert xs[0].begin == 0 and xs[-1].upto == len(texts[k])
        for a, b in zip(xs, xs[1:]):
            assert a.begin < b.begin <= a.upto < b.upto
            assert len(texts[k][b.begin : a.upto].split()) == b.shared_words
        assert all(x.text == texts[k][x.begin : x.upto] and len(x.text) <= 600 for x in xs)
    assert {x.shared_words for x in got[1][1:]} == {8}
    assert all(x.text[-1].isspace() for x in got[1][:-1])
    assert all(x.end_ms - x.start_ms <= 28_001 for x in got[3]) and got[3][-1].end_ms == 100_000
    assert not any(x.text.startswith("ָ") for x in got[4])


def test_ranges_do_not_change_cuts(spark):
    r = random.Random(5)
    rows = [(1, text_of(r, 3000), 0.0, 900.0)]
    one = pieces(spark, rows).orderBy("piece").collect()
    assert one == pieces(spark, rows, range_size=500).orderBy("piece").collect()


def test_cases(spark):
    rows = [(1, "קורץ", 0.0, 28.0), (2, None, 0.0, 60.0), (3, "", 5.0, 5.5), (4, "א ב", 9.0, 1.0), (5, "א" * 601, 9.0, 1.0), (6, "א ב", None, 99.0), (7, "קורץ", 0.0, 28.0004), (8, "קורץ", 0.0, 28.001), (2, None, 0.0, 60.0), (9, "אב", 0.0, 1000.0)]
    got = {}
    for x in pieces(spark, rows).orderBy("piece").collect():
        got.setdefault(x.seg_id, []).append(x)
    assert set(got) == {2, 5, 8, 9}
    assert [(x.text, x.start_ms, x.end_ms) for x in got[2]] == [("", 0, 20_000), ("", 20_000, 40_000), ("", 40_000, 60_000)]
    assert {(x.start_ms, x.end_ms) for x in got[5]} == {(None, None)}
    assert got[9][0].text == "אב" and len(got[9]) == 36
    assert pieces(spark, []).count() == 0


@pytest.mark.parametrize("size", [1 << 16, 333])
def test_files_are_read_in_ranges(spark, tmp_path, size):
    r = random.Random(7)
    texts = {"long.txt": text_of(r, 4000) + "é😀" * 50, "sh rt%20.txt": "אב גד", "empty.txt": "", "solid.txt": "אָ😀" * 1500}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    got = {}
    for x in cut_files(spark, str(tmp_path), 600, 8, range_size=size).orderBy("piece").collect():
        got.setdefault(x.path.rpartition("/")[2], []).append(x)
    assert got.keys() == {"long.txt", "sh rt%20.txt", "solid.txt"}
    for name, xs in got.items():
        assert [x.piece for x in xs] == list(range(len(xs)))
        assert xs[0].begin == 0 and xs[-1].upto == len(texts[name])
        assert all(x.text == texts[name][x.begin : x.upto] and len(x.text) <= 600 for x in xs)
        assert all(a.begin < b.begin <= a.upto < b.upto for a, b in zip(xs, xs[1:]))
    assert [x.text for x in got["sh rt%20.txt"]] == ["אב גד"]
    assert [(x.begin, x.upto) for x in got["long.txt"]] == [(x.begin, x.upto) for x in pieces(spark, [(1, texts["long.txt"], None, None)]).orderBy("piece").collect()]


def test_a_text_of_many_ranges(spark):
    text = "אבג ד. " * 200_000
    got = pieces(spark, [(1, text, None, None)]).select("begin", "upto").orderBy("begin").collect()
    assert len(got) > 3000 and got[0].begin == 0 and got[-1].upto == len(text) and all(a.begin < b.begin <= a.upto for a, b in zip(got, got[1:]))
