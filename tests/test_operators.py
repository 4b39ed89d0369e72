import random

import numpy as np
from pyspark.sql import functions as F

from corpusmill.operators import alignment, glyphs
from corpusmill.operators.alignment import anchors, best_pairing, forward_matches, fuzzy
from corpusmill.operators.relations import both_ways, earliest, latest, shard, upsert
from corpusmill.operators.segments import best_cut_chunks, bounded_merge, chunk_labels, cluster, interpolated


def merged(rows, max_span, max_gap):
    out = []
    for s, e in sorted(r for r in rows if r[1] > r[0]):
        if out and e - out[-1][0] <= max_span and s - out[-1][1] < max_gap:
            out[-1] = (out[-1][0], e, out[-1][2] + 1)
        else:
            out.append((s, e, 1))
    return out


def test_bounded_merge(spark):
    r = random.Random(5)
    rows = [(k, s := r.randrange(100_000), s + r.randrange(-500, 9_000), i) for k in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint, i int")
    got = bounded_merge(df, ["k"], "s", "e", ["i"], 28_000, 2_000).collect()
    for key in "ab":
        assert sorted((x.chunk_start, x.chunk_end, x.n) for x in got if x.k == key) == sorted(merged([(s, e) for k, s, e, _ in rows if k == key], 28_000, 2_000))
        assert all(x.chunk_end - x.chunk_start <= 28_000 or x.n == 1 for x in got)


def test_merge_limits_are_inclusive_for_span_and_strict_for_gap(spark):
    df = spark.createDataFrame([("a", 0, 1000, 1), ("a", 3000, 4000, 2), ("a", 5999, 28_000 + 3000 - 0, 3)], "k string, s bigint, e bigint, i int")
    got = bounded_merge(df, ["k"], "s", "e", ["i"], 28_000, 2_000).collect()
    assert sorted((x.chunk_start, x.chunk_end) for x in got) == [(0, 1000), (3000, 31_000)]


def test_cluster_and_interpolation(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("a", 6.0, 3)], "k string, y double, i int")
    assert [r.cluster for r in cluster(df, ["k"], "y", 2.5, ["i"]).orderBy("i").collect()] == [0, 0, 1]
    df = spark.createDataFrame([("a", 1, 0.0, 1), ("a", 2, None, 1), ("a", 3, None, 1), ("a", 4, 9.0, 1)], "k string, place int, t double, w int")
    assert [r.time_between for r in interpolated(df, ["k"], "place", "t", "w").orderBy("place").collect()] == [0.0, 3.0, 6.0, 9.0]


def test_best_cut_prefers_the_later_of_equal_scores():
    starts, ends = np.arange(10.0), np.arange(10.0) + 1
    scores = np.array([0, 2, 0, 2, 0, 0, 0, 0, 0, 0.0])
    assert best_cut_chunks(starts, ends, scores, 5.0)[0] == (0, 4)
    assert best_cut_chunks(starts[:3], ends[:3], scores[:3], 5.0) == [(0, 3)]


def test_relations(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, None, "c")], "k int, t int, v string")
    assert {(r.k, r.v) for r in latest(df, ["k"], [F.col("t")]).collect()} == {(1, "b"), (2, "c")}
    assert {(r.k, r.v) for r in earliest(df, ["k"], [F.col("t")]).collect()} == {(1, "a"), (2, "c")}
    new = spark.createDataFrame([(2, 9, "d"), (3, 1, "e")], df.schema)
    assert {(r.k, r.v) for r in upsert(df, new, ["k"]).collect()} == {(1, "a"), (1, "b"), (2, "d"), (3, "e")}
    assert {(r.k, r.side) for r in both_ways(df, new, ["k"]).collect()} == {(1, "left"), (2, "both"), (3, "right")}
    parts = [shard(spark.range(10), ["id"], i, 3).collect() for i in range(3)]
    assert sorted(r.id for p in parts for r in p) == list(range(10))


def test_alignment():
    assert anchors(list("abcd"), list("bcx")) == [(1, 0, 1.0), (2, 1, 1.0)]
    got = fuzzy(["aa", "hello", "zz"], ["aa", "helo", "zz"])
    assert [(i, j) for i, j, _ in got] == [(0, 0), (1, 1), (2, 2)]
    assert [(i, j) for i, j, _ in fuzzy(["hello"], ["xyz"])] == []


def test_glyph_rows_and_tokens(spark):
    rows = [(1, 10.0, 90.0, 95.0, "a", "f"), (1, 10.5, 85.0, 90.0, "b", "f"), (1, 10.0, 80.0, 84.0, " ", "f"), (1, 10.0, 75.0, 80.0, "c", "f"), (1, 20.0, 90.0, 95.0, "d", "f")]
    df = spark.createDataFrame(rows, "page int, y double, x0 double, x1 double, code string, font string")
    tokens = glyphs.row_tokens(glyphs.baseline_rows(df, ["page"]), ["page"])
    assert [(r.row, r.codes) for r in tokens.orderBy("row", "token").collect()] == [(0, ["a", "b"]), (0, ["c"]), (1, ["d"])]
    font = spark.createDataFrame([("f", "a", "א"), ("f", "b", "ב")], "font string, code string, letter string")
    assert sorted(r.text for r in glyphs.decoded_tokens(tokens, font).collect()) == ["c", "d", "אב"]


def test_solver_finds_a_substitution():
    r = random.Random(1)
    letters = "אבגדהוזחטי"
    known = {"".join(r.choice(letters) for _ in range(r.randrange(2, 7))): r.randrange(1, 50) for _ in range(300)}
    codes = dict(zip(letters, r.sample("0123456789", 10), strict=True))
    words = [tuple(codes[c] for c in w) for w in r.choices(list(known), k=800)]
    found = glyphs.solve(words, known)
    assert sum(found[v] == k for k, v in codes.items()) >= 9


def test_patching_stays_one_to_one():
    assert glyphs.patched({"1": "a", "2": "b"}, "1", "b") == {"1": "b", "2": "a"}
    assert glyphs.patched({"2": "b"}, "1", "b") == {"1": "b"}
    assert glyphs.patched({"1": "a"}, "1", "c") == {"1": "c"}


def test_crib_pins_prefix_and_a_single_name():
    spell = lambda w: tuple(dict(zip("abcdefgh", "12345678", strict=True))[x] for x in w)
    assert glyphs.crib([[spell("ab"), spell("cad")]], ["ab"], ["cad", "ced"], {}) == {"1": "a", "2": "b", "3": "c", "4": "d"}
    assert glyphs.crib([[spell("ab"), spell("cef")]], ["ab"], ["ced", "gfh"], {}) == {"1": "a", "2": "b"}
    assert glyphs.crib([[spell("aa")]], ["ab"], [], {}) == {}


def test_climbing_from_a_bad_start_and_fonts(spark):
    r = random.Random(4)
    letters = "אבגדהוזחטיכל"
    known = {"".join(r.choice(letters) for _ in range(r.randrange(3, 8))): r.randrange(2, 50) for _ in range(400)}
    codes = dict(zip(letters, r.sample("0123456789xy", 12), strict=True))
    words = [tuple(codes[c] for c in w) for w in r.choices(list(known), k=700)]
    start = dict(zip(codes.values(), r.sample(letters, 12), strict=True))
    climb = glyphs.Climb(glyphs.Counter(words), known)
    assert climb.height(climb.up(start, {}, letters)) >= climb.height(start)
    found = glyphs.solve(words, known)
    assert sum(found[v] == k for k, v in codes.items()) >= 11
    tokens = spark.createDataFrame([("f", list(w)) for w in words] + [("small", ["1", "2"])], "font string, codes array<string>")
    got = glyphs.solved_fonts(tokens, spark.createDataFrame(list(known.items()), "word string, n int")).collect()
    assert {x.font for x in got} == {"f"} and all(x.known_share > 0.9 for x in got)


def test_pairing_is_the_best_one():
    r = random.Random(6)

    def most(alike):
        total = np.zeros((alike.shape[0] + 1, alike.shape[1] + 1))
        for i in range(alike.shape[0]):
            for j in range(alike.shape[1]):
                total[i + 1, j + 1] = max(total[i, j + 1], total[i + 1, j], total[i, j] + alike[i, j] if alike[i, j] > 0 else 0)
        return total[-1, -1]

    for _ in range(100):
        wide = r.randrange(1, 7)
        alike = np.array([[r.choice([0, 0, 0.75, 0.8, 1.0]) for _ in range(wide)] for _ in range(r.randrange(1, 7))])
        pairs = best_pairing(alike)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        assert abs(sum(alike[i, j] for i, j in pairs) - most(alike)) < 1e-9 and all(alike[i, j] > 0 for i, j in pairs)


def test_ties_leave_out_reference_words_from_the_end():
    assert best_pairing(np.array([[1.0], [1.0]])) == [(0, 0)]
    assert best_pairing(np.array([[1.0, 1.0]])) == [(0, 0)]


def test_segments_are_sought_forward(spark):
    tokens = spark.createDataFrame([(1, i, w) for i, w in enumerate("a b c a b d".split())], "k int, place int, norm string")
    said = spark.createDataFrame([(1, 0, ["b"]), (1, 1, ["a", "b"]), (1, 2, ["c"]), (1, 3, []), (1, 4, ["d"])], "k int, place int, words array<string>")
    assert sorted(tuple(r) for r in forward_matches(tokens, said, ["k"]).collect()) == [(1, 0, 1, 1), (1, 1, 3, 4), (1, 4, 5, 5)]
    assert sorted(r.place for r in forward_matches(tokens, said, ["k"], 2).collect()) == [0, 1, 4]


def test_one_entity_of_a_million_segments(spark):
    rows = spark.range(1_000_000).select(F.lit("a").alias("k"), (F.col("id") * 100).alias("s"), (F.col("id") * 100 + 90).alias("e"))
    got = bounded_merge(rows, ["k"], "s", "e", [], 1_000_000, None)
    assert got.agg(F.count("*"), F.sum("n"), F.max("n")).first()[:] == (100, 1_000_000, 10_000)
    gaps = rows.where("s % 100000 <> 0")
    assert bounded_merge(gaps, ["k"], "s", "e", [], 10_000_000, 50).agg(F.count("*"), F.sum("n")).first()[:] == (1000, 999_000)


def test_labels_part_rows_as_chunks_do(spark):
    r = random.Random(8)
    rows = [(k, s := r.randrange(60_000), s + r.randrange(-500, 9_000), i) for k in "ab" for i in range(80)]
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint, i int")
    for gap in (2_000, None):
        got = chunk_labels(df, ["k"], "s", "e", ["i"], 28_000, gap).groupBy("k", "chunk").agg(F.min("s"), F.max_by("e", F.struct("s", "e", "i")), F.count("*")).drop("chunk").collect()
        want = bounded_merge(df, ["k"], "s", "e", ["i"], 28_000, gap).collect()
        assert sorted(tuple(x) for x in got) == sorted(tuple(x) for x in want)


def test_gaps_of_any_size_are_matched(monkeypatch):
    r = random.Random(3)
    ref = ["".join(r.choice("אבגדהוזחטיכל") for _ in range(r.randrange(5, 9))) for _ in range(300)]
    hyp = [w[:-1] + "ש" for w in ref]
    assert [(i, j) for i, j, _ in fuzzy(ref, hyp)] == [(i, i) for i in range(300)]
    few = [r.choice(ref[:9]) for _ in range(70)]
    other = [w[:-1] + "ש" for w in few if r.random() < 0.8]
    whole = fuzzy(few, other)
    monkeypatch.setattr(alignment, "HELD", 50)
    assert fuzzy(few, other) == whole and fuzzy(ref, hyp) == [(i, i, 2 * (len(w) - 1) / (2 * len(w))) for i, w in enumerate(ref)]
