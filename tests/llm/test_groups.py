import random

from pyspark.sql import functions as F

from corpusmill.functions.dates import calendar_date
from corpusmill.llm.grouped_splits import assigned, components, torn
from corpusmill.llm.near_texts import similar_groups, similar_pairs

SCHEMA = "id string, year int, day string, source_date string, split string, _node string"


def links():
    return {"day": F.concat(F.col("year").cast("string"), F.lit("/"), F.col("day")), "date": calendar_date(F.col("source_date")).cast("string")}


def find(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    return {x: root(x) for x in list(parent)}


def same(found, truth):
    assert found.keys() == truth.keys()
    assert len(set(zip((found[k] for k in sorted(found)), (truth[k] for k in sorted(found))))) == len(set(found.values())) == len(set(truth.values()))


def test_components(spark):
    r = random.Random(6)
    pairs = [(f"n{r.randrange(150)}", f"n{r.randrange(150)}") for _ in range(110)]
    pairs += [(f"c{i}", f"c{i + 1}") for i in range(60)] + [("hub", f"h{i}") for i in range(200)] + [("x", "x"), ("p", "q"), ("q", "p")]
    df = spark.createDataFrame([*pairs, ("lost", None), (None, None)], "src string, dst string")
    same({r.node: r.component for r in components(df).collect()}, find(pairs))
    assert components(df.limit(0)).count() == 0


def test_components_of_one_task_and_of_many_are_the_same(spark):
    r = random.Random(7)
    pairs = [(f"n{r.randrange(400)}", f"n{r.randrange(400)}") for _ in range(300)] + [(f"c{i}", f"c{i + 1}") for i in range(90)] + [("x", "x"), ("p", "q"), ("q", "p")]
    df = spark.createDataFrame([*pairs, ("lost", None)], "src string, dst string").repartition(5)
    truth, tracker = find(pairs), spark.sparkContext.statusTracker()
    jobs = []
    for most in (1000, 40, 0):
        spark.sparkContext.setJobGroup(f"components{most}", "")
        same({x.node: x.component for x in components(df, most).collect()}, truth)
        jobs.append(len(tracker.getJobIdsForGroup(f"components{most}")))
    assert jobs[0] < 8 < jobs[1]


def clips():
    return [
        ("1", 1, "a", "1964-08-14", "train", ""), ("2", 1, "b", "14 Aug 1964", "dev", ""), ("3", 1, "c", "", "train", ""), ("4", 1, "c", None, "train", ""), ("5", 2, "a", "bad", "test", ""),
        ("6", 1, "d", "1970-01-01", None, ""), ("7", None, "e", "1970-01-01", "dev", ""), ("8", 1, "d", None, "train", ""), ("9", None, None, None, "dev", ""), ("1", 1, "a", "1964-08-14", "train", ""),
    ]


def test_torn(spark):
    df = spark.createDataFrame(clips(), SCHEMA)
    got = {tuple(r) for r in torn(df, links(), "id", "split", ["year", "day"]).collect()}
    assert got == {(1, "a"), (1, "b"), (1, "d")}
    assert torn(df.limit(0), links(), "id", "split", ["year", "day"]).count() == 0


def test_assigned(spark):
    r = random.Random(2)
    rows = [(str(i), r.randrange(3), f"d{r.randrange(200)}", None, "", "") for i in range(3000)] + [(f"big{i}", 9, "hot", None, "", "") for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    quota = {"train": 0.8, "dev": 0.08, "test": 0.08, "test_b": 0.04}
    got = {x.id: x.split for x in assigned(df, links(), "id", quota).collect()}
    assert len(got) == len(rows)
    by_day = {}
    for i, y, d, *_ in rows:
        by_day.setdefault((y, d), set()).add(got[i])
    assert all(len(s) == 1 for s in by_day.values())
    for name, share in quota.items():
        assert abs(sum(v == name for v in got.values()) / len(rows) - share) < 0.02
    assert assigned(df.limit(0), links(), "id", quota).count() == 0


def test_similar_bodies(spark):
    import re

    r = random.Random(8)
    words = ["".join(r.choice("אבגדהוזחטיכל") for _ in range(r.randrange(2, 7))) for _ in range(900)]
    rows = []
    for i in range(60):
        body = r.choices(words, k=80) + ["און", "די"] * 5
        rows.append((2 * i, " ".join(body), 1))
        swapped = [r.choice(words) if r.random() < 0.1 else w for w in body]
        r.shuffle(swapped)
        rows.append((2 * i + 1, ", ".join(swapped), 1))
    rows += [(500, rows[0][1] + ".", 1), (501, None, 1), (502, "", 1), (503, "abc 1", 1), (None, rows[0][1], 1), (0, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "k int, body string, rep int")
    sets = {k: set(re.findall("[א-ת]+", b)) for k, b, _ in rows if k is not None and b}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    got = similar_pairs(df, "k", "body").collect()
    assert {(x.k_a, x.k_b) for x in got} == want and len(got) == len(want)
    groups = {x.k: x for x in similar_groups(df, "k", "body").collect()}
    assert groups[500].rep == groups[0].rep == 0 and groups[0].links >= 1 and set(groups) == {k for k in sets if sets[k]}
    assert similar_pairs(df.limit(0), "k", "body").count() == 0
