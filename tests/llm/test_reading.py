import random

from corpusmill.llm.reading import reading_levels

DOCS, LABELS = "doc_id bigint, text string, grade string, word string", "doc_id bigint, grade int, rater string"


def corpus(n, seed=1):
    r = random.Random(seed)
    words = {g: [f"g{g}w{i}" for i in range(200)] for g in range(1, 5)}
    docs = []
    for d in range(n):
        g = 1 + d % 4
        docs.append((d, " ".join(r.choice(words[min(4, max(1, g + r.choice([-1, 0, 0, 0, 1])))]) for _ in range(80)), g))
    return docs


def test_held_out_accuracy(spark):
    docs = corpus(400)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t, _ in docs] + [(1000, "short", "", ""), (1001, None, "", ""), (1002, "", "", ""), (1003, "zz " * 50, "", "")], DOCS)
    labels = spark.createDataFrame([(d, g, "a") for d, _, g in docs if d % 5] + [(1, 3, "b"), (6, None, "b"), (7, 9, "b"), (1001, 2, "a"), (77777, 1, "a")], LABELS)
    got = {r.doc_id: r.grade for r in reading_levels(df, labels).collect()}
    assert set(got) == {d for d, _, _ in docs} | {1003}
    held = [(d, g) for d, _, g in docs if d % 5 == 0]
    assert sum(got[d] == g for d, g in held) >= 0.9 * len(held)


def test_no_labels_and_empty_tables(spark):
    df = spark.createDataFrame([(d, t, "", "") for d, t, _ in corpus(8)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert reading_levels(df, none).count() == 0
    assert reading_levels(df.limit(0), none).count() == 0
    assert reading_levels(df.limit(0), spark.createDataFrame([(1, 2, "a")], LABELS)).count() == 0
    assert reading_levels(df, spark.createDataFrame([(0, 1, "a"), (1, 1, "a")], LABELS)).count() == 8
