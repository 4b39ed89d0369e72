import random

from corpusmill.llm.leaks import leaks
from corpusmill.llm.wording import words_of

DOCS, ITEMS = "doc_id bigint, text string, id bigint, print string", "item_id bigint, text string, item string"


def brute(docs, items, span=12):
    out = {}
    for d, text in docs:
        a = words_of(text)
        for i, passage in items:
            b, best = words_of(passage), 0
            for x in range(len(a)):
                for y in range(len(b)):
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                        n += 1
                    best = max(best, n)
            if best >= span:
                out[d, i] = best
    return out


def test_against_brute_force(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)] + ["the"] * 20
    items = [(i, " ".join(r.choices(words, k=r.randrange(5, 40)))) for i in range(12)]
    docs = []
    for d in range(60):
        body = r.choices(words, k=r.randrange(0, 80))
        if d % 3 == 0:
            passage = r.choice(items)[1].split()
            at, n = r.randrange(len(passage)), r.randrange(8, 16)
            body[10:10] = passage[at : at + n]
        docs.append((d, " ".join(body)))
    # Runs of one word, at an edge and inside of other words.
    docs += [(99, "x " * 50), (98, "a " + "x " * 20 + "b c d"), (97, "x " * 11), (96, "q r " + "x " * 9 + "s t")]
    items += [(99, "x " * 30), (98, "e " + "x " * 15 + "b c"), (97, "r " + "x " * 9 + "s t u")]
    df = spark.createDataFrame([(d, t, 1, "p") for d, t in docs] + [(0, docs[0][1], 1, "p")], DOCS)
    got = leaks(df, spark.createDataFrame([(i, t, "q") for i, t in items], ITEMS)).collect()
    assert {(r.doc_id, r.item_id): r.words for r in got} == brute(docs, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_layout_points_and_markup_do_not_matter(spark):
    words = "אלף בית גימל דלת הא וו זין חית טית יוד כף למד".split()
    item = " ".join(words)
    doc = "<p>" + ",&nbsp;".join(w[0] + "ָ" + w[1:] for w in words[:6]) + "\r\n[[page 7]]\n" + "​  ".join(words[6:]).upper() + "</p>"
    rows = [(1, doc, 0, ""), (2, " ".join(words[:11]), 0, ""), (3, None, 0, ""), (4, "", 0, ""), (None, item, 0, "")]
    got = leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(5, item, ""), (6, None, ""), (None, item, "")], ITEMS)).collect()
    assert [(r.doc_id, r.item_id, r.words) for r in got] == [(1, 5, 12)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert leaks(empty, spark.createDataFrame([(1, "a " * 20, "")], ITEMS)).count() == 0
    assert leaks(spark.createDataFrame([(1, "a " * 20, 1, "")], DOCS), spark.createDataFrame([], ITEMS)).count() == 0


def test_very_long_texts(spark):
    passage = " ".join(f"p{i}" for i in range(14))
    rows = [(1, "x " * 150_000 + passage + " y" * 1000, 0, ""), (2, " ".join(f"w{i}" for i in range(100_000)), 0, "")]
    got = leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, passage, ""), (2, "x " * 40, "")], ITEMS)).collect()
    assert {(r.doc_id, r.item_id, r.words) for r in got} == {(1, 1, 14), (1, 2, 40)}
