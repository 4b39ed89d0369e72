import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import overlap
from corpusmill.llm.overlap import Placed, chunks, counted, lacking, leaked, overlaps
from corpusmill.llm.wording import plain_of

SCHEMA = "id string, text string, split string, rec int, plain string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute(rows):
    texts = {(i, plain_of(t), s) for i, t, s in rows if i is not None and t and s}
    texts = [(i, t, s) for i, t, s in texts if len(t.split()) >= 6]
    return {(a, b): d for a, x, s in texts if s != "train" for b, y, u in texts if u == "train" if (d := distance(x, y)) * 100 <= 15 * max(len(x), len(y))}


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA)
    got = overlaps(df, "id", "text", F.col("split") != "train").collect()
    assert len(got) == len({(r.key_a, r.key_b) for r in got})
    assert all(0 <= r.overlap_a <= 1 and 0 <= r.overlap_b <= 1 for r in got)
    return {(r.key_a, r.key_b): r.edits for r in got}


def test_against_brute_force(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("אבגדהוזחטיכלמנ") for _ in range(r.randrange(2, 8))) for _ in range(300)]
    rows = []
    for i in range(80):
        text = " ".join(r.choices(vocabulary, k=r.randrange(8, 25)))
        rows.append((f"t{i}", text, "train"))
        if i % 2:
            edited = list(text)
            for _ in range(int(len(text) * r.choice([0, 0.02, 0.05]))):
                at = r.randrange(len(edited))
                edited[at : at + 1] = r.choice([[], ["ק"], [edited[at], "ר"]])
            rows.append((f"e{i}", "".join(edited), r.choice(["dev", "test"])))
    rows += [("t0", rows[0][1], "train"), ("same", rows[0][1], "test"), ("again", rows[0][1], "train")]
    want = brute(rows)
    got = found(spark, rows)
    assert len(want) > 30
    assert got == want
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA)
    best = {k: min(d for (a, _), d in want.items() if a == k) for k, _ in want}
    assert {x.id: x.edits for x in leaked(df, "id", "text", F.col("split") != "train").collect()} == best


def test_cases(spark):
    base = "eins zwei drei vier funf sechs sieben acht"
    rows = [("a", base, "train"), ("b", base.upper() + "!!", "test"), ("c", "a b c d e", "train"), ("d", "a b c d e", "dev"), ("e", None, "train"), ("f", "", "dev"), (None, base, "train"), ("g", base, None), ("h", "​".join(base), "dev")]
    assert found(spark, rows) == {("b", "a"): 0, ("h", "a"): 0}
    assert found(spark, []) == {}
    assert found(spark, [("x", "w " * 20_000, "train"), ("y", "w " * 20_000, "dev")]) == {("y", "x"): 0}


def test_chunks_resynchronise_and_cover():
    r = random.Random(1)
    text = "".join(r.choice("abcdefgh ") for _ in range(400))
    owner, digest, length = chunks([text, "", text[:200] + "XY" + text[200:]])
    assert length[owner == 0].sum() == 400 and (owner != 1).all()
    assert len(set(digest[owner == 0]) & set(digest[owner == 2])) >= len(set(digest[owner == 0])) - 3
    assert len(chunks([])[0]) == 0


def test_counts_bound_the_distance():
    r = random.Random(3)
    texts = ["".join(r.choice("abcd ") for _ in range(r.randrange(1, 60))) for _ in range(40)]
    sizes, letters, pairs, windows = counted(texts)
    assert sizes.tolist() == [len(t) for t in texts]
    for i in range(40):
        for j in range(40):
            k = distance(texts[i], texts[j])
            for counts, each in ((letters, 1), (pairs, 2)):
                assert np.maximum(counts[i].astype(int) - counts[j], 0).sum() <= each * k
            assert int(np.bitwise_count(windows[i] & ~windows[j]).sum()) <= overlap.ROLL * k
            placed = Placed(texts)
            assert lacking(placed[i], placed[j], k) <= overlap.PLACED * k


def edited(r, text, n):
    out = list(text)
    for _ in range(n):
        at = r.randrange(len(out))
        out[at : at + 1] = r.choice([[], ["ק"], [out[at], "ר"]])
    return "".join(out)


def test_short_texts_with_as_many_edits_as_allowed(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("אבגדהוזחטיכלמנ") for _ in range(r.randrange(2, 6))) for _ in range(200)]
    texts = [" ".join(r.choices(vocabulary, k=r.randrange(6, 10))) for _ in range(80)]
    rows = [(f"t{i}", t, "train") for i, t in enumerate(texts)] + [(f"e{i}", edited(r, t, len(t) * 15 // 100), "dev") for i, t in enumerate(texts)]
    want = brute(rows)
    assert len(want) > 40 and found(spark, rows) == want


def test_pairs_that_share_only_frequent_chunks(spark, monkeypatch):
    monkeypatch.setattr(overlap, "PIECES", (7, 11), raising=False)
    r = random.Random(9)
    words = ["אבגדה", "וזחטי", "כלמנס", "עפצקר", "שתאגה", "זטכמס"]
    texts = [" ".join(r.choices(words, k=r.randrange(6, 16))) for _ in range(50)]
    rows = [(f"t{i}", t, "train") for i, t in enumerate(texts)] + [(f"e{i}", edited(r, t, len(t) // 8), "test") for i, t in enumerate(texts)]
    want = brute(rows)
    assert len(want) > 40 and found(spark, rows) == want


@pytest.mark.parametrize("size", [200, 800])
@pytest.mark.parametrize("percent", [5, 10, 15])
def test_evenly_spread_edits_are_found_at_every_size(spark, size, percent):
    """Few words, so that everything is frequent, and replacements as far apart as they can be: the hardest spread."""
    r = random.Random(percent)
    vocabulary = ["".join(r.choice("אבגדהוזחטיכלמנ") for _ in range(r.randrange(3, 7))) for _ in range(60)]
    texts = [" ".join(r.choices(vocabulary, k=10)) for _ in range(size)]
    rows = [(f"t{i}", t, "train") for i, t in enumerate(texts)]
    for i, text in enumerate(texts):
        n = len(text) * percent // 100
        places = {int((k + 0.5) * len(text) / n) for k in range(n)}
        rows.append((f"e{i}", "".join("ק" if k in places and c != " " else c for k, c in enumerate(text)), "dev"))
    got = found(spark, rows)
    assert all((f"e{i}", f"t{i}") in got for i in range(size))


def test_long_texts_may_have_as_many_edits():
    """Over 20,000 edits in a row, which move all that follows, leave a pair to be compared."""
    r = random.Random(4)
    text = "".join(r.choices("אבגדהוזחטיכלמנ ", k=150_000))
    shorter = text[:40_000] + text[62_000:]
    left = pa.table({"a": [1], "plain": [text]})
    right = pa.table({"b": [2, 6], "plain": [shorter, text]})
    got = overlap._compared(15)(left, right)
    assert {2, 6} <= set(got.column("b").to_pylist())
    placed = Placed([text, shorter])
    assert lacking(placed[0], placed[1], 22_500) <= overlap.PLACED * 22_000


def test_index_meets_every_close_pair(monkeypatch):
    """Texts of every length with as many edits as allowed, at any places, in a row or spread, among texts that share words."""
    r = random.Random(11)
    vocabulary = ["".join(r.choice("אבגדהוזחטיכלמנ") for _ in range(r.randrange(1, 9))) for _ in range(400)]
    texts, others = [], []
    for k in range(240):
        text = " ".join(r.choices(vocabulary, k=r.randrange(3, 45)))
        most, kind, out = len(text) * 15 // 100, k % 4, list(text)
        for e in range(most):
            at = r.randrange(len(out)) if kind == 0 else min(e + len(out) // 3, len(out) - 1) if kind == 1 else int((e + 0.5) * len(out) / most)
            out[at : at + 1] = [[], ["ק"], [out[at], "ר"]][kind - 1 if kind > 1 else r.randrange(3)]
        texts.append(text)
        others.append("".join(out))
    met, looked = {}, []
    meetings = overlap._meetings
    monkeypatch.setattr(overlap, "_meetings", lambda *given: looked.append(len(given[2])) or meetings(*given))
    monkeypatch.setattr(overlap, "INDEX_CHARS", 3000)
    monkeypatch.setattr(overlap, "PAIRS", 50)
    for one, two in ((texts, others), (others, texts)):
        for indexed in (0, 10**9):
            monkeypatch.setattr(overlap, "INDEXED", indexed)
            got = overlap._compared(15)(pa.table({"a": range(240), "plain": one}), pa.table({"b": range(240), "plain": two}))
            met[indexed] = set(zip(got.column("a").to_pylist(), got.column("b").to_pylist(), strict=True))
            assert len(met[indexed]) == got.num_rows
        close = {(i, j) for i, j in met[10**9] if distance(one[i], two[j]) * 100 <= 15 * max(len(one[i]), len(two[j]))}
        assert close <= met[0] <= met[10**9] and len(close) >= 220
    assert sum(looked) > 240


def test_index_meets_few_pairs():
    """A block's time must not be that of all pairs: of 9 million, under one in a hundred are looked at."""
    r = random.Random(12)
    vocabulary = ["".join(r.choice("אבגדהוזחטיכלמנ") for _ in range(r.randrange(2, 9))) for _ in range(3000)]
    texts = sorted((" ".join(r.choices(vocabulary, k=16)) for _ in range(6000)), key=len)
    one, two = sorted(texts[::2], key=len), texts[1::2]
    n, others = (np.array([len(t) for t in x]) for x in (one, two))
    met = sum(len(i) for i, _ in overlap._meetings(overlap._Grams(one), np.cumsum(n) - n, n, two, others, 15))
    assert met < 0.01 * 3000 * 3000


def test_packed_pieces_keep_every_record(monkeypatch):
    monkeypatch.setattr(overlap, "ROW_CHARS", 300)
    monkeypatch.setattr(overlap, "HELD_CHARS", 2000)
    r = random.Random(13)
    rows = [(r.randrange(3), r.randrange(4), k, "א" * r.randrange(200)) for k in range(500)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + 100], strict=True)], names=["band", "piece", "rec", "plain"]) for at in range(0, 500, 100)]
    got = []
    for batch in overlap._packed(batches):
        for band, piece, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            table = pa.ipc.open_stream(texts).read_all()
            got += [(band, piece, *x) for x in zip(table.column("rec").to_pylist(), table.column("plain").to_pylist(), strict=True)]
    assert sorted(got) == sorted(rows)
