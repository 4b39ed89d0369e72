import random

from corpusmill.llm.scans import Perceptron, line_shape, numbers_of, paragraphs, scan_findings, variant_keys, words_of_line

SCHEMA = "pdf_id bigint, year int, body string, doc int, edges string"


def pages(seed=3, docs=40):
    """Bodies with planted headers, page numbers, breaks and misread words; clean texts of the same words."""
    r = random.Random(seed)
    words = sorted({"".join(r.choice("אבגדהזחטילמנעפ") for _ in range(r.randrange(4, 9))) for _ in range(250)})
    clean = [" ".join(r.choices(words, k=60)) for _ in range(200)]
    headers = {y: " ".join(r.choices(words, k=4)) for y in (1, 2)}
    rows, truth = [], set()
    for d in range(docs):
        year, lines = 1 + d % 2, []
        for page in range(3):
            lines.append(f"{headers[year]} • {'אבגדה'[page]}׳" if d % 3 else f"| {headers[year]} |")
            truth.add((d, len(lines) - 1, "edge"))
            for n in range(8):
                line = r.choices(words, k=9)
                if r.random() < 0.15:
                    at = r.randrange(1, 8)
                    w = line[at]
                    line[at] = w[:2] + r.choice("wY|7") + w[3:]
                    truth.add((d, len(lines), "misread"))
                lines.append(" ".join(line))
            if page < 2:
                w = r.choice(words)
                lines[-1] += " " + w[:2] + "¬"
                truth.add((d, len(lines) - 1, "hyphen"))
                rest = w[2:]
                lines += ["", f"— {page + 7} —"]
                truth.add((d, len(lines) - 1, "edge"))
                lines.append(f"{headers[year]} • ז׳")
                truth.add((d, len(lines) - 1, "edge"))
                lines.append(rest + " " + " ".join(r.choices(words, k=8)))
        rows.append((d, year, "\n".join(lines), 0, ""))
    return rows, clean, truth


def test_planted_findings(spark):
    rows, clean, truth = pages()
    texts = spark.createDataFrame([(t,) for t in clean], "text string")
    df = spark.createDataFrame([*rows, (900, None, None, 0, ""), (901, 1, "", 0, ""), (None, 1, "x", 0, "")], SCHEMA)
    found, fixes = scan_findings(df, texts)
    got = {tuple(r) for r in found.collect()}
    for kind in ("edge", "hyphen", "misread"):
        a, b = {x for x in got if x[2] == kind}, {x for x in truth if x[2] == kind}
        assert len(a & b) >= 0.95 * len(b), kind
        assert len(a & b) >= 0.95 * len(a), kind
    first = paragraphs(df, found, fixes).where("pdf_id = 1").orderBy("paragraph").collect()
    joined = " ".join(r.text for r in first)
    assert "—" not in joined and "¬" not in joined and "•" not in joined


def test_empty_tables(spark):
    texts = spark.createDataFrame([("אבג דהו",)], "text string")
    empty = spark.createDataFrame([], SCHEMA)
    assert scan_findings(empty, texts)[0].count() == 0
    rows = spark.createDataFrame([(1, 1, "אבג דהו\nזחט", 0, "")], SCHEMA)
    assert scan_findings(rows, texts.limit(0))[0].count() == 0


def test_line_shapes():
    assert line_shape("— 12 —")[:2] == ("", 1) and line_shape("עמוד 3")[:2] == ("", 1) and line_shape("קל״ב")[:2] == ("", 1)
    assert line_shape('דא"ך')[1] == 0 and line_shape("סימן נ״ז")[0] == "סימן"
    assert line_shape("| א ב |")[0] == line_shape("12   א ב")[0] == "א ב"
    assert words_of_line('אב, גד־הו "זח" 12 ט״ו') == ["אב", "גד", "הו", "זח"]


def test_perceptron_learns():
    model = Perceptron().fit([([["keep"], ["x"]], 1), ([["keep"], ["y"]], 0)] * 5)
    assert model.best([["keep"], ["x"]]) == 1 and model.best([["keep"], ["y"]]) == 0


def test_variant_keys_meet_where_strings_do():
    r = random.Random(2)
    words = sorted({"".join(r.choice("אבג") for _ in range(r.randrange(1, 5))) for _ in range(60)})
    texts = {}
    for word in words:
        for key, op, place in variant_keys(word):
            text = word if op == "whole" else f"{word[:place]}*{word[place + 1 :]}" if op == "hole" else word[:place] + word[place + 1 :]
            assert texts.setdefault(key, text) == text
    assert len(set(texts.values())) == len(texts)


def test_numbers_of_lines():
    assert numbers_of("— 12 —") == {12} and numbers_of("עמוד 3") == {3} and numbers_of("קל״ב") == {132} and numbers_of("אב גד • ז׳") == {7} and numbers_of("אב גד") == set()


def test_a_number_that_is_no_page_is_text(spark):
    rows, clean, truth = pages()
    texts = spark.createDataFrame([(t,) for t in clean], "text string")
    with_pages = [(*r, [7, 8]) for r in rows]
    df = spark.createDataFrame(with_pages, SCHEMA + ", pages array<int>")
    found, _ = scan_findings(df, texts, pages="pages")
    got = {tuple(r) for r in found.where("kind = 'edge'").collect()}
    want = {x for x in truth if x[2] == "edge"}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)
    assert scan_findings(spark.createDataFrame([(1, 1, "א" * 20_000 + "\nאבג", 0, "")], SCHEMA), texts)[0].count() == 0
