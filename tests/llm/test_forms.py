import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm.forms import Canonical, Plain, canonical_plain
from corpusmill.llm.same_form import same_looking_pairs, with_canonical

ODD = "אבײױװאָאַפּפֿ־״'\"ℵℶ﬩１，！Å̧éé  ​­͏‏﻿\t\n ʼnﬁ각가\U0001f3a4"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(ODD), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_splicing_equals_the_whole_form(text):
    assert Canonical()(text) == canonical_plain(text)


def test_learning_in_any_order():
    r, form = random.Random(3), Canonical()
    for _ in range(500):
        text = "".join(r.choice(ODD) for _ in range(r.randrange(12)))
        assert form(text) == canonical_plain(text)
        assert form(form(text)) == form(text)


def test_known_forms():
    form = Canonical()
    assert form("ײִ") == form("ייִ")
    assert form("ﬡבּ") == form("אבּ")
    assert form("a b​ c") == "a b c"
    assert form('ד״ע') == form('ד"ע')
    assert form("e" + "́") == "é"
    assert form(None) is None
    assert form("") == form("  ") == form("​") == ""
    assert unicodedata.is_normalized("NFC", form("שָּׁ"))


def test_plain_words():
    assert "<Aב́,１>".translate(Plain()) == "aב1"


def test_pairs(spark):
    rows = [(1, "\ufb2f \u05d1"), (2, "\u05d0\u05b8 \u05d1"), (3, "\u05d0\u05b8\u00a0\u05d1"), (3, "\u05d0\u05b8\u00a0\u05d1"), (4, ""), (5, None), (6, "\u200b"), (7, "\t"), (None, "\ufb2f \u05d1"), (8, "\u05d2"), (9, "\u05d0\u05b8 \u05d1")]
    df = spark.createDataFrame(rows, "k int, _raw string")
    got = {tuple(r) for r in same_looking_pairs(df, "k", "_raw").collect()}
    texts = {k: t for k, t in rows if k}
    want = {(a, b) for a in texts for b in texts if a < b and texts[a] and texts[b] and texts[a] != texts[b] and canonical_plain(texts[a]) and canonical_plain(texts[a]) == canonical_plain(texts[b])}
    assert got == want and got
    assert same_looking_pairs(spark.createDataFrame([], df.schema), "k", "_raw").count() == 0
    assert [r.form for r in with_canonical(df.where("k = 8"), "_raw", "form").collect()] == ["ג"]


def test_very_long_text():
    text = "\ufb2f\u05d1 " * 100_000
    assert Canonical()(text) == canonical_plain(text)


def test_letters_of_other_scripts():
    form = Canonical()
    for a, b in (("раураl", "paypal"), ("Αpple", "Apple"), ("ѕ", "s"), ("a‐b", "a-b"), ("рoст", "рост"), ("ΡDF", "PDF"), ("poccия", "россия"), ("Ёж", "Eж".replace("E", "Ё"))):
        assert form(a) == form(b) == canonical_plain(a) == form(form(a))
    assert form("россия") == "россия" and form("Ελλάδα") == "Ελλάδα" and form("нет") != form("het")
    assert "раура1".translate(Plain()) == "paypa1"


def test_many_copies_of_two_forms(spark):
    rows = [(i, "אָ") for i in range(300)] + [(1000, "אָ")]
    got = same_looking_pairs(spark.createDataFrame(rows, "k int, _raw string"), "k", "_raw").collect()
    assert sorted(tuple(r) for r in got) == [(i, 1000) for i in range(300)]
