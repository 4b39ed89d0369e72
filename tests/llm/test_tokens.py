import base64
import importlib.util
import os

import pytest

from corpusmill.llm import blocks
from corpusmill.llm.tokens import PATTERN, TOKENIZER_FOLDER, PreTokens, decode, encode

pytestmark = pytest.mark.skipif(not os.path.exists(f"{TOKENIZER_FOLDER}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")
TEXTS = ["", None, "hello world's  x\n\n y", "אָז דער שלום 123 ²½ Ⅷ", "\x1c a\x85b   c", "😀 👩‍👩‍👧 é é", "a" * 5000, " 　 tab\t\t", "'LL 'll don't", "_x__y", "٣٤ 一二"]


@pytest.fixture(scope="module")
def coder():
    import tiktoken

    with open(f"{TOKENIZER_FOLDER}/byte_bpe_50k.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pretokens_agree_with_the_exact_pattern():
    import regex

    cut = PreTokens()
    for text in filter(None, TEXTS):
        assert cut(text) == regex.findall(PATTERN, text)


@pytest.mark.parametrize("block", [10, 2_000_000])
def test_ids_equal_direct_encoding(spark, coder, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK_CHARS", block)
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, block int")
    got = [(r.doc_id, list(r.ids)) for r in encode(df, "doc_id", "text").collect()]
    assert sorted(got) == sorted((i, coder.encode_ordinary(t or "")) for i, t, _ in rows)


def test_round_trip_and_empty_table(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    back = {r.doc_id: r.text for r in decode(encode(df, "doc_id", "text"), "doc_id").collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert encode(df.limit(0), "doc_id", "text").count() == 0


def test_the_package_names_no_other_tokenizer():
    assert importlib.util.find_spec("corpusmill.llm.tokens")
