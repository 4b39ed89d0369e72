"""Problem 8: encoding of a corpus with a public byte-level BPE tokenizer.

Texts are cut into pre-tokens, each distinct pre-token is encoded once for the whole corpus, and ids are joined back and
put together by position. Positions are kept per block of documents: a block lists its own distinct words and, for each
document, the sequence of their numbers, so that a word travels once a block instead of once an occurrence.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.blocks import id_blocks, with_entries, word_blocks, words_in

DEFAULT_TOKENIZER = "byte_bpe_50k"
TOKENIZER_FOLDER = "/opt/tokenizers"

#: Fixed value: the public pre-token pattern of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts all of whose digits are decimal and whose white space both libraries know.
_FAST = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class PreTokens:
    """Pre-tokens of a text; the slower pattern library only where the classes of the two differ."""

    def __init__(self) -> None:
        import regex

        self.exact = regex.compile(PATTERN)
        self.letter, self.number, self.space = (regex.compile(x) for x in (r"\p{L}", r"\p{N}", r"\s"))
        self.known: dict[str, bool] = {}

    def _agrees(self, ch: str) -> bool:
        letter, digit, space = bool(re.match(r"[^\W\d_]", ch)), bool(re.match(r"\d", ch)), bool(re.match(r"\s", ch))
        return (letter, digit, space) == (bool(self.letter.match(ch)), bool(self.number.match(ch)), bool(self.space.match(ch)))

    def __call__(self, text: str) -> list[str]:
        for ch in set(text) - self.known.keys():
            self.known[ch] = self._agrees(ch)
        fast = all(map(self.known.__getitem__, set(text)))
        return (_FAST if fast else self.exact).findall(text)


def _encode(path: str):
    """Adds the ids of each word, as the bytes of 32-bit integers."""

    def run(batches):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        coder = tiktoken.Encoding("corpusmill", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            words = batch.column(0).to_pylist()
            ids = [np.array(coder.encode_ordinary(w), np.int32).tobytes() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["word", "ids"])

    return run


def _assemble(batches):
    """Documents' ids from a block's codes and the ids of its words."""
    for batch in batches:
        for row in batch.to_pylist():
            keys, counts = np.frombuffer(row["documents"], np.int64), np.frombuffer(row["counts"], np.int32)
            codes = np.frombuffer(row["codes"], np.int32)
            entries = sorted((e["number"], e["value"]) for e in row["entries"] or [])
            sizes = np.array([len(ids) // 4 for _, ids in entries], np.int64)
            flat = np.frombuffer(b"".join(ids for _, ids in entries), np.int32)
            begins = np.concatenate([[0], np.cumsum(sizes)])[:-1] if len(sizes) else np.empty(0, np.int64)
            lengths = sizes[codes] if len(codes) else np.empty(0, np.int64)
            ends = np.cumsum(lengths)
            # Each output place: its word's first id plus its place in the word.
            places = np.repeat(begins[codes] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0) if len(codes) else np.empty(0, np.int64)
            ids = flat[places]
            upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
            for at in range(0, len(keys), 2000):
                some = upto[at : at + 2001]
                values = pa.array(ids[some[0] : some[-1]], pa.int32())
                lists = pa.ListArray.from_arrays(pa.array((some - some[0]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + len(some) - 1]), lists], names=["doc", "ids"])


def encode(df: DataFrame, key: str, text: str, tokenizer: str = DEFAULT_TOKENIZER, folder: str = TOKENIZER_FOLDER) -> DataFrame:
    """``key`` and ``ids`` of each row of ``df``, without special tokens.

    A null or an empty text gives the empty list. ``key`` must be a 64-bit integer and not null; repeated rows each give
    a row; an empty table gives none; other columns are ignored. The rank file ``folder/tokenizer.tiktoken`` must be
    there on every executor.
    """
    blocks = word_blocks(df, key, text, PreTokens)
    coded = words_in(blocks).select("word").distinct().mapInArrow(_encode(f"{folder}/{tokenizer}.tiktoken"), "word string, ids binary")
    whole = with_entries(blocks, coded, F.col("ids"))
    return whole.mapInArrow(_assemble, "doc bigint, ids array<int>").withColumnRenamed("doc", key)


def token_bytes(spark: SparkSession, tokenizer: str = DEFAULT_TOKENIZER, folder: str = TOKENIZER_FOLDER) -> DataFrame:
    """(word, bytes): the vocabulary's table of ids and the bytes they stand for."""
    lines = F.split(F.col("value"), " ")
    return spark.read.text(f"file://{folder}/{tokenizer}.tiktoken").select(lines[1].cast("int").alias("word"), F.unbase64(lines[0]).alias("bytes"))


def _texts(batches):
    """Documents' texts from a block's codes and the bytes of its ids."""
    for batch in batches:
        for row in batch.to_pylist():
            keys, counts = np.frombuffer(row["documents"], np.int64), np.frombuffer(row["counts"], np.int32)
            codes = np.frombuffer(row["codes"], np.int32).tolist()
            pieces = {e["number"]: e["value"] for e in row["entries"] or []}
            upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            for at in range(0, len(keys), 500):
                texts = [b"".join(map(pieces.__getitem__, codes[upto[i] : upto[i + 1]])).decode("utf-8", "replace") for i in range(at, min(at + 500, len(keys)))]
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 500]), pa.array(texts, pa.string())], names=["doc", "text"])


def decode(df: DataFrame, key: str, ids: str = "ids", tokenizer: str = DEFAULT_TOKENIZER, folder: str = TOKENIZER_FOLDER) -> DataFrame:
    """``key`` and ``text`` of lists of ids: the distinct ids of each block of documents are joined to the token-byte table.

    An empty and a null list give the empty text; an id that isn't in the table is an error. ``key`` must be a 64-bit
    integer and not null; repeated rows each give a row.
    """
    table = token_bytes(df.sparkSession, tokenizer, folder)
    whole = with_entries(id_blocks(df, key, ids), table, F.col("bytes"))
    return whole.mapInArrow(_texts, "doc bigint, text string").withColumnRenamed("doc", key)
