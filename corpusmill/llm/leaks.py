"""Problem 9: evaluation passages that stand in corpus documents.

Winnowing: of every ``WINDOW`` consecutive hashes of ``GRAM`` words the least is kept, so two texts that share at least
``GRAM + WINDOW - 1`` consecutive words keep a common fingerprint. Fingerprints are joined and each hit is extended word
by word in both texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.wording import Hashes, bounded, flat_hashes, grams, signed, winnowed, words_of
from corpusmill.session import cut

GRAM = 5
#: Consecutive words that make a leak.
SPAN = 12
#: Lists that the passages which hit a document are parted into, at most.
LISTS = 64
#: Texts handled at a time inside a batch.
SLICE = 1000


def _fingerprints(gram: int, window: int):
    def run(batches):
        hashes = Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                lists = [words_of(t) for t in some.column(1).to_pylist()]
                if len(hashes) > 500_000:
                    hashes.clear()
                flat, offsets = flat_hashes(lists, hashes)
                values = grams(flat, offsets, gram)
                kept = winnowed(values, window)
                owner = np.searchsorted(offsets, kept, side="right") - 1
                ids = some.column(0).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([ids, signed(values[kept]), pa.array((kept - offsets[owner]).astype(np.int32))], names=["id", "print", "place"])

    return run


def fingerprints(df: DataFrame, key: str, text: str, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """Rows (id, print, place) of the winnowed word hashes of each text; null and shorter texts give none."""
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null and text is not null")
    return rows.mapInArrow(_fingerprints(gram, span - gram + 1), "id bigint, print bigint, place int")


def _longest(a: list[str], b: list[str], i: int, j: int, gram: int) -> int:
    """Length of the run of equal words around places i and j; 0 if the ``gram`` words there differ after all."""
    if a[i : i + gram] != b[j : j + gram]:
        return 0
    left = 0
    while i > left and j > left and a[i - left - 1] == b[j - left - 1]:
        left += 1
    right = gram
    while i + right < len(a) and j + right < len(b) and a[i + right] == b[j + right]:
        right += 1
    return left + right


def _extend(gram: int):
    """Rows (id, item, words) of rows (id, text, passages): a document's words are made once for all its passages."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {"id": [], "item": [], "words": []}
            passages: dict[str, list[str]] = {}
            for row in batch.to_pylist():
                a = words_of(row["text"])
                if len(passages) > 5000:
                    passages.clear()
                for p in row["passages"]:
                    b = passages.get(p["item_text"]) or passages.setdefault(p["item_text"], words_of(p["item_text"]))
                    best, done = 0, set()
                    for hit in sorted((h["place"], h["item_place"]) for h in p["hits"]):
                        # A hit inside a run that was already extended has the same run.
                        if (hit[0] - hit[1], hit[0]) in done:
                            continue
                        best = max(best, _longest(a, b, *hit, gram))
                        done |= {(hit[0] - hit[1], hit[0] + x) for x in range(gram)}
                    for name, value in zip(out, (row["id"], p["item"], best), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("id", pa.int64()), ("item", pa.int64()), ("words", pa.int32())]))

    return run


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``key``, ``item_key`` and ``words``, the longest run of equal consecutive words, of each pair with ``span`` or more.

    Null keys and texts, empty texts and texts under ``span`` words match nothing; repeated rows give one pair; empty
    tables give no rows; other columns are ignored.
    """
    tests = cut(fingerprints(items, item_key, item_text, gram, span).distinct().select(F.col("id").alias("item"), "print", F.col("place").alias("item_place")))
    tests = bounded(tests)
    hits = fingerprints(docs, key, text, gram, span).join(tests, "print").groupBy("id", "item").agg(F.collect_set(F.struct("place", "item_place")).alias("hits"))
    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    passages = items.select(F.col(f"`{item_key}`").cast("bigint").alias("item"), F.col(f"`{item_text}`").alias("item_text")).distinct()
    # The passages that hit a document go to it in lists, so that its text stands in a row a list and not a pair; lists
    # are parted, so that a stock phrase of very many passages doesn't make one of them large.
    part = F.pmod(F.xxhash64("item"), F.lit(LISTS)).cast("int").alias("part")
    lists = cut(hits.join(passages, "item").groupBy("id", part).agg(F.collect_list(F.struct("item", "item_text", "hits")).alias("passages")))
    # Only the ids of documents with hits meet the corpus; their texts then meet their lists.
    wanted = texts.join(bounded(lists.select("id").distinct()), "id", "left_semi").distinct()
    found = wanted.join(lists, "id").select("id", "text", "passages").mapInArrow(_extend(gram), "id bigint, item bigint, words int").where(F.col("words") >= span)
    return found.groupBy("id", "item").agg(F.max("words").alias("words")).select(F.col("id").alias(key), F.col("item").alias(item_key), "words")
