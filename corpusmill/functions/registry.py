"""The engine's functions by name, for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from corpusmill.functions import edits, text

#: Functions that SQL can call after :func:`register`; column builders have no SQL form but their expressions.
FUNCTIONS = {"is_repetitive": text.is_repetitive, "cut_repeats": text.cut_repeats, "unescaped": text.unescaped, "word_alignment": edits.word_alignment, "similarity": edits.similarity}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; their names."""
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    return sorted(FUNCTIONS)
