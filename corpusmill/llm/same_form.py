"""Problem 6: texts that look the same but differ in their characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusmill.llm.forms import canonical_column
from corpusmill.session import cut


def with_canonical(df: DataFrame, text: str, out: str = "_canonical") -> DataFrame:
    """``df`` with ``out``, the canonical form of ``text``; null stays null, empty and blank texts become empty.

    Other columns pass through unchanged, whatever their names; ``out`` must not be one of them.
    """
    schema = StructType([*df.schema.fields, StructField(out, StringType())])
    return df.mapInArrow(canonical_column(text, out), schema)


def _digest(text: str) -> Column:
    return F.unhex(F.substring(F.sha2(F.col(text), 256), 1, 32))


def same_looking_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs ``key_a`` < ``key_b`` whose non-empty texts look the same but aren't the same code points.

    Null keys and null or empty texts give no pair; texts of white space or invisible characters alone look empty and
    give none; repeated rows count once; an empty table gives no rows. Different forms are paired, and their keys only then, so
    that copies of one form never meet each other.
    """
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).where("_key is not null and _text <> ''")
    rows = with_canonical(rows, "_text").where("_canonical <> ''")
    # Texts are known by 128 bits of their digests from here on: what a key's text looks like, and its raw form.
    rows = cut(rows.select("_key", _digest("_canonical").alias("_look"), _digest("_text").alias("_raw")).distinct())
    # Only forms that have another of the same look are paired, and then their keys.
    forms = rows.select("_look", "_raw").distinct()
    varied = forms.groupBy("_look").agg(F.count("*").alias("_n")).where("_n > 1").select("_look")
    forms = forms.join(varied, "_look", "left_semi")
    members = rows.join(varied, "_look", "left_semi")
    one, two = (forms.select("_look", F.col("_raw").alias(n)) for n in ("_one", "_two"))
    apart = one.join(two, "_look").where("_one < _two")
    left = members.select("_look", F.col("_key").alias("_a"), F.col("_raw").alias("_one"))
    right = members.select("_look", F.col("_key").alias("_b"), F.col("_raw").alias("_two"))
    pairs = apart.join(left, ["_look", "_one"]).join(right, ["_look", "_two"]).where("_a <> _b")
    return pairs.select(F.least("_a", "_b").alias(f"{key}_a"), F.greatest("_a", "_b").alias(f"{key}_b")).distinct()
