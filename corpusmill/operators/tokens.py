"""Reference tokens of paragraphs with what cutting needs to know of them, and times for tokens that have none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import scoring_text

#: Characters that part a token and are kept as its separator.
PARTERS = "־–—-"
#: Words a second where no recognised word says when a token is spoken.
PACE = 2.8


def reference_tokens(paragraphs: DataFrame, keys: Sequence[str], place: str, text: str, keep_brackets: bool = True) -> DataFrame:
    """``keys``, token, surface, sep, norm, paragraph, sentence_end, comma, paragraph_end: the tokens of each text in order.

    Words are parted at hyphens and dashes, and ``sep`` is the one before a part, else a blank. A part without letters is
    no token: it is put at the end of the surface of the token before, in whatever paragraph, and left out where there
    is none. Flags tell a token's own last character, and the last token of a paragraph. Without ``keep_brackets``
    what stands in square brackets is left out first. Null texts give nothing.
    """
    body = F.col(text) if keep_brackets else F.regexp_replace(text, r"\[[^\]]*\]", " ")
    part = rf"([{PARTERS}]*)([^\s{PARTERS}]+)"
    seps, surfaces = (F.regexp_extract_all(F.col("_word"), F.lit(rf"(?U){part}"), F.lit(i)) for i in (1, 2))
    words = paragraphs.select(*keys, F.col(place).alias("paragraph"), F.posexplode(F.filter(F.split(body, r"(?U)\s+"), lambda w: w != "")).alias("_nth", "_word"))
    parts = words.select(*keys, "paragraph", "_nth", F.posexplode(F.arrays_zip(seps.alias("sep"), surfaces.alias("surface"))).alias("_part", "_p"))
    sep = F.when(F.col("_p.sep") == "", " ").otherwise(F.substring("_p.sep", -1, 1))
    parts = parts.select(*keys, "paragraph", "_nth", "_part", sep.alias("sep"), F.col("_p.surface").alias("surface"), F.replace(scoring_text(F.col("_p.surface")), F.lit(" "), F.lit("")).alias("norm"))
    order = Window.partitionBy(*keys).orderBy("paragraph", "_nth", "_part")
    # A token and the bare marks that follow it have one number.
    numbered = parts.withColumn("_number", F.sum((F.col("norm") != "").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_number > 0")
    own = lambda c: F.max(F.when(F.col("norm") != "", F.col(c)))
    last = F.max(F.when(F.col("norm") != "", F.substring("surface", -1, 1)))
    glued = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("paragraph", "_nth", "_part", "surface"))), lambda p: p.surface), "")
    tokens = numbered.groupBy(*keys, "_number").agg(own("paragraph").alias("paragraph"), own("sep").alias("sep"), own("norm").alias("norm"), glued.alias("surface"), last.alias("_last"))
    following = F.lead("paragraph").over(Window.partitionBy(*keys).orderBy("_number"))
    end = following.isNull() | (following != F.col("paragraph"))
    return tokens.select(*keys, (F.col("_number") - 1).alias("token"), "surface", "sep", "norm", "paragraph", F.col("_last").isin(".", "?", "!", ":").alias("sentence_end"), F.col("_last").isin(",", ";").alias("comma"), end.alias("paragraph_end"))


def token_times(tokens: DataFrame, keys: Sequence[str], place: str, start: str, end: str, weight: str, begin: Column, finish: Column, pace: float = PACE) -> DataFrame:
    """``tokens`` with token_start and token_end: known times as they are, the others from their neighbours.

    Tokens between two known ones share the time between in proportion to ``weight``; if the later one starts before the
    earlier one ends, they have no length. Those before the first known one run at ``pace`` words a second up to it, but
    not from before ``begin``; those after the last one at the same pace, but not beyond ``finish``. A text without a known
    time has none at all.
    """
    order = Window.partitionBy(*keys).orderBy(place)
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    known = F.col(start).isNotNull()
    x = tokens.withColumn("_n", F.row_number().over(order)).withColumn("_w", F.when(known, 0).otherwise(F.col(weight)))
    x = x.withColumn("_all", F.count("*").over(Window.partitionBy(*keys))).withColumn("_upto", F.sum("_w").over(before))
    for name, value in (("s", F.col(start)), ("e", F.col(end)), ("w", F.col("_upto")), ("i", F.col("_n"))):
        known_value = F.when(known, value)
        x = x.withColumn(f"_{name}0", F.last(known_value, True).over(before)).withColumn(f"_{name}1", F.first(known_value, True).over(after))
    head, tail = F.col("_i0").isNull(), F.col("_i1").isNull()
    span = F.greatest(F.lit(0.0), F.col("_s1") - F.col("_e0"))
    share = lambda upto: F.col("_e0") + span * (upto - F.col("_w0")) / F.nullif(F.col("_w1") - F.col("_w0"), F.lit(0))
    n_head, n_tail = F.col("_i1") - 1, F.col("_all") - F.col("_i0")
    from_ = F.greatest(begin, F.col("_s1") - n_head / pace)
    upto = F.least(finish, F.col("_e0") + n_tail / pace)
    early = lambda k: from_ + (F.col("_s1") - from_) * k / n_head
    late = lambda k: F.col("_e0") + (upto - F.col("_e0")) * k / n_tail
    nth, past = F.col("_n"), F.col("_n") - F.col("_i0")
    token_start = F.when(known, F.col(start)).when(head & tail, F.lit(None)).when(head, early(nth - 1)).when(tail, late(past - 1)).otherwise(share(F.col("_upto") - F.col("_w")))
    token_end = F.when(known, F.col(end)).when(head & tail, F.lit(None)).when(head, early(nth)).when(tail, late(past)).otherwise(share(F.col("_upto")))
    return x.withColumn("token_start", token_start).withColumn("token_end", token_end).select(*tokens.columns, "token_start", "token_end")
