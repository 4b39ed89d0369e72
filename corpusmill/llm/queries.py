"""Queries over the test tables; their SQL is in ``sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.dates import calendar_date
from corpusmill.llm.grouped_splits import assigned, torn
from corpusmill.llm.leaks import leaks
from corpusmill.llm.near_texts import similar_groups, similar_pairs
from corpusmill.llm.overlap import leaked, overlaps
from corpusmill.llm.pieces import cut_oversized
from corpusmill.llm.reading import reading_levels
from corpusmill.llm.same_form import same_looking_pairs, with_canonical
from corpusmill.llm.scans import paragraphs, scan_findings
from corpusmill.llm.sql import SQL
from corpusmill.llm.tokens import decode, encode
from corpusmill.session import table

__all__ = ["QUERIES", "SQL"]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of a train clip and another one with the same or nearly the same text."""
    pairs = overlaps(table(spark, root, "manifest"), "id", "text", F.col("split") != "train")
    return pairs.select(F.least("key_a", "key_b").alias("id_a"), F.greatest("key_a", "key_b").alias("id_b")).distinct()


def p1_report(spark: SparkSession, root: str) -> DataFrame:
    """Held-out clips that also stand in train, per split and source: clips, those leaked, and the exact ones."""
    best = leaked(table(spark, root, "manifest"), "id", "text", F.col("split") != "train")
    clips = table(spark, root, "manifest").where(F.col("split") != "train").select("id", "split", "source_mp3", "day").distinct()
    hit, n = F.col("edits").isNotNull(), F.countDistinct
    return (
        clips.join(best, "id", "left")
        .groupBy("split", "source_mp3", "day")
        .agg(n("id").alias("clips"), n(F.when(hit, F.col("id"))).alias("leaked"), n(F.when(F.col("edits") == 0, F.col("id"))).alias("exact"))
    )


def p1_overlaps(spark: SparkSession, root: str) -> DataFrame:
    """The greatest share of each leaked clip's text that stands in chunks it has in common with a train clip."""
    return leaked(table(spark, root, "manifest"), "id", "text", F.col("split") != "train").select("id", "edits", F.round("overlap", 6).alias("overlap"))


def _scans(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Words of documents, clips and segments are taken as read rightly."""
    clean = table(spark, root, "documents").select("text").unionByName(table(spark, root, "manifest").select("text")).unionByName(table(spark, root, "site_segment").select(F.col("yiddish").alias("text")))
    return scan_findings(table(spark, root, "pdf_day"), clean, pages="pages")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Furniture, broken words and misread words of scanned bodies, by line."""
    return _scans(spark, root)[0]


def p2_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    """The repaired paragraphs of scanned bodies."""
    return paragraphs(table(spark, root, "pdf_day"), *_scans(spark, root))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of scanned bodies that share at least 0.6 of their distinct words."""
    return similar_pairs(table(spark, root, "pdf_day"), "pdf_id", "body").select("pdf_id_a", "pdf_id_b")


def p4_groups(spark: SparkSession, root: str) -> DataFrame:
    """Each scanned body's class of equal sets of words, and its links to other classes."""
    return similar_groups(table(spark, root, "pdf_day"), "pdf_id", "body")


def _clip_links() -> dict:
    return {"day": F.concat(F.col("year").cast("string"), F.lit("/"), F.col("day")), "date": calendar_date(F.col("source_date")).cast("string")}


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Publication days whose group of clips has more than one split."""
    return torn(table(spark, root, "manifest"), _clip_links(), "id", "split", ["year", "day"])


def p5_assigned(spark: SparkSession, root: str) -> DataFrame:
    """A new split for every clip, in the shares of the quota, with groups whole."""
    quota = {r["split"]: r["share"] for r in table(spark, root, "split_quota").collect()}
    return assigned(table(spark, root, "manifest"), _clip_links(), "id", quota)


def p5_checked(spark: SparkSession, root: str) -> DataFrame:
    """Whether the new splits keep days and dates whole, and their shares are near the quota.

    Near is within a hundredth and the share of the largest day or date, which can't be parted.
    """
    new = p5_assigned(spark, root)
    rows = table(spark, root, "manifest").select("id", *(v.alias(k) for k, v in _clip_links().items())).distinct().join(new, "id")
    units = [rows.where(F.col(k).isNotNull()).groupBy(k).agg(F.countDistinct("split").alias("n"), F.count("*").alias("size")) for k in ("day", "date")]
    torn_by = [u.agg(F.count_if(F.col("n") > 1)) for u in units]
    largest = F.greatest(*(F.coalesce(u.agg(F.max("size")).scalar(), F.lit(0)) for u in units))
    shares = new.groupBy("split").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row a split
    off = table(spark, root, "split_quota").join(shares, "split", "left").select(F.abs(F.coalesce("n", F.lit(0)) / total - F.col("share")).alias("off"), total.alias("clips"))
    found = off.agg(F.max("clips").alias("clips"), F.max("off").alias("off")).withColumn("near_quota", F.col("off") <= 0.01 + largest / F.col("clips")).drop("off")
    return found.withColumn("torn_days", torn_by[0].scalar()).withColumn("torn_dates", torn_by[1].scalar())


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Segments that look the same but are coded differently."""
    return same_looking_pairs(table(spark, root, "site_segment"), "seg_id", "yiddish")


def p6_forms(spark: SparkSession, root: str) -> DataFrame:
    """The consistent form of every clip's raw text and every segment's Yiddish."""
    clips = table(spark, root, "manifest").select(F.lit("manifest").alias("origin"), F.col("id").alias("key"), F.col("text_raw").alias("raw"))
    segments = table(spark, root, "site_segment").select(F.lit("site_segment").alias("origin"), F.col("seg_id").cast("string").alias("key"), F.col("yiddish").alias("raw"))
    return with_canonical(clips.unionByName(segments), "raw", "form").drop("raw").distinct()


def _pieces(spark: SparkSession, root: str) -> DataFrame:
    limit = table(spark, root, "piece_limit").where("item = 'yiddish'").first()
    return cut_oversized(table(spark, root, "site_segment"), "seg_id", "yiddish", "start", "end", limit["max_chars"], limit["max_seconds"], limit["overlap_words"])


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Segments that had to be cut."""
    return _pieces(spark, root).select("seg_id").distinct()


def p7_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The pieces of segments beyond the limits."""
    return _pieces(spark, root)


def p7_checked(spark: SparkSession, root: str) -> DataFrame:
    """Whether each cut segment's pieces keep the limits, follow each other without a hole, and cover the text."""
    limit = table(spark, root, "piece_limit").where("item = 'yiddish'").first()
    short = (F.length("text") <= limit["max_chars"]) & F.coalesce(F.col("end_ms") - F.col("start_ms") <= round(limit["max_seconds"] * 1000) + 1, F.lit(True))
    nth = Window.partitionBy("seg_id").orderBy("piece")
    rows = _pieces(spark, root).withColumn("_next", F.lead("begin").over(nth)).withColumn("_following", F.coalesce((F.col("_next") >= F.col("begin")) & (F.col("_next") <= F.col("upto")), F.lit(True)))
    return rows.groupBy("seg_id").agg(F.min("begin").alias("first"), F.max("upto").alias("last"), F.every(short).alias("within"), F.every("_following").alias("following"))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document."""
    return encode(table(spark, root, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, root: str) -> DataFrame:
    """Every document's text out of its token ids."""
    return decode(p8_ids(spark, root), "doc_id")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold at least twelve consecutive words of an evaluation passage."""
    return leaks(table(spark, root, "documents"), table(spark, root, "eval_item")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """The reading level of every document of at least forty words."""
    return reading_levels(table(spark, root, "documents"), table(spark, root, "reading_label"))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_overlaps": p1_overlaps, "p2_found": p2_found, "p2_paragraphs": p2_paragraphs, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_assigned": p5_assigned, "p5_checked": p5_checked, "p6_found": p6_found, "p6_forms": p6_forms, "p7_found": p7_found, "p7_pieces": p7_pieces, "p7_checked": p7_checked, "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_found": p9_found, "p10_found": p10_found}
